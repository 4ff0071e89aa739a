"""Molecules as tables of atoms and bonds: cut into fragments, and put together again as combs.

``atoms`` has (target_id, atom), ``bonds`` (target_id, bond_seq, a1, a2, cut). Atoms
are numbers; bonds that are cut link fragments, the others lie within one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bits import NARROW, Bits
from ..tables import removed, stored
from .combs import reached


def fragments(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """(target_id, atom, frag_id): the parts that stay whole when all cut bonds break, numbered from 0 by their lowest atoms.

    Atoms take the lowest number among their neighbours, then that one's own, so
    that long chains close up in few steps. Targets share no rows: the joins are
    on (target, atom) and all targets advance together. Atoms without a bond are
    fragments of their own; a bond with an end that is no atom of its target
    links nothing.
    """
    whole = bonds.where("not cut and a1 <> a2")
    links = stored(whole.select("target_id", "a1", "a2").unionAll(whole.select("target_id", F.col("a2").alias("a1"), F.col("a1").alias("a2"))).distinct(), "links")
    now = stored(atoms.select("target_id", "atom").distinct().withColumn("low", F.col("atom")), "lowest")
    while True:
        near = links.join(now.select("target_id", F.col("atom").alias("a2"), "low"), ["target_id", "a2"]).groupBy("target_id", F.col("a1").alias("atom")).agg(F.min("low").alias("near"))
        nearer = now.join(near, ["target_id", "atom"], "left").select("target_id", "atom", F.col("low").alias("was"), F.least("low", F.coalesce("near", "low")).alias("up"))
        own = now.select("target_id", F.col("atom").alias("up"), "low")
        after = stored(nearer.join(own, ["target_id", "up"]).select("target_id", "atom", "was", "low"), "lowest")
        removed(now)
        now = after
        if now.where("low <> was").isEmpty():
            break
    number = F.dense_rank().over(Window.partitionBy("target_id").orderBy("low")) - 1
    return now.select("target_id", "atom", number.alias("frag_id"))


def cuts(bonds: DataFrame, placed: DataFrame) -> DataFrame:
    """(target_id, bond_seq, a1, a2, u, v): cut bonds with the fragments of their ends; ``placed`` is what ``fragments`` gives."""
    end = lambda a, f: placed.select("target_id", F.col("atom").alias(a), F.col("frag_id").alias(f))
    return bonds.where("cut").join(end("a1", "u"), ["target_id", "a1"]).join(end("a2", "v"), ["target_id", "a2"]).select("target_id", "bond_seq", "a1", "a2", "u", "v")


def broken(combs: DataFrame, cuts_: DataFrame, bits: Bits = NARROW) -> DataFrame:
    """(target_id, mask, bond_seq, a1, a2, u, v): the cuts that stay when a comb is put together: all but those between two of its fragments."""
    inside = lambda f: bits.has(F.col("mask"), F.col(f))
    return combs.select("target_id", "mask").distinct().join(cuts_, "target_id").where(~(inside("u") & inside("v")))


def assembled(combs: DataFrame, placed: DataFrame, cuts_: DataFrame, bits: Bits = NARROW) -> DataFrame:
    """(target_id, mask, atoms, ends): what a comb is once only the cuts inside it are closed.

    ``atoms`` are those of the piece that holds the first atom of the comb's
    lowest fragment, ascending: all of the comb's, if it is connected. ``ends``
    are the atoms of that piece at which a cut stays open, one for each such cut,
    ascending. Fragments that are no part of the target add nothing; a comb
    without any fragment has no row.
    """
    pieces = stored(reached(combs.select("target_id", "mask").distinct(), cuts_, bits).where(F.col("mask") != bits.zero()), "pieces")
    holds = lambda f: bits.has(F.col("reached"), F.col(f))
    inner = pieces.join(placed, "target_id").where(holds("frag_id")).groupBy("target_id", "mask").agg(F.sort_array(F.collect_list("atom")).alias("atoms"))
    open_ = pieces.join(cuts_, "target_id").where(holds("u") != holds("v")).select("target_id", "mask", F.when(holds("u"), F.col("a1")).otherwise(F.col("a2")).alias("end"))
    ends = open_.groupBy("target_id", "mask").agg(F.sort_array(F.collect_list("end")).alias("ends"))
    joined = inner.join(ends, ["target_id", "mask"], "left")
    return joined.select("target_id", "mask", "atoms", F.coalesce("ends", F.slice("atoms", 1, 0)).alias("ends"))
