"""Which bonds lie in rings: bridges of all graphs at once.

A spanning forest leaves out one bond a ring. Each bond left out has a random
number, which its two ends hold; the numbers of a branch, combined by exclusive or,
are those of the bonds that lead out of it. A bond of the forest is in a ring just
if some do, so if the number is not 0 (but for a chance of 2^-64). Branches are
summed by doubling: after k rounds an atom has what lies fewer than 2^k steps below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import removed, stored


def _distances(links: DataFrame) -> DataFrame:
    """(target_id, atom, far): from the lowest atom of every connected part, in ``links`` (target_id, near, atom) that go both ways.

    Atoms take the lowest atom that they have heard of, and the least distance from it; the lowest of
    a part is given up nowhere, so that after k rounds all within k bonds of it have both. Only what is new to an atom is
    told to its neighbours. Parts and distances are found in one loop.
    """
    start = F.struct(F.col("atom").alias("low"), F.lit(0).alias("far"))
    now = stored(links.select("target_id", "atom").distinct().select("target_id", "atom", start.alias("x"), F.lit(True).alias("new")), "distances")
    while not now.where("new").isEmpty():
        told = now.where("new").select("target_id", F.col("atom").alias("near"), F.struct("x.low", (F.col("x.far") + 1).alias("far")).alias("x")).join(links, ["target_id", "near"])
        own = now.select("target_id", "atom", "x", F.col("x").alias("was"))
        both = own.unionAll(told.select("target_id", "atom", "x", F.lit(None).cast(own.schema["was"].dataType)))
        least = both.groupBy("target_id", "atom").agg(F.min("x").alias("x"), F.max("was").alias("was"))
        after = stored(least.select("target_id", "atom", "x", (F.col("x") != F.col("was")).alias("new")), "distances")
        removed(now)
        now = after
    return now.select("target_id", "atom", F.col("x.far").alias("far"))


def spanning_forest(bonds: DataFrame) -> DataFrame:
    """(target_id, atom, parent, bond_seq) for the atoms that are no root, from ``bonds`` (target_id, bond_seq, a1, a2).

    Breadth first, from the lowest atom of every connected part; all parts take a
    step a round. For tables that come from text, take the order of the text.
    """
    plain = stored(bonds.where("a1 <> a2").select("target_id", "bond_seq", "a1", "a2"), "plain-bonds")
    way = lambda a, b: plain.select("target_id", "bond_seq", F.col(a).alias("near"), F.col(b).alias("atom"))
    both = way("a1", "a2").unionAll(way("a2", "a1"))
    links = stored(both.select("target_id", "near", "atom").distinct(), "links")
    far = _distances(links)
    ends = both.join(far, ["target_id", "atom"]).join(far.select("target_id", F.col("atom").alias("near"), F.col("far").alias("near_far")), ["target_id", "near"])
    first = ends.where("far = near_far + 1").groupBy("target_id", "atom").agg(F.min(F.struct("near", "bond_seq")).alias("x"))
    return first.select("target_id", "atom", F.col("x.near").cast("long").alias("parent"), F.col("x.bond_seq").cast("long").alias("bond_seq"))


def ring_bonds(bonds: DataFrame, parents: DataFrame | None = None) -> DataFrame:
    """(target_id, bond_seq) of the bonds of ``bonds`` (target_id, bond_seq, a1, a2) that lie in a ring.

    ``parents`` is a spanning forest as ``spanning_forest`` gives it, if one is at
    hand. A bond of an atom with itself is none in a ring; of two bonds between two
    atoms both are. Targets without bonds left out by the forest cost nothing.
    """
    parents = stored(spanning_forest(bonds), "forest") if parents is None else parents
    extra = stored(bonds.where("a1 <> a2").join(parents.select("target_id", "bond_seq"), ["target_id", "bond_seq"], "left_anti").select("target_id", "bond_seq", "a1", "a2"), "extra-bonds")
    number = F.xxhash64(F.col("target_id").cast("string"), F.col("bond_seq").cast("long"))
    held = extra.select("target_id", F.explode(F.array("a1", "a2")).alias("atom"), number.alias("x")).groupBy("target_id", "atom").agg(F.bit_xor("x").alias("x"))
    cyclic = extra.select("target_id").distinct()
    tree = parents.join(cyclic, "target_id", "left_semi").select("target_id", "atom", F.col("parent").alias("up"))
    now = stored(tree.join(held, ["target_id", "atom"], "left").select("target_id", "atom", "up", F.coalesce("x", F.lit(0).cast("long")).alias("x")), "branches")
    while not now.where("up is not null").isEmpty():
        below = now.where("up is not null").groupBy("target_id", F.col("up").alias("atom")).agg(F.bit_xor("x").alias("more"))
        higher = now.select("target_id", F.col("atom").alias("up"), F.col("up").alias("next"))
        after = now.join(below, ["target_id", "atom"], "left").join(higher, ["target_id", "up"], "left")
        after = stored(after.select("target_id", "atom", F.col("next").alias("up"), F.col("x").bitwiseXOR(F.coalesce("more", F.lit(0).cast("long"))).alias("x")), "branches")
        removed(now)
        now = after
    inside = parents.join(now.where("x <> 0").select("target_id", "atom"), ["target_id", "atom"], "left_semi")
    return inside.select("target_id", "bond_seq").unionAll(extra.select("target_id", "bond_seq"))
