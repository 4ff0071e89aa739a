"""Pieces cut again and again until no rule fits, and pieces put together again.

Equal pieces of all targets are one node, told by its canonical key, and are cut
once. ``cut_graph`` finds all nodes and what each is cut into; ``reached`` walks
from the targets to their pieces with joins on keys alone. A piece is a row of
arrays, so that parting or joining two of them moves no data but their rows.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import removed, stored
from .cutting import CLASSIC, Rules, _NUMBER, family, fitting_rules, parts
from .graphs import canonical
from .molecules import Molecules

_ATOM = {"symbol": "string", "aromatic": "boolean", "isotope": "int", "charge": "int", "hydrogens": "int", "degree": "int", "n_ring_bonds": "int"}
ATOMS = f"array<struct<{','.join(f'{k}:{t}' for k, t in _ATOM.items())}>>"
ADJACENT = "array<array<struct<to:int,kind:string,ring:boolean>>>"
_BONDS = "array<struct<to:int,kind:string,ring:boolean>>"


class CutGraph(NamedTuple):
    #: (target_id, key) of the connected parts that targets begin with
    starts: DataFrame
    #: (key, atoms, adj), a row a piece
    nodes: DataFrame
    #: (key, family, child): what a rule of a group cuts a piece into
    edges: DataFrame


def piece_rows(mols: Molecules, placed: DataFrame | None = None) -> DataFrame:
    """(target_id, frag_id, atoms, adj) of each connected part, with what the rules ask of atoms and bonds; atoms count from 0 in the row."""
    own = mols.atoms.join(parts(mols) if placed is None else placed, ["target_id", "atom"])
    end = lambda a, b: mols.bonds.select("target_id", F.col(a).alias("atom"), F.struct(F.col(b).alias("to"), "kind", "ring").alias("b"))
    bonds = end("a1", "a2").unionAll(end("a2", "a1")).groupBy("target_id", "atom").agg(F.sort_array(F.collect_list("b")).alias("bonds"))  # a list as long as an atom's degree
    rows = own.join(bonds, ["target_id", "atom"], "left").groupBy("target_id", "frag_id").agg(F.sort_array(F.collect_list(F.struct("atom", *_ATOM, "bonds"))).alias("rows"))
    here = lambda to: (F.array_position(F.col("rows.atom"), to) - 1).cast("int")
    adj = F.transform("rows", lambda r: F.transform(F.coalesce(r["bonds"], F.array().cast(_BONDS)), lambda b: F.struct(here(b["to"]).alias("to"), b["kind"].alias("kind"), b["ring"].alias("ring"))))
    return rows.select("target_id", "frag_id", F.transform("rows", lambda r: F.struct(*[r[c].alias(c) for c in _ATOM])).cast(ATOMS).alias("atoms"), adj.cast(ADJACENT).alias("adj"))


def _tables(nodes: DataFrame) -> Molecules:
    """Pieces as tables of atoms and bonds, with the key as target."""
    atoms = nodes.select(F.col("key").alias("target_id"), F.posexplode("atoms").alias("atom", "a")).select("target_id", "atom", "a.*")
    each = nodes.select(F.col("key").alias("target_id"), F.size("atoms").alias("n"), F.posexplode("adj").alias("a1", "bs")).select("target_id", "n", "a1", F.explode("bs").alias("b"))
    bonds = each.where("a1 < b.to").select("target_id", (F.col("a1") * F.col("n") + F.col("b.to")).alias("bond_seq"), "a1", F.col("b.to").alias("a2"), "b.kind", "b.ring")
    return Molecules(atoms, bonds, atoms.limit(0))


def _side(here: Column, gone: Column) -> Column:
    """Atoms on the side of ``here`` of a bond to ``gone`` that lies in no ring, ascending."""
    on = lambda seen: F.array_distinct(F.concat(seen, F.flatten(F.transform(seen, lambda i: F.filter(F.transform(F.get(F.col("adj"), i), lambda b: b["to"]), lambda t: t != gone)))))
    step = lambda s, _: F.when(s["still"], s).otherwise(F.transform(F.array(on(s["seen"])), lambda x: F.struct(x.alias("seen"), (F.size(x) == F.size(s["seen"])).alias("still")))[0])
    start = F.struct(F.array(here).cast("array<int>").alias("seen"), F.lit(False).alias("still"))
    return F.array_sort(F.aggregate(F.sequence(F.lit(1), F.size("adj")), start, step)["seen"])


def _heavy(ids: Column) -> Column:
    return F.size(F.filter(ids, lambda i: F.get(F.col("atoms"), i)["symbol"] != "*"))


def _half(ids: Column, here: Column, gone: Column, label: Column) -> Column:
    """(atoms, adj) of the atoms ``ids``, with an attachment point in the place of ``gone``."""
    at = lambda i: (F.array_position(ids, i) - 1).cast("int")
    point = F.struct(F.lit("*").alias("symbol"), F.lit(False).alias("aromatic"), label.cast("int").alias("isotope"), F.lit(0).alias("charge"), F.lit(0).alias("hydrogens"), F.lit(1).alias("degree"), F.lit(0).alias("n_ring_bonds"))
    bond = lambda to: F.array(F.struct(to.cast("int").alias("to"), F.col("kind").alias("kind"), F.lit(False).alias("ring")))
    kept = lambda i: F.transform(F.filter(F.get(F.col("adj"), i), lambda b: b["to"] != gone), lambda b: F.struct(at(b["to"]).alias("to"), b["kind"].alias("kind"), b["ring"].alias("ring")))
    adj = F.transform(ids, lambda i: F.concat(kept(i), F.when(i == here, bond(F.size(ids))).otherwise(F.array().cast(_BONDS))))
    atoms = F.concat(F.transform(ids, lambda i: F.get(F.col("atoms"), i)), F.array(point)).cast(ATOMS)
    return F.struct(atoms.alias("atoms"), F.concat(adj, F.array(bond(at(here)))).cast(ADJACENT).alias("adj"))


def _keyed(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with the canonical key of (atoms, adj); (target_id, frag_id) names a row."""
    rows = stored(rows, name)
    return rows.join(canonical(rows).select("target_id", "frag_id", "key"), ["target_id", "frag_id"])


def _nodes(rows: DataFrame) -> DataFrame:
    """One of the equal pieces of a key."""
    return rows.groupBy("key").agg(F.min_by(F.struct("atoms", "adj"), F.xxhash64("atoms", "adj")).alias("p")).select("key", "p.*")


def cut_graph(mols: Molecules, rules: Rules = CLASSIC, min_size: int = 1, single_pass: bool = False) -> CutGraph:
    """All pieces that ``mols`` can be cut into, one bond at a time.

    A cut counts if both sides have ``min_size`` atoms beside attachment points. A
    piece's environments are those of the piece itself, with its points as
    atoms. Bonds in rings stay, as one cut does not part them. With
    ``single_pass`` only the targets are cut. There are as many rounds as cuts
    that follow one another; in each, only pieces not met before are cut.
    Parts of one target that hang together by no bond are cut each on its own.
    """
    first = stored(_keyed(piece_rows(mols), "parts"), "named-parts")
    starts = first.select("target_id", "key").distinct()
    new = stored(_nodes(first), "pieces")
    nodes, edges = new, None
    while True:
        fits = fitting_rules(_tables(new), rules).where("not ring and (label1 <> label2 or a1 < a2)")
        ways = fits.select("target_id", "a1", "a2", "kind", "label1", "label2", "family").distinct().join(new.withColumnRenamed("key", "target_id"), "target_id")
        sides = ways.withColumn("s", F.explode(F.array(F.struct(_side(F.col("a1"), F.col("a2")).alias("one"), _side(F.col("a2"), F.col("a1")).alias("two")))))
        if min_size > 0:
            sides = sides.where((_heavy(F.col("s.one")) >= min_size) & (_heavy(F.col("s.two")) >= min_size))
        halves = F.array(_half(F.col("s.one"), F.col("a1"), F.col("a2"), F.col("label1")), _half(F.col("s.two"), F.col("a2"), F.col("a1"), F.col("label2")))
        name = F.struct(F.col("target_id").alias("key"), "family", "a1", "a2", "label1", "label2")
        apart = sides.select(name.alias("target_id"), F.posexplode(halves).alias("frag_id", "p")).select("target_id", "frag_id", "p.*")
        named = stored(_keyed(apart, "halves"), "named-halves")
        cut = named.select("target_id.key", "target_id.family", F.col("key").alias("child")).distinct()
        edges = cut if edges is None else edges.unionAll(cut)
        new = stored(_nodes(named).join(nodes.select("key"), "key", "left_anti"), "pieces")
        if new.isEmpty():
            break
        nodes = nodes.unionAll(new)
        if single_pass:
            break
    return CutGraph(starts, nodes, stored(edges, "cuts-of-pieces"))


def reached(graph: CutGraph, rules: Rules = CLASSIC, keep_nodes: bool = False) -> DataFrame:
    """(target_id, key): the pieces of each target that no rule cuts, or with ``keep_nodes`` all on the way, the target itself included.

    The groups of rules follow one another: what a group makes is cut by it and
    by later ones, and by no earlier one. A piece that a target has had before is
    not taken up again.
    """
    have = {r[0] for r in graph.edges.select("family").distinct().collect()}  # groups of rules: a few dozen
    pool = seen = graph.starts
    for group in dict.fromkeys(family(*p[:2]) for p in rules.pairs if family(*p[:2]) in have):
        cuts = graph.edges.where(F.col("family") == group).select("key", "child")
        active, left = pool, None
        while True:
            whole = active if keep_nodes else stored(active.join(cuts, "key", "left_anti").select("target_id", "key"), "uncut")
            left = whole if left is None else left.unionAll(whole)
            made = active.join(cuts, "key").select("target_id", F.col("child").alias("key")).distinct()
            active = stored(made.join(seen, ["target_id", "key"], "left_anti"), "made")
            if active.isEmpty():
                removed(active)
                break
            seen = seen.unionAll(active)
        pool = left
    return seen if keep_nodes else pool


def decompose(mols: Molecules, rules: Rules = CLASSIC, min_size: int = 1, keep_nodes: bool = False, single_pass: bool = False) -> DataFrame:
    """(target_id, key, atoms, adj): the pieces of each target, each once; see ``cut_graph`` and ``reached``."""
    graph = cut_graph(mols, rules, min_size, single_pass)
    if single_pass:
        cut = graph.starts.join(graph.edges.select("key", "child"), "key").select("target_id", F.col("child").alias("key"))
        found = graph.starts.unionAll(cut).distinct()
    else:
        found = reached(graph, rules, keep_nodes)
    return found.join(graph.nodes, "key").select("target_id", "key", "atoms", "adj")


# --- putting together ------------------------------------------------------


def _points(pieces: DataFrame, side: str) -> DataFrame:
    """A row for each attachment point of each piece, its columns named after ``side``."""
    each = pieces.select("target_id", "key", "atoms", "adj", F.posexplode("atoms").alias("p", "a")).where("a.symbol = '*' and a.isotope is not null and size(adj[p]) = 1")
    bond = F.get(F.get(F.col("adj"), F.col("p")), F.lit(0))
    return each.select("target_id", "key", "atoms", "adj", "p", bond["to"].alias("at"), bond["kind"].alias("kind"), F.col("a.isotope").alias("label")).select("target_id", "kind", *[F.col(c).alias(f"{side}_{c}") for c in ("key", "atoms", "adj", "p", "at", "label")])


def _joined() -> Column:
    """(atoms, adj) of two pieces without their points, the atoms beside these bonded."""
    n = F.size("a_atoms")
    to_a = lambda i: (i - (i > F.col("a_p")).cast("int")).cast("int")
    to_b = lambda i: (n - 1 + i - (i > F.col("b_p")).cast("int")).cast("int")

    def of(side: str, to, other: Column) -> Column:
        p, at = F.col(f"{side}_p"), F.col(f"{side}_at")
        kept = lambda bs: F.transform(F.filter(bs, lambda b: b["to"] != p), lambda b: F.struct(to(b["to"]).alias("to"), b["kind"].alias("kind"), b["ring"].alias("ring")))
        tie = F.array(F.struct(other.alias("to"), F.col("kind").alias("kind"), F.lit(False).alias("ring")))
        rows = F.transform(F.col(f"{side}_adj"), lambda bs, i: F.concat(kept(bs), F.when(i == at, tie).otherwise(F.array().cast(_BONDS))))
        return F.filter(rows, lambda bs, i: i != p)

    atoms = F.concat(F.filter("a_atoms", lambda x, i: i != F.col("a_p")), F.filter("b_atoms", lambda x, i: i != F.col("b_p")))
    return F.struct(atoms.cast(ATOMS).alias("atoms"), F.concat(of("a", to_a, to_b(F.col("b_at"))), of("b", to_b, to_a(F.col("a_at")))).cast(ADJACENT).alias("adj"))


def recombine(pieces: DataFrame, rules: Rules = CLASSIC, max_depth: int = 3, only_complete: bool = True, seeds: DataFrame | None = None) -> DataFrame:
    """(target_id, key, depth, complete, atoms, adj): what the pieces of a target can be put together to, each once.

    ``pieces`` and ``seeds`` (without them, the pieces) have (target_id, key, atoms,
    adj); a target is a library of pieces that are joined with one another. A point
    of a seed and one of a piece are joined where a rule has their two labels,
    whichever way round, and their kind of bond. Results that still have points are the seeds of the next
    depth, up to ``max_depth``; ``depth`` is the first one a result comes at. Results
    come out in no order. The joins are on (target, label, kind of bond).
    """
    spark = pieces.sparkSession
    number = lambda x: int(_NUMBER.sub("", x))
    fits = sorted({(number(x), number(y), kind) for a, b, kind, _ in rules.pairs for x, y in ((a, b), (b, a))})
    fits = spark.createDataFrame(fits, "a_label int, b_label int, kind string")
    own = stored(_points(pieces, "b"), "points")
    now, seen = pieces if seeds is None else seeds, None
    for depth in range(max_depth + 1):
        ends = _points(now, "a").join(F.broadcast(fits), ["a_label", "kind"])  # a few hundred rules at most
        pairs = ends.join(own, ["target_id", "b_label", "kind"])
        name = F.struct(F.col("target_id").alias("target_id"), "a_key", "a_p", "b_key", "b_p")
        made = _keyed(pairs.select(name.alias("target_id"), F.lit(0).alias("frag_id"), _joined().alias("p")).select("target_id", "frag_id", "p.*"), "joined")
        one = made.groupBy("target_id.target_id", "key").agg(F.min_by(F.struct("atoms", "adj"), F.xxhash64("atoms", "adj")).alias("p")).select("target_id", "key", "p.*")
        if seen is not None:
            one = one.join(seen.select("target_id", "key"), ["target_id", "key"], "left_anti")
        complete = ~F.exists("atoms", lambda a: a["symbol"] == "*")
        new = stored(one.select("target_id", "key", F.lit(depth).alias("depth"), complete.alias("complete"), "atoms", "adj"), "products")
        seen = new if seen is None else seen.unionAll(new)
        now = new.where("not complete").select("target_id", "key", "atoms", "adj")
        if now.isEmpty():
            break
    return seen.where("complete") if only_complete else seen
