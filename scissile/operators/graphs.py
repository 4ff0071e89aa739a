"""A molecule or fragment as one row: canonical keys and strict matching by SQL folds over its arrays.

Targets are joined and shuffled as whole rows; what happens inside one, colours
that are refined or partial maps that grow, is a fold over the row and moves no data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import once
from ..tables import stored
from .molecules import Molecules

_ADJACENT = "array<array<struct<to:int,kind:string>>>"
_KIND = ["symbol", "aromatic", "isotope", "charge", "hydrogens"]


def graph_rows(mols: Molecules, parts: DataFrame | None = None) -> DataFrame:
    """(target_id, frag_id, ids, atoms, adj) a connected part of ``parts`` (target_id, atom, frag_id), or without it a target with frag_id 0.

    ``ids`` are the atoms' numbers, ascending, ``atoms`` what they are, ``adj`` their
    bonds (to, kind), where ``to`` counts from 0 in the row.
    """
    placed = mols.atoms.join(parts, ["target_id", "atom"]) if parts is not None else mols.atoms.withColumn("frag_id", F.lit(0))
    ends = lambda a, b: mols.bonds.select("target_id", F.col(a).alias("atom"), F.struct(F.col(b).alias("to"), "kind").alias("b"))
    bonds = ends("a1", "a2").unionAll(ends("a2", "a1")).groupBy("target_id", "atom").agg(F.sort_array(F.collect_list("b")).alias("bonds"))  # a list as long as an atom's degree
    rows = placed.join(bonds, ["target_id", "atom"], "left").groupBy("target_id", "frag_id").agg(F.sort_array(F.collect_list(F.struct("atom", *_KIND, "bonds"))).alias("rows"))
    ids = F.col("rows.atom")
    here = lambda to: (F.array_position(ids, to) - 1).cast("int")
    adj = F.transform("rows", lambda r: F.transform(F.filter(F.coalesce(r["bonds"], F.array().cast("array<struct<to:int,kind:string>>")), lambda b: F.array_contains(ids, b["to"])), lambda b: F.struct(here(b["to"]).alias("to"), b["kind"].alias("kind"))))
    atoms = F.transform("rows", lambda r: F.struct(*[r[c].alias(c) for c in _KIND]))
    return rows.select("target_id", "frag_id", ids.alias("ids"), atoms.alias("atoms"), adj.cast(_ADJACENT).alias("adj"))


def _label(a: Column, numbered_points: bool) -> Column:
    """An atom as text; attachment points without their numbers unless these are asked for."""
    isotope = a["isotope"] if numbered_points else F.when(a["symbol"] != "*", a["isotope"])
    return F.concat(F.coalesce(isotope.cast("string"), F.lit("")), F.when(a["aromatic"], F.lower(a["symbol"])).otherwise(a["symbol"]), F.lit("H"), a["hydrogens"].cast("string"), F.when(a["charge"] != 0, F.format_string("%+d", a["charge"])).otherwise(""))


def _refined(colours: Column, adj: Column) -> Column:
    """Colours that are told apart by their neighbours' until none is told apart any more; equal graphs get equal colours."""
    hashed = lambda c: F.transform(adj, lambda bs, i: F.xxhash64(F.get(c, i), F.array_sort(F.transform(bs, lambda b: F.xxhash64(b["kind"], F.get(c, b["to"]))))))
    kinds = lambda c: F.size(F.array_distinct(c))

    def on(s: Column, _: Column) -> Column:
        step = once(hashed(s["c"]), lambda c: F.struct(c.alias("c"), kinds(c).alias("k"), (kinds(c) == s["k"]).alias("still")))
        return F.when(s["still"], s).otherwise(step).cast("struct<c:array<bigint>,k:int,still:boolean>")

    start = F.struct(colours.alias("c"), kinds(colours).alias("k"), F.lit(False).alias("still")).cast("struct<c:array<bigint>,k:int,still:boolean>")
    return F.aggregate(F.sequence(F.lit(0), F.size(adj)), start, on)["c"]


def _twice(c: Column) -> Column:
    """Colours that several atoms have, ascending."""
    ordered = F.array_sort(c)
    return F.array_distinct(F.filter(ordered, lambda x, i: (i > 0) & (x == F.get(ordered, i - 1))))


def _choices(c: Column, adj: Column) -> Column:
    """Atoms of the first colour that several have, each of which is told from the rest once.

    Of atoms that hang on one neighbour by equal bonds one is enough, as they can be
    swapped. Where every colour has two atoms at most, all pairs can be swapped
    together, and one atom is enough as well.
    """
    several = _twice(c)
    same = F.filter(F.sequence(F.lit(0), F.size(c) - 1), lambda i: F.get(c, i) == F.get(several, F.lit(0)))
    one = lambda i: F.get(F.get(adj, i), F.lit(0))
    twin = lambda i: F.exists(same, lambda j: (j < i) & (F.size(F.get(adj, i)) == 1) & (F.size(F.get(adj, j)) == 1) & (one(i) == one(j)))
    pairs = F.size(c) - F.size(F.array_distinct(c)) == F.size(several)
    return F.when(pairs, F.slice(same, 1, 1)).otherwise(F.filter(same, lambda i: ~twin(i)))


def _certificate(c: Column, labels: Column, adj: Column) -> Column:
    """A graph whose colours all differ, as text: atoms in the order of their colours, then bonds."""
    ordered = F.array_sort(c)
    place = lambda i: (F.array_position(ordered, F.get(c, i)) - 1).cast("int")
    atoms = F.transform(ordered, lambda x: F.get(labels, (F.array_position(c, x) - 1).cast("int")))
    each = F.flatten(F.transform(adj, lambda bs, i: F.transform(F.filter(bs, lambda b: place(i) < place(b["to"])), lambda b: F.struct(place(i).alias("a"), place(b["to"]).alias("b"), b["kind"].alias("kind")))))
    bonds = F.transform(F.array_sort(each), lambda b: F.concat(b["a"].cast("string"), b["kind"], b["b"].cast("string")))
    return F.concat(F.array_join(atoms, " "), F.lit(" | "), F.array_join(bonds, " "))


def canonical(rows: DataFrame, numbered_points: bool = True) -> DataFrame:
    """(target_id, frag_id, certificate, key): equal for graphs that differ only in the order of their atoms, and for no others.

    ``rows`` as from ``graph_rows``, connected. Atoms are coloured by what they are
    and refined by their neighbours; where several stay alike, each is told from the
    rest in a row of its own, and the least text of all that come out is the
    graph's. All graphs take such a step together. Stereo marks are left out.
    """
    labels = F.transform("atoms", lambda a: _label(a, numbered_points))
    graphs = stored(rows.select("target_id", "frag_id", labels.alias("labels"), "adj"), "graphs")
    coloured = graphs.withColumn("c", F.transform("labels", lambda x: F.xxhash64(x)))
    done: DataFrame | None = None
    while True:
        # The explode keeps the refined colours from being worked out anew in each place that reads them.
        step = stored(coloured.select("target_id", "frag_id", "labels", "adj", F.explode(F.array(_refined(F.col("c"), F.col("adj")))).alias("c")), "colours")
        alike = F.size(F.array_distinct("c")) < F.size("c")
        whole = step.where(~alike).select("target_id", "frag_id", _certificate(F.col("c"), F.col("labels"), F.col("adj")).alias("certificate"))
        done = whole if done is None else done.unionAll(whole)
        if (open_ := step.where(alike)).isEmpty():
            break
        told = open_.withColumn("i", F.explode(_choices(F.col("c"), F.col("adj"))))
        coloured = told.withColumn("c", F.transform("c", lambda x, k: F.when(k == F.col("i"), F.xxhash64(x, F.lit(1))).otherwise(x))).drop("i")
    least = done.groupBy("target_id", "frag_id").agg(F.min("certificate").alias("certificate"))
    return least.withColumn("key", F.sha2("certificate", 256))


# --- strict matching -------------------------------------------------------

_STEP = "array<struct<atom:int,anchor:int,kind:string,closures:array<struct<at:int,kind:string>>>>"


def patterns(rows: DataFrame) -> DataFrame:
    """(query_id, wanted, steps): what each atom of a fragment asks for, and the order in which a map takes them in.

    ``wanted`` has (symbol, free, charge, least, most): attachment points are free, others
    ask for their element and number of hydrogens, one more of these if they have an
    attachment point; charged atoms ask for their charge alone. ``steps`` begin
    at the first atom of the row and go along bonds, attachment points last.
    """
    point = lambda i: F.get(F.col("atoms"), i)["symbol"] == "*"
    n, every = F.size("atoms"), F.sequence(F.lit(0), F.size("atoms") - 1)
    wanted = F.transform("atoms", lambda a, i: F.struct(
        a["symbol"].alias("symbol"), (a["symbol"] == "*").alias("free"), a["charge"].alias("charge"), F.when(a["charge"] == 0, a["hydrogens"]).alias("least"),
        F.when(a["charge"] == 0, a["hydrogens"] + F.exists(F.get(F.col("adj"), i), lambda b: point(b["to"])).cast("int")).alias("most")))
    start = F.coalesce(F.get(F.filter(every, lambda i: ~point(i)), F.lit(0)), F.lit(0))
    reach = lambda seen: F.filter(every, lambda i: ~F.array_contains(seen, i) & F.exists(F.get(F.col("adj"), i), lambda b: F.array_contains(seen, b["to"])))
    # Attachment points sort behind all others.
    nearest = lambda seen: F.array_min(F.transform(reach(seen), lambda i: F.when(point(i), i + n).otherwise(i))) % n
    order = F.aggregate(F.filter(every, lambda i: i > 0), F.array(start), lambda seen, _: F.concat(seen, F.array_compact(F.array(nearest(seen)))))
    rows = rows.where(n > 0).select(F.col("target_id").alias("query_id"), "atoms", "adj", wanted.alias("wanted"), F.explode(F.array(order)).alias("order"))
    at = lambda i: (F.array_position("order", i) - 1).cast("int")

    def step(i: Column, k: Column) -> Column:
        back = F.filter(F.get(F.col("adj"), i), lambda b: at(b["to"]) < k)
        first = F.array_min(F.transform(back, lambda b: at(b["to"])))
        kind = F.get(F.filter(back, lambda b: at(b["to"]) == first), F.lit(0))["kind"]
        more = F.transform(F.filter(back, lambda b: at(b["to"]) != first), lambda b: F.struct(at(b["to"]).alias("at"), b["kind"].alias("kind")))
        return F.struct(i.alias("atom"), first.alias("anchor"), kind.alias("kind"), more.alias("closures"))

    checked = F.when(F.size("order") < F.size("atoms"), F.raise_error(F.lit("a pattern must be connected"))).otherwise(F.transform("order", step).cast(_STEP))
    return rows.select("query_id", "wanted", checked.alias("steps"))


def _fits(w: Column, a: Column) -> Column:
    return w["free"] | ((w["symbol"] == a["symbol"]) & (w["charge"] == a["charge"]) & F.coalesce(a["hydrogens"].between(w["least"], w["most"]), F.lit(True)))


def strict_matches(pairs: DataFrame, patterns_: DataFrame, stock: DataFrame) -> DataFrame:
    """(query_id, bb_id) of those ``pairs`` whose item holds the fragment, with no atom beside it but at attachment points.

    ``stock`` as from ``graph_rows``, with bb_id in place of target_id. A pair is a row
    with both graphs: the maps of the first k atoms are grown by each bond of the
    next one's anchor, and those that do not close the pattern's other bonds go. A
    hydrogen counts as one place that as many attachment points can take as the
    atom has hydrogens. Stereo marks are not compared.
    """
    items = stock.select("bb_id", "atoms", "adj")
    rows = pairs.select("query_id", "bb_id").distinct().join(patterns_, "query_id").join(items, "bb_id")
    atom = lambda i: F.get(F.col("atoms"), i)
    # -1 - i: a hydrogen of atom i.
    free_h = lambda m, i: F.when(atom(i)["hydrogens"] > F.size(F.filter(m, lambda x: x == -1 - i)), F.array(F.struct((-1 - i).alias("to"), F.lit("-").alias("kind")))).otherwise(F.array().cast("array<struct<to:int,kind:string>>"))

    def grown(m: Column, s: Column) -> Column:
        at = F.get(m, s["anchor"])
        w = F.get(F.col("wanted"), s["atom"])
        near = F.filter(F.get(F.col("adj"), at), lambda b: (b["kind"] == s["kind"]) & ~F.array_contains(m, b["to"]) & _fits(w, atom(b["to"])))
        near = F.when(w["free"] & (s["kind"] == "-"), F.concat(near, free_h(m, at))).otherwise(near)
        closed = lambda b: F.forall(s["closures"], lambda c: F.exists(F.get(F.col("adj"), b["to"]), lambda x: (x["to"] == F.get(m, c["at"])) & (x["kind"] == c["kind"])))
        return F.transform(F.filter(near, closed), lambda b: F.array_append(m, b["to"]))

    first = F.get(F.col("steps"), F.lit(0))["atom"]
    seeds = F.transform(F.filter(F.sequence(F.lit(0), F.size("atoms") - 1), lambda i: _fits(F.get(F.col("wanted"), first), atom(i))), lambda i: F.array(i)).cast("array<array<int>>")
    maps = F.aggregate(F.slice("steps", 2, F.greatest(F.size("steps") - 1, F.lit(0))), seeds, lambda ms, s: F.flatten(F.transform(ms, lambda m: grown(m, s))).cast("array<array<int>>"))
    return rows.where(F.size("atoms") > 0).where(F.size(maps) > 0).select("query_id", "bb_id")


def _signature(symbol: Column, charge: Column, hydrogens: Column) -> Column:
    return F.concat_ws("/", symbol, charge.cast("string"), hydrogens.cast("string"))


def signature_pairs(patterns_: DataFrame, stock: DataFrame) -> DataFrame:
    """(query_id, bb_id) that can match: the item has an atom like the rarest one of the pattern whose hydrogens are fixed.

    An equi-join on what an atom is; an item has a row for each kind of its atoms.
    Patterns without such an atom meet the items by the kinds that one of their
    atoms may have; those of attachment points only meet every item that has atoms.
    """
    held = stock.select("bb_id", F.explode(F.array_distinct(F.transform("atoms", lambda a: _signature(a["symbol"], a["charge"], a["hydrogens"])))).alias("kind"))
    common = held.groupBy("kind").agg(F.count("*").alias("held"))
    asked = patterns_.select("query_id", F.posexplode("wanted").alias("pos", "w")).where("not w.free")
    # A charged atom may have any number of hydrogens: its kinds are those that the stock knows.
    span = F.sequence(F.coalesce("w.least", F.lit(0)), F.coalesce("w.most", F.lit(8)))
    kinds = asked.withColumn("kind", F.explode(F.transform(span, lambda h: _signature(F.col("w.symbol"), F.col("w.charge"), h))))
    total = kinds.join(F.broadcast(common), "kind", "left").groupBy("query_id", "pos").agg(F.sum(F.coalesce("held", F.lit(0))).alias("held"))  # kinds are elements with charges and hydrogens: a few thousand
    rarest = total.groupBy("query_id").agg(F.min_by("pos", F.struct("held", "pos")).alias("pos"))
    found = kinds.join(rarest, ["query_id", "pos"]).join(held, "kind").select("query_id", "bb_id")
    bare = patterns_.where(F.forall("wanted", lambda w: w["free"])).select("query_id", F.lit("").alias("any"))
    every = stock.where(F.size("atoms") > 0).select("bb_id", F.lit("").alias("any"))
    return found.unionAll(bare.join(every, "any").select("query_id", "bb_id")).distinct()
