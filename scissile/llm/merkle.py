"""Merkle manifest of a dataset by a tree of SHA-256 states (op 13).

Rows are leaves, numbered by source and doc_id; every 16 neighbours hash to a
parent until a source has one digest, its subroot, and the subroots likewise hash
to the root. A task takes a run of ``RUN`` neighbours and the two levels above
them. A parent keeps a copy of its hash state before each child's slot, so that
a leaf that changed is folded upwards from the copy before it: with the new
digest and the siblings to its right, while those to its left are not hashed
again. What lies above a run is the same for all its leaves: the state before
the run and the siblings after it come down once a run.

Hex digests are hashed as text. A digest is 64 characters, so that siblings are
slices of their parent's children in a row.

Defined cases: a null column is written ``-``, an empty text ``0:``; a null source
is a source of its own and comes first, an empty one is another; a null doc_id
comes first in its source and is never tampered with; rows of one doc_id are
leaves of their own, in the order of their digests; repeated rows are equal
leaves side by side; one row alone is its leaf, subroot and root; an empty table
gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import sha256
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.running import so_far
from .common import removed, table, written

#: Children of a parent.
FAN = 16
#: Levels that one task folds, and the leaves below them.
LEVELS = 2
RUN = FAN**LEVELS
_HEX = 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Parent:
    """A parent of up to 16 digests, with its hash state before each of them."""

    def __init__(self, children: list[str]):
        self.row = "".join(children)
        self.before, state = [], sha256()
        for c in children:
            self.before.append(state.copy())
            state.update(c.encode())
        self.digest = state.hexdigest()

    def folded(self, slot: int, child: str) -> str:
        """The digest with ``child`` in a slot: the state before it goes on with the child and what lies to the right."""
        return resumed(self.before[slot], child, self.row[_HEX * (slot + 1) :])

    def siblings(self, slot: int) -> tuple[str, str]:
        """The digests before a slot and after it, in a row."""
        return self.row[: _HEX * slot], self.row[_HEX * (slot + 1) :]


def resumed(state, child: str, after: str) -> str:
    state = state.copy()
    state.update((child + after).encode())
    return state.hexdigest()


def levels_above(digests: list[str], n: int) -> list[list[Parent]]:
    """Parents of a run of neighbours, level by level; ``n`` nodes in all are on their level."""
    out: list[list[Parent]] = []
    while n > 1 and len(out) < LEVELS:
        out.append([Parent(digests[k : k + FAN]) for k in range(0, len(digests), FAN)])
        digests, n = [p.digest for p in out[-1]], -(-n // FAN)
    return out


#: Nodes of a storey, paths of the runs above them (place -1) and leaves share these columns.
_COLUMNS = {
    "tree": "string", "run": "long", "place": "long", "n": "long", "digest": "string", "doc_id": "long", "tampered": "string",
    "subroot": "string", "root": "string", "path": "array<struct<before:string,after:string>>",
}
_NODE = "tree string, place long, n long, digest string"
_PATH = f"tree string, place long, subroot string, root string, path {_COLUMNS['path']}"
_LEAF = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        yield from b.to_pylist()


def _batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)


def _arrow(spec: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), _COLUMNS["path"]: pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))}
    return pa.schema([(c.split(" ", 1)[0], kinds[c.split(" ", 1)[1]]) for c in spec.split(", ")])


def _in_runs(df: DataFrame, work, spec: str) -> DataFrame:
    """``work`` (rows of a run, by place) over all runs; a run has at most ``RUN`` rows and the path above it."""
    schema = _arrow(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (list(g) for _, g in groupby(_rows(batches), key=lambda r: (r["tree"], r["run"])))
        yield from _batches((x for g in each for x in work(g)), schema)

    return df.repartition("tree", "run").sortWithinPartitions("tree", "run", "place").mapInArrow(run, spec)


def _run_of(place: str = "place") -> Column:
    return F.floor(F.col(place) / RUN)


def _like_all(df: DataFrame) -> DataFrame:
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in _COLUMNS.items()])


def _collapsed(rows: list[dict]) -> Iterator[tuple]:
    up = levels_above([r["digest"] for r in rows], rows[0]["n"])
    yield rows[0]["tree"], rows[0]["run"], -(-rows[0]["n"] // FAN ** len(up)), up[-1][0].digest


def _climb(up: list[list[Parent]], k: int) -> Iterator[tuple[Parent, int]]:
    """The parents above child ``k`` of a run, and its slots in them."""
    for level in up:
        yield level[k // FAN], k % FAN
        k //= FAN


def _descended(rows: list[dict]) -> Iterator[tuple]:
    top, nodes = rows[0], rows[1:]
    up = levels_above([r["digest"] for r in nodes], nodes[0]["n"])
    for k, r in enumerate(nodes):
        own = [dict(zip(("before", "after"), p.siblings(slot), strict=True)) for p, slot in _climb(up, k)]
        yield r["tree"], r["place"], top["subroot"], top["root"], own + top["path"]


def _proven(rows: list[dict]) -> Iterator[tuple]:
    top, leaves = rows[0], rows[1:]
    up = levels_above([r["digest"] for r in leaves], leaves[0]["n"])
    above = [(sha256(x["before"].encode()), x["after"]) for x in top["path"]]
    around = "".join(x["before"] + x["after"] for x in top["path"])
    for k, r in enumerate(leaves):
        now, proof = r["tampered"] or r["digest"], sha256()
        for p, slot in _climb(up, k):
            now = p.folded(slot, now)
            proof.update("".join(p.siblings(slot)).encode())
        for state, after in above:
            now = resumed(state, now, after)
        proof.update(around.encode())
        yield r["doc_id"], r["digest"], top["subroot"], top["root"], proof.hexdigest(), now, now == top["root"]


def storeys(nodes: DataFrame) -> list[DataFrame]:
    """(tree, place, n, digest) of ``nodes`` and of every second level above, up to one node a tree; ``n`` counts the nodes of the tree's level.

    A tree that has come to one node has no row further up.
    """
    out = [nodes]
    while not (below := out[-1].where("n > 1")).isEmpty():
        out.append(written(_in_runs(_like_all(below.withColumn("run", _run_of())), _collapsed, _NODE), "storey"))
    return out


def tops(up: list[DataFrame]) -> DataFrame:
    """(tree, digest): the one node that each tree comes to."""
    out = up[0].where("n = 1")
    for s in up[1:]:
        out = out.unionAll(s.where("n = 1"))
    return out.select("tree", "digest")


def _with_paths(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Nodes of runs, and before those of each run the path of the node above it."""
    return _like_all(nodes.withColumn("run", _run_of())).unionAll(_like_all(paths.withColumn("run", F.col("place")).withColumn("place", F.lit(-1))))


def paths(up: list[DataFrame], of_tops: DataFrame, least: int = 0) -> DataFrame:
    """(tree, place, subroot, root, path) of the nodes of storey ``least`` of ``up``; path: siblings before and after, level by level. ``of_tops`` has those of each tree's last node."""
    at_top = lambda s: s.where("n = 1").select("tree", "place").join(of_tops.drop("place"), "tree").select("tree", "place", "subroot", "root", "path")
    now = at_top(up[-1])
    for s in reversed(up[least:-1]):
        # Only trees that go on above have paths there.
        now = written(_in_runs(_with_paths(s.where("n > 1"), now), _descended, _PATH).unionAll(at_top(s)), "paths")
    return now


def _written_as(c: Column) -> Column:
    text = c.cast("string")
    return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaves(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, digest, tampered): a row's leaf, and where its doc_id chooses it the leaf that it has after tampering."""
    head = F.concat(*[_written_as(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")])
    leaf = lambda text: F.sha2(F.concat(head, _written_as(text)), 256)
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    tree = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit(""))
    return docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf(F.col("text")).alias("digest"), F.when(chosen, leaf(F.translate("text", _UPPER, _LOWER))).alias("tampered"))


def _numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    return written(so_far(nodes, "tree", order).withColumn("place", F.col("row_no") - 1).withColumnRenamed("n_rows", "n").drop("row_no", "running"), "numbered")


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) a row of ``docs`` (doc_id, source, lang, n_chars, text)."""
    at = _numbered(written(leaves(docs), "leaves"), ["doc_id", "digest"])
    up = storeys(at.select("tree", "place", "n", "digest"))
    subroots = tops(up).select(F.lit("").alias("tree"), F.col("tree").alias("source"), "digest")
    sources = _numbered(written(subroots, "subroots"), ["source"])
    up_root = storeys(sources.select("tree", "place", "n", "digest"))
    root = tops(up_root).select("tree", F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"), F.array().cast(_COLUMNS["path"]).alias("path"))
    named = paths(up_root, root).join(sources.select("place", "source", "digest"), "place")
    of_tops = written(named.select(F.col("source").alias("tree"), F.col("digest").alias("subroot"), "root", "path"), "subroot-paths")
    alone = at.where("n = 1").join(of_tops, "tree").withColumn("run", F.lit(0))
    above = alone.select("tree", "place", "subroot", "root", "path").unionAll(paths(up, of_tops, 1)) if len(up) > 1 else alone.select("tree", "place", "subroot", "root", "path")
    out = written(_in_runs(_with_paths(at, above), _proven, _LEAF), "manifest")
    removed(at, sources, of_tops, *up[1:], *up_root[1:])
    return out


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


_FIELD = "case when {0} is null then '-' else strlen(cast({0} as varchar)) || ':' || {0} end"
ORACLE = {
    "op13_merkle": f"""
with recursive
tab as (select list(c order by i) as t from (select i, list_reduce([i] || range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from range(256) r(i))),
crc as (select doc_id, xor(list_reduce([4294967295] || list_transform(string_split(cast(doc_id as varchar), ''), lambda x: cast(ascii(x) as bigint)),
               lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 5 = 0 as bad from (select distinct doc_id from documents where doc_id is not null), tab),
said as (select doc_id, source, text, coalesce(bad, false) as bad, {" || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars"))} as head from documents left join crc using (doc_id)),
leaf as (select doc_id, coalesce('s' || source, '') as tree, sha256(head || {_FIELD.format("text")}) as h,
                case when bad then sha256(head || case when text is null then '-' else strlen(text) || ':' || translate(text, '{_UPPER}', '{_LOWER}') end) end as tampered from said),
placed as (select *, row_number() over (partition by tree order by doc_id nulls first, h) - 1 as pos, count(*) over (partition by tree) as n from leaf),
node as (select tree, cast(0 as bigint) as lvl, pos, n, h from placed
         union all select tree, lvl + 1, pos // {FAN}, (n + {FAN - 1}) // {FAN}, sha256(string_agg(h, '' order by pos)) from node where n > 1 group by tree, lvl, pos // {FAN}, n),
sub as (select tree, lvl as last, h, row_number() over (order by tree) - 1 as pos, count(*) over () as n from node where n = 1),
top as (select cast(0 as bigint) as lvl, pos, n, h from sub
        union all select lvl + 1, pos // {FAN}, (n + {FAN - 1}) // {FAN}, sha256(string_agg(h, '' order by pos)) from top where n > 1 group by lvl, pos // {FAN}, n),
root as (select h, lvl as last from top where n = 1),
every as (select tree, lvl, pos, h from node where n > 1 union all select s.tree, s.last + t.lvl, t.pos, t.h from sub s, top t where t.n > 1),
mine as (select row_number() over () as id, p.doc_id, p.tree, p.h, p.tampered, p.pos, s.last, s.pos as s_pos, s.h as subroot from placed p join sub s using (tree)),
way as (select id, e.lvl, e.pos, e.h, e.pos = here as own
        from (select m.id, m.tree, l.lvl, case when l.lvl < m.last then m.pos // cast({FAN} ** l.lvl as bigint) else m.s_pos // cast({FAN} ** (l.lvl - m.last) as bigint) end as here
              from mine m join (select distinct tree, lvl from every) l using (tree)) w join every e on e.tree = w.tree and e.lvl = w.lvl and e.pos // {FAN} = here // {FAN}),
proof as (select id, string_agg(h, '' order by lvl, pos) as s from way where not own group by id),
fold as (select id, cast(0 as bigint) as lvl, coalesce(tampered, h) as h from mine
         union all select f.id, f.lvl + 1, sha256(string_agg(case when w.own then f.h else w.h end, '' order by w.pos)) from fold f join way w on w.id = f.id and w.lvl = f.lvl group by f.id, f.lvl),
done as (select id, arg_max(h, lvl) as folded from fold group by id)
select doc_id, mine.h as leaf, subroot, root.h as root, sha256(coalesce(proof.s, '')) as proof_sha256, folded as folded_root, folded = root.h as verified
from mine join done using (id) left join proof using (id), root
""",
}
QUERIES = {"op13_merkle": op13_merkle}
