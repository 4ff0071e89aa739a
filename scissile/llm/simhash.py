"""SimHash near-dedup by tiled exact comparison (op 6).

Distinct fingerprints are grouped into cells by the population counts of their
four 16-bit words, and cells are cut into tiles of bounded size. The bits in
which two fingerprints differ are at least the sum of the differences of those
counts, so a pair of tiles is compared only if its cells are within the radius.
A pair of tiles is one task row: numpy exclusive-or and bit counts find every
link exactly. A tile pair returns a spanning set of its links, not all pairs.

Defined cases: a null or empty text has fingerprint 0, linked like any other; a
text of fewer words than a shingle is one shingle; a null doc_id takes part and
is below no other id; repeated rows share a fingerprint; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, table, written

SEED = 42
TILE = 1024
#: Four counts of 0 to 16 bits: at most 17 ** 4 cells, which bounds what is broadcast.
PARTS, PART_BITS = 4, 16


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 of every run of ``size`` words of a UTF-8 text, lower-cased in A-Z."""
    from xxhash import xxh64_intdigest as h

    tokens = text.lower().split()  # on bytes: A-Z, and the six ASCII separators
    if not tokens:
        return np.empty(0, np.uint64)
    line = b" ".join(tokens)
    if len(tokens) <= size:
        return np.array([h(line, SEED)], np.uint64)
    ends = [0, *accumulate(len(t) + 1 for t in tokens)]
    return np.fromiter((h(line[a : b - 1], SEED) for a, b in zip(ends, ends[size:], strict=False)), np.uint64, len(tokens) - size + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """Unsigned 64 bits: those set in over half of the hashes; whole blocks bound the memory of long texts."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        block = hashes[at : at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) with fp as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.fromiter((fingerprint(shingle_hashes(x.as_py() or b"", shingle)) for x in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _labels(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Least node reachable of each of n nodes."""
    least = np.arange(n)
    while True:
        before = least.copy()
        m = np.minimum(least[u], least[v])
        np.minimum.at(least, u, m)
        np.minimum.at(least, v, m)
        least = least[least]
        if (least == before).all():
            return least


def close_pairs(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs that differ in at most ``radius`` bits."""
    return np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= radius)


def tile_links(a: np.ndarray, b: np.ndarray, same: bool, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all that the pair of tiles connects: within one tile, or else between the parts of two."""
    i, j = close_pairs(a, b, radius)
    if same:
        least = _labels(len(a), i, j)
        out = np.nonzero(least != np.arange(len(a)))[0]
        return a[out], a[least[out]]
    if not len(i):
        return a[:0], a[:0]
    # Parts within a tile are linked by its own row, so a link a part suffices here.
    la, lb = _labels(len(a), *close_pairs(a, a, radius)), _labels(len(b), *close_pairs(b, b, radius))
    kinds = np.unique(la[i].astype(np.int64) * len(b) + lb[j])
    pa_, pb = kinds // len(b), kinds % len(b) + len(a)
    least = _labels(len(a) + len(b), pa_, pb)
    out = np.nonzero(least != np.arange(len(least)))[0]
    both = np.concatenate([a, b])
    return both[out], both[least[out]]


def _cell(fp: str) -> list:
    return [F.bit_count(F.shiftrightunsigned(F.col(fp), PART_BITS * k).bitwiseAND(F.lit((1 << PART_BITS) - 1))) for k in range(PARTS)]


def links(distinct: DataFrame, radius: int = 3, tile: int = TILE) -> DataFrame:
    """(a, b): links that connect the distinct fingerprints ``fp`` exactly as all links within the radius do."""
    base = PART_BITS + 1
    number = lambda c: sum((c[k] * base**k for k in range(1, PARTS)), c[0])
    celled = distinct.select("fp", number(_cell("fp")).cast("int").alias("cell"))
    cells = written(celled.groupBy("cell").agg(F.count("*").alias("n")).select("cell", F.ceil(F.col("n") / tile).cast("int").alias("subs")), "cells")
    tiles = written(
        celled.join(F.broadcast(cells), "cell")
        .withColumn("sub", F.pmod(F.xxhash64("fp"), F.col("subs")).cast("int"))
        .groupBy("cell", "sub")
        .agg(F.collect_list("fp").alias("fps")),  # about TILE each: cells are cut by a hash
        "tiles",
    )
    steps = [d for d in product(range(-radius, radius + 1), repeat=PARTS) if sum(map(abs, d)) <= radius and d[::-1] >= (0,) * PARTS]
    digits = lambda c: [(F.floor(F.col(c) / base**k) % base) for k in range(PARTS)]
    near = F.explode(F.array(*[F.array(*[F.lit(x) for x in d]) for d in steps])).alias("d")
    moved = cells.select(F.col("cell").alias("ca"), F.col("subs").alias("na"), near)
    moved = moved.select("ca", "na", *[(x + F.col("d")[k]).alias(f"x{k}") for k, x in enumerate(digits("ca"))])
    moved = moved.where(" and ".join(f"x{k} between 0 and {PART_BITS}" for k in range(PARTS)))
    moved = moved.select("ca", "na", number([F.col(f"x{k}") for k in range(PARTS)]).cast("int").alias("cb"))
    pairs = (
        moved.join(F.broadcast(cells.select(F.col("cell").alias("cb"), F.col("subs").alias("nb"))), "cb")
        .select("ca", "cb", "nb", F.explode(F.sequence(F.lit(0), F.col("na") - 1)).alias("sa"))
        .select("ca", "cb", "sa", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("sb"))
        .where("ca <> cb or sa <= sb")
    )
    named = lambda x: tiles.select(F.col("cell").alias(f"c{x}"), F.col("sub").alias(f"s{x}"), F.col("fps").alias(f"f{x}"))
    work = pairs.join(named("a"), ["ca", "sa"]).join(named("b"), ["cb", "sb"]).select("fa", "fb", F.expr("ca = cb and sa = sb").alias("same"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            us, vs = [], []
            fa, fb, same = t.column(0), t.column(1), t.column(2)
            for k in range(t.num_rows):
                a, b = (np.asarray(x[k].values).astype(np.int64, copy=False).view(np.uint64) for x in (fa, fb))
                u, v = tile_links(a, b, same[k].as_py(), radius)
                us.append(u)
                vs.append(v)
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (us, vs)], ["a", "b"])

    return work.mapInArrow(run, "a long, b long")


def components(signed: DataFrame, radius: int = 3) -> DataFrame:
    """(fp, component_id): the smallest doc_id that is linked to each distinct fingerprint of (doc_id, fp)."""
    distinct = written(signed.groupBy("fp").agg(F.min("doc_id").alias("rep")), "fingerprints")
    found = connected_components(links(distinct.select("fp"), radius)).withColumnRenamed("node", "fp")
    placed = distinct.join(found, "fp", "left")
    joined = placed.where("component is not null")
    least = joined.groupBy("component").agg(F.min("rep").alias("component_id"))
    return placed.where("component is null").select("fp", F.col("rep").alias("component_id")).unionByName(joined.join(least, "component").select("fp", "component_id"))


def simhash_groups(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fp, component_id), a row of ``docs`` each."""
    signed = written(fingerprints(docs, shingle), "signed")
    # Written, so that both sides of the join are dealt out anew and a hot fingerprint can be split.
    return signed.join(written(components(signed, radius), "components"), "fp").select("doc_id", "fp", "component_id")


#: The stage for near duplicates: sets of five-word shingles, equal in 0.8 of them or more.
STAGE_SHINGLE, SIMILARITY = 5, 0.8
#: 256 bits: at a similarity of 0.8 they differ in 39 bits on average (5.7 deviation), unrelated texts in 128 (8).
WIDE, WIDE_RADIUS, WIDE_TILE, WIDE_CELL = 4, 52, 1 << 14, 16
#: Shingles of a block of the exact check, and what a document counts beside its own.
BLOCK, BLOCK_DOC = 1 << 18, 128


def wide_fingerprint(hashes: np.ndarray) -> bytes:
    """256 bits: SimHash of the hashes, and of three hashes of them."""
    with np.errstate(over="ignore"):
        more = [(hashes ^ (hashes >> np.uint64(29))) * np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
    return b"".join(fingerprint(h ^ (h >> np.uint64(32)) if k else h).to_bytes(8, "little") for k, h in enumerate([hashes, *more]))


def shingle_sets(docs: DataFrame, with_set: bool) -> DataFrame:
    """(doc_id, fp, shingles) of documents with a word: 256 bits, or the sorted distinct hashes in eight bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, out = [], []
            for key, text in zip(b.column(0), b.column(1), strict=True):
                h = np.unique(shingle_hashes(text.as_py() or b"", STAGE_SHINGLE))
                if len(h):
                    ids.append(key.as_py())
                    out.append(h.tobytes() if with_set else wide_fingerprint(h))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).where("doc_id is not null").mapInArrow(run, "doc_id long, x binary")


def lightest_forest(n: int, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Positions of links that connect what all links connect, those of least weight first."""
    order = np.argsort(w, kind="stable")
    part, chosen = np.arange(n), []
    while len(order):
        pu, pv = part[u[order]], part[v[order]]
        order = order[pu != pv]
        if not len(order):
            break
        pu, pv = part[u[order]], part[v[order]]
        best = np.full(n, len(order))
        np.minimum.at(best, pu, np.arange(len(order)))
        np.minimum.at(best, pv, np.arange(len(order)))
        pick = order[np.unique(best[best < len(order)])]
        chosen.append(pick)
        part = _labels(n, *np.concatenate([[u[pick], v[pick]], [np.arange(n), part]], axis=1))
    return np.concatenate(chosen) if chosen else order


def wide_links(a: np.ndarray, b: np.ndarray, same: bool, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of links between two tiles of (n, WIDE) fingerprints: a lightest forest, kept up block by block so that memory is bounded."""
    n = len(a) if same else len(a) + len(b)
    u, v, w = (np.empty(0, np.int64) for _ in range(3))
    for i in range(0, len(a), 32):
        for j in range(i if same else 0, len(b), 4096):
            x, y = a[i : i + 32], b[j : j + 4096]
            bits = np.bitwise_count(x[:, None, 0] ^ y[None, :, 0])
            for k in range(1, WIDE):
                bits = bits + np.bitwise_count(x[:, None, k] ^ y[None, :, k]).astype(np.uint16)
            p, q = np.nonzero(bits <= radius)
            if same:
                p, q = p[p + i < q + j], q[p + i < q + j]
            if not len(p):
                continue
            u, v, w = np.concatenate([u, p + i]), np.concatenate([v, q + j + (0 if same else len(a))]), np.concatenate([w, bits[p, q].astype(np.int64)])
            if len(u) > 4 * n:
                keep = lightest_forest(n, u, v, w)
                u, v, w = u[keep], v[keep], w[keep]
    keep = lightest_forest(n, u, v, w)
    return u[keep], v[keep]


def likely_links(signed: DataFrame, radius: int = WIDE_RADIUS, tile: int = WIDE_TILE) -> DataFrame:
    """(a, b): documents of (doc_id, x) whose wide fingerprints link them; tile pairs too far apart in their population counts are skipped."""
    word = lambda k: F.conv(F.hex(F.substring("x", 8 * k + 1, 8)), 16, -10).cast("long")
    celled = signed.withColumn("cell", F.floor(sum((F.bit_count(word(k)) for k in range(1, WIDE)), F.bit_count(word(0))) / WIDE_CELL).cast("int"))
    cells = written(celled.groupBy("cell").agg(F.count("*").alias("n")).select("cell", F.ceil(F.col("n") / tile).cast("int").alias("subs")), "cells")
    tiles = written(
        celled.join(F.broadcast(cells), "cell")  # at most 257 / WIDE_CELL + 1 rows
        .groupBy("cell", F.pmod(F.xxhash64("doc_id"), F.col("subs")).cast("int").alias("sub"))
        .agg(F.collect_list(F.struct("doc_id", "x")).alias("rows")),
        "tiles",
    )
    numbered = tiles.select(F.struct("cell", "sub").alias("t"), "rows")
    names = cells.select(F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("sub"), "cell").select(F.struct("cell", "sub").alias("t"))
    reach = (radius - 1) // WIDE_CELL + 1
    left = names.withColumn("c", F.explode(F.sequence(F.col("t.cell") - reach, F.col("t.cell"))))
    right = names.select(F.col("t").alias("t2"), F.col("t.cell").alias("c"))
    pairs = left.join(right, "c").where("t2.cell < t.cell or t2.sub <= t.sub").select("t", "t2")
    work = pairs.join(numbered, "t").withColumnRenamed("rows", "ra").join(numbered.select(F.col("t").alias("t2"), F.col("rows").alias("rb")), "t2")
    work = work.select(F.col("ra.doc_id").alias("ia"), F.col("ra.x").alias("xa"), F.col("rb.doc_id").alias("ib"), F.col("rb.x").alias("xb"), (F.col("t") == F.col("t2")).alias("same"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for k in range(t.num_rows):
                ia, ib = (np.asarray(t.column(c)[k].values).astype(np.int64, copy=False) for c in (0, 2))
                xa, xb = (np.frombuffer(b"".join(t.column(c)[k].values.to_pylist()), np.uint64).reshape(-1, WIDE) for c in (1, 3))
                same = t.column(4)[k].as_py()
                u, v = wide_links(xa, xb, same, radius)
                both = ia if same else np.concatenate([ia, ib])
                yield pa.RecordBatch.from_arrays([pa.array(both[u]), pa.array(both[v])], ["a", "b"])

    return work.repartition(max(8, 2 * signed.sparkSession.sparkContext.defaultParallelism)).mapInArrow(run, "a long, b long")


def set_of(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint64)


def similar(links_: DataFrame, sets: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The links (a, b) whose documents in ``sets`` (doc_id, x) share ``least`` of their shingles or more: an exact check of each."""
    both = links_.join(sets.select(F.col("doc_id").alias("a"), F.col("x").alias("xa")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("x").alias("xb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            keep = []
            for xa, xb in zip(t.column(2), t.column(3), strict=True):
                x, y = (set_of(s.as_py()) for s in (xa, xb))
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common >= least * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "xa", "xb").mapInArrow(run, "a long, b long")


def verified_links(sets: list[np.ndarray], fps: np.ndarray, parts: np.ndarray, n: int, same: bool, radius: int, least: float) -> tuple[list[int], list[int]]:
    """Positions of exactly checked links that connect, with ``parts``, all that such links within the radius connect: among n documents, or else between the first n and the rest."""
    lengths = np.array([len(s) for s in sets])
    ends = np.concatenate([[0], np.cumsum(lengths)])
    column = np.unique(np.concatenate(sets), return_inverse=True)[1]
    part = np.unique(parts, return_inverse=True)[1]
    own = np.zeros(len(column), np.uint8)
    us, vs = [], []
    for i in range(n):
        begin = i + 1 if same else n
        near = np.nonzero(part[begin:] != part[i])[0] + begin
        near = near[np.minimum(lengths[near], lengths[i]) >= least * np.maximum(lengths[near], lengths[i])]
        bits = np.bitwise_count(fps[near] ^ fps[i]).sum(1, dtype=np.int64)
        left = near[np.argsort(bits, kind="stable")][: np.count_nonzero(bits <= radius)]
        own[column[ends[i] : ends[i + 1]]] = 1
        most = 8  # the closest ones first: a link of one of a part spares the others
        while len(left := left[part[left] != part[i]]):
            now, left, most = left[:most], left[most:], 4 * most
            flat = np.concatenate([column[ends[q] : ends[q + 1]] for q in now])
            common = np.add.reduceat(own[flat], np.concatenate([[0], np.cumsum(lengths[now])[:-1]]), dtype=np.int64)
            found = now[common >= least * (lengths[now] + lengths[i] - common)]
            joined, first = np.unique(part[found], return_index=True)
            us += [i] * len(first)
            vs += found[first].tolist()
            part[np.isin(part, joined)] = part[i]
        own[column[ends[i] : ends[i + 1]]] = 0
    return us, vs


def links_left(likely: DataFrame, verified: DataFrame, sets: DataFrame, radius: int = WIDE_RADIUS, least: float = SIMILARITY) -> DataFrame | None:
    """(a, b): links of similarity ``least`` within the radius that connect what the ``verified`` of the ``likely`` ones leave apart.

    A likely forest connects all that links within the radius connect, so each
    of its parts that verified links do not hold together is compared in full:
    all pairs of its documents, in blocks. Parts of two have had their one check.
    """
    named = connected_components(likely).join(connected_components(verified).withColumnRenamed("component", "part"), "node", "left")
    placed = written(named.select(F.col("node").alias("doc_id"), "component", F.coalesce("part", "node").alias("part")), "placed")
    torn = placed.groupBy("component").agg(F.count("*").alias("n"), F.min("part").alias("low"), F.max("part").alias("high")).where("n > 2 and low < high")
    torn = written(torn.select("component"), "torn")
    if torn.isEmpty():
        return None

    def add_fp(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column("fp", pa.array([wide_fingerprint(set_of(x.as_py())) for x in b.column(3)], pa.binary()))

    held = placed.join(torn, "component", "left_semi").join(sets, "doc_id").select("doc_id", "component", "part", "x")
    rows = written(held.mapInArrow(add_fp, "doc_id long, component long, part long, x binary, fp binary"), "torn-rows")
    weights = written(rows.groupBy("component").agg(F.sum(F.octet_length("x") / 8 + BLOCK_DOC).alias("w")), "weights")
    bins = int((weights.where(F.col("w") <= BLOCK).agg(F.sum("w")).first()[0] or 0) // BLOCK) + 1
    big = F.col("w") > BLOCK
    cut = weights.select("component", big.alias("big"), F.when(big, F.col("component")).otherwise(F.pmod(F.xxhash64("component"), F.lit(bins))).alias("name"), F.when(big, F.ceil(F.col("w") / BLOCK)).otherwise(1).cast("int").alias("subs"))
    blocks = written(
        rows.join(written(cut, "cut"), "component")
        .groupBy(F.struct("big", "name", F.pmod(F.xxhash64("doc_id"), F.col("subs")).cast("int").alias("sub")).alias("t"))
        .agg(F.collect_list(F.struct("doc_id", "part", "x", "fp")).alias("rows")),  # about BLOCK shingles
        "blocks",
    )
    names = written(blocks.select("t"), "names")
    pairs = written(names.join(names.select(F.col("t").alias("t2")), F.expr("t.big = t2.big and t.name = t2.name")).where("t2.sub <= t.sub"), "block-pairs")
    work = pairs.join(blocks.withColumnRenamed("rows", "ra"), "t").join(blocks.select(F.col("t").alias("t2"), F.col("rows").alias("rb")), "t2")
    work = work.select(*[F.col(f"r{s}.{c}").alias(f"{c}_{s}") for s in "ab" for c in ("doc_id", "part", "x", "fp")], (F.col("t") == F.col("t2")).alias("same"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for k in range(t.num_rows):
                same = t.column(8)[k].as_py()
                lists = lambda c: [t.column(c)[k].values, *([] if same else [t.column(c + 4)[k].values])]  # noqa: B023, E731
                ids, parts = (np.concatenate([np.asarray(x).astype(np.int64, copy=False) for x in lists(c)]) for c in (0, 1))
                sets_, fps = ([x for v in lists(c) for x in v.to_pylist()] for c in (2, 3))
                u, v = verified_links([set_of(x) for x in sets_], set_of(b"".join(fps)).reshape(-1, WIDE), parts, len(t.column(0)[k].values), same, radius, least)
                yield pa.RecordBatch.from_arrays([pa.array(ids[u], pa.int64()), pa.array(ids[v], pa.int64())], ["a", "b"])

    # A few pairs a task: rows are large, and a task's rows come to Python together.
    return work.repartition(max(8, -(-pairs.count() // 4))).mapInArrow(run, "a long, b long")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` without near duplicates: of the documents that links of similarity 0.8 or more connect, the smallest doc_id stays.

    Rows without a word, and rows without a doc_id, stay.
    """
    found = written(likely_links(written(shingle_sets(docs, False), "wide")).distinct(), "likely")
    nodes = found.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    # Written without repeated ids, so that joins deal it out by themselves and links of a hot document can be split.
    sets = written(shingle_sets(docs.join(nodes, "doc_id", "left_semi"), True).dropDuplicates(["doc_id"]), "shingles")
    verified = written(similar(found, sets), "similar")
    left = links_left(found, verified, sets)
    groups = connected_components(verified if left is None else verified.unionAll(written(left, "left")))
    gone = written(groups.where("node <> component").select(F.col("node").alias("__gone")), "gone")
    return docs.join(gone, docs["doc_id"].cast("long") == gone["__gone"], "left_anti")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash_groups(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


ORACLE: dict[str, str] = {}
QUERIES = {"op6_simhash": op6_simhash}
