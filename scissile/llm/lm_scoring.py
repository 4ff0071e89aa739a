"""LM scoring by a hierarchical Pitman-Yor model (op 5).

Restaurants form a tree of two levels: a root over all words, which the context
restaurants share as their parent. A context is the word before, or the start
of a text: of the most frequent words, at most ``OWN`` of them, each has a
restaurant of its own; a rarer word shares one with those that end in the same
two bytes. Counts are gathered over the whole corpus by (word, context).

Seating is sampled by Gibbs in blocks: in each sweep all customers of every
(restaurant, word) pair are seated anew, whose number of tables t has the
probability a**t * S(c, t) for c customers, S being generalised Stirling numbers
and a the weight of a new table by the parent's predictive probability; a table
is a customer of the root. S is exact up to ``EXACT`` customers, and by a series
or saddle points beyond. The root's probabilities and the totals are those
before the level is drawn. A part of the words holds all it needs but the
restaurants' totals, so a sweep is one pass over the parts, and only those
totals, at most 65,536 numbers, pass through the driver. The predictive
probabilities of several sweeps are averaged.

Words travel as 64-bit hashes, in packed rows of a block of texts and a part of
the words: a shuffled row is some thousands of tokens. Two words of one hash
would count as one; among ten million words the odds are 3 in a million. Blocks
sum equal (word, context) pairs before the shuffle, so no word is hot there.

Defined cases: a null or empty text is one end token; a null doc_id is held out;
repeated rows are scored each and train each; an empty table gives no rows, and
with no training rows the model is the uniform base; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, removed, table, written

#: Context restaurants of single words, at most, and those that rarer words share; 0 is the start of a text.
OWN, SHARED = 1 << 15, 1021
RESTAURANTS = 1 + OWN + SHARED
DISCOUNT, STRENGTH = 0.75, 1.0
#: Customers of a pair up to which its tables are drawn by exact numbers; beyond, points of the grid that is drawn from, and terms of a series.
EXACT, GRID, SERIES = 128, 64, 40
#: Tokens and texts of a block, about; bytes of text for each part of the words; blocks whose counts of a part meet at once.
BLOCK_TOKENS, BLOCK_DOCS, PART_BYTES, MERGED = 1 << 19, 1 << 15, 1 << 23, 256
#: Texts, and rows of parts, that pass to Python at a time.
TEXTS, ROWS = 512, 1
#: The end of a text, as a word's hash: no word has it.
END = np.uint64(0)
_SPAN = 1 << 17
_MULTIPLIER = 0x9E3779B97F4A7C13
_IS_WORD = np.ones(256, bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False
_FOLDED = np.arange(256)
_FOLDED[65:91] += 32
_LETTERS = (np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1))[_FOLDED]


def split_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, text) with text in bytes; held out where crc32 of the id's digits is a multiple of 10."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.crc32(key) % 10 == 0).alias("held_out"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _MULTIPLIER, np.uint64), np.full(n, pow(_MULTIPLIER, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def words_of(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, hash, last two bytes) of each word of texts that lie end to end and begin at ``begins``; A-Z count as a-z.

    A hash is the sum of random numbers of its bytes times powers of an odd
    number, all modulo 2**64, so that those of all words come from running sums.
    """
    word, fresh = _IS_WORD[data], np.zeros(len(data) + 1, bool)
    fresh[begins] = True
    fresh[-1] = True
    goes_on = np.concatenate([[False], word[:-1]]) & ~fresh[:-1]
    start = np.flatnonzero(word & ~goes_on)
    end = np.flatnonzero(word & ~np.concatenate([goes_on[1:] & word[1:], [False]])) + 1
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        upto = max(int(np.searchsorted(start, start[at] + _SPAN)), at + 1)
        low, high = int(start[at]), int(end[upto - 1])
        up, down = _powers(max(4 * _SPAN, 1 << (high - low).bit_length()))
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_LETTERS[data[low:high]] * up[: high - low], out=sums[1:])
        a, b = start[at:upto] - low, end[at:upto] - low
        out[at:upto] = (sums[b] - sums[a]) * down[a]
        at = upto
    for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0xBF58476D1CE4E5B9)):
        out ^= out >> np.uint64(shift)
        out *= np.uint64(factor)
    out ^= out >> np.uint64(32)
    out[out == END] = 1
    before = np.where(end - start > 1, _FOLDED[data[np.maximum(end - 2, 0)]], 0)
    return start, out, (before * 256 + _FOLDED[data[end - 1]]).astype(np.uint16)


@dataclass
class Block:
    """Tokens of some texts: each text's words and an end; rank numbers the distinct words, which are sorted."""

    ids: list
    held: np.ndarray
    n_tokens: np.ndarray
    tokens: np.ndarray
    last: np.ndarray  # of each token's word, its last two bytes

    def contexts(self, own: np.ndarray) -> np.ndarray:
        """Restaurant of each token, by the token before it; ``own`` is sorted."""
        place = np.searchsorted(own, self.tokens) if len(own) else np.zeros(len(self.tokens), np.int64)
        has = own[np.minimum(place, len(own) - 1)] == self.tokens if len(own) else np.zeros(len(self.tokens), bool)
        of = np.where(has, 1 + place, 1 + OWN + self.last % SHARED).astype(np.uint16)
        of[self.tokens == END] = 0
        return np.concatenate([of[:0], np.zeros(1, np.uint16), of[:-1]])

    def docs(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ids)), self.n_tokens)

    def name(self, k: int) -> int:
        """By its task and what it holds: a task that runs again names it alike."""
        held = blake2b(f"{TaskContext.get().partitionId()} {k} {self.ids}".encode() + self.tokens.tobytes(), digest_size=8)
        return int.from_bytes(held.digest()) >> 1


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    held: list[tuple] = []
    n_tokens = n_docs = 0
    for whole in batches:
        for at in range(0, whole.num_rows, 64):
            b = whole.slice(at, 64)
            texts = b.column(2)
            offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
            begins = offsets - offsets[0]
            place, words, last = words_of(data, begins[:-1])
            n = np.diff(np.searchsorted(place, begins))
            row = np.repeat(np.arange(len(n)), n)
            tokens, ends = np.full(len(words) + len(n), END), np.zeros(len(words) + len(n), np.uint16)
            tokens[np.arange(len(words)) + row] = words
            ends[np.arange(len(words)) + row] = last
            held.append((b.column(0).to_pylist(), b.column(1).to_numpy(zero_copy_only=False), n + 1, tokens, ends))
            n_tokens, n_docs = n_tokens + len(tokens), n_docs + len(n)
            if n_tokens >= BLOCK_TOKENS or n_docs > BLOCK_DOCS - 64:
                yield Block(sum((x[0] for x in held), []), *(np.concatenate([x[k] for x in held]) for k in range(1, 5)))
                held, n_tokens, n_docs = [], 0, 0
    if held:
        yield Block(sum((x[0] for x in held), []), *(np.concatenate([x[k] for x in held]) for k in range(1, 5)))


def runs_of(x: np.ndarray) -> np.ndarray:
    """Where equal neighbours begin."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.empty(0, np.int64)


def lengths(begins: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(begins, n))


def part_of(words: np.ndarray, parts: int) -> np.ndarray:
    """Part of each word: a range of hashes, so that sorted words are sorted by part."""
    return ((words >> np.uint64(40)) * np.uint64(parts) >> np.uint64(24)).astype(np.int64)


def packed(x: np.ndarray, kind: str) -> bytes:
    """Numbers by their bytes' places, the last bytes of all first, which compresses well where they are small or sorted."""
    return np.ascontiguousarray(x.astype(kind)).view(np.uint8).reshape(len(x), np.dtype(kind).itemsize).T.tobytes()


def unpacked(data: bytes | None, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data or b"", np.uint8).reshape(size, -1).T).view(kind).ravel()


def packed_counts(x: np.ndarray) -> bytes:
    """Counts in four bytes each, or in eight where one of them needs more."""
    return packed(x, "<u8" if len(x) and x.max() >> 32 else "<u4")


def unpacked_counts(data: bytes | None, n: int) -> np.ndarray:
    """``n`` counts, of four or eight bytes as their length tells."""
    return unpacked(data, "<u8" if n and len(data or b"") == 8 * n else "<u4").astype(np.int64)


def word_counts(train: DataFrame, parts: int) -> DataFrame:
    """(part, w, n, bins): the distinct words of each part and how often they occur, and how many words have how many digits' worth of counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            words = np.sort(block.tokens)
            at = runs_of(words)
            yield _by_part({"w": (words[at], "<u8"), "n": (lengths(at, len(words)), "<u8")}, words[at], parts)

    def merge(t: pa.Table) -> pa.Table:
        words, n = (np.concatenate([unpacked(x.as_py(), "<u8") for x in t.column(c)]) for c in ("w", "n"))
        order = np.argsort(words, kind="stable")
        at = runs_of(words[order])
        n = np.add.reduceat(n[order], at)
        bins = np.bincount(_bin(n), minlength=_BINS)
        return pa.table({"part": pa.array([t.column("part")[0].as_py()], pa.int32()), "w": [packed(words[order][at], "<u8")], "n": [packed(n, "<u8")], "bins": [bins.tolist()], "total": [int(n.sum())]})

    rows = train.mapInArrow(run, "part int, w binary, n binary")
    return rows.groupBy("part").applyInArrow(merge, "part int, w binary, n binary, bins array<long>, total long")


_BINS = 2048


def _bin(n: np.ndarray) -> np.ndarray:
    """Counts up to 1,023 by themselves, larger ones by steps of about 2 %."""
    n = n.astype(float)
    return np.minimum(np.where(n < 1024, n, 1024 + np.floor(32 * np.log2(np.maximum(n, 1024) / 1024))), _BINS - 1).astype(np.int64)


def _by_part(columns: dict[str, tuple[np.ndarray, str]], words: np.ndarray, parts: int, **more: list) -> pa.RecordBatch:
    """A row for each part that has words, of columns that have a value a word."""
    part = part_of(words, parts)
    at = runs_of(part)
    cut = [slice(a, b) for a, b in zip(at, np.append(at[1:], len(words)), strict=True)]
    return pa.RecordBatch.from_pydict({"part": pa.array(part[at].astype(np.int32)), **{k: pa.array([packed(x[c], kind) for c in cut], pa.binary()) for k, (x, kind) in columns.items()}, **more})


def frequent(counts: DataFrame, most: int = OWN) -> np.ndarray:
    """Hashes, sorted, of the words with a restaurant of their own: those above the least count that leaves no more than ``most``."""
    bins = {r["k"]: r["n"] for r in counts.select(F.posexplode("bins").alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n")).collect()}  # _BINS rows
    above = np.cumsum([bins.get(k, 0) for k in range(_BINS)][::-1])
    least = _BINS - int(np.searchsorted(above, most, "right"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w, n in zip(b.column(0), b.column(1), strict=True):
                words = unpacked(w.as_py(), "<u8")
                words = words[(_bin(unpacked(n.as_py(), "<u8")) >= least) & (words != END)]
                yield pa.RecordBatch.from_pydict({"w": pa.array(words.view(np.int64))})

    found = counts.select("w", "n").mapInArrow(run, "w long").collect()  # OWN rows at most
    return np.sort(np.array([r["w"] for r in found], np.int64).view(np.uint64))


def log_stirling(n: int) -> np.ndarray:
    """(n + 1, n + 1): logarithms of the generalised Stirling numbers S(c, t) of the discount."""
    out = np.full((n + 1, n + 1), -np.inf)
    out[0, 0] = 0
    t = np.arange(n + 1)
    for c in range(n):
        stay = np.log(np.maximum(c - DISCOUNT * t, 1e-300))
        out[c + 1, 1:] = np.logaddexp(out[c, :-1], np.where(t[1:] <= c, out[c, 1:] + stay[1:], -np.inf))
    return out


class Tables:
    """Draws numbers of tables: of c customers at t tables, in proportion to a ** t * S(c, t).

    S(c, t) is c! / t! times the coefficient of z ** c in g(z) ** t, with
    g(z) = (1 - (1 - z) ** d) / d. Its saddle point is where tables have c / t
    customers on average when sizes are tilted by z; y is 1 - z.
    """

    def __init__(self) -> None:
        d = DISCOUNT
        self.exact = log_stirling(EXACT)
        self.x = np.linspace(-250.0, 12.0, 1 << 16)  # log(y / z)
        _, y, z = self._parts(self.x)
        with np.errstate(over="ignore"):
            self.mean = np.log(d * z * y ** (d - 1) / -np.expm1(d * np.log(y)) - 1)
        self.total = np.log(z) + (d - 1) * np.log(y)

    @staticmethod
    def _parts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log z, y, z)."""
        log_z = -np.logaddexp(0, x)
        return log_z, np.exp(x + log_z), np.exp(log_z)

    def log_weight(self, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        """log S(c, t) less log c!: for t up to c ** d by a series in their ratio, and by the saddle point beyond."""
        with np.errstate(divide="ignore"):
            x = np.interp(-np.log(c / t - 1), -self.mean, self.x)
        log_z, y, z = self._parts(x)
        mean = DISCOUNT * z * y ** (DISCOUNT - 1) / -np.expm1(DISCOUNT * np.log(y))
        spread = t * mean * (1 + z * (1 - DISCOUNT) / y - mean)
        size = np.log(-np.expm1(DISCOUNT * np.log(y)) / DISCOUNT)
        log_factorial = t * np.log(t) - t + np.log(2 * np.pi * t) / 2 + 1 / (12 * t)
        # At t = c the coefficient is 1, which the least spread stands for.
        saddle = t * size - c * log_z - np.log(np.maximum(2 * np.pi * spread, 1)) / 2
        few = np.nonzero(t <= c**DISCOUNT)
        saddle[few] = self._series(np.broadcast_to(c, t.shape)[few], t[few])
        return saddle - log_factorial

    @staticmethod
    def _series(c: np.ndarray, t: np.ndarray) -> np.ndarray:
        """log of the coefficient of z ** c in g(z) ** t, by the powers (1 - z) ** (d * j)."""
        d = DISCOUNT
        log_gamma = lambda x: (x - 0.5) * np.log(x) - x + 1 / (12 * x) - 1 / (360 * x**3)
        sizes, of = np.unique(c, return_inverse=True)
        first = log_gamma(sizes - d)
        total, chosen = np.zeros(len(c)), np.ones(len(c))
        for j in range(1, SERIES):
            chosen = chosen * np.maximum(t - j + 1, 0) / j
            term = -((-1) ** j) * np.exp(log_gamma(sizes - d * j) - first) * math.gamma(1 + d * j) * math.sin(math.pi * d * j) / math.pi
            total += chosen * term[of]
        first, c = first[of], sizes[of]
        return np.log(np.maximum(total, 1e-300)) + first - log_gamma(c + 1.0) - t * math.log(d)

    def _small(self, c: np.ndarray, log_a: np.ndarray, u: np.ndarray) -> np.ndarray:
        owner = np.repeat(np.arange(len(c)), c)
        begin = np.cumsum(c) - c
        t = np.arange(len(owner)) - begin[owner] + 1
        w = self.exact[c[owner], t] + t * log_a[owner]
        w = np.exp(w - np.maximum.reduceat(w, begin)[owner])
        total = np.cumsum(w)
        low = np.concatenate([[0.0], total])[begin]
        at = np.searchsorted(total, low + u * (total[begin + c - 1] - low), "right")
        return np.minimum(np.maximum(at - begin + 1, 1), c)

    def _large(self, c: np.ndarray, log_a: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        x = np.interp(log_a - np.log(c), -self.total, self.x)
        _, y, z = self._parts(x)
        a = np.exp(log_a)
        mean = a * -np.expm1(DISCOUNT * np.log(y)) / DISCOUNT
        spread = np.sqrt(np.maximum(mean - c / (1 + z * (1 - DISCOUNT) / y), 0))
        first = np.clip(np.floor(mean - 6 * spread - 4), 1, c)
        last = np.minimum(np.ceil(mean + 6 * spread + 20), c)
        step = np.maximum(np.ceil((last - first + 1) / GRID), 1)
        t = first[:, None] + step[:, None] * np.arange(GRID)
        held = t <= last[:, None]
        t = np.minimum(t, last[:, None])
        w = np.where(held, self.log_weight(c[:, None].astype(float), t) + t * log_a[:, None], -np.inf)
        total = np.cumsum(np.exp(w - w.max(1, keepdims=True)), 1)
        at = (total <= rng.random(len(c))[:, None] * total[:, -1:]).sum(1)
        drawn = t[np.arange(len(c)), np.minimum(at, GRID - 1)] + np.floor(rng.random(len(c)) * step)
        return np.clip(drawn, 1, c).astype(np.int64)

    def draw(self, c: np.ndarray, a: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        out = np.ones(len(c), np.int64)
        log_a = np.log(a)
        small, large = np.nonzero((c > 1) & (c <= EXACT))[0], np.nonzero(c > EXACT)[0]
        block = np.cumsum(c[small]) >> 19  # memory is bounded
        for q in np.split(small, np.nonzero(np.diff(block))[0] + 1) if len(small) else []:
            out[q] = self._small(c[q], log_a[q], rng.random(len(q)))
        for k in range(0, len(large), 1 << 11):
            q = large[k : k + (1 << 11)]
            out[q] = self._large(c[q], log_a[q], rng)
        return out


def parent_probability(customers: np.ndarray, tables: np.ndarray, totals: tuple[float, float], base: float) -> np.ndarray:
    """The root's predictive probabilities of words with so many customers and tables there."""
    c, t = totals
    return np.maximum(customers - DISCOUNT * tables, 0) / (STRENGTH + c) + (STRENGTH + DISCOUNT * t) / (STRENGTH + c) * base


PAIRS = "part int, w binary, m binary, ctx binary, cnt binary"


def pair_counts(train: DataFrame, own: np.ndarray, parts: int, n_blocks: int) -> DataFrame:
    """(part, w, m, ctx, cnt): the sorted words of each part, how many contexts each follows, and these with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, block in enumerate(blocks(batches)):
            words, rank, ctx = _ranked(block, own)[:3]
            key = np.sort(rank << 16 | ctx)
            at = runs_of(key)
            rows = _pair_rows(words, key[at], lengths(at, len(key)), parts)
            yield rows.append_column("salt", pa.array(np.full(rows.num_rows, block.name(k) % (1 << 30)), pa.int32()))

    def merge(t: pa.Table) -> pa.Table:
        rows = [_pairs(r) for r in t.select(["w", "m", "ctx", "cnt"]).to_pylist()]
        words, of = np.unique(np.concatenate([r[0] for r in rows]), return_inverse=True)
        ends = np.cumsum([0, *(len(r[0]) for r in rows)])
        key = np.concatenate([of[a + r[1]] << 16 | r[2] for r, a in zip(rows, ends, strict=False)])
        order = np.argsort(key, kind="stable")
        at = runs_of(key[order])
        cnt = np.add.reduceat(np.concatenate([r[3] for r in rows])[order], at)
        m = np.bincount(key[order][at] >> 16, minlength=len(words))
        return pa.table({"part": t.column("part")[:1], "w": [packed(words, "<u8")], "m": [packed(m, "<u4")], "ctx": [packed(key[order][at] & 0xFFFF, "<u2")], "cnt": [packed_counts(cnt)]})

    rows = train.mapInArrow(run, PAIRS + ", salt int")
    if n_blocks > MERGED:  # few blocks at a time first, so that no task holds all rows of a part
        salted = rows.withColumn("salt", F.pmod("salt", F.lit(-(-n_blocks // MERGED))))
        rows = salted.groupBy("part", "salt").applyInArrow(lambda _, t: merge(t), PAIRS)
    return rows.drop("salt").groupBy("part").applyInArrow(merge, PAIRS)


def _ranked(block: Block, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct words, and of each token in the order of its word: the word's number, its context, its text)."""
    order = np.argsort(block.tokens)
    words = block.tokens[order]
    at = runs_of(words)
    return words[at], np.repeat(np.arange(len(at)), lengths(at, len(words))), block.contexts(own)[order].astype(np.int64), block.docs()[order]


def _pair_rows(words: np.ndarray, key: np.ndarray, cnt: np.ndarray, parts: int) -> pa.RecordBatch:
    """Rows by part of (word, context) pairs: word numbers and contexts in ``key``."""
    m = np.bincount(key >> 16, minlength=len(words))
    rows = _by_part({"w": (words, "<u8"), "m": (m, "<u4")}, words, parts)
    begins = np.concatenate([runs_of(part_of(words, parts)), [len(words)]])
    ends = np.concatenate([[0], np.cumsum(m)])[begins]
    cut = [slice(a, b) for a, b in zip(ends, ends[1:], strict=False)]
    for name, x, kind in (("ctx", key & 0xFFFF, "<u2"), ("cnt", cnt, "<u4")):
        rows = rows.append_column(name, pa.array([packed(x[c], kind) for c in cut], pa.binary()))
    return rows


def _pairs(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, and of each pair: its word's number, context, count)."""
    words, m = unpacked(row["w"], "<u8"), unpacked(row["m"], "<u4")
    return words, np.repeat(np.arange(len(words)), m), unpacked(row["ctx"], "<u2").astype(np.int64), unpacked_counts(row["cnt"], int(m.sum()))


@dataclass
class Totals:
    """Customers and tables of every restaurant: of contexts, then of the root; the root's base probability."""

    C: np.ndarray
    T: np.ndarray
    root: tuple[float, float]
    base: float


#: A part after a sweep: tables in the root a word, as pairs (customers, tables) of the kept sweeps and this one; sums of the kept sweeps' tables a pair; what the part adds to the tables of each restaurant, and of the root.
STATE = PAIRS + ", customers binary, seated binary, kept binary, tables binary, root long"


def _arrays(data: bytes | None, n: int, kind: str) -> list[np.ndarray]:
    x = unpacked(data, kind)
    return [x[k : k + n] for k in range(0, len(x), n)] if n else []


def swept(state: DataFrame, t: Totals, seed: int, keep: bool) -> DataFrame:
    """``state`` after a sweep over all customers; a part's draws depend on its number and ``seed`` alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draws = Tables()
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                words, of, ctx, cnt = _pairs(row)
                n, rng = len(words), np.random.default_rng([seed, row["part"]])
                customers, seated = _arrays(row["customers"], n, "<u8"), _arrays(row["seated"], n, "<u8")
                c, r = (customers[-1], seated[-1]) if customers else (np.bincount(of, minlength=n), np.ones(n, np.int64))
                parent = parent_probability(c, r, t.root, t.base)
                tables = draws.draw(cnt, (STRENGTH + DISCOUNT * t.T[ctx]) * parent[of], rng)
                c = np.bincount(of, tables, n).astype(np.int64)
                r = draws.draw(c, np.full(n, (STRENGTH + DISCOUNT * t.root[1]) * t.base), rng)
                old = customers[:-1], seated[:-1]  # the last of them is this sweep's, kept or not
                kept = unpacked_counts(row["kept"], len(cnt)) if row["kept"] else np.zeros(len(cnt), np.int64)
                if keep:
                    old, kept = (customers[: len(customers) - 1] + [c], seated[: len(seated) - 1] + [r]), kept + tables
                row |= {"customers": packed(np.concatenate([*old[0], c]), "<u8"), "seated": packed(np.concatenate([*old[1], r]), "<u8"), "kept": packed_counts(kept), "tables": packed(np.bincount(ctx, tables, RESTAURANTS), "<u8"), "root": int(r.sum())}
                yield pa.RecordBatch.from_pylist([row], _SCHEMA)

    return state.mapInArrow(run, STATE)


_SCHEMA = pa.schema([(n, {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[k]) for n, k in (x.split() for x in STATE.split(", "))])


def summed(rows: DataFrame, column: str, kind: str = "<u8") -> np.ndarray:
    """Sum of packed numbers a restaurant: by task, then by a few tasks, whose few rows come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(RESTAURANTS, np.int64)
        for b in batches:
            for x in b.column(0):
                total += unpacked(x.as_py(), kind).astype(np.int64)
        yield pa.RecordBatch.from_pydict({column: [packed(total, "<u8")]})

    once = rows.select(column).mapInArrow(run, f"{column} binary")
    return sum((unpacked(r[0], "<u8").astype(np.int64) for r in once.repartition(4).mapInArrow(run, f"{column} binary").collect()), np.zeros(RESTAURANTS, np.int64))


@dataclass
class Model:
    """Parts of the words after the last sweep, and the totals of each kept one."""

    parts: int
    own: np.ndarray
    state: DataFrame
    n_tokens: int
    n_words: int
    totals: list[Totals]
    #: Parts with the tokens of several, as those of the most frequent words, and of how many: their blocks are dealt to as many tasks.
    spread: dict[int, int]


def fit(train: DataFrame, burn_in: int = 2, samples: int = 3, seed: int = 7, own_words: int = OWN) -> Model:
    """``train`` has (doc_id, held_out, text)."""
    size, n_docs = train.agg(F.sum(F.octet_length("text") + 1), F.count("*")).first()
    parts = max(8, -(-(size or 0) // PART_BYTES))
    spark = train.sparkSession
    with arrow_rows(spark, TEXTS):
        counts = written(word_counts(train, parts), "word-counts")
    sums = counts.agg(F.sum("total"), F.sum(F.aggregate("bins", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    n_tokens, n_words = (int(x or 0) for x in sums)
    own = frequent(counts, own_words)
    # Fewer than half of the parts have twice the tokens of the mean.
    fair = max(1, n_tokens // parts)
    spread = {r["part"]: -(-r["total"] // fair) for r in counts.where(F.col("total") > 2 * fair).select("part", "total").collect()}
    removed(counts)
    # A task ends with a block that is not full, so there are more.
    n_blocks = n_tokens // BLOCK_TOKENS + n_docs // BLOCK_DOCS + train.rdd.getNumPartitions()
    with arrow_rows(spark, TEXTS):
        state = written(pair_counts(train, own, parts, n_blocks), "pair-counts")

    def begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, t = np.zeros(RESTAURANTS, np.int64), np.zeros(RESTAURANTS, np.int64)
        for b in batches:
            for ctx, cnt in zip(b.column(0), b.column(1), strict=True):
                at = unpacked(ctx.as_py(), "<u2")
                c += np.bincount(at, unpacked_counts(cnt.as_py(), len(at)), RESTAURANTS).astype(np.int64)
                t += np.bincount(at, minlength=RESTAURANTS)
        yield pa.RecordBatch.from_pydict({"c": [packed(c, "<u8")], "t": [packed(t, "<u8")]})

    first = written(state.select("ctx", "cnt").mapInArrow(begun, "c binary, t binary"), "totals")
    # At first, every pair has one table, and every word one in the root.
    customers, tables = summed(first, "c").astype(float), summed(first, "t").astype(float)
    t = Totals(customers, tables, (tables.sum(), float(n_words)), 1 / (n_words + 1))
    kept: list[Totals] = []
    state_ = state.select("*", *[F.lit(None).cast(k).alias(n) for n, k in (x.split() for x in STATE.split(", ")[5:])])
    for k in range(burn_in + samples):
        with arrow_rows(spark, ROWS):
            after = written(swept(state_, t, seed + k, k >= burn_in), "seating")
        removed(state)
        state = state_ = after
        tables = summed(after, "tables").astype(float)
        t = Totals(customers, tables, (tables.sum(), float(after.agg(F.sum("root")).first()[0] or 0)), t.base)
        if k >= burn_in:
            kept.append(t)
    return Model(parts, own, state, n_tokens, n_words, kept, spread)


def probabilities(model: Model, row: dict | None) -> tuple:
    """Of a part: its words, counts, (word, context) keys with what they add to a probability, and the root's probabilities of each kept sweep, a last one of a word never seen."""
    samples = len(model.totals)
    row = row or {}
    words, of, ctx, cnt = _pairs({"w": b"", "m": b"", "ctx": b"", "cnt": b"", **row})
    n = len(words)
    kept = unpacked_counts(row.get("kept"), len(cnt))
    own = (cnt - DISCOUNT * kept / samples) / (STRENGTH + model.totals[0].C[ctx])
    seats = zip(_arrays(row.get("customers"), n, "<u8") or [np.empty(0)] * samples, _arrays(row.get("seated"), n, "<u8") or [np.empty(0)] * samples, model.totals, strict=False)
    roots = [parent_probability(np.append(c, 0), np.append(r, 0), t.root, t.base) for c, r, t in seats]
    return words, np.bincount(of, cnt, n).astype(np.int64), of << 16 | ctx, own, roots


def shares(model: Model) -> list[np.ndarray]:
    """Of each kept sweep, the share of every restaurant that goes to the root."""
    return [(STRENGTH + DISCOUNT * t.T) / (STRENGTH + t.C) for t in model.totals]


SUMS = "block long, part int, docs binary, known binary, base binary, score binary, ids array<long>, held array<boolean>, n array<long>"
POSTINGS = PAIRS + ", block long, salt int, docs binary, ids array<long>, held array<boolean>, n array<long>"


def postings(rows: DataFrame, model: Model) -> DataFrame:
    """For each block of texts and part of the words: where each (word, context) occurs. One of a block's rows names the texts."""
    own, parts, spread = model.own, model.parts, model.spread

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, block in enumerate(blocks(batches)):
            words, rank, ctx, doc = _ranked(block, own)
            key = np.sort(rank << 32 | ctx << 16 | doc)
            pair = key >> 16
            at = runs_of(pair)
            rows = _pair_rows(words, pair[at], lengths(at, len(key)), parts)
            ends = np.concatenate([runs_of(part_of(words[rank], parts)), [len(key)]])
            doc = key & 0xFFFF
            name = block.name(k)
            only = lambda x, kind: pa.array([x if i == name % rows.num_rows else None for i in range(rows.num_rows)], pa.list_(kind))  # noqa: B023, E731
            salt = [(name >> 20) % spread.get(p, 1) for p in rows.column("part").to_pylist()]
            names = {"block": pa.array([name] * rows.num_rows, pa.int64()), "salt": pa.array(salt, pa.int32()), "docs": pa.array([packed(doc[a:b], "<u2") for a, b in zip(ends, ends[1:], strict=False)], pa.binary())}
            names |= {"ids": only(block.ids, pa.int64()), "held": only(block.held.tolist(), pa.bool_()), "n": only(block.n_tokens.tolist(), pa.int64())}
            for name, x in names.items():
                rows = rows.append_column(name, x)
            yield rows

    return rows.mapInArrow(run, POSTINGS)


def score(rows: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, base_score, score) of ``rows`` (doc_id, held_out, text): sums a part of the words, then a text."""
    floor = model.n_tokens + 0.1 * (model.n_words + 1)
    bare = Model(model.parts, model.own, None, model.n_tokens, model.n_words, model.totals, {})  # type: ignore[arg-type]

    def scored(found: pa.Table, state: pa.Table) -> pa.Table:
        words, count, keys, own, roots = probabilities(bare, next(iter(state.to_pylist()), None))
        to_root, out = shares(bare), []
        for row in (found.slice(i, 1).to_pylist()[0] for i in range(found.num_rows)):
            asked, of, ctx, cnt = _pairs(row)
            place = np.minimum(np.searchsorted(words, asked), max(len(words) - 1, 0))
            known = words[place] == asked if len(words) else np.zeros(len(asked), bool)
            place = np.where(known, place, len(words))
            key = place[of] << 16 | ctx
            at = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
            p = np.where(keys[at] == key, own[at], 0.0) if len(keys) else np.zeros(len(key))
            for s, r in zip(to_root, roots, strict=True):
                p = p + s[ctx] * r[place[of]] / len(roots)
            doc = unpacked(row["docs"], "<u2").astype(np.int64)
            base = np.log10((np.append(count, 0)[place] + 0.1) / floor)
            sums = [np.bincount(doc, np.repeat(x, cnt)) for x in (known[of].astype(float), base[of], np.log10(p))]
            there = np.flatnonzero(np.bincount(doc))
            out.append({"block": row["block"], "part": row["part"], "docs": packed(there, "<u2"), "known": packed(sums[0][there], "<u4"), "base": sums[1][there].tobytes(), "score": sums[2][there].tobytes(), **{k: row[k] for k in ("ids", "held", "n")}})
        return pa.Table.from_pylist(out, pa.schema([("block", pa.int64()), ("part", pa.int32()), *[(k, pa.binary()) for k in ("docs", "known", "base", "score")], ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("n", pa.list_(pa.int64()))]))

    def added(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: r["part"])  # in one order, so that sums are the same each time
        named = next(r for r in rows if r["ids"] is not None)  # one of them
        sums = np.zeros((3, len(named["ids"])))
        for r in rows:
            at = unpacked(r["docs"], "<u2")
            for k, x in enumerate((unpacked(r["known"], "<u4"), np.frombuffer(r["base"]), np.frombuffer(r["score"]))):
                sums[k, at] += x
        return pa.table({"doc_id": pa.array(named["ids"], pa.int64()), "held_out": pa.array(named["held"], pa.bool_()), "n_tokens": pa.array(named["n"], pa.int64()), "n_known": sums[0].astype(np.int64), "base_score": sums[1], "score": sums[2]})

    spark = rows.sparkSession
    wide = spark.createDataFrame(list(model.spread.items()), "part int, salts int")
    # A part that is spread is there once for each of its tasks: with all others, at most three times as many.
    state = model.state.drop("tables", "root").join(F.broadcast(wide), "part", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    # Written, so that the shuffle of postings goes before the sums come together.
    with arrow_rows(spark, TEXTS):
        sums = written(postings(rows, model).groupBy("part", "salt").cogroup(state.groupBy("part", "salt")).applyInArrow(scored, SUMS), "sums")
    return sums.groupBy("block").applyInArrow(added, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = split_rows(table(spark, sf_dir, "documents"))
    model = fit(rows.where("not held_out"))
    return score(rows, model).select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score")


ORACLE: dict[str, str] = {}
QUERIES = {"op5_lm_scoring": op5_lm_scoring}
