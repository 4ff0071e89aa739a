"""SentencePiece encoding and decoding by Gumbel top-k without replacement (op 9).

The lattice of a text holds every way to cut it into pieces of a SentencePiece
vocabulary; characters outside it are spelt in byte pieces. A piece of rank r
weighs 1 / (r + 2.7), in the order of the model's own scores. Pieces never hold
a space after another character, so the lattice of a text is a chain of small
lattices, one for each run of spaces and letters; equal runs share theirs.

Samples come from an A-star search over perturbed log-probabilities: each
sub-tree of the search has the maximum of its leaves' Gumbel values, drawn top
down. On the best path, every run leaves aside a sub-tree (all other ways through
that run) whose maximum is a truncated Gumbel draw; the search goes on at the
largest of these, which is parted by the place in the run where it leaves the
path, and the place by the piece taken there. It returns the k distinct segmentations of the largest
perturbed values, and the next largest value as the threshold of the inclusion
scores. Draws are hashes of the row's key, the sample and the place in the text:
the same row gives the same samples wherever and however often it runs.

Defined cases: a null or empty text has one sample, of no pieces; a text of
fewer than k segmentations gives all it has; a null key is a key of its own;
repeated rows give equal samples; an empty table gives no rows; extra columns
are ignored. ``decode(encode(text))`` is the text exactly, for any sample.
"""

from __future__ import annotations

import math
import os
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate, groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Characters of text that a task holds lattices for at a time; a longer text is a block of its own.
BLOCK_CHARS = 3 << 19
#: Edges of a step of the lattices below which a numpy pass costs more than it saves.
FEW = 24
_RUNS = re.compile(r" *[^ \n]+| +|\n")
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_ALL = (1 << 64) - 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = x + _MIX[0]
        x = (x ^ (x >> np.uint64(30))) * _MIX[1]
        x = (x ^ (x >> np.uint64(27))) * _MIX[2]
        return x ^ (x >> np.uint64(31))


def mixed_int(x: int) -> int:
    x = (x + int(_MIX[0])) & _ALL
    x = ((x ^ (x >> 30)) * int(_MIX[1])) & _ALL
    x = ((x ^ (x >> 27)) * int(_MIX[2])) & _ALL
    return x ^ (x >> 31)


def uniform(x: np.ndarray) -> np.ndarray:
    """In (0, 1), from hashes."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * (1.0 / (1 << 53))


def slots(key: np.ndarray, shift: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((key.astype(np.uint64) * _MIX[0]) >> np.uint64(shift)).astype(np.int64)


@dataclass
class Vocabulary:
    """Trie of the pieces, as an open hash table of (node * classes + class) keys, and piece weights."""

    pieces: list[bytes]
    log_p: np.ndarray
    byte_ids: np.ndarray
    classes: np.ndarray  # code point -> class, 0 if in no piece
    n_classes: int
    keys: np.ndarray  # slot -> key, -1 if free; the last slots are free
    targets: np.ndarray  # slot -> node
    shift: int
    piece_at: np.ndarray  # node -> piece id or -1
    roots: np.ndarray  # class -> node below the root, 0 if none

    @property
    def byte_log_p(self) -> float:
        return float(self.log_p.min() - 10)

    def below(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, node) of the keys that the trie has, in their order."""
        slot = slots(key, self.shift)
        found, left = np.full(len(key), -1, self.targets.dtype), np.arange(len(key))
        while len(left):
            at = self.keys[slot]
            hit = at == key[left]
            found[left[hit]] = self.targets[slot[hit]]
            on = ~hit & (at >= 0)
            left, slot = left[on], slot[on] + 1
        has = np.nonzero(found >= 0)[0]
        return has, found[has]


@lru_cache(maxsize=2)
def vocabulary(model_file: str) -> Vocabulary:
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_file)
    size = m.get_piece_size()
    special = [m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i) for i in range(size)]
    byte_ids = np.array([m.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
    plain = sorted((i for i in range(size) if not special[i]), key=lambda i: (-m.get_score(i), i))
    weight = 1 / (np.arange(len(plain)) + 2.7)
    log_p = np.zeros(size)
    log_p[plain] = np.log(weight / weight.sum())
    letters = sorted({c for i in plain for c in m.id_to_piece(i)})
    classes = np.zeros(0x110000, np.int32)
    classes[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
    classes[ord(" ")], classes[ord(SPACE)] = classes[ord(SPACE)], 0  # U+2581 in a text is not a space
    of = {c: k for k, c in enumerate(letters, 1)}
    trie: dict[tuple[int, int], int] = {}
    at = [-1]
    for i in plain:
        p = m.id_to_piece(i)
        if SPACE in p.lstrip(SPACE) or "\n" in p:
            continue  # would span two runs
        u = 0
        for c in p:
            v = trie.setdefault((u, of[c]), len(at))
            if v == len(at):
                at.append(-1)
            u = v
        at[u] = i
    n = len(letters) + 1
    bits = max(8, int(np.ceil(np.log2(4 * len(trie) + 1))))
    keys, targets = np.full((1 << bits) + len(trie) + 1, -1, np.int64), np.zeros((1 << bits) + len(trie) + 1, np.int32)
    for k, ((u, c), node) in zip(slots(np.array([u * n + c for u, c in trie], np.int64), 64 - bits).tolist(), trie.items(), strict=True):
        while keys[k] >= 0:
            k += 1
        keys[k], targets[k] = u * n + c, node
    roots = np.zeros(n, np.int32)
    for (u, c), node in trie.items():
        if u == 0:
            roots[c] = node
    pieces = [b"" if special[i] else m.id_to_piece(i).replace(SPACE, " ").encode() for i in range(size)]
    for b, i in enumerate(byte_ids):
        pieces[i] = bytes([b])
    return Vocabulary(pieces, log_p, byte_ids, classes, n, keys, targets, 64 - bits, np.array(at, np.int32), roots)


@dataclass
class Lattices:
    """Edges of many runs, sorted by the node they leave; a node is a place in the runs laid end to end."""

    first: np.ndarray  # run -> its first node
    last: np.ndarray  # run -> its last node
    codes: np.ndarray  # code points, a 0 after each run
    begin: np.ndarray  # node -> its first edge
    start: np.ndarray
    to: np.ndarray
    piece: np.ndarray  # -1: the character's several bytes
    p: np.ndarray  # of the edge, given its node
    reach: np.ndarray  # share of the node's edges up to and with this one


def _few(edges: np.ndarray, start: np.ndarray, end: np.ndarray, score: np.ndarray, weight: np.ndarray) -> None:
    """Weights of the nodes of ``edges``, which come in the order of their nodes' distance from the end."""
    rows = zip(start[edges].tolist(), end[edges].tolist(), score[edges].tolist(), strict=True)
    for node, own in groupby(rows, itemgetter(0)):
        values = [p + weight[to] for _, to, p in own]
        top = max(values)
        weight[node] = top + math.log(sum(math.exp(x - top) for x in values))


def lattices(runs: list[str], v: Vocabulary) -> Lattices:
    codes = np.frombuffer("\0".join([*runs, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, runs), np.int64, len(runs))
    first = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]).astype(np.int64)
    last = first + lengths
    inner = np.ones(len(codes), bool)
    inner[last] = False
    kind = np.where(inner, v.classes[codes], np.int32(-1))
    pos = np.nonzero(inner)[0].astype(np.int32)
    node, count, found = np.zeros(len(pos), np.int32), np.zeros(len(codes), np.int32), []
    single = np.zeros(len(codes), bool)
    while len(pos):
        depth = len(found)
        c = kind[np.minimum(pos + depth, len(codes) - 1)]
        if depth:
            pos, node, c = pos[c > 0], node[c > 0], c[c > 0]
            has, node = v.below(node.astype(np.int64) * v.n_classes + c)
            pos = pos[has]
        else:
            node = v.roots[np.maximum(c, 0)]
            pos, node = pos[node > 0], node[node > 0]
        piece = v.piece_at[node]
        done = piece >= 0
        found.append((pos[done], piece[done]))
        count[found[-1][0]] += 1
        if not depth:
            single[found[0][0]] = True
    spelt = np.nonzero(inner & ~single)[0].astype(np.int32)  # no piece of its own: byte pieces
    count[spelt] += 1
    # Each edge goes to the place of its node; shorter pieces first, byte pieces last.
    begin = np.concatenate([[0], np.cumsum(count)])
    n_edges, free = int(begin[-1]), begin[:-1].copy()
    end, piece, score = np.empty(n_edges, np.int32), np.empty(n_edges, np.int32), np.empty(n_edges)
    for depth, (at, ids) in enumerate(found):
        e = free[at]
        free[at] += 1
        end[e], piece[e], score[e] = at + (depth + 1), ids, v.log_p[ids]
    n_bytes = np.where(codes[spelt] < 0x80, 1, np.where(codes[spelt] < 0x800, 2, np.where(codes[spelt] < 0x10000, 3, 4)))
    e = free[spelt]
    end[e], piece[e], score[e] = spelt + 1, np.where(codes[spelt] < 0x80, v.byte_ids[np.minimum(codes[spelt], 0x7F)], np.int32(-1)), v.byte_log_p * n_bytes
    start = np.repeat(np.arange(len(codes), dtype=np.int32), count)
    del found, free, pos, node, kind, inner, count
    # From the ends of the runs back: the weight of all ways from a node to its run's end.
    left = (np.repeat(last, lengths + 1) - np.arange(len(codes))).astype(np.uint16 if len(runs) and lengths.max() < 1 << 16 else np.int32)
    weight = np.zeros(len(codes))
    by = np.argsort(left[start], kind="stable").astype(np.int32)  # edges by how far their node is from the end, then by node
    bounds = np.cumsum(np.bincount(left[start], minlength=1))
    sizes = np.diff(bounds)
    # Beyond these steps only a few long runs are left, which go edge by edge.
    steps = int(np.nonzero(sizes >= FEW)[0][-1]) + 1 if (sizes >= FEW).any() else 0
    for a, b in zip(bounds[:steps], bounds[1:], strict=False):
        e = by[a:b]
        value, s = score[e] + weight[end[e]], start[e]
        cut = np.nonzero(np.diff(s, prepend=-1))[0]
        top = np.maximum.reduceat(value, cut)
        sums = np.add.reduceat(np.exp(value - np.repeat(top, np.diff(cut, append=len(s)))), cut)
        weight[s[cut]] = top + np.log(sums)
    _few(by[bounds[steps] :], start, end, score, weight)
    del by, left
    p = score
    p += weight[end]
    p -= weight[start]
    np.exp(p, out=p)
    if len(p):  # the likeliest edge of a node first
        own = begin[:-1][np.diff(begin) > 0]
        best = np.nonzero(p == np.repeat(np.maximum.reduceat(p, own), np.diff(own, append=len(p))))[0]
        best = best[np.diff(start[best], prepend=-1) > 0]
        for c in (end, piece, p):
            c[own], c[best] = c[best], c[own]
    reach = np.cumsum(p)
    own = begin[:-1][np.diff(begin) > 0]
    reach -= np.repeat(np.concatenate([[0.0], reach])[own], np.diff(own, append=len(p)))
    reach[np.nonzero(np.diff(start, append=-1))[0]] = 1.0
    return Lattices(first, last, codes, begin, start, end, piece, p, reach)


def _walk(x: Lattices, node: np.ndarray, last: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, step, edge) of a random way from each node to the end of its run, in the order of the positions."""
    taken: list[tuple[np.ndarray, np.ndarray]] = []
    length = np.zeros(len(node), np.int64)
    live = np.nonzero(node < last)[0]
    at, end, seed = node[live], last[live], seed[live]
    while len(live):
        u = uniform(mixed(seed + (at - end).astype(np.uint64)))
        e = x.begin[at]
        past = np.nonzero(x.reach[e] <= u)[0]
        while len(past):
            e[past] += 1
            past = past[x.reach[e[past]] <= u[past]]
        taken.append((live, e))
        length[live] += 1
        at = x.to[e]
        more = at < end
        live, at, end, seed = live[more], at[more], end[more], seed[more]
    where = np.cumsum(length) - length
    row = np.repeat(np.arange(len(node)), length)
    edges = np.empty(len(row), np.int64)
    for step, (live, e) in enumerate(taken):
        edges[where[live] + step] = e
    return row, np.arange(len(row)) - where[row], edges


@dataclass
class Sample:
    edges: np.ndarray
    log_prob: float
    value: float
    log_inclusion: float = 0.0


def _largest(values: np.ndarray, cut: np.ndarray, n: int) -> list[list[tuple[float, int]]]:
    """For each stretch of ``values``: its up to n largest that are above -inf, with their places in it."""
    out = []
    for a, b in zip(cut, cut[1:], strict=False):
        v = values[a:b]
        top = np.argpartition(v, len(v) - n)[len(v) - n :] if len(v) > n else range(len(v))
        out.append([(float(v[i]), int(i)) for i in top if v[i] > -np.inf])
    return out


def _spans(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, number) for the numbers of each range [begin, end)."""
    n = end - begin
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + begin[which]


class _Numbers(dict):
    """Numbers of strings, from 0, in the order they come."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


def sample_block(texts: list[str], seeds: np.ndarray, k: int, v: Vocabulary) -> tuple[Lattices, list[list[Sample]]]:
    """The k samples of each text, best first. Each round draws one more path of every text at once."""
    number = _Numbers()
    run_of: list[int] = []
    n_runs = []
    for t in texts:
        found = _RUNS.findall(" " + t) if t else []
        run_of += map(number.__getitem__, found)
        n_runs.append(len(found))
    x = lattices(list(number), v)
    runs = np.array(run_of, np.int64)
    bounds = np.concatenate([[0], np.cumsum(n_runs)]).astype(np.int64)
    log_p = np.log(np.maximum(x.p, 1e-300))
    everyone = np.arange(len(texts))
    seed_of = seeds.tolist()

    def key(d: np.ndarray, sample: int, what: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed(seeds[d] ^ (np.uint64(8 * sample + what + 1) * _MIX[1]))

    def drawn(d: int, sample: int, what: int, i: int) -> float:
        """The same hash, of one number."""
        one = mixed_int(seed_of[d] ^ ((8 * sample + what + 1) * int(_MIX[1]) & _ALL))
        return ((mixed_int((one + i) & _ALL) >> 11) + 0.5) * (1.0 / (1 << 53))

    def path(d: np.ndarray, token: np.ndarray, node: np.ndarray, sample: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, token, edge) of random ways on from each token's node."""
        place = (token - bounds[d]).astype(np.uint64)
        at, _, edge = _walk(x, node, x.last[runs[token]], mixed(key(d, sample, 0) + place))
        return d[at], token[at], edge

    def aside(d: np.ndarray, token: np.ndarray, edge: np.ndarray, texts_: np.ndarray, reached: np.ndarray, bound: np.ndarray, sample: int) -> list[list[tuple[float, int, int]]]:
        """For each of ``texts_``: up to k (value, first edge, end) of the runs of its path with the largest values of the ways that leave the path in them; truncated Gumbel draws."""
        cut = np.nonzero(np.diff(token, prepend=-1))[0]
        own, end = d[cut], np.append(cut[1:], len(edge))
        of = np.concatenate([np.searchsorted(own, texts_), [len(own)]])
        if not len(cut):
            return [[] for _ in texts_]
        whole = np.add.reduceat(log_p[edge], cut)
        total = np.cumsum(whole) - whole
        n = np.diff(of)
        before = total - np.repeat(total[np.minimum(of[:-1], len(total) - 1)] - reached, n)
        rest = -np.expm1(whole)
        draw = -np.log(uniform(mixed(key(own, sample, 1) + (token[cut] - bounds[own]).astype(np.uint64))))
        phi = before + np.log(np.maximum(rest, 1e-300))
        value = np.where(rest > 1e-15, phi - np.log(np.exp(np.minimum(phi - np.repeat(bound, n), 700.0)) + draw), -np.inf)
        first = np.searchsorted(d, texts_)
        return [[(g, int(cut[a + i] - z), int(end[a + i] - z)) for g, i in top] for top, a, z in zip(_largest(value, of, k), of[:-1].tolist(), first.tolist(), strict=True)]

    def below(phi: float, g: float, u: float) -> float:
        """The largest value of a sub-tree of log-weight phi, given that it is below g."""
        return phi - math.log(math.exp(min(phi - g, 700.0)) - math.log(u))

    top = -np.log(-np.log(uniform(key(everyone, 0, 2))))
    d, tokens = _spans(bounds[:-1], bounds[1:])
    d, tok, edge = path(d, tokens, x.first[runs[tokens]], 0)
    cut = np.searchsorted(d, np.arange(len(texts) + 1))
    left = aside(d, tok, edge, everyone, np.zeros(len(texts)), top, 0)
    found: list[list[Sample]] = []
    tokens_of, agendas = [], []
    for q in range(len(texts)):
        e = edge[cut[q] : cut[q + 1]]
        found.append([Sample(e, float(log_p[e].sum()), float(top[q]))])
        tokens_of.append([tok[cut[q] : cut[q + 1]]])
        # Value, path, and a stretch of it; or a place of it and the edges left out there.
        agendas.append([(g, 0, i, j, ()) for g, i, j in left[q]])
    for s in range(1, k):
        picked, nodes, starts = [], [], []
        for q in range(len(texts)):
            if not agendas[q]:
                continue
            agendas[q].sort()
            g, r, i, j, out = agendas[q].pop()
            old, toks = found[q][r].edges, tokens_of[q][r]
            prefix = float(log_p[old[:i]].sum())
            if not out:  # the place in the stretch, and the largest values of its other places
                p, sofar, weights = x.p[old[i:j]].tolist(), 1.0, []
                for y in p:
                    weights.append(sofar * (1 - y))
                    sofar *= y
                share = list(accumulate(weights))
                at = min(bisect_right(share, drawn(q, s, 5, i) * share[-1]), len(p) - 1)
                agendas[q] += [(below(prefix + math.log(w), g, drawn(q, s, 6, i + m)), r, i + m, i + m + 1, (int(old[i + m]),)) for m, w in enumerate(weights) if m != at and w > 1e-15]
                i, prefix = i + at, prefix + sum(math.log(y) for y in p[:at])
                out = (int(old[i]),)
            node = int(x.start[old[i]])
            free = [e for e in range(x.begin[node], x.begin[node + 1]) if e not in out]
            share = list(accumulate(x.p[free].tolist()))
            e = free[min(bisect_right(share, drawn(q, s, 3, i) * share[-1]), len(free) - 1)]
            rest = share[-1] - float(x.p[e])
            if len(free) > 1 and rest > 1e-15:
                agendas[q].append((below(prefix + math.log(rest), g, drawn(q, s, 4, i)), r, i, i + 1, (*out, e)))
            picked.append((q, g, e, old[:i], toks[: i + 1], prefix))
            nodes.append(x.to[e])
            starts.append(toks[i])
        if not picked:
            break
        who = np.array([q[0] for q in picked])
        which, tokens = _spans(np.array(starts), bounds[who + 1])
        node = x.first[runs[tokens]]
        node[np.nonzero(np.diff(which, prepend=-1))[0]] = nodes
        d, tok, edge = path(who[which], tokens, node, s)
        cut = np.concatenate([np.searchsorted(d, who), [len(d)]])
        reached = np.array([q[5] + log_p[q[2]] for q in picked])
        left = aside(d, tok, edge, who, reached, np.array([q[1] for q in picked]), s)
        for n, (q, g, e, head, toks, _) in enumerate(picked):
            edges = np.concatenate([head, [e], edge[cut[n] : cut[n + 1]]]).astype(np.int64)
            after = len(head) + 1
            agendas[q] += [(h, len(found[q]), after + i, after + j, ()) for h, i, j in left[n]]
            found[q].append(Sample(edges, float(log_p[edges].sum()), g))
            tokens_of[q].append(np.concatenate([toks, tok[cut[n] : cut[n + 1]]]))
    for q, samples in enumerate(found):
        threshold = max((g[0] for g in agendas[q]), default=-np.inf)
        for f in samples if threshold > -np.inf else []:
            z = math.exp(min(f.log_prob - threshold, 700.0))
            f.log_inclusion = math.log(-math.expm1(-z)) if z > 1e-300 else f.log_prob - threshold
    return x, found


def edge_ids(x: Lattices, edges: np.ndarray, v: Vocabulary) -> np.ndarray:
    """Piece ids of a path, characters outside the vocabulary as byte pieces."""
    ids = x.piece[edges]
    if (ids >= 0).all():
        return ids.astype(np.int32)
    out: list[int] = []
    for i, n in zip(ids, x.start[edges], strict=True):
        out += [i] if i >= 0 else [v.byte_ids[b] for b in chr(x.codes[n]).encode("utf-8", "surrogatepass")]
    return np.array(out, np.int32)


def decode_ids(ids: list[int], v: Vocabulary) -> str:
    return b"".join(map(v.pieces.__getitem__, ids)).decode("utf-8", "replace").removeprefix(" ")


def encode(docs: DataFrame, samples: int = 2, key: str = "doc_id", text: str = "text", model_file: str | None = None, decoded: bool = False) -> DataFrame:
    """(key, sample, ids, n_pieces, log_prob, perturbed, log_inclusion): ``samples`` rows a row of ``docs``, fewer if it has fewer segmentations.

    With ``decoded``, ``exact`` says whether the ids decode to the text: while it is at hand, so that it is not read or joined again.
    """
    model_file = model_file or os.environ.get("TOKENIZER_MODEL", MODEL)

    def rows(keys: list, texts: list[str], v: Vocabulary) -> pa.RecordBatch:
        seeds = mixed(np.array([0x5EED if q is None else q for q in keys], np.int64).view(np.uint64))
        x, found = sample_block(texts, seeds, samples, v)
        flat = [(q, s, f) for q, ss in zip(keys, found, strict=True) for s, f in enumerate(ss)]
        ids = [edge_ids(x, f.edges, v) for _, _, f in flat]
        n = np.array([len(i) for i in ids], np.int32)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(np.concatenate([np.empty(0, np.int32), *ids])))
        column = lambda f: pa.array([f(q) for q in flat], pa.float64())
        whole = [t for t, ss in zip(texts, found, strict=True) for _ in ss]
        exact = [pa.array([decode_ids(i.tolist(), v) == t for i, t in zip(ids, whole, strict=True)], pa.bool_())] if decoded else []
        return pa.RecordBatch.from_arrays(
            [pa.array([q for q, _, _ in flat], pa.int64()), pa.array([s for _, s, _ in flat], pa.int32()), lists, pa.array(n), column(lambda q: q[2].log_prob), column(lambda q: q[2].value), column(lambda q: q[2].log_inclusion), *exact],
            [key, "sample", "ids", "n_pieces", "log_prob", "perturbed", "log_inclusion", *["exact"] * decoded],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model_file)
        keys, texts, held = [], [], 0
        for b in batches:
            for q, t in zip(b.column(0), b.column(1), strict=True):
                keys.append(q.as_py())
                texts.append(t.as_py() or "")
                held += len(texts[-1])
                if held >= BLOCK_CHARS:
                    yield rows(keys, texts, v)
                    keys, texts, held = [], [], 0
        if keys:
            yield rows(keys, texts, v)

    return docs.select(F.col(key).cast("long").alias(key), F.col(text).alias("text")).mapInArrow(
        run, f"{key} long, sample int, ids array<int>, n_pieces int, log_prob double, perturbed double, log_inclusion double" + ", exact boolean" * decoded
    )


def decode(encoded: DataFrame, model_file: str | None = None) -> DataFrame:
    """``encoded`` with ``text``: the text that each row's ids spell."""
    model_file = model_file or os.environ.get("TOKENIZER_MODEL", MODEL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model_file)
        for b in batches:
            texts = [decode_ids(i.as_py() or [], v) for i in b.column("ids")]
            yield b.append_column("text", pa.array(texts, pa.string()))

    kept = encoded.drop("text")
    return kept.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in kept.dtypes) + ", text string")


def op9_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both ways: each sample is decoded and held against its text."""
    return encode(table(spark, sf_dir, "documents"), decoded=True)


ORACLE: dict[str, str] = {}
QUERIES = {"op9_segmentation": op9_segmentation}
