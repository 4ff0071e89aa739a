"""Word-piece lengths by a linear longest-match automaton (op 10).

The vocabulary is a trie with failure links; each node knows how many pieces
its failure pops. One pass over the letters of a word then gives the number of
pieces that greedy longest match would cut, without building them.

Defined cases: a null or empty text has no words; a word that cannot be cut is
one unknown token; repeated rows count alike; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Distinct words that a Python worker remembers before it starts anew.
REMEMBERED = 400_000
_UNKNOWN = 1 << 40


def word_pieces(model_file: str) -> tuple[list[str], list[str]]:
    """(pieces that begin a word, pieces that go on) of a SentencePiece model, without special and byte pieces."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_file)
    plain = [m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))]
    return [p[1:] for p in plain if p[0] == "▁" and p.strip("▁")], [p for p in plain if "▁" not in p]


class Automaton:
    """Longest match over words: ``pieces(word)`` is the count of greedy pieces, or None for an unknown word."""

    def __init__(self, begins: Iterable[str], goes_on: Iterable[str]):
        self.next: list[dict[str, int]] = [{}, {}]
        terminal = set()
        for root, pieces in ((0, begins), (1, goes_on)):
            for p in pieces:
                u = root
                for c in p:
                    v = self.next[u].get(c)
                    if v is None:
                        v = self.next[u][c] = len(self.next)
                        self.next.append({})
                    u = v
                terminal.add(u)
        n = len(self.next)
        self.fail: list[int] = [-1] * n
        self.pops = [0] * n
        queue = deque([0, 1])
        while queue:
            u = queue.popleft()
            for c, v in self.next[u].items():
                if v in terminal:
                    self.fail[v], self.pops[v] = 1, 1
                else:
                    z, popped = self.fail[u], self.pops[u]
                    while z >= 0 and c not in self.next[z]:
                        popped += self.pops[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[v], self.pops[v] = self.next[z][c], popped
                queue.append(v)

    def pieces(self, word: str) -> int | None:
        u, count = 0, 0
        for c in word:
            while c not in self.next[u]:
                if self.fail[u] < 0:
                    return None
                count += self.pops[u]
                u = self.fail[u]
            u = self.next[u][c]
        while u > 1:
            if self.fail[u] < 0:
                return None
            count += self.pops[u]
            u = self.fail[u]
        return count


@lru_cache(maxsize=2)
def automaton(model_file: str) -> Automaton:
    return Automaton(*word_pieces(model_file))


class _Lengths(dict):
    """Pieces of each word seen; an unknown word also counts in the upper bits."""

    def __init__(self, a: Automaton):
        super().__init__()
        self.a = a

    def __missing__(self, word: bytes) -> int:
        n = self.a.pieces(word.decode("utf-8", "replace"))
        self[word] = got = _UNKNOWN + 1 if n is None else n
        return got


def token_counts(docs: DataFrame, text: str = "text", model_file: str | None = None, key: str = "doc_id") -> DataFrame:
    """(key, n_words, n_tokens, n_unknown) a row of ``docs``; ``model_file`` must lie at the same path on every executor."""
    model_file = model_file or os.environ.get("TOKENIZER_MODEL", MODEL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = _Lengths(automaton(model_file))
        for b in batches:
            n_words, packed = [], []
            for t in b.column(1):
                tokens = (t.as_py() or b"").split()
                n_words.append(len(tokens))
                packed.append(sum(map(lengths.__getitem__, tokens)))
                if len(lengths) > REMEMBERED:
                    lengths.clear()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array([x % _UNKNOWN for x in packed], pa.int64()), pa.array([x // _UNKNOWN for x in packed], pa.int64())], [key, "n_words", "n_tokens", "n_unknown"])

    return docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("binary").alias("text")).mapInArrow(run, f"{key} long, n_words long, n_tokens long, n_unknown long")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


ORACLE: dict[str, str] = {}
QUERIES = {"op10_token_counts": op10_token_counts}
