"""Secret scans: fixed patterns, and values that would cost many guesses (op 11).

Three patterns give the base spans. Values beside a word for a credential are
weighed besides: the fewest guesses that a password cracker needs, found by
dynamic programming over all ways to cut the value into dictionary words, dates,
repeats, keyboard walks and brute-force spans. A value from ``GUESSES`` on that
no base span covers is one more span, ``guess``.

The cost of a cut is the sum of its spans' costs, all as log10 of guesses, and
``CUT`` for each span but the first. Costs grow by a fixed amount a character or
repetition, so each end of a span needs the best cost before it and a few
numbers of the character before: the time is linear in the value, however long.

The dictionary is made of the corpus: the ``DICTIONARY`` commonest words of
letters, counted over all texts; of equal counts the first in the alphabet. That
size bounds what each task is sent.

Defined cases: a null or empty text has no spans, and the digest of an empty list;
patterns that touch or overlap are listed each under its own kind; repeated
rows are scanned alike; a null doc_id stays null; an empty table gives no rows;
extra columns are ignored; texts and values of any length are read whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, table, written

#: The base patterns; an assignment's second group is its value.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: A maximal run that is long enough, without a match for each short one.
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
LEAST = {"assign": 8, "access": 16, "hex": 32}
KINDS = ("assign", "access", "hex", "guess")

#: Values that are weighed: what follows a word for a credential and a sign that it is given.
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|api[_-]?key|(?:access|private|auth)[_-]?key|authorization|bearer)["']?\x20*(?:=>|:=|[:=]|\x20is\x20)\x20*["']?([^\x00-\x20\x7F"'<>,;]+)""",
    re.IGNORECASE | re.ASCII,
)
_CLOSING = ".!?:)]}"

#: log10 of the guesses from which on a value counts as a secret.
GUESSES = 10.0
DICTIONARY = 20_000
#: Occurrences that make a word one of the dictionary's, at least.
LEAST_USES = 10
LONGEST_WORD = 31
LONGEST_PERIOD = 8
CUT = math.log10(2)
#: log10 of the characters of a kind: digits, small and capital letters, signs, all others.
_DIGIT, _LETTER, _SIGN, _OTHER = math.log10(10), math.log10(26), math.log10(33), 3.0
_AGAIN, _CAPITAL = math.log10(2), math.log10(2)
#: Years from 1900 to 2099, with month and day, and four signs between them.
_YEAR, _DATE, _APART = math.log10(200), math.log10(200 * 12 * 31), math.log10(4)
_Y, _M, _D = "(?:19|20)[0-9]{2}", "(?:0[1-9]|1[0-2])", "(?:0[1-9]|[12][0-9]|3[01])"
_DATES = [
    (4, re.compile(_Y), _YEAR),
    (8, re.compile(f"{_Y}{_M}{_D}|{_D}{_M}{_Y}|{_M}{_D}{_Y}"), _DATE),
    (10, re.compile(rf"{_Y}([-/._]){_M}\1{_D}|{_D}([-/._]){_M}\2{_Y}|{_M}([-/._]){_D}\3{_Y}"), _DATE + _APART),
]
#: Rows of a keyboard; a key's neighbours are beside it and, as rows are set off by half a key, two above and two below.
ROWS = ("`1234567890-=", " qwertyuiop[]\\", " asdfghjkl;'", " zxcvbnm,./")
_AT = {c: (r, k) for r, row in enumerate(ROWS) for k, c in enumerate(row) if c != " "}
_STEPS = {(0, 1), (0, -1), (-1, 0), (-1, 1), (1, 0), (1, -1)}
_START, _STEP, _TURN = math.log10(len(_AT)), math.log10(2), math.log10(len(_STEPS))


def step(a: str, b: str) -> tuple[int, int] | None:
    """The direction from one key to the next, if they are neighbours."""
    at, to = _AT.get(a.lower()), _AT.get(b.lower())
    way = (to[0] - at[0], to[1] - at[1]) if at and to else None
    return way if way in _STEPS else None


def character_cost(c: str) -> float:
    return _DIGIT if "0" <= c <= "9" else _LETTER if "a" <= c <= "z" or "A" <= c <= "Z" else _SIGN if "!" <= c <= "~" else _OTHER


def word_cost(word: str, ranks: dict[str, int]) -> float | None:
    """That of a word of the dictionary by its rank from 1, and of each capital letter in it."""
    rank = ranks.get(word.lower()) if word.isascii() and word.isalpha() else None
    return None if rank is None else math.log10(rank) + _CAPITAL * sum(c.isupper() for c in word)


def guess_cost(value: str, ranks: dict[str, int]) -> float:
    """log10 of the fewest guesses over all cuts of a value; -inf for an empty one."""
    n = len(value)
    if not n:
        return -math.inf
    # best[j]: of the first j characters, with CUT for each span; the first one is free.
    best = [-CUT] + [math.inf] * n
    brute = walk = math.inf
    chars = [0.0]
    for c in value:
        chars.append(chars[-1] + character_cost(c))
    # again[p][j % p]: the last span repeats what is p long, up to here.
    again: list[list[float]] = [[math.inf] * p for p in range(LONGEST_PERIOD + 1)]
    way = None
    for j in range(1, n + 1):
        brute = min(brute, best[j - 1] + CUT) + chars[j] - chars[j - 1]
        here = brute
        before, way = way, step(value[j - 2], value[j - 1]) if j > 1 else None
        if way:
            walk = min(best[j - 2] + CUT + _START + _TURN + _STEP, walk + _STEP + (0 if way == before else _TURN))
            here = min(here, walk)
        else:
            walk = math.inf
        for p in range(1, min(LONGEST_PERIOD, j // 2) + 1):
            now = math.inf
            if value[j - p : j] == value[j - 2 * p : j - p]:
                now = min(again[p][j % p], best[j - 2 * p] + CUT + chars[j - p] - chars[j - 2 * p]) + _AGAIN
                here = min(here, now)
            again[p][j % p] = now
        for size, date, cost in _DATES:
            if j >= size and date.fullmatch(value, j - size, j):
                here = min(here, best[j - size] + CUT + cost)
        for k in range(j - 1, max(-1, j - 1 - LONGEST_WORD), -1):
            if not (value[k].isascii() and value[k].isalpha()):
                break
            if j - k > 2 and (cost := word_cost(value[k:j], ranks)) is not None:
                here = min(here, best[k] + CUT + cost)
        best[j] = here
    return best[n]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, ascending; positions in code points, the end is the first behind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def context_values(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the values beside words for credentials, without marks that close a sentence."""
    for m in CONTEXT.finditer(text):
        start, end = m.span(1)
        end = start + len(m[1].rstrip(_CLOSING))
        if end > start:
            yield start, end


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(text: str, cost: Callable[[str], float], least: float = GUESSES) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int]:
    """Base spans, all spans, and how many credential values that a base span covers cost fewer guesses than ``least``."""
    base = base_spans(text)
    more, weak, k, reach = [], 0, 0, 0
    for start, end in context_values(text):
        while k < len(base) and base[k][0] < end:
            reach = max(reach, base[k][2])
            k += 1
        strong = cost(text[start:end]) >= least
        if reach > start:
            weak += not strong
        elif strong:
            more.append((start, 3, end))
    return base, sorted(base + more), weak


def dictionary(docs: DataFrame, size: int = DICTIONARY, least_uses: int = LEAST_USES) -> list[str]:
    """The commonest words of all texts, ``size`` at most: letters that stand alone, small but for the first."""
    alone = F.lit(rf"(?<![A-Za-z0-9+/_=.-])[A-Za-z][a-z]{{2,{LONGEST_WORD - 1}}}(?![A-Za-z0-9+/_=-])")
    words = docs.select(F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), alone, F.lit(0))).alias("w"))
    # Written first: what is left of the words is a few files, and as few tasks send their first ones to the driver.
    counts = written(words.groupBy(F.lower("w").alias("w")).agg(F.count("*").alias("n")).where(F.col("n") >= least_uses), "words")
    return [r["w"] for r in counts.orderBy(F.desc("n"), "w").limit(size).collect()]


def secret_spans(docs: DataFrame, words: list[str], least: float = GUESSES) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_guess, n_weak) a row of ``docs``; ``words`` by rank."""
    ranks = {w: k + 1 for k, w in enumerate(words)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, float] = {}

        def cost(value: str) -> float:
            if len(value) > 200:
                return guess_cost(value, ranks)
            if (got := seen.get(value)) is None:
                if len(seen) > 50_000:
                    seen.clear()
                got = seen[value] = guess_cost(value, ranks)
            return got

        for b in batches:
            out: list[tuple] = []
            for t in b.column(1):
                base, every, weak = scan(t.as_py() or "", cost, least)
                kinds = [k for _, k, _ in base]
                out.append((kinds.count(0), kinds.count(1), kinds.count(2), sha256(_joined(base).encode()).hexdigest(), _joined(every), len(every) - len(base), weak))
            columns = [b.column(0), *(pa.array(c, pa.string() if k in (3, 4) else pa.int64()) for k, c in enumerate(zip(*out) if out else [()] * 7))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess", "n_weak"])

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long, n_weak long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with arrow_rows(spark, 200):
        return written(secret_spans(docs, dictionary(docs)), "secrets")


#: The cost of a cut is no SQL; tests hold it against all cuts of short values.
ORACLE: dict[str, str] = {}
QUERIES = {"op11_secrets": op11_secrets}
