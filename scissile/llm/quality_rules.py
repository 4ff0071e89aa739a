"""Quality rules as a short-circuit cascade (op 4), in DataFrame operations only.

Each rule is a boolean column that is true where a document fails. Cost and
selectivity of every rule are measured on a sample; the rules are then nested
in one CASE, those that reject most per cost first, so that a rejected document
pays for no later rule. The order changes the work, never the verdict.

Defined cases: a null text has no words and fails ``few_words``; an empty table
gives no rows; repeated rows are judged alike; only the text is read, and extra
columns pass through whatever their names.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table, words, written

SYMBOLS = "#*$%&|<>"
WINDOW = 5


def symbol_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[{SYMBOLS}]")), F.lit(0))


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def repeated_words(tokens: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window of words found twice or more in the text, the first included.

    Windows are compared by a 64-bit hash within one text. Sorting (hash,
    position) puts equal windows side by side; each repeated window then covers
    the words up to the next repeated one, or its own length.
    """

    def marked(p: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(p, k)["h"] == x["h"], F.lit(False))
        return F.transform(p, lambda x, k: F.struct(x["i"].alias("i"), (same(x, k - 1) | same(x, k + 1)).alias("twice")))

    def starts(hashes: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(0), F.size(hashes) - window), lambda i: F.struct(F.xxhash64(*[F.get(hashes, i + j) for j in range(window)]).alias("h"), i.alias("i")))
        return let(F.sort_array(pairs), lambda p: F.sort_array(F.transform(F.filter(marked(p), lambda x: x["twice"]), lambda x: x["i"])))

    def covered(at: Column) -> Column:
        return F.aggregate(
            at,
            F.struct(F.lit(0).alias("n"), F.lit(-window).alias("p")),
            lambda s, i: F.struct((s["n"] + F.least(i - s["p"], F.lit(window))).alias("n"), i.alias("p")),
            lambda s: s["n"],
        )

    hashes = F.transform(tokens, lambda w: F.xxhash64(w))
    return F.when(F.size(tokens) <= window, F.lit(0)).otherwise(let(hashes, lambda h: covered(starts(h))))


@dataclass(frozen=True)
class Measures:
    """What rules look at: the text, its words, and numbers of them as columns, whether computed already or not."""

    text: Column
    words: Column
    n: Column
    chars: Column
    symbols: Column
    dup_lines: Column
    repeated: Column


def measures(text: Column, w: Column) -> Measures:
    return Measures(text, w, F.size(w), F.length(F.array_join(w, "")), symbol_count(text), duplicate_lines(text), repeated_words(w))


@dataclass(frozen=True)
class Rule:
    """``fails`` is true where a document is rejected."""

    name: str
    fails: Callable[[Measures], Column]


def default_rules() -> list[Rule]:
    """Lenient rules for prose; a clean document of any language passes all of them."""
    return [
        Rule("few_words", lambda m: m.n < 10),
        Rule("word_length", lambda m: (m.chars < 2 * m.n) | (m.chars > 15 * m.n)),
        Rule("symbols", lambda m: m.symbols * 10 > m.n),
        Rule("shouting", lambda m: F.size(F.filter(m.words, lambda w: w.rlike("^\\p{Lu}{2,}"))) * 2 > m.n),
        Rule("letters", lambda m: F.size(F.filter(m.words, lambda w: w.rlike("\\p{L}"))) * 10 < 7 * m.n),
        Rule("repeated_lines", lambda m: m.dup_lines * 10 > 3 * F.size(F.split(m.text, "\n"))),
        Rule("few_kinds", lambda m: let(F.size(F.array_distinct(m.words)), lambda k: k * k < m.n)),
        Rule("repeated_words", lambda m: m.repeated * 100 > 20 * m.n),
    ]


#: Numbers of a row that several rules ask for.
NUMBERS = ("n", "chars", "symbols", "dup_lines", "repeated")
#: Seconds a row below which costs of rules are noise.
RESOLUTION = 1e-5


def measured(docs: DataFrame, rules: list[Rule], sample_rows: int = 500, bound: bool = False, rounds: int = 3, copies: int = 2) -> list[tuple[Rule, float, float]]:
    """(rule, seconds a row, share rejected) on about ``sample_rows`` rows chosen by a hash of the text.

    The sample only orders the rules. Each row is judged ``copies`` times, so that the rules
    outweigh the running of a job, and the rules take turns for ``rounds`` rounds,
    of which each one's fastest counts. A condition on the number of words measures reading
    alone, which is taken off every rule's time. With ``bound`` the numbers of a row
    are there before the rules are judged, and the rules' costs are what is left. Costs under
    ``RESOLUTION`` are not told apart; rules of nearly the same rejection per cost may change places between calls.
    """
    total = docs.count()
    if not total:
        return [(r, 1.0, 0.0) for r in rules]
    text = F.coalesce("text", F.lit(""))
    chosen = docs.where(F.pmod(F.xxhash64(text), F.lit(1_000_000)) < max(1, round(1_000_000 * min(1.0, sample_rows / total)))).select(text.alias("text"))
    # All tasks filter; only the rows that they find meet in one file.
    sample = written(chosen.repartition(1), "rule-sample").withColumn("w", words(F.col("text")))
    m = measures(F.col("text"), F.col("w"))
    if bound:
        sample = sample.select("text", "w", *[getattr(m, k).alias(k) for k in NUMBERS])
        m = Measures(F.col("text"), F.col("w"), *[F.col(k) for k in NUMBERS])
    sample = written(sample, "rule-numbers")
    n = max(1, sample.count())
    repeated = sample.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))

    def timed(c: Column) -> tuple[float, int]:
        began = time.perf_counter()
        got = repeated.agg(F.sum(c.cast("int"))).first()[0] or 0
        return time.perf_counter() - began, got // copies

    conditions = [m.n < 0, *[r.fails(m) for r in rules]]
    taken = [[timed(c) for c in conditions] for _ in range(rounds + 1)][1:]  # the first round compiles
    floor, *fastest = [min(t[k][0] for t in taken) for k in range(len(conditions))]
    return [(r, max((s - floor) / (n * copies), RESOLUTION), taken[0][k + 1][1] / n) for k, (r, s) in enumerate(zip(rules, fastest, strict=True))]


def ordered(measures_: list[tuple[Rule, float, float]]) -> list[Rule]:
    """Most rejection per cost first; ties by name."""
    return [r for r, _, _ in sorted(measures_, key=lambda m: (-m[2] / m[1], m[1], m[0].name))]


def first_failure(rules: list[Rule], m: Measures) -> Column:
    """Name of the first rule that fails, null if none does; later rules are not evaluated."""
    out = F.lit(None).cast("string")
    for r in reversed(rules):
        out = F.when(r.fails(m), F.lit(r.name)).otherwise(out)
    return out


def verdict(rules: list[Rule]) -> Column:
    """The first failure of a row; words are cut once a row, and numbers of them only where a rule asks."""
    text = F.coalesce("text", F.lit(""))
    return let(words(text), lambda w: first_failure(rules, measures(text, w)))


def cascade(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = 500, into: str = "failed") -> DataFrame:
    """``docs`` with the first rule that rejects each row, or null, in a column ``into``, or that name and as many ``_`` as make it a new one."""
    while into.lower() in map(str.lower, docs.columns):
        into += "_"
    return docs.select("*", verdict(ordered(measured(docs, rules or default_rules(), sample_rows))).alias(into))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with the columns they came with."""
    return docs.where(verdict(ordered(measured(docs, default_rules()))).isNull())


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that every row returns are computed once and passed to the rules; the rest of the cascade stops at the first failure."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules, names = ordered(measured(docs, default_rules(), bound=True)), NUMBERS
    text = F.coalesce("text", F.lit(""))

    def judged(w: Column, numbers: Column) -> Column:
        m = Measures(text, w, *[numbers[k] for k in names])
        return F.struct(*[m_.cast("long").alias(k) for k, m_ in zip(names, (m.n, m.chars, m.symbols, m.dup_lines, m.repeated), strict=True)], first_failure(rules, m).alias("failed"))

    def of(w: Column) -> Column:
        m = measures(text, w)
        return let(F.struct(*[getattr(m, k).alias(k) for k in names]), lambda numbers: judged(w, numbers))

    r = docs.select("doc_id", let(words(text), of).alias("r")).select("doc_id", "r.*")
    base_failed = (F.col("n") < 10) | (100 * F.col("repeated") > 20 * F.col("n"))
    return r.select(
        "doc_id", F.col("n").alias("n_words"), F.col("chars").alias("word_chars"), F.col("symbols").alias("n_symbols"), F.col("dup_lines").alias("n_dup_lines"), F.col("repeated").alias("n_repeat_words"),
        base_failed.alias("base_failed"), (~base_failed & F.col("failed").isNull()).alias("kept"),
    )


ORACLE = {
    "op4_quality_rules": """
with d as (select doc_id, coalesce(text, '') as text,
                  list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') as w from documents),
wins as (select doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: {'i': i, 'k': w[i:i+4]})) as x from d where len(w) >= 5),
twice as (select doc_id, x.i as i from (select doc_id, x, count(*) over (partition by doc_id, x.k) as c from wins) where c > 1),
rep as (select doc_id, count(*) as r from (select distinct doc_id, i + j as p from twice, range(5) t(j)) group by doc_id),
m as (select d.doc_id, d.text, w, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0b\\f\\r]')) as l, coalesce(r, 0)::bigint as n_repeat_words
      from d left join rep using (doc_id)),
b as (select *, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not (base_failed or word_chars < 2 * n_words or word_chars > 15 * n_words or n_symbols * 10 > n_words
            or len(list_filter(w, lambda x: regexp_matches(x, '^\\p{Lu}{2,}'))) * 2 > n_words
            or len(list_filter(w, lambda x: regexp_matches(x, '\\p{L}'))) * 10 < 7 * n_words
            or n_dup_lines * 10 > 3 * len(string_split(text, chr(10))) or len(list_distinct(w)) * len(list_distinct(w)) < n_words) as kept
from b
""",
}
QUERIES = {"op4_quality_rules": op4_quality_rules}
