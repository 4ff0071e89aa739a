"""How far the sources of a language are from it and from one another in their terms (op 12).

A source of a language is compared with the language, term by term, and with
each other source, over all terms. What a term adds depends only on how often it
occurs on both sides, so terms are grouped into cells of two counts and the
amount is evaluated once a cell:

* ``terms``: cells (count in the group, count in the language) with their
  multiplicity; cells of one value are merged and ranked by it, with the number
  of terms before them; only those that begin within the ranks asked for are
  expanded to terms again, in the order of their UTF-8 bytes.
* ``pairs``: the terms that two sources share meet in a join by term and are
  summed on the spot; terms of one of them only are counted in cells of one
  count, and those that neither has are a number. So a pair costs what it
  shares, and a term that few sources have meets few.

All numbers are whole: decimals where a product does not fit a long.

Defined cases: a null text, lang or source is empty; a language without kept terms
has groups whose pairs are 0 and no term rows; a group without terms is compared
like any other; one source alone has no pairs; repeated rows count again, each as
a document of its own; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_rows, table, written

#: Bytes of a term: small letters, capital ones as small, and all beyond ASCII.
_LETTERS = bytes(k + 32 if 0x41 <= k <= 0x5A else k if 0x61 <= k <= 0x7A or k > 0x7F else 0x20 for k in range(256))
#: Terms and groups that a task counts before it gives them on.
HELD = 400_000
LEAST_DOCS = 10
RANKS = 10
SCALE = 1_000_000_000
_GROUP = ["lang", "source"]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of the terms of (lang, source, text), a row a term and group for every ``HELD`` of these."""
    # Occurrences in the upper bits, documents in the lower ones.
    held: dict[tuple, dict[bytes, int]] = defaultdict(lambda: defaultdict(int))
    n = 0
    for b in batches:
        for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            own = held[lang, source]
            n -= len(own)
            for term, times in Counter(text.as_py().translate(_LETTERS).split()).items():
                own[term] += (times << 32) + 1
            n += len(own)
            if n > HELD:
                yield from _given(held)
                held.clear()
                n = 0
    yield from _given(held)


def _given(held: dict[tuple, dict[bytes, int]]) -> Iterator[pa.RecordBatch]:
    for (lang, source), own in held.items():
        for k in range(0, len(own), 20_000):
            part = dict(islice(own.items(), k, k + 20_000))
            both = np.fromiter(part.values(), np.int64, len(part))
            columns = [pa.repeat(lang, len(part)), pa.repeat(source, len(part)), pa.array(part, pa.binary()).cast(pa.string()), pa.array(both >> 32), pa.array(both & 0xFFFFFFFF)]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])


def shared_terms(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, term, n, lang_n): occurrences in a group and in its language, of the terms in at least so many documents of the language.

    On the bytes of UTF-8 a term is a run of letters and of all bytes beyond ASCII;
    everything else becomes a space. Tasks count what they read; their counts are
    dealt out once, by language and term, and summed there by group and by language.
    A term of all documents brings a row a task and group.
    """
    named = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in _GROUP], F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    counts = named.mapInArrow(_counted, "lang string, source string, term string, n long, docs long").repartition("lang", "term")
    own = counts.groupBy(*_GROUP, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    language = Window.partitionBy("lang", "term")
    known = own.select(*_GROUP, "term", "n", F.sum("n").over(language).alias("lang_n"), F.sum("docs").over(language).alias("docs"))
    return known.where(F.col("docs") >= least_docs).drop("docs")


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 terms)) as a long, in whole numbers of any size; null without terms."""
    whole = lambda c, digits=20: c.cast(f"decimal({digits},0)")
    part = F.call_function("div", whole(F.lit(SCALE), 10) * whole(n + 2), F.nullif(whole(total + 2 * terms), whole(F.lit(0))))
    return (part + 1).cast("long")


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); p and q are at most 10^9 + 1, so the square fits a long."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def groups(docs: DataFrame, shared: DataFrame) -> DataFrame:
    """(lang, source, n_group, n_kinds, v, n_lang) of every group: its terms and their occurrences, the language's kept terms and their occurrences."""
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    own = shared.groupBy(*_GROUP).agg(F.sum("n").alias("n_group"), F.count("*").alias("n_kinds"))
    whole = shared.groupBy("lang", "term").agg(F.max("lang_n").alias("lang_n")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("n_lang"))
    every = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in _GROUP]).distinct()
    return every.join(own, _GROUP, "left").join(whole, "lang", "left").select(*_GROUP, *map(zero, ("n_group", "n_kinds", "v", "n_lang")))


def terms(shared: DataFrame, totals: DataFrame, ranks: int = RANKS) -> DataFrame:
    """(lang, source, item, value, rank): the terms that a group has oftener than its language, widest gap first."""
    cells = shared.groupBy(*_GROUP, "n", "lang_n").agg(F.count("*").alias("terms"))
    p, q = share(F.col("n"), F.col("n_group"), F.col("v")), share(F.col("lang_n"), F.col("n_lang"), F.col("v"))
    valued = written(cells.join(totals, _GROUP).withColumn("p", p).withColumn("q", q).where("p > q").select(*_GROUP, "n", "lang_n", "terms", gap(F.col("p"), F.col("q")).alias("value")), "cells")
    # A value has a term at least: values beyond the ranks asked for can't begin within them.
    best = Window.partitionBy(*_GROUP).orderBy(F.desc("value"))
    merged = valued.groupBy(*_GROUP, "value").agg(F.sum("terms").alias("terms")).withColumn("k", F.row_number().over(best)).where(F.col("k") <= ranks)
    before = F.coalesce(F.sum("terms").over(best.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = merged.withColumn("before", before).where(F.col("before") < ranks).select(*_GROUP, "value", "before")
    chosen = written(valued.join(within, [*_GROUP, "value"]).select(*_GROUP, "n", "lang_n", "value", "before"), "chosen-cells")
    inside = Window.partitionBy(*_GROUP, "value").orderBy("term")
    found = shared.join(chosen, [*_GROUP, "n", "lang_n"]).withColumn("k", F.row_number().over(inside)).where(F.col("k") <= ranks)
    rank = (F.col("before") + F.col("k")).cast("int")
    return found.withColumn("rank", rank).where(F.col("rank") <= ranks).select(*_GROUP, F.col("term").alias("item"), "value", "rank")


def pairs(shared: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, source, item, value, rank): each other source of the language by how far its terms are from the group's."""
    zero = share(F.lit(0), F.col("n_group"), F.col("v"))
    ends = totals.withColumn("zero", zero).select(*_GROUP, "v", "n_kinds", "zero")
    end = lambda s: ends.select("lang", *[F.col(c).alias(f"{c}_{s}") for c in ("source", "n_kinds", "zero")])
    both = end("a").join(ends.select("lang", *[F.col(c).alias(f"{c}_b") for c in ("source", "n_kinds", "zero")], "v"), "lang").where("source_a < source_b and v > 0")
    both = written(both, "pairs")
    placed = written(shared.join(totals, _GROUP).select(*_GROUP, "term", share(F.col("n"), F.col("n_group"), F.col("v")).alias("p"), zero.alias("zero")), "shares")
    side = lambda s: placed.select("lang", "term", *[F.col(c).alias(f"{c}_{s}") for c in ("source", "p", "zero")])
    g = lambda x, y: gap(F.col(x), F.col(y))
    met = side("a").join(side("b"), ["lang", "term"]).where("source_a < source_b")
    meeting = met.groupBy("lang", "source_a", "source_b").agg(F.sum(g("p_a", "p_b") - g("p_a", "zero_b") - g("zero_a", "p_b") + g("zero_a", "zero_b")).alias("x"))
    # The terms of one side, as if the other had none of them: a row a count that occurs there.
    single = placed.groupBy(*_GROUP, "p").agg(F.count("*").alias("terms"))

    def lone(mine: str, other: str) -> DataFrame:
        of = single.withColumnRenamed("source", f"source_{mine}").join(both, ["lang", f"source_{mine}"])
        return of.groupBy("lang", "source_a", "source_b").agg(F.sum(gap(F.col("p"), F.col(f"zero_{other}")) * F.col("terms")).alias("x"))

    neither = both.select("lang", "source_a", "source_b", ((F.col("v") - F.col("n_kinds_a") - F.col("n_kinds_b")) * g("zero_a", "zero_b")).alias("x"))
    value = meeting.unionAll(lone("a", "b")).unionAll(lone("b", "a")).unionAll(neither).groupBy("lang", "source_a", "source_b").agg(F.sum("x").alias("value"))
    value = written(value, "pair-values")
    ways = value.select("lang", F.col("source_a").alias("source"), F.col("source_b").alias("item"), "value").unionAll(value.select("lang", F.col("source_b").alias("source"), F.col("source_a").alias("item"), "value"))
    bare = totals.where("v = 0").select(*_GROUP)
    none = bare.join(bare.select("lang", F.col("source").alias("item")), "lang").where("source <> item").withColumn("value", F.lit(0).cast("long"))
    return ways.unionAll(none).withColumn("rank", F.row_number().over(Window.partitionBy(*_GROUP).orderBy(F.desc("value"), "item")))


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, ranks: int = RANKS) -> DataFrame:
    """(lang, source, part, item, value, rank): other sources (``pair``) and terms (``term``) of every group."""
    with arrow_rows(docs.sparkSession, 500):
        shared = written(shared_terms(docs, least_docs), "shared-terms")
    totals = written(groups(docs, shared), "group-totals")
    part = lambda df, name: df.select(*_GROUP, F.lit(name).alias("part"), "item", "value", "rank")
    return part(pairs(shared, totals), "pair").unionAll(part(terms(shared, totals, ranks), "term"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


ORACLE = {
    "op12_divergence": rf"""
with d as (select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
w as (select id, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
kept as (select lang, term, count(*) as lang_n from w group by lang, term having count(distinct id) >= {LEAST_DOCS}),
g as (select distinct lang, source from d),
dense as (select g.lang, g.source, k.term, k.lang_n, count(w.id) as n from g join kept k using (lang) left join w on w.lang = g.lang and w.source = g.source and w.term = k.term group by all),
p as (select lang, source, term, n, 1 + {SCALE}::hugeint * (n + 2) // (sum(n) over (partition by lang, source) + 2 * count(*) over (partition by lang, source)) as p,
             1 + {SCALE}::hugeint * (lang_n + 2) // (sum(lang_n) over (partition by lang, source) + 2 * count(*) over (partition by lang, source)) as q from dense),
pair as (select g.lang, g.source, h.source as item, cast(coalesce(x.value, 0) as bigint) as value from g join g h on h.lang = g.lang and h.source <> g.source
         left join (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value from p a join p b on b.lang = a.lang and b.term = a.term and b.source <> a.source group by all) x
         on x.lang = g.lang and x.source = g.source and x.item = h.source),
term as (select lang, source, term as item, cast((p - q) * (p - q) // (p + q) as bigint) as value from p where n > 0 and p > q),
ranked as (select lang, source, 'term' as part, item, value, row_number() over (partition by lang, source order by value desc, item) as rank from term)
select lang, source, 'pair' as part, item, value, cast(row_number() over (partition by lang, source order by value desc, item) as int) as rank from pair
union all select lang, source, part, item, value, cast(rank as int) from ranked where rank <= {RANKS}
""",
}
QUERIES = {"op12_divergence": op12_divergence}
