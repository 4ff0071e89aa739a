"""What the operators of this subpackage share: words, written tables, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import removed, shared_path, table, written

__all__ = ["arrow_rows", "connected_components", "let", "removed", "shared_path", "table", "words", "written"]

#: Words are maximal runs of characters other than these six.
SEPARATORS = "[\\x20\\x09-\\x0D]+"


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Queries inside pass so many rows at a time to Python: fewer where rows are large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def words(text: Column) -> Column:
    """Words of a text, in order; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge list; component is the smallest node reachable.

    Alternates large-star and small-star steps, so that every round halves the
    depth of the trees, with a written table after each. Self links count as
    nodes of their own; null ends are ignored; no edges give no rows.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    pairs = written(pairs, "pairs")
    nodes = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    stars = written(pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")

    def star(e: DataFrame, both: bool) -> DataFrame:
        e = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both else e
        least = e.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        linked = e.join(least, "u")
        if both:
            return linked.where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        away = linked.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return away.unionAll(least.select("u", F.col("m").alias("v"))).distinct()

    def mark(e: DataFrame) -> tuple:
        return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    before = mark(stars)
    while before[0]:
        stars = written(star(star(stars, True), False), "edges")
        after = mark(stars)
        if after == before:
            break
        before = after
    return nodes.join(stars.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
