"""Row numbers and running sums of groups of any size, in blocks that add up."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import stored

#: Rows of a block, about.
BLOCK_ROWS = 1 << 20


def so_far(rows: DataFrame, by: str, order: list[str], value: str | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``rows`` with ``row_no`` from 1, ``n_rows`` of their group ``by``, and ``running``, the sum of ``value`` up to the row (0 without one).

    Rows are dealt into blocks by ranges of group and order, so a large group is
    spread over many tasks; each block is numbered by itself and starts from what
    the blocks before it hold. ``order`` must be a total order inside a group.
    Null groups are one group, nulls come first, null values count as 0; no rows
    give none. ``rows`` is read three times: store what is costly.
    """
    blocks = max(1, -(-rows.count() // block_rows))
    cut = stored(rows.repartitionByRange(blocks, by, *order).withColumn("__block", F.spark_partition_id()), "blocks")
    amount = F.coalesce(F.col(value), F.lit(0)) if value else F.lit(0)
    parts = cut.groupBy(by, "__block").agg(F.count("*").alias("n"), F.sum(amount).alias("v"))
    group = Window.partitionBy(by)  # a row a block
    before = group.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    sofar = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    starts = parts.select(F.col(by).alias("__by"), F.col("__block").alias("__at"), sofar("n").alias("__n"), sofar("v").alias("__v"), F.sum("n").over(group).alias("n_rows"))
    own = Window.partitionBy(by, "__block").orderBy(*order)
    placed = cut.join(starts, cut[by].eqNullSafe(starts["__by"]) & (cut["__block"] == starts["__at"]))
    running = F.col("__v") + F.sum(amount).over(own.rowsBetween(Window.unboundedPreceding, 0))
    return placed.select(*rows.columns, (F.col("__n") + F.row_number().over(own)).alias("row_no"), "n_rows", running.alias("running"))
