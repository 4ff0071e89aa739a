"""Sharding by balanced label propagation (op 7).

Documents start in a shard by a hash. Rows of one group (equal texts, or any
other grouping passed in) are linked through the group, never pair by pair. In
each round the parts of a group ask to move to the shard that holds most of it,
of those with room for the rest; a shard lets in groups, in an order by a hash, while their rows fit the room that
its quota leaves, until no wish that fits is left. Groups larger than a quota do
not ask. At last all documents are put in one order, by shard and group, and cut
into runs of equal row counts, which moves few and cuts at most one group at each
of the bounds.

Law: ``rows``, counts of rows at most one apart.

Defined cases: a null text has size 1 and groups with empty texts; a null
doc_id is a row like others; of repeated rows each has a slot; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

SHARDS = 16
#: Steps of a shard's order by group, and by row for groups too large for a shard; with the shards they bound the table of offsets.
GROUP_STEPS, ROW_STEPS = 1024, 16


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, group) with group the hash of the text."""
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), F.xxhash64(data).alias("group"))


def propagated(rows: DataFrame, shards: int = SHARDS, slack: float = 0.1) -> DataFrame:
    """(group, home, shard) for each part of a group of two rows or more that a shard has room for.

    ``rows`` has (doc_id, group, home). A part is the rows of a group that began
    in one home shard, so that the table has at most ``shards`` rows a group,
    however many rows the group has. A group too large for a shard stays spread.
    A group that has moved is whole and asks no more, so the rounds end.
    """
    base = {r["home"]: r["n"] for r in rows.groupBy("home").agg(F.count("*").alias("n")).collect()}  # a row a shard
    load = dict(base)
    quota = (1 + slack) * sum(base.values()) / shards
    homes = rows.groupBy("group", "home").agg(F.count("*").alias("n"))
    several = homes.groupBy("group").agg(F.sum("n").alias("all")).where(f"all > 1 and all <= {quota}D")
    parts = written(homes.join(several, "group").select("group", "home", "n", F.col("home").alias("shard")), "parts")
    k = 0
    while True:
        held = parts.groupBy("group", "shard").agg(F.sum("n").alias("held"))
        room = F.get(F.array(*[F.lit(float(quota - load.get(s, 0))) for s in range(shards)]), F.col("to"))
        total = parts.groupBy("group").agg(F.sum("n").alias("all"))
        open_ = held.join(total, "group").select("group", F.col("shard").alias("to"), "held", (F.col("all") - F.col("held")).alias("need")).where((F.col("need") > 0) & (F.col("need") <= room))
        wish = open_.groupBy("group").agg(F.max_by(F.struct("to", "need"), F.struct("held", F.xxhash64("group", "to"))).alias("w")).select("group", "w.to", "w.need")
        step = F.pmod(F.xxhash64("group", F.lit(k)), F.lit(GROUP_STEPS)).cast("int")
        fits = written(wish.select("group", "to", "need", step.alias("step")), "wishes")
        if fits.isEmpty():
            break
        # The rows that ask before a group: those of the steps before, of which there are at most shards * GROUP_STEPS, and of its own step.
        ahead = Window.partitionBy("to").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
        offsets = fits.groupBy("to", "step").agg(F.sum("need").alias("n")).select("to", "step", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
        within = Window.partitionBy("to", "step").orderBy("group").rowsBetween(Window.unboundedPreceding, 0)
        asked = fits.withColumn("sum", F.sum("need").over(within)).join(F.broadcast(offsets), ["to", "step"])
        let_in = written(asked.where(F.col("sum") + F.col("before") <= room).select("group", "to"), "let-in")
        parts = written(parts.join(let_in, "group", "left").select("group", "home", "n", F.coalesce("to", "shard").alias("shard")), "parts")
        moved = {(r["home"], r["shard"]): r["n"] for r in parts.groupBy("home", "shard").agg(F.sum("n").alias("n")).where("home <> shard").collect()}
        load = {s: base.get(s, 0) + sum(n for (_, b), n in moved.items() if b == s) - sum(n for (a, _), n in moved.items() if a == s) for s in range(shards)}
        k += 1
    return parts.select("group", "home", "shard")


def balanced(rows: DataFrame, shards: int = SHARDS, slack: float = 0.1) -> DataFrame:
    """``rows`` (doc_id, group, shard, ...) with ``shard`` anew and ``slot``: counts at most one apart, slots gapless from 0.

    The place of a row in the order is its number within a step plus the rows of
    the steps before; the steps are bounded, whatever the input. A group lies in
    one step of its shard, but for those too large for a shard, of which there
    are fewer than shards: these follow the others, in steps by row.
    """
    most = (1 + slack) * rows.count() / shards
    large = [r["group"] for r in rows.groupBy("group").agg(F.count("*").alias("n")).where(f"n > {most}D").collect()]
    by_row = F.when(F.col("group").isin(large), F.pmod(F.xxhash64("doc_id"), F.lit(ROW_STEPS)) + 1).otherwise(0)
    step = (F.col("shard") * GROUP_STEPS + F.pmod(F.xxhash64("group"), F.lit(GROUP_STEPS))) * (ROW_STEPS + 1) + by_row
    rows = rows.withColumn("step", step.cast("int"))
    counts = rows.groupBy("step").agg(F.count("*").alias("n"))
    before = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("step", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy()).alias("all"))
    number = F.row_number().over(Window.partitionBy("step").orderBy("group", "doc_id")) - 1
    placed = rows.withColumn("k", number).join(F.broadcast(offsets), "step").withColumn("k", F.col("k") + F.col("before"))
    shard = F.expr(f"k * {shards} div all")
    return placed.withColumn("shard", shard.cast("int")).withColumn("slot", (F.col("k") - F.expr(f"(shard * all + {shards - 1}) div {shards}")).cast("long")).drop("k", "before", "all", "step")


def shard(docs: DataFrame, shards: int = SHARDS, slack: float = 0.1) -> DataFrame:
    """(doc_id, size, text_crc32, group, home, shard, slot), a row of ``docs`` each."""
    rows = written(signatures(docs).withColumn("home", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int")), "to-shard")
    moved = written(propagated(rows, shards, slack), "moved")
    named = written(rows.join(moved, ["group", "home"], "left").withColumn("shard", F.coalesce("shard", "home")), "placed")
    return balanced(named, shards, slack)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = shard(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


ORACLE: dict[str, str] = {}
QUERIES = {"op7_sharding": op7_sharding}
