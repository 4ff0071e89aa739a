"""Exact dedup by a persistent digest index (op 8), in DataFrame operations only.

The index is a table bucketed and sorted by the SHA-256 digest of a text. A new
batch is hashed, grouped by digest and joined with the index by sort-merge: the
digests that an anti-join leaves are appended, and those that the index knows
are appended to a second table of sightings, bucketed alike. Files are only ever
added; a reader takes the largest doc_id and the sum of the counts of a digest.

Defined cases: a null text counts as empty; of equal texts the row with the
largest doc_id stays (a null doc_id is below all others), over all batches; of
repeated rows with one doc_id and text one stays and each counts in group_size;
an empty table gives no rows; extra columns pass through whatever their names.
"""

from __future__ import annotations

from hashlib import md5

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_path, table, written

COLUMNS = "digest string, keep_id long, group_size long"


def digest_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


class DigestIndex:
    """Digests by folder: one that exists is opened, with the number of buckets it was made with, and never overwritten."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = 64):
        self.spark, self.path = spark, path or shared_path(spark, "digest-index")
        self.buckets = self._made_with() or buckets

    def _made_with(self) -> int | None:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in fs.listStatus(folder)] if fs.exists(folder) else []
        return next((int(n.removeprefix("first-")) for n in names if n.startswith("first-")), None)

    def _table(self, kind: str) -> str:
        """Name of the table over a folder of the index; the session learns of it where it does not know it yet."""
        path = f"{self.path}/{kind}-{self.buckets}"
        name = f"digests_{md5(path.encode()).hexdigest()}"
        self.spark.sql(f"create table if not exists {name} ({COLUMNS}) using parquet clustered by (digest) sorted by (digest) into {self.buckets} buckets location '{path}'")
        return name

    def _append(self, rows: DataFrame, kind: str) -> None:
        # A file for each bucket and batch.
        rows.repartition(self.buckets, "digest").write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").mode("append").saveAsTable(self._table(kind))

    def read(self) -> DataFrame:
        """(digest, keep_id, group_size), a row a digest."""
        again = self.spark.table(self._table("again")).groupBy("digest").agg(F.max("keep_id").alias("later"), F.sum("group_size").alias("more"))
        first = self.spark.table(self._table("first")).hint("merge").join(again, "digest", "left")
        return first.select("digest", F.greatest("keep_id", "later").alias("keep_id"), (F.col("group_size") + F.coalesce("more", F.lit(0))).alias("group_size"))

    def ingest(self, signatures: DataFrame) -> None:
        """Add a batch of (doc_id, digest) rows.

        The partial aggregation leaves a row per digest and task, so a group of
        copies of any size costs its tasks one row each. The index is not
        shuffled by the joins: its buckets are their partitions.
        """
        batch = written(signatures.groupBy("digest").agg(F.max("doc_id").cast("long").alias("keep_id"), F.count("*").alias("group_size")), "batch")
        known = self.spark.table(self._table("first")).select("digest")
        # Both read the index before the first of them is appended to.
        again = written(batch.hint("merge").join(known, "digest", "left_semi"), "again")
        self._append(batch.hint("merge").join(known, "digest", "left_anti"), "first")
        self._append(again, "again")


def signatures(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest_of(F.col("text")).alias("digest"))


def repeats(signatures_: DataFrame) -> bool:
    """Whether some (doc_id, digest) occurs more than once."""
    return not signatures_.groupBy("digest", "doc_id").count().where("count > 1").limit(1).isEmpty()


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, batches: int = 1) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) a row of ``docs``, as the index has it once all are in.

    With ``batches``, rows come in so many batches by a hash of their doc_id.
    """
    index = index or DigestIndex(docs.sparkSession)
    mine = written(signatures(docs), "digests")
    for k in range(batches):
        index.ingest(mine.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == k))
    # Written, so that both sides of the join are dealt out anew and a hot digest can be split at run time.
    got = mine.join(written(index.read(), "index"), "digest").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
    if repeats(mine):
        first = F.row_number().over(Window.partitionBy("digest", "doc_id").orderBy(F.lit(0))) == 1
        got = got.withColumn("kept", F.col("kept") & first)
    return got.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def keep_first_copies(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, all columns; one of several rows with one doc_id and text."""
    index = index or DigestIndex(docs.sparkSession)
    index.ingest(signatures(docs))
    keep = written(index.read().select(F.col("digest").alias("k_digest"), F.col("keep_id").alias("k_id")), "index")
    # Rows travel whole in one column, so that none of theirs can clash with the two beside it.
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), digest_of(F.col("text")).alias("digest"))
    # The key holds the doc_id too: copies that go meet no row, so a hot text is spread over all tasks.
    left = marked.join(keep, (F.col("digest") == F.col("k_digest")) & F.col("id").eqNullSafe(F.col("k_id")), "left_semi")
    if repeats(signatures(docs)):
        left = left.dropDuplicates(["id", "digest"])
    return left.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches, so that copies in the second meet an index that knows their text."""
    return exact_dedup(table(spark, sf_dir, "documents"), batches=2)


ORACLE = {
    "op8_exact_dedup": """
select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
       doc_id = max(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
from (select doc_id, coalesce(text, '') as t from documents)
""",
}
QUERIES = {"op8_exact_dedup": op8_exact_dedup}
