"""Sessions, and tables written in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark removes the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: How large a table may be to be broadcast, by the size of its files, and by that of the rows that a shuffle has written.
BY_FILES, MEASURED = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"


def session(name: str = "scissile", cpus: str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; on a cluster, pass your own."""
    build = SparkSession.builder.master(f"local[{cpus}]").appName(name)
    conf = {
        "spark.sql.shuffle.partitions": partitions, "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": os.environ.get("SCISSILE_DRIVER_MEMORY", "8g"),
    }
    for k, v in conf.items():
        build = build.config(k, v)
    spark = build.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where Spark itself is local."""
    sc = spark.sparkContext
    at = sc._jsc.sc().getCheckpointDir()
    if at.isDefined():
        return at.get()
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="spark-")
    sc.setCheckpointDir(path)
    return sc._jsc.sc().getCheckpointDir().get()


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Queries inside run under these settings."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def shuffles_removed(spark: SparkSession):
    """Queries inside leave no shuffle files behind: for writes, which nothing shuffled is read again after."""
    return settings(spark, {CLEANUP: "true"})


def broadcasts_measured(spark: SparkSession):
    """Queries inside broadcast what is small as rows, as measured while they run, and not what is small as a file: files of sorted numbers grow tenfold and more in memory."""
    most = spark.conf.get(MEASURED, None) or spark.conf.get(BY_FILES)
    return settings(spark, {BY_FILES: "-1", MEASURED: most})


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the shared folder: loops cut their lineage with it and survive lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    with shuffles_removed(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same, with broadcasts by the size of rows."""
    with broadcasts_measured(df.sparkSession):
        return written(df, name)


def removed(*tables: DataFrame) -> None:
    """Deletes tables that ``stored`` has written and that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
