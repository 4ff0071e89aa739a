"""Stocks, targets and results in files; schemas are always given, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import trimmed
from ..tables import stored

PROPERTIES = "cano_smiles string, num_heavy_atoms int, num_rings int, pfp array<int>"


def read_lines(spark: SparkSession, path: str, column: str = "smiles") -> DataFrame:
    """One string a line, white space trimmed; blank lines stay as empty strings."""
    return spark.read.text(path).select(trimmed(F.col("value")).alias(column))


def with_ids(df: DataFrame, key: str = "bb_id") -> DataFrame:
    """``df`` with a lasting number from 0: a row's identity in a stock, in the order of the rows.

    Rows of files count by the file's path, then by their place in it, however
    Spark deals the files out; other rows by partition and place. A part of a file that is read at
    once is numbered by itself, and the counts of the parts before, a row a part, are added.
    """
    at = {"__file": F.input_file_name(), "__start": F.input_file_block_start(), "__at": F.monotonically_increasing_id()}
    rows = stored(df.withColumns(at).withColumn("__part", F.shiftright("__at", 33)), "numbered")
    split = ["__file", "__start", "__part"]
    counts = rows.groupBy(*split).agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*split, (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__add"))
    return rows.join(offsets, split).select((F.col("__at") + F.col("__add")).alias(key), *[F.col(c) for c in df.columns])


def read_smiles_json(spark: SparkSession, path: str) -> DataFrame:
    """The ``smiles`` of a JSON array of objects; gzip files are read as they are."""
    return spark.read.schema("smiles string").option("multiLine", True).json(path)


def read_properties(spark: SparkSession, path: str, array: bool = False) -> DataFrame:
    """Molecule properties from JSON lines, which tasks can split, or with ``array`` from files of one array; a row without a field is an error."""
    rows = spark.read.schema(PROPERTIES).option("multiLine", array).json(path)
    missing = F.col("cano_smiles").isNull() | F.col("num_heavy_atoms").isNull() | F.col("num_rings").isNull() | F.col("pfp").isNull()
    return rows.withColumn("cano_smiles", F.when(missing, F.raise_error(F.lit("a molecule lacks a property"))).otherwise(F.col("cano_smiles")))


def write_properties(df: DataFrame, path: str) -> None:
    """JSON lines of molecule properties, for interchange; keep stocks in Parquet otherwise."""
    df.select("cano_smiles", "num_heavy_atoms", "num_rings", "pfp").write.mode("errorifexists").json(path)


def write_unique(df: DataFrame, column: str, path: str) -> None:
    """Distinct strings, one a line."""
    df.select(column).where(F.col(column).isNotNull()).distinct().write.text(path)


def write_solutions(solutions: DataFrame, path: str) -> None:
    solutions.write.parquet(path)


def stock_of(spark: SparkSession, smiles: list[str]) -> DataFrame:
    """A stock from strings at hand."""
    return spark.createDataFrame(list(enumerate(smiles)), "bb_id long, smiles string")
