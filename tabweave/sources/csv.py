"""CSV in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV file or folder with a header row.

    Types are inferred unless a schema is given; a schema saves the extra pass
    over the data that inference takes.
    """
    reader = spark.read.option("header", True)
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    return reader.schema(schema).csv(path)


def level_text(in_level: float) -> str:
    """A level with three decimals, or with all of them if three do not give it back."""
    short = f"{in_level:.3f}"
    return short if float(short) == in_level else repr(float(in_level))


def level_name(in_level: float, n: int) -> str:
    """Name of the data set of one level."""
    return f"synthetic_IN_{level_text(in_level)}_size_{n}.csv"


def write_level(df: DataFrame, folder: str, in_level: float, n: int, mode: str = "errorifexists") -> str:
    """Write one level as a CSV data set with a header; returns its path."""
    path = f"{folder.rstrip('/')}/{level_name(in_level, n)}"
    df.write.mode(mode).option("header", True).csv(path)
    return path


def write_sweep(df: DataFrame, folder: str, mode: str = "errorifexists") -> None:
    """Write all levels of a sweep in one job, one ``in_level=0.100`` folder each.

    ``df`` must have an ``in_level`` column.  ``generate`` keeps the rows of a
    level together, so a task opens one or two files.  A level that three decimals
    do not give back is written with all its digits.
    """
    short, level = F.format_string("%.3f", "in_level"), F.col("in_level")
    (
        df.withColumn("in_level", F.when(short.cast("double") == level, short).otherwise(level.cast("string")))
        .write.mode(mode).option("header", True).partitionBy("in_level").csv(folder)
    )


def read_sweep(spark: SparkSession, folder: str, schema: str | None = None) -> DataFrame:
    """Read a sweep back; a filter on ``in_level`` prunes folders."""
    return read_csv(spark, folder, schema)
