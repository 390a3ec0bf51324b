"""What the operators of this subpackage share: inputs, parked tables, workers' caches."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.sources.scratch import fresh_path

WHITE = " \t\n\x0b\x0c\r"                            # fixed values: [\x20\x09-\x0D]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, as (doc_id, text); other columns cannot clash."""
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")
    )


def utf8(text: Column) -> Column:
    """A text as UTF-8 bytes; null becomes empty."""
    return F.coalesce(text.cast("string").cast("binary"), F.lit(b""))


def as_bytes(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with the text as UTF-8 bytes; null becomes empty."""
    return docs.select("doc_id", utf8(F.col("text")).alias("text"))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only.

    Where nothing beyond ASCII has a lower case of its own, ``lower`` gives the
    same and is compiled; other texts go letter by letter.
    """
    ascii = F.octet_length(text) == F.char_length(text)
    plain = ascii | ~F.rlike(text, F.lit(r"[^\x00-\x7F\p{Ll}\p{Lo}\p{P}\p{Zs}]"))
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo a number of folds; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def fold_of(doc_id: int | None, folds: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds


def drop_at_exit(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder when the driver ends."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


def park(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Later steps start from the files, so a lost executor costs no earlier work,
    and Spark knows the size of what it joins.  The files go when the driver ends.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    drop_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of a query go when it has ended.

    Otherwise they go when the JVM collects garbage, and the rounds of an iteration add up.
    What later rounds read has to be parked.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def binary_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls, end to end, and n + 1 offsets."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1 + column.offset)
    offsets = offsets[column.offset:]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[offsets[0]:offsets[-1]], offsets - offsets[0]


def by_slices(
    step: Callable[[pa.RecordBatch], pa.RecordBatch], max_bytes: int
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Run a step on slices of about max_bytes of text (the second column).

    One row is never split, so memory is bounded by the slice and the longest text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            _, offsets = binary_column(batch.column(1))
            start = 0
            while start < batch.num_rows:
                stop = int(np.searchsorted(offsets, offsets[start] + max_bytes, "right")) - 1
                stop = min(max(stop, start + 1), batch.num_rows)
                yield step(batch.slice(start, stop - start))
                start = stop

    return run
