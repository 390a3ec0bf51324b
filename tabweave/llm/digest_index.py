"""Exact dedup against a persistent index of digests, bucketed and sorted by hash.

Native: DataFrame functions only.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.llm.common import lower_ascii, park

HOT_SHARE = 1000        # a text on more than this part of all rows is hot: fewer than so many are
BUCKET_TEXTS = 2_000_000    # texts for which a bucket is planned, some 80 MB
SCHEMA = "digest binary, doc_id long, batch string"


def normalised(text: Column) -> Column:
    """The text that is compared: A-Z lower-cased, null as empty."""
    return lower_ascii(F.coalesce(text.cast("string"), F.lit("")))


def digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, digest): SHA-256 of each whole text, a row for each row."""
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        F.unhex(F.sha2(normalised(docs[text_col]).cast("binary"), 256)).alias("digest"),
    )


def by_text(rows: DataFrame) -> DataFrame:
    """(digest, last, n): the largest id of each text and its rows, counted in the tasks first."""
    return rows.groupBy("digest").agg(F.max("doc_id").alias("last"), F.count("*").alias("n"))


@dataclass
class DigestIndex:
    """(digest, doc_id, batch) of every text seen, one row each, in files by bucket of the digest.

    The folder is the index: it outlives the session, and any session opens it again with
    the number of buckets it was made with.  Within a session the folder is a table of
    the catalog, so that joins on the digest read its buckets as they are, without a
    shuffle of the index.  Every batch appends one sorted file to each bucket;
    ``compact`` makes one file of them.
    """

    spark: SparkSession
    path: str
    buckets: int
    name: str

    @classmethod
    def open(cls, spark: SparkSession, path: str, buckets: int) -> DigestIndex:
        """The index in a folder, empty if there is none yet."""
        name = f"digests_{uuid.uuid4().hex}"
        spark.sql(
            f"create table {name} ({SCHEMA}) using parquet clustered by (digest) sorted by (digest) "
            f"into {int(buckets)} buckets location '{path}'")
        return cls(spark, path, int(buckets), name)

    def rows(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def close(self) -> None:
        """Forget the table; the folder stays."""
        self.spark.sql(f"drop table if exists {self.name}")

    def unseen(self, texts: DataFrame) -> DataFrame:
        """The rows whose digest the index lacks, by a sort-merge anti-join on its buckets."""
        return texts.join(self.rows().hint("merge"), "digest", "left_anti")

    def append(self, texts: DataFrame) -> None:
        """Add (digest, doc_id, batch) rows, each digest new and once: a sorted file a bucket."""
        texts.select("digest", "doc_id", "batch").repartition(self.buckets, "digest").write.mode(
            "append").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)

    def compact(self, path: str) -> DigestIndex:
        """The same index in another folder, with one file a bucket."""
        other = DigestIndex.open(self.spark, path, self.buckets)
        other.append(self.rows())
        return other

    def add(self, docs: DataFrame, batch: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Dedup a batch of new rows against the index and each other, and append the new texts.

        Texts are equal when identical after lower-casing A-Z; null counts as empty.
        Returns (doc_id, keep_id, group_size, kept, digest) for every row of ``docs``,
        dropped ones too.  If the index has a row's text, keep_id is the id it came with
        and no row stays; else the largest id of the batch's equal texts stays.
        group_size is the batch's rows of that text.  Rows of one id and text stay or go
        together; a null id is smaller than any other.  An empty batch changes nothing.

        The texts are read once; what follows works on digests in parked tables, so a lost
        executor redoes its tasks only.  The append is one write job.  A batch that is run
        again under its name, after a failure, finds its own texts and gives the same rows.
        """
        rows = park(digests(docs, id_col, text_col), "digests")
        texts = park(by_text(rows), "texts")
        self.append(self.unseen(texts).select(
            "digest", F.col("last").alias("doc_id"), F.lit(batch).alias("batch")))
        held = self.rows().withColumnRenamed("doc_id", "keep_id").hint("merge")
        known = park(texts.join(held, "digest"), "kept")
        return spread(rows, known.drop("last")).select(
            "doc_id", "keep_id", F.col("n").alias("group_size"),
            ((F.col("batch") == batch) & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
            "digest")


def spread(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows with what their text has; a text on many rows never meets them in one task."""
    total = texts.agg(F.sum("n")).first()[0] or 0
    hot = texts.where(F.col("n") * HOT_SHARE > total)  # fewer than HOT_SHARE rows
    near = rows.join(F.broadcast(hot), "digest", "left")
    rest = near.where("n is null").select("digest", "doc_id")
    columns = ["digest", "doc_id", *[c for c in texts.columns if c != "digest"]]
    return near.where("n is not null").select(columns).unionAll(
        rest.join(texts, "digest").select(columns))


def open_index(spark: SparkSession, path: str, texts: int) -> DigestIndex:
    """An index for about so many texts, with at least a bucket for each shuffle partition."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return DigestIndex.open(spark, path, max(least, -(-texts // BUCKET_TEXTS)))


def drop_copies(
    docs: DataFrame, index: DigestIndex, batch: str, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """The rows of a batch that stay, all columns; the new texts are in the index afterwards."""
    kept = index.add(docs, batch, id_col, text_col).where("kept").select(
        F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).distinct()
    own = F.unhex(F.sha2(normalised(docs[text_col]).cast("binary"), 256))
    return docs.withColumn("__own_digest", own).join(
        kept, (F.col("__own_digest") == F.col("_digest"))
        & docs[id_col].cast("long").eqNullSafe(F.col("_id")), "left_semi").drop("__own_digest")
