"""Line dedup: lines that many documents share stay in one of them.

Native: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabweave.llm.common import WHITE, lower_ascii, park

NO_ID = -(2**63)


def text_lines(text: Column) -> Column:
    """All lines of a text; null and empty texts have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, version, text): the version tells rows with one id and different texts apart."""
    return docs.select(
        F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID)).alias("id"),
        F.xxhash64(docs[text_col].cast("string")).alias("version"),
        docs[text_col].cast("string").alias("text"),
    )


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """(id, version, pos, h1, h2), a row for each line whose key is long enough.

    h1 and h2 are 64-bit hashes of the key with different seeds.
    """
    line = F.btrim("line", F.lit(WHITE))
    return (
        docs.select("id", "version", F.posexplode(text_lines(F.col("text"))).alias("pos", "line"))
        .select("id", "version", "pos", line.alias("line"))
        .where(F.char_length("line") >= min_chars)
        .select("id", "version", "pos", lower_ascii(F.col("line")).alias("key"))
        .select("id", "version", "pos", F.xxhash64("key").alias("h1"),
                F.xxhash64(F.lit(1), "key").alias("h2"))
    )


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    min_chars: int = 40, min_docs: int = 5,
) -> DataFrame:
    """The documents without the lines that at least min_docs of them hold.

    Every line is exploded and hashed; distinct documents are counted by hash; a
    key at or over the threshold stays only in the largest id that holds it (there,
    all its lines stay).  The others are dropped by position and the rest joined
    again in order.  A hash pair stands for a key; two keys of 10^12 agree by chance
    with probability below 10^-14.

    Returns all input columns with the text cleaned, and n_lines, n_dropped (long).
    Null and empty texts are one empty line.  A row that occurs twice comes back
    twice; rows with one id are one document, and all rows without an id are one
    more, smaller than any other.  An empty table gives an empty table.
    """
    keyed = _keyed(docs, id_col, text_col)
    hashes = park(line_hashes(keyed, min_chars), "line-hashes")
    shared = park(
        hashes.groupBy("h1", "h2")
        .agg(F.count_distinct("id").alias("n"), F.max("id").alias("last"))
        .where(F.col("n") >= min_docs).select("h1", "h2", "last"),
        "shared-lines",
    )
    dropped = (
        hashes.join(shared, ["h1", "h2"]).where(F.col("id") != F.col("last"))
        .groupBy("id", "version").agg(F.collect_set("pos").alias("gone"))
        .withColumnsRenamed({"id": "_id", "version": "_version", "gone": "_gone"})
    )
    kept = docs.withColumns({
        "_key": F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID)),
        "_text_hash": F.xxhash64(docs[text_col].cast("string")),
    })
    joined = kept.join(
        dropped, (kept["_key"] == dropped["_id"]) & (kept["_text_hash"] == dropped["_version"]),
        "left",
    ).withColumn("_lines", text_lines(F.col(text_col).cast("string")))
    places = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    rest = F.array_join(F.transform(places, lambda at: F.get("_lines", at)), "\n")
    return joined.select(
        *[F.when(F.col("_gone").isNull(), F.col(c)).otherwise(rest).alias(c) if c == text_col
          else F.col(c) for c in docs.columns],
        F.size("_lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )
