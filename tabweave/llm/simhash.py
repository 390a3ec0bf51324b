"""SimHash near-dedup with a pigeonring filter."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabweave.llm.common import by_slices, identified, park
from tabweave.llm.components import components

SEED = 42        # fixed value: seed of the shingle hash
BITS = 64
SLICE = 4 << 20  # bytes of text that a step holds at once


def shingle_hashes(text: bytes, words: int) -> list[int]:
    """XXH64 of every run of so many words (all words if fewer), repeats included."""
    found = text.lower().split()  # of bytes: A-Z only, and ASCII white space only
    if not found:
        return []
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= words:
        return [digest(joined, SEED)]
    starts = np.cumsum([0, *map(len, found)]) + np.arange(len(found) + 1)
    ends = starts[words:] - 1
    return [digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist())]


def fingerprint(hashes: list[int]) -> int:
    """A bit is 1 if set in over half the hashes; without hashes, zero."""
    if not hashes:
        return 0
    ones = np.zeros(BITS, np.int64)
    values = np.array(hashes, dtype="<u8")
    for at in range(0, len(values), 65_536):
        block = values[at:at + 65_536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(values), bitorder="little")
    return int(bits.view("<u8")[0])


def _fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(doc_id, version, fp): fingerprints of whole texts as signed longs."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = [fingerprint(shingle_hashes(t, words)) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(np.array(fps, np.uint64).view(np.int64))],
            ["doc_id", "version", "fp"])

    rows = identified(docs, id_col, text_col).select(
        "doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"),
        F.xxhash64("text").alias("version"))
    return rows.mapInArrow(by_slices(step, SLICE), "doc_id long, version long, fp long")


# Pigeonring: cut 64 bits into max_bits + 1 segments laid in a ring.  If two
# fingerprints differ in at most max_bits bits, some segment starts a chain whose
# first 1, 2, 3, ... segments differ in at most 0, 1, 2, ... bits (the proportional
# budget of l segments is l * max_bits / (max_bits + 1)).

def segments(max_bits: int) -> list[tuple[int, int]]:
    """(offset, width) of the ring's segments."""
    edges = [round(BITS * i / (max_bits + 1)) for i in range(max_bits + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _segment(fp: Column, offset: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, offset).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _chain_keys(fp: Column, max_bits: int, spread: bool) -> Column:
    """Keys of the chains of two segments, from each start.

    With spread, also the keys whose second segment differs in one bit, which the
    budget of two segments allows.
    """
    ring, keys = segments(max_bits), []
    for start, (offset, width) in enumerate(ring):
        after = ring[(start + 1) % len(ring)]
        key = (F.shiftleft(_segment(fp, offset, width), after[1]) + _segment(fp, *after)
               + F.lit(start << (2 * max(w for _, w in ring))))
        flips = [0] + ([1 << bit for bit in range(after[1])] if spread else [])
        keys += [key.bitwiseXOR(F.lit(flip).cast("long")) for flip in flips]
    return F.array(*keys)


def _chain_holds(differing: Column, start: Column, max_bits: int) -> Column:
    """Whether the chain from a start keeps its budget at every length, the whole ring included."""
    ring = segments(max_bits)

    def mask(first: int, length: int) -> int:
        bits = sum(((1 << w) - 1) << o for o, w in
                   (ring[(first + i) % len(ring)] for i in range(length)))
        return bits - (1 << 64) if bits >> 63 else bits

    within = F.lit(True)
    for length in range(3, len(ring) + 1):
        masks = F.array(*[F.lit(mask(first, length)).cast("long") for first in range(len(ring))])
        budget = length * max_bits // len(ring)
        within &= F.bit_count(differing.bitwiseAND(F.get(masks, start))) <= budget
    return within


def _start(key: Column, max_bits: int) -> Column:
    width = max(w for _, w in segments(max_bits))
    return F.shiftrightunsigned(key, 2 * width).cast("int")


def links(nodes: DataFrame, max_bits: int = 4, hot: int = 64) -> DataFrame:
    """(a, b): links between distinct fingerprints that give the components of all links.

    ``nodes`` has one column, fp.  First every fingerprint is compared with one
    representative of each chain it shares exactly (a row each, however large the
    group), which gathers dense groups into labels.  Then chains within the budget of
    two segments propose pairs; only pairs with different labels are proposed, checked
    along the ring and at last by the full distance.  In a chain shared by more than
    ``hot`` fingerprints, those of its commonest label meet only those of other labels.
    No pair of different labels is left out, so a link that is not listed joins two
    fingerprints that the listed links connect.
    """
    index = park(
        nodes.select("fp", F.explode(_chain_keys(F.col("fp"), max_bits, False)).alias("key")),
        "chains")
    heads = park(
        index.groupBy("key").agg(F.min("fp").alias("head"), F.count("*").alias("members"))
        .where(F.col("members") > 1), "chain-heads")
    stars = park(
        index.join(heads, "key").where(
            (F.col("fp") != F.col("head"))
            & (F.bit_count(F.col("fp").bitwiseXOR(F.col("head"))) <= max_bits))
        .select(F.col("fp").alias("a"), F.col("head").alias("b")).distinct(), "stars")
    labels = park(components(stars), "labels").withColumnsRenamed(
        {"node": "fp", "component": "label"})
    labelled = park(
        nodes.join(labels, "fp", "left").select("fp", F.coalesce("label", "fp").alias("label")),
        "labelled")

    def chains(spread: bool) -> DataFrame:
        keys = _chain_keys(F.col("fp"), max_bits, spread)
        return labelled.select("fp", "label", F.explode(keys).alias("key"))

    main = park(
        chains(False).join(heads.where(F.col("members") > hot).select("key"), "key")
        .groupBy("key", "label").count()
        .groupBy("key").agg(F.max_by("label", F.struct("count", "label")).alias("main")),
        "hot-chains")

    def sided(rows: DataFrame) -> DataFrame:
        return rows.join(main, "key", "left").withColumn(
            "major", F.coalesce(F.col("label") == F.col("main"), F.lit(False))
        ).withColumn("is_hot", F.col("main").isNotNull()).drop("main")

    members = sided(chains(False)).select(
        "key", F.col("major").alias("side"), F.col("fp").alias("b"), F.col("label").alias("label_b"))
    probes = sided(chains(True)).select(
        "key", F.col("fp").alias("a"), F.col("label").alias("label_a"),
        F.explode(F.when(F.col("is_hot") & ~F.col("major"), F.array(F.lit(True), F.lit(False)))
                  .otherwise(F.array(F.lit(False)))).alias("side"))
    differing = F.col("a").bitwiseXOR(F.col("b"))
    pairs = probes.join(
        members,
        (probes["key"] == members["key"]) & (probes["side"] == members["side"])
        & (probes["label_a"] != members["label_b"])
        & _chain_holds(differing, _start(probes["key"], max_bits), max_bits)
        & (F.bit_count(differing) <= max_bits),
    ).select("a", "b")
    return stars.unionAll(pairs)


def near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    shingle_words: int = 4, max_bits: int = 4,
) -> DataFrame:
    """(doc_id, version, fp, component_id, root) for each input row.

    Fingerprints that differ in at most max_bits bits are linked; a component's id is
    its smallest doc_id and its root the smallest fingerprint.  ``version`` is xxhash64 of the text, which tells rows with
    one id apart.  Null and empty texts have fingerprint zero, linked like any other.
    A row without an id belongs to its component too, and gets a null component_id if
    nothing there has an id.  Repeated rows come back as often as they occur.
    """
    prints = park(_fingerprints(docs, id_col, text_col, shingle_words), "fingerprints")
    nodes = park(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    found = park(components(links(nodes.select("fp"), max_bits)), "components").withColumnsRenamed(
        {"node": "fp", "component": "root"})
    rooted = nodes.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = park(rooted.join(smallest, "root").select("fp", "component_id", "root"), "named")
    return prints.join(named, "fp").select("doc_id", "version", "fp", "component_id", "root")


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    shingle_words: int = 4, max_bits: int = 4,
) -> DataFrame:
    """The documents, one of each component: the smallest id, then text hash.

    All columns stay.  A row without any id in its component is told by its text hash
    alone.  Rows that repeat both id and text are one document and stay once.
    """
    found = near_copies(docs, id_col, text_col, shingle_words, max_bits)
    chosen = found.groupBy("root").agg(
        F.min(F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("_id"), "version")).alias("row")
    ).select("row._id", F.col("row.version").alias("_version"))
    keyed = docs.withColumns({
        "_row_id": F.coalesce(docs[id_col].cast("long"), F.lit(2**63 - 1)),
        "_row_version": F.xxhash64(docs[text_col].cast("string")),
    })
    kept = keyed.join(
        chosen, (keyed["_row_id"] == chosen["_id"]) & (keyed["_row_version"] == chosen["_version"]),
        "left_semi")
    order = Window.partitionBy("_row_id", "_row_version").orderBy(F.lit(0))
    return kept.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").select(docs.columns)
