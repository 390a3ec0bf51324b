"""Benchmark decontamination with an Aho-Corasick automaton."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabweave.llm.common import identified, park, utf8

WINDOW = 10               # words in a window
MAX_CHARS = 4 << 20       # item text in one automaton: some 200 MB in each worker
# Bytes outside [\x00-\x2F\x3A-\x60\x7B-\x7F] after A-Z are lower-cased are words.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def word_spans(text: bytes) -> list[tuple[int, int]]:
    """(start, end) of each word in code points of the original text."""
    starts = np.frombuffer(text, np.uint8) & 0xC0 != 0x80
    points = np.concatenate([[0], np.cumsum(starts)])
    return [(int(points[m.start()]), int(points[m.end()]))
            for m in _WORD.finditer(text.translate(_FOLD))]


def item_windows(text: bytes, window: int) -> list[bytes]:
    """Every run of so many words, or all words if fewer."""
    found = words_of(text)
    if not found:
        return []
    return [b" ".join(found[i:i + window]) for i in range(max(1, len(found) - window + 1))]


class Scanner:
    """One automaton over the windows of some items; a window may belong to several."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        owners: dict[bytes, tuple[int, set[str]]] = {}
        for item, text in items:
            for each in item_windows(text, window):
                owners.setdefault(each, (each.count(b" ") + 1, set()))[1].add(item)
        self.automaton = ahocorasick.Automaton()
        for each, value in owners.items():
            self.automaton.add_word(f" {each.decode()} ", value)
        if owners:
            self.automaton.make_automaton()

    def scan(self, text: bytes) -> tuple[int, list[int], list[int], set[str]]:
        """(words, starts and ends of the occurrences in words, items that occur)."""
        found = words_of(text)
        starts, ends, items = [], [], set()
        if found and len(self.automaton):
            joined = f" {b' '.join(found).decode()} "
            gaps = None
            for last, (length, owners) in self.automaton.iter(joined):
                if gaps is None:  # the places of the spaces, once for a text with an occurrence
                    code = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
                    gaps = np.flatnonzero(code == 32)
                end = int(np.searchsorted(gaps, last))
                starts.append(end - length)
                ends.append(end)
                items |= owners
        return len(found), starts, ends, items


_scanners: dict[str, Scanner] = {}


def _scanner(key: str, items: list[tuple[str, bytes]], window: int) -> Scanner:
    if key not in _scanners:  # a worker keeps the automaton of one scan
        _scanners.clear()
        _scanners[key] = Scanner(items, window)
    return _scanners[key]


def merged(starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    """The union of intervals, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(starts, ends)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


FOUND = ("n_words long, hit_starts array<long>, hit_ends array<long>, items array<string>, "
         "char_starts array<long>, char_ends array<long>")


def _scan(text: Column, shared: Broadcast, window: int) -> Column:
    """Occurrences of broadcast items in a column of UTF-8 texts, as a struct of FOUND."""
    key = uuid.uuid4().hex
    long, longs = pa.int64(), pa.list_(pa.int64())
    kinds = pa.struct([
        ("n_words", long), ("hit_starts", longs), ("hit_ends", longs),
        ("items", pa.list_(pa.string())), ("char_starts", longs), ("char_ends", longs)])

    @F.arrow_udf(f"struct<{FOUND.replace(' long', ':long').replace(' array', ':array')}>")
    def found(texts: pa.Array) -> pa.Array:
        scanner, rows = _scanner(key, shared.value, window), []
        for text in texts:
            text = text.as_py()
            n, starts, ends, owners = scanner.scan(text)
            hits = merged(starts, ends)
            spans = word_spans(text) if hits else []
            rows.append((n, [a for a, _ in hits], [b for _, b in hits], sorted(owners),
                         [spans[a][0] for a, _ in hits], [spans[b - 1][1] for _, b in hits]))
        return pa.StructArray.from_arrays(
            [pa.array([r[i] for r in rows], kinds.field(i).type) for i in range(6)],
            fields=list(kinds))

    return found(text)


def _groups(
    items: DataFrame, item_col: str, item_text_col: str, max_chars: int
) -> tuple[int, Iterator[Broadcast]]:
    """How many groups of bounded text the items make, and the groups, broadcast one at a time.

    Each is small enough for one automaton.  A test set within the bound is one group.  A
    larger one is dealt by a hash of its items into as many groups as it takes, and parked
    by group.  The driver holds one group; the broadcast of a group is released when the
    next is asked for, so its scan must have been parked by then.  The last one stays.
    """
    known = items.select(
        F.coalesce(items[item_col].cast("string"), F.lit("")).alias("item"),
        utf8(items[item_text_col]).alias("text"),
    ).where(F.length("text") > 0)
    total = known.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total * 2 // max_chars) if total > max_chars else 1
    if n > 1:
        group = F.pmod(F.xxhash64("item", "text"), F.lit(n))
        known = park(known.withColumn("group", group).repartition("group").sortWithinPartitions("group"), "items")
    context = items.sparkSession.sparkContext

    def each() -> Iterator[Broadcast]:
        for group in range(n):
            part = known.where(F.col("group") == group) if n > 1 else known
            shared = context.broadcast([(r.item, bytes(r.text)) for r in part.select("item", "text").collect()])
            yield shared
            if group < n - 1:
                shared.destroy()

    return n, each()


def scan_documents(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
    window: int = WINDOW, max_chars: int = MAX_CHARS,
) -> DataFrame:
    """Where windows of the test items occur, by document.

    One pass over each whole text.  Returns, for each input row, doc_id, n_words,
    n_hit (words inside occurrences), hit_starts/hit_ends (merged occurrences in
    words), char_starts/char_ends (the same in code points of the original text, from
    the first to the last hit word), items (sorted ids of the items with an occurring
    window).  Null texts and null items have no words; an item without an id counts
    under the id "".  Repeated rows come back as often as they occur.

    Items are broadcast in groups of about max_chars bytes; a test set beyond that is
    scanned for group by group and the occurrences are united.
    """
    texts = identified(docs, id_col, text_col).select("doc_id", utf8(F.col("text")).alias("text"))
    n, groups = _groups(items, item_col, item_text_col, max_chars)
    if n == 1:
        found = texts.select("doc_id", _scan(F.col("text"), next(groups), window).alias("f"))
        found = found.select("doc_id", "f.*")
    else:
        found = _united(texts, groups, window)
    hit = F.aggregate(
        F.zip_with("hit_starts", "hit_ends", lambda a, b: b - a), F.lit(0).cast("long"),
        lambda total, each: total + each)
    return found.withColumn("n_hit", hit)


def _united(texts: DataFrame, groups: Iterator[Broadcast], window: int) -> DataFrame:
    """One scan of parked rows for each group of items; the occurrences of a row united."""
    rows = park(texts.withColumn("row", F.monotonically_increasing_id()), "texts")
    scans = [
        park(rows.select("row", "doc_id", _scan(F.col("text"), group, window).alias("f"))
             .select("row", "doc_id", "f.*"), "scan")
        for group in groups
    ]
    every = scans[0]
    for scan in scans[1:]:
        every = every.unionAll(scan.where(F.size("items") > 0))

    def union(starts: str, ends: str) -> Column:
        """Disjoint intervals (a, b), in order."""
        each = F.array_sort(F.flatten(F.collect_list(F.arrays_zip(
            F.col(starts).alias("a"), F.col(ends).alias("b")))))
        return F.aggregate(
            each, F.array().cast("array<struct<a:bigint,b:bigint>>"),
            lambda out, x: F.when(
                (F.size(out) > 0) & (x["a"] <= F.try_element_at(out, F.lit(-1))["b"]),
                F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(
                    F.try_element_at(out, F.lit(-1))["a"].alias("a"),
                    F.greatest(F.try_element_at(out, F.lit(-1))["b"], x["b"]).alias("b")))),
            ).otherwise(F.concat(out, F.array(x))))

    merged_rows = every.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"),
        union("hit_starts", "hit_ends").alias("hits"),
        union("char_starts", "char_ends").alias("chars"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return merged_rows.select(
        "doc_id", "n_words", F.col("hits.a").alias("hit_starts"), F.col("hits.b").alias("hit_ends"),
        "items", F.col("chars.a").alias("char_starts"), F.col("chars.b").alias("char_ends"))


def drop_contaminated(
    docs: DataFrame, items: DataFrame, text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
    window: int = WINDOW, max_chars: int = MAX_CHARS,
) -> DataFrame:
    """The rows in whose text no window of any item occurs; all columns stay."""
    n, groups = _groups(items, item_col, item_text_col, max_chars)
    for nth, group in enumerate(groups, 1):
        docs = docs.where(F.size(_scan(utf8(F.col(text_col)), group, window)["items"]) == 0)
        if nth < n:  # one automaton in memory at a time
            docs = park(docs, "clean")
    return docs
