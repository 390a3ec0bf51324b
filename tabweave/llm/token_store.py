"""Token ids in files of directly addressable codes."""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabweave.llm.common import binary_column, identified, park, utf8
from tabweave.llm.memory import WordMemory, ordered

MAGIC = b"DACIDS01"          # fixed values: the format's mark and layout
CHUNK = 8                    # bits of an id in a level
BLOCK = 512                  # bits of a bitmap between two entries of its rank directory
FILE_TOKENS = 4_000_000      # a file is closed after so many ids
MAX_WORDS = 300_000          # encoded words that a worker remembers at a time
GROUP = 2000                 # words in a text that the library encodes
SLICE = 4 << 20              # bytes of text that a step holds at once
NO_ID = -(2**63)             # stands for a null doc_id in a file
MANY_FILES = 500_000         # the starts of more files are joined rather than broadcast
_MARK = re.compile(rb"(?<=[a-z])([.,;:!?])(?=[ \n])")


class Level:
    """The chunks of one level, a bitmap of the ids that go on, and its rank directory."""

    def __init__(self, chunks: np.ndarray, bitmap: np.ndarray, ranks: np.ndarray):
        self.chunks, self.bitmap, self.ranks = chunks, bitmap, ranks

    def goes_on(self, at: np.ndarray) -> np.ndarray:
        return (self.bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ids before each place that go on: the directory, and a count within the block."""
        block = at // BLOCK
        inside = self.bitmap[(block * (BLOCK // 8))[:, None] + np.arange(BLOCK // 8)]
        bits = np.clip((at % BLOCK)[:, None] - 8 * np.arange(BLOCK // 8), 0, 8)
        inside = inside & ((1 << bits) - 1).astype(np.uint8)
        return self.ranks[block] + np.bitwise_count(inside).sum(axis=1, dtype=np.int64)


def to_levels(ids: np.ndarray) -> list[Level]:
    """Ids below 2^32 as levels of CHUNK bits, the lowest first."""
    levels, rest = [], ids.astype(np.uint32)
    while len(rest) or not levels:
        more = rest >> CHUNK != 0
        padded = np.zeros(-(-(len(rest) + 1) // BLOCK) * BLOCK, bool)
        padded[:len(rest)] = more
        counts = padded.reshape(-1, BLOCK).sum(axis=1)
        levels.append(Level(
            (rest & (2**CHUNK - 1)).astype(np.uint8), np.packbits(padded, bitorder="little"),
            (np.cumsum(counts) - counts).astype(np.uint32)))
        rest = rest[more] >> CHUNK
    return levels


class TokenFile:
    """One file: documents in order, their bounds, and the levels of their ids."""

    def __init__(self, doc_ids: np.ndarray, bounds: np.ndarray, levels: list[Level]):
        self.doc_ids, self.bounds, self.levels = doc_ids, bounds, levels

    def to_bytes(self) -> bytes:
        out = [MAGIC, struct.pack("<QQ", len(self.doc_ids), len(self.levels)),
               self.doc_ids.astype("<i8").tobytes(), self.bounds.astype("<u8").tobytes()]
        for level in self.levels:
            out += [struct.pack("<Q", len(level.chunks)), level.chunks.tobytes(),
                    level.bitmap.tobytes(), level.ranks.astype("<u4").tobytes()]
        return b"".join(out)

    @classmethod
    def from_bytes(cls, data: bytes) -> TokenFile:
        """Arrays over the bytes; nothing is decoded."""
        if data[:8] != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        docs, n_levels = struct.unpack_from("<QQ", data, 8)
        at = 24

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(data, kind, count, at)
            at += found.nbytes
            return found

        doc_ids, bounds, levels = take("<i8", docs), take("<u8", docs + 1).astype(np.int64), []
        for _ in range(n_levels):
            n = int(take("<u8", 1)[0])
            blocks = -(-(n + 1) // BLOCK)
            levels.append(Level(take("u1", n), take("u1", blocks * BLOCK // 8), take("<u4", blocks)))
        return cls(doc_ids, bounds, levels)

    def tokens(self, at: np.ndarray) -> np.ndarray:
        """Ids at any places, each by itself."""
        out = np.zeros(len(at), np.uint32)
        where, places = np.arange(len(at)), np.asarray(at, np.int64)
        for k, level in enumerate(self.levels):
            out[where] |= level.chunks[places].astype(np.uint32) << np.uint32(CHUNK * k)
            more = level.goes_on(places)
            where, places = where[more], level.rank(places[more])
            if not len(where):
                break
        return out

    def span(self, start: int, stop: int) -> np.ndarray:
        """Ids from start to stop: one rank for each level, then in a row."""
        out = np.zeros(stop - start, np.uint32)
        where = np.arange(stop - start)
        for k, level in enumerate(self.levels):
            if start >= stop:
                break
            out[where] |= level.chunks[start:stop].astype(np.uint32) << np.uint32(CHUNK * k)
            bits = np.unpackbits(level.bitmap[start // 8:-(-stop // 8)], bitorder="little")
            more = bits[start % 8:start % 8 + stop - start] == 1
            where = where[more]
            start = int(level.rank(np.array([start]))[0])
            stop = start + len(where)
        return out

    def document(self, n: int) -> np.ndarray:
        return self.span(int(self.bounds[n]), int(self.bounds[n + 1]))


class WordTokenizer:
    """A word tokenizer of the library; words between ASCII white space are encoded once.

    Holds for tokenizers that lower-case texts, treat white space as a border, drop it, keep
    runs of letters in one piece of their own and mark the last id of a piece.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
        self.library = Tokenizer.from_file(path)
        special = self.library.get_added_tokens_decoder()
        self.border_id, self.border = max((i, t.content) for i, t in special.items())
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        self.last = np.zeros(max(vocabulary.values()) + len(special) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.memory = WordMemory(self._encode, MAX_WORDS)

    def _joined(self, words: list[str], between: str) -> list[np.ndarray]:
        groups = [between.join(words[i:i + GROUP]) for i in range(0, len(words), GROUP)]
        return [np.array(e.ids, np.int64) for e in
                self.library.encode_batch_fast(groups, add_special_tokens=False)]

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Words of Latin letters go as one text and end where the library marks an end.

        Others, and those if the marks do not add up, are joined by a special token;
        words that may hold one go alone.
        """
        texts = [w.decode() for w in words]
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        plain, mixed = [], []
        for i, text in enumerate(texts):
            if text.lower().isalpha() and max(text) < "\u0250":
                plain.append(i)
            elif "<|" in text or self.border in text:
                ids = np.array(self.library.encode(text, add_special_tokens=False).ids, np.int64)
                parts.append((np.array([i]), ids, np.array([len(ids)])))
            else:
                mixed.append(i)
        for n, ids in enumerate(self._joined([texts[i] for i in plain], " ")):
            here = np.array(plain[n * GROUP:(n + 1) * GROUP])
            sizes = np.diff(np.flatnonzero(self.last[ids]), prepend=-1)
            if len(sizes) == len(here):
                parts.append((here, ids, sizes))
            else:
                mixed += here.tolist()
        for n, ids in enumerate(self._joined([texts[i] for i in mixed], self.border)):
            here = np.array(mixed[n * GROUP:(n + 1) * GROUP])
            borders = np.flatnonzero(ids == self.border_id)
            sizes = np.diff(np.concatenate([[-1], borders, [len(ids)]])) - 1
            parts.append((here, ids[ids != self.border_id], sizes))
        return ordered(parts, len(words))

    def words(self, text: bytes) -> list[bytes]:
        """Parts that are encoded alike wherever they stand.

        A mark behind a letter and before a space is a part of its own.  A-Z become
        small, unless that could make a special token.
        """
        if b"<|" in text:
            return text.split()
        return _MARK.sub(rb" \1 ", text.lower()).split()

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the number of each."""
        return self.memory.ids(list(map(self.words, texts)))


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def _put(folder: str, name: str, data: bytes) -> None:
    """Write a whole file under another name and rename it, so that a retry is harmless."""
    store, path = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith(
        "file:") else (fs.LocalFileSystem(), folder)
    store.create_dir(path, recursive=True)
    draft = f"{path}/_{name}-{os.getpid()}-{np.random.default_rng().integers(2**62)}"
    with store.open_output_stream(draft) as out:
        out.write(data)
    store.move(draft, f"{path}/{name}")


def write_tokens(
    docs: DataFrame, folder: str, tokenizer_path: str, end_id: int,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Encode whole texts, end each with end_id, and write them in ascending doc_id order.

    ``folder`` is on storage that all machines share.  Rows are dealt by ranges of
    doc_id, then of the text's hash (so that a repeated id does not meet in one task);
    null ids come first.  A task writes files of about FILE_TOKENS ids, named so that
    their names sort as their rows.  Returns a table of (file, docs, tokens), a row for
    each file, in the shared folder.
    """
    rows = identified(docs, id_col, text_col).select(
        F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), utf8(F.col("text")).alias("text"),
        F.xxhash64("text").alias("tie"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, task = tokenizer(tokenizer_path), TaskContext.get().partitionId()
        doc_ids: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        files = 0

        def close() -> pa.RecordBatch:
            nonlocal files, doc_ids, ids, sizes
            bounds = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
            name = f"{task:08d}-{files:06d}.dac"
            every = np.concatenate(ids)
            _put(folder, name, TokenFile(np.concatenate(doc_ids), bounds, to_levels(every)).to_bytes())
            row = pa.RecordBatch.from_pydict(
                {"file": [name], "docs": [len(bounds) - 1], "tokens": [len(every)]})
            files, doc_ids, ids, sizes = files + 1, [], [], []
            return row

        for batch in batches:
            if not batch.num_rows:
                continue
            _, offsets = binary_column(batch.column(1))
            start = 0
            while start < batch.num_rows:
                stop = int(np.searchsorted(offsets, offsets[start] + SLICE, "right")) - 1
                stop = min(max(stop, start + 1), batch.num_rows)
                found, counts = coder.encode(batch.column(1)[start:stop].to_pylist())
                ids.append(np.insert(found, np.cumsum(counts), end_id).astype(np.uint32))
                sizes.append(counts + 1)
                doc_ids.append(batch.column(0)[start:stop].to_numpy())
                start = stop
                if sum(map(len, ids)) >= FILE_TOKENS:
                    yield close()
        if sizes:
            yield close()

    return park(ordered.mapInArrow(write, "file string, docs long, tokens long"), "token-files")


def read_tokens(spark: SparkSession, folder: str, files: DataFrame, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32 and, if wanted, ids) of every document in the files.

    ``start`` counts the ids of all documents before it.  The driver adds up one number
    for each file, as it also lists them.
    """
    known = sorted((r.file, r.tokens) for r in files.collect())
    if not known:
        kind = "doc_id long, start long, n_tokens long, ids_crc32 long"
        return spark.createDataFrame([], kind + (", ids array<int>" if with_ids else ""))
    begin = dict(zip((f for f, _ in known), np.cumsum([0] + [n for _, n in known]).tolist()))
    starts = spark.createDataFrame(list(begin.items()), "file string, start long")
    if len(known) <= MANY_FILES:  # 50 bytes each
        starts = F.broadcast(starts)
    content = spark.read.format("binaryFile").option("pathGlobFilter", "*.dac").load(folder).select(
        F.element_at(F.split("path", "/"), -1).alias("file"), "content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = TokenFile.from_bytes(data.as_buffer())
                places = iter(range(len(found.doc_ids)))
                while some := list(islice(places, 4096)):
                    ids = [found.document(n) for n in some]
                    columns = [
                        pa.array([None if i == NO_ID else int(i) for i in found.doc_ids[some]], pa.int64()),
                        pa.array(start + found.bounds[some]),
                        pa.array(np.array([len(x) for x in ids], np.int64)),
                        pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                    ] + ([pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))]
                         if with_ids else [])
                    yield pa.RecordBatch.from_arrays(
                        columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][:len(columns)])

    return content.join(starts, "file").select("start", "content").mapInArrow(
        read, "doc_id long, start long, n_tokens long, ids_crc32 long"
        + (", ids array<int>" if with_ids else ""))
