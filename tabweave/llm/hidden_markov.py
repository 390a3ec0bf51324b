"""Language-model scores from a hidden Markov model trained by Baum-Welch."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.llm import native
from tabweave.llm.common import binary_column, by_slices, drop_at_exit, fold, identified, park, shuffles_removed, utf8
from tabweave.llm.memory import _Known
from tabweave.sources.scratch import fresh_path

END = b" "              # no word: words hold no white space
STATES = 8
LOCAL_WORDS = 250_000   # the commonest words whose counts and emissions every worker holds
START_ROUNDS = 10       # from random states, the likelihood hardly rises in so many rounds
ROUNDS = 4              # further rounds, at least; all rounds are over all training documents
SETTLED = 1e-4          # training ends when a round raises the log-likelihood by less than this share
GROUP = 1 << 18         # tokens of the texts that a step of the recursions holds at once
SCALED = 8              # steps between scalings; so many chances multiplied stay far from the smallest double
SLICE = 8 << 20         # bytes of text that a step holds at once
BLOCK = 5 << 20         # tokens of the texts of a block, at least, if its task has so many
RANGE = 1 << 16         # words beyond the commonest whose emissions are one row, about
LOCAL_RANGE = 1 << 13   # of the commonest words


@dataclass
class Model:
    """Distributions of the first state, of the next state, and of each state's symbols.

    ``emit`` is (symbols, states).  The last symbol is the end of a text, the one before
    it any word that is no symbol.  Words that workers do not hold have their emissions
    in a table, from which each block of texts gets those of its own words.
    """

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    def groups(self, texts: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, list[int]]]:
        """(places, symbols, texts still running by step) of texts of like length, longest first.

        Symbols are end to end by step: the first of all texts, the second of all that have one, ...
        """
        lengths = np.array([len(t) for t in texts])
        order = np.argsort(-lengths, kind="stable")
        at = 0
        while at < len(order):
            sizes, part = np.cumsum(lengths[order[at:at + GROUP]]), order[at:]
            part = part[:max(1, int(np.searchsorted(sizes, GROUP, "right")))]
            at += len(part)
            own = lengths[part]
            running = np.searchsorted(-own, -np.arange(own[0]), "left")
            begins = np.concatenate([[0], np.cumsum(running)[:-1]])
            symbols = np.empty(int(own.sum()), np.int64)
            for column, i in enumerate(part.tolist()):
                symbols[begins[:lengths[i]] + column] = texts[i]
            yield part, symbols, running.tolist()

    def forward(self, symbols: np.ndarray, running: list[int], keep: bool):
        """Log-likelihoods by the scaled forward recursion; if kept, its states and the scaled emissions.

        Arrays are (state, token), so that every operation runs along the texts.  States
        are scaled to add up to 1 in every SCALED-th step and at the end of each text.
        """
        chances = np.empty((len(self.start), len(symbols)))
        for i in range(0, len(symbols), 1 << 14):
            chances[:, i:i + (1 << 14)] = self.emit.take(symbols[i:i + (1 << 14)], axis=0).T
        states = np.empty(chances.shape) if keep else None
        logs, move, begin = np.zeros(running[0]), np.ascontiguousarray(self.move.T), 0
        for t, (n, after) in enumerate(zip(running, [*running[1:], 0])):
            here = slice(begin, begin + n)
            now = np.multiply(move @ now[:, :n] if t else self.start[:, None], chances[:, here],
                              out=states[:, here] if keep else None)
            ended = 0 if t % SCALED == SCALED - 1 else after
            if ended < n:
                scale = now[:, ended:].sum(axis=0)
                logs[ended:n] += np.log(scale)
                scale = 1.0 / scale
                now[:, ended:] *= scale
                if keep:
                    chances[:, begin + ended:begin + n] *= scale
            begin += n
        return logs, states, chances

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """log10 of the exact likelihood of each text's symbols."""
        out = np.zeros(len(texts))
        for places, symbols, running in self.groups(texts):
            out[places] = self.forward(symbols, running, False)[0] / np.log(10)
        return out

    def expect(self, texts: list[np.ndarray]) -> Expected:
        """Expected counts of Baum-Welch over some texts; rounds have the same from native.py."""
        total = Expected.zero(*self.emit.shape)
        emit = np.zeros(self.emit.shape[::-1])
        for _, symbols, running in self.groups(texts):
            logs, states, chances = self.forward(symbols, running, True)
            total.likelihood += float(logs.sum())
            later, moves, begin = np.ones((len(self.start), running[0])), np.zeros(self.move.shape), len(symbols)
            for t in range(len(running) - 1, -1, -1):
                n = running[t]
                begin -= n
                here, then = slice(begin, begin + n), later[:, :n]
                if t:
                    coming = chances[:, here]
                    coming *= then
                    before = begin - running[t - 1]
                    moves += states[:, before:before + n] @ coming.T
                states[:, here] *= then  # from here on, the chances of each state given all
                if t:
                    np.matmul(self.move, coming, out=then)
            total.move += self.move * moves
            total.start += states[:, :running[0]].sum(axis=1)
            for sums, each in zip(emit, states):
                sums += np.bincount(symbols, each, len(sums))
        total.emit += emit.T
        return total


@dataclass
class Expected:
    """Expected numbers of starts, moves and emissions, and the log-likelihood."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray
    likelihood: float = 0.0

    @classmethod
    def zero(cls, symbols: int, states: int) -> Expected:
        return cls(np.zeros(states), np.zeros((states, states)), np.zeros((symbols, states)))

    def __iadd__(self, other: Expected) -> Expected:
        self.start += other.start
        self.move += other.move
        self.emit += other.emit
        self.likelihood += other.likelihood
        return self

    def model(self, shares: np.ndarray, tail: Tail | None = None) -> Model:
        """The next model; a little of the symbols' overall shares keeps every chance positive.

        Each symbol has half a count more, as in the base score, split by how much a state
        is used, so that a rare word is not tied to the state of its one occurrence.
        """
        used = self.emit.sum(axis=0) + (tail.sums if tail else 0.0)
        even = 0.5 * used / used.sum()
        emit = self.emit + 2.0 * shares[:, None]
        emit += even
        total = emit.sum(axis=0)
        if tail:
            total = total + tail.sums + 2.0 * tail.share + even * tail.count
            tail.even, tail.total = even, total
        move, start = self.move + 0.1, self.start + 0.1
        return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), np.divide(emit, total, out=emit))


@dataclass
class Tail:
    """The training words that workers do not hold, dealt into ranges by hash.

    Expected emissions are (words, states) doubles: in ``rows`` (range, block, far) those of a
    block's words in a range that other blocks have too, in ``own`` (block, own, mask) of those
    that no other block has, which stay with it.  ``sums`` are those of all by state, ``count`` how
    many words they are, ``share`` their part of all smoothed counts, which add up to ``whole``.
    """

    rows: DataFrame | None
    own: DataFrame
    paths: list[str]
    sums: np.ndarray
    count: int
    share: float
    whole: float
    even: np.ndarray | None = None
    total: np.ndarray | None = None
    first: str | None = None  # the path of rows before the first round

    def chances(self):
        """A function from expected emissions to the chances of each word by state."""
        even, total, whole = self.even, self.total, self.whole

        def each(counts: np.ndarray) -> np.ndarray:
            # the chances of states add up to 1, so the sum is the word's count
            return (counts + 2.0 / whole * (counts.sum(axis=1, keepdims=True) + 0.5) + even) / total

        return each


def _dropped(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def hashed(tokens: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(t) for t in tokens], np.uint64)


def noise(hashes: np.ndarray, states: int) -> np.ndarray:
    """(tokens, states) numbers above 0.2, exponential, from the tokens' hashes alone."""
    mixed = hashes[:, None] + np.arange(1, states + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    mixed ^= mixed >> np.uint64(31)
    return 0.2 - np.log1p(-(mixed >> np.uint64(11)) * 2.0 ** -53)


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()  # of bytes: A-Z only, and ASCII white space only


def tokenized(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """``words_of`` of many texts end to end, and how many each has."""
    flat, offsets = binary_column(texts)
    plain = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets), pa.py_buffer(flat))  # any bytes
    lists = pc.ascii_split_whitespace(pc.ascii_lower(plain))
    words, sizes = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    some = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0  # white space at either end gives an empty one
    sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[some], minlength=len(sizes))
    return words.filter(pa.array(some)).cast(pa.large_binary()).dictionary_encode(), sizes


def token_counts(texts: DataFrame) -> DataFrame:
    """(token, c) of all words and of the ends of (doc_id, text), counted in the tasks first."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, _ = tokenized(batch.column(1))
        tokens = words.dictionary.cast(pa.binary())
        counts = np.bincount(words.indices.to_numpy(), minlength=len(tokens))
        return pa.RecordBatch.from_arrays(
            [pa.concat_arrays([tokens, pa.array([END], pa.binary())]),
             pa.array(np.append(counts, batch.num_rows).astype(np.int64))], ["token", "c"])

    return texts.mapInArrow(by_slices(step, SLICE), "token binary, c long").groupBy("token").agg(
        F.sum("c").alias("c"))


def commonest(counts: DataFrame, limit: int) -> list[tuple[bytes, int]]:
    """At most so many words, all that occur more often than some number; commonest first.

    That number comes from a histogram, so that no task sorts all words.
    """
    words = counts.where(F.col("token") != END)
    step = F.floor(F.log2("c") * 16)
    histogram = sorted((r.step, r["count"]) for r in
                       words.groupBy(step.alias("step")).count().collect())  # 16 rows a doubling
    total, least = 0, None
    for at, n in reversed(histogram):
        if total + n > limit:
            break
        total, least = total + n, at
    if least is None:
        return []
    rows = words.where(step >= least).select("token", "c").toArrow()
    return sorted(zip(rows["token"].to_pylist(), rows["c"].to_pylist()), key=lambda x: (-x[1], x[0]))


BLOCKS = ("block long, held_out boolean, doc_ids array<long>, lengths array<int>, words binary, places binary, "
          "ranges binary, tail array<binary>, counts binary")


def _blocks(rows: DataFrame, words: list[tuple[bytes, int]], ranges: int, buckets: int) -> DataFrame:
    """Texts in blocks, a row each: those of one fold that a task meets, BLOCK tokens or the last.

    ``words`` numbers the words of all texts end to end, ``lengths`` of each text, by their
    first occurrence in the block.  ``places`` has for each of these words its place among
    those that workers hold, or -1; for the others, ``tail`` has the word, ``ranges`` its
    range and ``counts`` its occurrences.  The table is bucketed by block, so that rounds
    read it without a shuffle.
    """
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(b" ".join(w for w, _ in words))  # at most LOCAL_WORDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = {w: i for i, w in enumerate(shared.value.split())}
        first, made = TaskContext.get().partitionId() << 33, 0
        open_blocks: dict[bool, tuple[_Known, list, list, list, int]] = {}

        def closed(held: bool) -> pa.RecordBatch:
            nonlocal made
            known, ids, lengths, texts, _ = open_blocks.pop(held)
            vocabulary = list(known)
            at = np.fromiter((local.get(w, -1) for w in vocabulary), np.int32, len(vocabulary))
            numbers = np.concatenate(texts)
            tail = [vocabulary[i] for i in np.flatnonzero(at < 0).tolist()]
            dealt = np.fromiter((xxhash.xxh64_intdigest(w, 7) % ranges for w in tail), np.int32, len(tail))
            counts = np.bincount(numbers, minlength=len(at))[at < 0].astype(np.int64)
            row = [first + made, held, ids, lengths, numbers.tobytes(), at.tobytes(),
                   dealt.tobytes(), tail, counts.tobytes()]
            made += 1
            kinds = [pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary(),
                     pa.binary(), pa.list_(pa.binary()), pa.binary()]
            names = ["block", "held_out", "doc_ids", "lengths", "words", "places", "ranges", "tail", "counts"]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names)

        def numbered(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for held in (False, True):
                part = batch.filter(pc.equal(batch.column(2), held))
                words, sizes = tokenized(part.column(1))
                ids, at, tokens = part.column(0).to_pylist(), words.indices.to_numpy(), words.dictionary.to_pylist()
                ends, cuts, begin = np.cumsum(sizes + 1), np.append(0, np.cumsum(sizes)), 0
                while begin < len(ids):
                    known, own, lengths, texts, n = open_blocks.get(held) or (_Known(), [], [], [], 0)
                    enough = int(np.searchsorted(ends, BLOCK - n + (ends[begin - 1] if begin else 0)))
                    stop = min(enough + 1, len(ids))
                    here = at[cuts[begin]:cuts[stop]]
                    number = np.zeros(len(tokens), np.int32)
                    for i in np.flatnonzero(np.bincount(here)).tolist():
                        number[i] = known[tokens[i]]
                    texts.append(number[here])
                    own += ids[begin:stop]
                    lengths += sizes[begin:stop].tolist()
                    open_blocks[held] = known, own, lengths, texts, n + len(here) + stop - begin
                    begin = stop
                    if open_blocks[held][-1] >= BLOCK:
                        yield closed(held)

        for part in by_slices(lambda x: x, SLICE)(batches):
            yield from numbered(part)
        for held in list(open_blocks):
            yield closed(held)
        local.clear()
        pa.default_memory_pool().release_unused()  # the worker stays, beside the JVM's rounds

    found, _ = _bucketed(rows.select("doc_id", "text", "held_out").mapInArrow(run, BLOCKS).repartition(
        buckets, "block"), buckets, "blocks", "zstd")
    shared.destroy()
    return found


def _bucketed(rows: DataFrame, buckets: int, label: str, compression: str) -> tuple[DataFrame, str]:
    """Rows written to the shared folder in buckets by block, and the path."""
    spark = rows.sparkSession
    path, name = fresh_path(spark, label), f"{label}_{uuid.uuid4().hex}"
    writer = rows.write.partitionBy("kind") if "kind" in rows.columns else rows.write
    writer.bucketBy(buckets, "block").sortBy("block").option("path", path).option(
        "compression", compression).option("parquet.enable.dictionary", "false").saveAsTable(name)
    drop_at_exit(spark, path)
    found = spark.table(name)
    spark.sql(f"drop table {name}")  # the files stay, and so does what reads them
    return found, path


def _own(spark: SparkSession, path: str, buckets: int) -> DataFrame:
    """(block, own, mask) of what blocks have sent, in buckets; other kinds have folders of their own."""
    name = f"own_{uuid.uuid4().hex}"
    spark.sql(f"create table {name} (block long, own binary, mask binary) using parquet clustered by (block) "
              f"sorted by (block) into {buckets} buckets location '{path}/kind=own'")
    found = spark.table(name)
    spark.sql(f"drop table {name}")
    return found


def _numbered(blocks: DataFrame) -> DataFrame:
    """(range, block, held_out, at, c): what the words of each range are to each block.

    ``at`` has the rows of a block's words in their range, -1 for those that training lacks,
    -2 for those that no other block has, ``c`` their counts in training.  A row without block has the hashes and counts of a
    range's words.
    """

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, held, ranges, tail, counts in zip(*(c.to_pylist() for c in batch.columns)):
                n, tail = np.frombuffer(counts, np.int64), np.array(tail, object)
                for k, at in _by_range(ranges):
                    yield pa.RecordBatch.from_arrays([
                        pa.array([k], pa.int32()), pa.array([block], pa.int64()), pa.array([held]),
                        pa.array([tail[at].tolist()], pa.list_(pa.binary())), pa.array([n[at].tobytes()], pa.binary())],
                        ["range", "block", "held_out", "tail", "n"])

    def number(rows: pa.Table) -> pa.Table:
        flat = pa.chunked_array([c.flatten() for c in rows["tail"].chunks], pa.binary()).combine_chunks()
        code = flat.dictionary_encode()
        tokens, sizes = code.dictionary.to_pylist(), [len(x) for x in rows["tail"]]
        which = code.indices.to_numpy(zero_copy_only=False)
        n = np.concatenate([np.frombuffer(x, np.int64) for x in rows["n"].to_pylist()])
        taught = np.repeat(~rows["held_out"].to_numpy(zero_copy_only=False), sizes)
        c = np.bincount(which[taught], n[taught], len(tokens)).astype(np.int64)
        common = (c > 0) & (np.bincount(which, minlength=len(tokens)) > 1)  # a block has a word once
        place = np.where(common, np.cumsum(common) - 1, np.where(c > 0, -2, -1)).astype(np.int32)
        cuts, blocks = np.cumsum(sizes)[:-1], rows["block"].to_pylist()
        own = hashed([t for t, x in zip(tokens, c.tolist()) if x])
        return pa.table({
            "range": pa.array([rows["range"][0].as_py()] * (len(blocks) + 1), pa.int32()),
            "block": pa.array([*blocks, None], pa.int64()),
            "held_out": pa.array([*rows["held_out"].to_pylist(), None], pa.bool_()),
            "at": pa.array([*(x.tobytes() for x in np.split(place[which], cuts)), own.tobytes()], pa.binary()),
            "c": pa.array([*(x.tobytes() for x in np.split(c[which], cuts)), c[c > 0].tobytes()], pa.binary())})

    return park(blocks.select("block", "held_out", "ranges", "tail", "counts").mapInArrow(
        dealt, "range int, block long, held_out boolean, tail array<binary>, n binary").groupBy("range").applyInArrow(
            number, "range int, block long, held_out boolean, at binary, c binary"), "numbered")


def _by_range(ranges: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """Each range of a block's further words, and which of these words are in it, in order."""
    of = np.frombuffer(ranges, np.int32)
    order = np.argsort(of, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(of[order])) + 1) if len(of) else ():
        yield int(of[at[0]]), at


def _begun(training: Training, numbered: DataFrame, whole: float, states: int) -> tuple[DataFrame, str]:
    """(block, own, mask) before the first round: shares with noise of each block's further words, and which are its own."""

    def begin(rows: pa.Table, asked: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return out.empty_table()
        row = rows.to_pylist()[0]
        c, at, which = *_joined(row["ranges"], asked.to_pylist()), hashed(row["tail"])
        own = (c[:, None] + 0.5) / whole * noise(which, states)
        mask = (at == -2).astype(np.int8)
        return pa.Table.from_pylist([{"block": row["block"], "own": own.tobytes(), "mask": mask.tobytes()}], out)

    out = pa.schema([("block", pa.int64()), ("own", pa.binary()), ("mask", pa.binary())])
    asked = numbered.where("block is not null and not held_out").select("block", "range", "at", "c")
    blocks = training.blocks.select("block", "ranges", "tail")
    return _bucketed(blocks.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(
        begin, "block long, own binary, mask binary"), training.buckets, "emissions", "uncompressed")


def _joined(ranges: bytes, answers: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Counts in training and places of a block's further words, in order."""
    n = len(ranges) // 4
    c, at, which = np.zeros(n, np.int64), np.full(n, -1, np.int32), dict(_by_range(ranges))
    for x in answers:
        c[which[x["range"]]], at[which[x["range"]]] = np.frombuffer(x["c"], np.int64), np.frombuffer(x["at"], np.int32)
    return c, at


def _answers(numbered: DataFrame, tail: Tail | None, scored: bool) -> DataFrame:
    """(block, range, at, c, sums): expected emissions of the words that each block shares with others.

    To be scored, all blocks have answers, with places and counts too, else those of training.
    """
    asked = numbered.where("block is not null" if scored else "block is not null and not held_out").select(
        "range", "block", "at", F.col("c") if scored else F.lit(None).cast("binary").alias("c"))
    if tail is None:
        return asked.withColumn("sums", F.lit(None).cast("binary"))
    states = len(tail.sums)

    def answer(held: pa.Table, asked: pa.Table) -> pa.Table:
        at = [np.frombuffer(x, np.int32) for x in asked["at"].to_pylist()]
        at = [x[x >= 0] for x in at]
        of = dict(zip(asked["block"].to_pylist(), at))
        sums = np.zeros((max((int(x.max(initial=-1)) for x in at), default=-1) + 1, states))
        for block, rows in zip(held["block"].to_pylist(), held["far"]):
            sums[of[block]] += np.frombuffer(rows.as_buffer()).reshape(-1, states)  # a block has a word once
        found = pa.array([sums[x].tobytes() for x in at], pa.binary())
        if not scored:
            asked = asked.set_column(asked.schema.get_field_index("at"), "at", pa.nulls(len(at), pa.binary()))
        return asked.append_column("sums", found).select(["block", "range", "at", "c", "sums"])

    held = tail.rows.select("range", "block", "far")
    return held.groupBy("range").cogroup(asked.groupBy("range")).applyInArrow(
        answer, "block long, range int, at binary, c binary, sums binary")


@dataclass
class Block:
    """Texts of a block in the symbols of a model of its own words, the last of which is the end."""

    model: Model
    texts: list[np.ndarray]
    places: np.ndarray      # of the words in the model that workers hold
    c: np.ndarray           # counts in training of the words that workers do not hold, else 0

    @classmethod
    def of(cls, row: dict, answers: list[dict], model: Model, chances) -> Block:
        """``chances`` are those of a tail, none without."""
        states, symbols = len(model.start), len(model.emit) - 2
        places = np.frombuffer(row["places"], np.int32)
        emit = model.emit[np.append(np.where(places < 0, symbols, np.minimum(places, symbols)), symbols + 1)]
        c, beyond = np.zeros(len(places), np.int64), np.flatnonzero(places < 0)
        c[beyond], at = _joined(row["ranges"], answers)
        if chances:
            which = dict(_by_range(row["ranges"]))
            for x in answers:
                here = which[x["range"]]
                emit[beyond[here[at[here] >= 0]]] = chances(np.frombuffer(x["sums"]).reshape(-1, states))
            if row["own"] is not None:
                emit[beyond[at == -2]] = chances(np.frombuffer(row["own"]).reshape(-1, states))
        words, end = np.frombuffer(row["words"], np.int32), len(places)
        cuts = np.cumsum(row["lengths"])
        texts = [np.append(t, end) for t in np.split(words, cuts[:-1])]
        return cls(Model(model.start, model.move, emit), texts, places, c)


SUMS = "range int, counts binary"
SENT = "block long, range int, at binary, near binary, far binary, kind string"


@dataclass
class Training:
    """The training blocks, and in how many buckets their table is."""

    blocks: DataFrame
    buckets: int


def _expected(training: Training, model: Model, numbered: DataFrame, tail: Tail | None = None) -> tuple[Expected, Tail | None]:
    """One round over all training blocks, which send the sums of the words that they share to the words' ranges.

    Ranges below zero are of the words that workers hold; the lowest has the moves, the
    starts, the likelihood and the sums of the others, which stay in a table.
    """
    spark = numbered.sparkSession
    size, states = model.emit.shape
    lowest = -2 - size // LOCAL_RANGE
    kinds = {"mask": "binary", "own": "binary", "answers": "array<struct<range:int,sums:binary>>"}
    none = {name: F.lit(None).cast(kind) for name, kind in kinds.items()}
    blocks = training.blocks.select("block", "words", "lengths", "places", "ranges")
    if tail:
        blocks = blocks.join(tail.own.hint("shuffle_hash"), "block")  # no sort of the blocks
        del none["own"], none["mask"]
    if tail and tail.even is not None:
        answers = _answers(numbered, tail, False).repartition(training.buckets, "block").groupBy("block").agg(
            F.collect_list(F.struct("range", "sums")).alias("answers"))
        blocks = blocks.join(answers.hint("shuffle_hash"), "block", "left")
        del none["answers"]
    even, total, prior = np.zeros(states), np.ones(states), 0.0  # before the first round, rows are shares with noise
    if tail:
        total = tail.total
        if tail.even is not None:
            even, prior = tail.even, 2.0 / tail.whole
    expect = native.Rounds(spark, model, even, total, prior, LOCAL_RANGE, lowest, SCALED)
    sent = blocks.select("block", F.inline(expect(
        "words", "lengths", "places", "ranges", *(none.get(x, F.col(x)) for x in kinds))))
    kind = F.when(F.col("own").isNotNull(), "own").when(F.col("far").isNotNull(), "far").otherwise("near")
    _, path = _bucketed(sent.withColumn("kind", kind), training.buckets, "emissions", "uncompressed")
    rows = spark.read.schema(SENT).parquet(path)
    expect.destroy()
    for before in [*tail.paths, tail.first] if tail else ():
        if before:
            _dropped(spark, before)

    def total_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, at, near in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                at = np.frombuffer(at.as_buffer(), np.int32)
                now, most = sums.get(k, np.zeros((0, states))), int(at.max()) + 1
                if most > len(now):
                    now = np.vstack([now, np.zeros((most - len(now), states))])
                now[at] += np.frombuffer(near.as_buffer()).reshape(-1, states)  # a block sends each word once
                sums[k] = now
        for k, x in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([k], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["range", "counts"])

    found, sums = Expected.zero(size, states), np.zeros(states)
    near = rows.where("kind = 'near'").select("range", "at", "near").repartition("range").mapInArrow(
        total_of, SUMS).toArrow()  # LOCAL_WORDS words
    for k, counts in zip(near["range"].to_pylist(), near["counts"]):
        x = np.frombuffer(counts.as_buffer()).reshape(-1, states)
        if k == lowest:
            found.move += x[:states]
            found.start += x[states]
            found.likelihood += float(x[states + 1].sum())
            sums += x[states + 2]
        else:
            found.emit[(-1 - k) * LOCAL_RANGE:][:len(x)] += x
    _dropped(spark, f"{path}/kind=near" if tail else path)
    if tail is None:
        return found, None
    return found, Tail(rows.where("kind = 'far'"), _own(spark, path, training.buckets), [path], sums, tail.count, tail.share, tail.whole)


def train(training: Training, numbered: DataFrame, tokens: list[bytes], counts: np.ndarray, states: int, rounds: int,
          further: tuple[int, int] | None = None) -> tuple[Model, Tail | None]:
    """Baum-Welch over all training documents, from the symbols' shares, until the likelihood settles.

    ``tokens`` and ``counts`` (smoothed) are the model's symbols, ``further`` how many
    numbered words are symbols too, and their occurrences.  At least START_ROUNDS and so
    many further rounds run.
    """
    whole, rest = float(counts.sum()), None
    if further is not None:
        count, c = further
        share = c + 0.5 * count
        whole += share

        def shares_with_noise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for hashes, c in zip(*(x.to_pylist() for x in batch.columns)):
                    x = (np.frombuffer(c, np.int64)[:, None] + 0.5) / whole * noise(np.frombuffer(hashes, np.uint64), states)
                    yield pa.RecordBatch.from_arrays([pa.array([x.sum(axis=0).tolist()], pa.list_(pa.float64()))], ["sums"])

        begin = numbered.where("block is null").select("at", "c").mapInArrow(shares_with_noise, "sums array<double>")
        sums = sum((np.array(r.sums) for r in begin.toLocalIterator()), np.zeros(states))
        own, first = _begun(training, numbered, whole, states)
        rest = Tail(None, own, [], sums, count, share / whole, whole, first=first)
    shares = counts / whole
    emit = shares[:, None] * noise(hashed(tokens), states)
    total = emit.sum(axis=0) + (rest.sums if rest else 0.0)
    if rest:
        rest.total = total
    stay = np.full((states, states), 0.3 / states) + 0.7 * np.eye(states)
    model, done, before = Model(np.full(states, 1 / states), stay, emit / total), 0, -np.inf
    while True:
        found, rest = _expected(training, model, numbered, rest)
        if not np.isfinite(found.likelihood):
            raise ArithmeticError(f"the log-likelihood of round {done + 1} is {found.likelihood}")
        if not found.start.sum():  # no training rows
            return model, rest
        model = found.model(shares, rest)
        done += 1
        if done >= START_ROUNDS + rounds and found.likelihood - before < SETTLED * abs(found.likelihood):
            return model, rest
        before = found.likelihood


def score_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_out: int = 1,
    states: int = STATES, symbols: int | None = None, local_words: int = LOCAL_WORDS, rounds: int = ROUNDS,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row.

    Tokens are the words and one end.  The model learns from rows outside the held-out
    fold (crc32 of the id as text), in rounds over all of them until the likelihood settles.  Its
    symbols are all their words, the end, and one for words never seen.  If ``symbols``
    is given, only so many of the commonest (of those that workers hold) are symbols, and
    all other words are one, of which each has its smoothed share.  ``score`` is the log10
    of the exact likelihood of the whole text.  ``base_score`` is the smoothed unigram's.

    Counts and emissions of all words stay distributed.  Workers hold those of at most
    local_words; the others lie in ranges, and in every round a block of texts gets and
    sends one row for each range, which holds only the block's words, each once however
    often it occurs there.  Null and empty texts have the end only.
    Repeated rows come back, and count, as often as they occur.  Without training rows every
    count is zero.
    """
    spark = docs.sparkSession
    rows = identified(docs, id_col, text_col).select(
        "doc_id", utf8(F.col("text")).alias("text"), (fold(F.col("doc_id"), folds) == held_out).alias("held_out"))
    with shuffles_removed(spark):
        counts = park(token_counts(rows.where("not held_out").select("doc_id", "text")), "token-counts")
    total = counts.agg(F.sum("c"), F.count("*"), F.sum(F.when(F.col("token") == END, F.col("c")))).first()
    n, v, ends = total[0] or 0, total[1], total[2] or 0
    words = commonest(counts, local_words)
    n_words = v - (1 if ends else 0)
    tail_symbols = symbols is None and len(words) < n_words
    symbols = len(words) if symbols is None else min(symbols, len(words))
    own = sum(c for _, c in words[:symbols])
    others, kinds = (0, 0) if tail_symbols else (n - ends - own, n_words - symbols)
    smoothed = np.array([c for _, c in words[:symbols]] + [others + 0.5, ends + 0.5]) + 0.5
    # the words that workers do not hold
    further = (n_words - len(words), n - ends - sum(c for _, c in words)) if tail_symbols else None
    ranges = max(1, -(-(n_words - len(words)) // RANGE))
    buckets = 1 + n // (BLOCK // 4)
    rows = rows.coalesce(max(1, -(-n // BLOCK)))  # fewer, larger blocks send less
    with shuffles_removed(spark):
        blocks = _blocks(rows, words, ranges, buckets)
        numbered = _numbered(blocks)
        model, rest = train(Training(blocks.where("not held_out"), buckets), numbered, [w for w, _ in words[:symbols]] + [b"", END],
                            smoothed, states, rounds, further)
    chances = rest.chances() if rest else None
    shared = spark.sparkContext.broadcast((model, np.array([c for _, c in words], np.int64)))

    def score(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return out.empty_table()
        model, local = shared.value
        row = rows.drop_columns(["words"]).to_pylist()[0] | {"words": rows["words"][0].as_buffer()}
        block = Block.of(row, answers.to_pylist(), model, chances)
        c = np.where(block.places < 0, block.c, np.append(local, 0)[block.places])
        known, logs = c > 0, np.log10(c + 0.5)
        other = (block.places < 0) | (block.places >= symbols)
        at, sizes = np.frombuffer(row["words"], np.int32), np.array(row["lengths"], np.int64)
        text = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)

        def sums(x: np.ndarray) -> np.ndarray:
            parts = [slice(i, i + (1 << 20)) for i in range(0, len(at), 1 << 20)]
            return sum((np.bincount(text[p], x[at[p]], len(sizes)) for p in parts), np.zeros(len(sizes)))

        base = sums(logs) + np.log10(ends + 0.5) - (sizes + 1) * np.log10(n + 0.5 * (v + 1))
        found = block.model.score(block.texts)
        if not tail_symbols:
            found += sums(np.where(other, logs, 0.0)) - sums(other) * np.log10(others + 0.5 * (kinds + 1))
        n_known = np.rint(sums(known)).astype(np.int64) + (1 if ends else 0)
        columns = [pa.array(row["doc_ids"], pa.int64()), pa.array([row["held_out"]] * len(sizes)), pa.array(sizes + 1),
                   pa.array(n_known), pa.array(np.full(len(sizes), n, np.int64)), pa.array(base), pa.array(found)]
        return pa.Table.from_arrays(columns, schema=out)

    out = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()),
                     ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()),
                     ("score", pa.float64())])
    blocks = blocks.select("block", "held_out", "doc_ids", "lengths", "words", "places", "ranges")
    if rest:
        blocks = blocks.join(rest.own.select("block", "own").hint("shuffle_hash"), "block", "left")
    return blocks.groupBy("block").cogroup(_answers(numbered, rest, True).groupBy("block")).applyInArrow(
        score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
               "base_score double, score double")
