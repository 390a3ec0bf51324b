"""Alignment of two tokenizers' ids over the same texts, window by window."""

from __future__ import annotations

import hashlib
import json
import re
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabweave.llm.common import by_slices, identified, park, utf8

MARK = "▁"              # fixed value: the mark that stands for a space in pieces
# Fixed value: how the byte-level vocabulary splits a text before it merges.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
STOP = -1               # stands between the two id tuples of a window's key
MAX_WINDOWS = 300_000   # windows that a worker remembers, before it forgets all
MAX_BYTES = 32 << 20    # of their keys and alignments, likewise
LOCAL_PAIRS = 500_000   # the commonest id pairs whose counts every worker holds
SLICE = 1 << 20         # bytes of text that a step holds at once
_LONG_SPACE = re.compile(r"\s{1000}")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


class ByteTokens:
    """A byte-level vocabulary of the tokenizers library: ids of " " + text, and each id's bytes.

    Where the vocabulary is plain (ids in the order of merges, one known split, nothing
    else on the way), the same merges run in tiktoken, which is four times faster.  Texts
    with a long run of white space, which its split cannot read, go to the library.
    """

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as file:
            form = json.load(file)
        letters, vocab = byte_letters(), form["model"]["vocab"]
        special = {t["content"]: t["id"] for t in form.get("added_tokens", [])}
        size = max([*vocab.values(), *special.values()]) + 1
        self.bytes = [b""] * size
        for token, i in vocab.items():
            if token not in special:
                self.bytes[i] = bytes(letters[c] for c in token)
        for token, i in special.items():
            self.bytes[i] = token.encode()
        split = form.get("pre_tokenizer") or {}
        merges = [m.split(" ") if isinstance(m, str) else m for m in form["model"]["merges"]]
        made = [vocab.get(a + b, -1) for a, b in merges]
        plain = (form["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex", True)
                 and not split.get("add_prefix_space") and made == sorted(made) and -1 not in made)
        ranks = {self.bytes[i]: i for t, i in vocab.items() if t not in special}
        self.fast = tiktoken.Encoding("plain", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}) if plain else None

    @cached_property
    def library(self) -> Tokenizer:
        library = Tokenizer.from_file(self.path)
        library.encode_special_tokens = True
        return library

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.fast.encode_ordinary(" " + t) if self.fast and not _LONG_SPACE.search(t)
                else self.library.encode(" " + t, add_special_tokens=False).ids for t in texts]


class PieceTokens:
    """A SentencePiece model: ids of a text, and each id's bytes; the model puts the space in front."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(MARK, " ").encode()
                      for i, p in enumerate(pieces)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def _table(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The length of each token, and whether it begins with a space."""
    return np.array([len(t) for t in tokens], np.int64), np.array([t[:1] == b" " for t in tokens])


def _ends(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes[tokens])


def _shared(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where two rising sequences hold the same numbers."""
    at = np.searchsorted(b, a)
    both = np.flatnonzero(np.append(b, -1)[at] == a)
    return both, at[both]


class _Numbers(dict):
    """Numbers keys as they come and lists the new ones."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list = []

    def __missing__(self, key) -> int:
        self[key] = n = len(self)
        self.fresh.append(key)
        return n


class Aligner:
    """Aligns texts by both tokenizers; remembers windows by their id tuples.

    A window reaches from one anchor to the next: a place before tokens marked with a space
    in both sequences, which is an end of tokens in both.  What happens inside depends on
    the window's ids alone, so it is worked out once.
    """

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteTokens(a_path), PieceTokens(b_path)
        self.a_size, self.a_marked = _table(self.a.bytes)
        self.b_size, self.b_marked = _table(self.b.bytes)
        self.forget()

    def forget(self) -> None:
        self.windows, self.pairs, self.bytes = _Numbers(), _Numbers(), 0
        self.texts: list[str] = []
        self.counts, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def tokens(self, texts: list[bytes]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both; none for an empty text or one whose tokens spell another text."""
        words = [t.decode("utf-8", "replace") for t in texts]
        a, b = self.a.encode(words), self.b.encode(words)
        for i, text in enumerate(texts):
            whole = b" " + text
            if not text or any(b"".join(map(side.bytes.__getitem__, ids)) != whole
                               for side, ids in ((self.a, a[i]), (self.b, b[i]))):
                a[i], b[i] = [], []
        return a, b

    def align(self, texts: list[bytes]):
        """(ids of each by A, by B, window numbers end to end, windows of each text)."""
        if len(self.windows) > MAX_WINDOWS or self.bytes > MAX_BYTES:
            self.forget()
        a_ids, b_ids = self.tokens(texts)
        sizes = [np.fromiter(map(len, ids), np.int64, len(ids)) for ids in (a_ids, b_ids)]
        a, b = (np.concatenate([np.zeros(0, np.int32), *(np.array(x, np.int32) for x in ids)]) for ids in (a_ids, b_ids))
        # Both spell the same bytes, so places count on through all texts alike.
        a_start = _ends(a, self.a_size) - self.a_size[a]
        b_start = _ends(b, self.b_size) - self.b_size[b]
        a_at, b_at = np.flatnonzero(self.a_marked[a]), np.flatnonzero(self.b_marked[b])
        i, _ = _shared(a_start[a_at], b_start[b_at])  # places where tokens of both have ended
        cut = np.zeros(len(a), bool)
        cut[a_at[i]] = True
        cut[(np.cumsum(sizes[0]) - sizes[0])[sizes[0] > 0]] = True
        a_cut = np.append(np.flatnonzero(cut), len(a))
        b_cut = np.append(np.searchsorted(b_start, a_start[a_cut[:-1]]), len(b))
        owner = np.repeat(np.arange(len(texts)), sizes[0])[a_cut[:-1]]
        numbers = self._number(a, b, a_cut, b_cut)
        return sizes, numbers, np.bincount(owner, minlength=len(texts))

    def _number(self, a: np.ndarray, b: np.ndarray, a_cut: np.ndarray, b_cut: np.ndarray) -> np.ndarray:
        """The number of each window; new ones are worked out."""
        a_n, b_n = np.diff(a_cut), np.diff(b_cut)
        ends = np.cumsum(a_n + b_n + 1)
        keys = np.full(int(ends[-1]) if len(ends) else 0, STOP, np.int32)
        begin = ends - (a_n + b_n + 1)
        keys[np.arange(len(a)) + np.repeat(begin - a_cut[:-1], a_n)] = a
        keys[np.arange(len(b)) + np.repeat(begin + a_n + 1 - b_cut[:-1], b_n)] = b
        buffer = keys.tobytes()
        cuts = np.append(begin, len(keys)) * 4
        number = self.windows.__getitem__
        cuts = cuts.tolist()
        found = np.array([number(buffer[p:q]) for p, q in zip(cuts, cuts[1:])], np.int64)
        if self.windows.fresh:
            self._work_out(self.windows.fresh)
            self.windows.fresh = []
        return found

    def _work_out(self, keys: list[bytes]) -> None:
        """Groups and links of new windows: where tokens of both end, a group ends with a link."""
        ids = np.frombuffer(b"".join(keys), np.int32)
        key_ends = np.cumsum(np.fromiter(map(len, keys), np.int64, len(keys))) // 4
        stops = np.flatnonzero(ids == STOP)
        begins = np.concatenate([[0], key_ends[:-1]])
        side = np.zeros(len(ids) + 1, np.int64)  # 1 in the ids of A, 0 elsewhere
        side[begins] += 1
        side[stops] -= 1
        of_a = np.cumsum(side[:-1]) > 0
        a, b = ids[of_a], ids[~of_a & (ids != STOP)]
        i, j = _shared(_ends(a, self.a_size), _ends(b, self.b_size))
        ends = np.cumsum(stops - begins)  # in A, of each window; its last tokens end a group
        counts = np.diff(np.searchsorted(i, ends - 1, "right"), prepend=0)
        one, two = list(map(str, a.tolist())), list(map(str, b.tolist()))
        groups, p, q = [], 0, 0
        for x, y in zip((i + 1).tolist(), (j + 1).tolist()):
            groups.append(f"{one[p]}|{two[q]}" if x == p + 1 and y == q + 1
                          else f"{','.join(one[p:x])}|{','.join(two[q:y])}")
            p, q = x, y
        at = 0
        for n in counts.tolist():
            self.texts.append(";".join(groups[at:at + n]))
            at += n
        links = ((a[i].astype(np.int64) << 32) | b[j]).tolist()
        self.bytes += 4 * len(ids) + sum(map(len, groups))
        self.counts = np.concatenate([self.counts, counts])
        self.flat = np.concatenate([self.flat, np.fromiter(map(self.pairs.__getitem__, links), np.int64, len(links))])

    def rows(self, texts: list[bytes]) -> dict[str, object]:
        """n_a, n_b, n_groups, groups (text), and the distinct pairs of each text with their numbers."""
        (n_a, n_b), numbers, windows = self.align(texts)
        bounds = np.concatenate([[0], np.cumsum(windows)])
        own = numbers.tolist()
        groups = [";".join(map(self.texts.__getitem__, own[p:q])) for p, q in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        count = self.counts[numbers]
        starts = (np.cumsum(self.counts) - self.counts)[numbers]
        ends = np.cumsum(count)
        links = self.flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - count), count)]
        doc = np.repeat(np.repeat(np.arange(len(texts)), windows), count)
        self.pairs.fresh = []
        each, times = np.unique(doc * (len(self.pairs) + 1) + links, return_counts=True)
        code = np.fromiter(self.pairs, np.int64, len(self.pairs))
        doc, pair = np.divmod(each, len(self.pairs) + 1)
        return {"n_a": n_a, "n_b": n_b, "n_groups": np.bincount(
            np.repeat(np.arange(len(texts)), windows), count, len(texts)).astype(np.int64), "groups": groups,
            "pairs": code[pair], "times": times, "distinct": np.bincount(doc, minlength=len(texts))}


@lru_cache(maxsize=1)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


ROWS = ("row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, "
        "pairs array<long>, times array<long>")


def aligned(docs: DataFrame, a_path: str, b_path: str, groups: bool) -> DataFrame:
    """Each (row, text, doc_id) tokenised and aligned, with its distinct id pairs."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = aligner(a_path, b_path).rows(batch.column(1).to_pylist())
        ends = np.concatenate([[0], np.cumsum(found["distinct"])]).astype(np.int32)
        hashes = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in found["groups"]]
        columns = [batch.column(0), batch.column(2), pa.array(found["n_a"]), pa.array(found["n_b"]),
                   pa.array(found["n_groups"]), pa.array(hashes, pa.string()),
                   *[pa.ListArray.from_arrays(pa.array(ends), pa.array(found[x], pa.int64())) for x in ("pairs", "times")]]
        names = [c.split()[0] for c in ROWS.split(", ")]
        if groups:
            columns, names = [*columns, pa.array(found["groups"], pa.string())], [*names, "groups"]
        return pa.RecordBatch.from_arrays(columns, names)

    return docs.select("row", "text", "doc_id").mapInArrow(
        by_slices(step, SLICE), ROWS + (", groups string" if groups else ""))


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, c, best) of every id pair: its links in all texts, and if no pair of its B id has more."""
    counts = park(rows.select(F.explode(F.arrays_zip("pairs", "times")).alias("p")).groupBy(
        F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("c")), "pair-counts")
    own = F.col("pair").bitwiseAND((1 << 32) - 1)
    most = counts.groupBy(own.alias("b")).agg(F.max("c").alias("most"))  # a row for each B id, so broadcast
    return counts.join(F.broadcast(most), own == F.col("b")).select(
        "pair", "c", (F.col("c") == F.col("most")).alias("best"))


def least_local(counts: DataFrame, limit: int) -> int:
    """The least count such that at most ``limit`` pairs have so many, by a histogram."""
    step = F.floor(F.log2("c") * 16)  # 16 rows a doubling
    total, least = 0, None
    for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.min("c").alias("c")).orderBy(
            F.desc("step")).collect():
        total += r.n
        if total > limit:
            break
        least = r.c
    return 2**62 if least is None else least


def align_documents(
    docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text",
    groups: bool = False, local_pairs: int = LOCAL_PAIRS,
) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 for every row.

    A is a byte-level vocabulary over " " + text, B a SentencePiece model that puts the
    space in front; both encode every whole text, special tokens as plain text.  Places
    where tokens of both end cut the ids into groups (a1,a2|b1;a3|b2; ``groups=True``
    adds this text).  The last tokens of a group end together: they are its link.  n_best
    is how many links are of the pair that their B id has most often in the corpus (ties
    included), count_sum the sum of the links' pair counts in the corpus.

    Anchors, verified places before space-marked tokens, split a text into windows, whose
    alignments workers remember by both id tuples.  Texts are tokenised once; a row then
    holds its distinct pairs.  Pairs are summed in the tasks before they meet.  Workers
    hold the counts of the commonest ``local_pairs``; pairs with fewer links than these
    meet the rows in a join, in which none is common.

    Null and empty texts, and texts whose tokens of A or B spell other bytes (B reads its
    own mark as a space), have zeros and an empty groups_sha256.  Repeated rows come back,
    and count, each.  Rows of one id need not be one document.
    """
    spark = docs.sparkSession
    rows = identified(docs, id_col, text_col).select("doc_id", utf8(F.col("text")).alias("text")).withColumn(
        "row", F.monotonically_increasing_id())
    rows = park(aligned(rows, a_path, b_path, groups), "aligned")
    counts = park(pair_counts(rows), "pairs")
    least = least_local(counts, local_pairs)
    held = counts.where(F.col("c") >= least).orderBy("pair").toArrow()  # at most local_pairs
    shared = spark.sparkContext.broadcast(
        tuple(np.append(held[n].to_numpy(), 0) for n in ("pair", "c", "best")))

    @F.arrow_udf("struct<n_best:long,count_sum:long,rest:array<long>,rest_times:array<long>>")
    def looked_up(pairs: pa.Array, times: pa.Array) -> pa.Array:
        known, c, best = shared.value
        sizes = pairs.value_lengths().to_numpy(zero_copy_only=False)
        pair, n = (x.flatten().to_numpy(zero_copy_only=False) for x in (pairs, times))
        owner = np.repeat(np.arange(len(sizes)), sizes)
        at = np.minimum(np.searchsorted(known[:-1], pair), len(known) - 1)
        here = (known[at] == pair) & (at < len(known) - 1)
        sums = np.zeros((2, len(sizes)), np.int64)
        np.add.at(sums[0], owner[here], (n * best[at])[here].astype(np.int64))
        np.add.at(sums[1], owner[here], (n * c[at])[here])
        ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner[~here], minlength=len(sizes)))]).astype(np.int32))
        return pa.StructArray.from_arrays(
            [pa.array(sums[0]), pa.array(sums[1]), pa.ListArray.from_arrays(ends, pa.array(pair[~here])),
             pa.ListArray.from_arrays(ends, pa.array(n[~here]))], ["n_best", "count_sum", "rest", "rest_times"])

    found = rows.withColumn("found", looked_up("pairs", "times"))
    n_best, count_sum = F.col("found.n_best"), F.col("found.count_sum")
    if not counts.where(F.col("c") < least).isEmpty():
        tail = found.select("row", F.explode(F.arrays_zip("found.rest", "found.rest_times")).alias("r")).select(
            "row", F.col("r.rest").alias("pair"), F.col("r.rest_times").alias("n"))
        more = tail.join(counts.where(F.col("c") < least), "pair").groupBy("row").agg(
            F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("more_best"),
            F.sum(F.col("n") * F.col("c")).alias("more_sum"))
        found = found.join(more, "row", "left")
        n_best = n_best + F.coalesce("more_best", F.lit(0))
        count_sum = count_sum + F.coalesce("more_sum", F.lit(0))
    return found.select(
        "doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"),
        n_best.cast("long").alias("n_best"), count_sum.cast("long").alias("count_sum"), "groups_sha256",
        *(["groups"] if groups else []))
