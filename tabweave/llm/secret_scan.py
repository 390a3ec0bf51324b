"""Secrets by pattern, and random-looking tokens by a battery of tests."""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabweave.llm.common import as_bytes, by_slices, identified, park

# The patterns, their names in order, and their least lengths.
ASSIGN = re.compile(
    rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
KINDS = ("assign", "access", "hex", "random")
LEAST = {"assign": 12, "access": 18, "hex": 16}

DIGITS, UPPER, LOWER = b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
# Alphabets in the order of their values' classes; the first that holds a whole token is inferred.
ENCODINGS = {
    "hex": DIGITS + b"abcdef", "HEX": DIGITS + b"ABCDEF", "base32": UPPER + b"234567",
    "base36": DIGITS + LOWER, "BASE36": DIGITS + UPPER, "base62": DIGITS + UPPER + LOWER,
    "base64": UPPER + LOWER + DIGITS + b"+/", "base64url": UPPER + LOWER + DIGITS + b"-_",
}
MIN_TOKEN = 20      # least length of a token that the battery judges
RANDOM_LEVEL = 1e-3  # a token stays a candidate unless uniform randomness is rejected at this level
DISCOVERY_RATE = 0.01
BINS_PER_DECADE, MAX_BIN = 20, 1200
SLICE = 4 << 20     # bytes of text that a step holds at once

_ALPHABET = np.zeros((len(ENCODINGS), 256), bool)
_VALUE = np.zeros((len(ENCODINGS), 256), np.int64)
for _row, _letters in enumerate(ENCODINGS.values()):
    _ALPHABET[_row, list(_letters)] = True
    _VALUE[_row, list(_letters)] = np.arange(len(_letters))
_TOKEN = _ALPHABET.any(axis=0)  # '=' only pads: it ends a token
_PADDING = re.compile(b"=+(?![A-Za-z0-9+/_-])")
_PARTS = [re.compile(b"[A-Za-z0-9%s]{%d,}" % (signs, MIN_TOKEN)) for signs in (b"+/", b"_-")]
_HEX = _ALPHABET[0]


def runs(mask: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of at least so many."""
    padded = np.zeros(len(mask) + 2, np.int8)
    padded[1:-1] = mask
    edges = np.flatnonzero(padded[1:] != padded[:-1])
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= least
    return starts[long], ends[long]


def pattern_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(start, end, kind) in bytes of assign and access; hex comes from runs."""
    found = []
    lowered = text.lower()
    if any(word in lowered for word in KEYWORDS):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text)
                  if len(m[2]) >= LEAST["assign"]]
    if b"AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)
                  if m.end() - m.start() >= LEAST["access"]]
    return found


@dataclass
class TextModel:
    """What an encoding's symbols look like in ordinary text, from counts over all documents.

    ``share`` are the frequencies of the alphabet's symbols, ``changes`` the share of
    neighbours of which one is in the lower and one in the upper half of the alphabet.
    """

    share: np.ndarray
    changes: float


def text_models(pairs: np.ndarray) -> list[TextModel]:
    """A model for each encoding from the (256, 256) counts of neighbouring bytes."""
    models = []
    for letters in ENCODINGS.values():
        inside = pairs[np.ix_(list(letters), list(letters))].astype(float)
        count = pairs[list(letters)].sum(axis=1).astype(float) + 1.0
        half = len(letters) // 2
        crossing = inside[:half, half:].sum() + inside[half:, :half].sum()
        models.append(TextModel(count / count.sum(), (crossing + 1) / (inside.sum() + 2)))
    return models


def _upper(z: float) -> float:
    return max(0.5 * math.erfc(z / math.sqrt(2)), 1e-300)


def _two_sided(z: float) -> float:
    return max(math.erfc(abs(z) / math.sqrt(2)), 1e-300)


def fisher(values: list[float]) -> float:
    """The combined p-value of independent tests."""
    half, term, total = -sum(map(math.log, values)), 1.0, 1.0
    for j in range(1, len(values)):
        term *= half / j
        total += term
    return min(1.0, max(math.exp(-half) * total, 1e-300))


@dataclass
class Battery:
    """p-values of one token; ``random`` if it is uniform, ``text`` if it is like text."""

    uniformity: float
    runs: float
    serial: float
    random: float
    text: float


def battery(values: np.ndarray, size: int, model: TextModel) -> Battery:
    """Test the symbols of a token, as numbers below the alphabet's size.

    Against uniform randomness, two-sided each: chi-squared of the alphabet's counts
    (by the multinomial's own mean and variance), the number of runs of the lower and
    the upper half, and the correlation of neighbours; combined by Fisher's method.
    Against ordinary text, one-sided: chi-squared as low, and changes between the
    halves as many, as seen; combined likewise.  Longer tokens give stronger evidence.
    """
    n, counts = len(values), np.bincount(values, minlength=size)
    chi = float((counts.astype(float) ** 2).sum()) * size / n - n
    uniformity = _two_sided((chi - (size - 1)) / math.sqrt(2 * (size - 1) * (n - 1) / n))

    high = values >= size // 2
    upper, changed = int(high.sum()), int((high[1:] != high[:-1]).sum())
    product = 2 * upper * (n - upper)
    if product:
        mean = product / n + 1
        spread = math.sqrt(max(product * (product - n) / (n * n * (n - 1)), 1e-9))
        run = _two_sided((changed + 1 - mean) / spread)
    else:
        run = max(2.0 ** (1 - n), 1e-300)

    centred = values - values.mean()
    power = float((centred * centred).sum())
    if power:
        correlation = float((centred[1:] * centred[:-1]).sum()) / power
        serial = _two_sided((correlation + 1 / n) * math.sqrt(n))
    else:
        serial = 1e-300

    q = model.share
    mean = size * float((q * (1 - q)).sum()) + n * size * float(((q - 1 / size) ** 2).sum())
    cubes, squares = float((q ** 3).sum()), float((q * q).sum())
    variance = 4 * n * size * size * (cubes - squares * squares) + 2 * size * size * squares
    like_text = _upper((mean - chi) / math.sqrt(max(variance, 1e-9)))
    c = min(max(model.changes, 1e-6), 1 - 1e-6)
    many = _upper((changed - 0.5 - (n - 1) * c) / math.sqrt((n - 1) * c * (1 - c)))
    return Battery(uniformity, run, serial, fisher([uniformity, run, serial]), fisher([like_text, many]))


def tokens_of(run: bytes) -> list[tuple[int, int]]:
    """(start, end) of the tokens of a run of token letters.

    A run that one alphabet holds is one token.  Others mix '+' or '/' with '-' or '_';
    their tokens are the maximal parts that base64 or base64url holds, which may overlap.
    """
    symbols = np.frombuffer(run, np.uint8)
    if _ALPHABET[:, symbols].all(axis=1).any():
        return [(0, len(run))]
    return sorted({m.span() for part in _PARTS for m in part.finditer(run)})


def judge(token: bytes, models: list[TextModel]) -> tuple[int, float] | None:
    """(length band, p-value of being text) of a token, or None if it is not tested.

    The p-value of a token that does not pass for random is 1: it counts as tested.

    Padding at the end does not count.  The encoding is the first alphabet that holds
    every symbol; a token that mixes them has none.
    """
    symbols = np.frombuffer(token.rstrip(b"="), np.uint8)
    if len(symbols) < MIN_TOKEN:
        return None
    holds = np.flatnonzero(_ALPHABET[:, symbols].all(axis=1))
    if not len(holds):
        return None
    at = int(holds[0])
    result = battery(_VALUE[at, symbols], int(_ALPHABET[at].sum()), models[at])
    return len(symbols).bit_length(), 1.0 if result.random < RANDOM_LEVEL else result.text


def neighbour_counts(texts: DataFrame) -> np.ndarray:
    """(256, 256) counts of neighbouring bytes over all texts; at most 65536 rows are collected."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        flat = np.frombuffer(b"\n".join(batch.column(1).to_pylist()), np.uint8)  # in no alphabet
        pairs = flat[:-1].astype(np.int32) * 256 + flat[1:]
        counts = np.bincount(pairs, minlength=65536)
        seen = np.flatnonzero(counts)
        return pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(counts[seen])], ["pair", "n"])

    out = np.zeros(65536, np.int64)
    for row in texts.mapInArrow(by_slices(step, SLICE), "pair int, n long").groupBy("pair").agg(
            F.sum("n").alias("n")).collect():
        out[row.pair] = row.n
    return out.reshape(256, 256)


class Cover:
    """Tells whether one of some spans (start, kind, end) holds a stretch, by one binary search."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        ordered = sorted(spans)
        self.starts = [s for s, _, _ in ordered]
        self.reach = list(accumulate((e for _, _, e in ordered), max))  # the farthest end so far

    def holds(self, start: int, end: int) -> bool:
        before = bisect_right(self.starts, start)
        return before > 0 and end <= self.reach[before - 1]


FOUND = ("doc_id long, spans array<struct<start:bigint,kind:int,end:bigint>>, "
         "tokens array<struct<start:bigint,end:bigint,band:int,bin:int>>")


def _scan(texts: DataFrame, models: list[TextModel]) -> DataFrame:
    """Pattern spans and judged tokens of each whole text, in code points."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = batch.column(1).to_pylist()
        joined = b"\n".join(rows)  # no run crosses a new line
        flat = np.frombuffer(joined, np.uint8)
        begin = np.cumsum([0, *[len(r) + 1 for r in rows]])
        spans: list[list] = [[(a, k, b) for a, b, k in pattern_spans(r)] for r in rows]
        for a, b in zip(*runs(_HEX[flat], LEAST["hex"])):
            doc = int(np.searchsorted(begin, a, "right")) - 1
            spans[doc].append((int(a - begin[doc]), 2, int(b - begin[doc])))
        covers = list(map(Cover, spans))
        tokens: list[list] = [[] for _ in rows]
        for a, b in zip(*runs(_TOKEN[flat], MIN_TOKEN)):
            doc = int(np.searchsorted(begin, a, "right")) - 1
            a, b = int(a - begin[doc]), int(b - begin[doc])
            padded = _PADDING.match(rows[doc], b)
            for c, d in tokens_of(rows[doc][a:b]):
                c, d = a + c, a + d
                if covers[doc].holds(c, d):
                    continue
                judged = judge(rows[doc][c:d], models)
                if judged:
                    score = min(MAX_BIN, int(-math.log10(judged[1]) * BINS_PER_DECADE))
                    tokens[doc].append((c, padded.end() if d == b and padded else d, judged[0], score))
        for row, found, seen in zip(rows, spans, tokens):
            if (found or seen) and not row.isascii():
                points = np.cumsum(np.frombuffer(row, np.uint8) & 0xC0 != 0x80)
                place = np.concatenate([[0], points]).tolist()
                found[:] = [(place[a], k, place[b]) for a, k, b in found]
                seen[:] = [(place[a], place[b], band, score) for a, b, band, score in seen]
            found.sort()
        span = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
        token = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("band", pa.int32()), ("bin", pa.int32())]))
        named = [[{"start": a, "kind": k, "end": b} for a, k, b in s] for s in spans]
        judged_rows = [[{"start": a, "end": b, "band": n, "bin": s} for a, b, n, s in t] for t in tokens]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(named, span), pa.array(judged_rows, token)], ["doc_id", "spans", "tokens"])

    return texts.mapInArrow(by_slices(step, SLICE), FOUND)


def thresholds(counts: dict[tuple[int, int], int], rate: float) -> dict[int, int]:
    """By length band, the least bin that is a discovery (Benjamini and Hochberg).

    ``counts`` are numbers of tokens by band and bin.  A bin stands for its largest
    p-value, so the rate holds within each band.  Bands without a discovery are missing.
    """
    found: dict[int, int] = {}
    for band in {b for b, _ in counts}:
        bins = sorted(((b, n) for (k, b), n in counts.items() if k == band), reverse=True)
        total, above = sum(n for _, n in bins), 0
        for each, n in bins:
            above += n
            if 10.0 ** (-each / BINS_PER_DECADE) <= rate * above / total:
                found[band] = each
    return found


def find_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = DISCOVERY_RATE,
) -> DataFrame:
    """doc_id and spans (start, kind, end; in code points, in order) for every row.

    Kinds number KINDS.  Patterns give assign, access and hex.  The battery adds
    ``random``: maximal runs of one encoding's letters, with padding at the end, not
    inside a pattern's span, for which uniform randomness is not rejected and which
    ordinary text does not explain.  What
    ordinary text looks like is counted over all documents; the share of false
    discoveries is controlled over all tokens of a length band.  Null and empty texts
    have no spans; repeated rows come back as often as they occur.
    """
    texts = as_bytes(identified(docs, id_col, text_col))
    scanned = park(_scan(texts, text_models(neighbour_counts(texts))), "secret-scan")
    counts = {
        (r.band, r.bin): r["count"] for r in  # at most 64 bands of MAX_BIN bins
        scanned.select(F.explode("tokens").alias("t")).groupBy("t.band", "t.bin").count().collect()}
    least = thresholds(counts, rate)

    def discovered(token: Column) -> Column:
        bound = F.coalesce(*[F.when(token["band"] == band, F.lit(at)) for band, at in least.items()],
                           F.lit(MAX_BIN + 1))
        return token["bin"] >= bound

    added = F.transform(F.filter("tokens", discovered), lambda t: F.struct(
        t["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), t["end"].alias("end")))
    return scanned.select("doc_id", F.array_sort(F.concat("spans", added)).alias("spans"))


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
