"""Language identification with a bidirectional recurrent network over bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabweave.llm.common import binary_column, fold, utf8
from tabweave.llm.recurrent import Adam, BiGru, scatter_rows

STEPS = 64              # bytes that the network reads at a time
HIDDEN = 10             # units a direction
PAD = 256               # the symbol behind the end of a text
BLOCK = 2048            # segments that a step of inference holds at once
SAMPLE_TEXTS = 300      # training texts of each language, at most
SAMPLE_CHARS = 2000     # letters of each, from a place that its hash chooses
MAX_LANGUAGES = 256     # the commonest are learned
UNKNOWN = "und"         # fixed value
# Bytes of letters, nearly: ASCII letters and all of non-ASCII.
_LETTER = np.array([chr(b).isalpha() if b < 128 else True for b in range(256)] + [False])


class ByteNet:
    """Labels every byte; a text's probabilities are the mean over its letters."""

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.labels, self.layer = labels, BiGru(hidden, rng)
        self.params = self.layer.params | {
            "table": rng.normal(0, 0.3, (2 * 257, 3 * hidden)).astype(np.float32),
            "out": rng.normal(0, 0.3, (2 * hidden, len(labels))).astype(np.float32),
            "out_bias": np.zeros(len(labels), np.float32),
        }

    def _symbols(self, segments: np.ndarray) -> np.ndarray:
        """(steps, 2, batch): rows of the table, the second direction from the end."""
        symbols = np.empty((segments.shape[1], 2, len(segments)), np.int64)
        symbols[:, 0] = segments.T
        symbols[:, 1] = segments.T[::-1] + 257
        return symbols

    def _probabilities(self, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        both = np.concatenate([states[:, 0], states[::-1, 1]], axis=-1)
        logits = both @ self.params["out"] + self.params["out_bias"]
        logits -= logits.max(axis=-1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=-1, keepdims=True)
        return logits, both

    def predict(self, segments: np.ndarray) -> np.ndarray:
        """(steps, batch, labels): probabilities at every byte."""
        symbols, table = self._symbols(segments), self.params["table"]
        states = np.empty((*symbols.shape, self.layer.hidden), np.float32)
        h = np.zeros(states.shape[1:], np.float32)
        for t, at in enumerate(symbols):
            h = self.layer.step(table[at], h)[0]
            states[t] = h
        return self._probabilities(states)[0]

    def train(self, segments: np.ndarray, labels: np.ndarray, epochs: int, batch: int = 128) -> None:
        """Cross-entropy at every letter, by backpropagation through time."""
        rng, updates = np.random.default_rng(2), epochs * -(-len(segments) // batch)
        adam = Adam(self.params, 0.02, updates)
        n, width = self.layer.hidden, len(self.labels)
        for _ in range(epochs):
            order = rng.permutation(len(segments))
            for start in range(0, len(order), batch):
                part = order[start:start + batch]
                symbols = self._symbols(segments[part])
                states, kept = self.layer.forward(self.params["table"][symbols], keep=True)
                error, both = self._probabilities(states)
                weight = _LETTER[segments[part].T].astype(np.float32)
                weight /= max(weight.sum(), 1.0)
                error[:, np.arange(len(part)), labels[part]] -= 1
                error *= weight[..., None]
                flat = error.reshape(-1, width)
                grads = {"out": both.reshape(-1, 2 * n).T @ flat, "out_bias": flat.sum(axis=0)}
                back = error @ self.params["out"].T
                to_states = np.stack([back[..., :n], back[::-1, :, n:]], axis=1)
                to_inputs, layer = self.layer.backward(np.ascontiguousarray(to_states), kept)
                grads |= layer
                grads["table"] = scatter_rows(
                    symbols.reshape(-1), to_inputs.reshape(-1, 3 * n), 2 * 257)
                adam.update(grads)


def segments_of(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts cut into segments of STEPS bytes, and the text of each segment."""
    counts = -(-np.diff(offsets) // STEPS)
    owner = np.repeat(np.arange(len(counts)), counts)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = offsets[:-1][owner] + inner * STEPS
    places = start[:, None] + np.arange(STEPS)
    inside = places < offsets[1:][owner][:, None]
    out = np.full(places.shape, PAD, np.int64)
    out[inside] = flat[places[inside]]
    return out, owner


def score_texts(net: ByteNet, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By text: mean probabilities over its letters, bytes given to each label, letters."""
    flat, offsets = binary_column(texts)
    size, width = len(texts), len(net.labels)
    total, votes = np.zeros((size, width)), np.zeros((size, width), np.int64)
    letters = np.zeros(size, np.int64)
    step = BLOCK * STEPS
    begin = 0
    while begin < size:  # texts of about one block at a time; longer ones in several
        end = max(int(np.searchsorted(offsets, offsets[begin] + step, "right")) - 1, begin + 1)
        for at in range(int(offsets[begin]), max(int(offsets[end]), int(offsets[begin]) + 1), step):
            upto = min(at + step, int(offsets[end]))
            inner = np.clip(offsets[begin:end + 1], at, upto)
            segments, owner = segments_of(flat, inner)
            if not len(owner):
                continue
            chances = net.predict(segments)
            mask = _LETTER[segments.T]
            best = chances.argmax(axis=-1)
            owner = owner + begin
            np.add.at(total, owner, (chances * mask[..., None]).sum(axis=0))
            for label in range(width):
                np.add.at(votes[:, label], owner, ((best == label) & mask).sum(axis=0))
            np.add.at(letters, owner, mask.sum(axis=0))
        begin = end
    return total / np.maximum(letters, 1)[:, None], votes, letters


def training_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> list[tuple[str, bytes]]:
    """At most SAMPLE_TEXTS texts of each language, the smallest by hash; the bound is known.

    Ids with a hash below twice the wanted share are ranked, so few rows are shuffled.
    """
    known = docs.select(
        F.xxhash64(docs[id_col].cast("string")).alias("h"), docs[lang_col].cast("string").alias("lang"),
        docs[text_col].cast("string").alias("text"),
    ).where(F.col("lang").isNotNull() & (F.length("text") > 0))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count()
              .orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect()}
    if not counts:
        return []
    share = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(min(1.0, 2 * SAMPLE_TEXTS / n)))
                         for lang, n in counts.items()])
    near = known.where((F.pmod("h", F.lit(1_000_003)) / 1_000_003.0 < share))
    place = 1 + F.pmod("h", F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1)
    order = Window.partitionBy("lang").orderBy("h", "excerpt")
    rows = (near.select("h", "lang", F.substr("text", place.cast("int"), F.lit(SAMPLE_CHARS)).alias("excerpt"))
            .withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= SAMPLE_TEXTS))
    return [(r.lang, r.excerpt.encode()) for r in rows.select("lang", "excerpt").collect()]


def fit(sample: list[tuple[str, bytes]], passes: int = 24_000) -> ByteNet | None:
    """Train on the sample: about so many segments in all, several epochs if it is small."""
    if not sample:
        return None
    sample = sorted(sample)
    labels = sorted({lang for lang, _ in sample})
    texts = pa.array([t for _, t in sample], pa.large_binary())
    segments, owner = segments_of(*binary_column(texts))
    answers = np.array([labels.index(lang) for lang, _ in sample])[owner]
    rng = np.random.default_rng(0)
    chosen = rng.permutation(len(segments))[:passes]
    net = ByteNet(labels)
    net.train(segments[chosen], answers[chosen], max(1, min(20, passes // len(chosen))))
    return net


def predict(text: Column, net: ByteNet | None) -> Column:
    """struct(lang_pred, score, votes) of each whole text.

    ``votes`` counts the letter bytes that each learned label got, in order of the
    labels.  A text that is null, empty or without a letter, or any text if nothing was
    learned, is ``und`` with score 0.
    """

    @F.arrow_udf("struct<lang_pred:string,score:double,votes:array<bigint>>")
    def labelled(texts: pa.Array) -> pa.Array:
        if net is None:
            chances = votes = letters = np.zeros((len(texts), 0))
            best = score = np.zeros(len(texts))
        else:
            chances, votes, letters = score_texts(net, texts)
            best, score = chances.argmax(axis=1), chances.max(axis=1)
        names = [
            net.labels[b] if net and n and any(map(str.isalpha, t.as_py().decode())) else UNKNOWN
            for b, n, t in zip(best, letters, texts)
        ] if net else [UNKNOWN] * len(texts)
        score = [float(min(s, 1.0)) if name != UNKNOWN else 0.0 for s, name in zip(score, names)]
        return pa.StructArray.from_arrays(
            [pa.array(names, pa.string()), pa.array(score, pa.float64()),
             pa.array(votes.tolist(), pa.list_(pa.int64()))], ["lang_pred", "score", "votes"])

    return labelled(utf8(text))


def identify(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    folds: int = 5, held_out: int = 0,
) -> DataFrame:
    """doc_id, held_out, lang_pred, score and votes for every row.

    The network learns from text and label of rows outside the held-out fold (crc32 of
    the id as text); a prediction reads the text alone.  Labels beyond MAX_LANGUAGES,
    by number of rows, are not learned.
    """
    out = fold(docs[id_col], folds) == held_out
    net = fit(training_sample(docs.where(~out), id_col, text_col, lang_col))
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"), out.alias("held_out"),
        predict(docs[text_col], net).alias("p"),
    ).select("doc_id", "held_out", "p.lang_pred", "p.score", "p.votes")
