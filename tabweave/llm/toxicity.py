"""Toxicity scores from a bidirectional recurrent network with attention pooling."""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabweave.llm.common import binary_column, fold, utf8
from tabweave.llm.recurrent import F32, Adam, BiGru, scatter_rows

WINDOW, STRIDE = 32, 16     # words of a window; the next one starts so many on
HIDDEN = 8                  # units a direction
BUCKETS = 1 << 13           # rows of the learned character table
WIDTH = 6                   # numbers in one of its rows
PREFIXES = (3, 4, 5, 6)     # lengths of the beginnings that are features; the whole word is one more
FIXED = len(PREFIXES) + 1
GRAMS = (3, 5)              # lengths of the parts that are features, at every place of a word
FEATURES = FIXED + len(GRAMS)
PIECE, OVERLAP = 16, 4      # longer runs of letters are read in pieces, which share some letters
SAMPLE_TEXTS = {1: 1500, 0: 3500}   # labelled training texts of each class, at most
SAMPLE_CHARS = 20_000       # only texts of at most so many letters are sampled
NET_TEXTS = {1: 1200, 0: 3600}      # of these, the weights are trained on so many
CLEAN_WINDOWS = 6           # windows of a clean text that an update reads
LEAST_EVIDENCE = 1.5        # standard errors that a feature's evidence is reduced by
TABLE_ROWS = 200_000        # word and character features that keep a value of their own
MAX_WORDS = 200_000         # words whose inputs a worker remembers at a time
SMOOTH, CLEAN_COST = 0.5, 4.0       # of the cut between the classes, see _cut
BLOCK = 4096                # windows that a step of inference holds at once
SLICE = 4 << 20             # bytes of text that a step holds at once
THRESHOLD = 0.3
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    found = _WORD.findall(text.lower())
    if not found or max(map(len, found)) <= PIECE:
        return found
    words = []
    for w in found:
        if len(w) <= PIECE:
            words.append(w)
        else:
            words += [w[i:i + PIECE] for i in range(0, len(w) - OVERLAP, PIECE - OVERLAP)]
    return words


def _mixed(state: np.ndarray, more: np.ndarray | np.uint64) -> np.ndarray:
    """A hash state after one more letter or mark."""
    state = (state ^ (more + np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xFF51AFD7ED558CCD)
    return state ^ (state >> np.uint64(33))


@dataclass
class Features:
    """Features of words: ``fixed`` (words, FIXED), and ``parts``, a run for each length of a word."""

    fixed: np.ndarray
    parts: np.ndarray
    counts: np.ndarray  # (words, len(GRAMS)), none of them 0

    def starts(self) -> np.ndarray:
        return (np.cumsum(self.counts) - self.counts.reshape(-1)).reshape(self.counts.shape)

    def per_word(self) -> np.ndarray:
        return FIXED + self.counts.sum(axis=1)

    def take(self, words: np.ndarray) -> Features:
        counts = self.counts[words]
        begin = np.cumsum(counts) - counts.reshape(-1)
        at = np.repeat(self.starts()[words].reshape(-1) - begin, counts.reshape(-1)) + np.arange(counts.sum())
        return Features(self.fixed[words], self.parts[at], counts)

    def mean(self, table: np.ndarray) -> np.ndarray:
        """The means of the words' rows in the character table."""
        total = table[self.fixed % BUCKETS].sum(axis=1)
        total += np.add.reduceat(table[self.parts % BUCKETS], self.starts()[:, 0])
        return (total / self.per_word()[:, None]).astype(F32)

    def scatter(self, back: np.ndarray) -> np.ndarray:
        """The gradient of the character table from that of the means."""
        each = back / self.per_word()[:, None].astype(F32)
        rows = np.concatenate([self.fixed.reshape(-1), self.parts]) % BUCKETS
        values = np.concatenate([np.repeat(each, FIXED, axis=0), np.repeat(each, self.counts.sum(axis=1), axis=0)])
        return scatter_rows(rows, values, BUCKETS)


class Evidence:
    """How much more often a feature occurs in texts of one class than of the other.

    A value is the end nearer to 0 of an interval of LEAST_EVIDENCE standard errors around
    the smoothed log odds ratio, from numbers of texts: 0 for what chance may explain, and
    small for common words however sure.  At most TABLE_ROWS of the strongest stay.
    """

    def __init__(self, keys: np.ndarray, found: list[np.ndarray], labels: np.ndarray):
        with_one, with_any = np.zeros(len(keys)), np.zeros(len(keys))
        for places, label in zip(found, labels):  # a text's features, as places in keys, are distinct
            with_any[places] += 1
            with_one[places] += label
        many = max(int(labels.sum()), 1), max(int((1 - labels).sum()), 1)
        a, b = with_one + 0.5, with_any - with_one + 0.5
        odds = np.log(a / (many[0] - with_one + 0.5)) - np.log(b / (many[1] - with_any + with_one + 0.5))
        value = (with_any > 0) * np.sign(odds) * np.maximum(np.abs(odds) - LEAST_EVIDENCE * np.sqrt(1 / a + 1 / b), 0)
        strong = np.flatnonzero(value)
        strong = strong[np.argsort(-np.abs(value[strong]), kind="stable")[:TABLE_ROWS]]
        strong.sort()
        self.keys = np.concatenate([keys[strong], [2**63 - 1]])
        self.values = np.concatenate([np.clip(value[strong] / 2, -3, 3), [0]]).astype(F32)

    def look_up(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, hashes)
        return np.where(self.keys[at] == hashes, self.values[at], F32(0))

    def inputs(self, words: Features) -> np.ndarray:
        """(words, FEATURES) values; of the parts of one length, the strongest."""
        parts, starts = self.look_up(words.parts), words.starts().reshape(-1)
        high, low = np.maximum.reduceat(parts, starts), np.minimum.reduceat(parts, starts)
        strongest = np.where(high >= -low, high, low).reshape(-1, len(GRAMS))
        return np.concatenate([self.look_up(words.fixed), strongest], axis=1)


def windows_of(count: int) -> list[tuple[int, int]]:
    """(start, end) of overlapping windows that cover all words; none without words."""
    if not count:
        return []
    starts = range(0, max(count - STRIDE, 1), STRIDE)
    return [(s, min(s + WINDOW, count)) for s in starts]


class WordNet:
    """Reads windows of words, character and word inputs side by side."""

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        n = HIDDEN
        self.layer = BiGru(n, rng)
        self.params = self.layer.params | {
            "letters": rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(F32),
            "inputs": rng.normal(0, 0.3, (2, FEATURES + WIDTH, 3 * n)).astype(F32),
            "look": rng.normal(0, 0.3, (2 * n, n)).astype(F32),
            "query": rng.normal(0, 0.3, n).astype(F32),
            "out": rng.normal(0, 0.3, 2 * n).astype(F32),
            "out_bias": np.full(1, -1.0, F32),
        }
        self.evidence: Evidence | None = None

    def word_inputs(self, words: Features, evidence: Evidence) -> np.ndarray:
        """(words, FEATURES + WIDTH) from the words' features."""
        return np.concatenate([evidence.inputs(words), words.mean(self.params["letters"])], axis=1)

    def pooled(self, places: np.ndarray, table: np.ndarray, keep: bool = False):
        """Logits of windows; places (batch, WINDOW) are rows of a (2, words, 3n) table, 0 is none."""
        inputs = np.stack([table[0][places.T], table[1][places.T[::-1]]], axis=1)
        states, kept = self.layer.forward(inputs, keep)
        both = np.concatenate([states[:, 0], states[::-1, 1]], axis=-1)
        looked = np.tanh(both @ self.params["look"])
        attention = looked @ self.params["query"]
        attention[places.T == 0] = -1e9
        attention -= attention.max(axis=0)
        np.exp(attention, out=attention)
        attention /= attention.sum(axis=0)
        mean = (attention[..., None] * both).sum(axis=0)
        logits = mean @ self.params["out"] + self.params["out_bias"]
        return logits, (kept, both, looked, attention, mean)

    def gradients(self, error: np.ndarray, places: np.ndarray, cache: tuple) -> tuple[dict, np.ndarray]:
        """Gradients of the parameters above the table, and of the gathered rows."""
        kept, both, looked, attention, mean = cache
        n = HIDDEN
        grads = {"out": mean.T @ error, "out_bias": error.sum(keepdims=True)}
        to_mean = error[:, None] * self.params["out"]
        to_both = attention[..., None] * to_mean
        to_attention = (both * to_mean).sum(axis=-1)
        to_attention = attention * (to_attention - (attention * to_attention).sum(axis=0))
        grads["query"] = np.einsum("tbn,tb->n", looked, to_attention)
        to_look = to_attention[..., None] * self.params["query"] * (1 - looked * looked)
        grads["look"] = both.reshape(-1, 2 * n).T @ to_look.reshape(-1, n)
        to_both = to_both + to_look @ self.params["look"].T
        to_states = np.ascontiguousarray(np.stack([to_both[..., :n], to_both[::-1, :, n:]], axis=1))
        to_inputs, layer = self.layer.backward(to_states, kept)
        return grads | layer, to_inputs

    def project(self, inputs: np.ndarray) -> np.ndarray:
        """(2, words, 3n); row 0 stands for the place behind the last word."""
        return np.matmul(inputs, self.params["inputs"])


def _features(words: list[str]) -> Features:
    """Features of words: hashes of each word's beginnings and of the word, and of all its parts.

    A beginning, or a part, of a short word is the word.  Hashes run over the letters of all
    words at once.  The first row, of no word, is all zero.
    """
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    begin = np.cumsum(sizes) - sizes
    padded = np.append(letters, np.zeros(PIECE, np.uint64))

    def run(start: np.ndarray, length: np.ndarray, most: int, stops: tuple[int, ...] = ()) -> list[np.ndarray]:
        """Hash states after each of ``stops`` letters, or all if there are fewer, and after all."""
        state, kept = np.zeros(len(start), np.uint64), []
        for t in range(most):
            if t in stops:
                kept.append(state)
            state = np.where(t < length, _mixed(state, padded[start + np.minimum(t, length)]), state)
        return [*kept, state]

    states = run(begin, sizes, PIECE, PREFIXES)
    fixed = np.zeros((len(words) + 1, FIXED), np.int64)
    for k, (mark, state) in enumerate(zip([*PREFIXES, 0], states)):
        fixed[1:, k] = _mixed(state, np.uint64(mark)) >> np.uint64(1)
    counts = np.ones((len(words) + 1, len(GRAMS)), np.int64)
    for k, n in enumerate(GRAMS):
        counts[1:, k] = np.maximum(sizes - n, 0) + 1
    ends = np.cumsum(counts.reshape(-1)).reshape(counts.shape)
    parts = np.zeros(int(ends[-1, -1]), np.int64)
    for k, n in enumerate(GRAMS):
        many = counts[1:, k]
        inner = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        state = run(np.repeat(begin, many) + inner, np.repeat(np.minimum(sizes, n), many), n)[-1]
        parts[np.repeat(ends[1:, k] - many, many) + inner] = _mixed(state, np.uint64(99)) >> np.uint64(1)
    return Features(fixed, parts, counts)


def _places(sequence: np.ndarray) -> np.ndarray:
    """Windows over one text's word places."""
    spans = windows_of(len(sequence))
    if not spans:
        return np.zeros((0, WINDOW), np.int64)
    padded = np.append(sequence, np.zeros(WINDOW, np.int64))
    return padded[np.arange(len(spans))[:, None] * STRIDE + np.arange(WINDOW)]


def fit(sample: list[tuple[int, str]], epochs: int = 3, batch: int = 32) -> WordNet | None:
    """Train on labelled texts by backpropagation through time; a text counts by its top window.

    The evidence that training reads for a text comes from the other half of the
    sample, so that a feature is worth in training what it is worth on new texts.
    """
    sample = sorted((int(label), text) for label, text in sample)
    labels = np.array([label for label, _ in sample])
    if len(set(labels.tolist())) < 2:
        return None
    known: dict[str, int] = {}
    sequences = [np.array([known.setdefault(w, len(known) + 1) for w in words_of(t)], np.int64)
                 for _, t in sample]
    words = _features(list(known))
    keys = np.unique(np.concatenate([words.fixed.reshape(-1), words.parts]))
    coded = Features(np.searchsorted(keys, words.fixed).astype(np.int32),
                     np.searchsorted(keys, words.parts).astype(np.int32), words.counts)

    def found_in(sequence: np.ndarray) -> np.ndarray:
        own = coded.take(np.unique(sequence))
        return np.unique(np.concatenate([own.fixed.reshape(-1), own.parts]))

    found = [found_in(s) for s in sequences]
    rng = np.random.default_rng(3)
    half = rng.permutation(len(sample)) % 2
    net = WordNet()

    def evidence_of(part: np.ndarray) -> Evidence:
        return Evidence(keys, [found[i] for i in np.flatnonzero(part)], labels[part])

    halves = [evidence_of(half == k) for k in (0, 1)]
    looked = [e.inputs(words) for e in halves]
    net.evidence = evidence_of(np.ones(len(sample), bool))
    windows = [_places(s) for s in sequences]
    # A toxic text in which the other half knows nothing telling would teach noise.
    telling = np.array([labels[i] == 0 or not len(found[i]) or
                        halves[1 - half[i]].look_up(keys[found[i]]).max() > 0.5 for i in range(len(sample))])
    mixed = rng.permutation(len(sample))
    mixed = mixed[telling[mixed]]
    useful = np.array([i for k in (0, 1) for i in mixed[labels[mixed] == k][:NET_TEXTS[k]]
                       if len(windows[i])], np.int64)
    epochs = max(epochs, min(30, 6000 // max(len(useful), 1)))
    adam = Adam(net.params, 0.01, epochs * -(-len(useful) // batch))
    balance = len(labels) / 2 / np.array([max((labels == 0).sum(), 1), max((labels == 1).sum(), 1)])
    balance = np.sqrt(balance)
    for _ in range(epochs):
        order = rng.permutation(useful)
        for start in range(0, len(order), batch):
            part = order[start:start + batch]
            read = [windows[i] if labels[i] or len(windows[i]) <= CLEAN_WINDOWS else
                    windows[i][rng.choice(len(windows[i]), CLEAN_WINDOWS, replace=False)] for i in part]
            places = np.concatenate(read)
            owner = np.repeat(np.arange(len(part)), [len(w) for w in read])
            # A text of one half reads the evidence of the other.
            side = 1 - half[part][owner]
            rows, local = np.unique(places * 2 + side[:, None], return_inverse=True)
            rows = np.concatenate([[0], rows])
            local = np.where(places == 0, 0, local.reshape(places.shape) + 1)
            which = words.take(rows // 2)
            letters = which.mean(net.params["letters"])
            evidence = np.where((rows % 2)[:, None] == 1, looked[1][rows // 2], looked[0][rows // 2])
            inputs = np.concatenate([evidence, letters], axis=1)
            logits, cache = net.pooled(local, net.project(inputs), keep=True)
            chance = 1 / (1 + np.exp(-logits))
            answer = labels[part][owner]
            top = np.zeros(len(places), bool)
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            for a, b in zip(first, [*first[1:], len(owner)]):
                top[a + int(logits[a:b].argmax())] = True
            weight = np.where(answer == 1, top, True) * balance[answer]
            weight = np.where((answer == 0) & ~top, weight * 0.2, weight)
            error = ((chance - answer) * weight / len(part)).astype(F32)
            grads, to_inputs = net.gradients(error, local, cache)
            two = [scatter_rows(at.reshape(-1), to_inputs[:, k].reshape(-1, 3 * HIDDEN), len(rows))
                   for k, at in enumerate((local.T, local.T[::-1]))]
            grads["inputs"] = np.stack([inputs.T @ g for g in two])
            back = sum(g @ net.params["inputs"][k].T for k, g in enumerate(two))[:, FEATURES:]
            grads["letters"] = which.scatter(back)
            adam.update(grads)
    return net


def _cut(toxic: np.ndarray, clean: np.ndarray) -> float:
    """The logit that separates two classes of logits with the least smoothed error.

    Every logit counts as a logistic bump of width SMOOTH, so that a handful of texts, or a
    single odd one, does not place the cut; a clean text above it costs CLEAN_COST times
    a toxic one below it.
    """
    def share_above(logits: np.ndarray, cut: np.ndarray) -> np.ndarray:
        return (1 / (1 + np.exp(np.clip((cut[:, None] - logits) / SMOOTH, -60, 60)))).mean(axis=1)

    cuts = np.linspace(min(toxic.min(), clean.min()), max(toxic.max(), clean.max()), 801)
    cost = 1 - share_above(toxic, cuts) + CLEAN_COST * share_above(clean, cuts)
    best = np.flatnonzero(cost <= cost.min() + 1e-9)
    return float(cuts[best].mean())


def _set_threshold(net: WordNet, docs: DataFrame, labels: DataFrame) -> None:
    """Shift the scores so that THRESHOLD lies between toxic and clean texts not learned from.

    ``docs`` (doc_id, text) are scored whole, as all texts are later.  Each class sends
    evenly spaced quantiles of its scores, 400 at most.
    """
    scored = docs.join(labels, "doc_id").select("label", score(F.col("text"), net, docs, False)["score"].alias("p"))
    steps = [(i + 0.5) / 400 for i in range(400)]
    found = scored.groupBy("label").agg(F.percentile_approx("p", steps, 100_000).alias("q")).collect()
    logits = {}
    for r in found:
        p = np.clip(np.array(r.q), 1e-9, 1 - 1e-9)
        logits[r["label"]] = np.log(p) - np.log1p(-p)
    if len(logits) < 2:
        return
    net.params["out_bias"] += F32(np.log(THRESHOLD / (1 - THRESHOLD)) - _cut(logits[1], logits[0]))


class _Known(dict):
    """Numbers words from 1 as they come and lists the new ones."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self) + 1
        self.fresh.append(word)
        return n


class Scorer:
    """Scores texts; remembers the projected inputs of up to MAX_WORDS words."""

    def __init__(self, net: WordNet):
        self.net = net
        self.forget()

    def forget(self) -> None:
        self.known = _Known()
        self.table = self.net.project(self.net.word_inputs(_features([]), self.net.evidence))

    def score(self, texts: list[str], windows: bool = True) -> tuple[np.ndarray, list[list[float]]]:
        """The highest window of each text, 0 without words, and the scores of all its windows if asked."""
        if len(self.known) > MAX_WORDS:
            self.forget()
        number, places = self.known.__getitem__, []
        for text in texts:
            words = words_of(text)
            places.append(_places(np.fromiter(map(number, words), np.int64, len(words))))
        if self.known.fresh:
            new = self.net.project(self.net.word_inputs(_features(self.known.fresh), self.net.evidence))
            self.table = np.concatenate([self.table, new[:, 1:]], axis=1)
            self.known.fresh = []
        every = np.concatenate([*places, np.zeros((0, WINDOW), np.int64)])
        logits = np.concatenate([
            self.net.pooled(every[a:a + BLOCK], self.table)[0] for a in range(0, len(every), BLOCK)
        ] + [np.zeros(0, F32)])
        chances = 1 / (1 + np.exp(-logits.astype(np.float64)))
        counts = np.fromiter(map(len, places), np.int64, len(places))
        bounds = np.cumsum(counts) - counts
        top = np.zeros(len(texts))
        if len(every):
            top[counts > 0] = np.maximum.reduceat(chances, bounds[counts > 0])
        each = [chances[a:a + n].tolist() for a, n in zip(bounds.tolist(), counts.tolist())] if windows else []
        return top, each


def marked(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(doc_id, label, h) of each labelled document; a hash of the id."""
    found = labels.select(
        labels[id_col].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("label")
    ).where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    return found.withColumn("h", F.xxhash64("doc_id"))


def training_sample(texts: DataFrame, known: DataFrame, counts: dict[int, int]) -> DataFrame:
    """(label, excerpt): labelled texts, at most SAMPLE_TEXTS of each class, the smallest by hash.

    Longer clean texts give an excerpt.  Longer toxic ones give none, because it may not
    hold what is toxic.
    """
    share = F.when(F.col("label") == 1, min(1.0, 2 * SAMPLE_TEXTS[1] / counts.get(1, 1))).otherwise(
        min(1.0, 2 * SAMPLE_TEXTS[0] / counts.get(0, 1)))
    near = known.where(F.pmod("h", F.lit(1_000_003)) / 1_000_003.0 < share)
    nth = F.row_number().over(Window.partitionBy("label").orderBy("h"))
    chosen = near.withColumn("nth", nth).where(
        F.col("nth") <= F.when(F.col("label") == 1, SAMPLE_TEXTS[1]).otherwise(SAMPLE_TEXTS[0]))
    place = 1 + F.pmod("h", F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1)
    # The chosen rows are few by the bound above.
    return texts.where(F.length("text") > 0).join(F.broadcast(chosen.drop("nth")), "doc_id").where(
        (F.col("label") == 0) | (F.length("text") <= SAMPLE_CHARS)).select(
        "label", F.substr("text", place.cast("int"), F.lit(SAMPLE_CHARS)).alias("excerpt"))


def fit_in_a_task(sample: DataFrame) -> WordNet | None:
    """:func:`fit` on the bounded sample, in one task, so that the driver holds the network only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for b in batches for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(rows))], pa.binary())], ["net"])

    found = sample.repartition(1).mapInArrow(run, "net binary").collect()
    return pickle.loads(found[0].net) if found else None


def learn(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "toxic", folds: int = 4, held_out: int = 2,
) -> WordNet | None:
    """A network from labelled rows outside the held-out fold; None if a class is missing.

    A fifth of these rows teaches nothing and sets the threshold at the end.
    """
    known = marked(labels.where(fold(labels[id_col].cast("long"), folds) != held_out), id_col, label_col)
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    aside = F.pmod(F.xxhash64("h"), F.lit(5)) == 0
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    enough = sum(counts.values()) >= 200
    net = fit_in_a_task(training_sample(texts, known.where(~aside) if enough else known, counts))
    if net is not None and enough:
        _set_threshold(net, texts.where(F.length("text") > 0), known.where(aside).select("doc_id", "label"))
    return net


_scorers: dict[bytes, Scorer] = {}


def score(text: Column, net: WordNet | None, docs: DataFrame, windows: bool = True) -> Column:
    """struct(score, windows): the highest of all overlapping windows of each whole text.

    ``windows=False`` leaves the windows' scores empty.  A null or empty text, or one without a word, scores 0, and so does any text if
    nothing could be learned.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)  # bounded by TABLE_ROWS and BUCKETS
    key = np.random.default_rng().bytes(16)

    @F.arrow_udf("struct<score:double,windows:array<double>>")
    def scored(texts: pa.Array) -> pa.Array:
        top, each = np.zeros(len(texts)), [[] for _ in range(len(texts))]
        if shared.value is not None:
            if key not in _scorers:
                _scorers.clear()
                _scorers[key] = Scorer(shared.value)
            _, offsets = binary_column(texts)
            start = 0
            while start < len(texts):
                stop = int(np.searchsorted(offsets, offsets[start] + SLICE, "right")) - 1
                stop = min(max(stop, start + 1), len(texts))
                part = [t.decode() for t in texts[start:stop].to_pylist()]
                top[start:stop], found = _scorers[key].score(part, windows)
                each[start:stop] = found or each[start:stop]
                start = stop
        return pa.StructArray.from_arrays(
            [pa.array(top), pa.array(each, pa.list_(pa.float64()))], ["score", "windows"])

    return scored(utf8(text))


def rate(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "toxic", folds: int = 4, held_out: int = 2, windows: bool = True,
) -> DataFrame:
    """doc_id, held_out, score, predicted and windows (all window scores, if asked) for every row."""
    net = learn(docs, labels, id_col, text_col, label_col, folds, held_out)
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        (fold(docs[id_col].cast("long"), folds) == held_out).alias("held_out"),
        score(docs[text_col], net, docs, windows).alias("p"),
    ).select("doc_id", "held_out", "p.score", *(["p.windows"] if windows else []),
             F.when(F.col("p.score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def drop_toxic(docs: DataFrame, net: WordNet | None, text_col: str = "text") -> DataFrame:
    """The rows that score below the threshold; all columns stay."""
    return docs.where(score(F.col(text_col), net, docs, False)["score"] < THRESHOLD)
