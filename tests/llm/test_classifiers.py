"""Language identification and toxicity: held-out accuracy, and odd inputs."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabweave.llm import language, toxicity

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def test_language_held_out_accuracy(spark, docs):
    found = language.identify(docs.select("doc_id", "text", "lang")).join(docs.select("doc_id", "lang"), "doc_id")
    held = [r for r in found.collect() if r.held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in held)
    right = [r for r in held if r.lang_pred == r.lang]
    assert len(right) >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in held)


def test_language_labels_every_position(spark, docs):
    sample = language.training_sample(docs, "doc_id", "text", "lang")
    net = language.fit(sample, passes=6000)
    rows = [(1, "the thing that was in the house and there " * 40), (2, None), (3, "123 !?"), (4, ""),
            (5, "x" * 700_000), (None, "und der die ich nicht ein " * 9), (5, "x" * 700_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.doc_id, r.p.lang_pred, sum(r.p.votes), r.p.score > 0) for r in
             df.select("doc_id", language.predict(F.col("text"), net).alias("p")).collect()}
    names = {(i, p) for i, p, _, _ in found}
    assert {(2, "und"), (3, "und"), (4, "und")} <= names
    votes = {i: n for i, _, n, _ in found}
    assert votes[5] == 700_000 and votes[1] == sum(c.isalpha() for c in rows[0][1])
    assert votes[2] == votes[3] == 0
    nothing = df.select(language.predict(F.col("text"), None).alias("p")).select("p.*").distinct().collect()
    assert [(r.lang_pred, r.score) for r in nothing] == [("und", 0.0)]


def test_language_without_rows_or_labels(spark, docs):
    assert language.identify(docs.limit(0)).count() == 0
    unknown = docs.limit(20).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.identify(unknown).collect()} == {"und"}


def test_label_and_source_are_no_inputs(spark, docs):
    net = language.fit(language.training_sample(docs, "doc_id", "text", "lang"), passes=3000)
    other = docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit("q")).withColumn("doc_id", -F.col("doc_id"))
    first, second = ([r.p for r in d.orderBy("text").select(language.predict(F.col("text"), net).alias("p")).collect()]
                     for d in (docs, other))
    assert first == second


@pytest.fixture(scope="module")
def toxic_tables(spark):
    """Plain sentences; the toxic ones hold words of a small set, some of them inflected."""
    words = "house tree river stone morning window garden letter music winter story paper bread".split()
    bad = ["idiot", "scumface", "scumbag", "scumlike", "moron"]
    rows, labels = [], []
    for i in range(900):
        text = [words[(i * 7 + j * j * 3 + i * j) % len(words)] for j in range(30 + i % 60)]
        toxic = int(i % 3 == 0)
        if toxic:
            for k in range(3):
                text[(i * 5 + 11 * k) % len(text)] = bad[(i + k) % len(bad)]
        rows.append((i, " ".join(text).capitalize() + "."))
        labels.append((i, toxic))
    return (spark.createDataFrame(rows, "doc_id long, text string").repartition(3),
            spark.createDataFrame(labels, "doc_id long, toxic int"))


def test_toxicity_held_out(spark, toxic_tables):
    docs, labels = toxic_tables
    found = toxicity.rate(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in found if r.held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in held) and len(held) > 150
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in found)
    assert sum(r.predicted == r.toxic for r in held) >= 0.97 * len(held)
    net = toxicity.learn(docs, labels)
    odd = spark.createDataFrame(
        [(1, None, "a"), (2, "", "a"), (3, " !? ", "b"), (None, "the tree and the river", "c"),
         (5, "house tree river " * 60_000 + " idiot scumbag moron idiot", "d"), (6, "idiot " * 50, "e"), (6, "idiot " * 50, "e")],
        "doc_id long, text string, score string")
    kept = toxicity.drop_toxic(odd, net)
    assert kept.columns == odd.columns
    assert sorted(r.score for r in kept.collect()) == ["a", "a", "b", "c"]
    windows = odd.where("doc_id = 5").select(toxicity.score(F.col("text"), net, odd).windows.alias("w")).first().w
    assert len(windows) == len(toxicity.windows_of(180_004)) and max(windows) == windows[-1]


def test_toxicity_without_labels(spark, toxic_tables):
    docs, labels = toxic_tables
    assert {(r.score, r.predicted) for r in toxicity.rate(docs, labels.limit(0)).collect()} == {(0.0, 0)}
    nulls = labels.select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("int").alias("toxic"))
    assert toxicity.rate(docs.limit(5), nulls).count() == 5
    assert toxicity.rate(docs.limit(0), labels).count() == 0


def test_toxicity_reads_every_letter():
    """What is toxic late in a word, or in a script without spaces, is found in words never seen."""
    rng = np.random.default_rng(5)

    def word(n, letters="abcdefghijklmnopqrstuvwxyz"):
        return "".join(rng.choice(list(letters), n))

    def text(toxic, letters, glue):
        words = [word(8, letters) for _ in range(30)]
        if toxic:
            words[int(rng.integers(30))] += "zqxjk" if letters[0] == "a" else "\u9fa0\u9fa1\u9fa2"
        return glue.join(words)

    for letters, glue in (("abcdefghijklmnopqrstuvwxyz", " "), ("".join(map(chr, range(0x4e00, 0x4e40))), "")):
        sample = [(i % 2, text(i % 2, letters, glue)) for i in range(400)]
        net = toxicity.fit(sample)
        top = toxicity.Scorer(net).score([text(i % 2, letters, glue) for i in range(100)])[0]
        assert np.median(top[1::2]) > 0.7 > 0.3 > np.median(top[::2])
    for run in ("ab" * 500, "x" * 17, "abcdefghijklmnopqrst"):
        pieces = toxicity.words_of(run)
        assert pieces[0] + "".join(p[toxicity.OVERLAP:] for p in pieces[1:]) == run


def test_threshold_comes_from_whole_texts_not_learned_from(spark, toxic_tables, monkeypatch):
    docs, labels = toxic_tables
    long = docs.select("doc_id", F.when(F.col("doc_id") % 50 == 0, F.concat(
        F.repeat(F.lit("house tree river "), 2000), "text")).otherwise(F.col("text")).alias("text"))
    long = long.withColumn("text", F.concat_ws(" ", "text", "doc_id")).cache()  # no two are equal
    samples, scored = [], []
    fit, set_threshold = toxicity.fit_in_a_task, toxicity._set_threshold
    monkeypatch.setattr(toxicity, "fit_in_a_task", lambda sample: samples.append(
        [(r.label, r.excerpt) for r in sample.collect()]) or fit(sample))
    monkeypatch.setattr(toxicity, "_set_threshold", lambda net, texts, known: scored.append(
        texts.join(known, "doc_id").collect()) or set_threshold(net, texts, known))
    net = toxicity.learn(long, labels)
    learned, aside = {t for _, t in samples[0]}, scored[0]
    whole = {r.doc_id: r.text for r in long.collect()}
    assert all(r.text == whole[r.doc_id] and r.text not in learned for r in aside)
    assert {r.label for r in aside} == {0, 1} and any(len(r.text) > toxicity.SAMPLE_CHARS for r in aside)
    assert all(label == 0 or t in whole.values() for label, t in samples[0])
    top = toxicity.Scorer(net).score([r.text for r in aside if r.label == 0])[0]
    assert (top > toxicity.THRESHOLD + 1e-6).mean() <= 0.01
