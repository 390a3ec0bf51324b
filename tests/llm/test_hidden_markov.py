"""The hidden Markov model against brute force, and odd inputs."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tabweave.llm import hidden_markov as hmm


def random_model(rng, symbols=6, states=3):
    start, move, emit = rng.random(states), rng.random((states, states)), rng.random((symbols, states))
    return hmm.Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def all_paths(model, text):
    """Likelihood and expected counts by every path of states."""
    states, total = len(model.start), 0.0
    counts = hmm.Expected.zero(*model.emit.shape)
    for code in range(states ** len(text)):
        path = [code // states**i % states for i in range(len(text))]
        chance = model.start[path[0]]
        for i, (k, s) in enumerate(zip(path, text)):
            chance *= model.emit[s, k] * (model.move[path[i - 1], k] if i else 1)
        total += chance
        counts.start[path[0]] += chance
        for i, (k, s) in enumerate(zip(path, text)):
            counts.emit[s, k] += chance
            if i:
                counts.move[path[i - 1], k] += chance
    for part in (counts.start, counts.move, counts.emit):
        part /= total
    return total, counts


def test_recursions_equal_all_paths():
    rng = np.random.default_rng(1)
    model = random_model(rng)
    texts = [rng.integers(0, 6, n) for n in (1, 5, 3, 6, 3)]
    exact = [all_paths(model, t) for t in texts]
    assert np.allclose(model.score(texts), [math.log10(p) for p, _ in exact])
    found = model.expect(texts)
    for name in ("start", "move", "emit"):
        assert np.allclose(getattr(found, name), sum(getattr(c, name) for _, c in exact))
    assert math.isclose(found.likelihood, sum(math.log(p) for p, _ in exact))


def test_rounds_raise_the_likelihood_and_long_texts_stay_finite():
    rng = np.random.default_rng(2)
    true = random_model(rng, 20, 2)
    texts = [rng.integers(0, 10, 200) if i % 2 else rng.integers(10, 20, 200) for i in range(20)]
    shares = np.full(20, 1 / 20)
    model, seen = random_model(rng, 20, 2), []
    for _ in range(12):
        step = model.expect(texts)
        seen.append(step.likelihood)
        model = step.model(shares)
    assert all(b > a - 25 for a, b in zip(seen, seen[1:])) and seen[-1] > seen[0] + 100
    assert np.isfinite(true.score([rng.integers(0, 20, 30_000)])).all()


def base_rows(rows):
    words = {i: (t or "").encode().lower().split() for i, t in rows}
    train = Counter()
    for i, _ in rows:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            train.update([*words[i], hmm.END])
    n, v = sum(train.values()), len(train)
    out = {}
    for i, _ in rows:
        tokens = [*words[i], hmm.END]
        out[i] = (zlib.crc32(str(i).encode()) % 5 == 1, len(tokens), sum(train[t] > 0 for t in tokens), n,
                  sum(math.log10((train[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens))
    return out


@pytest.mark.parametrize("symbols,local", [(200, 1000), (16_384, 250_000), (5, 0)])
def test_table(spark, symbols, local):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    expected = base_rows([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    found = hmm.score_documents(docs, symbols=symbols, local_words=local, rounds=2).collect()
    assert len(found) == len(expected)
    for r in found:
        out, n_tokens, n_known, n, base = expected[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out, n_tokens, n_known, n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
    if symbols > 5:
        held = [r for r in found if r.held_out]
        assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_score_is_a_distribution_over_texts(spark):
    """All texts of one known word or none, with all that could follow, add up to less than 1."""
    docs = spark.createDataFrame([(i, "a b a") for i in (0, 2, 3, 4)], "doc_id long, text string")
    probes = spark.createDataFrame([(100 + i, t) for i, t in enumerate(["", "a", "b", "a a", "a b", "b a", "zz"])],
                                   docs.schema)
    found = hmm.score_documents(docs.unionAll(probes), states=2, rounds=1).where("doc_id >= 100").collect()
    assert 0.0 < sum(10 ** r.score for r in found) < 1.0


def test_odd_rows(spark):
    rows = [(2, None), (3, ""), (4, "One two\x85 ONE " * 3), (None, "two"), (4, "One two\x85 ONE " * 3),
            (6, "x " * 50_000)]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double")
    found = hmm.score_documents(docs, rounds=1)
    assert found.count() == 6
    by_id = {r.doc_id: r for r in found.collect()}
    assert by_id[2].n_tokens == by_id[3].n_tokens == 1 and by_id[6].n_tokens == 50_001
    assert all(np.isfinite([r.score, r.base_score]).all() for r in by_id.values())
    assert hmm.score_documents(docs.limit(0)).count() == 0
    only_held_out = docs.where("false").unionAll(
        spark.createDataFrame([(i, "a b", 0.0) for i in range(40) if zlib.crc32(str(i).encode()) % 5 == 1], docs.schema))
    r = hmm.score_documents(only_held_out, rounds=1).first()
    assert (r.n_known, r.train_tokens) == (0, 0) and math.isclose(r.base_score, 0.0, abs_tol=1e-12)


def test_all_training_tokens_and_words_teach(spark):
    """A habit of the texts' later parts, in words beyond any fixed number, is learned."""
    lines = []
    for i in range(60):
        head = "same opening words " * 140
        lines.append((i, head + " ".join(f"{'pq'[j // 40 % 2]}{(i * 7 + j * j) % 40}" for j in range(400))))
    docs = spark.createDataFrame(lines, "doc_id long, text string")
    found = hmm.score_documents(docs, states=4).collect()
    held = [r for r in found if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 100 * len(held)


def test_emissions_of_words_that_workers_do_not_hold(spark, monkeypatch):
    monkeypatch.setattr(hmm, "START_ROUNDS", 0)
    monkeypatch.setattr(hmm, "SETTLED", 1.0)  # as many rounds as asked for
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).coalesce(1)
    near, far = ({r.doc_id: r.score for r in hmm.score_documents(docs, local_words=n, rounds=2).collect()}
                 for n in (250_000, 300))
    assert near.keys() == far.keys()
    for i in near:
        assert math.isclose(near[i], far[i], rel_tol=1e-8)


def test_rounds_shuffle_words_of_blocks_not_occurrences(spark, monkeypatch):
    """A block sends a word once a round, whatever it occurs, and scratch of a round goes with it."""
    monkeypatch.setattr(hmm, "START_ROUNDS", 0)
    monkeypatch.setattr(hmm, "SETTLED", 1.0)
    sent, kept, run = [], [], hmm._expected

    def watched(training, model, numbered, tail=None):
        found = run(training, model, numbered, tail)
        asked = numbered.where("block is not null").toArrow()
        sent.append(sum(len(x) // 4 for x in asked["at"].to_pylist()))
        kept.append(tail.paths)
        return found

    monkeypatch.setattr(hmm, "_expected", watched)
    words = [f"w{j}" for j in range(300)]
    docs = spark.createDataFrame([(i, " ".join(words)) for i in range(100)], "doc_id long, text string").coalesce(1)
    found = hmm.score_documents(docs, local_words=0, states=2, rounds=3).collect()
    assert len(found) == 100 and np.isfinite([r.score for r in found]).all()
    assert sent == [600] * 3  # a block of training and one of held-out texts
    assert kept[0] == [] and kept[1] != kept[2]
    files = spark._jvm.org.apache.hadoop.fs.Path(kept[1][0])
    assert not files.getFileSystem(spark._jsc.hadoopConfiguration()).exists(files)


def test_blocks_and_ranges_change_no_score(spark, monkeypatch):
    """Many blocks and ranges give what one block gives, with words of one or many blocks or never taught."""
    monkeypatch.setattr(hmm, "START_ROUNDS", 0)
    monkeypatch.setattr(hmm, "SETTLED", 1.0)
    rng = np.random.default_rng(5)
    lines = [(i, " ".join(f"v{int(x)}" for x in rng.zipf(1.3, 40 + i) % 5000)) for i in range(80)]
    docs = spark.createDataFrame([*lines, (81, None), (None, "v1 v1"), (81, "")], "doc_id long, text string").coalesce(1)
    scores = []
    for block, size, local in ((1 << 22, 1 << 16, 10_000), (200, 16, 20), (1 << 22, 16, 0)):  # one part, two, one
        monkeypatch.setattr(hmm, "BLOCK", block)
        monkeypatch.setattr(hmm, "RANGE", size)
        monkeypatch.setattr(hmm, "LOCAL_RANGE", size)
        rows = hmm.score_documents(docs, states=3, local_words=local, rounds=3).collect()
        scores.append(sorted((r.doc_id or -1, r.n_tokens, r.n_known, r.base_score, r.score) for r in rows))
    for other in scores[1:]:
        assert len(other) == 83 and np.allclose(other, scores[0], rtol=1e-8)


@pytest.mark.parametrize("states", [3, 8])
def test_rounds_in_java_equal_numpy(spark, states):
    """With vectors (8 states) and without, over empty, short and long texts."""
    from pyspark.sql import functions as F

    from tabweave.llm import native

    rng, size, end = np.random.default_rng(states), 40, 39
    model = random_model(rng, size, states)
    texts = [rng.integers(0, 38, n).astype(np.int32) for n in (0, 1, 7, 8, 300, 4094, 4095, 4096, 9001, 0)]
    expect = native.Rounds(spark, model, np.zeros(states), np.ones(states), 0.0, 16, -9, hmm.SCALED)
    row = (np.concatenate(texts).tobytes(), [len(t) for t in texts], np.arange(38, dtype=np.int32).tobytes())
    kinds = ("binary", "binary", "binary", "array<struct<range:int,sums:binary>>")
    rows = spark.createDataFrame([row], "words binary, lengths array<int>, places binary").select(F.inline(expect(
        "words", "lengths", "places", *(F.lit(None).cast(kind) for kind in kinds)))).collect()
    expect.destroy()
    found = hmm.Expected.zero(size, states)
    for r in rows:
        x, at = np.frombuffer(r.near).reshape(-1, states), np.frombuffer(r.at, np.int32)
        if r.range == -9:
            found.move, found.start, found.likelihood = x[:states], x[states], x[states + 1].sum()
        else:
            found.emit[(-1 - r.range) * 16 + at] = x
    exact = model.expect([np.append(t, end) for t in texts])
    for name in ("start", "move", "emit", "likelihood"):
        assert np.allclose(getattr(found, name), getattr(exact, name), rtol=1e-9)


def test_words_of_one_block_are_not_exchanged(spark, monkeypatch):
    """Only words of several blocks go to ranges, and only training blocks get answers in a round."""
    monkeypatch.setattr(hmm, "START_ROUNDS", 0)
    monkeypatch.setattr(hmm, "SETTLED", 1.0)
    monkeypatch.setattr(hmm, "BLOCK", 50)
    sent, answered, run = [], [], hmm._expected

    def watched(training, model, numbered, tail=None):
        found, tail = run(training, model, numbered, tail)
        rows = {"far": tail.rows, "own": tail.own}
        sent.append([sum(len(r[0]) // 16 for r in rows[c].select(c).collect()) for c in ("far", "own")])
        answered.append(hmm._answers(numbered, tail, False).select("block").distinct().count())
        return found, tail

    monkeypatch.setattr(hmm, "_expected", watched)
    taught = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5 != 1][:4]
    other = next(i for i in range(40) if zlib.crc32(str(i).encode()) % 5 == 1)
    lines = [(i, " ".join(["both one", *(f"w{i}x{j}" for j in range(60))])) for i in taught] + [(other, "both far")]
    docs = spark.createDataFrame(lines, "doc_id long, text string").coalesce(1)
    found = hmm.score_documents(docs, local_words=0, states=2, rounds=2).collect()
    assert len(found) == 5 and np.isfinite([r.score for r in found]).all()
    assert sent == [[8, 240]] * 2 and answered == [4] * 2


def test_words_of_many_texts_at_once():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    signs = b" \t\n\x0b\x0c\r\x00\x1c\x1d\x1f\x85\xa0\xc3\x89\xc9Aaz.Z"
    texts = [bytes(signs[i] for i in rng.integers(0, len(signs), n)) for n in rng.integers(0, 30, 500)]
    words, sizes = hmm.tokenized(pa.array([b"", b"skipped", *texts, b"", b" "], pa.binary()).slice(2))
    expected = [hmm.words_of(t) for t in [*texts, b"", b" "]]
    assert sizes.tolist() == [len(w) for w in expected]
    assert words.to_pylist() == [w for ws in expected for w in ws]
    assert hmm.tokenized(pa.array([], pa.binary()))[1].tolist() == []
