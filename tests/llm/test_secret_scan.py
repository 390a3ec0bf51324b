"""Secret scans: patterns against brute force, the battery on known inputs."""

import base64
import re
import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tabweave.llm import secret_scan as scan

ASSIGN = re.compile(
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def brute(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found)


def base(row):
    return [tuple(s) for s in row.spans if s.kind < 3]


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    found = scan.find_secrets(docs).collect()
    assert len(found) == len(texts) and sum(map(len, map(base, found))) > 20
    for r in found:
        assert base(r) == brute(texts[r.doc_id])


STRETCH = st.tuples(st.integers(0, 30), st.integers(0, 12))


@settings(max_examples=300, deadline=None)
@given(st.lists(STRETCH, max_size=8), st.lists(STRETCH, min_size=1, max_size=8))
def test_stretches_inside_spans(spans, asked):
    spans = [(a, k % 3, a + n) for k, (a, n) in enumerate(spans)]
    cover = scan.Cover(spans)
    for a, n in asked:
        assert cover.holds(a, a + n) == any(s <= a and a + n <= e for s, _, e in spans)


def test_many_spans_in_one_text(spark):
    """Work grows with the text, not with the square of its spans: 10 MB of hashes."""
    rng = np.random.default_rng(3)
    hashes = rng.integers(0, 256, (160_000, 32), np.uint8)
    text = "\n".join(bytes(h).hex() for h in hashes)
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.monotonic()
    spans = scan.find_secrets(docs).first().spans
    assert time.monotonic() - began < 60
    assert [tuple(s) for s in spans] == [(65 * i, 2, 65 * i + 64) for i in range(len(hashes))]


PARTS = st.sampled_from(["password", "Token", "API_KEY", "apikey", "ſecret", "secret", ":", "=", " ", '"', "é",
                         "abcdef0123456789", "AKIA", "ABCD1234EFGH5678", "deadbeef", "x" * 12, "\n", "passwd"])


@settings(max_examples=300, deadline=None)
@given(st.lists(PARTS, max_size=14).map("".join))
def test_patterns(text):
    data = text.encode()
    spans = [(a, k, b) for a, b, k in scan.pattern_spans(data)]
    flat = np.frombuffer(data, np.uint8)
    spans += [(int(a), 2, int(b)) for a, b in zip(*scan.runs(scan._HEX[flat], 16))]
    points = [len(data[:i].decode(errors="ignore")) for i in range(len(data) + 1)]
    assert sorted((points[a], k, points[b]) for a, k, b in spans) == brute(text)


def test_battery_tells_random_from_text_and_order():
    rng = np.random.default_rng(4)
    english = b"the quick brown fox jumps over the lazy dog and Runs home again in 1999 " * 50
    pairs = np.zeros((256, 256), np.int64)
    data = np.frombuffer(english, np.uint8)
    np.add.at(pairs, (data[:-1], data[1:]), 1)
    models = scan.text_models(pairs)
    letters = np.frombuffer(scan.ENCODINGS["base62"], np.uint8)
    random = [scan.judge(rng.choice(letters, 40).tobytes(), models) for _ in range(300)]
    assert sum(r is not None for r in random) > 290
    assert np.median([r[1] for r in random if r]) < 1e-6
    for text in (b"abcdefghijklmnopqrstuvwxyz0123456789ABCDEFGHIJ", b"aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa",
                 b"thequickbrownfoxjumpsoverthelazydogandrunshome", b"0101010101010101010101010101010101"):
        judged = scan.judge(text, models)
        assert judged is None or judged[1] > 1e-4
    assert scan.judge(b"short", models) is None
    assert scan.judge(b"mixed+and-both_of/them+in-one_token", models) is None


def test_uniform_p_values_are_uniform():
    rng = np.random.default_rng(9)
    model = scan.TextModel(np.full(64, 1 / 64), 0.5)
    found = [scan.battery(rng.integers(0, 64, 60), 64, model) for _ in range(2000)]
    for values in ([f.uniformity for f in found], [f.runs for f in found], [f.serial for f in found]):
        assert 0.02 < np.mean(np.array(values) < 0.05) < 0.09
    assert np.mean([f.random < 1e-3 for f in found]) < 0.01


def test_thresholds():
    # 10 tokens at p = 1e-5 among 1000 are discoveries, one at 1e-2 is not.
    assert scan.thresholds({(5, 100): 10, (5, 40): 1, (5, 0): 989}, 0.01) == {5: 100}
    assert scan.thresholds({(6, 40): 1, (6, 0): 999}, 0.01) == {}
    assert scan.thresholds({}, 0.01) == {}


def test_odd_rows(spark):
    key = "Zk9" + base64.b64encode(np.random.default_rng(89).bytes(45)).decode().replace("+", "x").replace("/", "Q").rstrip("=")
    prose = "some plain words of a text that goes on for a while without anything to hide. " * 20
    rows = [(i, prose, 1) for i in range(30)] + [
        (100, f"é {prose} {key} end", 1), (101, None, 1), (102, "", 1), (None, "password = abcdefghijklm", 1),
        (103, "word " * 200_000 + "AKIA" + "A1B2" * 4, 1), (100, f"é {prose} {key} end", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    found = scan.find_secrets(docs)
    by_id = {r.doc_id: [tuple(s) for s in r.spans] for r in found.collect()}
    start = rows[30][1].index(key)
    assert by_id[100] == [(start, 3, start + len(key))]
    assert by_id[101] == by_id[102] == by_id[0] == [] and by_id[None] == [(0, 0, 24)]
    assert by_id[103] == [(1_000_000, 1, 1_000_020)]
    assert found.count() == len(rows)
    shown = found.where("doc_id = 103").select(scan.spans_text(found.spans)).first()[0]
    assert shown == "access:1000000:1000020"
    assert scan.find_secrets(docs.limit(0)).count() == 0


def test_random_parts_of_longer_runs(spark):
    """Values after a sign of equality, and joined to paths, names and other alphabets' signs."""
    rng = np.random.default_rng(12)
    letters = np.frombuffer(scan.ENCODINGS["base62"], np.uint8)
    keys = [rng.choice(letters, 42).tobytes().decode() for _ in range(5)]
    prose = "some plain words of a text that goes on for a while without anything to hide. " * 20
    forms = [f"aws_access={keys[0]}", f"https://a.example/get?sig={keys[1]}&x=1", f"AccountKey={keys[2]}==",
             f"my-files_of/{keys[3]}/part+one", f"a={keys[4]}=b"]
    docs = spark.createDataFrame([(i, f"{prose} {forms[i]} end" if i < 5 else prose) for i in range(40)],
                                 "doc_id long, text string")
    found = {r.doc_id: [tuple(s) for s in r.spans] for r in scan.find_secrets(docs).collect()}
    for i, (key, form) in enumerate(zip(keys, forms)):
        start = len(prose) + 1 + form.index(key)
        inside = [(a, b) for a, k, b in found[i] if k == 3 and a <= start and b >= start + 42]
        assert inside, (form, found[i])
        if i != 3:
            assert inside == [(start, start + 42 + 2 * (i == 2))]
    assert all(found[i] == [] for i in range(5, 40))


def test_rejected_tokens_count_as_tested():
    """They are in the total that the false-discovery rate refers to, in the last bin."""
    models = scan.text_models(np.ones((256, 256), np.int64))
    assert scan.judge(b"ab" * 16, models) == (6, 1.0)
    assert scan.thresholds({(6, 60): 1, (6, 0): 9}, 0.01) == {6: 60}
    assert scan.thresholds({(6, 60): 1, (6, 0): 99}, 0.01) == {}
