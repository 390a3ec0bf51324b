"""Decontamination against brute force, and odd inputs."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tabweave.llm import contamination
from tabweave.llm.contamination import Scanner, drop_contaminated, merged, scan_documents, word_spans

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(text, items, window):
    own, hit, found = words(text), set(), set()
    for item, item_text in items:
        w = words(item_text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            part = w[i:i + window]
            for at in range(len(own) - len(part) + 1):
                if own[at:at + len(part)] == part:
                    hit |= set(range(at, at + len(part)))
                    found.add(item)
    return len(own), len(hit), sorted(found)


ALPHABET = st.lists(st.sampled_from(["a", "B", "é", "a-b", "1", "Ab", "\x85", "a\n", "Ä"]), max_size=14)


@settings(max_examples=150, deadline=None)
@given(ALPHABET.map(" ".join), st.lists(ALPHABET.map(" ".join), max_size=4), st.integers(1, 4))
def test_brute_force(text, items, window):
    named = [(str(i), t) for i, t in enumerate(items)]
    scanner = Scanner([(i, t.encode()) for i, t in named], window)
    n, starts, ends, owners = scanner.scan(text.encode())
    hits = merged(starts, ends)
    assert (n, sum(b - a for a, b in hits), sorted(owners)) == brute(text, named, window)
    spans = word_spans(text.encode())
    assert [w for a, b in spans for w in words(text[a:b])] == words(text) and len(spans) == n


def tables(spark):
    docs = [(1, "x Alpha, beta? gamma y", 0), (2, "alpha beta x gamma", 0), (3, None, 0), (4, "", 0),
            (None, "ALPHA-BETA-GAMMA delta epsilon", 0), (5, "word " * 100_000 + "alpha beta gamma", 0),
            (1, "x Alpha, beta? gamma y", 0)]
    items = [(10, "alpha beta gamma"), (9, "beta gamma delta epsilon"), (8, None), (7, "?!"),
             (10, "alpha beta gamma"), (6, "short one")]
    return (spark.createDataFrame(docs, "doc_id long, text string, item_id int"),
            spark.createDataFrame(items, "item_id long, text string"))


def test_odd_rows(spark):
    docs, items = tables(spark)
    found = scan_documents(docs, items, window=3)
    rows = {(r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in found.collect()}
    assert rows == {(1, 5, 3, ("10",)), (2, 4, 0, ()), (3, 0, 0, ()), (4, 0, 0, ()),
                    (None, 5, 5, ("10", "9")), (5, 100_003, 3, ("10",))}
    one = found.where("doc_id = 1").first()
    assert found.count() == 7 and (one.char_starts, one.char_ends) == ([2], [20])
    clean = drop_contaminated(docs, items, window=3)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [2, 3, 4]
    assert scan_documents(docs.limit(0), items).count() == 0
    assert {r.n_hit for r in scan_documents(docs, items.limit(0)).collect()} == {0}


def test_large_test_sets_are_scanned_in_groups(spark):
    docs, items = tables(spark)
    whole = scan_documents(docs, items, window=3)
    parts = scan_documents(docs, items, window=3, max_chars=20)
    assert sorted(map(str, whole.collect())) == sorted(
        map(str, parts.select(whole.columns).collect()))
    assert drop_contaminated(docs, items, window=3, max_chars=20).count() == 3


def test_the_driver_holds_one_group_at_a_time(spark):
    items = spark.createDataFrame([(i, f"item {i} has words of its own") for i in range(200)],
                                  "item_id long, text string")
    n, groups = contamination._groups(items, "item_id", "text", 400)
    assert n > 20
    seen, before = [], None
    for group in groups:
        assert before is None or not before._jbroadcast.isValid()  # released
        assert sum(len(text) for _, text in group.value) < 2000
        seen += [item for item, _ in group.value]
        before = group
    assert sorted(seen, key=int) == [str(i) for i in range(200)]
    assert before.value is not None  # the last scan need not have run yet
