"""SimHash near-dedup against brute force, and odd inputs."""

import numpy as np
import pytest
import xxhash
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabweave.llm import simhash
from tabweave.llm.components import components


def brute_print(text, words=4):
    found = (text or "").encode().lower().split()
    shingles = [b" ".join(found[i:i + words]) for i in range(max(1, len(found) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles] if found else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, max_bits=4):
    """Smallest id reachable, for (id, print) rows."""
    label = list(range(len(prints)))
    def find(i):
        while label[i] != i:
            i = label[i]
        return i
    for i, (_, p) in enumerate(prints):
        for j in range(i):
            if (p ^ prints[j][1]).bit_count() <= max_bits:
                a, b = sorted((find(i), find(j)))
                label[b] = a
    roots = [find(i) for i in range(len(prints))]
    least = {r: min(prints[i][0] for i in range(len(prints)) if roots[i] == r) for r in set(roots)}
    return [least[r] for r in roots]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def expect(rows):
    prints = [(i, brute_print(t)) for i, t in rows]
    return sorted((i, signed(p), c) for (i, p), c in zip(prints, brute_components(prints)))


def got(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((r.doc_id, r.fp, r.component_id) for r in simhash.near_copies(docs).collect())


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(spark, rows) == expect(rows)


def test_dense_groups_keep_every_link(spark, monkeypatch):
    """Hot chains: thousands of fingerprints a few flips from two centres and each other."""
    rng = np.random.default_rng(3)
    centres = [int(x) for x in rng.integers(0, 2**63, 3)]
    values = {int(x) for x in rng.integers(0, 2**63, 200)}
    for centre in centres:
        walk = centre
        for _ in range(150):
            walk ^= sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 8), replace=False))
            values.add(walk & (2**64 - 1))
            values.add(centre ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))))
    rows = [(i, v) for i, v in enumerate(sorted(values))]
    nodes = spark.createDataFrame([(signed(v),) for _, v in rows], "fp long")
    links = simhash.links(nodes, 4, hot=4)
    found = {r.node: r.component for r in components(links).collect()}
    ours = {}
    for i, v in rows:
        ours.setdefault(found.get(signed(v), signed(v)), []).append(i)
    theirs = {}
    for (i, _), c in zip(rows, brute_components(rows)):
        theirs.setdefault(c, []).append(i)
    assert sorted(ours.values()) == sorted(theirs.values())
    distances = links.select(F.bit_count(F.expr("a ^ b")).alias("d")).agg(F.max("d")).first()[0]
    assert distances <= 4


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=4))
def test_some_chain_holds(value, flips):
    """Without Spark: the pigeonring bound that the filter rests on."""
    other = value
    for bit in flips:
        other ^= 1 << bit
    ring = simhash.segments(4)
    boxes = [((value ^ other) >> o & ((1 << w) - 1)).bit_count() for o, w in ring]
    assert any(all(sum(boxes[(s + k) % 5] for k in range(n)) <= n * 4 // 5 for n in range(1, 6))
               for s in range(5))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB \t\n\x1c\x85 é ", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(simhash.shingle_hashes(text.encode(), 4)) == brute_print(text)


def test_odd_rows_and_keep_one(spark):
    text = "one two three four five six"
    rows = [(4, text, "a"), (2, text.upper(), "b"), (9, None, "c"), (7, "", "d"), (8, " \t", "e"),
            (None, text, "f"), (2, text.upper(), "b"), (11, "w " * 200_000, "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    found = simhash.near_copies(docs)
    assert {(r.doc_id, r.component_id) for r in found.collect()} == {
        (4, 2), (2, 2), (None, 2), (9, 7), (7, 7), (8, 7), (11, 11)}
    assert found.count() == 8
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.fp) for r in kept.collect()) == [(2, "b"), (7, "d"), (11, "g")]
    nobody = spark.createDataFrame([(None, text), (None, text)], "doc_id long, text string")
    assert simhash.keep_one(nobody).count() == 1
    assert simhash.near_copies(docs.limit(0)).count() == 0
