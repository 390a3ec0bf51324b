"""Embedding near-dedup against brute force, and odd inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabweave.llm import vector_graph as graph


def clustered(rng, n, dims=16, groups=12):
    centres = rng.normal(size=(groups, dims))
    near = centres[rng.integers(0, groups, n // 2)] + rng.normal(size=(n // 2, dims)) * 0.12
    return np.concatenate([near, rng.normal(size=(n - n // 2, dims))])


def brute(ids, vectors, cosine=0.9):
    units = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    links = units @ units.T >= cosine
    a, b = np.nonzero(links)
    root = np.arange(len(ids))
    while True:
        before = root.copy()
        np.minimum.at(root, a, root[b])
        root = root[root]
        if (root == before).all():
            break
    least = {r: min(ids[i] for i in np.flatnonzero(root == r)) for r in set(root.tolist())}
    return {i: (int(links[k].sum()) - 1, least[int(root[k])]) for k, i in enumerate(ids)}


def table(spark, ids, vectors):
    return spark.createDataFrame(
        [(int(i), [float(x) for x in v], "c") for i, v in zip(ids, vectors)],
        "vec_id long, embedding array<double>, n_links string")


def test_graph_search_reaches_every_group():
    rng = np.random.default_rng(0)
    vectors = clustered(rng, 1500)
    units = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    found = graph.range_search(units, graph.build_graph(units), graph.medoid(units), units, 0.9)
    true = units @ units.T >= 0.9
    assert not (found & ~true).any()
    assert (found & true).sum() >= 0.98 * true.sum()


@pytest.mark.parametrize("block", [4096, 150])
def test_index(spark, monkeypatch, block):
    """One shard; and many splits, overlapping shards, and dense shards searched in blocks."""
    monkeypatch.setattr(graph, "BLOCK", block)
    monkeypatch.setattr(graph, "SHARD", min(700, block // 2))
    monkeypatch.setattr(graph, "LEVELS", 2)
    rng = np.random.default_rng(1)
    vectors = clustered(rng, 1200, groups=2 if block < 1000 else 12)
    ids = np.arange(len(vectors)) * 7 % 1201
    df = table(spark, ids, vectors)
    found = graph.near_duplicates(df).cache()
    expected = brute(ids.tolist(), vectors)
    rows = {r.vec_id: r for r in found.collect()}
    links = sum(r.n_links for r in rows.values()), sum(n for n, _ in expected.values())
    assert 0.95 * links[1] <= links[0] <= links[1]
    assert all(rows[i].n_links <= n for i, (n, _) in expected.items())
    right = np.mean([rows[i].component_id == c for i, (_, c) in expected.items()])
    assert right >= 0.98
    assert all(r.kept == (r.vec_id == r.component_id) for r in rows.values())
    ours, truth, recall = graph.audit(df, found, every=10)
    assert truth == sum(n for i, (n, _) in expected.items() if i % 10 == 0) and recall >= 0.9


def test_table_recall(spark):
    """The given vectors, none of which are near each other, and jittered copies of them."""
    plain = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").selectExpr("vec_id", "embedding")
    jitter = F.expr("""transform(embedding, (x, i) -> x * (0.8D + 0.4D *
        (pmod(xxhash64(vec_id, copy, i), 1000) / 1000.0D)))""")
    near = plain.withColumn("copy", F.explode(F.expr("sequence(1, if(vec_id % 100 = 7, 40, 2))")))
    df = plain.union(near.select(F.expr("vec_id * 100 + copy + 1000000"), jitter))
    ours, truth, recall = graph.audit(df, graph.near_duplicates(df), every=1)
    assert truth > 10_000 and recall >= 0.9


@pytest.mark.parametrize("block", [4096, 100])
def test_lengths_are_groups_of_their_own(spark, monkeypatch, block):
    monkeypatch.setattr(graph, "BLOCK", block)
    monkeypatch.setattr(graph, "SHARD", min(700, block // 2))
    few = spark.createDataFrame(
        [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [1.0, 0.0, 0.0]), (5, [1.0, 0.0, 0.0])],
        "vec_id long, embedding array<double>")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in graph.near_duplicates(few).collect())
    assert got == [(1, 1, 1), (2, 1, 1), (3, 0, 3), (4, 1, 4), (5, 1, 4)]
    rng = np.random.default_rng(5)
    parts = [(np.arange(300) * 2 + k, clustered(rng, 300, dims)) for k, dims in ((0, 16), (1, 12))]
    df = table(spark, *parts[0]).union(table(spark, *parts[1]))
    found = graph.near_duplicates(df).cache()
    rows = {r.vec_id: r for r in found.collect()}
    expected = {i: v for ids, vectors in parts for i, v in brute(ids.tolist(), vectors).items()}
    assert rows.keys() == expected.keys()
    assert np.mean([rows[i].component_id == c for i, (_, c) in expected.items()]) >= 0.98
    ours, truth, recall = graph.audit(df, found, every=1)
    assert truth == sum(n for n, _ in expected.values()) and recall >= 0.95


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(5, [1.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (9, [2.0, 0.1]), (1, [0.0, 0.0]), (2, None),
            (4, [nan, 1.0]), (6, [1.0, inf]), (7, [1.0, None]), (8, [1.0, 0.0, 0.0]), (10, []),
            (None, [-1.0, 0.0]), (11, [1e300, 0.0]), (12, [-1e-300, 0.0])]
    df = spark.createDataFrame([(i, v, i) for i, v in rows], "vec_id long, embedding array<double>, kept long")
    found = graph.near_duplicates(df)
    got = sorted((-1 if r.vec_id is None else r.vec_id, r.n_links, r.component_id, r.kept) for r in found.collect())
    alone = [(i, 0, i, True) for i in (1, 2, 4, 6, 7, 8, 10)]
    assert got == sorted(alone + [(-1, 1, 12, False), (12, 1, 12, True), (3, 4, 3, True), (3, 4, 3, True),
                                  (5, 4, 3, False), (9, 4, 3, False), (11, 4, 3, False)])
    assert graph.near_duplicates(df.limit(0)).count() == 0
    assert graph.near_duplicates(df.where("vec_id is null").withColumn("vec_id", F.lit(None).cast("long"))).first().component_id is None
    whole = spark.createDataFrame([(1, [0.5, 0.5]), (2, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [r.n_links for r in graph.near_duplicates(whole).collect()] == [1, 1]
