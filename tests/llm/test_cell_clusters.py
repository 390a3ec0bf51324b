"""Centroid clustering over cells: bounds, whole runs against brute force, odd rows."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabweave.llm import cell_clusters as cells

SCHEMA = "vec_id long, embedding array<double>, cluster int, x string, row long"


def brute(rows, k, rounds, dims):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and None not in v and np.isfinite(v).all():
            kept.append((i, np.floor(1024 * np.array(v)).astype(np.int64)))
    if not kept:
        return []
    key = lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1].astype("<i4").tobytes())
    vectors = np.array([v for _, v in kept])
    centroids = np.array([v for _, v in sorted(kept, key=key)[:k]])
    for _ in range(rounds + 1):
        distances = ((vectors[:, None] - centroids) ** 2).sum(axis=2)
        which, last = distances.argmin(axis=1), centroids
        centroids = np.array([vectors[which == j].sum(axis=0) // (which == j).sum() if (which == j).any() else c
                              for j, c in enumerate(centroids)])
    own = distances[np.arange(len(which)), which]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in last.tolist()]
    return sorted([(i, int(j), int(d), int(own[which == j].sum()), int(own.sum()), digest[j])
                   for (i, _), j, d in zip(kept, which, own)], key=repr)


def run(spark, rows, **options):
    table = spark.createDataFrame([(i, v, 1, "y", 2) for i, v in rows], SCHEMA)
    return sorted(map(tuple, cells.cluster(table, **options).collect()), key=repr)


@settings(max_examples=50, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 8), st.integers(1, 9), st.sampled_from([3, 700, 10**6]))
def test_intervals_hold_the_distances(seed, bits, k, size):
    rng = np.random.default_rng(seed)
    vectors, centroids = rng.integers(-size, size, (60, 5)), rng.integers(-size, size, (k, 5))
    grid = cells.Grid.of(vectors.min(axis=0), vectors.max(axis=0), bits)
    norms, squares = (vectors**2).sum(axis=1), (centroids**2).sum(axis=1)
    low, high = cells.intervals(grid.place(vectors), norms, grid.tables(centroids), squares)
    exact = ((vectors[:, None] - centroids) ** 2).sum(axis=2)
    assert (low <= exact).all() and (exact <= high).all()
    fits = cells.candidates(low, high)
    assert fits[np.arange(60), exact.argmin(axis=1)].all()
    which, distance = cells.nearest(vectors, norms, centroids, fits)
    assert (which == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()


@pytest.mark.parametrize("bits", [2, 8])
def test_brute_force(spark, bits):
    rng = np.random.default_rng(bits)
    centres = rng.normal(0, 0.2, (5, 6))
    vectors = centres[rng.integers(0, 5, 400)] + rng.normal(0, 0.08, (400, 6))
    rows = [(i * 7 % 401, v.tolist()) for i, v in enumerate(vectors)] + [(900 + i, vectors[0].tolist()) for i in range(150)]
    assert run(spark, rows, k=4, rounds=6, dims=6, bits=bits) == brute(rows, 4, 6, 6)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    bad = [(1, None), (2, []), (3, [1.0]), (4, [1.0, nan]), (5, [inf, 0.0]), (6, [None, 0.0]), (7, [0.0, 1.0, 2.0])]
    good = [(8, [0.5, -0.25]), (8, [0.5, -0.25]), (None, [0.1, 0.1]), (9, [-0.0001, 0.0]), (10, [0.5, -0.25])]
    assert run(spark, bad + good, k=8, rounds=3, dims=2) == brute(bad + good, 8, 3, 2)
    assert run(spark, good, k=2, rounds=10, dims=2) == brute(good, 2, 10, 2)
    assert run(spark, bad, dims=2) == [] and run(spark, [], dims=2) == []
    with pytest.raises(Exception, match="components must lie within 131072"):
        run(spark, [(1, [1e9, 0.0])], dims=2)


def test_rounds_shuffle_no_vectors(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    with cells.Workspace(spark) as scratch:
        whole = scratch.keep(cells.whole_vectors(table, "vec_id", "embedding", 64).withColumn(
            "row", F.monotonically_increasing_id()))
        tables = cells._Buckets(spark, scratch.folder, 8)
        full = tables.keep(whole.repartition(8, "row"))
        grid = cells.Grid.of(*cells._ranges(full, 64), 8)
        narrow = tables.keep(cells._cells(full, grid, 64))
        centroids = cells._first(full, 8, "3", 64)
        judged = tables.keep(cells._judge(narrow.withColumn("old", F.lit(0)), grid, centroids))
        overlapping = judged.where("new = -1")
        assert 0 < overlapping.count() < 400  # of 500: the cells settle the rest
        fetched = full.join(overlapping.hint("shuffle_hash"), "row")
        assert fetched.count() == overlapping.count()
        plan = fetched._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan and "Exchange" not in plan and plan.count("Bucketed: true") == 2
        tables.close()
