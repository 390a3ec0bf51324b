"""Centroid clustering over a file of cells: few bits a component decide most assignments."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.llm.common import binary_column, park
from tabweave.sources.scratch import Workspace

BITS = 8                    # of a component in the cell file, at most 8
SCALE = 1024.0              # a component x becomes floor(SCALE * x)
LARGEST = 1 << 27           # of a whole component, so that a squared distance fits 64 bits
BUCKET_ROWS = 500_000       # vectors for which a bucket is planned
STEP = 1 << 14              # vectors that a step holds at once
OUT = ("vec_id long, cluster int, distance long, cluster_inertia long, inertia long, "
       "centroid_sha256 string")


@dataclass
class Grid:
    """Cells of equal width in each dimension, from its smallest to its largest component."""

    low: np.ndarray
    width: np.ndarray
    cells: int

    @classmethod
    def of(cls, low: np.ndarray, high: np.ndarray, bits: int) -> Grid:
        cells = 1 << bits
        return cls(low, np.maximum(-(-(high - low + 1) // cells), 1), cells)

    def place(self, vectors: np.ndarray) -> np.ndarray:
        return ((vectors - self.low) // self.width).astype(np.uint8)

    def tables(self, centroids: np.ndarray) -> np.ndarray:
        """(dimension, cell, 2 * centroids): least and greatest products with each centroid."""
        least = self.low[:, None] + self.width[:, None] * np.arange(self.cells)
        products = [edge[..., None] * centroids.T[:, None] for edge in (least, least + self.width[:, None] - 1)]
        return np.concatenate([np.minimum(*products), np.maximum(*products)], axis=2)


def intervals(cells: np.ndarray, norms: np.ndarray, tables: np.ndarray, squares: np.ndarray):
    """Least and greatest squared distances of vectors from each centroid, by their cells alone.

    |x|^2 is kept with the cells, so |x|^2 - 2 x.c + |c|^2 is uncertain only in x.c, whose
    bounds are sums of table entries.
    """
    products = np.zeros((len(cells), tables.shape[2]), np.int64)
    for d, table in enumerate(tables):
        products += table[cells[:, d]]
    k = len(squares)
    fixed = norms[:, None] + squares
    return fixed - 2 * products[:, k:], fixed - 2 * products[:, :k]


def candidates(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Centroids whose interval overlaps the one with the least upper end; exactly one settles it."""
    return low <= high.min(axis=1, keepdims=True)


def nearest(vectors: np.ndarray, norms: np.ndarray, centroids: np.ndarray, open_to: np.ndarray):
    """The nearest of each vector's candidates, the smaller number on ties, and the squared distance."""
    exact = norms[:, None] + (centroids * centroids).sum(axis=1) - 2 * (vectors @ centroids.T)
    exact[~open_to] = np.iinfo(np.int64).max
    which = exact.argmin(axis=1)
    return which, exact[np.arange(len(which)), which]


def _matrix(column: pa.Array, kind: str, width: int) -> np.ndarray:
    """Rows of a fixed-width binary column."""
    return np.frombuffer(binary_column(column)[0].tobytes(), kind).reshape(-1, width)


def _blobs(rows: np.ndarray) -> pa.Array:
    """The rows of an array as a binary column."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * (rows.shape[1] * rows.itemsize)
    return pa.Array.from_buffers(
        pa.binary(), len(rows), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(rows.tobytes())])


def _masks(bits: np.ndarray) -> pa.Array:
    """Candidate sets as bytes, a bit for each centroid."""
    return _blobs(np.packbits(bits, axis=1))


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, STEP):
            yield batch.slice(start, STEP)


def whole_vectors(table: DataFrame, id_col: str, vector_col: str, dims: int) -> DataFrame:
    """(vec_id, norm, x) of the vectors that count, x as whole numbers (dims of 4 bytes).

    Others have another number of components, or one that is null or not finite.  A
    component beyond LARGEST / SCALE raises, because distances would not fit 64 bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _steps(batches):
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            whole = np.floor(values * SCALE)
            if (np.abs(whole) > LARGEST).any():
                raise ValueError(f"components must lie within {LARGEST / SCALE:g}")
            whole = whole.astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array((whole * whole).sum(axis=1)), _blobs(whole.astype("<i4"))],
                ["vec_id", "norm", "x"])

    rows = table.select(table[id_col].cast("long").alias("vec_id"),
                        table[vector_col].cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where((F.size("v") == dims) & ~bad).mapInArrow(run, "vec_id long, norm long, x binary")


def _ranges(full: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest component of each dimension; a row for each task and dimension meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high, seen = np.full(dims, LARGEST), np.full(dims, -LARGEST), False
        for batch in _steps(batches):
            if batch.num_rows:
                rows, seen = _matrix(batch.column(0), "<i4", dims), True
                low, high = np.minimum(low, rows.min(axis=0)), np.maximum(high, rows.max(axis=0))
        if seen:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(dims, dtype=np.int32)), pa.array(low), pa.array(high)], ["d", "low", "high"])

    found = full.select("x").mapInArrow(run, "d int, low long, high long").groupBy("d").agg(
        F.min("low").alias("low"), F.max("high").alias("high")).orderBy("d").collect()
    return np.array([r.low for r in found], np.int64), np.array([r.high for r in found], np.int64)


def _first(full: DataFrame, k: int, salt: str, dims: int) -> np.ndarray:
    """The k vectors whose salted id hashes lowest, in that order; of one id, the least by bytes."""
    text = F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    rows = full.select(F.sha2(text.cast("binary"), 256).alias("h"), "x").orderBy("h", "x").limit(k).collect()
    return np.array([np.frombuffer(r.x, "<i4") for r in rows], np.int64).reshape(-1, dims)


class _Buckets:
    """Tables of one clustering, all bucketed by row number alike, so that they join without a shuffle."""

    def __init__(self, spark: SparkSession, folder: str, count: int):
        self.spark, self.folder, self.count, self.names = spark, folder, count, []

    def keep(self, df: DataFrame) -> DataFrame:
        name = f"cells_{uuid.uuid4().hex}"
        df.write.bucketBy(self.count, "row").option("path", f"{self.folder}/{name}").saveAsTable(name)
        self.names.append(name)
        return self.spark.table(name)

    def close(self) -> None:
        for name in self.names:
            self.spark.sql(f"drop table if exists {name}")


def _cells(full: DataFrame, grid: Grid, dims: int) -> DataFrame:
    """(row, norm, cells): the narrow file that every round reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _steps(batches):
            cells = grid.place(_matrix(batch.column(2), "<i4", dims))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _blobs(cells)],
                                             ["row", "norm", "cells"])

    return full.select("row", "norm", "x").mapInArrow(run, "row long, norm long, cells binary")


def _judge(cells: DataFrame, grid: Grid, centroids: np.ndarray) -> DataFrame:
    """(row, old, new, mask): new is -1, and mask the candidates, where intervals overlap.

    ``cells`` has the cluster so far in ``old``.
    """
    shared = cells.sparkSession.sparkContext.broadcast(grid.tables(centroids))
    squares, dims = (centroids * centroids).sum(axis=1), centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _steps(batches):
            at = _matrix(batch.column(2), "u1", dims)
            fits = candidates(*intervals(at, batch.column(1).to_numpy(), shared.value, squares))
            new = np.where(fits.sum(axis=1) == 1, fits.argmax(axis=1), -1).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(3), pa.array(new), _masks(fits)], ["row", "old", "new", "mask"])

    return cells.select("row", "norm", "cells", "old").mapInArrow(
        run, "row long, old int, new int, mask binary")


def _settle(fetched: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(row, cluster), and what moves do to sums: rows without a number, with n and the sums.

    ``fetched`` has (row, old, mask, norm, x) of the rows whose full vectors are needed.
    """
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in _steps(batches):
            if not batch.num_rows:
                continue
            fits = np.unpackbits(_matrix(batch.column(2), "u1", -(-k // 8)), axis=1)[:, :k].astype(bool)
            vectors = _matrix(batch.column(4), "<i4", dims).astype(np.int64)
            new, _ = nearest(vectors, batch.column(3).to_numpy(), centroids, fits)
            old = batch.column(1).to_numpy()
            for j in range(k):
                to, off = (new == j) & (old != j), (old == j) & (new != j)
                n[j] += to.sum() - off.sum()
                sums[j] += vectors[to].sum(axis=0) - vectors[off].sum(axis=0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(new.astype(np.int32)), pa.nulls(len(new), pa.int64()),
                 pa.nulls(len(new), pa.list_(pa.int64()))], ["row", "cluster", "n", "sums"])
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(k, pa.int64()), pa.array(np.arange(k, dtype=np.int32)), pa.array(n),
             pa.array(sums.tolist(), pa.list_(pa.int64()))], ["row", "cluster", "n", "sums"])

    return fetched.select("row", "old", "mask", "norm", "x").mapInArrow(
        run, "row long, cluster int, n long, sums array<long>")


def _moves(settled: DataFrame, k: int, dims: int) -> tuple[list[int], list[list[int]]]:
    """What a round adds to the clusters' sizes and sums, exactly; each task sends k rows."""

    def total(column: Column) -> Column:
        return F.sum(column.cast("decimal(38,0)"))

    rows = settled.where("row is null").groupBy("cluster").agg(
        total(F.col("n")).alias("n"), F.array(*[total(F.col("sums")[d]) for d in range(dims)]).alias("s")).collect()
    sizes, sums = [0] * k, [[0] * dims for _ in range(k)]
    for r in rows:
        sizes[r.cluster], sums[r.cluster] = int(r.n), [int(x) for x in r.s]
    return sizes, sums


def _distances(fetched: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) by the full vectors; new names the cluster where it is settled."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _steps(batches):
            fits = np.unpackbits(_matrix(batch.column(1), "u1", -(-k // 8)), axis=1)[:, :k].astype(bool)
            vectors = _matrix(batch.column(3), "<i4", dims).astype(np.int64)
            which, distance = nearest(vectors, batch.column(2).to_numpy(), centroids, fits)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(which.astype(np.int32)), pa.array(distance)],
                ["vec_id", "cluster", "distance"])

    return fetched.select("vec_id", "mask", "norm", "x").mapInArrow(
        run, "vec_id long, cluster int, distance long")


def cluster(
    table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 8, rounds: int = 10,
    dims: int = 64, salt: str = "3", bits: int = BITS,
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector that counts.

    Vectors of exactly ``dims`` components, none null or non-finite, count; their components
    become floor(1024 * x).  The k vectors whose sha256 of "salt:id" is smallest start
    as centroids (fewer vectors: fewer centroids).  A round assigns every vector to the
    nearest centroid (ties: the smaller number) and moves each centroid to the exact floored
    mean of its vectors; one without vectors stays.  At the end vectors are assigned again.

    Each vector is kept twice: whole, and as a few bits a dimension with its norm.  A round
    reads the narrow file and bounds every distance by sums of table entries; where only
    one interval reaches below the least upper end, the cluster is settled.  The whole
    vectors are joined for the others alone, and for those that move, whose sums change.
    The tables are bucketed alike by row number: no round shuffles vectors, and no bucket
    is larger than another.  The driver holds centroids and their sums.  Everything is
    read from files in the shared folder, which go at the end, so a lost executor redoes
    its tasks of one step.

    Repeated rows each count.  A null id hashes as an empty one.  Without vectors that count
    the result is empty.  A component beyond 131 072 in size raises an error.
    """
    spark = table.sparkSession
    with Workspace(spark) as scratch:
        whole = scratch.keep(whole_vectors(table, id_col, vector_col, dims).withColumn(
            "row", F.monotonically_increasing_id()))
        count = whole.count()
        if not count:
            return spark.createDataFrame([], OUT)
        least = int(spark.conf.get("spark.sql.shuffle.partitions"))
        tables = _Buckets(spark, scratch.folder, max(least, -(-count // BUCKET_ROWS)))
        try:
            done, centroids = _rounds(whole, tables, k, rounds, dims, salt, bits)
        finally:
            tables.close()
    each = {r.cluster: int(r.s) for r in done.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    model = spark.createDataFrame(
        [(j, s, sum(each.values()), hashes[j]) for j, s in each.items()],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return done.join(F.broadcast(model), "cluster").select(*[c.split()[0] for c in OUT.split(", ")])


def _rounds(whole: DataFrame, tables: _Buckets, k: int, rounds: int, dims: int, salt: str, bits: int):
    """The last assignment, parked, and the final centroids."""
    full = tables.keep(whole.repartition(tables.count, "row"))
    grid = Grid.of(*_ranges(full, dims), bits)
    cells = tables.keep(_cells(full, grid, dims))
    centroids = _first(full, k, salt, dims)
    sizes, sums = [0] * len(centroids), [[0] * dims for _ in centroids]
    held = cells.withColumn("old", F.lit(-1))
    for _ in range(rounds):
        judged = tables.keep(_judge(held, grid, centroids))
        # Only these rows' whole vectors are needed: overlapping intervals, and moves.
        needed = judged.where("new = -1 or new <> old").select("row", "old", "mask")
        settled = tables.keep(_settle(full.join(needed.hint("shuffle_hash"), "row"), centroids))
        more, moved = _moves(settled, len(centroids), dims)
        sizes = [a + b for a, b in zip(sizes, more)]
        sums = [[a + b for a, b in zip(*pair)] for pair in zip(sums, moved)]
        centroids = np.array([[s // n for s in row] if n else old for row, n, old in
                              zip(sums, sizes, centroids.tolist())], np.int64)
        now = judged.select("row", "new").join(
            settled.where("row is not null").select("row", "cluster").hint("shuffle_hash"), "row", "left")
        held = cells.join(now.select("row", F.coalesce("cluster", "new").alias("old")).hint("shuffle_hash"), "row")
    judged = tables.keep(_judge(held, grid, centroids))
    return park(_distances(full.join(judged.select("row", "mask").hint("shuffle_hash"), "row"), centroids),
                "clusters"), centroids
