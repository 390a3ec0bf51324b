"""Normal scores, their correlation, and the factor that reproduces it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.functions.normal import normal_quantile, normal_quantile_array, quantile_parts
from tabweave.functions.repair import nan_to_null
from tabweave.functions.text import ident
from tabweave.operators.profile import named, tall
from tabweave.sources.scratch import cut_lineage

LOOKUP_VALUES = 200_000     # distinct values that tasks look up, of all columns together, at most
SAMPLE_CELLS = 1_000_000    # cells that blocks are cut by, at most about
BLOCK_CELLS = 200_000       # cells of a column that meet in a task, about
DEALT_CELLS = 500_000       # cells that a task deals to blocks at a time
ANSWER_CELLS = 500_000      # cells of neighbouring rows that meet in a task, at most


def normal_scores(df: DataFrame, cols: list[str]) -> DataFrame:
    """Average-rank normal scores of a bounded sample, one column per input.

    Ranks are taken within a column in one task, so the input must be bounded
    (``bounded_sample``).  For whole tables use :func:`normal_scores_at_scale`.
    """
    numbered = df.withColumn("__row", F.monotonically_increasing_id())
    by_value = "over (partition by position order by value"
    everything = f"{by_value} rows between unbounded preceding and unbounded following)"
    # the average rank is half way between the rows below a value and those up to it
    scored = (
        tall(numbered, cols, ["__row"]).where("value is not null")
        .selectExpr(
            "__row", "position",
            f"(rank() {by_value}) - 1.0D) / count(*) {everything} as below",
            f"cume_dist() {by_value}) as upto",
        )
        .selectExpr("__row", "position", "coalesce((below + upto) / 2.0D, 0.5D) as p")
        .selectExpr("__row", "position", *quantile_parts("p", "p"))
        .selectExpr("__row", "position", f"{normal_quantile('p')} as z")
    )
    return _wide(scored, cols, ["__row"]).drop("__row")


def average_ranks(
    cells: DataFrame, parts: int | None = None, keep: Callable[[DataFrame], DataFrame] = cut_lineage
) -> DataFrame:
    """Average rank of each distinct (position, value), at any table size.

    Equal values are counted on the map side, so a hot value is one row.  The
    distinct values are range-partitioned; the ranks within a partition start
    from the total of all partitions before it.  The partition numbers are
    written to the shared folder first (by ``keep``), so that a lost task cannot
    see another split than the offsets were made for.
    """
    counts = cells.groupBy("position", "value").agg(F.count("*").alias("ties"))
    ranges = ([parts] if parts else []) + ["position", "value"]
    split = keep(counts.repartitionByRange(*ranges).withColumn("part", F.spark_partition_id()))
    # one row per partition and column: small, and these sums run over it alone
    offsets = split.groupBy("position", "part").agg(F.sum("ties").alias("size")).selectExpr(
        "position", "part",
        "coalesce(sum(size) over (partition by position order by part"
        " rows between unbounded preceding and 1 preceding), 0L) as offset",
        "sum(size) over (partition by position) as n",
    )
    return (
        split.selectExpr(
            "*",
            "sum(ties) over (partition by position, part order by value rows unbounded preceding)"
            " as upto",
        )
        .join(F.broadcast(offsets), ["position", "part"])
        .selectExpr(
            "position", "value", "ties", "n", "offset + upto - (ties - 1) / 2.0D as rank"
        )
    )


@dataclass
class _Blocks:
    """How a column's values become percentiles.

    ``edges`` cut the values into blocks; block b holds edges[b - 1] <= x < edges[b].
    Where ``known`` has a percentile, all rows of the block share it: an indexed column has
    a block for each of its values, others one for each hot value.  The remaining blocks'
    cells meet in tasks, ``start`` rows of the column being below them.
    """

    edges: np.ndarray
    hot: np.ndarray | None = None
    known: np.ndarray | None = None
    start: np.ndarray | None = None
    count: int = 0

    def of(self, values: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, values, "right")

    def place(self, sizes: np.ndarray, single: np.ndarray) -> None:
        """Set starts and shared percentiles from the rows of each block."""
        self.count = int(sizes.sum())
        self.start = np.cumsum(sizes) - sizes
        rank = self.start + (sizes + 1) / 2.0
        self.known = np.where(single, (rank - 0.5) / max(self.count, 1), np.nan)


def _indexed(rows: DataFrame, cols: list[str], limit: int) -> dict[int, _Blocks]:
    """Whole value-to-percentile indexes of the columns with the fewest values, about limit values in all."""
    estimates = {r.position: r.n for r in tall(rows, cols).groupBy("position").agg(
        F.approx_count_distinct("value").alias("n")).collect()}  # a row for each column
    few, total = [], 0
    for i in sorted(estimates, key=lambda i: (estimates[i], i)):
        total += estimates[i]
        if total > limit:
            break
        few.append(i)
    if not few:
        return {}
    counts = tall(rows, [cols[i] for i in few]).where("value is not null").groupBy(
        "position", "value").agg(F.count("*").alias("ties"))
    held = counts.limit(2 * limit + 1).toArrow()
    if held.num_rows > 2 * limit:  # the estimates were far off
        return {}
    position, value, ties = (held[c].to_numpy() for c in ("position", "value", "ties"))
    found = {}
    for k, i in enumerate(few):
        own = np.flatnonzero(position == k)
        own = own[np.argsort(value[own])]
        sizes = np.concatenate([[0], ties[own]])
        found[i] = _Blocks(value[own])
        found[i].place(sizes, np.arange(len(sizes)) > 0)
    return found


def _sampled_blocks(rows: DataFrame, cols: list[str], which: list[int], n: int, block_cells: int) -> dict[int, _Blocks]:
    """Blocks of about so many cells for the other columns; a frequent value is a block by itself.

    Edges come from a sample of at most about SAMPLE_CELLS cells; the rows of each block are
    counted exactly, and the sample decides nothing but how even the blocks are.
    """
    names = [cols[i] for i in which]
    pick = F.xxhash64("__row", "position").bitwiseAND((1 << 30) - 1) < int(
        min(1.0, SAMPLE_CELLS / max(n * len(which), 1)) * (1 << 30))
    held = tall(rows, names, ["__row"]).where("value is not null").where(pick).select("position", "value").toArrow()
    position, value = held["position"].to_numpy(), held["value"].to_numpy()
    found = {}
    for k, i in enumerate(which):
        own = np.sort(value[position == k])
        pieces = max(1, -(-n // block_cells))
        cuts = own[(np.arange(1, pieces) * len(own)) // pieces] if len(own) else own
        different, times = np.unique(own, return_counts=True)
        hot = different[(times * 2 * pieces > len(own)) & (times > 10)]
        found[i] = _Blocks(np.unique(np.concatenate([cuts, hot, np.nextafter(hot, np.inf)])), hot)
    shared = rows.sparkSession.sparkContext.broadcast({i: b.edges for i, b in found.items()})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {i: np.zeros(len(e) + 1, np.int64) for i, e in shared.value.items()}
        for batch in batches:
            for k, (i, edges) in enumerate(shared.value.items()):
                x = batch.column(k).drop_null().to_numpy()
                total[i] += np.bincount(np.searchsorted(edges, x, "right"), minlength=len(edges) + 1)
        for i, sizes in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(sizes), i)), pa.array(np.arange(len(sizes))), pa.array(sizes)], ["i", "b", "n"])

    sizes = rows.select(*map(ident, names)).mapInArrow(count, "i long, b long, n long").groupBy("i", "b").agg(
        F.sum("n").alias("n")).collect()  # a row for each block
    for i, blocks in found.items():
        own = np.zeros(len(blocks.edges) + 1, np.int64)
        for r in sizes:
            if r.i == i:
                own[r.b] = r.n
        single = np.zeros(len(own), bool)
        single[blocks.of(blocks.hot)] = True
        blocks.place(own, single)
    return found


def normal_scores_at_scale(
    df: DataFrame, cols: list[str], keep: Callable[[DataFrame], DataFrame] = cut_lineage,
    lookup_values: int = LOOKUP_VALUES, block_cells: int = BLOCK_CELLS,
) -> DataFrame:
    """:func:`normal_scores` of a whole table of any size.

    Rows are numbered, and the numbers written to the shared folder (by ``keep``)
    with the columns, so that every later stage sees the same ones and equal rows
    stay apart.

    Columns with few values, about ``lookup_values`` distinct ones in all, become an index of
    sorted values that every task looks its rows up in: their cells do not move.  So do
    values of other columns that hold more than half a block of rows.  The other cells go to
    blocks of about ``block_cells``, cut by value, whose rank starts from the exact number of
    rows below, and from there back to their rows: each moves twice, in groups bounded
    by the block and by the rows of an answer.  If all columns are indexed nothing is shuffled.
    """
    d, spark, names = len(cols), df.sparkSession, cols
    cols = [f"c{i}" for i in range(d)]
    rows = keep(df.selectExpr(*(f"{nan_to_null(f'cast({ident(a)} as double)')} as {b}" for a, b in zip(names, cols)))
                .withColumn("__row", F.monotonically_increasing_id()))
    tasks = spark.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() < tasks:  # a file or two; this many of them are no more than a task's share
        rows = keep(rows.repartition(tasks))
    n = rows.count()
    blocks = _indexed(rows, cols, lookup_values)
    rest = [i for i in range(d) if i not in blocks]
    if rest:
        blocks |= _sampled_blocks(rows, cols, rest, n, block_cells)
    first = dict(zip(rest, np.cumsum([0] + [len(blocks[i].edges) + 1 for i in rest]).tolist()))
    shared = spark.sparkContext.broadcast(blocks)  # lookup_values numbers, and some for each block

    def column(batch: pa.RecordBatch | pa.Table, i: int) -> np.ndarray:
        return np.asarray(batch.column(i), float)  # null as NaN

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(d):
                x = column(batch, i)
                out.append(np.where(np.isnan(x), np.nan, shared.value[i].known[shared.value[i].of(x)]))
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(normal_quantile_array(p), from_pandas=True) for p in out), batch.column(d)],
                [*cols, "__row"])

    wide = ", ".join(f"{c} double" for c in cols)
    known = rows.mapInArrow(look_up, f"{wide}, __row long")
    if not rest:
        return known.toDF(*names, "__row").drop("__row")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) * len(rest) >= DEALT_CELLS:
                yield dealt(pa.Table.from_batches(held).combine_chunks())
                held = []
        if held:
            yield dealt(pa.Table.from_batches(held).combine_chunks())

    def dealt(table: pa.Table) -> pa.RecordBatch:
        row, parts = table.column(d).to_numpy(), []
        for i in rest:
            own, x = shared.value[i], column(table, i)
            at = np.flatnonzero(~np.isnan(x))
            block = own.of(x[at])
            moves = np.isnan(own.known[block])
            parts += _packed(block[moves] + first[i], i, row[at[moves]], x[at[moves]])
        return _packets("block", parts)

    def rank(table: pa.Table) -> pa.Table:
        i = table["position"][0].as_py()
        own, (row, x) = shared.value[i], _unpacked(table)
        _, back, ties = np.unique(x, return_inverse=True, return_counts=True)
        mean = np.cumsum(ties) - (ties - 1) / 2.0 + own.start[table["block"][0].as_py() - first[i]]
        z = normal_quantile_array((mean[back] - 0.5) / own.count)
        return pa.Table.from_batches([_packets("answer", _packed(row // answer, i, row, z))])

    def fill(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left["__row"].to_numpy()
        order = np.argsort(row)
        out = [column(left, i).copy() for i in range(d)]
        for i in np.unique(right["position"].to_numpy()):
            rows_of, z = _unpacked(right.filter(pc.equal(right["position"], i)))
            out[i][order[np.searchsorted(row, rows_of, sorter=order)]] = z
        return pa.table([pa.array(x, from_pandas=True) for x in out], list(cols))

    answer = max(1, ANSWER_CELLS // d)
    ranked = rows.mapInArrow(deal, PACKETS.format("block")).groupBy("block").applyInArrow(
        rank, PACKETS.format("answer"))
    group = F.expr(f"__row div {answer}").alias("answer")
    return known.groupBy(group).cogroup(ranked.groupBy("answer")).applyInArrow(fill, wide).toDF(*names)


PACKETS = "{} long, position int, rows binary, numbers binary"


def _packed(key: np.ndarray, position: int, row: np.ndarray, number: np.ndarray) -> list[tuple]:
    """Row numbers and numbers by key, a packet each, so that what is shuffled is few rows."""
    order = np.argsort(key, kind="stable")
    keys, begin = np.unique(key[order], return_index=True)
    row, number = row[order].astype("<i8"), number[order].astype("<f8")
    return [(int(k), position, r.tobytes(), x.tobytes())
            for k, r, x in zip(keys, np.split(row, begin[1:]), np.split(number, begin[1:]))]


def _packets(key: str, packets: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays(
        [pa.array([p[i] for p in packets], kind) for i, kind in enumerate(kinds)],
        [key, "position", "rows", "numbers"])


def _unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return (np.frombuffer(b"".join(table["rows"].to_pylist()), "<i8"),
            np.frombuffer(b"".join(table["numbers"].to_pylist()), "<f8"))


def _wide(scored: DataFrame, cols: list[str], keys: list[str]) -> DataFrame:
    """One row per key with a column per position; a row's cells meet in one list."""
    d, first = len(cols), len(keys)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column(first)
            row = np.repeat(np.arange(len(cells)), cells.value_lengths().to_numpy(zero_copy_only=False))
            position, z = (a.to_numpy(zero_copy_only=False) for a in cells.flatten().flatten())
            wide = np.full((d, len(cells)), np.nan)
            wide[position, row] = z
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(first)] + [pa.array(x, from_pandas=True) for x in wide],
                names=[*keys, *cols],
            )

    kinds = [f"{ident(f.name)} {f.dataType.simpleString()}" for f in scored.select(*keys).schema]
    return (
        scored.groupBy(*keys).agg(F.collect_list(F.struct("position", "z")).alias("__cells"))
        .mapInArrow(spread, ", ".join(kinds + [f"{ident(c)} double" for c in cols]))
    )


def pairwise_correlation(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson correlation of every column pair i < j: (col_i, col_j, rho).

    Each task multiplies its rows, batch by batch, into sums of products over the
    rows where both columns have a value, and sends one row for each pair.  The
    columns should lie around zero, as normal scores do.
    """
    d = len(cols)
    first, second = np.triu_indices(d, 1)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((6, d, d))
        for batch in batches:
            x = np.column_stack([
                np.asarray(c.cast(pa.float64()).to_numpy(zero_copy_only=False)) for c in batch.columns
            ])
            seen = (~np.isnan(x)).astype(float)
            x = np.nan_to_num(x, nan=0.0)
            square = x * x
            total += np.stack([
                seen.T @ seen, x.T @ seen, seen.T @ x, square.T @ seen, seen.T @ square, x.T @ x
            ])
        yield pa.RecordBatch.from_arrays(
            [pa.array(first.astype(np.int32)), pa.array(second.astype(np.int32)),
             *(pa.array(t[first, second]) for t in total)],
            ["i", "j", "n", "sx", "sy", "sxx", "syy", "sxy"],
        )

    sums = ["n", "sx", "sy", "sxx", "syy", "sxy"]
    numbers = [f"cast({ident(c)} as double) as c{i}" for i, c in enumerate(cols)]
    spread = "(n * sxx - sx * sx) * (n * syy - sy * sy)"
    return (
        df.selectExpr(*numbers)
        .mapInArrow(products, "i int, j int, " + ", ".join(f"{s} double" for s in sums))
        .groupBy("i", "j").agg(*(F.sum(s).alias(s) for s in sums))
        .selectExpr(
            f"{named(cols, 'i')} as col_i", f"{named(cols, 'j')} as col_j",
            f"if({spread} > 0, try_divide(n * sxy - sx * sy, sqrt({spread})), null) as rho",
        )
    )


def correlation_factor(rho: np.ndarray) -> np.ndarray:
    """Lower-triangular L with L L' = rho, after making rho positive definite."""
    rho = np.nan_to_num(np.array(rho, dtype=float), nan=0.0)
    np.fill_diagonal(rho, 1.0)
    rho = (rho + rho.T) / 2.0
    values, vectors = np.linalg.eigh(rho)
    if values.min() < 1e-10:
        rho = (vectors * np.maximum(values, 1e-10)) @ vectors.T
        size = np.sqrt(np.diag(rho))
        rho = rho / np.outer(size, size)
    return np.linalg.cholesky(rho)
