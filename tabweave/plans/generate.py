"""Generation: a shuffle-free projection over row ids.

    row id -> its block's indeterminacy factors, and independent normals
           -> correlated normals -> percentiles (or scores)
           -> values -> repair, clip, zeros

Each arrow is one projection whose outputs the next one uses several times;
Catalyst therefore keeps them apart and evaluates none of them twice.  Only a column
whose family has no quantile function needs more: its block's sorted sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tabweave.functions.normal import normal_cdf, normal_quantile, quantile_parts
from tabweave.functions.quantiles import Draw
from tabweave.functions.randomness import Rng, between
from tabweave.functions.repair import (
    PERCENTILE_FLOOR, ZERO_RATIO_MIN, clip, clip_range, inject_zero, repair,
)
from tabweave.functions.scores import ScorePolynomial, z_limit
from tabweave.functions.special import polish
from tabweave.functions.text import Sql, double, ident
from tabweave.operators.dependence import correlation_factor
from tabweave.operators.draws import OVERSAMPLE, Keep, read_sorted, sampled
from tabweave.operators.frequencies import draw_category
from tabweave.operators.laws import FAMILIES
from tabweave.operators.uncertainty import (
    BLOCK_ROWS, MODES, FactorOf, fallback_normal, widen,
)
from tabweave.plans.model import Model
from tabweave.sources.scratch import cut_lineage

ROWS_PER_PARTITION = 4_000_000
LITERAL_COLUMNS = 40  # up to here the copula's weights are literals of the plan
HUGE_METHOD = "spark.sql.codegen.hugeMethodLimit"
OUTSIDE_LOW, OUTSIDE_HIGH = 0.001, 0.999  # fixed values: percentiles outside the copula


@dataclass
class _Column:
    """A modelled column on its way through the plan."""

    name: str
    no: int
    family: str | None
    params: dict[str, float | None]
    stats: dict
    score: ScorePolynomial | None = None
    factor_of: FactorOf = lambda name: "1.0D"
    polished: bool = False

    @property
    def uses(self) -> str:
        """The part of the draw its quantile function reads."""
        if self.score is not None:
            return "score"
        if self.family is None:
            return "z"
        uses = FAMILIES[self.family].uses
        return "u" if uses == "score" else uses

    @property
    def sampled(self) -> bool:
        """Its quantiles come from a sorted sample."""
        return self.family is not None and not self.undefined and FAMILIES[self.family].sampler is not None

    @property
    def undefined(self) -> bool:
        """A law whose shape could not be fitted: every value gets repaired."""
        return self.family is not None and any(v is None for v in self.params.values())

    def __call__(self, label: str) -> Sql:
        return f"__{label}_{self.no}"


def _per_level(levels: list[float]) -> Sql:
    """The level of a row, from its level number."""
    if len(levels) == 1:
        return double(levels[0])
    cases = " ".join(f"when {i} then {double(v)}" for i, v in enumerate(levels[:-1]))
    return f"(case __level {cases} else {double(levels[-1])} end)"


def _check_levels(in_levels) -> list[float]:
    levels = [float(x) for x in in_levels]
    if not levels or any(not 0.0 <= x < 1.0 for x in levels):
        raise ValueError("indeterminacy levels must lie in [0, 1)")
    if len(set(levels)) != len(levels):
        raise ValueError("indeterminacy levels must differ")
    return levels


def default_partitions(spark: SparkSession, rows: int) -> int:
    """Enough partitions to fill the cluster and to keep each one moderate."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // ROWS_PER_PARTITION))


def generate(
    spark: SparkSession,
    model: Model,
    n: int | None = None,
    in_levels=(0.0,),
    *,
    ids: DataFrame | None = None,
    rng: Rng = Rng(),
    fuzz: str = "shared",
    copula: bool = True,
    percentile_floor: float = PERCENTILE_FLOOR,
    block_rows: int = BLOCK_ROWS,
    num_partitions: int | None = None,
    keep_id: bool = False,
    keep_level: bool | None = None,
    exact: bool = False,
    keep: Keep = cut_lineage,
) -> DataFrame:
    """n synthetic rows per indeterminacy level, lazily and without a shuffle.

    A row depends on (model, id, level, seed, block_rows) only: not on n, the
    number of partitions, the cluster or retries.  ``ids`` replaces the row ids
    0..n-1 by the ``id`` column of a table.  ``block_rows`` rows in a row, by id,
    share one indeterminacy draw.  ``copula=False`` draws the columns
    independently.  ``exact=True`` refines gamma, beta and chi-squared quantiles by the
    incomplete gamma and beta functions, in Python workers batch by batch; else their
    relative error is that of the score polynomials.  Columns come back as doubles in
    source order.

    A column whose family has a sampler only (``register_family``) is read from a sample of
    its block, of any size, which is sorted across the cluster and written by ``keep`` (a
    ``Workspace``'s, to remove it afterwards).  It is neither repaired nor clipped, and
    depends on the ids of its block as well; ``ids`` must then give the same rows each time.
    """
    levels = _check_levels(in_levels)
    if (n is None) == (ids is None):
        raise ValueError("give either n or ids")
    if fuzz not in MODES:
        raise ValueError(f"fuzz must be one of {sorted(MODES)}")
    columns = []
    for no, name in enumerate(model.columns):
        if not model.statistics[name]["is_binary"]:
            family, params = model.law_of.get(name, (None, {}))
            columns.append(_Column(name, no, family, params, model.statistics[name]))
    _attach_scores(columns, max(levels), fuzz == "independent", percentile_floor)

    tune(spark)
    if ids is not None:
        rows = _rows_of(ids, len(levels), block_rows)
    else:
        n = int(n)
        parts = num_partitions or default_partitions(spark, n * len(levels))
        rows = _rows(spark, n, len(levels), block_rows, parts)
    in_level = _per_level(levels)
    factors = _factors(columns, rng, fuzz, in_level if max(levels) > 0.0 else None)
    pool = rows.selectExpr("id", "__level", "__block", *factors)
    rows = _draws(rows, factors, columns, model, rng, percentile_floor, copula, exact)
    if exact:
        rows = _polished(rows, columns)
    for c in columns:
        if c.sampled:
            rows = _from_sample(rows, pool, c, rng, block_rows, n, keep)
    keep_level = len(levels) > 1 if keep_level is None else keep_level
    head = (["id"] if keep_id else []) + ([f"{in_level} as in_level"] if keep_level else [])
    return _values(rows, columns, model, rng, head)


def tune(spark: SparkSession) -> None:
    """Let Spark split the code of wide projections.

    HotSpot does not compile methods above 8000 bytes and then interprets them,
    an order of magnitude slower.  Spark's own default allows 65535.  A session
    that sets the limit itself keeps its value.
    """
    if HUGE_METHOD not in spark.conf.getAll:
        spark.conf.set(HUGE_METHOD, "8000")


def _rows(spark, n: int, n_levels: int, size: int, parts: int) -> DataFrame:
    """(id, level, block).  The rows of a level are neighbours, so that a task,
    and hence its output files, sees one or two levels."""
    numbers = spark.range(0, n * n_levels, 1, max(1, min(parts, n * n_levels)))
    if n_levels == 1:
        return numbers.selectExpr("id", "0 as __level", f"id div {size}L as __block")
    per_level = max(n, 1)
    return numbers.selectExpr(
        f"id % {per_level}L as id",
        f"cast(id div {per_level}L as int) as __level",
        f"(id % {per_level}L) div {size}L as __block",
    )


def _rows_of(ids: DataFrame, n_levels: int, size: int) -> DataFrame:
    """The same for the ids of a table."""
    every = ", ".join(map(str, range(n_levels)))
    level = f"explode(array({every}))" if n_levels > 1 else "0"
    return ids.selectExpr("id", f"{level} as __level", f"cast(id as bigint) div {size}L as __block")


def _attach_scores(columns, top_level: float, independent: bool, floor: float) -> None:
    """Fit the score polynomials the model needs; equal shapes share one."""
    known = {}
    for c in columns:
        if c.family is None or FAMILIES[c.family].uses != "score" or c.undefined:
            continue
        shape = [c.params[p] for p in FAMILIES[c.family].table]
        if c.family == "beta" and top_level == 0.0 and shape == [2.0, 2.0]:
            continue  # closed form
        ranges = []
        for value in shape:
            low, high = value * (1.0 - top_level), value * (1.0 + top_level)
            if c.family == "chi2":  # the shape is half the whole degrees of freedom
                low, high = max(int(low), 1) / 2.0, max(int(high), 1) / 2.0
            ranges.append((low, high))
        if c.family == "beta" and not independent and shape[0] == shape[1]:
            ranges = ranges[:1]
        key = (c.family, *ranges)
        if key not in known:
            known[key] = ScorePolynomial.of(c.family, ranges, floor)
        c.score = known[key]


def _factors(columns, rng, fuzz: str, in_level: Sql | None) -> list[Sql]:
    """One column per indeterminacy factor; sets each column's ``factor_of``."""
    out = []
    if in_level is None:
        return out
    for c in columns:
        if c.family is not None and fuzz == "shared":
            g = MODES["shared"](rng, "__block", in_level, c.name)("")
            out.append(f"{g} as {c('g')}")
            c.factor_of = lambda name, c=c: c("g")
        else:
            factor_of = MODES["independent"](rng, "__block", in_level, c.name)
            out += [f"{factor_of(p)} as {c('g_' + p)}" for p in c.params or ("loc", "scale")]
            c.factor_of = lambda name, c=c: c("g_" + name)
    return out


def _parameters(c: _Column) -> dict[str, Sql]:
    """The column's widened parameters."""
    if c.family is None:
        p = fallback_normal(c.stats["mean_nonzero"], c.stats["std_nonzero"], c.factor_of)
    else:
        p = widen({
            k: "cast(null as double)" if v is None else f"{int(v)}L" if k == "df" else double(v)
            for k, v in c.params.items()
        }, c.factor_of)
    return {k: f"({v})" for k, v in p.items()}


def _draws(rows, factors, columns, model, rng, floor, copula, exact) -> DataFrame:
    """Attach each column's draw: z, u, or the variables of its score."""
    carried = ["id", "__level"] + [f.rsplit(" as ", 1)[1] for f in factors]
    if copula and columns:
        polar, normals = [], []
        for i in range((len(columns) + 1) // 2):
            radius, angle = rng.polar("id", f"copula/{i}")
            polar += [f"{radius} as __r{i}", f"{angle} as __a{i}"]
            normals += [f"__r{i} * cos(__a{i}) as __e{2 * i}", f"__r{i} * sin(__a{i}) as __e{2 * i + 1}"]
        factor = correlation_factor(model.correlation_matrix([c.name for c in columns]))
        limit = z_limit(floor)
        rows = (
            rows.selectExpr("id", "__level", *factors, *polar)
            .selectExpr(*carried, *normals[: len(columns)])
        )
        if len(columns) > LITERAL_COLUMNS:
            rows = _multiplied(rows, carried, factor)
            sums = [f"__e{i}" for i in range(len(columns))]
        else:
            sums = [" + ".join(f"{double(w)} * __e{j}" for j, w in enumerate(row) if w != 0.0)
                    for row in factor]
        rows = rows.selectExpr(*carried, *(
            f"{clip(total, -limit, limit)} as {c('z')}" for c, total in zip(columns, sums)
        ))
    else:
        from_u = [c for c in columns if c.uses != "u"]
        plain = [c("u") for c in columns if c.uses == "u"]
        rows = rows.selectExpr("id", "__level", *factors, *(
            f"{between(rng.uniform('id', c.name + '/u'), OUTSIDE_LOW, OUTSIDE_HIGH)} as {c('u')}"
            for c in columns
        )).selectExpr(*carried, *plain, *(
            part for c in from_u for part in quantile_parts(c("u"), c("u"))
        )).selectExpr(*carried, *plain, *(
            f"{normal_quantile(c('u'))} as {c('z')}" for c in from_u
        ))
    parts = []
    for c in columns:
        if c.uses == "score":
            p = _parameters(c)
            names = FAMILIES[c.family].table[: len(c.score.axes)]
            shapes = [f"({p[x]} * 0.5D)" if x == "df" else p[x] for x in names]
            found = c.score.variables(c("z"), shapes)
            parts += [f"{v} as {c(f'v{i}')}" for i, v in enumerate(found)] + [c("z")] * exact
        elif c.uses == "u" and copula:
            parts.append(f"{normal_cdf(c('z'))} as {c('u')}")
        else:
            parts.append(c(c.uses))
    return rows.selectExpr(*carried, *parts)


def _multiplied(rows: DataFrame, carried: list[str], factor: np.ndarray) -> DataFrame:
    """The normals __e0, __e1, ... times the factor, in batches outside the plan's text.

    Written out, the weights of d columns are d * d / 2 literals.  Here they go to the
    tasks as one matrix.  Terms are added in the same order, so values are the same.
    """
    d, first = len(factor), len(carried)
    shared = rows.sparkSession.sparkContext.broadcast(factor)  # d * d doubles

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for batch in batches:
            total = np.zeros((d, batch.num_rows))
            for j in range(d):
                total[j:] += weights[j:, j:j + 1] * batch.column(first + j).to_numpy()
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(first)] + [pa.array(z) for z in total],
                schema=batch.schema,
            )

    return rows.mapInArrow(multiply, rows.schema)


def _score(c: _Column) -> Sql:
    """The column's score polynomial over its variables."""
    count = 1 + sum(not axis.fixed for axis in c.score.axes)
    return c.score.score([c(f"v{i}") for i in range(count)])


def _polished(rows: DataFrame, columns: list[_Column]) -> DataFrame:
    """Exact scores next to the polynomials' variables."""
    items = []
    for c in columns:
        if c.score is not None:
            p, c.polished = _parameters(c), True
            shapes = [f"({p[x]} * 0.5D)" if x == "df" else p[x] for x in FAMILIES[c.family].table]
            items.append((c.family, c("p"), _score(c), c("z"), shapes))
    return polish(rows, items) if items else rows


def _from_sample(rows, pool, c: _Column, rng, size: int, n: int | None, keep: Keep) -> DataFrame:
    """Add the column's value: its percentile of the sorted draws of its level and block."""
    block = "struct(__level, {} as b) as __block".format
    draws, p = None, _parameters(c)
    for i in range(OVERSAMPLE):
        value = sampled("id", c.family, p, rng, f"{c.name}/pool/{i}")
        part = pool.selectExpr(block("__block"), f"{value} as __x", "id as __key")
        draws = part if draws is None else draws.unionByName(part)
    source = rows.selectExpr(
        "*", "id as __key", block(f"cast(id as bigint) div {size}L"), f"{c('u')} as __p")
    count = None if n is None else f"{OVERSAMPLE}L * least({size}L, {n}L - __block.b * {size}L)"
    return read_sorted(source, draws, c("x"), count, keep).select(*rows.columns, c("x"))


def _quantile(c: _Column) -> Sql:
    if c.undefined:
        return "cast(null as double)"
    if c.sampled:
        return c("x")
    quantile, p = FAMILIES[c.family or "normal"].quantile, _parameters(c)
    if c.score is None:
        return quantile(Draw(**{c.uses: c(c.uses)}), p)
    return quantile(Draw(score=c("p") + "_s" if c.polished else _score(c)), p)


def _values(rows, columns, model, rng, head) -> DataFrame:
    """Quantiles, then repair, range clip and zero injection, then assembly."""
    raw = [f"{_quantile(c)} as {c('x')}" for c in columns]
    raw += [f"{_parameters(c)['loc']} as {c('mu')}" for c in columns if c.family is None]
    rows = rows.selectExpr("id", "__level", *raw)

    by_name = {c.name: c for c in columns}
    out = list(head)
    for name in model.columns:
        s = model.statistics[name]
        if name not in by_name:
            x = draw_category(rng.uniform("id", f"{name}/category"), model.categories.get(name, []))
        else:
            c = by_name[name]
            if c.family is None:
                x = repair(c("x"), c("mu"))
            elif c.sampled:
                x = c("x")
            else:
                x = repair(c("x"), s["mean_nonzero"], s["max"], s["min"])
                x = clip_range(x, s["min"], s["max"])
            if s["zero_ratio"] is not None and s["zero_ratio"] > ZERO_RATIO_MIN:
                x = inject_zero(x, rng.uniform("id", f"{name}/zero"), s["zero_ratio"])
        out.append(f"{x} as {ident(name)}")
    return rows.selectExpr(*out)
