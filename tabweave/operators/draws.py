"""Independent draws from a law, and the empirical-quantile fallback."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.functions.normal import normal_quantile, quantile_parts
from tabweave.functions.quantiles import Draw, Params
from tabweave.functions.randomness import Rng
from tabweave.functions.repair import PERCENTILE_FLOOR, clip
from tabweave.functions.scores import ScorePolynomial, z_limit
from tabweave.functions.special import polish
from tabweave.functions.text import Sql, double
from tabweave.operators.laws import FAMILIES
from tabweave.sources.scratch import cut_lineage

Keep = Callable[[DataFrame], DataFrame]
SMALLEST = 2.0 ** -53  # the smallest uniform that Rng gives; 1 minus it is the largest
OVERSAMPLE = 2  # fixed value: values drawn per value wanted in the fallback
LARGE_BLOCK = 2_000_000  # drawn values from which a block's size goes to its rows by broadcast


def evaluate(
    rows: DataFrame,
    u: Sql,
    out: str,
    family: str,
    params: dict[str, float],
    floor: float = PERCENTILE_FLOOR,
    exact: bool = False,
) -> DataFrame:
    """Add ``out``, the family's quantile of the percentile ``u``.

    Parameters are numbers.  Families read through a score polynomial clip the
    percentile to [floor, 1 - floor]; the others take it as it is.  ``exact`` refines
    what the polynomial gives by the incomplete gamma or beta function.
    """
    f = FAMILIES[family]
    p: Params = {k: double(v) for k, v in params.items()}
    kept = rows.columns
    if f.sampler:
        raise ValueError(f"{family!r} has a sampler and no quantile: use empirical_quantile")
    if f.uses == "u" or (family == "beta" and params["a"] == params["b"] == 2.0):
        return rows.selectExpr(*kept, f"{u} as __u").selectExpr(
            *kept, f"{f.quantile(Draw(u='__u'), p)} as {out}"
        )
    rows = rows.selectExpr(*kept, f"{u} as __u").selectExpr(*kept, *quantile_parts("__u", "__n"))
    rows = rows.selectExpr(*kept, f"{normal_quantile('__n')} as __z")
    if f.uses == "z":
        return rows.selectExpr(*kept, f"{f.quantile(Draw(z='__z'), p)} as {out}")
    shapes = [params[x] / 2.0 if x == "df" else params[x] for x in f.table]
    if len(set(shapes)) == 1:
        shapes = shapes[:1]
    curve = ScorePolynomial.of(family, [(s, s) for s in shapes], floor)
    limit = z_limit(floor)
    position = curve.variables(clip("__z", -limit, limit), [double(s) for s in shapes])[0]
    score = f"({curve.score(['__t'])})"
    if exact:
        rows = rows.selectExpr(*kept, f"{position} as __t", f"{clip('__z', -limit, limit)} as __z")
        own = [params[x] / 2.0 if x == "df" else params[x] for x in f.table]
        rows = polish(rows, [(family, "__p", score, "__z", [double(s) for s in own])])
        return rows.selectExpr(*kept, f"{f.quantile(Draw(score='__p_s'), p)} as {out}")
    return rows.selectExpr(*kept, f"{position} as __t").selectExpr(
        *kept, f"{f.quantile(Draw(score=score), p)} as {out}"
    )


def draw(
    rows: DataFrame,
    key: Sql,
    out: str,
    family: str,
    params: dict[str, float],
    rng: Rng = Rng(),
    tag: str = "draw",
    exact: bool = False,
) -> DataFrame:
    """Add ``out``, an independent draw per row, from the whole range of the uniform."""
    if FAMILIES[family].sampler:
        p: Params = {k: double(v) for k, v in params.items()}
        return rows.selectExpr(*rows.columns, f"{sampled(key, family, p, rng, f'{tag}/{out}')} as {out}")
    return evaluate(rows, rng.uniform(key, f"{tag}/{out}"), out, family, params, SMALLEST, exact)


def sampled(key: Sql, family: str, params: Params, rng: Rng, tag: str) -> Sql:
    """One value of a family that has a sampler, from uniforms of its own."""
    return f"({FAMILIES[family].sampler(lambda name: rng.uniform(key, f'{tag}/{name}'), params)})"


def empirical_quantile(
    rows: DataFrame,
    key: Sql,
    block: Sql,
    percentile: Sql,
    out: str,
    family: str,
    params: dict[str, float],
    rng: Rng = Rng(),
    keep: Keep = cut_lineage,
) -> DataFrame:
    """The quantile of a sorted sample instead of a formula.

    Each block draws two values per row, sorts them, and a row at percentile p
    reads the value at position floor(p * (m - 1)) of the m drawn.  Blocks may have
    any size; rows without a block form one.  A row without a percentile gets null.
    There is no clipping on this path.
    """
    source = rows.selectExpr(
        *rows.columns, f"{key} as __key", f"struct({block} as b) as __block", f"{percentile} as __p"
    )
    keyed = source.select("__key", "__block")
    pool = None
    for i in range(OVERSAMPLE):
        part = draw(keyed, "__key", "__x", family, params, rng, tag=f"pool/{i}")
        pool = part if pool is None else pool.unionByName(part)
    return read_sorted(source, pool, out, keep=keep).select(*rows.columns, out)


def positions(pool: DataFrame, keep: Keep = cut_lineage, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(__block, __x, __at) with the position of each value in its sorted block, and the block sizes.

    The values are range-partitioned by block, value and key, so that a block, and equal
    values in it, may lie in any number of partitions.  Positions count from the rows of the
    block in the partitions before, which one row per partition tells.  The partition numbers
    are kept first, so that a lost task cannot see another split.
    """
    order = ["__block", F.col("__x").asc_nulls_last(), "__key"]
    split = keep(
        pool.repartitionByRange(*([parts] if parts else []), *order)
        .select("__block", "__x", F.spark_partition_id().alias("__part"))
    )
    pieces = split.groupBy("__part", "__block").agg(F.count("*").alias("n"))
    # only the first block of a partition can have begun before it, as the last of others
    before = (
        pieces.groupBy("__part")
        .agg(F.min("__block").alias("first"), F.max(F.struct("__block", "n")).alias("last"))
        .selectExpr("__part", "inline(array(named_struct('__block', first, 'n', 0L, 'ends', false),"
                              " named_struct('__block', last.__block, 'n', last.n, 'ends', true)))")
        .selectExpr("__part", "__block", "ends", "sum(n) over (partition by __block"
                    " order by __part, ends rows unbounded preceding) as before")
        .where("not ends").drop("ends")
    )
    inside = "row_number() over (partition by __part, __block order by __x nulls last)"
    placed = split.join(F.broadcast(before), ["__part", "__block"], "left").selectExpr(
        "__block", "__x", f"coalesce(before, 0L) + {inside} - 1L as __at"
    )
    return placed, pieces.groupBy("__block").agg(F.sum("n").alias("__m"))


def read_sorted(
    rows: DataFrame,
    pool: DataFrame,
    out: str,
    count: Sql | None = None,
    keep: Keep = cut_lineage,
    parts: int | None = None,
    large: int = LARGE_BLOCK,
) -> DataFrame:
    """Give each row (__key, __block, __p) the value at its percentile of its block's pool.

    ``pool`` is (__block, __x, __key).  ``count`` tells the values drawn for the row's block,
    if they are known; else sizes are joined: those of large blocks, one for every ``large``
    drawn values at most, by broadcast, so that no block's rows meet for it.  The look-up
    joins on block and position and spreads as the percentiles do.
    """
    placed, sizes = positions(pool, keep, parts)
    if count is not None:
        rows = rows.selectExpr("*", f"{count} as __m")
    else:
        many = sizes.where(f"__m > {large}").selectExpr("__block", "__m as __many")
        few = sizes.where(f"__m <= {large}").selectExpr("__block", "0L as __salt", "__m as __few")
        rows = (
            rows.join(F.broadcast(many), "__block", "left")
            # rows of large blocks look nothing up any more: spread them
            .selectExpr("*", "if(__many is null, 0L, 1L + pmod(xxhash64(__key), 1000L)) as __salt")
            .join(few, ["__block", "__salt"], "left")
            .selectExpr("*", "coalesce(__many, __few) as __m")
        )
    wanted = rows.selectExpr("*", "cast(floor(__p * (__m - 1L)) as bigint) as __at")
    found = placed.withColumnRenamed("__x", out)
    return wanted.join(found, ["__block", "__at"], "left")
