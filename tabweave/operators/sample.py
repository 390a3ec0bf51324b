"""An exact-size, repeatable sample without replacement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.functions.randomness import Rng
from tabweave.functions.text import double, ident
from tabweave.sources.scratch import cut_lineage

SAMPLE_LIMIT = 100_000   # fixed value: default sample size
COPIES_PER_TASK = 100_000
BITS, ROUND_BITS = 52, 13   # of a hash, and of those that a round counts by
SORTED_ROWS = 10_000        # rows with the k-th row's leading bits that are sorted


def _text(cols: list[str]) -> str:
    return "concat_ws('|', " + ", ".join(f"coalesce(cast({ident(c)} as string), '~')" for c in cols) + ")"


def _numbered_copies(df: DataFrame, text: str = "to_json(struct(*))") -> DataFrame:
    """Give equal rows distinct numbers, without gathering them in one task.

    ``text`` spells a row out; types that cannot be compared, like maps, can be
    spelled.  Copies are counted on the map side.  A row that occurs many times comes
    back as many chunks of at most COPIES_PER_TASK copies, spread over the cluster.
    """
    return (
        df.selectExpr(f"{text} as __text", "struct(*) as __row")
        .groupBy("__text").agg(F.count("*").alias("__n"), F.any_value("__row").alias("__row"))
        .selectExpr("*", f"explode(sequence(0L, __n - 1, {COPIES_PER_TASK}L)) as __from")
        .repartition("__from", "__text")
        .selectExpr(
            "__row.*", "__text",
            f"explode(sequence(__from, least(__from + {COPIES_PER_TASK}L, __n) - 1)) as __copy",
        )
    )


def _edge(hashed: DataFrame, k: int) -> tuple[int, int, int]:
    """(shift, prefix, rows): the k smallest hashes are those whose leading bits, ``__bits``
    shifted right by ``shift``, are below ``prefix``, and so many of those that equal it.

    Every round counts rows by the next ROUND_BITS bits, in the tasks first, among those that
    share the bits found so far, until few enough are left to sort.
    """
    prefix, shift = 0, BITS
    while True:
        inside = hashed if shift == BITS else hashed.where(f"shiftright(__bits, {shift}) = {prefix}L")
        shift -= ROUND_BITS
        counts = inside.groupBy(F.shiftright("__bits", shift).alias("bin")).count().collect()  # 2^ROUND_BITS at most
        for row in sorted(counts):
            prefix = row["bin"]
            if row["count"] >= k:
                break
            k -= row["count"]
        if row["count"] <= SORTED_ROWS or shift == 0:
            return shift, prefix, k


def bounded_sample(
    df: DataFrame,
    k: int = SAMPLE_LIMIT,
    key_cols: list[str] | None = None,
    rng: Rng = Rng(),
) -> DataFrame:
    """min(k, n) rows: those whose hashed key is smallest, for any k.

    ``key_cols`` should identify a row.  If they do not, or without them, all columns
    are hashed with a copy number, so that repeated rows are drawn one by one.  Select
    the wanted columns first: all of them are carried.

    A plain ``orderBy(hash).limit(k)`` would gather k rows in one task.  Here the k-th
    hash is found by histograms of its bits, in rounds that read the key columns only; the
    sample is then a filter, and only the rows that share the k-th one's leading bits, at
    most SORTED_ROWS, are sorted by hash and key.  The source is read once a round, so it
    has to give the same rows each time, as files do; numbered copies are checkpointed.
    """
    names = [ident(c) for c in df.columns]
    if key_cols is not None:
        text = _text(key_cols)
        repeated = df.selectExpr(f"{text} as key").groupBy("key").count().where("count > 1")
        if not repeated.isEmpty():
            key_cols = None
    if df.count() <= k:
        return df
    if key_cols is None:
        df, text, order = cut_lineage(_numbered_copies(df)), _text(["__text", "__copy"]), ["__text", "__copy"]
    else:
        order = [ident(c) for c in key_cols]
    # a uniform is (bits + 1/2) / 2^52, so the bits come back exactly
    hashed = df.withColumn("__bits", F.expr(f"cast(floor({rng.uniform(text, 'sample')} * {double(2.0 ** BITS)}) as bigint)"))
    if k <= 0:
        return hashed.limit(0).selectExpr(*names)
    shift, prefix, rest = _edge(hashed, k)
    lead = f"shiftright(__bits, {shift})"
    last = hashed.where(f"{lead} = {prefix}L").orderBy("__bits", *order).limit(rest)
    return hashed.where(f"{lead} < {prefix}L").selectExpr(*names).unionAll(last.selectExpr(*names))
