"""A data set for each level of indeterminacy, and its log."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession

from tabweave.plans.generate import generate
from tabweave.plans.model import Model
from tabweave.sources.csv import level_name, write_level


def write_levels(
    spark: SparkSession, model: Model, n: int, in_levels, folder: str, **options
) -> DataFrame:
    """Generate and write one CSV data set per level; returns the log.

    The log has a row for each level: in_level, time (seconds), filename.  ``options``
    go to ``generate``.  ``write_sweep`` writes all levels in one job, without times.
    """
    log = []
    for level in map(float, in_levels):
        start = time.perf_counter()
        write_level(generate(spark, model, n, [level], **options), folder, level, n)
        log.append((level, time.perf_counter() - start, level_name(level, n)))
    return spark.createDataFrame(log, "in_level double, time double, filename string")
