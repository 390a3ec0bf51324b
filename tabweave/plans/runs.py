"""Summaries of run logs: repeated timings by size, two-phase timings, file logs.

A run log is a table with one row per run.  A skipped or failed run has a null
time, which every mean and standard deviation leaves out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_summary(runs: DataFrame) -> DataFrame:
    """Mean and sample std per size, and the speed-up of the distributed leg.

    ``runs``: size, spark_time, seq_time.
    """
    return runs.groupBy("size").agg(
        F.avg("spark_time").alias("spark_mean"),
        F.stddev_samp("spark_time").alias("spark_std"),
        F.avg("seq_time").alias("seq_mean"),
        F.stddev_samp("seq_time").alias("seq_std"),
    ).withColumn("speedup", F.try_divide("seq_mean", "spark_mean"))


def two_phase_summary(runs: DataFrame) -> DataFrame:
    """Mean and std of training, sampling and their total per size.

    ``runs``: size, train_time, sample_time.  The phases count as independent,
    so the variances add up.
    """
    return runs.groupBy("size").agg(
        F.avg("train_time").alias("train_mean"),
        F.stddev_samp("train_time").alias("train_std"),
        F.avg("sample_time").alias("sample_mean"),
        F.stddev_samp("sample_time").alias("sample_std"),
    ).selectExpr(
        "*",
        "train_mean + sample_mean as total_mean",
        "sqrt(train_std * train_std + sample_std * sample_std) as total_std",
    )


def presentation(summary: DataFrame) -> DataFrame:
    """A two-phase summary as text: sizes with separators, times as 'm ± s'."""

    # The headings and the texts for missing times.
    def shown(phase: str, missing: str, title: str) -> str:
        std = f"if({phase}_std is null, 'nan', format_string('%.2f', {phase}_std))"
        text = f"concat(format_string('%.2f', {phase}_mean), ' ± ', {std})"
        return f"if({phase}_mean is null, '{missing}', {text}) as `{title}`"

    return summary.selectExpr(
        "format_number(size, 0) as `Sample Size`",
        shown("train", "N/A", "Train Time (s)"),
        shown("sample", "N/A (OOM)", "Sample Time (s)"),
        shown("total", "N/A (OOM)", "Total Time (s)"),
    )


def log_levels(log: DataFrame) -> DataFrame:
    """One row per level of a sweep's log: its files, their total time, the first name."""
    return log.groupBy("in_level").agg(
        F.count("*").alias("files"), F.sum("time").alias("total_time"),
        F.min("filename").alias("filename"),
    )


def level_log(log: DataFrame) -> DataFrame:
    """Files, total and average time over a sweep's log: in_level, time, filename."""
    return log.agg(
        F.count("*").alias("files"),
        F.sum("time").alias("total_time"),
        F.avg("time").alias("average_time"),
    )
