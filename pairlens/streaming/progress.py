"""Counters that follow a run: throughput, peak usage, unit completeness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pairlens.functions.scalars import is_peak
from pairlens.operators.quality import unit_status
from pairlens.streaming.ingest import latest, start_updates


def _tokens(column: str):
    return F.coalesce(F.sum(column), F.lit(0)).alias(column)


def progress(rows: DataFrame, by: Sequence[str], window: str = "1 minute", delay: str = "1 hour") -> DataFrame:
    """Completed, valid and failed rows, token sums and rate per tumbling window.

    Works on a stream (update mode) and on a batch alike.
    """
    seconds = F.unix_timestamp("window.end") - F.unix_timestamp("window.start")
    counted = (
        rows.withWatermark("timestamp", delay)
        .groupBy(F.window("timestamp", window).alias("window"), *by)
        .agg(
            F.count("*").alias("completed"),
            F.count_if(F.col("status") == "valid").alias("successful"),
            F.count_if(F.col("status") != "valid").alias("failed"),
            *[_tokens(c) for c in ("input_tokens", "output_tokens", "reasoning_tokens")],
        )
    )
    return counted.select(
        F.col("window.start").alias("window_start"),
        *by,
        "completed", "successful", "failed", "input_tokens", "output_tokens", "reasoning_tokens",
        (F.col("completed") / seconds).alias("rate_per_second"),
    )


def hourly_peak_usage(rows: DataFrame, by: Sequence[str], delay: str = "1 hour") -> DataFrame:
    """Usage per tumbling hour; an hour is wholly peak or off-peak."""
    counted = (
        rows.withWatermark("timestamp", delay)
        .groupBy(F.window("timestamp", "1 hour").alias("window"), *by)
        .agg(F.count("*").alias("n"), _tokens("input_tokens"), _tokens("output_tokens"))
    )
    start = F.col("window.start")
    return counted.select(
        start.alias("window_start"), is_peak(start).alias("is_peak"), *by, "n", "input_tokens", "output_tokens"
    )


def start_completeness(
    rows: DataFrame, unit: Sequence[str], cell: Sequence[str], expected: int, target: str, checkpoint: str
) -> StreamingQuery:
    """Keep unit completeness current while results arrive.

    The counts and distinct cells of a unit are the state of the stream, kept by a hash of the unit in the
    checkpoint folder, so a batch reads its own rows and the state of the units it touches and
    nothing that arrived before.  A unit never expires: a late row counts whenever it comes.  The
    units of a batch go to its own partition of ``target``, which a retry overwrites.
    """
    return start_updates(unit_status(rows, unit, cell, expected, F.col("status") == "valid"), target, checkpoint)


def current_completeness(spark: SparkSession, target: str, unit: Sequence[str]) -> DataFrame:
    return latest(spark.read.parquet(target), list(unit))
