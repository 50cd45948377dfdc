"""Validate appended results as they arrive.

The base table is authoritative: rows later than the watermark still land in it and
enter the next batch recompute; only the windowed dashboards drop them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from pairlens.functions.answers import rendered_error, with_choice
from pairlens.functions.scalars import attempt_status
from pairlens.sources.readers import path_exists


def stream_files(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    fmt: str = "json",
    name_filter: str | None = None,
    files_per_batch: int | None = None,
) -> DataFrame:
    """Stream of the files below a folder, in the order they appear."""
    reader = spark.readStream.schema(schema).format(fmt)
    if name_filter:
        reader = reader.option("pathGlobFilter", name_filter)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def parsed(rows: DataFrame) -> DataFrame:
    """Answer, error and status of each response; a recorded transport error wins."""
    result = with_choice(rows, "response_text", "answer", "__code")
    error = F.coalesce("validation_error", rendered_error(F.col("__code")))
    result = result.withColumn("error", error).drop("__code")
    return result.withColumn("status", attempt_status(F.col("answer"), F.col("error")))


def first_of_each(rows: DataFrame) -> DataFrame:
    """The earliest row of each observation id (of one time the least by content); rows without an id are all kept."""
    body = [c for c in rows.columns if c != "observation_id"]
    order = F.struct("timestamp", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in body if c != "timestamp"])
    first = rows.where("observation_id IS NOT NULL").groupBy("observation_id").agg(F.min_by(F.struct(*body), order).alias("__f"))
    named = first.select("observation_id", *[F.col(f"__f.{c}").alias(c) for c in body]).select(*rows.columns)
    return named.unionByName(rows.where("observation_id IS NULL"))


def start_ingest(rows: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Validate and append to parquet; processes everything available, then stops.

    Every row reaches the table however late it is; repeated observations are dropped when it is read.
    See :func:`start_once` for a table that never holds a repeat.
    """
    return (
        parsed(rows).writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def start_once(rows: DataFrame, target: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Validate and append each observation at most once, whatever the delay of a repeat: the first to arrive stays.

    The table lies in partitions by batch and by a hash bucket of the id.  A batch keeps the first row of
    each id, and of those only ids that earlier batches have not written; it looks for them in the buckets it
    touches, in their id column alone.  A retried batch overwrites its own partition and ignores what it wrote before.
    """
    bucket = F.coalesce(F.pmod(F.xxhash64("observation_id"), F.lit(buckets)), F.lit(-1)).cast("int")

    def save(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        first = first_of_each(parsed(batch)).withColumn("id_bucket", bucket).persist()
        try:
            if path_exists(spark, f"{target}/batch_id=*"):
                touched = [r["id_bucket"] for r in first.select("id_bucket").distinct().collect()]  # at most one row per bucket
                before = spark.read.parquet(target).where((F.col("batch_id") < batch_id) & F.col("id_bucket").isin(touched))
                fresh = first.join(before.select("id_bucket", "observation_id"), ["id_bucket", "observation_id"], "left_anti")
            else:
                fresh = first
            fresh.write.mode("overwrite").partitionBy("id_bucket").parquet(f"{target}/batch_id={batch_id}")
        finally:
            first.unpersist()

    return start_batches(rows, save, checkpoint)


def observations(spark: SparkSession, target: str) -> DataFrame:
    """The ingested table with one row per observation, its earliest (rows without an id are all kept)."""
    return first_of_each(spark.read.parquet(target))


def start_updates(rows: DataFrame, target: str, checkpoint: str, output_mode: str = "update") -> StreamingQuery:
    """Write every batch of changed aggregates to its own partition of ``target``.

    A batch that is retried after a failure overwrites its own partition, so the sink
    is idempotent.  Read it back with :func:`latest`.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    return start_batches(rows, save, checkpoint, output_mode)


def start_batches(
    rows: DataFrame, save: Callable[[DataFrame, int], None], checkpoint: str, output_mode: str = "append"
) -> StreamingQuery:
    return (
        rows.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .outputMode(output_mode)
        .trigger(availableNow=True)
        .start()
    )


def latest(updates: DataFrame, key: list[str]) -> DataFrame:
    """The newest version of each key of an update log."""
    body = [c for c in updates.columns if c not in key and c != "batch_id"]
    newest = F.max_by(F.struct(*body), "batch_id")
    return updates.groupBy(*key).agg(newest.alias("__n")).select(*key, *[F.col(f"__n.{c}").alias(c) for c in body])
