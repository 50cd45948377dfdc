"""Contract queries of the streaming operators.

Each runs its stream over the whole events table until everything available is
processed, and returns what the sink holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.contract.effects import present
from pairlens.contract.records import PEAK
from pairlens.contract.registry import query
from pairlens.functions.scalars import utc_text
from pairlens.session import fresh_path
from pairlens.sources import fixtures as fix
from pairlens.streaming import ingest as ing
from pairlens.streaming import progress as pro


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = fix.table(spark, sf, "events").schema
    return fix.respond(ing.stream_files(spark, sf, schema, "parquet", "events.parquet"))


def arrivals(spark: SparkSession, sf: str, repeats: bool) -> list[DataFrame]:
    """The events by day of arrival: a third of them come days late, and with ``repeats`` every fifth
    comes again in between with another outcome and a later time."""
    events = fix.table(spark, sf, "events")
    again = events.where("event_id % 5 = 3").withColumns({"ts": F.col("ts") + F.expr("INTERVAL 1 DAY"), "event_type": F.when(F.col("event_type") == "error", "click").otherwise("error")})
    late = F.coalesce(F.col("event_id") % 3 == 0, F.lit(True))
    return [events.where(~late), again if repeats else events.limit(0), events.where(late)]


def day_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    return fix.respond(ing.stream_files(spark, folder + "/*", schema, "parquet", files_per_batch=4))


def day_files(spark: SparkSession, sf: str, repeats: bool) -> DataFrame:
    """The arrivals of all three days as a stream of files, a few per batch."""
    folder, days = fresh_path(spark, "days"), arrivals(spark, sf, repeats)
    for day, rows in enumerate(days, start=1):
        rows.write.parquet(f"{folder}/day={day}")
    return day_stream(spark, folder, days[0].schema)


def finished(stream) -> None:
    stream.awaitTermination()
    if stream.exception():
        raise stream.exception()


@query(
    "stream_ingest",
    """SELECT observation_id, answer, status, contrast_id, evaluator_id, input_tokens, output_tokens FROM v_responses""",
)
def _(spark, sf):
    target, checkpoint = fresh_path(spark, "ingest"), fresh_path(spark, "ingest-state")
    finished(ing.start_ingest(event_stream(spark, sf), target, checkpoint))
    kept = ("observation_id", "answer", "status", "contrast_id", "evaluator_id", "input_tokens", "output_tokens")
    return ing.observations(spark, target).select(*kept)


# Of an id that comes late and again, the repeat arrives first, with the other outcome: errors became clicks, the rest errors.
FIRST_ARRIVALS = """SELECT observation_id, CASE WHEN NOT again THEN answer WHEN event_type = 'error' THEN CASE WHEN observation_id % 2 = 0 THEN 'A' ELSE 'B' END END AS answer,
       CASE WHEN NOT again THEN status WHEN event_type = 'error' THEN 'valid' ELSE 'api_error' END AS status, contrast_id, evaluator_id, input_tokens, output_tokens
       FROM (SELECT *, coalesce(observation_id % 3 = 0 AND observation_id % 5 = 3, false) AS again FROM v_responses)"""


@query("stream_once", FIRST_ARRIVALS)
def _(spark, sf):
    """Over several days with late rows and repeats that differ: the first arrival stays.

    Each day the stream takes up what has come since, so that no batch holds two days, however many files a day has.
    """
    target, state, folder = fresh_path(spark, "once"), fresh_path(spark, "once-state"), fresh_path(spark, "days")
    for day, rows in enumerate(arrivals(spark, sf, repeats=True), start=1):
        rows.write.parquet(f"{folder}/day={day}")
        finished(ing.start_once(day_stream(spark, folder, rows.schema), target, state))
    return spark.read.parquet(target).select("observation_id", "answer", "status", "contrast_id", "evaluator_id", "input_tokens", "output_tokens")


@query(
    "stream_progress",
    """SELECT strftime(date_trunc('minute', ts), '%Y-%m-%dT%H:%M:%SZ') AS window_start, evaluator_id, count(*) AS completed,
       count(*) FILTER (status = 'valid') AS successful, count(*) FILTER (status <> 'valid') AS failed,
       sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens,
       coalesce(sum(reasoning_tokens), 0)::BIGINT AS reasoning_tokens, round(count(*) / 60, 9) + 0.0 AS rate_per_second FROM v_responses GROUP BY ALL""",
)
def _(spark, sf):
    target, checkpoint = fresh_path(spark, "progress"), fresh_path(spark, "progress-state")
    counters = pro.progress(ing.parsed(event_stream(spark, sf)), ("evaluator_id",))
    finished(ing.start_updates(counters, target, checkpoint))
    rows = ing.latest(spark.read.parquet(target), ["window_start", "evaluator_id"])
    return present(rows.withColumn("window_start", utc_text(F.col("window_start"))))


@query(
    "stream_peak_usage",
    f"""SELECT strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:%M:%SZ') AS window_start, {PEAK} AS is_peak, evaluator_id, count(*) AS n,
        sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens FROM v_responses GROUP BY ALL""",
)
def _(spark, sf):
    target, checkpoint = fresh_path(spark, "peak"), fresh_path(spark, "peak-state")
    usage = pro.hourly_peak_usage(event_stream(spark, sf), ("evaluator_id",))
    finished(ing.start_updates(usage, target, checkpoint))
    rows = ing.latest(spark.read.parquet(target), ["window_start", "evaluator_id"])
    return rows.withColumn("window_start", utc_text(F.col("window_start")))


@query(
    "stream_completeness",
    """SELECT contrast_id, unit, count(*) AS n_cells_present, count(DISTINCT evaluator_id || instruction_condition) AS n_distinct_cells,
       count(*) FILTER (status <> 'valid') AS n_terminally_failed, 6::BIGINT AS n_cells_expected,
       count(*) = 6 AND count(DISTINCT evaluator_id || instruction_condition) = 6 AND count(*) FILTER (status <> 'valid') = 0 AS complete,
       CASE WHEN count(*) = 6 AND count(DISTINCT evaluator_id || instruction_condition) = 6 AND count(*) FILTER (status <> 'valid') = 0 THEN NULL
            WHEN count(*) FILTER (status <> 'valid') > 0 THEN 'terminally_incomplete' ELSE 'temporarily_incomplete' END AS reason
       FROM (SELECT *, observation_id // 6 AS unit FROM v_responses) GROUP BY ALL""",
)
def _(spark, sf):
    rows = ing.parsed(day_files(spark, sf, repeats=False)).withColumn("unit", F.floor(F.col("observation_id") / 6))
    target = fresh_path(spark, "unit-status")
    unit, cell = ("contrast_id", "unit"), ("evaluator_id", "instruction_condition")
    finished(pro.start_completeness(rows, unit, cell, 6, target, fresh_path(spark, "unit-state")))
    return pro.current_completeness(spark, target, unit)
