from pyspark.sql import functions as F

from pairlens.functions.scalars import utc_text
from pairlens.session import fresh_path
from pairlens.sources import fixtures as fix
from pairlens.streaming import ingest as ing
from pairlens.streaming import progress as pro
from tests.conftest import rows_of

SF = "/root/testdata/sf0.001"


def daily_files(spark):
    rows = fix.responses(spark, SF)
    path = fresh_path(spark, "daily")
    rows.withColumn("day", F.dayofmonth("timestamp")).repartition("day").write.partitionBy("day").json(path)
    return rows, ing.stream_files(spark, path + "/*", rows.schema, files_per_batch=4)


def test_stream_equals_batch(spark):
    rows, stream = daily_files(spark)
    target = fresh_path(spark, "out")
    twice = stream.unionByName(stream)  # every result arrives twice
    ing.start_ingest(twice, target, fresh_path(spark, "state")).awaitTermination()
    columns = ("observation_id", "answer", "status")
    assert spark.read.parquet(target).count() == 2 * rows.count()  # nothing is lost on the way
    got = ing.observations(spark, target)
    assert got.count() == rows.count()
    assert rows_of(got, *columns) == rows_of(ing.parsed(rows), *columns)


def test_progress_over_many_batches_equals_batch(spark):
    rows, stream = daily_files(spark)
    target = fresh_path(spark, "progress")
    counters = pro.progress(ing.parsed(stream), ("evaluator_id",), "1 day", "60 days")
    ing.start_updates(counters, target, fresh_path(spark, "state")).awaitTermination()
    got = ing.latest(spark.read.parquet(target), ["window_start", "evaluator_id"])
    want = pro.progress(ing.parsed(rows), ("evaluator_id",), "1 day", "60 days")
    assert spark.read.parquet(target).select("batch_id").distinct().count() > 1
    columns = ("t", "evaluator_id", "completed", "successful", "output_tokens")
    assert rows_of(got.withColumn("t", utc_text(F.col("window_start"))), *columns) == rows_of(want.withColumn("t", utc_text(F.col("window_start"))), *columns)


def test_completeness_over_many_batches_equals_batch(spark):
    from pairlens.operators.quality import unit_status

    rows, stream = daily_files(spark)
    unit, cell = ("contrast_id", "evaluator_id"), ("observation_id",)
    target = fresh_path(spark, "status")
    query = pro.start_completeness(ing.parsed(stream), unit, cell, 40, target, fresh_path(spark, "state"))
    query.awaitTermination()
    read = [p["numInputRows"] for p in query.recentProgress]
    assert len(read) > 1 and sum(read) == rows.count()  # every batch reads its own rows and nothing else
    want = unit_status(ing.parsed(rows), unit, cell, 40, F.col("status") == "valid")
    columns = (*unit, "n_cells_present", "n_terminally_failed", "complete", "reason")
    assert rows_of(pro.current_completeness(spark, target, unit), *columns) == rows_of(want, *columns)


def test_each_observation_once_and_the_first_stays(spark):
    rows = fix.responses(spark, SF).where("observation_id < 300")
    later = rows.where("observation_id % 4 = 1").withColumns({"response_text": F.lit("Passage B"), "timestamp": F.col("timestamp") - F.expr("INTERVAL 9 DAYS")})
    nameless = rows.where("observation_id < 3").withColumn("observation_id", F.lit(None).cast("bigint"))
    path, target, state = fresh_path(spark, "parts"), fresh_path(spark, "once"), fresh_path(spark, "state")
    for part, piece in enumerate([rows.where("observation_id < 200"), later.unionByName(nameless), rows.where("observation_id >= 100").unionByName(nameless)]):
        piece.coalesce(1).write.json(f"{path}/part={part}")
        stream = ing.stream_files(spark, path + "/*", rows.schema, files_per_batch=1)
        ing.start_once(stream, target, state, buckets=8).awaitTermination()  # stopped and started again between the parts
    got = spark.read.parquet(target)
    assert got.where("observation_id IS NOT NULL").count() == 300 and got.where("observation_id IS NULL").count() == 6
    columns = ("observation_id", "answer", "status")
    first = rows.where("observation_id < 200 OR observation_id % 4 <> 1").unionByName(later.where("observation_id >= 200"))
    assert rows_of(got.where("observation_id IS NOT NULL"), *columns) == rows_of(ing.parsed(first), *columns)


def test_first_arrival_does_not_depend_on_the_number_of_files(spark):
    import duckdb

    from pairlens.contract import load

    queries, sql = load()
    events, folder = spark.read.parquet(f"{SF}/events.parquet").where("event_id < 200"), fresh_path(spark, "many-files")
    events.repartition(7, "event_id").write.parquet(f"{folder}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    columns = ("observation_id", "answer", "status")
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({sql['stream_once']})").fetchall()
    assert rows_of(queries["stream_once"](spark, folder), *columns) == sorted(want, key=repr)
