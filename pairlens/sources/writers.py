"""Sinks.  Inputs are never overwritten: rewrites go to a new location."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.functions.answers import RATING_FIELDS


def append_results(rows: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """Append to a result log."""
    rows.write.mode("append").format(fmt).partitionBy(*partition_by).save(path)


def write_csv(rows: DataFrame, columns: Sequence[str], path: str) -> None:
    """Tidy CSV with a fixed column order (a folder of parts; nothing is gathered)."""
    rows.select(*columns).write.mode("errorifexists").option("header", True).csv(path)


def write_tables(tables: Mapping[str, DataFrame], folder: str) -> None:
    """One CSV folder per table, in the tables' own column order."""
    for name, rows in tables.items():
        flat = [
            F.to_json(c).alias(c) if t.startswith(("struct", "array", "map")) else F.col(c) for c, t in rows.dtypes
        ]
        write_csv(rows.select(*flat), rows.columns, f"{folder}/{name}")


def headline(
    points: DataFrame, verdicts: DataFrame, counts: DataFrame, evaluator: str = "partition_id"
) -> DataFrame:
    """One JSON document per evaluator: its counts, measures and verdicts by contrast.

    Arrays hold one entry per contrast.  Union :func:`cross_evaluator_summary` to write the flat rows beside them.
    """

    def listed(rows: DataFrame, name: str) -> DataFrame:
        body = F.struct(*[c for c in rows.columns if c != evaluator])
        return rows.groupBy(evaluator).agg(F.sort_array(F.collect_list(body)).alias(name))

    joined = counts.join(listed(points, "controllability_effects"), evaluator, "left").join(
        listed(verdicts, "equivalence_results"), evaluator, "left"
    )
    return joined.select(evaluator, F.to_json(F.struct(*joined.columns)).alias("document"))


def cross_evaluator_summary(points: DataFrame, evaluator: str = "partition_id") -> DataFrame:
    """The measures of every evaluator and contrast as flat JSON rows, named ``evaluator_id``; descriptive, never pooled."""
    body = [F.col(c) for c in points.columns if c != evaluator]
    return points.select(F.col(evaluator), F.to_json(F.struct(F.lit("cross_model_summary").alias("record"), F.col(evaluator).alias("evaluator_id"), *body)).alias("document"))


def write_headline(documents: DataFrame, path: str) -> None:
    documents.select(F.col("document").alias("value")).write.mode("errorifexists").text(path)


def observation_export(observations: DataFrame) -> DataFrame:
    """Wide pilot export: preference and ratings of both sides as columns.

    Needs ``answer`` (compact JSON) beside the parsed trial columns.
    """
    pair = "struct<story_a: map<string,int>, story_b: map<string,int>, preference: int>"
    single = F.from_json(F.when(F.col("trial_type") == "single", F.col("answer")), "map<string,int>")
    both = F.from_json(F.when(F.col("trial_type") != "single", F.col("answer")), pair)
    staged = observations.withColumns({"__s": single, "__p": both})
    side_a = F.coalesce(F.col("__s"), F.col("__p.story_a"))
    columns = [F.try_element_at(side_a, F.lit(f)).alias(f"a_{f}") for f in RATING_FIELDS]
    columns += [F.try_element_at(F.col("__p.story_b"), F.lit(f)).alias(f"b_{f}") for f in RATING_FIELDS]
    return staged.select(
        "trial_id", "model", "replicate_id", "attempt_id", "trial_type", "story_a", "story_b", "condition", "task",
        F.col("__p.preference").alias("preference"), *columns,
    )


def split_by_unit_kind(merged: DataFrame, path: str) -> None:
    """Merged output with one folder per unit kind."""
    merged.write.mode("errorifexists").partitionBy("unit_kind").parquet(path)
