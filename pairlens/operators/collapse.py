"""Retry collapse, completion, resume and duplicate detection.

Keys are reduced with mergeable aggregates (``max_by``, conditional counts), so a key
with very many attempts is combined map-side and never gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.functions.common import null_safe_join, order_hash
from pairlens.functions.scalars import attempt_status, is_success

PILOT_KEY = ("trial_id", "model", "replicate_id")
CONTEXT_KEY = (*PILOT_KEY, "sampling_regime")
IDENTITY_KEY = ("trial_id", "replicate_id", "provider", "requested_model", "reasoning_profile", "prompt_sha256")


def with_defaults(rows: DataFrame) -> DataFrame:
    """Absent replicate and attempt numbers mean 1."""
    defaults = {c: F.coalesce(c, F.lit(1)) for c in ("replicate_id", "attempt_id") if c in rows.columns}
    return rows.withColumns(defaults) if defaults else rows


def collapse_attempts(
    rows: DataFrame,
    key: Sequence[str] = PILOT_KEY,
    answer: str = "answer",
    error: str = "error",
    order: Sequence[str] = ("attempt_id", "ingest_order"),
    carry: Sequence[str] = (),
) -> DataFrame:
    """One row per key: the last success (or none), attempt counts, absorbed failures.

    Failures count as absorbed only where the key was resolved in the end; further
    successes are never counted as failures.
    """
    ok = is_success(F.col(answer), F.col(error))
    kept = F.max_by(
        F.struct(*dict.fromkeys([answer, "attempt_id", *carry])), F.when(ok, F.struct(*[F.col(c) for c in order]))
    )
    grouped = with_defaults(rows).groupBy(*key).agg(
        kept.alias("__kept"), F.count("*").alias("n_attempts"), F.count_if(ok).alias("n_successes")
    )
    resolved = F.col("n_successes") > 0
    return grouped.select(
        *key,
        "n_attempts",
        "n_successes",
        resolved.alias("resolved"),
        F.when(resolved, F.col("n_attempts") - F.col("n_successes")).otherwise(F.lit(0)).alias("absorbed_failures"),
        *[F.col(f"__kept.{c}").alias(c) for c in dict.fromkeys([answer, "attempt_id", *carry])],
    )


def collapse_totals(collapsed: DataFrame) -> DataFrame:
    """Inventory header of a collapsed log."""
    return collapsed.agg(
        F.coalesce(F.sum("n_attempts"), F.lit(0)).alias("raw_attempts"),
        F.count_if("resolved").alias("completed"),
        F.count_if(~F.col("resolved")).alias("unresolved"),
        F.coalesce(F.sum("absorbed_failures"), F.lit(0)).alias("absorbed_failures"),
    )


def inventory(observations: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts by each single column in one pass; missing values are ``n/a``."""
    shown = observations.select(*[F.coalesce(F.col(c).cast("string"), F.lit("n/a")).alias(c) for c in by])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in by]))
    # Unpivoting before one partial aggregation keeps a single shuffle of a few rows.
    return shown.select(pairs.alias("p")).groupBy(F.col("p.field").alias("field"), F.col("p.value").alias("value")).agg(
        F.count("*").alias("n")
    )


def last_of_each(table: DataFrame, key: str, fields: Sequence[str], order: str = "ingest_order") -> DataFrame:
    """One row per key: the last one by ``order``, the reading position that ``readers.with_arrival`` adds.

    A table without that column has no last row, so a repeated key in it is an error, never a
    multiplied or an arbitrary row.
    """
    kept = F.struct(*fields)
    if order in table.columns:
        one = F.max_by(kept, F.col(order))
    else:
        repeated = F.concat(F.lit(f"{key} occurs more than once and nothing tells which row is last: "), F.col(key))
        one = F.when(F.count("*") > 1, F.raise_error(repeated).cast(table.select(kept.alias("r")).schema["r"].dataType)).otherwise(F.max_by(kept, F.lit(1)))
    return table.where(F.col(key).isNotNull()).groupBy(key).agg(one.alias("__r")).select(key, *[F.col(f"__r.{f}").alias(f) for f in fields])


def with_metadata(rows: DataFrame, manifest: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Resolve trial metadata: the row's own ``trial_meta`` wins, else the manifest.

    The prompt never travels along.  Adds ``has_metadata``.  Of manifest rows with one
    trial_id the last read wins, see :func:`last_of_each`.
    """
    last = last_of_each(manifest, "trial_id", fields)
    side = last.select("trial_id", *[F.col(f).alias(f"__m_{f}") for f in fields], F.lit(True).alias("__known"))
    joined = rows.join(side, "trial_id", "left")
    own = F.col("trial_meta").isNotNull() if "trial_meta" in rows.columns else F.lit(False)
    resolved = {
        f: F.when(own, F.col(f"trial_meta.{f}")).otherwise(F.col(f"__m_{f}"))
        if "trial_meta" in rows.columns
        else F.col(f"__m_{f}")
        for f in fields
    }
    flagged = joined.withColumns({**resolved, "has_metadata": own | F.coalesce("__known", F.lit(False))})
    return flagged.drop("trial_meta", "prompt", "__known", *[f"__m_{f}" for f in fields])


def next_attempt(planned: DataFrame, records: DataFrame, key: Sequence[str]) -> DataFrame:
    """Next attempt number of every planned key: highest recorded plus one, else 1."""
    highest = records.groupBy(*key).agg(F.max(F.coalesce("attempt_id", F.lit(1))).alias("__last"))
    joined = null_safe_join(planned.select(*key), highest, key, "left")
    return joined.withColumn("next_attempt_id", F.coalesce("__last", F.lit(0)) + 1).drop("__last")


def _completes(planned: DataFrame, records: DataFrame, key: Sequence[str], identity: Sequence[str]) -> Column:
    condition = F.lit(True)
    for k in key:
        condition = condition & planned[k].eqNullSafe(records[k])
    if "prompt_sha256" in planned.columns and "prompt_sha256" in records.columns:
        condition = condition & (
            planned["prompt_sha256"].isNull() | (records["prompt_sha256"] == planned["prompt_sha256"])
        )
    for c in identity:
        condition = condition & (records[c].isNull() | planned[c].isNull() | (records[c] == planned[c]))
    return condition


def _successful(records: DataFrame, answer: str, error: str) -> DataFrame:
    return records.where(is_success(F.col(answer), F.col(error)))


def completed(
    planned: DataFrame,
    records: DataFrame,
    key: Sequence[str],
    identity: Sequence[str] = (),
    answer: str = "answer",
    error: str = "error",
) -> DataFrame:
    """Planned rows with a valid record of the same prompt and evaluator identity.

    A planned prompt hash must match exactly; identity columns a record never stored
    (NULL) are compatible.
    """
    done = _successful(records, answer, error)
    return planned.join(done, _completes(planned, done, key, identity), "left_semi")


def pending(
    planned: DataFrame,
    records: DataFrame,
    key: Sequence[str],
    identity: Sequence[str] = (),
    answer: str = "answer",
    error: str = "error",
) -> DataFrame:
    """Planned rows still to be run."""
    done = _successful(records, answer, error)
    return planned.join(done, _completes(planned, done, key, identity), "left_anti")


def retry_failed(
    records: DataFrame,
    manifest: DataFrame,
    key: Sequence[str] = CONTEXT_KEY,
    answer: str = "answer",
    error: str = "error",
    where: Column | None = None,
) -> DataFrame:
    """Keys that have records, none of them successful, and whose trial still exists."""
    ok = is_success(F.col(answer), F.col(error))
    failed = records.groupBy(*key).agg(F.count("*").alias("n_failed"), F.count_if(ok).alias("__ok")).where("__ok = 0")
    if where is not None:
        failed = failed.where(where)
    return failed.drop("__ok").join(manifest.select("trial_id").distinct(), "trial_id", "left_semi")


def unfinished(plan: DataFrame, results: DataFrame, valid_only: bool = False) -> DataFrame:
    """Plan rows without a result: any row counts as done, or only a resolved one."""
    done = results.where("parsing_status = 'resolved'") if valid_only else results
    return plan.join(done.select("observation_id"), "observation_id", "left_anti")


def number_new_attempts(existing: DataFrame, collected: DataFrame, key: Sequence[str], arrival: str) -> DataFrame:
    """Attempt numbers of newly collected rows, continuing after the existing ones.

    Ranks among the new rows of a key come from bucketed row numbers, so one key with
    very many new rows is still spread over tasks.
    """
    from pairlens.operators.ordering import BUCKET, numbered, value_buckets

    bucketed = value_buckets(collected, list(key), arrival).withColumnRenamed(BUCKET, "__vb")
    ranked = numbered(bucketed, list(key), [arrival], F.col("__vb"), "__rank").drop("__vb")
    highest = existing.groupBy(*key).agg(F.max(F.coalesce("attempt_id", F.lit(1))).alias("__last"))
    joined = null_safe_join(ranked, highest, key, "left")
    return joined.withColumn("attempt_id", F.coalesce("__last", F.lit(0)) + F.col("__rank")).drop("__last", "__rank")


def fold_attempts(
    attempts: DataFrame, key: Sequence[str] = ("observation_id",), nested: Sequence[str] = ()
) -> DataFrame:
    """One planned observation per key from its recorded attempts.

    Attempts after the first valid one are ignored.  ``nested`` columns are kept as an
    ``attempts`` array; the retry limit bounds its length, so it is only for tables
    that were written under one.
    """
    rows = attempts if "status" in attempts.columns else attempts.withColumn(
        "status", attempt_status(F.col("answer"), F.col("error"))
    )
    valid, number = F.col("status") == "valid", F.col("attempt_number")
    columns = [
        F.min(F.when(valid, number)).alias("__first_valid"),
        F.max(number).alias("__last"),
        F.min_by("status", "attempt_number").alias("first_attempt_status"),
        F.min_by("answer", F.when(valid, number)).alias("first_valid_response"),
    ]
    if nested:
        entry = F.struct("attempt_number", "status", *nested)
        columns.append(F.array_sort(F.collect_list(entry)).alias("__attempts"))
    folded = rows.groupBy(*key).agg(*columns)
    total = F.coalesce("__first_valid", "__last")
    result = folded.withColumns(
        {
            "total_attempts": total,
            "parsing_status": F.when(F.col("__first_valid").isNotNull(), "resolved").otherwise("unresolved"),
            "refusal_status": F.col("first_attempt_status") == "refusal",
            "api_error_status": F.col("first_attempt_status") == "api_error",
        }
    )
    if nested:
        result = result.withColumn("attempts", F.filter("__attempts", lambda a: a["attempt_number"] <= F.col("total_attempts")))
    return result.drop("__first_valid", "__last", "__attempts")


def shuffled_units(rows: DataFrame, seed: int, unit: str = "unit_id") -> DataFrame:
    """Distinct units with their reproducible shuffle key."""
    return rows.select(unit).distinct().withColumn("shuffle_key", order_hash(seed, F.col(unit)))
