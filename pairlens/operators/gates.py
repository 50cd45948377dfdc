"""Gates before a recovery and before an analysis.

A gate is one declared number with the value it must have.  The numbers of a report are measured
by a few aggregations that each end in one row; what takes a join (a plan against the planned
index) is one violation table, counted in the same report.  ``require`` is the only action.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.operators.quality import GateError
from pairlens.operators.recovery import DUPLICATE, MALFORMED, UNKNOWN, VALID, class_counts

REPEATED, NOT_PLANNED, OTHER_IDENTITY = "repeated", "not_planned", "other_identity"


def plan_violations(plan: DataFrame, planned: DataFrame, identity: Sequence[str] = ("trial_id", "replicate_number")) -> DataFrame:
    """(observation_id, violation) of plan rows that the planned index does not cover.

    A recovery may only repeat planned observations: each id once, known, and with the planned
    identity.  An id has one row per kind of violation; a NULL id is not planned.
    """
    ids = plan.groupBy("observation_id").agg(F.count("*").alias("__k"))
    known = planned.groupBy("observation_id").agg(F.first(F.struct(*identity)).alias("__own"), F.lit(True).alias("__known"))
    named = plan.select("observation_id", F.struct(*identity).alias("__as")).distinct().join(known, "observation_id", "left")
    found = named.select("observation_id", F.when(F.col("__known").isNull(), NOT_PLANNED).when(~F.col("__as").eqNullSafe(F.col("__own")), OTHER_IDENTITY).alias("violation"))
    again = ids.where("__k > 1 AND observation_id IS NOT NULL").select("observation_id", F.lit(REPEATED).alias("violation"))
    return found.where("violation IS NOT NULL").distinct().unionByName(again)


def _one_row(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.crossJoin, parts)  # one row each


def wave_measures(planned: DataFrame, classified: DataFrame, violations: DataFrame | None = None, cell: str = "trial_id") -> DataFrame:
    """One row of what the gates of a wave look at."""
    plan = planned.agg(
        F.count_distinct("observation_id").alias("planned"), (F.count("*") - F.count_distinct("observation_id")).alias("planned_again"), F.count_distinct(cell).alias("cells"),
    )
    of = lambda c, what: F.coalesce(F.max(F.when(F.col("row_class") == c, F.col(what))), F.lit(0))
    classes = class_counts(classified).agg(
        of(VALID, "n_ids").alias("valid"), of(UNKNOWN, "n_rows").alias("unknown"), of(DUPLICATE, "n_ids").alias("duplicate"), of(MALFORMED, "n_rows").alias("malformed"),
    )
    wrong = planned.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("plan_wrong")) if violations is None else violations.agg(F.count("*").alias("plan_wrong"))
    return _one_row(plan, classes, wrong).withColumn("unresolved", F.col("planned") - F.col("valid"))


def report(measures: DataFrame, gates: Mapping[str, tuple[str, Column | int]]) -> DataFrame:
    """One row per gate (name to measure and wanted value): ``check_name``, ``found``, ``wanted``, ``ok``."""
    rows = [F.struct(F.lit(name).alias("check_name"), F.col(m).cast("bigint").alias("found"), F.lit(w).cast("bigint").alias("wanted")) for name, (m, w) in gates.items()]
    each = measures.select(F.explode(F.array(*rows)).alias("g")).select("g.*")
    return each.withColumn("ok", F.coalesce(F.col("found") == F.col("wanted"), F.lit(False)))


def recovery_preflight(planned: DataFrame, classified: DataFrame, plan: DataFrame, expected_total: int, identity: Sequence[str] = ("trial_id", "replicate_number")) -> DataFrame:
    """Whether a recovery of this wave may start."""
    measures = wave_measures(planned, classified, plan_violations(plan, planned, identity), cell=identity[0] if identity else "observation_id")
    return report(measures, {
        "planned_count_matches_design": ("planned", expected_total), "planned_ids_unique": ("planned_again", 0), "no_unknown_rows": ("unknown", 0),
        "no_duplicate_answers": ("duplicate", 0), "no_malformed_answers": ("malformed", 0), "recovery_creates_no_new_replicates": ("plan_wrong", 0),
    })


def wave_complete(planned: DataFrame, classified: DataFrame, expected_total: int, expected_cells: int, cell: str = "trial_id") -> DataFrame:
    """Whether a wave holds one valid answer for every planned observation, of as many cells as designed."""
    return report(wave_measures(planned, classified, cell=cell), {
        "planned_count_matches_design": ("planned", expected_total), "cells_match_design": ("cells", expected_cells), "every_answer_valid": ("valid", expected_total),
        "nothing_unresolved": ("unresolved", 0), "no_unknown_rows": ("unknown", 0), "no_duplicate_answers": ("duplicate", 0), "no_malformed_answers": ("malformed", 0),
    })


def merge_complete(diagnostics: DataFrame, expected_total: int) -> DataFrame:
    """Whether merged waves may be analysed, from ``recovery.merge_diagnostics``."""
    settled = diagnostics.withColumn("__settled", F.col("first_wave_retained") + F.col("recovered"))
    return report(settled, {
        "planned_count_matches_design": ("planned_total", expected_total), "nothing_unresolved": ("still_unresolved", 0),
        "every_observation_settled": ("__settled", expected_total), "no_observation_answered_again": ("ids_answered_again", 0),
    })


def require(checks: DataFrame, message: str) -> None:
    """Raise with every failed check of a report; nothing is changed or deleted."""
    failed = [f"{r['check_name']}: found {r['found']}, wanted {r['wanted']}" for r in checks.where(~F.col("ok")).collect()]  # one row per gate
    if failed:
        raise GateError(f"{message}: {'; '.join(failed)}")
