"""Recovery merge and validation report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.operators import design as ds
from pairlens.operators import gates
from pairlens.operators import quality as q
from pairlens.operators import recovery as rec
from pairlens.operators import sampling as sp
from pairlens.functions.scalars import token_bin


def planned_index(
    manifests: dict[str, tuple[DataFrame, int]], experiment_id: str, evaluator_id: str
) -> DataFrame:
    """Planned observations of several unit kinds; their id spaces must not meet."""
    parts = [ds.planned_observations(m, n, experiment_id, evaluator_id, kind) for kind, (m, n) in manifests.items()]
    index = parts[0]
    for part in parts[1:]:
        q.require_empty(q.shared_ids(index, part, "observation_id"), "planned id spaces collide")
        index = index.unionByName(part)
    return index


def consistency_violations(classified: DataFrame) -> DataFrame:
    """Classes that make a wave unusable, with their counts."""
    bad = (rec.UNKNOWN, rec.DUPLICATE, rec.MALFORMED)
    return rec.class_counts(classified).where(F.col("row_class").isin(*bad))


def merge(
    planned: DataFrame,
    first_wave: DataFrame,
    recovery: DataFrame,
    carry: Sequence[str],
    arrival: Sequence[str],
    require_consistent: bool = True,
    expected_total: int | None = None,
) -> dict[str, DataFrame]:
    """Classify the first wave, fill its gaps, and report.

    Rows need observation_id, parsing_status, recorded_answer, last_response_text.  An inconsistent
    first wave and a recovery plan outside the planned index are errors, and with ``expected_total`` so is a merge that
    does not settle that many observations.
    """
    classified = rec.classify_rows(first_wave, planned).persist()
    if require_consistent:
        q.require_empty(consistency_violations(classified), "first wave is inconsistent")
    identity = [c for c in ("trial_id", "replicate_number") if c in planned.columns] or ["observation_id"]
    plan = rec.recovery_plan(planned, classified)
    q.require_empty(gates.plan_violations(plan, planned, identity), "recovery plan leaves the planned index")
    merged = rec.merge_waves(planned, rec.valid_rows(classified), recovery, carry, arrival).persist()
    diagnostics = rec.merge_diagnostics(planned, recovery, merged)
    if expected_total is not None:
        gates.require(gates.merge_complete(diagnostics, expected_total), "merged waves are incomplete")
    return {
        "class_counts": rec.class_counts(classified),
        "recovery_plan": plan,
        "merged": merged,
        "diagnostics": diagnostics,
    }


def completeness_violations(diagnostics: DataFrame, expected_total: int) -> DataFrame:
    """Non-empty when a merge may not be analysed yet."""
    return diagnostics.where(
        (F.col("planned_total") != expected_total)
        | (F.col("still_unresolved") != 0)
        | (F.col("final_completeness") != 1.0)
        | (F.col("ids_answered_again") != 0)
    )


def validation_sample(valid: DataFrame, size: int, seed: int) -> DataFrame:
    """Stratified by unit kind, instruction, contrast and token bin; exactly min(size, rows)."""
    binned = valid.withColumn("token_bin", token_bin(F.col("reasoning_tokens")))
    strata = ("unit_kind", "instruction_condition", "contrast_id", "token_bin")
    return rec.validation_plan(sp.stratified_sample(binned, strata, size, seed, "observation_id"))


def validation_report(originals: DataFrame, reruns: DataFrame) -> dict[str, DataFrame]:
    """Agreement overall and by token bin, and the effect comparison where calculable."""
    meta = ("contrast_id", "instruction_condition", "assignment", "position", "story_1_id", "story_2_id", "story_a_id", "story_b_id")
    rows = rec.validation_rows(originals, reruns, meta).persist()
    treated = rows.where("contrast_id IS NOT NULL")
    return {
        "agreement": rec.validation_agreement(rows),
        "effects": rec.validation_effects(treated, ("contrast_id", "instruction_condition")),
    }
