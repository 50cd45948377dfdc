"""First controllability design: suppression of pooled effects and their link to blind margins."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.functions.scalars import attempt_status, display_name
from pairlens.functions.stats import pearson
from pairlens.operators import collapse as col
from pairlens.operators import effects as fx
from pairlens.operators import quality as q
from pairlens.operators.usage import mixed_identity
from pairlens.plans.context import META, categories_of, observations, pairwise_tables

UNIT = ("block_id", "model", "replicate_id", "sampling_regime")


def first_attempt_compliance(attempts: DataFrame, manifest: DataFrame) -> DataFrame:
    """Outcomes of first attempts only, by model, regime and contrast."""
    rows = col.with_metadata(col.with_defaults(attempts).where("attempt_id = 1"), manifest, META)
    status = attempt_status(F.col("answer"), F.col("error"))
    # Hedged answers count as invalid here; only transport errors stand apart.
    plain = F.when(status == "refusal", "invalid").otherwise(status)
    return q.compliance(
        rows.withColumn("first_attempt_status", plain), ("model", "evaluation_regime", "contrast_id")
    )


def _complete(rows: DataFrame, cell: tuple[str, ...], expected: int) -> tuple[DataFrame, DataFrame]:
    status = q.unit_status(rows, UNIT, cell, expected, F.col("answer").isNotNull())
    return q.complete_rows(rows, status, UNIT), q.unit_counts(status)


def analyse(
    treatment: DataFrame,
    treatment_manifest: DataFrame,
    baseline: DataFrame,
    baseline_manifest: DataFrame,
    sampling_regime: str,
    experiment_ids: tuple[str, str],
    names: Mapping[str, str] | None = None,
) -> dict[str, DataFrame]:
    """``experiment_ids``: (treatment, baseline).  ``names``: display names of contrasts."""

    def load(attempts: DataFrame, manifest: DataFrame, experiment: str) -> DataFrame:
        wanted = (
            F.col("has_metadata")
            & F.col("sampling_regime").eqNullSafe(F.lit(sampling_regime))
            & (F.col("experiment_id") == experiment)
        )
        return q.isolate(observations(attempts, manifest), wanted)[0].where("type = 'context_pairwise'").persist()

    treated, blind = load(treatment, treatment_manifest, experiment_ids[0]), load(baseline, baseline_manifest, experiment_ids[1])
    complete, counts = _complete(treated.where("assignment IS NOT NULL"), ("assignment", "position"), 4)
    blind_complete, blind_counts = _complete(blind, ("position",), 2)
    overall = ("overall_quality",)
    tables = pairwise_tables(fx.forced_pairwise(categories_of(complete, overall)))
    margins = fx.baseline_margin(categories_of(blind_complete, overall), ("model", "category"))
    joined = fx.effect_with_margin(tables["directional_effects"], margins, ("model", "category", *fx.PAIR))
    by = ("model", "evaluation_regime", "contrast_id", "category")
    correlation = joined.groupBy(*by).agg(
        F.count("*").alias("n_pairs"), pearson(F.col("baseline_margin"), F.col("abs_effect")).alias("r_margin_vs_abs_effect")
    )

    def named(rows: DataFrame) -> DataFrame:
        return rows.withColumn("context", display_name(F.col("contrast_id"), names or {}))

    compliance = first_attempt_compliance(treatment, treatment_manifest).unionByName(
        first_attempt_compliance(baseline, baseline_manifest)
    )
    fields = [c for c in ("provider", "requested_model", "reasoning_profile", "response_model") if c in treated.columns]
    return {
        **tables,
        "unit_counts": counts,
        "baseline_unit_counts": blind_counts,
        "suppression": named(fx.suppression(tables["regime_comparison"])),
        "baseline_margin": margins,
        "effect_vs_margin": named(joined),
        "margin_correlation": named(correlation),
        "compliance": compliance,
        "mixed_identity": mixed_identity(treated, ("model",), fields),
    }
