"""Manifest builders: design tables in, checked trial manifests out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.operators import design as ds
from pairlens.operators import quality as q

# Experiment ids of the designs.
V1, V1_BASELINE = "context_controllability_v1", "context_controllability_baseline_v1"
V2, V2_BASELINE = "context_controllability_v2", "context_controllability_baseline_v2"
V2_TEXT_ONLY = "context_controllability_baseline_text_only_v2"


def _paired(items: DataFrame, pairs: DataFrame | None) -> DataFrame:
    chosen = ds.unordered_pairs(items) if pairs is None else pairs
    return ds.with_texts(chosen, items, "story_1_id", "story_2_id")


def _tagged(rows: DataFrame, experiment: str) -> DataFrame:
    return rows.withColumn("experiment_id", F.lit(experiment))


def _checked(trials: DataFrame, gates: Mapping[str, DataFrame]) -> DataFrame:
    for name, violations in gates.items():
        q.require_empty(violations, f"manifest gate {name} failed")
    return trials


def pilot(
    items: DataFrame,
    conditions: Sequence[Mapping[str, str]],
    tasks: Sequence[Mapping[str, str]],
    pair_conditions: Sequence[Mapping[str, str]],
    instruction: str,
    subset: Sequence[str] | None = None,
) -> DataFrame:
    """Single, ordered-pair and identical-text control trials."""
    chosen = items if subset is None else ds.select_items(items, subset)
    pairs = ds.literal_rows(pair_conditions, ("id", "a_context", "b_context"))
    single = ds.single_manifest(
        chosen, ds.literal_rows(conditions, ("id", "context")), ds.literal_rows(tasks, ("id", "instruction"))
    )
    compared = ds.comparison_manifest(ds.ordered_pairs(chosen), chosen, pairs, instruction)
    control = ds.comparison_manifest(ds.self_pairs(chosen), chosen, pairs, instruction, control=True)
    trials = single.unionByName(compared, allowMissingColumns=True).unionByName(control, allowMissingColumns=True)
    return _checked(trials, {"unique ids": q.duplicate_ids(trials, "trial_id")})


def context(
    items: DataFrame,
    dimensions: DataFrame,
    contrasts: Sequence[Mapping[str, str]],
    prompt_contrasts: Sequence[Mapping[str, str]],
    instructions: Mapping[str, str],
    pairs: DataFrame | None = None,
) -> DataFrame:
    """Single-text, pairwise and prompt-scope trials under both regimes."""
    paired = _paired(items, pairs)
    fields = ("contrast_id", "dimension", "a", "b", "a_text", "b_text")
    parts = [
        ds.context_single_manifest(items, ds.single_variable_conditions(dimensions), instructions),
        ds.pairwise_manifest(paired, ds.literal_rows(contrasts, ds.CONTRAST_FIELDS)),
        ds.prompt_manifest(paired, ds.literal_rows(prompt_contrasts, fields)),
    ]
    trials = parts[0]
    for part in parts[1:]:
        trials = trials.unionByName(part, allowMissingColumns=True)
    return _checked(trials, {"unique ids": q.duplicate_ids(trials, "trial_id")})


def tie_allowed(items: DataFrame, contrasts: Sequence[Mapping[str, str]], pairs: DataFrame | None = None) -> DataFrame:
    """The separate hedging diagnostic."""
    return ds.pairwise_manifest(
        _paired(items, pairs), ds.literal_rows(contrasts, ds.CONTRAST_FIELDS), choice_mode="tie_allowed"
    )


def same_context(items: DataFrame, values: Sequence[Mapping[str, str]], pairs: DataFrame | None = None) -> DataFrame:
    return ds.same_context_manifest(_paired(items, pairs), ds.literal_rows(values, ("dimension", "value", "phrase")))


def named_labels(
    items: DataFrame, contrasts: Sequence[Mapping[str, str]], experiment: str, regimes: Sequence[str] = ("naturalistic",),
    pairs: DataFrame | None = None,
) -> DataFrame:
    """Pairwise manifest restricted to the supplied label contrasts."""
    trials = _tagged(
        ds.pairwise_manifest(_paired(items, pairs), ds.literal_rows(contrasts, ds.CONTRAST_FIELDS), regimes), experiment
    )
    return _checked(trials, {"trials": q.trial_violations(trials), "blocks": q.block_violations(trials)})


def controllability_v1(
    items: DataFrame, contrasts: Sequence[Mapping[str, str]], pairs: DataFrame | None = None
) -> dict[str, DataFrame]:
    paired = _paired(items, pairs)
    treatment = _tagged(ds.plain_manifest_v1(paired, ds.literal_rows(contrasts, ds.CONTRAST_FIELDS)), V1)
    baseline = _tagged(ds.baseline_manifest_v1(paired), V1_BASELINE)
    _checked(treatment, {"trials": q.trial_violations(treatment, response_format="plain_ab"), "blocks": q.block_violations(treatment)})
    _checked(
        baseline,
        {
            "trials": q.trial_violations(baseline, response_format="plain_ab", baseline=True),
            "blocks": q.block_violations(baseline, baseline=True),
        },
    )
    return {"treatment": treatment, "baseline": baseline}


def controllability_v2(
    items: DataFrame, contrasts: Sequence[Mapping[str, str]], pairs: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Treatment superblocks and both blind baselines."""
    paired = _paired(items, pairs)
    conditions = ("matched_control", "text_only")
    treatment = _tagged(ds.plain_manifest_v2(paired, ds.literal_rows(contrasts, ds.CONTRAST_FIELDS), conditions), V2)
    _checked(
        treatment,
        {
            "trials": q.trial_violations(treatment, response_format="plain_ab", instruction_conditions=conditions),
            "blocks": q.block_violations(treatment),
            "superblocks": q.superblock_violations(treatment, conditions),
        },
    )
    result = {"treatment": treatment}
    for name, condition, experiment in (
        ("baseline", "matched_control", V2_BASELINE), ("baseline_text_only", "text_only", V2_TEXT_ONLY),
    ):
        blind = _tagged(ds.baseline_manifest_v2(paired, condition), experiment)
        _checked(
            blind,
            {
                "trials": q.trial_violations(
                    blind, response_format="plain_ab", instruction_conditions=(condition,), baseline=True
                ),
                "blocks": q.block_violations(blind, baseline=True),
            },
        )
        result[name] = blind
    return result
