"""Second controllability design: evaluator partitions, rate-averaged effects, node bootstrap."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.operators import effects as fx
from pairlens.operators import quality as q
from pairlens.operators import resampling as rs
from pairlens.operators import usage as use
from pairlens.sources.readers import StudyConfig

P = "partition_id"
CELL = ("instruction_condition", "assignment", "position")
IDENTITY = ("provider", "requested_model", "reasoning_profile")
META = (
    "contrast_id", "instruction_condition", "assignment", "position", "story_1_id", "story_2_id", "story_a_id", "story_b_id",
)


def partitioned(results: DataFrame, config: StudyConfig) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of configured evaluators split by served version, the rest, and mixed versions."""
    flat = results.select(
        "*", *[F.col(f"evaluator.{c}").alias(c) for c in IDENTITY], *[F.col(f"trial_meta.{c}").alias(c) for c in META]
    )
    matched = q.match_evaluators(flat, config.evaluator_table(results.sparkSession), IDENTITY)
    return q.split_versions(matched), matched.where("evaluator_id IS NULL"), q.mixed_versions(matched)


def _gated(rows: DataFrame, unit: Sequence[str], cell: Sequence[str], expected: int) -> tuple[DataFrame, DataFrame]:
    status = q.unit_status(rows, unit, cell, expected, F.col("parsing_status") == "resolved")
    return q.complete_rows(rows, status, unit), status


def _each(partitions: Sequence[str], build) -> DataFrame:
    """Run a per-evaluator step for every partition (as many as configured versions)."""
    return reduce(DataFrame.unionByName, [build(p) for p in partitions])


def analyse(
    results: DataFrame,
    config: StudyConfig,
    frozen: bool,
    rates: DataFrame | None = None,
    draws: int | None = None,
    strict: bool = False,
) -> dict[str, DataFrame]:
    """All tables of the design.  ``results`` is the union of treatment and baseline rows.

    ``frozen`` comes from the drift check: without it there are intervals but no
    verdicts.  ``strict`` makes a mix of served versions an error instead of a split.
    """
    draws, seed = draws or config.bootstrap_draws, config.random_seed
    rows, unmatched, mixed = partitioned(results, config)
    if strict:
        q.require_empty(mixed, "an evaluator answered under several model versions")
    rows = rows.persist()
    treatment = rows.where("superblock_id IS NOT NULL")
    blind = rows.where("superblock_id IS NULL AND block_id IS NOT NULL")
    unit, blind_unit = (P, "superblock_id", "replicate_number"), (P, "block_id", "instruction_condition", "replicate_number")
    kept, status = _gated(treatment, unit, CELL, 8)
    kept_blind, blind_status = _gated(blind, blind_unit, ("position",), 2)
    control_blind = kept_blind.where(F.col("instruction_condition") == fx.CONTROL)

    group = (P, "contrast_id", "instruction_condition")
    strength = fx.baseline_strength(control_blind, (P,))
    pairs = fx.pair_effects(fx.cell_rates(kept, group), group)
    pairs = fx.with_baseline_strength(pairs, strength, (P, *fx.PAIR)).persist()
    items = (
        pairs.select(P, *fx.PAIR)
        .unionByName(kept_blind.select(P, *fx.PAIR))
        .select(P, F.explode(F.array(*fx.PAIR)).alias("story_id"))
        .distinct()
        .persist()
    )
    only_pairs = fx.instruction_only_pairs(kept_blind, (P,))
    partitions = sorted(r[P] for r in pairs.select(P).distinct().collect())

    def of(table: DataFrame, partition: str) -> DataFrame:
        return table.where(F.col(P) == partition)

    tables: dict[str, DataFrame] = {
        "unmatched_rows": unmatched,
        "mixed_versions": mixed,
        "pair_context_effects": pairs,
        "cue_ates": fx.average_effects(pairs, group),
        "controllability_points": fx.controllability_points(fx.average_effects(pairs, group), (P, "contrast_id")),
        "position_effects": fx.position_means(pairs, group),
        "leave_one_story_out": fx.leave_one_item_out_grid(pairs, items, group, (P,), "d_pair"),
        "baseline_pair_strength": strength,
        "baseline_reliability": q.split_half_reliability(control_blind, (P,)),
        "ambiguity_fit": rs.ambiguity_fit(pairs, group),
        "instruction_only_pair_effects": only_pairs,
        "instruction_only_effects": fx.instruction_only_summary(only_pairs, (P,)),
        "response_compliance": q.compliance(rows, group),
        "cell_counts": q.resolved_cells(
            kept.select(P, "contrast_id", *CELL).unionByName(control_blind.select(P, "contrast_id", *CELL)),
            (P, "contrast_id", *CELL),
        ),
        "unit_counts": q.unit_counts(status, (P,)),
        "baseline_unit_counts": q.unit_counts(blind_status, (P, "instruction_condition")),
        "incomplete_units": status.where("NOT complete").select(
            P, F.lit("treatment_superblock").alias("unit_type"), F.col("superblock_id").alias("unit_id"), *_STATUS
        ).unionByName(
            blind_status.where("NOT complete").select(
                P,
                F.concat_ws("_", F.lit("baseline_unit"), "instruction_condition").alias("unit_type"),
                F.col("block_id").alias("unit_id"),
                *_STATUS,
            )
        ),
    }
    if partitions:
        # Each evaluator resamples its own item list.
        joint = {p: rs.controllability_draws(of(pairs, p), of(items, p), (P, "contrast_id"), draws, seed) for p in partitions}
        tables |= {
            "cue_ate_intervals": _each(
                partitions, lambda p: rs.ate_intervals(of(pairs, p), of(items, p), group, draws, seed)
            ),
            "controllability_intervals": _each(
                partitions, lambda p: rs.controllability_intervals(joint[p], (P, "contrast_id"))
            ),
            "equivalence_results": _each(
                partitions,
                lambda p: rs.equivalence(joint[p], (P, "contrast_id"), config.equivalence_margin, frozen),
            ),
            "ambiguity_intervals": _each(
                partitions, lambda p: rs.slope_intervals(of(pairs, p), of(items, p), group, draws, seed)
            ),
            "instruction_only_intervals": _each(
                partitions,
                lambda p: rs.percentile_intervals(
                    rs.resampled_means(of(only_pairs, p), of(items, p), (P,), "instruction_only_effect", draws, seed), (P,)
                ),
            ),
        }
    attempts = use.flatten_attempts(rows.select(P, *IDENTITY, "attempts"), (P, *IDENTITY))
    usage = use.usage_totals(attempts, (P, "provider", "requested_model"))
    models = use.value_inventory(attempts, (P,), "response_model")
    tables |= {
        "response_models": models,
        "system_fingerprints": use.value_inventory(attempts, (P,), "system_fingerprint"),
        "evaluator_inventory": use.evaluator_inventory(usage, models, q.unit_counts(status, (P,)), (P,)),
    }
    if rates is not None:
        tables["cost_summary"] = use.cost_summary(usage, rates, ("provider", "requested_model"))
    tag = {"experiment_id": F.lit(config.experiment_id), "corpus_id": F.lit(config.corpus_id)}
    return {name: table.withColumns(tag) if P in table.columns else table for name, table in tables.items()}


_STATUS = ("replicate_number", "n_cells_present", "n_cells_expected", "n_terminally_failed", "reason")
