"""Pilot analysis: retry collapse, identical-text controls, label-swap shifts, rating effects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.operators import collapse as col
from pairlens.operators import effects as fx
from pairlens.sources.readers import parse_pilot_ids
from pairlens.sources.writers import observation_export

# Condition pairs that only swap the labelled side, ordered so that a
# positive shift moves towards the AI label.
SHIFT_SWAPS = (("self_vs_ai", "ai_vs_self"), ("journal_vs_ai", "ai_vs_journal"))
RATING_SWAPS = (("self_vs_ai", "ai_vs_self"), ("ai_vs_journal", "journal_vs_ai"))
_PAIR_ANSWER = "struct<story_a: map<string,int>, story_b: map<string,int>, preference: int>"


def comparisons(observations: DataFrame) -> DataFrame:
    """Comparison observations with their preference and both rating maps."""
    answer = F.from_json("answer", _PAIR_ANSWER)
    rows = observations.where("trial_type IN ('comparison', 'comparison_control')").withColumn("__p", answer)
    return rows.select(
        "trial_type", "model", "replicate_id", "condition",
        F.col("story_a").alias("story_a_id"), F.col("story_b").alias("story_b_id"),
        F.col("__p.preference").alias("preference"),
        F.col("__p.story_a").alias("ratings_a"), F.col("__p.story_b").alias("ratings_b"),
    )


def analyse(attempts: DataFrame) -> dict[str, DataFrame]:
    collapsed = col.collapse_attempts(attempts, col.PILOT_KEY)
    observations = parse_pilot_ids(collapsed.where("resolved")).persist()
    compared = comparisons(observations)
    shifts = [fx.label_swap_shifts(compared, a, b, f"{a} vs {b}") for a, b in SHIFT_SWAPS]
    swaps = shifts[0].unionByName(shifts[1])
    rated = [fx.rating_effects(compared, a, b, f"{a} vs {b}") for a, b in RATING_SWAPS]
    effects = rated[0].unionByName(rated[1])
    return {
        "totals": col.collapse_totals(collapsed),
        "inventory": col.inventory(observations, ("trial_type", "condition", "replicate_id")),
        "unrecognised_ids": observations.where("trial_type IS NULL").select("trial_id"),
        "observation_summary": observation_export(observations),
        "control_summary": fx.control_ties(compared),
        "provenance_swaps": swaps,
        "shift_summary": fx.shift_summary(swaps),
        "rating_effects": effects,
        "rating_effect_means": fx.rating_effect_means(effects),
    }
