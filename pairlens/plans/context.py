"""Context benchmark analysis, and the shared loading of collapsed observations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.functions.answers import RATING_FIELDS
from pairlens.operators import agreement as agr
from pairlens.operators import collapse as col
from pairlens.operators import effects as fx
from pairlens.operators import quality as q

META = (
    "type", "experiment_id", "block_id", "story_id", "story_1_id", "story_2_id", "story_a_id", "story_b_id", "contrast_id",
    "condition_id", "dimension", "value", "assignment", "position", "evaluation_regime", "choice_mode",
    "prompt_context_text", "response_format",
)
IDENTITY = ("provider", "requested_model", "response_model", "reasoning_profile", "execution_mode", "request_id")
BY = ("model", "evaluation_regime", "contrast_id", "category")


def observations(attempts: DataFrame, manifest: DataFrame) -> DataFrame:
    """Collapsed, resolved attempts with their metadata; ``has_metadata`` flags the gaps."""
    carried = [c for c in (*IDENTITY, "trial_meta", "reasoning_tokens") if c in attempts.columns]
    collapsed = col.collapse_attempts(attempts, col.CONTEXT_KEY, carry=carried)
    return col.with_metadata(collapsed.where("resolved"), manifest, META)


def categories_of(rows: DataFrame, categories: Sequence[str] = RATING_FIELDS) -> DataFrame:
    """Unpivot answers into (category, choice): a plain letter is overall_quality."""
    plain = F.col("answer").isin("A", "B")
    choices = F.when(plain, F.create_map(F.lit("overall_quality"), F.col("answer"))).otherwise(
        F.from_json("answer", "map<string,string>")
    )
    return fx.by_category(rows.withColumn("__c", choices), "__c", categories)


def pairwise_tables(forced: DataFrame) -> dict[str, DataFrame]:
    """Every table derived from forced-choice cells (one data-sized aggregation)."""
    cells = fx.cell_counts(forced).persist()
    effects = fx.directional_effects(cells)
    summary = fx.effect_summary(effects)
    four = fx.four_cell_table(cells)
    loo = fx.leave_one_item_out(effects)
    items = fx.per_item_effects(effects, detail_digits=3)
    return {
        "directional_effects": effects,
        "effects_by_contrast": summary,
        "four_cell_rates": four,
        "position_effects": fx.position_interaction(four),
        "per_story_effects": items,
        "widest_stories": fx.widest_items(items),
        "leave_one_story_out": loo,
        "leave_one_story_out_range": fx.leave_one_out_range(loo),
        "regime_comparison": fx.regime_comparison(summary, fx.GROUP),
    }


def analyse(
    attempts: DataFrame,
    manifest: DataFrame,
    sampling_regime: str,
    reference: DataFrame | None = None,
    edges: DataFrame | None = None,
) -> dict[str, DataFrame]:
    everything = observations(attempts, manifest).persist()
    kept, excluded = q.isolate(
        everything.where("has_metadata"), F.col("sampling_regime").eqNullSafe(F.lit(sampling_regime))
    )
    kept = kept.persist()
    pairwise = categories_of(kept.where("type = 'context_pairwise'"))
    forced = fx.forced_pairwise(pairwise)
    tables = {
        "inventory": col.inventory(
            everything, ("type", "model", "sampling_regime", "evaluation_regime", "dimension", "contrast_id", "replicate_id")
        ),
        "missing_metadata": everything.where("NOT has_metadata").select(*col.CONTEXT_KEY),
        "excluded_by_regime": excluded,
        **pairwise_tables(forced),
    }
    changes = fx.choice_changes(forced)
    ties = fx.tie_rates(fx.cell_counts(pairwise.where("choice_mode = 'tie_allowed'")))
    prompt_rows = categories_of(kept.where("type = 'context_prompt'"))
    prompt_key = ("model", "evaluation_regime", "story_a_id", "story_b_id", "contrast_id", "replicate_id", "category")
    prompt_changes = fx.prompt_context_changes(prompt_rows, prompt_key)
    singles = kept.where("type = 'context_single'").withColumn("ratings", F.from_json("answer", "map<string,double>"))
    rated = fx.by_rating(singles)
    deltas = fx.treatment_deltas(rated)
    delta_means = fx.delta_means(deltas, by_item=False)
    overall = rated.where("category = 'overall_quality'")
    conditions = ("dimension", "value")
    score_group = ("model", "evaluation_regime", *conditions)
    scores = agr.item_means(overall, conditions)
    tally = agr.win_tally(forced.where("category = 'overall_quality'"), ("model", "evaluation_regime"))
    tables |= {
        "pairwise_changes": changes,
        "pairwise_change_rates": fx.change_rates(changes, BY),
        "tie_rates": ties,
        "tie_rate_summary": fx.tie_rate_summary(ties),
        "prompt_changes": prompt_changes,
        "prompt_change_rates": fx.change_rates(prompt_changes, BY),
        "treatment_deltas": deltas,
        "delta_by_story": fx.delta_means(deltas, by_item=True),
        "delta_by_condition": delta_means,
        "single_regime_comparison": fx.regime_comparison(
            delta_means, ("model", "evaluation_regime", "dimension", "value", "category"), "mean_delta"
        ),
        "single_text_rankings": agr.average_ranks(scores, score_group, "mean_score"),
        "pairwise_rankings": agr.average_ranks(
            tally.withColumn("score", F.col("copeland").cast("double")), ("model", "evaluation_regime"), "score"
        ),
    }
    if edges is not None:
        outcomes = agr.reference_agreement(forced.where("category = 'overall_quality'"), edges)
        tables["reference_outcomes"] = outcomes
        tables["reference_agreement"] = agr.agreement_summary(outcomes, ("model", "evaluation_regime"))
        if reference is not None:
            ranking = agr.reference_scores(reference)
            tables["single_reference_comparison"] = agr.reference_comparison(
                scores, ranking, edges, score_group, "story_id", "mean_score"
            )
            tables["pairwise_reference_comparison"] = agr.reference_comparison(
                tally.withColumn("score", F.col("copeland").cast("double")), ranking, edges,
                ("model", "evaluation_regime"), "story_id", "score",
            )
    return tables
