"""Counterbalanced effect estimation.

Everything starts from one row per non-empty design cell (``cell_counts`` or
``cell_rates``): that aggregation is the only data-sized shuffle, it combines
map-side, and its output grows with the design, not with the number of judgements.
Estimates keep full precision; nothing is rounded between stages.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.functions.common import null_safe_join, ratio, share
from pairlens.functions.scalars import SUMMATION_NOISE, attenuation_label, chosen_item, first_item_chosen, is_forced

PAIR = ("story_1_id", "story_2_id")
# The four cells of a block and the label of the row without exclusion.
ASSIGNMENTS = ("forward", "flipped")
POSITIONS = ("story1_as_a", "story2_as_a")
CELLS = tuple((a, p) for a in ASSIGNMENTS for p in POSITIONS)
NO_EXCLUSION = "(none -- full aggregate)"
NATURAL, RESTRAINED = "naturalistic", "text_only_invariance"
CONTROL, TEXT_ONLY = "matched_control", "text_only"

GROUP = ("model", "evaluation_regime", "contrast_id", "category")


# -- shaping -----------------------------------------------------------------------------


def by_category(observations: DataFrame, choices: str, categories: Sequence[str] | None = None) -> DataFrame:
    """Unpivot a ``map<category, choice>`` column into ``category`` and ``choice`` rows."""
    rows = observations.select("*", F.explode(choices).alias("category", "choice")).drop(choices)
    return rows.where(F.col("category").isin(*categories)) if categories is not None else rows


def forced_pairwise(observations: DataFrame) -> DataFrame:
    """Forced-choice pairwise rows only; tie-allowed rows are never pooled with them."""
    rows = observations
    if "type" in rows.columns:
        rows = rows.where("type = 'context_pairwise'")
    if "choice_mode" in rows.columns:
        rows = rows.where(is_forced(F.col("choice_mode")))
    return rows


def _is_cell(assignment: str, position: str) -> Column:
    return (F.col("assignment") == assignment) & (F.col("position") == position)


def _label(assignment: str, position: str) -> str:
    return f"{assignment}_{position}"


# -- pooled counts (context benchmark, controllability v1) ---------------------------------


def cell_counts(rows: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    """n, wins of either item and ties per (group, pair, assignment, position)."""
    chosen = chosen_item(F.col("choice"), F.col("story_a_id"), F.col("story_b_id"))
    return rows.groupBy(*group, *PAIR, "assignment", "position").agg(
        F.count("*").alias("n"),
        F.count_if(chosen == F.col("story_1_id")).alias("wins_1"),
        F.count_if(chosen == F.col("story_2_id")).alias("wins_2"),
        F.count_if(chosen.isNull()).alias("ties"),
    )


def directional_effects(cells: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    """P(item 1 wins | it carries value a) - P(item 1 wins | it carries value b), per pair.

    Counts are pooled over display positions; ties count in n but not as wins; both
    assignments are required.
    """

    def total(column: str, assignment: str) -> Column:
        return F.sum(F.when(F.col("assignment") == assignment, F.col(column)))

    wide = cells.groupBy(*group, *PAIR).agg(
        total("n", "forward").alias("n_value_a"),
        total("wins_1", "forward").alias("__wins_a"),
        total("ties", "forward").alias("tie_n_value_a"),
        total("n", "flipped").alias("n_value_b"),
        total("wins_1", "flipped").alias("__wins_b"),
        total("ties", "flipped").alias("tie_n_value_b"),
    )
    p_a, p_b = ratio(F.col("__wins_a"), F.col("n_value_a")), ratio(F.col("__wins_b"), F.col("n_value_b"))
    return (
        wide.where("n_value_a > 0 AND n_value_b > 0")
        .withColumns({"p_value_a": p_a, "p_value_b": p_b, "effect": p_a - p_b})
        .drop("__wins_a", "__wins_b")
    )


def effect_summary(effects: DataFrame, group: Sequence[str] = GROUP, value: str = "effect") -> DataFrame:
    """Mean, min, max, range and number of pairs of an effect per group."""
    v = F.col(value)
    return effects.where(v.isNotNull()).groupBy(*group).agg(
        F.avg(v).alias("mean_effect"),
        F.min(v).alias("min_effect"),
        F.max(v).alias("max_effect"),
        (F.max(v) - F.min(v)).alias("range_effect"),
        F.count("*").alias("n_pairs"),
    )


def four_cell_table(cells: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    """Raw wins and n of the four cells side by side; complete blocks only."""
    columns = []
    for a, p in CELLS:
        for source, suffix in (("wins_1", "story_1_wins"), ("wins_2", "story_2_wins"), ("n", "n")):
            columns.append(F.sum(F.when(_is_cell(a, p), F.col(source))).alias(f"{_label(a, p)}_{suffix}"))
    wide = cells.groupBy(*group, *PAIR).agg(*columns)
    complete = " AND ".join(f"{_label(a, p)}_n > 0" for a, p in CELLS)
    return wide.where(complete)


def position_interaction(four_cells: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    """Context effect at each position, their interaction and the position effects."""

    def rate(*cells: tuple[str, str]) -> Column:
        wins = sum((F.col(f"{_label(*c)}_story_1_wins") for c in cells), F.lit(0))
        n = sum((F.col(f"{_label(*c)}_n") for c in cells), F.lit(0))
        return ratio(wins, n)

    fwd_a, fwd_b, flp_a, flp_b = (rate(c) for c in CELLS)
    at_a = rate(("forward", "story1_as_a"), ("flipped", "story1_as_a"))
    at_b = rate(("forward", "story2_as_a"), ("flipped", "story2_as_a"))
    return four_cells.select(
        *group,
        *PAIR,
        (fwd_a - flp_a).alias("context_effect_at_position_a"),
        (fwd_b - flp_b).alias("context_effect_at_position_b"),
        ((fwd_a - flp_a) - (fwd_b - flp_b)).alias("context_x_position_interaction"),
        (at_a - at_b).alias("position_effect_pooled"),
        (fwd_a - fwd_b).alias("position_effect_under_forward"),
        (flp_a - flp_b).alias("position_effect_under_flipped"),
    )


def per_item_effects(
    effects: DataFrame, group: Sequence[str] = GROUP, value: str = "effect", detail_digits: int | None = None
) -> DataFrame:
    """Spread of an item's pair effects over its opponents.

    ``detail_digits`` adds the ordered ``opponent=+0.123; ...`` text.  That text
    holds one entry per opponent, so leave it off for very large item sets; the
    numbers need no such list.
    """
    side = F.explode(
        F.array(
            F.struct(F.col("story_1_id").alias("item"), F.col("story_2_id").alias("opponent")),
            F.struct(F.col("story_2_id").alias("item"), F.col("story_1_id").alias("opponent")),
        )
    )
    rows = effects.where(F.col(value).isNotNull()).select(*group, F.col(value).alias("__v"), side.alias("__s"))
    v = F.col("__v")
    columns = [
        F.count("*").alias("n_opponents"),
        F.avg(v).alias("mean_effect"),
        F.min(v).alias("min_effect"),
        F.max(v).alias("max_effect"),
        (F.max(v) - F.min(v)).alias("range_effect"),
    ]
    if detail_digits is not None:
        entries = F.array_sort(F.collect_list(F.struct(F.col("__s.opponent").alias("o"), v.alias("v"))))
        texts = F.transform(entries, lambda e: F.format_string(f"%s=%+.{detail_digits}f", e["o"], e["v"]))
        columns.append(F.array_join(texts, "; ").alias("per_opponent_effects"))
    return rows.groupBy(*group, F.col("__s.item").alias("story_id")).agg(*columns)


def widest_items(per_item: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` items whose effects spread widest (a top-n report)."""
    return per_item.orderBy(F.desc("range_effect"), *[c for c in (*GROUP, "story_id") if c in per_item.columns]).limit(n)


# -- leave one out -------------------------------------------------------------------------


def _touching_sums(effects: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Sum and count per (group, item), plus the group total under a NULL item."""
    who = F.explode(F.array(F.lit(None).cast("string"), F.col("story_1_id"), F.col("story_2_id")))
    rows = effects.where(F.col(value).isNotNull()).select(*group, F.col(value).alias("__v"), who.alias("__item"))
    return rows.groupBy(*group, "__item").agg(F.sum("__v").alias("__s"), F.count("*").alias("__n"))


def leave_one_item_out(effects: DataFrame, group: Sequence[str] = GROUP, value: str = "effect") -> DataFrame:
    """Group mean without each item in turn, and without exclusion.

    One pass: the mean without item k is (S - S_k) / (N - N_k).  Items whose removal
    leaves nothing are skipped.
    """
    sums = _touching_sums(effects, group, value)
    totals = sums.where("__item IS NULL").select(*group, F.col("__s").alias("__total_s"), F.col("__n").alias("__total_n"))
    rest = null_safe_join(sums, totals, group)
    full = F.col("__item").isNull()
    return (
        rest.withColumns(
            {
                "excluded_story_id": F.coalesce("__item", F.lit(NO_EXCLUSION)),
                "n_pairs": F.when(full, F.col("__total_n")).otherwise(F.col("__total_n") - F.col("__n")),
                "__sum": F.when(full, F.col("__total_s")).otherwise(F.col("__total_s") - F.col("__s")),
            }
        )
        .where("n_pairs > 0")
        .select(*group, "excluded_story_id", ratio(F.col("__sum"), F.col("n_pairs")).alias("mean_effect"), "n_pairs")
    )


def leave_one_item_out_grid(
    effects: DataFrame, items: DataFrame, group: Sequence[str], scope: Sequence[str], value: str
) -> DataFrame:
    """Leave-one-out over a given item list: NULL where nothing remains.

    ``items`` holds (scope..., story_id); ``scope`` is the part of ``group`` an item
    list belongs to, so items meet groups through an equi-join.
    """
    sums = _touching_sums(effects, group, value)
    totals = sums.where("__item IS NULL").select(*group, F.col("__s").alias("__total_s"), F.col("__n").alias("__total_n"))
    grid = null_safe_join(totals, items.select(*scope, "story_id"), scope)
    touching = sums.where("__item IS NOT NULL").withColumnRenamed("__item", "story_id")
    joined = null_safe_join(grid, touching, [*group, "story_id"], "left")
    left_n = F.col("__total_n") - F.coalesce("__n", F.lit(0))
    left_s = F.when(left_n > 0, F.col("__total_s") - F.coalesce("__s", F.lit(0.0)))
    return joined.select(
        *group, F.col("story_id").alias("excluded_story_id"), ratio(left_s, left_n).alias("mean_effect_without")
    )


def leave_one_out_range(leave_one_out: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    """Full aggregate beside the range of its leave-one-out means."""
    full = F.col("excluded_story_id") == NO_EXCLUSION
    mean = F.col("mean_effect")
    return leave_one_out.groupBy(*group).agg(
        F.max(F.when(full, mean)).alias("full_effect"),
        F.min(F.when(~full, mean)).alias("min_without_item"),
        F.max(F.when(~full, mean)).alias("max_without_item"),
    )


# -- ties, regimes, label matrix -----------------------------------------------------------


def tie_rates(cells: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    """P(item 1), P(item 2), P(tie) per pair and assignment of the tie-allowed task."""
    pooled = cells.groupBy(*group, *PAIR, "assignment").agg(
        *[F.sum(c).alias(c) for c in ("n", "wins_1", "wins_2", "ties")]
    )
    return pooled.select(
        *group,
        *PAIR,
        "assignment",
        ratio(F.col("wins_1"), F.col("n")).alias("p_story_1_chosen"),
        ratio(F.col("wins_2"), F.col("n")).alias("p_story_2_chosen"),
        ratio(F.col("ties"), F.col("n")).alias("p_tie"),
        "n",
    )


def tie_rate_summary(rates: DataFrame) -> DataFrame:
    """Mean, min and max tie rate, overall (NULL assignment) and by assignment."""
    return rates.rollup("assignment").agg(
        F.avg("p_tie").alias("mean_tie_rate"),
        F.min("p_tie").alias("min_tie_rate"),
        F.max("p_tie").alias("max_tie_rate"),
        F.count("*").alias("n_cells"),
    )


def regime_comparison(
    summary: DataFrame, group: Sequence[str], value: str = "mean_effect", zero_tol: float = SUMMATION_NOISE
) -> DataFrame:
    """The same effect under both regimes with its attenuation label; both required."""

    def under(regime: str) -> Column:
        return F.max(F.when(F.col("evaluation_regime") == regime, F.col(value)))

    keys = [g for g in group if g != "evaluation_regime"]
    wide = summary.groupBy(*keys).agg(
        under(NATURAL).alias("effect_naturalistic"), under(RESTRAINED).alias("effect_text_only_invariance")
    )
    return wide.where("effect_naturalistic IS NOT NULL AND effect_text_only_invariance IS NOT NULL").withColumn(
        "attenuation",
        attenuation_label(F.col("effect_naturalistic"), F.col("effect_text_only_invariance"), zero_tol),
    )


def suppression(comparison: DataFrame) -> DataFrame:
    """How much the instruction shrank an effect, in size and signed."""
    nat, txt = F.col("effect_naturalistic"), F.col("effect_text_only_invariance")
    return comparison.withColumns(
        {"suppression_magnitude": F.abs(nat) - F.abs(txt), "signed_regime_difference": nat - txt}
    )


def label_matrix(summary: DataFrame, labels: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Antisymmetric label x label table of contrast effects.

    ``labels`` maps contrast_id to (label_a, label_b).  The diagonal is 0; a pair of
    labels that was never contrasted is NULL with n_pairs 0, not a made-up zero.
    """
    tagged = summary.join(labels, "contrast_id")
    directed = tagged.select(
        *scope,
        F.explode(
            F.array(
                F.struct(F.col("label_a").alias("r"), F.col("label_b").alias("c"), F.col("mean_effect").alias("e")),
                F.struct(F.col("label_b").alias("r"), F.col("label_a").alias("c"), (-F.col("mean_effect")).alias("e")),
            )
        ).alias("d"),
        "n_pairs",
    ).select(
        *scope,
        F.col("d.r").alias("row_label"),
        F.col("d.c").alias("column_label"),
        F.col("d.e").alias("directional_effect"),
        "n_pairs",
    )
    names = directed.select(*scope, F.col("row_label").alias("name")).distinct()
    grid = null_safe_join(
        names.withColumnRenamed("name", "row_label"), names.withColumnRenamed("name", "column_label"), scope
    )
    cells = null_safe_join(grid, directed, [*scope, "row_label", "column_label"], "left")
    diagonal = F.col("row_label") == F.col("column_label")
    return cells.select(
        *scope,
        "row_label",
        "column_label",
        F.when(diagonal, F.lit(0.0)).otherwise(F.col("directional_effect")).alias("directional_effect"),
        F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"),
    )


# -- rate averages (controllability v2) ----------------------------------------------------


def cell_rates(rows: DataFrame, group: Sequence[str]) -> DataFrame:
    """Rate of choosing item 1 per cell, over answered rows."""
    chosen = first_item_chosen(F.col("choice"), F.col("story_a_id"), F.col("story_b_id"), F.col("story_1_id"))
    return (
        rows.groupBy(*group, *PAIR, "assignment", "position")
        .agg(F.count_if(chosen).alias("__w"), F.count(chosen).alias("n"))
        .where("n > 0")
        .withColumn("rate", ratio(F.col("__w"), F.col("n")))
        .drop("__w")
    )


def pair_effects(rates: DataFrame, group: Sequence[str]) -> DataFrame:
    """D_pair and its position diagnostics; only pairs with exactly the four cells."""

    def at(a: str, p: str) -> Column:
        return F.max(F.when(_is_cell(a, p), F.col("rate")))

    wide = rates.groupBy(*group, *PAIR).agg(
        at("forward", "story1_as_a").alias("__fa"),
        at("flipped", "story1_as_a").alias("__la"),
        at("forward", "story2_as_a").alias("__fb"),
        at("flipped", "story2_as_a").alias("__lb"),
        F.count("*").alias("__k"),
    )
    at_a, at_b = F.col("__fa") - F.col("__la"), F.col("__fb") - F.col("__lb")
    four = "__k = 4 AND __fa IS NOT NULL AND __la IS NOT NULL AND __fb IS NOT NULL AND __lb IS NOT NULL"
    return wide.where(four).select(
        *group,
        *PAIR,
        ((at_a + at_b) / 2).alias("d_pair"),
        at_a.alias("context_effect_at_a"),
        at_b.alias("context_effect_at_b"),
        (at_a - at_b).alias("context_x_position_interaction"),
        ((F.col("__fa") + F.col("__la")) / 2 - (F.col("__fb") + F.col("__lb")) / 2).alias("position_effect"),
    )


def average_effects(pairs: DataFrame, group: Sequence[str], value: str = "d_pair") -> DataFrame:
    """Unweighted mean over pairs."""
    return pairs.groupBy(*group).agg(F.avg(value).alias("ate"), F.count(value).alias("n_pairs"))


def position_means(pairs: DataFrame, group: Sequence[str]) -> DataFrame:
    """Means of the position diagnostics over pairs."""
    return pairs.groupBy(*group).agg(
        F.count("*").alias("n_pairs"),
        F.avg("context_effect_at_a").alias("context_effect_at_a"),
        F.avg("context_effect_at_b").alias("context_effect_at_b"),
        F.avg("context_x_position_interaction").alias("context_x_position_interaction"),
        F.avg("position_effect").alias("position_effect"),
    )


def controllability_points(ates: DataFrame, group: Sequence[str]) -> DataFrame:
    """Control and text-only averages side by side with their derived measures."""

    def under(condition: str) -> Column:
        return F.max(F.when(F.col("instruction_condition") == condition, F.col("ate")))

    wide = ates.groupBy(*group).agg(under(CONTROL).alias("ate_control"), under(TEXT_ONLY).alias("ate_text_only"))
    return controllability_measures(wide.where("ate_control IS NOT NULL AND ate_text_only IS NOT NULL"))


def controllability_measures(wide: DataFrame) -> DataFrame:
    """Derived measures of ``ate_control`` and ``ate_text_only``."""
    control, text_only = F.col("ate_control"), F.col("ate_text_only")
    return wide.withColumns(
        {
            "signed_instruction_difference": text_only - control,
            "magnitude_reduction": F.abs(control) - F.abs(text_only),
            "residual_text_only_effect": text_only,
        }
    )


# -- blind baseline ------------------------------------------------------------------------


def baseline_strength(rows: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Smoothed preference, margin and log-odds per pair without any context."""
    chosen = first_item_chosen(F.col("choice"), F.col("story_a_id"), F.col("story_b_id"), F.col("story_1_id"))
    counts = rows.groupBy(*group, *PAIR).agg(
        F.count_if(chosen).alias("baseline_wins_story1"), F.count(chosen).alias("baseline_n")
    )
    wins, n = F.col("baseline_wins_story1"), F.col("baseline_n")
    p = (wins + 0.5) / (n + 1)
    log_odds = F.ln((wins + 0.5) / (n - wins + 0.5))
    return counts.where("baseline_n > 0").withColumns(
        {
            "baseline_p": p,
            "baseline_margin": 2 * F.abs(p - 0.5),
            "baseline_signed_log_odds": log_odds,
            "baseline_strength": F.abs(log_odds),
        }
    )


def baseline_margin(rows: DataFrame, group: Sequence[str] = ("model",)) -> DataFrame:
    """Unsmoothed preference and decisiveness per pair, both positions pooled."""
    chosen = chosen_item(F.col("choice"), F.col("story_a_id"), F.col("story_b_id"))
    counts = rows.groupBy(*group, *PAIR).agg(
        F.count("*").alias("n"), F.count_if(chosen == F.col("story_1_id")).alias("__w")
    )
    p = ratio(F.col("__w"), F.col("n"))
    return counts.withColumns({"p_story1_wins": p, "baseline_margin": 2 * F.abs(p - 0.5)}).drop("__w")


def effect_with_margin(effects: DataFrame, margins: DataFrame, on: Sequence[str]) -> DataFrame:
    """Each pair's effect beside its blind margin; pairs without a baseline are dropped."""
    side = margins.select(*on, "baseline_margin", "p_story1_wins")
    return null_safe_join(effects.where("effect IS NOT NULL"), side, on).withColumn("abs_effect", F.abs("effect"))


def with_baseline_strength(pairs: DataFrame, strength: DataFrame, on: Sequence[str] = PAIR) -> DataFrame:
    """Attach the baseline strength of each pair, NULL where there is none."""
    return null_safe_join(pairs, strength.select(*on, "baseline_strength"), on, "left")


def instruction_only_pairs(rows: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Text-only minus control rate of choosing item 1, without context, per pair."""
    chosen = first_item_chosen(F.col("choice"), F.col("story_a_id"), F.col("story_b_id"), F.col("story_1_id"))

    def rate(condition: str) -> Column:
        return share(F.when(F.col("instruction_condition") == condition, chosen))

    wide = rows.groupBy(*group, *PAIR).agg(
        rate(CONTROL).alias("matched_control_rate"), rate(TEXT_ONLY).alias("text_only_rate")
    )
    return wide.where("matched_control_rate IS NOT NULL AND text_only_rate IS NOT NULL").withColumn(
        "instruction_only_effect", F.col("text_only_rate") - F.col("matched_control_rate")
    )


def instruction_only_summary(pairs: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    mean = F.avg("instruction_only_effect")
    return pairs.groupBy(*group).agg(
        F.count("*").alias("n_pairs"),
        mean.alias("effect_probability_points"),
        (mean * 100).alias("effect_percentage_points"),
    )


# -- change diagnostics --------------------------------------------------------------------


def choice_changes(
    rows: DataFrame, group: Sequence[str] = GROUP, replicate: str = "replicate_id", position: str = POSITIONS[0]
) -> DataFrame:
    """Raw choice under forward against flipped, same replicate, one fixed position.

    (key, assignment) is unique by design, so the self-join is one aggregation.
    """
    fixed = rows.where(F.col("position") == position)

    def under(assignment: str, value: Column) -> Column:
        return F.max(F.when(F.col("assignment") == assignment, value))

    chosen = F.coalesce(chosen_item(F.col("choice"), F.col("story_a_id"), F.col("story_b_id")), F.lit("tie"))
    wide = fixed.groupBy(*group, *PAIR, replicate).agg(
        under("forward", F.col("choice")).alias("forward_choice"),
        under("forward", chosen).alias("forward_chosen_story_id"),
        under("flipped", F.col("choice")).alias("flipped_choice"),
        under("flipped", chosen).alias("flipped_chosen_story_id"),
    )
    return wide.where("forward_choice IS NOT NULL AND flipped_choice IS NOT NULL").withColumn(
        "changed", F.col("forward_choice") != F.col("flipped_choice")
    )


def prompt_context_changes(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Every other value of a prompt context against the baseline value of its key.

    The baseline is the value with empty text; without one, the smallest value id.
    Keys with a single value give no row.  The baseline is found by aggregation and
    joined back, so a key with many values is never gathered in one place.
    """
    empty = F.coalesce(F.col("prompt_context_text"), F.lit("")) == ""
    picked = F.min_by(F.struct("value", "choice"), F.struct((~empty).cast("int"), F.col("value")))
    base = rows.groupBy(*key).agg(picked.alias("__base"))
    joined = null_safe_join(rows, base, key)
    return joined.where(F.col("value") != F.col("__base.value")).select(
        *key,
        F.col("__base.value").alias("baseline_value"),
        F.col("value").alias("treatment_value"),
        F.col("__base.choice").alias("baseline_choice"),
        F.col("choice").alias("treatment_choice"),
        (F.col("__base.choice") != F.col("choice")).alias("changed"),
    )


def change_rates(changes: DataFrame, by: Sequence[str]) -> DataFrame:
    """Share of changed rows overall and by each single column of ``by``, in one pass."""
    sets = [[]] + [[c] for c in by]
    level = F.concat_ws(",", *[F.when(F.grouping(c) == 0, F.lit(c)) for c in by])
    return changes.groupingSets(sets, *by).agg(
        level.alias("grouped_by"),
        F.count("*").alias("n"),
        F.count_if("changed").alias("n_changed"),
        share(F.col("changed")).alias("change_rate"),
    )


# -- single-text ratings -------------------------------------------------------------------


def by_rating(observations: DataFrame, ratings: str = "ratings") -> DataFrame:
    """Unpivot a ``map<category, rating>`` column."""
    return observations.select("*", F.explode(ratings).alias("category", "rating")).drop(ratings)


def neutral_means(rows: DataFrame) -> DataFrame:
    """Mean neutral rating per model, item, regime and category."""
    return (
        rows.where("dimension = 'neutral'")
        .groupBy("model", "story_id", "evaluation_regime", "category")
        .agg(F.avg("rating").alias("neutral_mean"))
    )


def treatment_deltas(rows: DataFrame) -> DataFrame:
    """Rating minus the item's own neutral mean under the same regime.

    The neutral side is one row per (model, item, regime, category): far smaller
    than the ratings, and AQE turns the join into a broadcast when it is small enough.
    """
    keys = ["model", "story_id", "evaluation_regime", "category"]
    treated = rows.where("dimension <> 'neutral'")
    return null_safe_join(treated, neutral_means(rows), keys).withColumn("delta", F.col("rating") - F.col("neutral_mean"))


def delta_means(deltas: DataFrame, by_item: bool) -> DataFrame:
    """Mean delta per condition and category, with or without the item."""
    keys = ["model", "evaluation_regime", *(["story_id"] if by_item else []), "dimension", "value", "category"]
    return deltas.groupBy(*keys).agg(F.avg("delta").alias("mean_delta"), F.count("*").alias("n"))


# -- pilot comparisons ---------------------------------------------------------------------


def control_ties(rows: DataFrame) -> DataFrame:
    """Preference distribution of identical-text controls, per condition and in total.

    The total row has a NULL condition.
    """
    pref = F.col("preference")
    return (
        rows.where("trial_type = 'comparison_control'")
        .rollup("condition")
        .agg(
            F.count("*").alias("n"),
            F.avg(pref).alias("mean_preference"),
            F.count_if(pref == 0).alias("tie_count"),
            (share(pref == 0) * 100).alias("tie_pct"),
            *[F.count_if(pref == v).alias(n) for v, n in PREFERENCE_BINS],
        )
    )


PREFERENCE_BINS = ((-2, "pref_neg2"), (-1, "pref_neg1"), (0, "pref_0"), (1, "pref_pos1"), (2, "pref_pos2"))
PILOT_KEY = ("model", "story_a_id", "story_b_id", "replicate_id")
# Which side carries the AI label under each comparison condition.
AI_SIDE: Mapping[str, str] = {"self_vs_ai": "b", "ai_vs_self": "a", "ai_vs_journal": "a", "journal_vs_ai": "b"}


def label_swap_shifts(rows: DataFrame, condition_a: str, condition_b: str, swap: str) -> DataFrame:
    """Preference under one condition minus the same trial's preference under the other."""

    def under(condition: str) -> Column:
        return F.max(F.when(F.col("condition") == condition, F.col("preference")))

    wide = (
        rows.where(F.col("trial_type") == "comparison")
        .where(F.col("condition").isin(condition_a, condition_b))
        .groupBy(*PILOT_KEY)
        .agg(under(condition_a).alias("pref_condition_a"), under(condition_b).alias("pref_condition_b"))
    )
    shift = F.col("pref_condition_a") - F.col("pref_condition_b")
    return wide.where("pref_condition_a IS NOT NULL AND pref_condition_b IS NOT NULL").withColumns(
        {
            "swap": F.lit(swap),
            "condition_a": F.lit(condition_a),
            "condition_b": F.lit(condition_b),
            "shift": shift,
            "advantage": shift / 2,
        }
    )


def shift_summary(shifts: DataFrame) -> DataFrame:
    """Signs and mean of the shifts: overall, by replicate and by unordered pair."""
    rows = shifts.withColumns(
        {"item_low": F.least("story_a_id", "story_b_id"), "item_high": F.greatest("story_a_id", "story_b_id")}
    )
    s = F.col("shift")
    return rows.groupingSets([["swap"], ["swap", "replicate_id"], ["swap", "item_low", "item_high"]], "swap", "replicate_id", "item_low", "item_high").agg(
        F.count("*").alias("n"),
        F.count_if(s > 0).alias("n_positive"),
        F.count_if(s == 0).alias("n_zero"),
        F.count_if(s < 0).alias("n_negative"),
        F.avg(s).alias("mean_shift"),
        (F.avg(s) / 2).alias("advantage"),
    )


def rating_effects(rows: DataFrame, condition_x: str, condition_y: str, swap: str) -> DataFrame:
    """Rating of the same item at the same position with the AI label minus without it."""

    def under(condition: str, side: str) -> Column:
        return F.first(F.when(F.col("condition") == condition, F.col(f"ratings_{side}")), ignorenulls=True)

    def labelled(side: str) -> tuple[str, str]:
        return (condition_x, condition_y) if AI_SIDE[condition_x] == side else (condition_y, condition_x)

    columns = [
        under(c, side).alias(f"__{name}_{side}")
        for side in ("a", "b")
        for name, c in zip(("ai", "other"), labelled(side))
    ]
    wide = (
        rows.where(F.col("trial_type") == "comparison")
        .where(F.col("condition").isin(condition_x, condition_y))
        .groupBy(*PILOT_KEY)
        .agg(F.count_distinct("condition").alias("__k"), *columns)
        .where("__k = 2")
    )
    sides = F.explode(
        F.array(
            *[
                F.struct(
                    F.col(f"story_{s}_id").alias("story"),
                    F.lit(s.upper()).alias("position"),
                    F.col(f"__ai_{s}").alias("ai"),
                    F.col(f"__other_{s}").alias("other"),
                )
                for s in ("a", "b")
            ]
        )
    )
    long = wide.select("model", "replicate_id", sides.alias("s")).select(
        "model", "replicate_id", "s.*", F.explode("s.ai").alias("dimension", "ai_rating")
    )
    return long.select(
        F.lit(swap).alias("swap"),
        "model",
        "story",
        "position",
        "replicate_id",
        "dimension",
        (F.col("ai_rating") - F.element_at("other", F.col("dimension"))).alias("ai_minus_other"),
    )


def rating_effect_means(effects: DataFrame) -> DataFrame:
    return effects.groupBy("swap", "dimension").agg(
        F.count("*").alias("n"), F.avg("ai_minus_other").alias("mean_ai_minus_other")
    )
