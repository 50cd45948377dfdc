import pytest
from pyspark.sql import functions as F

from pairlens.operators import effects as fx
from pairlens.operators import quality as q
from pairlens.operators import usage as use
from tests.builders import OBS, block, four
from tests.conftest import one, rows_of

G = fx.GROUP


def table(spark, *blocks):
    return spark.createDataFrame([r for b in blocks for r in b], OBS)


def test_directional_effect_and_interaction(spark):
    cells = fx.cell_counts(fx.forced_pairwise(table(spark, block(four(8, 4, 6, 2)))))
    row = one(fx.directional_effects(cells))
    assert row["effect"] == pytest.approx(0.2) and row["n_value_a"] == 20
    pos = one(fx.position_interaction(fx.four_cell_table(cells)))
    assert pos["position_effect_pooled"] == pytest.approx(0.4)
    cells = fx.cell_counts(table(spark, block(four(9, 7, 6, 1))))
    assert one(fx.directional_effects(cells))["effect"] == pytest.approx(0.45)
    pos = one(fx.position_interaction(fx.four_cell_table(cells)))
    assert pos["context_x_position_interaction"] == pytest.approx(-0.3)


def test_tie_allowed_rows_are_never_pooled(spark):
    mixed = table(spark, block(four(10, 10, 0, 0)), block(four(0, 0, 10, 10), mode="tie_allowed"))
    row = one(fx.directional_effects(fx.cell_counts(fx.forced_pairwise(mixed))))
    assert row["effect"] == pytest.approx(1.0) and row["n_value_a"] == 20


def test_incomplete_blocks_are_skipped(spark):
    wins = four(8, 4, 6, 2)
    del wins[("flipped", "story2_as_a")]
    cells = fx.cell_counts(table(spark, block(wins)))
    assert fx.four_cell_table(cells).isEmpty()
    assert fx.directional_effects(fx.cell_counts(table(spark, block({("forward", "story1_as_a"): 3})))).isEmpty()


def test_effect_changes_sign_when_values_swap(spark):
    wins = four(9, 7, 6, 1)
    swapped = {("flipped" if a == "forward" else "forward", p): w for (a, p), w in wins.items()}
    effects = [one(fx.directional_effects(fx.cell_counts(table(spark, block(w)))))["effect"] for w in (wins, swapped)]
    assert effects[0] == pytest.approx(-effects[1])


def pair_table(spark, values, column="effect"):
    rows = [("m", "naturalistic", "k", "overall_quality", a, b, v) for (a, b), v in values.items()]
    return spark.createDataFrame(rows, f"model string, evaluation_regime string, contrast_id string, category string, story_1_id string, story_2_id string, {column} double")


def test_leave_one_out(spark):
    effects = pair_table(spark, {("a", "b"): 0.4, ("a", "c"): 0.6, ("b", "c"): 0.2})
    got = {r["excluded_story_id"]: (round(r["mean_effect"], 9), r["n_pairs"]) for r in fx.leave_one_item_out(effects).collect()}
    assert got == {"a": (0.2, 1), "b": (0.6, 1), "c": (0.4, 1), fx.NO_EXCLUSION: (0.4, 3)}
    items = spark.createDataFrame([("m", i) for i in "abcd"], "model string, story_id string")
    grid = fx.leave_one_item_out_grid(effects, items, G, ("model",), "effect")
    assert {r["excluded_story_id"]: round(r["mean_effect_without"], 9) for r in grid.collect()} == {"a": 0.2, "b": 0.6, "c": 0.4, "d": 0.4}
    # One pair: removing either item leaves nothing.
    single = pair_table(spark, {("a", "b"): 0.4})
    assert rows_of(fx.leave_one_item_out(single), "excluded_story_id") == [(fx.NO_EXCLUSION,)]
    grid = fx.leave_one_item_out_grid(single, items, G, ("model",), "effect")
    assert {r["excluded_story_id"]: r["mean_effect_without"] for r in grid.collect()} == {"a": None, "b": None, "c": 0.4, "d": 0.4}


def test_one_odd_item(spark):
    from itertools import combinations

    blocks = [block(four(*([9, 9, 1, 1] if "a" in p else [5, 5, 5, 5])), pair=p) for p in combinations("abcd", 2)]
    loo = fx.leave_one_item_out(fx.directional_effects(fx.cell_counts(table(spark, *blocks))))
    assert {r["excluded_story_id"]: r["mean_effect"] for r in loo.collect()}["a"] == pytest.approx(0.0)


def test_per_item_detail(spark):
    effects = pair_table(spark, {("a", "b"): 0.4, ("a", "c"): -0.1})
    row = one(fx.per_item_effects(effects, detail_digits=3).where("story_id = 'a'"))
    assert row["per_opponent_effects"] == "b=+0.400; c=-0.100" and row["range_effect"] == pytest.approx(0.5)


@pytest.mark.parametrize(
    "cells, d, position",
    [((0.7, 0.6, 0.5, 0.4), 0.2, 0.1), ((0.9, 0.1, 0.9, 0.1), 0.0, 0.8)],
)
def test_pair_effects(spark, cells, d, position):
    rows = [("k", "matched_control", "a", "b", a, p, 10, r) for (a, p), r in zip(fx.CELLS, cells)]
    rates = spark.createDataFrame(rows, "contrast_id string, instruction_condition string, story_1_id string, story_2_id string, assignment string, position string, n int, rate double")
    got = one(fx.pair_effects(rates, ("contrast_id", "instruction_condition")))
    assert got["d_pair"] == pytest.approx(d) and got["position_effect"] == pytest.approx(position)
    assert fx.pair_effects(rates.limit(3), ("contrast_id", "instruction_condition")).isEmpty()


def test_controllability_measures(spark):
    wide = spark.createDataFrame([("k", 0.20, 0.05)], "contrast_id string, ate_control double, ate_text_only double")
    row = one(fx.controllability_measures(wide))
    assert row["magnitude_reduction"] == pytest.approx(0.15)
    assert row["signed_instruction_difference"] == pytest.approx(-0.15)
    assert row["residual_text_only_effect"] == pytest.approx(0.05)


def test_suppression(spark):
    pairs = [(1.0, 0.4, 0.6, 0.6), (0.2, 0.8, -0.6, -0.6), (1.0, -1.0, 0.0, 2.0)]
    df = spark.createDataFrame(pairs, "effect_naturalistic double, effect_text_only_invariance double, s double, d double")
    for r in fx.suppression(df).collect():
        assert r["suppression_magnitude"] == pytest.approx(r["s"]) and r["signed_regime_difference"] == pytest.approx(r["d"])


def test_label_matrix_marks_unmeasured_pairs(spark):
    summary = pair_table(spark, {("x", "y"): 0.3}).select("model", "contrast_id", F.lit(0.3).alias("mean_effect"), F.lit(66).alias("n_pairs"))
    summary = summary.unionByName(summary.withColumn("contrast_id", F.lit("q")).withColumn("mean_effect", F.lit(-0.1)))
    labels = spark.createDataFrame([("k", "L1", "L2"), ("q", "L2", "L3")], "contrast_id string, label_a string, label_b string")
    got = {(r["row_label"], r["column_label"]): r["directional_effect"] for r in fx.label_matrix(summary, labels, ("model",)).collect()}
    assert got[("L1", "L2")] == 0.3 and got[("L2", "L1")] == -0.3 and got[("L1", "L1")] == 0.0 and got[("L1", "L3")] is None
    assert len(got) == 9


def test_prompt_baseline_choice(spark):
    rows = [(1, "x", "text", "A"), (1, "none", "", "B"), (2, "p", "t", "A"), (2, "o", "t", "A"), (3, "only", "", "A")]
    df = spark.createDataFrame(rows, "k int, value string, prompt_context_text string, choice string")
    got = rows_of(fx.prompt_context_changes(df, ("k",)), "k", "baseline_value", "treatment_value", "changed")
    assert got == [(1, "none", "x", True), (2, "o", "p", False)]


def test_pilot_shift(spark):
    schema = "trial_type string, model string, story_a_id string, story_b_id string, replicate_id int, condition string, preference int"
    rows = [("comparison", "m", "a", "b", 1, "self_vs_ai", 1), ("comparison", "m", "a", "b", 1, "ai_vs_self", -1), ("comparison", "m", "a", "c", 1, "self_vs_ai", 2)]
    shifts = fx.label_swap_shifts(spark.createDataFrame(rows, schema), "self_vs_ai", "ai_vs_self", "s")
    row = one(shifts)
    assert (row["shift"], row["advantage"]) == (2, 1.0)
    assert one(fx.shift_summary(shifts).where("replicate_id IS NULL AND item_low IS NULL"))["mean_shift"] == 2.0


def test_cost_rules(spark):
    schema = "provider string, input_tokens bigint, output_tokens bigint, reasoning_tokens bigint, prompt_cache_hit_tokens bigint, prompt_cache_miss_tokens bigint"
    rates = spark.createDataFrame([("p", 0.1, 1.0, 2.0), ("q", 0.1, 1.0, 2.0)], "provider string, cache_hit_input double, cache_miss_input double, output double")
    rows = [("p", 100, 10, None, 80, 20), ("q", 100, 10, 5, None, None), ("z", 100, 10, 5, None, None)]
    cost = use.cost_summary(use.usage_totals(spark.createDataFrame(rows, schema), ("provider",)), rates, ("provider",))
    got = {r["provider"]: r for r in cost.collect()}
    assert got["p"]["estimated_input_cost_usd"] == pytest.approx((80 * 0.1 + 20 * 1.0) / 1e6)
    assert got["q"]["estimated_input_cost_usd"] == pytest.approx(100 / 1e6) and got["q"]["cache_hit_prompt_tokens"] is None
    assert got["z"]["estimated_total_cost_usd"] is None and not got["z"]["is_priced"]


def test_unit_gate(spark):
    cells = [(c, a, p) for c in ("matched_control", "text_only") for a, p in fx.CELLS]
    rows = [("full", *c, "resolved") for c in cells] + [("short", *c, "resolved") for c in cells[:7]]
    rows += [("failed", *c, "resolved") for c in cells[:7]] + [("failed", *cells[7], "unresolved")]
    rows += [("repeat", *c, "resolved") for c in cells[:7]] + [("repeat", *cells[0], "resolved")]
    df = spark.createDataFrame(rows, "u string, instruction_condition string, assignment string, position string, s string")
    status = q.unit_status(df, ("u",), ("instruction_condition", "assignment", "position"), 8, F.col("s") == "resolved")
    assert {r["u"]: r["reason"] for r in status.collect()} == {
        "full": None, "short": "temporarily_incomplete", "failed": "terminally_incomplete", "repeat": "temporarily_incomplete",
    }
    assert q.complete_rows(df, status, ("u",)).count() == 8


def test_partitioning_does_not_change_results(spark):
    df = table(spark, block(four(9, 7, 6, 1)), block(four(3, 4, 5, 6), pair=("s1", "s3")))
    results = [rows_of(fx.leave_one_item_out(fx.directional_effects(fx.cell_counts(df.repartition(n)))), "excluded_story_id", "mean_effect") for n in (1, 17)]
    assert results[0] == results[1]
