"""Contract queries of the effect operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.contract.registry import query
from pairlens.functions.common import rounded
from pairlens.operators import effects as fx
from pairlens.operators.ordering import dealt
from pairlens.session import fresh_path
from pairlens.sources import fixtures as fix
from pairlens.sources import writers

V2 = ("contrast_id", "instruction_condition")


def present(df: DataFrame) -> DataFrame:
    """Round every double for comparison across engines."""
    return df.select(
        *[rounded(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )


def r9(*names: str) -> str:
    """SQL counterpart of :func:`present` for the named columns."""
    return ", ".join(f"round({n}, 9) + 0.0 AS {n.split('.')[-1]}" for n in names)


def forced(spark: SparkSession, sf: str) -> DataFrame:
    return fix.judgements(spark, sf).withColumn("category", F.lit("overall_quality"))


def cells(spark: SparkSession, sf: str) -> DataFrame:
    return fx.cell_counts(forced(spark, sf))


def directional(spark: SparkSession, sf: str) -> DataFrame:
    return fx.directional_effects(cells(spark, sf))


def rates(spark: SparkSession, sf: str) -> DataFrame:
    return fx.cell_rates(fix.judgements(spark, sf), V2)


def d_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return fx.pair_effects(rates(spark, sf), V2)


def control_baseline(spark: SparkSession, sf: str) -> DataFrame:
    return fix.baseline(spark, sf).where("instruction_condition = 'matched_control'")


@query("cell_rates", f"SELECT * EXCLUDE (rate), {r9('rate')} FROM v_rates")
def _(spark, sf):
    return present(rates(spark, sf))


@query(
    "pair_effects",
    f"""SELECT contrast_id, instruction_condition, story_1_id, story_2_id, {r9('d_pair')},
        round(at_a, 9) + 0.0 AS context_effect_at_a, round(at_b, 9) + 0.0 AS context_effect_at_b,
        round(interaction, 9) + 0.0 AS context_x_position_interaction, {r9('position_effect')} FROM v_dpairs""",
)
def _(spark, sf):
    return present(d_pairs(spark, sf))


@query("ate_by_contrast", f"SELECT contrast_id, instruction_condition, {r9('ate')}, n_pairs FROM v_ates")
def ate_by_contrast(spark, sf):
    return present(fx.average_effects(d_pairs(spark, sf), V2))


@query(
    "directional_effects",
    f"""SELECT model, evaluation_regime, contrast_id, category, story_1_id, story_2_id, n_value_a, n_value_b,
        0::BIGINT AS tie_n_value_a, 0::BIGINT AS tie_n_value_b, round(wa / n_value_a, 9) + 0.0 AS p_value_a,
        round(wb / n_value_b, 9) + 0.0 AS p_value_b, {r9('effect')} FROM v_effects""",
)
def _(spark, sf):
    return present(directional(spark, sf))


@query(
    "effects_by_contrast",
    f"""SELECT model, evaluation_regime, contrast_id, category,
        {r9('mean_effect', 'min_effect', 'max_effect', 'range_effect')}, n_pairs FROM v_by_contrast""",
)
def _(spark, sf):
    return present(fx.effect_summary(directional(spark, sf)))


@query(
    "four_cell_counts",
    """SELECT model, evaluation_regime, contrast_id, category, story_1_id, story_2_id,
       faw1 AS forward_story1_as_a_story_1_wins, faw2 AS forward_story1_as_a_story_2_wins, fan AS forward_story1_as_a_n,
       fbw1 AS forward_story2_as_a_story_1_wins, fbw2 AS forward_story2_as_a_story_2_wins, fbn AS forward_story2_as_a_n,
       law1 AS flipped_story1_as_a_story_1_wins, law2 AS flipped_story1_as_a_story_2_wins, lan AS flipped_story1_as_a_n,
       lbw1 AS flipped_story2_as_a_story_1_wins, lbw2 AS flipped_story2_as_a_story_2_wins, lbn AS flipped_story2_as_a_n
       FROM v_four""",
)
def _(spark, sf):
    return fx.four_cell_table(cells(spark, sf))


@query(
    "position_interaction",
    """SELECT model, evaluation_regime, contrast_id, category, story_1_id, story_2_id,
       round(faw1 / fan - law1 / lan, 9) + 0.0 AS context_effect_at_position_a,
       round(fbw1 / fbn - lbw1 / lbn, 9) + 0.0 AS context_effect_at_position_b,
       round((faw1 / fan - law1 / lan) - (fbw1 / fbn - lbw1 / lbn), 9) + 0.0 AS context_x_position_interaction,
       round((faw1 + law1) / (fan + lan) - (fbw1 + lbw1) / (fbn + lbn), 9) + 0.0 AS position_effect_pooled,
       round(faw1 / fan - fbw1 / fbn, 9) + 0.0 AS position_effect_under_forward,
       round(law1 / lan - lbw1 / lbn, 9) + 0.0 AS position_effect_under_flipped
       FROM v_four""",
)
def _(spark, sf):
    return present(fx.position_interaction(fx.four_cell_table(cells(spark, sf))))


@query(
    "position_summary",
    """SELECT contrast_id, instruction_condition, count(*) AS n_pairs, round(avg(at_a), 9) + 0.0 AS context_effect_at_a,
       round(avg(at_b), 9) + 0.0 AS context_effect_at_b,
       round(avg(interaction), 9) + 0.0 AS context_x_position_interaction,
       round(avg(position_effect), 9) + 0.0 AS position_effect
       FROM v_dpairs GROUP BY ALL""",
)
def _(spark, sf):
    return present(fx.position_means(d_pairs(spark, sf), V2))


SIDES = """SELECT model, evaluation_regime, contrast_id, category, story_1_id AS story_id, story_2_id AS opp, effect FROM v_effects
           UNION ALL
           SELECT model, evaluation_regime, contrast_id, category, story_2_id, story_1_id, effect FROM v_effects"""


@query(
    "per_item_effects",
    f"""SELECT model, evaluation_regime, contrast_id, category, story_id, count(*) AS n_opponents,
        round(avg(effect), 9) + 0.0 AS mean_effect, round(min(effect), 9) + 0.0 AS min_effect,
        round(max(effect), 9) + 0.0 AS max_effect, round(max(effect) - min(effect), 9) + 0.0 AS range_effect,
        string_agg(opp || '=' || printf('%+.9f', effect), '; ' ORDER BY opp) AS per_opponent_effects
        FROM ({SIDES}) GROUP BY ALL""",
)
def _(spark, sf):
    return present(fx.per_item_effects(directional(spark, sf), detail_digits=9))


@query(
    "widest_items",
    f"""SELECT model, evaluation_regime, contrast_id, category, story_id, count(*) AS n_opponents,
        round(avg(effect), 9) + 0.0 AS mean_effect, round(min(effect), 9) + 0.0 AS min_effect,
        round(max(effect), 9) + 0.0 AS max_effect, round(max(effect) - min(effect), 9) + 0.0 AS range_effect
        FROM ({SIDES}) GROUP BY ALL
        ORDER BY max(effect) - min(effect) DESC, model, evaluation_regime, contrast_id, category, story_id LIMIT 5""",
)
def _(spark, sf):
    return present(fx.widest_items(fx.per_item_effects(directional(spark, sf))))


LOO = f"""
SELECT model, evaluation_regime, contrast_id, category, '{fx.NO_EXCLUSION}' AS excluded_story_id,
       avg(effect) AS mean_effect, count(*) AS n_pairs FROM v_effects GROUP BY ALL
UNION ALL
SELECT e.model, e.evaluation_regime, e.contrast_id, e.category, k.item, avg(effect), count(*)
FROM v_effects e JOIN (SELECT DISTINCT model, evaluation_regime, contrast_id, category,
                              unnest([story_1_id, story_2_id]) AS item FROM v_effects) k
  ON e.model = k.model AND e.evaluation_regime = k.evaluation_regime AND e.contrast_id = k.contrast_id
 AND e.category = k.category AND e.story_1_id <> k.item AND e.story_2_id <> k.item
GROUP BY ALL"""


@query(
    "leave_one_item_out",
    f"SELECT model, evaluation_regime, contrast_id, category, excluded_story_id, {r9('mean_effect')}, n_pairs FROM ({LOO})",
)
def _(spark, sf):
    return present(fx.leave_one_item_out(directional(spark, sf)))


@query(
    "leave_one_out_range",
    f"""SELECT model, evaluation_regime, contrast_id, category,
        round(max(mean_effect) FILTER (excluded_story_id LIKE '(none%'), 9) + 0.0 AS full_effect,
        round(min(mean_effect) FILTER (excluded_story_id NOT LIKE '(none%'), 9) + 0.0 AS min_without_item,
        round(max(mean_effect) FILTER (excluded_story_id NOT LIKE '(none%'), 9) + 0.0 AS max_without_item
        FROM ({LOO}) GROUP BY ALL""",
)
def _(spark, sf):
    return present(fx.leave_one_out_range(fx.leave_one_item_out(directional(spark, sf))))


@query(
    "leave_one_out_grid",
    """SELECT g.contrast_id, g.instruction_condition, i.item AS excluded_story_id,
       round(avg(d.d_pair) FILTER (d.story_1_id <> i.item AND d.story_2_id <> i.item), 9) + 0.0 AS mean_effect_without
       FROM (SELECT DISTINCT contrast_id, instruction_condition FROM v_dpairs) g
       JOIN (SELECT DISTINCT instruction_condition, unnest([story_1_id, story_2_id]) AS item FROM v_baseline) i
         ON g.instruction_condition = i.instruction_condition
       JOIN v_dpairs d ON d.contrast_id = g.contrast_id AND d.instruction_condition = g.instruction_condition
       GROUP BY ALL""",
)
def _(spark, sf):
    items = (
        fix.baseline(spark, sf)
        .select("instruction_condition", F.explode(F.array("story_1_id", "story_2_id")).alias("story_id"))
        .distinct()
    )
    return present(
        fx.leave_one_item_out_grid(d_pairs(spark, sf), items, V2, ("instruction_condition",), "d_pair")
    )


TIES = """SELECT model, evaluation_regime, contrast_id, 'overall_quality' AS category, story_1_id, story_2_id, assignment,
       count(*) FILTER (tie_choice <> 'tie' AND chosen = story_1_id) / count(*) AS p1,
       count(*) FILTER (tie_choice <> 'tie' AND chosen = story_2_id) / count(*) AS p2,
       count(*) FILTER (tie_choice = 'tie') / count(*) AS p_tie, count(*) AS n
       FROM v_judgements GROUP BY ALL"""


def tie_cells(spark: SparkSession, sf: str) -> DataFrame:
    return fx.cell_counts(forced(spark, sf).withColumn("choice", F.col("tie_choice")))


@query(
    "tie_rates",
    f"""SELECT * EXCLUDE (p1, p2, p_tie), round(p1, 9) + 0.0 AS p_story_1_chosen, round(p2, 9) + 0.0 AS p_story_2_chosen,
        {r9('p_tie')} FROM ({TIES})""",
)
def _(spark, sf):
    return present(fx.tie_rates(tie_cells(spark, sf)))


@query(
    "tie_rate_summary",
    f"""SELECT assignment, round(avg(p_tie), 9) + 0.0 AS mean_tie_rate, round(min(p_tie), 9) + 0.0 AS min_tie_rate,
        round(max(p_tie), 9) + 0.0 AS max_tie_rate, count(*) AS n_cells FROM ({TIES}) GROUP BY ROLLUP (assignment)""",
)
def _(spark, sf):
    return present(fx.tie_rate_summary(fx.tie_rates(tie_cells(spark, sf))))


REGIMES = """SELECT *, CASE
         WHEN abs(nat) <= 1e-12 AND abs(inv) <= 1e-12 THEN 'no_naturalistic_effect' WHEN abs(nat) <= 1e-12 THEN 'invariance_effect_only'
         WHEN abs(inv) <= 1e-12 THEN 'attenuated' WHEN sign(nat) <> sign(inv) THEN 'reversed'
         WHEN abs(inv) / abs(nat) < 0.5 THEN 'attenuated' WHEN abs(inv) / abs(nat) > 1.5 THEN 'amplified'
         ELSE 'unchanged' END AS attenuation
       FROM (SELECT model, contrast_id, category, max(mean_effect) FILTER (evaluation_regime = 'naturalistic') AS nat,
                    max(mean_effect) FILTER (evaluation_regime = 'text_only_invariance') AS inv
             FROM v_by_contrast GROUP BY ALL) WHERE nat IS NOT NULL AND inv IS NOT NULL"""


def regimes(spark: SparkSession, sf: str) -> DataFrame:
    return fx.regime_comparison(fx.effect_summary(directional(spark, sf)), fx.GROUP)


@query(
    "regime_comparison",
    f"""SELECT model, contrast_id, category, round(nat, 9) + 0.0 AS effect_naturalistic,
        round(inv, 9) + 0.0 AS effect_text_only_invariance, attenuation FROM ({REGIMES})""",
)
def _(spark, sf):
    return present(regimes(spark, sf))


@query(
    "suppression",
    f"""SELECT model, contrast_id, category, round(nat, 9) + 0.0 AS effect_naturalistic,
        round(inv, 9) + 0.0 AS effect_text_only_invariance, attenuation,
        round(abs(nat) - abs(inv), 9) + 0.0 AS suppression_magnitude,
        round(nat - inv, 9) + 0.0 AS signed_regime_difference FROM ({REGIMES})""",
)
def _(spark, sf):
    return present(fx.suppression(regimes(spark, sf)))


def labels(spark: SparkSession, sf: str) -> DataFrame:
    """Two labels per contrast, in a ring: some label pairs stay unmeasured."""
    number = F.substring("contrast_id", 2, 9).cast("int")
    contrasts = fix.judgements(spark, sf).select("contrast_id").distinct()
    return contrasts.select(
        "contrast_id",
        F.concat(F.lit("L"), number.cast("string")).alias("label_a"),
        F.concat(F.lit("L"), ((number + 1) % 5).cast("string")).alias("label_b"),
    )


@query(
    "label_matrix",
    """WITH directed AS (
         SELECT model, evaluation_regime, 'L' || contrast_id[2:] AS r,
                'L' || CAST((CAST(contrast_id[2:] AS INTEGER) + 1) % 5 AS VARCHAR) AS c, mean_effect AS e, n_pairs
         FROM v_by_contrast),
       both_ways AS (SELECT * FROM directed UNION ALL SELECT model, evaluation_regime, c, r, -e, n_pairs FROM directed),
       names AS (SELECT DISTINCT model, evaluation_regime, r AS name FROM both_ways)
       SELECT a.model, a.evaluation_regime, a.name AS row_label, b.name AS column_label,
              CASE WHEN a.name = b.name THEN 0.0::DOUBLE ELSE round(e, 9) + 0.0 END AS directional_effect,
              coalesce(n_pairs, 0) AS n_pairs
       FROM names a JOIN names b ON a.model = b.model AND a.evaluation_regime = b.evaluation_regime
       LEFT JOIN both_ways d ON d.model = a.model AND d.evaluation_regime = a.evaluation_regime AND d.r = a.name AND d.c = b.name""",
)
def _(spark, sf):
    summary = fx.effect_summary(directional(spark, sf))
    return present(fx.label_matrix(summary, labels(spark, sf), ("model", "evaluation_regime")))


@query(
    "controllability_points",
    """SELECT contrast_id, round(c, 9) + 0.0 AS ate_control, round(t, 9) + 0.0 AS ate_text_only,
       round(t - c, 9) + 0.0 AS signed_instruction_difference, round(abs(c) - abs(t), 9) + 0.0 AS magnitude_reduction,
       round(t, 9) + 0.0 AS residual_text_only_effect
       FROM (SELECT contrast_id, max(ate) FILTER (instruction_condition = 'matched_control') AS c,
                    max(ate) FILTER (instruction_condition = 'text_only') AS t FROM v_ates GROUP BY ALL)
       WHERE c IS NOT NULL AND t IS NOT NULL""",
)
def _(spark, sf):
    return present(fx.controllability_points(fx.average_effects(d_pairs(spark, sf), V2), ("contrast_id",)))


MODEL_POINTS = """SELECT model, contrast_id, max(ate) FILTER (instruction_condition = 'matched_control') AS c, max(ate) FILTER (instruction_condition = 'text_only') AS t
    FROM (SELECT model, contrast_id, instruction_condition, avg(((fa - la) + (fb - lb)) / 2) AS ate
          FROM (SELECT model, contrast_id, instruction_condition, story_1_id, story_2_id,
                       max(rate) FILTER (assignment = 'forward' AND position = 'story1_as_a') AS fa, max(rate) FILTER (assignment = 'flipped' AND position = 'story1_as_a') AS la,
                       max(rate) FILTER (assignment = 'forward' AND position = 'story2_as_a') AS fb, max(rate) FILTER (assignment = 'flipped' AND position = 'story2_as_a') AS lb
                FROM (SELECT model, contrast_id, instruction_condition, story_1_id, story_2_id, assignment, position, avg((chosen = story_1_id)::INTEGER) AS rate FROM v_judgements GROUP BY ALL)
                GROUP BY ALL) WHERE fa IS NOT NULL AND la IS NOT NULL AND fb IS NOT NULL AND lb IS NOT NULL GROUP BY ALL) GROUP BY ALL"""


@query(
    "headline_summary",
    f"""WITH p AS (SELECT * FROM ({MODEL_POINTS}) WHERE c IS NOT NULL AND t IS NOT NULL)
        SELECT 'cross_model_summary' AS record, model AS evaluator_id, contrast_id, round(c, 9) + 0.0 AS ate_control, round(t, 9) + 0.0 AS ate_text_only,
               round(abs(c) - abs(t), 9) + 0.0 AS magnitude_reduction, NULL::BIGINT AS n_listed FROM p
        UNION ALL SELECT 'evaluator', model, NULL, NULL, NULL, NULL, count(*) FROM p GROUP BY model""",
)
def _(spark, sf):
    """Written as JSON lines, one document per evaluator and one flat row per evaluator and contrast, and read back."""
    group = ("model", *V2)
    pairs = fx.pair_effects(fx.cell_rates(fix.judgements(spark, sf), group), group)
    points = fx.controllability_points(fx.average_effects(pairs, group), ("model", "contrast_id")).persist()
    models = points.select("model").distinct()
    verdicts = points.select("model", "contrast_id").limit(0)
    documents = writers.headline(points, verdicts, models, "model").unionByName(writers.cross_evaluator_summary(points, "model"))
    path = fresh_path(spark, "headline")
    writers.write_headline(documents, path)
    schema = "record string, model string, evaluator_id string, contrast_id string, ate_control double, ate_text_only double, magnitude_reduction double, controllability_effects array<struct<contrast_id:string>>"
    back = spark.read.schema(schema).json(path)
    return present(back.select(
        F.coalesce("record", F.lit("evaluator")).alias("record"), F.coalesce("evaluator_id", "model").alias("evaluator_id"), "contrast_id", "ate_control", "ate_text_only", "magnitude_reduction",
        F.when(F.col("record").isNull(), F.size("controllability_effects").cast("bigint")).alias("n_listed"),
    ))


@query(
    "baseline_strength",
    """SELECT story_1_id, story_2_id, w AS baseline_wins_story1, n AS baseline_n,
       round((w + 0.5) / (n + 1), 9) + 0.0 AS baseline_p, round(2 * abs((w + 0.5) / (n + 1) - 0.5), 9) + 0.0 AS baseline_margin,
       round(ln((w + 0.5) / (n - w + 0.5)), 9) + 0.0 AS baseline_signed_log_odds,
       round(strength, 9) + 0.0 AS baseline_strength FROM v_strength""",
)
def _(spark, sf):
    return present(fx.baseline_strength(control_baseline(spark, sf)))


@query(
    "baseline_margin",
    """SELECT model, story_1_id, story_2_id, count(*) AS n,
       round(count(*) FILTER (chosen = story_1_id) / count(*), 9) + 0.0 AS p_story1_wins,
       round(2 * abs(count(*) FILTER (chosen = story_1_id) / count(*) - 0.5), 9) + 0.0 AS baseline_margin
       FROM v_baseline GROUP BY ALL""",
)
def _(spark, sf):
    return present(fx.baseline_margin(fix.baseline(spark, sf)))


ONLY = """SELECT story_1_id, story_2_id,
       avg((chosen = story_1_id)::INTEGER) FILTER (instruction_condition = 'matched_control') AS matched_control_rate,
       avg((chosen = story_1_id)::INTEGER) FILTER (instruction_condition = 'text_only') AS text_only_rate
       FROM v_baseline GROUP BY ALL"""


@query(
    "instruction_only",
    f"""SELECT story_1_id, story_2_id, {r9('matched_control_rate', 'text_only_rate')},
        round(text_only_rate - matched_control_rate, 9) + 0.0 AS instruction_only_effect
        FROM ({ONLY}) WHERE matched_control_rate IS NOT NULL AND text_only_rate IS NOT NULL""",
)
def _(spark, sf):
    return present(fx.instruction_only_pairs(fix.baseline(spark, sf)))


@query(
    "instruction_only_summary",
    f"""SELECT count(*) AS n_pairs, round(avg(text_only_rate - matched_control_rate), 9) + 0.0 AS effect_probability_points,
        round(100 * avg(text_only_rate - matched_control_rate), 9) + 0.0 AS effect_percentage_points
        FROM ({ONLY}) WHERE matched_control_rate IS NOT NULL AND text_only_rate IS NOT NULL""",
)
def _(spark, sf):
    return present(fx.instruction_only_summary(fx.instruction_only_pairs(fix.baseline(spark, sf))))


CHANGES = """SELECT f.evaluation_regime, f.contrast_id, 'overall_quality' AS category, f.story_1_id, f.story_2_id, f.replicate_number,
       f.tie_choice AS forward_choice, CASE WHEN f.tie_choice = 'tie' THEN 'tie' ELSE f.chosen END AS forward_chosen_story_id,
       l.tie_choice AS flipped_choice, CASE WHEN l.tie_choice = 'tie' THEN 'tie' ELSE l.chosen END AS flipped_chosen_story_id,
       f.tie_choice <> l.tie_choice AS changed
       FROM v_judgements_rep f JOIN v_judgements_rep l ON f.superblock_id = l.superblock_id
        AND f.instruction_condition = l.instruction_condition AND f.replicate_number = l.replicate_number
        AND f.assignment = 'forward' AND l.assignment = 'flipped' AND f.position = 'story1_as_a' AND l.position = 'story1_as_a'"""
CHANGE_GROUP = ("evaluation_regime", "contrast_id", "category")


def changes(spark: SparkSession, sf: str) -> DataFrame:
    rows = fix.judgements(spark, sf, replicates=True).withColumns(
        {"category": F.lit("overall_quality"), "choice": F.col("tie_choice")}
    )
    rows = dealt(rows, fix.lines(spark, sf), (*CHANGE_GROUP, *fx.PAIR, "replicate_number"))
    return fx.choice_changes(rows, CHANGE_GROUP, "replicate_number")


@query("choice_changes", CHANGES)
def _(spark, sf):
    return changes(spark, sf)


@query(
    "choice_change_rates",
    f"""SELECT evaluation_regime, contrast_id, category,
        concat_ws(',', CASE WHEN grouping(evaluation_regime) = 0 THEN 'evaluation_regime' END,
                       CASE WHEN grouping(contrast_id) = 0 THEN 'contrast_id' END,
                       CASE WHEN grouping(category) = 0 THEN 'category' END) AS grouped_by,
        count(*) AS n, count(*) FILTER (changed) AS n_changed, round(avg(changed::INTEGER), 9) + 0.0 AS change_rate
        FROM ({CHANGES}) GROUP BY GROUPING SETS ((), (evaluation_regime), (contrast_id), (category))""",
)
def _(spark, sf):
    return present(fx.change_rates(changes(spark, sf), CHANGE_GROUP))


PROMPT_KEY = ("evaluation_regime", "story_a_id", "story_b_id", "replicate_number")


@query(
    "prompt_context_changes",
    """WITH p AS (SELECT evaluation_regime, story_a_id, story_b_id, replicate_number, contrast_id AS value, choice,
                         CASE WHEN contrast_id = 'c2' THEN '' ELSE 'sentence ' || contrast_id END AS txt
                  FROM v_judgements_rep WHERE assignment = 'forward'),
       b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY evaluation_regime, story_a_id, story_b_id, replicate_number
                                                  ORDER BY txt <> '', value) AS rn FROM p) WHERE rn = 1)
       SELECT p.evaluation_regime, p.story_a_id, p.story_b_id, p.replicate_number, b.value AS baseline_value,
              p.value AS treatment_value, b.choice AS baseline_choice, p.choice AS treatment_choice,
              b.choice <> p.choice AS changed
       FROM p JOIN b USING (evaluation_regime, story_a_id, story_b_id, replicate_number) WHERE p.value <> b.value""",
)
def _(spark, sf):
    rows = (
        fix.judgements(spark, sf, replicates=True)
        .where("assignment = 'forward'")
        .withColumns(
            {
                "value": F.col("contrast_id"),
                "prompt_context_text": F.when(F.col("contrast_id") == "c2", "").otherwise(
                    F.concat(F.lit("sentence "), F.col("contrast_id"))
                ),
            }
        )
    )
    return fx.prompt_context_changes(rows, PROMPT_KEY)


# -- ratings -------------------------------------------------------------------------------

DELTAS = """SELECT r.*, m.neutral_mean, rating - m.neutral_mean AS delta
       FROM v_ratings r JOIN (SELECT model, story_id, evaluation_regime, category, avg(rating) AS neutral_mean
                              FROM v_ratings WHERE dimension = 'neutral' GROUP BY ALL) m
         USING (model, story_id, evaluation_regime, category) WHERE dimension <> 'neutral'"""


def deltas(spark: SparkSession, sf: str) -> DataFrame:
    return fx.treatment_deltas(fx.by_rating(fix.ratings(spark, sf)))


@query(
    "neutral_means",
    """SELECT model, story_id, evaluation_regime, category, round(avg(rating), 9) + 0.0 AS neutral_mean
       FROM v_ratings WHERE dimension = 'neutral' GROUP BY ALL""",
)
def _(spark, sf):
    return present(fx.neutral_means(fx.by_rating(fix.ratings(spark, sf))))


@query(
    "treatment_deltas",
    f"""SELECT model, evaluation_regime, story_id, dimension, value, replicate_id, category, {r9('rating', 'neutral_mean', 'delta')}
        FROM ({DELTAS})""",
)
def _(spark, sf):
    return present(deltas(spark, sf))


@query(
    "delta_means_by_item",
    f"""SELECT model, evaluation_regime, story_id, dimension, value, category, round(avg(delta), 9) + 0.0 AS mean_delta,
        count(*) AS n FROM ({DELTAS}) GROUP BY ALL""",
)
def _(spark, sf):
    return present(fx.delta_means(deltas(spark, sf), by_item=True))


DELTA_MEANS = f"""SELECT model, evaluation_regime, dimension, value, category, avg(delta) AS mean_delta, count(*) AS n
                  FROM ({DELTAS}) GROUP BY ALL"""


@query(
    "delta_means",
    f"SELECT model, evaluation_regime, dimension, value, category, {r9('mean_delta')}, n FROM ({DELTA_MEANS})",
)
def _(spark, sf):
    return present(fx.delta_means(deltas(spark, sf), by_item=False))


@query(
    "single_regime_comparison",
    f"""SELECT model, dimension, value, category, round(nat, 9) + 0.0 AS effect_naturalistic,
        round(inv, 9) + 0.0 AS effect_text_only_invariance,
        CASE WHEN abs(nat) <= 1e-12 AND abs(inv) <= 1e-12 THEN 'no_naturalistic_effect' WHEN abs(nat) <= 1e-12 THEN 'invariance_effect_only'
         WHEN abs(inv) <= 1e-12 THEN 'attenuated' WHEN sign(nat) <> sign(inv) THEN 'reversed'
         WHEN abs(inv) / abs(nat) < 0.5 THEN 'attenuated' WHEN abs(inv) / abs(nat) > 1.5 THEN 'amplified'
         ELSE 'unchanged' END AS attenuation
        FROM (SELECT model, dimension, value, category,
                     max(mean_delta) FILTER (evaluation_regime = 'naturalistic') AS nat,
                     max(mean_delta) FILTER (evaluation_regime = 'text_only_invariance') AS inv
              FROM ({DELTA_MEANS}) GROUP BY ALL) WHERE nat IS NOT NULL AND inv IS NOT NULL""",
)
def _(spark, sf):
    keys = ("model", "evaluation_regime", "dimension", "value", "category")
    return present(fx.regime_comparison(fx.delta_means(deltas(spark, sf), by_item=False), keys, "mean_delta"))


# -- pilot comparisons ---------------------------------------------------------------------


@query(
    "control_ties",
    """SELECT condition, count(*) AS n, round(avg(preference), 9) + 0.0 AS mean_preference,
       count(*) FILTER (preference = 0) AS tie_count, round(100 * avg((preference = 0)::INTEGER), 9) + 0.0 AS tie_pct,
       count(*) FILTER (preference = -2) AS pref_neg2, count(*) FILTER (preference = -1) AS pref_neg1,
       count(*) FILTER (preference = 0) AS pref_0, count(*) FILTER (preference = 1) AS pref_pos1,
       count(*) FILTER (preference = 2) AS pref_pos2
       FROM v_comparisons WHERE trial_type = 'comparison_control' GROUP BY ROLLUP (condition)""",
)
def _(spark, sf):
    return present(fx.control_ties(fix.comparisons(spark, sf)))


def _shift_sql(a: str, b: str) -> str:
    return f"""SELECT 'm0' AS model, x.story_a_id, x.story_b_id, x.replicate_id, x.preference AS pref_condition_a,
        y.preference AS pref_condition_b, '{a} vs {b}' AS swap, '{a}' AS condition_a, '{b}' AS condition_b,
        x.preference - y.preference AS shift, (x.preference - y.preference) / 2 AS advantage
        FROM v_comparisons x JOIN v_comparisons y USING (trial_type, story_a_id, story_b_id, replicate_id)
        WHERE trial_type = 'comparison' AND x.condition = '{a}' AND y.condition = '{b}'"""


SWAPS = (("self_vs_ai", "ai_vs_self"), ("journal_vs_ai", "ai_vs_journal"))
SHIFTS = " UNION ALL ".join(_shift_sql(a, b) for a, b in SWAPS)


def shifts(spark: SparkSession, sf: str) -> DataFrame:
    rows = fix.comparisons(spark, sf)
    parts = [fx.label_swap_shifts(rows, a, b, f"{a} vs {b}") for a, b in SWAPS]
    return parts[0].unionByName(parts[1])


@query("label_swap_shifts", SHIFTS)
def _(spark, sf):
    return shifts(spark, sf)


@query(
    "shift_summary",
    f"""SELECT swap, replicate_id, lo AS item_low, hi AS item_high, count(*) AS n, count(*) FILTER (shift > 0) AS n_positive,
        count(*) FILTER (shift = 0) AS n_zero, count(*) FILTER (shift < 0) AS n_negative,
        round(avg(shift), 9) + 0.0 AS mean_shift, round(avg(shift) / 2, 9) + 0.0 AS advantage
        FROM (SELECT *, least(story_a_id, story_b_id) AS lo, greatest(story_a_id, story_b_id) AS hi FROM ({SHIFTS}))
        GROUP BY GROUPING SETS ((swap), (swap, replicate_id), (swap, lo, hi))""",
)
def _(spark, sf):
    return present(fx.shift_summary(shifts(spark, sf)))


def _rating_effect_sql(x: str, y: str) -> str:
    ai_is_a = fx.AI_SIDE[x] == "a"
    side = "SELECT '{x} vs {y}' AS swap, 'm0' AS model, {story} AS story, '{P}' AS position, x.replicate_id, f.category AS dimension, "
    parts = []
    for s, shift in (("a", 0), ("b", 2)):
        ai, other = ("x", "y") if (ai_is_a == (s == "a")) else ("y", "x")
        parts.append(
            side.format(x=x, y=y, story=f"x.story_{s}_id", P=s.upper())
            + f"""(1 + ({ai}.q * f.k + x.replicate_id + {shift}) % 5) - (1 + ({other}.q * f.k + x.replicate_id + {shift}) % 5) AS ai_minus_other
            FROM v_comparisons x JOIN v_comparisons y USING (trial_type, story_a_id, story_b_id, replicate_id) CROSS JOIN v_fields f
            WHERE trial_type = 'comparison' AND x.condition = '{x}' AND y.condition = '{y}'"""
        )
    return " UNION ALL ".join(parts)


RATING_SWAPS = (("self_vs_ai", "ai_vs_self"), ("ai_vs_journal", "journal_vs_ai"))
RATING_EFFECTS = " UNION ALL ".join(_rating_effect_sql(x, y) for x, y in RATING_SWAPS)


def rating_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = fix.comparisons(spark, sf)
    parts = [fx.rating_effects(rows, x, y, f"{x} vs {y}") for x, y in RATING_SWAPS]
    return parts[0].unionByName(parts[1])


@query("rating_effects", RATING_EFFECTS)
def _(spark, sf):
    return rating_rows(spark, sf)


@query(
    "rating_effect_means",
    f"""SELECT swap, dimension, count(*) AS n, round(avg(ai_minus_other), 9) + 0.0 AS mean_ai_minus_other
        FROM ({RATING_EFFECTS}) GROUP BY ALL""",
)
def _(spark, sf):
    return present(fx.rating_effect_means(rating_rows(spark, sf)))
