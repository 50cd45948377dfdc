"""Contract queries of rank statistics, resampling and reference agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairlens.contract.effects import (
    V2, control_baseline, d_pairs, directional, forced, present, r9,
)
from pairlens.contract.registry import query, view
from pairlens.functions import stats
from pairlens.operators import agreement as agr
from pairlens.operators import effects as fx
from pairlens.operators import quality as q
from pairlens.operators import resampling as rs
from pairlens.sources import fixtures as fix

SEED, DRAWS = 20260917, 10_000

# -- ranks ---------------------------------------------------------------------------------

TALLY_GROUP = ("model", "evaluation_regime")
view(
    "v_tally",
    """
SELECT *, wins - losses AS copeland, wins + losses + ties AS games, (wins + 0.5 * ties) / greatest(1, wins + losses + ties) AS win_rate
FROM (SELECT model, evaluation_regime, story_id, count(*) FILTER (tie_choice <> 'tie' AND chosen = story_id) AS wins,
             count(*) FILTER (tie_choice <> 'tie' AND chosen <> story_id) AS losses, count(*) FILTER (tie_choice = 'tie') AS ties
      FROM (SELECT *, unnest([story_a_id, story_b_id]) AS story_id FROM v_judgements) GROUP BY ALL)
""",
)


def tally(spark: SparkSession, sf: str) -> DataFrame:
    return agr.win_tally(fix.judgements(spark, sf).withColumn("choice", F.col("tie_choice")), TALLY_GROUP)


@query("copeland", f"SELECT * EXCLUDE (win_rate), {r9('win_rate')} FROM v_tally")
def _(spark, sf):
    return present(tally(spark, sf))


view(
    "v_item_means",
    """
SELECT model, evaluation_regime, dimension, value, story_id, sum(rating::DECIMAL(18, 6))::DOUBLE / count(*) AS mean_score, count(*) AS n
FROM v_ratings WHERE category = 'overall_quality' GROUP BY ALL
""",
)
CONDITION = ("dimension", "value")
SCORE_GROUP = ("model", "evaluation_regime", "dimension", "value")


def overall(spark: SparkSession, sf: str) -> DataFrame:
    return fx.by_rating(fix.ratings(spark, sf)).where("category = 'overall_quality'")


@query(
    "item_means",
    f"""SELECT model, evaluation_regime, dimension, value, story_id, {r9('mean_score')}, n FROM v_item_means
        UNION ALL SELECT model, evaluation_regime, NULL, NULL, story_id, round(avg(rating), 9) + 0.0, count(*) FROM v_ratings
        WHERE category = 'overall_quality' GROUP BY ALL""",
)
def _(spark, sf):
    return present(agr.item_means(overall(spark, sf), CONDITION, pooled=True))


# Whole points, so that ties occur.
def rounded_means(spark: SparkSession, sf: str) -> DataFrame:
    means = agr.item_means(overall(spark, sf), CONDITION)
    return means.withColumn("score", F.floor(F.col("mean_score") + 1e-9).cast("double"))


RANKED = """SELECT *, rank() OVER (PARTITION BY model, evaluation_regime, dimension, value ORDER BY score DESC)
              + (count(*) OVER (PARTITION BY model, evaluation_regime, dimension, value, score) - 1) / 2 AS rank_position,
            count(*) OVER (PARTITION BY model, evaluation_regime, dimension, value, score) AS tie_group_size
            FROM (SELECT *, floor(mean_score + 1e-9) AS score FROM v_item_means)"""


@query(
    "avg_ranks",
    f"SELECT model, evaluation_regime, dimension, value, story_id, score, n, rank_position, tie_group_size FROM ({RANKED})",
)
def _(spark, sf):
    return agr.average_ranks(rounded_means(spark, sf), SCORE_GROUP, "score").drop("mean_score")


@query(
    "tie_groups",
    f"""SELECT model, evaluation_regime, dimension, value, score, string_agg(story_id, ',' ORDER BY story_id) AS members,
        max(tie_group_size) AS tie_group_size, max(rank_position) AS rank_position FROM ({RANKED}) GROUP BY ALL""",
)
def _(spark, sf):
    groups = agr.tie_groups(rounded_means(spark, sf), SCORE_GROUP, "story_id", "score")
    return groups.withColumn("members", F.array_join("members", ","))


# Ranks over a whole large column: every order price, ties included.
@query(
    "avg_ranks_large",
    """SELECT o_orderkey, o_orderstatus, price, rank() OVER (PARTITION BY o_orderstatus ORDER BY price DESC)
       + (count(*) OVER (PARTITION BY o_orderstatus, price) - 1) / 2 AS rank_position,
       count(*) OVER (PARTITION BY o_orderstatus, price) AS tie_group_size
       FROM (SELECT o_orderkey, o_orderstatus, floor(o_totalprice / 100) AS price FROM orders)""",
)
def _(spark, sf):
    orders = fix.table(spark, sf, "orders").select(
        "o_orderkey", "o_orderstatus", F.floor(F.col("o_totalprice") / 100).cast("double").alias("price")
    )
    return agr.average_ranks(orders, ("o_orderstatus",), "price")


# -- rank correlation ----------------------------------------------------------------------

# tau-b by all pairs: fine for SQL on small groups, and independent of our bit counting.
TAU = """SELECT g, (sum(s) / sqrt((count(*) - sum((dx = 0)::INTEGER)) * (count(*) - sum((dy = 0)::INTEGER)))) AS tau
  FROM (SELECT a.g, sign(a.x - b.x) * sign(a.y - b.y) AS s, a.x - b.x AS dx, a.y - b.y AS dy
        FROM pts a JOIN pts b ON a.g = b.g AND a.id < b.id) GROUP BY g
  HAVING count(*) > sum((dx = 0)::INTEGER) AND count(*) > sum((dy = 0)::INTEGER)"""
RHO = """SELECT g, corr(rx, ry) AS rho FROM (
  SELECT g, rank() OVER (PARTITION BY g ORDER BY x DESC) + (count(*) OVER (PARTITION BY g, x) - 1) / 2 AS rx,
         rank() OVER (PARTITION BY g ORDER BY y DESC) + (count(*) OVER (PARTITION BY g, y) - 1) / 2 AS ry FROM pts) GROUP BY g"""
POINTS = "SELECT 'exact' AS g, item_id AS id, customer_score AS x, supplier_score AS y FROM v_scores UNION ALL SELECT 'coarse', item_id, floor(customer_score / 1000), floor(supplier_score / 1000) FROM v_scores"


def points(spark: SparkSession, sf: str) -> DataFrame:
    s = fix.scores(spark, sf)
    exact = s.select(F.lit("exact").alias("g"), F.col("customer_score").alias("x"), F.col("supplier_score").alias("y"))
    coarse = s.select(
        F.lit("coarse").alias("g"),
        F.floor(F.col("customer_score") / 1000).cast("double").alias("x"),
        F.floor(F.col("supplier_score") / 1000).cast("double").alias("y"),
    )
    return exact.unionByName(coarse)


@query(
    "kendall_tau_b",
    f"""WITH pts AS ({POINTS}), t AS ({TAU})
        SELECT g, round(tau, 9) + 0.0 AS kendall_tau_b, (SELECT count(*) FROM pts p WHERE p.g = n.g) AS n_items
        FROM (SELECT DISTINCT g FROM pts) n LEFT JOIN t USING (g)""",
)
def _(spark, sf):
    return present(agr.kendall_tau_b(points(spark, sf), ("g",), "x", "y"))


@query(
    "spearman",
    f"""WITH pts AS ({POINTS}), t AS ({RHO})
        SELECT g, round(rho, 9) + 0.0 AS spearman, (SELECT count(*) FROM pts p WHERE p.g = n.g) AS n_items
        FROM (SELECT DISTINCT g FROM pts) n LEFT JOIN t USING (g)""",
)
def _(spark, sf):
    return present(agr.spearman(points(spark, sf), ("g",), "x", "y"))


@query("kendall_tau_b_large")
def _(spark, sf):
    """Whole lineitem in three groups: forming pairs is out of reach, so there is no SQL."""
    rows = fix.table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("g"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y")
    )
    return present(agr.kendall_tau_b(rows, ("g",), "x", "y"))


@query(
    "spearman_large",
    """WITH pts AS (SELECT l_returnflag AS g, l_quantity AS x, l_extendedprice AS y FROM lineitem)
       SELECT g, round(corr(rx, ry), 9) + 0.0 AS spearman, count(*) AS n_items FROM (
         SELECT g, rank() OVER (PARTITION BY g ORDER BY x DESC) + (count(*) OVER (PARTITION BY g, x) - 1) / 2 AS rx,
                rank() OVER (PARTITION BY g ORDER BY y DESC) + (count(*) OVER (PARTITION BY g, y) - 1) / 2 AS ry FROM pts) GROUP BY g""",
)
def _(spark, sf):
    rows = fix.table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("g"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y")
    )
    return present(agr.spearman(rows, ("g",), "x", "y"))


# -- reference judgements ------------------------------------------------------------------

view(
    "v_edges",
    """
SELECT CASE WHEN 2 * w > n THEN story_1_id ELSE story_2_id END AS winner,
       CASE WHEN 2 * w > n THEN story_2_id ELSE story_1_id END AS loser
FROM v_strength WHERE 2 * w <> n
""",
)
view(
    "v_reference",
    """
SELECT story_id AS item_id, row_number() OVER (ORDER BY wins DESC, story_id) AS place,
       (count(*) OVER () - row_number() OVER (ORDER BY wins DESC, story_id) + 1)::DOUBLE AS score
FROM (SELECT story_id, count(*) FILTER (chosen = story_id) AS wins
      FROM (SELECT *, unnest([story_a_id, story_b_id]) AS story_id FROM v_baseline) GROUP BY ALL)
""",
)


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """Majority winner of each pair without context; split pairs have none."""
    s = fx.baseline_strength(control_baseline(spark, sf)).where("2 * baseline_wins_story1 <> baseline_n")
    first = F.expr("2 * baseline_wins_story1 > baseline_n")
    return s.select(
        F.when(first, F.col("story_1_id")).otherwise(F.col("story_2_id")).alias("winner"),
        F.when(first, F.col("story_2_id")).otherwise(F.col("story_1_id")).alias("loser"),
    )


def ranking(spark: SparkSession, sf: str) -> DataFrame:
    """The items as one best-first list (as many entries as there are items)."""
    wins = agr.win_tally(fix.baseline(spark, sf), ())
    order = F.array_sort(F.collect_list(F.struct((-F.col("wins")).alias("w"), F.col("story_id").alias("s"))))
    return wins.agg(F.transform(order, lambda e: e["s"]).alias("ranking"))


@query("reference_scores", "SELECT item_id, score FROM v_reference")
def _(spark, sf):
    return agr.reference_scores(ranking(spark, sf))


@query(
    "edge_concordance",
    """SELECT model, evaluation_regime, dimension, value, count(*) FILTER (a.mean_score > b.mean_score) AS concordant,
       count(*) FILTER (a.mean_score < b.mean_score) AS discordant, count(*) FILTER (a.mean_score = b.mean_score) AS tied,
       count(*) AS checked, round(count(*) FILTER (a.mean_score > b.mean_score) / nullif(count(*) FILTER (a.mean_score <> b.mean_score), 0), 9) + 0.0 AS concordant_rate
       FROM v_edges e JOIN v_item_means a ON a.story_id = e.winner
       JOIN v_item_means b USING (model, evaluation_regime, dimension, value) WHERE b.story_id = e.loser GROUP BY ALL""",
)
def _(spark, sf):
    means = agr.item_means(overall(spark, sf), CONDITION)
    return present(agr.edge_concordance(means, edges(spark, sf), SCORE_GROUP, "story_id", "mean_score"))


@query(
    "reference_comparison",
    f"""WITH pts AS (SELECT model || '|' || evaluation_regime AS g, story_id AS id, copeland::DOUBLE AS x, score AS y
                     FROM v_tally JOIN v_reference ON item_id = story_id),
        t AS ({TAU}), r AS ({RHO}),
        c AS (SELECT model || '|' || evaluation_regime AS g, count(*) FILTER (a.copeland > b.copeland) AS c,
                     count(*) FILTER (a.copeland < b.copeland) AS d, count(*) FILTER (a.copeland = b.copeland) AS tied, count(*) AS checked
              FROM v_edges e JOIN v_tally a ON a.story_id = e.winner JOIN v_tally b USING (model, evaluation_regime)
              WHERE b.story_id = e.loser GROUP BY ALL)
        SELECT split_part(g, '|', 1) AS model, split_part(g, '|', 2) AS evaluation_regime, round(tau, 9) + 0.0 AS kendall_tau_b,
               (SELECT count(*) FROM pts p WHERE p.g = t.g) AS n_common, round(rho, 9) + 0.0 AS spearman, c AS concordant,
               d AS discordant, tied, checked, round(c / nullif(c + d, 0), 9) + 0.0 AS concordant_rate
        FROM t JOIN r USING (g) JOIN c USING (g)""",
)
def _(spark, sf):
    scores = tally(spark, sf).withColumn("score", F.col("copeland").cast("double"))
    reference = agr.reference_scores(ranking(spark, sf))
    return present(agr.reference_comparison(scores, reference, edges(spark, sf), TALLY_GROUP, "story_id", "score"))


@query(
    "human_agreement",
    """SELECT model, evaluation_regime, count(*) FILTER (tie_choice <> 'tie' AND chosen = winner) AS concordant,
       count(*) FILTER (tie_choice <> 'tie' AND chosen <> winner) AS discordant, count(*) FILTER (tie_choice = 'tie') AS model_tied,
       count(*) AS n, round(count(*) FILTER (tie_choice <> 'tie' AND chosen = winner) / nullif(count(*) FILTER (tie_choice <> 'tie'), 0), 9) + 0.0 AS concordant_rate
       FROM v_judgements JOIN v_edges ON story_1_id = least(winner, loser) AND story_2_id = greatest(winner, loser) GROUP BY ALL""",
)
def _(spark, sf):
    rows = fix.judgements(spark, sf).withColumn("choice", F.col("tie_choice"))
    return present(agr.agreement_summary(agr.reference_agreement(rows, edges(spark, sf)), TALLY_GROUP))


# A chain with shortcuts over the ranked items, and the majority edges as they are.
view(
    "v_chain",
    """
SELECT a.item_id AS winner, b.item_id AS loser FROM v_reference a JOIN v_reference b ON b.place IN (a.place + 1, a.place + 3)
""",
)


def chain(spark: SparkSession, sf: str) -> DataFrame:
    placed = ranking(spark, sf).select(F.posexplode("ranking").alias("place", "item_id"))
    ahead = placed.select(F.col("item_id").alias("winner"), F.explode(F.array(F.col("place") + 1, F.col("place") + 3)).alias("place"))
    return ahead.join(placed.withColumnRenamed("item_id", "loser"), "place").select("winner", "loser")


def items(spark: SparkSession, sf: str) -> DataFrame:
    return rs.items_of(fix.baseline(spark, sf)).distinct().withColumnRenamed("story_id", "item_id")


LAYERS = """WITH RECURSIVE depth AS (
  SELECT item_id, 1 AS layer FROM v_reference
  UNION SELECT c.loser, d.layer + 1 FROM depth d JOIN v_chain c ON c.winner = d.item_id)
  SELECT item_id, max(layer)::INTEGER AS layer FROM depth GROUP BY ALL"""


@query("total_order", LAYERS)
def _(spark, sf):
    return agr.order_layers(items(spark, sf), chain(spark, sf))


@query("total_order_verdict")
def _(spark, sf):
    """Majority judgements usually hold cycles, which SQL recursion cannot stop on."""
    return agr.order_verdict(agr.order_layers(items(spark, sf), edges(spark, sf)))


@query(
    "contradictions",
    """SELECT DISTINCT least(a.winner, a.loser) AS low, greatest(a.winner, a.loser) AS high
       FROM (SELECT CASE choice WHEN 'A' THEN story_a_id ELSE story_b_id END AS winner,
                    CASE choice WHEN 'A' THEN story_b_id ELSE story_a_id END AS loser FROM v_baseline) a
       JOIN (SELECT CASE choice WHEN 'A' THEN story_a_id ELSE story_b_id END AS winner,
                    CASE choice WHEN 'A' THEN story_b_id ELSE story_a_id END AS loser FROM v_baseline) b
         ON a.winner = b.loser AND a.loser = b.winner""",
)
def _(spark, sf):
    first = F.col("choice") == "A"
    judged = fix.baseline(spark, sf).select(
        F.when(first, F.col("story_a_id")).otherwise(F.col("story_b_id")).alias("winner"),
        F.when(first, F.col("story_b_id")).otherwise(F.col("story_a_id")).alias("loser"),
    )
    return agr.contradictions(judged)


# -- correlation and reliability -----------------------------------------------------------


@query(
    "margin_correlation",
    """SELECT e.model, evaluation_regime, contrast_id, count(*) AS n_pairs,
       CASE WHEN min(margin) < max(margin) AND min(abs(effect)) < max(abs(effect)) THEN round(corr(margin, abs(effect)), 9) + 0.0 END AS r
       FROM v_effects e JOIN (SELECT model, story_1_id, story_2_id,
              2 * abs(count(*) FILTER (chosen = story_1_id) / count(*) - 0.5) AS margin FROM v_baseline GROUP BY ALL) b
         ON e.model = b.model AND e.story_1_id = b.story_1_id AND e.story_2_id = b.story_2_id GROUP BY ALL""",
)
def _(spark, sf):
    margins = fx.baseline_margin(fix.baseline(spark, sf))
    joined = fx.effect_with_margin(directional(spark, sf), margins, ("model", *fx.PAIR))
    r = stats.pearson(F.col("baseline_margin"), F.col("abs_effect"))
    return present(
        joined.groupBy("model", "evaluation_regime", "contrast_id").agg(F.count("*").alias("n_pairs"), r.alias("r"))
    )


@query(
    "split_half",
    """SELECT instruction_condition, round(corr(o, e), 9) + 0.0 AS r_split_half, count(*) AS n_pairs FROM (
         SELECT instruction_condition, story_1_id, story_2_id,
                avg((chosen = story_1_id)::INTEGER) FILTER (replicate_number % 2 = 1) AS o,
                avg((chosen = story_1_id)::INTEGER) FILTER (replicate_number % 2 = 0) AS e FROM v_baseline_rep GROUP BY ALL)
       WHERE o IS NOT NULL AND e IS NOT NULL GROUP BY ALL""",
)
def _(spark, sf):
    rows = fix.baseline(spark, sf, replicates=True)
    return present(q.split_half_reliability(rows, ("instruction_condition",)))


@query(
    "ambiguity_fit",
    """SELECT contrast_id, instruction_condition, count(*) AS n_pairs, round(regr_intercept(y, x), 9) + 0.0 AS intercept,
       round(regr_slope(y, x), 9) + 0.0 AS beta,
       round(regr_intercept(y, x) + regr_slope(y, x) * quantile_cont(x, 0.25), 9) + 0.0 AS predicted_at_p25,
       round(regr_intercept(y, x) + regr_slope(y, x) * quantile_cont(x, 0.5), 9) + 0.0 AS predicted_at_p50,
       round(regr_intercept(y, x) + regr_slope(y, x) * quantile_cont(x, 0.75), 9) + 0.0 AS predicted_at_p75
       FROM v_joined GROUP BY ALL HAVING count(*) >= 2 AND min(x) < max(x)""",
)
def _(spark, sf):
    return present(rs.ambiguity_fit(ambiguity_rows(spark, sf), V2))


def ambiguity_rows(spark: SparkSession, sf: str) -> DataFrame:
    return fx.with_baseline_strength(d_pairs(spark, sf), fx.baseline_strength(control_baseline(spark, sf)))


# -- bootstrap -----------------------------------------------------------------------------

view(
    "v_mult",
    f"""
SELECT d.draw, i.item, count(*) AS m
FROM (SELECT d.draw, s.slot, CAST('0x' || substr(md5('{SEED}:' || CAST(d.draw AS VARCHAR) || ':' || CAST(s.slot AS VARCHAR)), 1, 15) AS BIGINT)
             % (SELECT count(*) FROM v_items) AS idx
      FROM (SELECT unnest(range({DRAWS})) AS draw) d, (SELECT unnest(range((SELECT count(*) FROM v_items))) AS slot) s) d
JOIN v_items i ON i.idx = d.idx GROUP BY ALL
""",
)
view(
    "v_items",
    "SELECT item, row_number() OVER (ORDER BY item) - 1 AS idx FROM (SELECT DISTINCT unnest([story_1_id, story_2_id]) AS item FROM v_dpairs)",
)
view(
    "v_draws",
    """
SELECT contrast_id, instruction_condition, a.draw, sum(a.m * b.m * d_pair) / sum(a.m * b.m) AS estimate
FROM v_dpairs p JOIN v_mult a ON a.item = p.story_1_id JOIN v_mult b ON b.item = p.story_2_id AND b.draw = a.draw GROUP BY ALL
""",
)
CI = """round(quantile_cont(estimate, 0.025), 9) + 0.0 AS ci_95_lo, round(quantile_cont(estimate, 0.05), 9) + 0.0 AS ci_90_lo,
        round(quantile_cont(estimate, 0.95), 9) + 0.0 AS ci_90_hi, round(quantile_cont(estimate, 0.975), 9) + 0.0 AS ci_95_hi"""


@query("bootstrap_draws", f"SELECT contrast_id, instruction_condition, draw, {r9('estimate')} FROM v_draws")
def _(spark, sf):
    pairs = d_pairs(spark, sf).persist()
    return present(rs.resampled_means(pairs, rs.items_of(pairs), V2, "d_pair", DRAWS, SEED))


@query("bootstrap_ate_ci", f"SELECT contrast_id, instruction_condition, count(*) AS n_draws, {CI} FROM v_draws GROUP BY ALL")
def _(spark, sf):
    pairs = d_pairs(spark, sf).persist()
    return present(rs.ate_intervals(pairs, rs.items_of(pairs), V2, DRAWS, SEED))


JOINT = """SELECT c.contrast_id, c.draw, c.estimate AS ate_control, t.estimate AS ate_text_only FROM v_draws c JOIN v_draws t
           ON c.contrast_id = t.contrast_id AND c.draw = t.draw
           WHERE c.instruction_condition = 'matched_control' AND t.instruction_condition = 'text_only'"""


def joint(spark: SparkSession, sf: str) -> DataFrame:
    pairs = d_pairs(spark, sf).persist()
    return rs.controllability_draws(pairs, rs.items_of(pairs), ("contrast_id",), DRAWS, SEED)


@query(
    "bootstrap_controllability",
    f"""WITH j AS ({JOINT}), l AS (
          SELECT contrast_id, 'ate_control' AS measure, ate_control AS estimate FROM j
          UNION ALL SELECT contrast_id, 'ate_text_only', ate_text_only FROM j
          UNION ALL SELECT contrast_id, 'residual_text_only_effect', ate_text_only FROM j
          UNION ALL SELECT contrast_id, 'signed_instruction_difference', ate_text_only - ate_control FROM j
          UNION ALL SELECT contrast_id, 'magnitude_reduction', abs(ate_control) - abs(ate_text_only) FROM j)
        SELECT contrast_id, measure, count(*) AS n_draws, {CI} FROM l GROUP BY ALL""",
)
def _(spark, sf):
    return present(rs.controllability_intervals(joint(spark, sf), ("contrast_id",)))


@query(
    "equivalence",
    f"""SELECT *, 0.05::DOUBLE AS equivalence_margin, true AS study_frozen,
        CASE WHEN ci_90_lo >= -0.05 AND ci_90_hi <= 0.05 THEN 'practically_invariant' ELSE 'not_practically_invariant' END AS verdict
        FROM (SELECT contrast_id, count(*) AS n_draws, {CI}
              FROM (SELECT contrast_id, ate_text_only AS estimate FROM ({JOINT})) GROUP BY ALL)""",
)
def _(spark, sf):
    return present(rs.equivalence(joint(spark, sf), ("contrast_id",), 0.05, frozen=True))


@query(
    "bootstrap_slope_ci",
    f"""WITH s AS (SELECT contrast_id, instruction_condition, a.draw, sum(a.m * b.m) AS w, sum(a.m * b.m * x) AS wx,
                          sum(a.m * b.m * y) AS wy, sum(a.m * b.m * x * x) AS wxx, sum(a.m * b.m * x * y) AS wxy, max(x) - min(x) AS spread
                   FROM v_joined p JOIN v_mult a ON a.item = p.story_1_id JOIN v_mult b ON b.item = p.story_2_id AND b.draw = a.draw GROUP BY ALL),
          e AS (SELECT contrast_id, instruction_condition, CASE WHEN spread > 0 THEN (wxy - wx * wy / w) / nullif(wxx - wx * wx / w, 0) END AS estimate FROM s)
        SELECT contrast_id, instruction_condition, count(*) AS n_draws, {CI} FROM e WHERE estimate IS NOT NULL GROUP BY ALL""",
)
def _(spark, sf):
    rows = ambiguity_rows(spark, sf).persist()
    return present(rs.slope_intervals(rows, rs.items_of(rows), V2, DRAWS, SEED))


# -- bootstrap over many items: consecutive orders of a customer ------------------------------

LARGE_DRAWS = 400
PRICES = """SELECT CAST(o_orderkey AS VARCHAR) AS item, o_custkey, o_orderpriority, o_totalprice,
                   lead(CAST(o_orderkey AS VARCHAR)) OVER w AS other, lead(o_totalprice) OVER w AS other_price
            FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)"""


@query(
    "bootstrap_orders_ci",
    f"""WITH pairs AS MATERIALIZED (SELECT o_orderpriority, item, other, (other_price - o_totalprice) / 1000 AS d FROM ({PRICES}) WHERE other IS NOT NULL),
          items AS MATERIALIZED (SELECT item, row_number() OVER (ORDER BY item) - 1 AS idx FROM (SELECT DISTINCT unnest([item, other]) AS item FROM pairs)),
          mult AS MATERIALIZED (SELECT draw, idx, count(*) AS m FROM (
              SELECT draw, CAST('0x' || substr(md5('{SEED}:' || draw || ':' || idx), 1, 15) AS BIGINT) % n AS idx
              FROM (SELECT unnest(range({LARGE_DRAWS})) AS draw), (SELECT idx, count(*) OVER () AS n FROM items)) GROUP BY ALL),
          placed AS MATERIALIZED (SELECT o_orderpriority, d, a.idx AS i, b.idx AS j FROM pairs JOIN items a USING (item) JOIN items b ON b.item = other),
          half AS MATERIALIZED (SELECT o_orderpriority, d, j, draw, m FROM placed JOIN mult ON idx = i),
          drawn AS (SELECT o_orderpriority, a.draw, sum(a.m * b.m * d) / sum(a.m * b.m) AS estimate
                    FROM half a JOIN mult b ON b.idx = j AND b.draw = a.draw GROUP BY ALL)
        SELECT o_orderpriority, count(*) AS n_draws, {CI} FROM drawn GROUP BY ALL""",
)
def _(spark, sf):
    """As many items as orders, thousands at the smallest scale that has enough."""
    nearby = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    orders = fix.table(spark, sf, "orders").select("o_orderpriority", "o_custkey", "o_orderkey", "o_totalprice")
    rows = orders.select(
        "o_orderpriority", F.col("o_orderkey").cast("string").alias("story_1_id"), F.lead(F.col("o_orderkey").cast("string")).over(nearby).alias("story_2_id"),
        ((F.lead("o_totalprice").over(nearby) - F.col("o_totalprice")) / 1000).alias("d_pair"),
    )
    pairs = rows.where("story_2_id IS NOT NULL").persist()
    return present(rs.ate_intervals(pairs, rs.items_of(pairs), ("o_orderpriority",), LARGE_DRAWS, SEED))
