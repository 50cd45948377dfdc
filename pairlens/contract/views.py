"""SQL of the derived views; mirrors ``pairlens.sources.fixtures``."""

from pairlens.contract.registry import view

ROW_ORDER = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey"

view(
    "v_pairs",
    """
SELECT *, least(story_a_id, story_b_id) AS story_1_id, greatest(story_a_id, story_b_id) AS story_2_id,
       CASE WHEN story_a_id < story_b_id THEN 'story1_as_a' ELSE 'story2_as_a' END AS position
FROM (SELECT l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag,
             CAST(l_quantity AS INTEGER) AS q,
             CAST(round(l_discount * 100, 0) AS INTEGER) % 5 AS contrast_no,
             's' || lpad(CAST(l_partkey % 12 AS VARCHAR), 2, '0') AS story_a_id,
             's' || lpad(CAST(l_suppkey % 12 AS VARCHAR), 2, '0') AS story_b_id,
             'e' || CAST(CAST(round(l_tax * 100, 0) AS INTEGER) % 3 AS VARCHAR) AS model,
             CASE WHEN l_linestatus = 'F' THEN 'A' ELSE 'B' END AS choice
      FROM lineitem)
""",
)
view(
    "v_judgements",
    """
SELECT *, 'c' || CAST(contrast_no AS VARCHAR) AS contrast_id,
       CASE WHEN q % 2 = 0 THEN 'forward' ELSE 'flipped' END AS assignment,
       CASE WHEN l_returnflag = 'A' THEN 'matched_control' ELSE 'text_only' END AS instruction_condition,
       CASE WHEN l_returnflag = 'A' THEN 'naturalistic' ELSE 'text_only_invariance' END AS evaluation_regime,
       CASE WHEN l_linenumber % 4 = 0 THEN 'tie' ELSE choice END AS tie_choice,
       CASE choice WHEN 'A' THEN story_a_id ELSE story_b_id END AS chosen,
       'c' || CAST(contrast_no AS VARCHAR) || '__' || story_1_id || '__' || story_2_id AS superblock_id
FROM v_pairs WHERE l_returnflag <> 'R' AND story_a_id <> story_b_id
""",
)
view(
    "v_judgements_rep",
    f"""
SELECT *, row_number() OVER (PARTITION BY superblock_id, instruction_condition, assignment, position
                             ORDER BY {ROW_ORDER}) AS replicate_number
FROM v_judgements
""",
)
view(
    "v_baseline",
    """
SELECT *, CASE WHEN month(l_shipdate) % 2 = 0 THEN 'matched_control' ELSE 'text_only' END AS instruction_condition,
       CASE choice WHEN 'A' THEN story_a_id ELSE story_b_id END AS chosen,
       story_1_id || '__' || story_2_id AS block_id
FROM v_pairs WHERE l_returnflag = 'R' AND story_a_id <> story_b_id
""",
)
view(
    "v_baseline_rep",
    f"""
SELECT *, row_number() OVER (PARTITION BY block_id, instruction_condition, position
                             ORDER BY {ROW_ORDER}) AS replicate_number
FROM v_baseline
""",
)
view(
    "v_attempts",
    f"""
SELECT *, l_orderkey AS trial_id, l_linenumber AS replicate_id, l_returnflag <> 'R' AS ok,
       CASE WHEN l_returnflag <> 'R' THEN choice END AS answer,
       CASE WHEN l_returnflag = 'R' THEN 'API call failed: 503' END AS error,
       CASE WHEN l_returnflag = 'A' THEN 'low_variance_primary' ELSE 'provider_default_secondary' END AS sampling_regime,
       row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {ROW_ORDER}) AS attempt_id
FROM v_pairs
""",
)
view(
    "v_responses",
    """
SELECT *, CASE WHEN event_type <> 'view' THEN input_tokens // 3 END AS hit,
       CASE WHEN event_type <> 'view' THEN input_tokens - input_tokens // 3 END AS miss
FROM (SELECT event_id AS observation_id, ts, event_type,
             CASE event_type
               WHEN 'click' THEN 'Passage ' || CASE WHEN event_id % 2 = 0 THEN 'A' ELSE 'B' END
               WHEN 'view' THEN '{"choice": "' || CASE WHEN event_id % 2 = 0 THEN 'A' ELSE 'B' END || '"}'
               WHEN 'purchase' THEN 'I prefer ' || CASE WHEN event_id % 2 = 0 THEN 'A' ELSE 'B' END || ', for its ending.'
               WHEN 'signup' THEN 'It is a tie.' END AS response_text,
             CASE WHEN event_type IN ('click', 'view', 'purchase')
                  THEN CASE WHEN event_id % 2 = 0 THEN 'A' ELSE 'B' END END AS answer,
             CASE event_type WHEN 'error' THEN 'api_error' WHEN 'signup' THEN 'refusal' ELSE 'valid' END AS status,
             'c' || CAST(user_id % 5 AS VARCHAR) AS contrast_id,
             'e' || CAST(user_id % 3 AS VARCHAR) AS evaluator_id,
             CASE WHEN user_id % 2 = 0 THEN 'matched_control' ELSE 'text_only' END AS instruction_condition,
             100 + event_id % 900 AS input_tokens, 1 + event_id % 50 AS output_tokens,
             CASE WHEN event_id % 13 <> 0 THEN event_id % 700 END AS reasoning_tokens,
             'v' || CAST(user_id % 2 AS VARCHAR) AS response_model
      FROM events)
""",
)
view(
    "v_fields",
    """
SELECT * FROM (VALUES (1, 'plot_structure'), (2, 'prose_style'), (3, 'characterization'),
                      (4, 'originality'), (5, 'overall_quality')) t(k, category)
""",
)
view(
    "v_ratings",
    """
SELECT model, CASE WHEN l_returnflag = 'A' THEN 'naturalistic' ELSE 'text_only_invariance' END AS evaluation_regime,
       story_a_id AS story_id, CASE WHEN contrast_no = 0 THEN 'neutral' ELSE 'signal' END AS dimension,
       CASE WHEN contrast_no = 0 THEN 'neutral' ELSE 'v' || CAST(contrast_no AS VARCHAR) END AS value,
       l_linenumber AS replicate_id, category, 1 + ((q * k + l_linenumber) % 91) / 10.0::DOUBLE AS rating
FROM v_pairs CROSS JOIN v_fields WHERE l_returnflag <> 'R'
""",
)
view(
    "v_comparisons",
    f"""
SELECT CASE WHEN story_a_id = story_b_id THEN 'comparison_control' ELSE 'comparison' END AS trial_type, 'm0' AS model, *
FROM (SELECT story_a_id, story_b_id, l_linenumber AS replicate_id, q, (q + l_linenumber) % 5 - 2 AS preference,
             CASE contrast_no WHEN 0 THEN 'neutral' WHEN 1 THEN 'self_vs_ai' WHEN 2 THEN 'ai_vs_self'
                              WHEN 3 THEN 'journal_vs_ai' ELSE 'ai_vs_journal' END AS condition,
             row_number() OVER (PARTITION BY story_a_id, story_b_id, l_linenumber, contrast_no
                                ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC,
                                         l_partkey DESC, l_suppkey DESC) AS rn
      FROM v_pairs) WHERE rn = 1
""",
)
view(
    "v_scores",
    """
SELECT 'n' || CAST(nation AS VARCHAR) AS item_id, customer_score, supplier_score
FROM (SELECT c_nationkey AS nation, avg(c_acctbal) AS customer_score FROM customer GROUP BY 1)
JOIN (SELECT s_nationkey AS nation, avg(s_acctbal) AS supplier_score FROM supplier GROUP BY 1) USING (nation)
""",
)

# -- effects on top of the judgements ------------------------------------------------------
view(
    "v_cells",
    """
SELECT model, evaluation_regime, contrast_id, 'overall_quality' AS category, story_1_id, story_2_id, assignment, position,
       count(*) AS n, count(*) FILTER (chosen = story_1_id) AS w1, count(*) FILTER (chosen = story_2_id) AS w2
FROM v_judgements GROUP BY ALL
""",
)
view(
    "v_effects",
    """
SELECT *, wa / n_value_a - wb / n_value_b AS effect
FROM (SELECT model, evaluation_regime, contrast_id, category, story_1_id, story_2_id,
             sum(n) FILTER (assignment = 'forward')::BIGINT AS n_value_a, sum(w1) FILTER (assignment = 'forward')::DOUBLE AS wa,
             sum(n) FILTER (assignment = 'flipped')::BIGINT AS n_value_b, sum(w1) FILTER (assignment = 'flipped')::DOUBLE AS wb
      FROM v_cells GROUP BY ALL)
WHERE n_value_a > 0 AND n_value_b > 0
""",
)
view(
    "v_by_contrast",
    """
SELECT model, evaluation_regime, contrast_id, category, avg(effect) AS mean_effect, min(effect) AS min_effect,
       max(effect) AS max_effect, max(effect) - min(effect) AS range_effect, count(*) AS n_pairs
FROM v_effects GROUP BY ALL
""",
)
view(
    "v_four",
    """
SELECT * FROM (
SELECT model, evaluation_regime, contrast_id, category, story_1_id, story_2_id,
       sum(w1) FILTER (assignment = 'forward' AND position = 'story1_as_a')::BIGINT AS faw1,
       sum(w2) FILTER (assignment = 'forward' AND position = 'story1_as_a')::BIGINT AS faw2,
       sum(n) FILTER (assignment = 'forward' AND position = 'story1_as_a')::BIGINT AS fan,
       sum(w1) FILTER (assignment = 'forward' AND position = 'story2_as_a')::BIGINT AS fbw1,
       sum(w2) FILTER (assignment = 'forward' AND position = 'story2_as_a')::BIGINT AS fbw2,
       sum(n) FILTER (assignment = 'forward' AND position = 'story2_as_a')::BIGINT AS fbn,
       sum(w1) FILTER (assignment = 'flipped' AND position = 'story1_as_a')::BIGINT AS law1,
       sum(w2) FILTER (assignment = 'flipped' AND position = 'story1_as_a')::BIGINT AS law2,
       sum(n) FILTER (assignment = 'flipped' AND position = 'story1_as_a')::BIGINT AS lan,
       sum(w1) FILTER (assignment = 'flipped' AND position = 'story2_as_a')::BIGINT AS lbw1,
       sum(w2) FILTER (assignment = 'flipped' AND position = 'story2_as_a')::BIGINT AS lbw2,
       sum(n) FILTER (assignment = 'flipped' AND position = 'story2_as_a')::BIGINT AS lbn
FROM v_cells GROUP BY ALL)
WHERE fan > 0 AND fbn > 0 AND lan > 0 AND lbn > 0
""",
)
view(
    "v_rates",
    """
SELECT contrast_id, instruction_condition, story_1_id, story_2_id, assignment, position, count(*) AS n,
       avg((chosen = story_1_id)::INTEGER) AS rate
FROM v_judgements GROUP BY ALL
""",
)
view(
    "v_dpairs",
    """
SELECT contrast_id, instruction_condition, story_1_id, story_2_id, ((fa - la) + (fb - lb)) / 2 AS d_pair,
       fa - la AS at_a, fb - lb AS at_b, (fa - la) - (fb - lb) AS interaction,
       (fa + la) / 2 - (fb + lb) / 2 AS position_effect
FROM (SELECT contrast_id, instruction_condition, story_1_id, story_2_id,
             max(rate) FILTER (assignment = 'forward' AND position = 'story1_as_a') AS fa,
             max(rate) FILTER (assignment = 'flipped' AND position = 'story1_as_a') AS la,
             max(rate) FILTER (assignment = 'forward' AND position = 'story2_as_a') AS fb,
             max(rate) FILTER (assignment = 'flipped' AND position = 'story2_as_a') AS lb
      FROM v_rates GROUP BY ALL)
WHERE fa IS NOT NULL AND la IS NOT NULL AND fb IS NOT NULL AND lb IS NOT NULL
""",
)
view(
    "v_ates",
    "SELECT contrast_id, instruction_condition, avg(d_pair) AS ate, count(*) AS n_pairs FROM v_dpairs GROUP BY ALL",
)
view(
    "v_strength",
    """
SELECT *, abs(ln((w + 0.5) / (n - w + 0.5))) AS strength
FROM (SELECT story_1_id, story_2_id, count(*) FILTER (chosen = story_1_id) AS w, count(*) AS n
      FROM v_baseline WHERE instruction_condition = 'matched_control' GROUP BY ALL)
""",
)
view(
    "v_joined",
    """
SELECT contrast_id, instruction_condition, d.story_1_id, d.story_2_id, strength AS x, d_pair AS y
FROM v_dpairs d JOIN v_strength s ON d.story_1_id = s.story_1_id AND d.story_2_id = s.story_2_id
""",
)
