"""Contract queries of parsing, collapse, recovery and usage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.contract.effects import V2, present
from pairlens.contract.registry import query, view
from pairlens.functions import answers as ans
from pairlens.functions import scalars as sc
from pairlens.operators import collapse as col
from pairlens.operators import gates
from pairlens.operators import recovery as rec
from pairlens.operators import usage as use
from pairlens.operators.quality import duplicate_ids
from pairlens.sources import fixtures as fix

# -- answers -------------------------------------------------------------------------------

# The plain-choice parser in SQL, over any (id, txt) input.
MARKERS = " OR ".join("contains(low, '" + m.replace("'", "''") + "')" for m in ans.HEDGE_MARKERS)
WS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160) || chr(5760) || chr(8192) || chr(8193) || chr(8194) || chr(8195) || chr(8196) || chr(8197) || chr(8198) || chr(8199) || chr(8200) || chr(8201) || chr(8202) || chr(8232) || chr(8233) || chr(8239) || chr(8287) || chr(12288)"
EM = "'*_`''\"' || chr(8220) || chr(8221) || chr(8216) || chr(8217) || chr(32) || chr(9) || chr(13) || chr(10)"


def LAST_OF(key: str) -> str:  # noqa: N802
    """The value of a key of the object ``j``; of a repeated key the last one counts."""
    return f"(list_filter(list_zip(json_keys(j), json_extract(j, '$.*')), lambda kv: kv[1] = '{key}')[-1][2])"


def parser_sql(source: str) -> str:
    """SQL of the plain-choice parser over ``source`` with columns id, txt."""
    return f"""
SELECT id, CASE WHEN is_json THEN CASE WHEN letter_json IN ('A', 'B') THEN letter_json END
                WHEN letter <> '' AND NOT hedged THEN upper(letter) END AS answer,
       CASE WHEN txt IS NULL THEN 'no_response_text'
            WHEN is_json THEN CASE WHEN letter_json IN ('A', 'B') THEN NULL
                                   WHEN json_type(j) <> 'OBJECT' THEN 'json_not_object' ELSE 'json_without_letter' END
            WHEN hedged THEN 'ambiguous/hedged' WHEN letter = '' THEN 'no_leading_letter' END AS error
FROM (SELECT *, ({MARKERS}) AS hedged,
             regexp_extract(clean, '(?is)^(?:i\\s+prefer\\s+(?:passage\\s+)?|passage\\s+)?([ab])(?:$|[^\\p{{L}}\\p{{N}}_])', 1) AS letter,
             CASE WHEN json_type(j) = 'OBJECT' THEN
               CASE WHEN json_exists(j, '$.overall_quality')
                    THEN CASE WHEN json_type({LAST_OF('overall_quality')}) = 'VARCHAR' THEN upper(trim({LAST_OF('overall_quality')}->>'$')) END
                    WHEN json_type({LAST_OF('choice')}) = 'VARCHAR' THEN upper(trim({LAST_OF('choice')}->>'$')) END END AS letter_json
      FROM (SELECT *, lower(clean) AS low, coalesce(json_type(j) <> 'NULL', false) AS is_json
            FROM (SELECT *, CASE WHEN json_valid(clean) THEN clean END AS j FROM (SELECT id, txt, trim(CASE WHEN starts_with(bare, '```') THEN trim(
                         CASE WHEN ends_with(rtrim(opened, {WS}), '```')
                              THEN left(rtrim(opened, {WS}), length(rtrim(opened, {WS})) - 3) ELSE opened END, {WS}) ELSE bare END, {EM}) AS clean
                  FROM (SELECT *, regexp_replace(substr(bare, 4), '^[ \\t]*[a-zA-Z0-9_+-]*[ \\t]*\\n?', '') AS opened
                        FROM (SELECT *, trim(txt, {WS}) AS bare FROM ({source})))))))"""


@query("parse_answers", parser_sql("SELECT observation_id AS id, response_text AS txt FROM v_responses"))
def _(spark, sf):
    rows = fix.responses(spark, sf).select(F.col("observation_id").alias("id"), "response_text")
    return ans.with_choice(rows, "response_text").drop("response_text")


# Whole document and conversation texts, as they are and behind an answer, a fence or a JSON wrapper.
TEXTS = """SELECT 'd' || CAST(doc_id AS VARCHAR) || '_' || CAST(v AS VARCHAR) AS id,
  CASE v WHEN 0 THEN text WHEN 1 THEN 'Passage B. ' || text WHEN 2 THEN '```json' || chr(10) || '{"choice": "a"}' || chr(10) || '```'
         WHEN 3 THEN '**A** ' || text WHEN 4 THEN '{"overall_quality": "' || lang || '", "choice": "A"}' WHEN 5 THEN '{"choice": ' || text
         ELSE '{"choice": "A", "lang": "' || lang || '", "choice": "' || CASE WHEN doc_id % 3 = 0 THEN 'b' ELSE lang END || '"}' END AS txt
  FROM documents CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4, 5, 6]) AS v)
  UNION ALL SELECT 't' || CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR), text FROM conversations"""


@query("parse_texts", parser_sql(TEXTS))
def _(spark, sf):
    text = F.col("text")
    variants = F.array(
        text,
        F.concat(F.lit("Passage B. "), text),
        F.lit('```json\n{"choice": "a"}\n```'),
        F.concat(F.lit("**A** "), text),
        F.concat(F.lit('{"overall_quality": "'), F.col("lang"), F.lit('", "choice": "A"}')),
        F.concat(F.lit('{"choice": '), text),
        F.concat(F.lit('{"choice": "A", "lang": "'), F.col("lang"), F.lit('", "choice": "'), F.when(F.col("doc_id") % 3 == 0, "b").otherwise(F.col("lang")), F.lit('"}')),
    )
    docs = fix.spread(fix.table(spark, sf, "documents"), "doc_id").select("doc_id", F.posexplode(variants).alias("v", "txt"))
    docs = docs.select(F.concat(F.lit("d"), F.col("doc_id"), F.lit("_"), F.col("v")).alias("id"), "txt")
    talk = fix.table(spark, sf, "conversations").select(
        F.concat(F.lit("t"), F.col("conv_id"), F.lit("_"), F.col("turn")).alias("id"), F.col("text").alias("txt")
    )
    return ans.with_choice(docs.unionByName(talk), "txt").drop("txt")


def answered(spark: SparkSession, sf: str) -> DataFrame:
    """Responses with parsed answers; a recorded transport error stays the error."""
    rows = ans.with_choice(fix.responses(spark, sf), "response_text")
    error = F.coalesce("validation_error", ans.rendered_error(F.col("error")))
    return rows.withColumn("error", error).withColumn("status", sc.attempt_status(F.col("answer"), F.col("error")))


@query("answer_status", "SELECT evaluator_id, status, count(*) AS n FROM v_responses GROUP BY ALL")
def _(spark, sf):
    return answered(spark, sf).groupBy("evaluator_id", "status").agg(F.count("*").alias("n"))


@query(
    "retryable_errors",
    "SELECT evaluator_id, event_type = 'error' AS is_retryable, count(*) AS n FROM v_responses GROUP BY ALL",
)
def _(spark, sf):
    rows = fix.responses(spark, sf).withColumn("is_retryable", sc.is_retryable(F.col("validation_error")))
    return rows.groupBy("evaluator_id", "is_retryable").agg(F.count("*").alias("n"))


@query(
    "compliance",
    """SELECT contrast_id, instruction_condition, count(*) AS n_attempted, count(*) FILTER (status = 'valid') AS n_valid,
       count(*) FILTER (status = 'invalid') AS n_invalid, count(*) FILTER (status = 'refusal') AS n_refusal,
       count(*) FILTER (status = 'api_error') AS n_api_error,
       round(avg((status = 'valid')::INTEGER), 9) + 0.0 AS valid_rate FROM v_responses GROUP BY ALL""",
)
def _(spark, sf):
    from pairlens.operators.quality import compliance

    return present(compliance(answered(spark, sf).withColumnRenamed("status", "first_attempt_status"), V2))


# Rating answers as JSON with every kind of defect a validator has to tell apart.
view(
    "v_rating_json",
    """
SELECT id, d, r1, CASE d
   WHEN 1 THEN '{"plot_structure": true' || tail || '}' WHEN 2 THEN '{"plot_structure": 0.5' || tail || '}'
   WHEN 3 THEN '{"plot_structure": 7.25' || tail || '}' WHEN 4 THEN '{"plot_structure": "7"' || tail || '}'
   WHEN 5 THEN '{"prose_style": 3' || '}' WHEN 6 THEN '{"plot_structure": ' || r1 || tail || ', "extra": 1}'
   WHEN 7 THEN '```json' || chr(10) || '{"plot_structure": ' || r1 || tail || '}' || chr(10) || '```'
   WHEN 8 THEN '[1, 2, 3]' WHEN 9 THEN 'no rating' ELSE '{"plot_structure": ' || r1 || tail || '}' END AS txt
FROM (SELECT l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey AS id, (q + l_linenumber) % 12 AS d,
             CAST(1 + (q + l_linenumber) % 9 AS VARCHAR) || '.' || CAST(q % 10 AS VARCHAR) AS r1,
             ', "prose_style": ' || CAST(1 + q % 10 AS VARCHAR) || ', "characterization": 3.5, "originality": 1.0, "overall_quality": 10' AS tail
      FROM v_pairs)
""",
)


def rating_texts(spark: SparkSession, sf: str) -> DataFrame:
    q = F.col("l_quantity").cast("int")
    r1 = F.concat((1 + (q + F.col("l_linenumber")) % 9).cast("string"), F.lit("."), (q % 10).cast("string"))
    tail = F.concat(
        F.lit(', "prose_style": '), (1 + q % 10).cast("string"),
        F.lit(', "characterization": 3.5, "originality": 1.0, "overall_quality": 10'),
    )
    d = (q + F.col("l_linenumber")) % 12

    def body(value) -> F.Column:
        return F.concat(F.lit('{"plot_structure": '), value, tail, F.lit("}"))

    text = (
        F.when(d == 1, body(F.lit("true"))).when(d == 2, body(F.lit("0.5"))).when(d == 3, body(F.lit("7.25")))
        .when(d == 4, body(F.lit('"7"'))).when(d == 5, F.lit('{"prose_style": 3}'))
        .when(d == 6, F.concat(F.lit('{"plot_structure": '), r1, tail, F.lit(', "extra": 1}')))
        .when(d == 7, F.concat(F.lit("```json\n"), body(r1), F.lit("\n```")))
        .when(d == 8, F.lit("[1, 2, 3]")).when(d == 9, F.lit("no rating")).otherwise(body(r1))
    )
    li = fix.spread(fix.table(spark, sf, "lineitem"), "l_orderkey")
    return li.select(F.concat_ws("_", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), text.alias("txt"))


@query(
    "validate_ratings",
    """SELECT id, CASE WHEN d = 9 THEN 'not_json' WHEN d IN (1, 2, 3, 4, 5, 6, 8) THEN 'bad_decimal_ratings' END AS error,
       CASE WHEN d IN (0, 7, 10, 11) THEN CAST(r1 AS DOUBLE) END AS plot_structure FROM v_rating_json""",
)
def _(spark, sf):
    rows = rating_texts(spark, sf).withColumns(
        {"type": F.lit("context_single"), "choice_mode": F.lit(None).cast("string"), "response_format": F.lit(None).cast("string")}
    )
    checked = ans.with_validation(rows, "txt")
    return checked.select("id", "error", F.get_json_object("answer", "$.plot_structure").cast("double").alias("plot_structure"))


# -- collapse ------------------------------------------------------------------------------

ATTEMPT_KEY = ("trial_id", "replicate_id")


def collapsed(spark: SparkSession, sf: str) -> DataFrame:
    return col.collapse_attempts(fix.attempts(spark, sf), ATTEMPT_KEY, order=("attempt_id",), carry=("model", "sampling_regime"))


COLLAPSED = """SELECT trial_id, replicate_id, count(*) AS n_attempts, count(*) FILTER (ok) AS n_successes,
       count(*) FILTER (ok) > 0 AS resolved,
       CASE WHEN count(*) FILTER (ok) > 0 THEN count(*) FILTER (NOT ok) ELSE 0 END AS absorbed_failures,
       arg_max(answer, attempt_id) FILTER (ok) AS answer, max(attempt_id) FILTER (ok) AS attempt_id,
       arg_max(model, attempt_id) FILTER (ok) AS model, arg_max(sampling_regime, attempt_id) FILTER (ok) AS sampling_regime
       FROM v_attempts GROUP BY ALL"""


@query("collapse_attempts", COLLAPSED)
def _(spark, sf):
    return collapsed(spark, sf)


@query(
    "collapse_totals",
    f"""SELECT sum(n_attempts)::BIGINT AS raw_attempts, count(*) FILTER (resolved) AS completed,
        count(*) FILTER (NOT resolved) AS unresolved, sum(absorbed_failures)::BIGINT AS absorbed_failures FROM ({COLLAPSED})""",
)
def _(spark, sf):
    return col.collapse_totals(collapsed(spark, sf))


@query(
    "collapse_inventory",
    f"""WITH o AS (SELECT * FROM ({COLLAPSED}) WHERE resolved)
        SELECT 'model' AS field, model AS value, count(*) AS n FROM o GROUP BY ALL
        UNION ALL SELECT 'sampling_regime', sampling_regime, count(*) FROM o GROUP BY ALL
        UNION ALL SELECT 'replicate_id', CAST(replicate_id AS VARCHAR), count(*) FROM o GROUP BY ALL""",
)
def _(spark, sf):
    return col.inventory(collapsed(spark, sf).where("resolved"), ("model", "sampling_regime", "replicate_id"))


REPLICATES = 5


def planned_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Orders x replicates: some recorded keys lie outside, some planned keys have no record."""
    orders = fix.table(spark, sf, "orders")
    return orders.select(
        F.col("o_orderkey").alias("trial_id"), F.explode(F.sequence(F.lit(1), F.lit(REPLICATES))).alias("replicate_id")
    )


view("v_planned", "SELECT o_orderkey AS trial_id, unnest([1, 2, 3, 4, 5]) AS replicate_id FROM orders")


@query(
    "pending_units",
    """SELECT p.* FROM v_planned p WHERE NOT EXISTS (SELECT 1 FROM v_attempts a WHERE a.ok AND a.trial_id = p.trial_id
       AND a.replicate_id = p.replicate_id)""",
)
def _(spark, sf):
    return col.pending(planned_keys(spark, sf), fix.attempts(spark, sf), ATTEMPT_KEY)


@query(
    "completed_units",
    """SELECT p.trial_id, p.replicate_id, p.model FROM (SELECT *, 'e1' AS model FROM v_planned) p
       WHERE EXISTS (SELECT 1 FROM v_attempts a WHERE a.ok AND a.trial_id = p.trial_id AND a.replicate_id = p.replicate_id
                     AND (a.model = 'e2' OR a.model = 'e1'))""",
)
def _(spark, sf):
    # Records of evaluator e2 carry no identity (old rows), so they are compatible.
    records = fix.attempts(spark, sf).withColumn("model", F.when(F.col("model") != "e2", F.col("model")))
    return col.completed(planned_keys(spark, sf).withColumn("model", F.lit("e1")), records, ATTEMPT_KEY, ("model",))


@query(
    "retry_failed",
    """SELECT trial_id, replicate_id, count(*) AS n_failed FROM v_attempts a
       WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = a.trial_id) GROUP BY ALL HAVING count(*) FILTER (ok) = 0""",
)
def _(spark, sf):
    manifest = fix.table(spark, sf, "orders").select(F.col("o_orderkey").alias("trial_id"))
    return col.retry_failed(fix.attempts(spark, sf), manifest, ATTEMPT_KEY)


@query(
    "next_attempt",
    """SELECT p.trial_id, p.replicate_id, coalesce(max(a.attempt_id), 0) + 1 AS next_attempt_id
       FROM v_planned p LEFT JOIN v_attempts a ON a.trial_id = p.trial_id AND a.replicate_id = p.replicate_id GROUP BY ALL""",
)
def _(spark, sf):
    return col.next_attempt(planned_keys(spark, sf), fix.attempts(spark, sf), ATTEMPT_KEY)


@query(
    "new_attempt_numbers",
    """WITH old AS (SELECT trial_id, replicate_id, max(attempt_id) AS last FROM v_attempts WHERE ok GROUP BY ALL)
       SELECT n.trial_id, n.replicate_id, n.attempt_id AS arrival,
              (coalesce(last, 0) + row_number() OVER (PARTITION BY n.trial_id, n.replicate_id ORDER BY n.attempt_id))::BIGINT AS attempt_id
       FROM v_attempts n LEFT JOIN old ON old.trial_id = n.trial_id AND old.replicate_id = n.replicate_id WHERE NOT n.ok""",
)
def _(spark, sf):
    log = fix.attempts(spark, sf)
    new = log.where("NOT ok").select(*ATTEMPT_KEY, F.col("attempt_id").alias("arrival"))
    return col.number_new_attempts(log.where("ok"), new, ATTEMPT_KEY, "arrival")


@query(
    "fold_attempts",
    """SELECT trial_id, replicate_id, arg_min(CASE WHEN ok THEN 'valid' ELSE 'api_error' END, attempt_id) AS first_attempt_status,
       arg_min(answer, attempt_id) FILTER (ok) AS first_valid_response,
       coalesce(min(attempt_id) FILTER (ok), max(attempt_id)) AS total_attempts,
       CASE WHEN count(*) FILTER (ok) > 0 THEN 'resolved' ELSE 'unresolved' END AS parsing_status,
       false AS refusal_status, NOT arg_min(ok, attempt_id) AS api_error_status
       FROM v_attempts GROUP BY ALL""",
)
def _(spark, sf):
    return col.fold_attempts(fix.attempts(spark, sf).withColumnRenamed("attempt_id", "attempt_number"), ATTEMPT_KEY)


@query(
    "duplicate_ids",
    "SELECT CAST(l_orderkey AS VARCHAR) || '::r' || CAST(l_linenumber AS VARCHAR) AS observation_id, count(*) AS n FROM v_pairs GROUP BY ALL HAVING count(*) > 1",
)
def _(spark, sf):
    rows = fix.table(spark, sf, "lineitem").select(
        F.concat_ws("::r", "l_orderkey", "l_linenumber").alias("observation_id")
    )
    return duplicate_ids(rows, "observation_id")


# -- waves ---------------------------------------------------------------------------------

view(
    "v_wave",
    """
SELECT 'x::e::o' || CAST(l_orderkey AS VARCHAR) || '::r' || CAST(l_linenumber AS VARCHAR) AS observation_id,
       CASE WHEN l_returnflag <> 'R' THEN 'resolved' ELSE 'unresolved' END AS parsing_status,
       CASE WHEN l_returnflag <> 'R' THEN choice END AS recorded_answer,
       l_returnflag <> 'R' AND q % 10 = 0 AS malformed,
       CASE WHEN month(l_shipdate) <= 6 THEN 1 ELSE 2 END AS wave,
       l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey
FROM v_pairs
""",
)
view(
    "v_plan_ids",
    "SELECT 'x::e::o' || CAST(trial_id AS VARCHAR) || '::r' || CAST(replicate_id AS VARCHAR) AS observation_id FROM v_planned",
)
view(
    "v_classified",
    """
SELECT *, CASE WHEN base = 'valid' AND count(*) FILTER (base = 'valid') OVER (PARTITION BY observation_id) > 1
               THEN 'duplicate_valid' ELSE base END AS row_class
FROM (SELECT w.*, CASE WHEN p.observation_id IS NULL THEN 'unknown' WHEN parsing_status <> 'resolved' THEN 'unresolved'
                       WHEN malformed THEN 'malformed' ELSE 'valid' END AS base
      FROM v_wave w LEFT JOIN (SELECT DISTINCT observation_id FROM v_plan_ids) p ON p.observation_id = w.observation_id
      WHERE wave = 1)
""",
)
view(
    "v_merged",
    """
SELECT p.observation_id, coalesce(v.recorded_answer, r.recorded_answer) AS recorded_answer,
       CASE WHEN v.observation_id IS NOT NULL THEN 'wave1_original' ELSE 'wave2_recovery' END AS result_source,
       CASE WHEN v.observation_id IS NOT NULL THEN 0 ELSE r.n - 1 END AS extra_recovery_answers
FROM v_plan_ids p
LEFT JOIN (SELECT * FROM v_classified WHERE row_class = 'valid') v ON v.observation_id = p.observation_id
LEFT JOIN (SELECT observation_id, count(*) AS n,
                  arg_min(recorded_answer, row(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS recorded_answer
           FROM v_wave WHERE wave = 2 AND parsing_status = 'resolved' GROUP BY 1) r ON r.observation_id = p.observation_id
WHERE v.observation_id IS NOT NULL OR r.observation_id IS NOT NULL
""",
)


def wave_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Result rows of two waves; every tenth quantity is recorded with the wrong text."""
    li = fix.table(spark, sf, "lineitem")
    resolved = F.col("l_returnflag") != "R"
    answer = F.when(F.col("l_linestatus") == "F", "A").otherwise("B")
    wrong = F.when(answer == "A", "B").otherwise("A")
    shown = F.when(F.col("l_quantity").cast("int") % 10 == 0, wrong).otherwise(answer)
    return li.select(
        *fix.ROW_ORDER,
        sc.observation_id(
            F.lit("x"), F.lit("e"), F.concat(F.lit("o"), F.col("l_orderkey").cast("string")), F.col("l_linenumber")
        ).alias("observation_id"),
        F.when(resolved, "resolved").otherwise("unresolved").alias("parsing_status"),
        F.when(resolved, answer).alias("recorded_answer"),
        F.when(resolved, F.concat(F.lit("Passage "), shown)).otherwise("It is a tie.").alias("last_response_text"),
        F.when(F.month("l_shipdate") <= 6, 1).otherwise(2).alias("wave"),
    )


def planned_ids(spark: SparkSession, sf: str) -> DataFrame:
    return planned_keys(spark, sf).select(
        sc.observation_id(
            F.lit("x"), F.lit("e"), F.concat(F.lit("o"), F.col("trial_id").cast("string")), F.col("replicate_id")
        ).alias("observation_id")
    )


def classified(spark: SparkSession, sf: str) -> DataFrame:
    return rec.classify_rows(wave_rows(spark, sf).where("wave = 1"), planned_ids(spark, sf))


@query(
    "wave_classification",
    "SELECT row_class, count(*) AS n_rows, count(DISTINCT observation_id) AS n_ids FROM v_classified GROUP BY ALL",
)
def _(spark, sf):
    return rec.class_counts(classified(spark, sf))


@query(
    "recovery_plan",
    """SELECT observation_id, row_number() OVER (ORDER BY observation_id) AS execution_order_index FROM v_plan_ids p
       WHERE NOT EXISTS (SELECT 1 FROM v_classified c WHERE c.row_class = 'valid' AND c.observation_id = p.observation_id)""",
)
def _(spark, sf):
    return rec.recovery_plan(planned_ids(spark, sf), classified(spark, sf))


def merged(spark: SparkSession, sf: str) -> DataFrame:
    return rec.merge_waves(
        planned_ids(spark, sf),
        rec.valid_rows(classified(spark, sf)),
        wave_rows(spark, sf).where("wave = 2"),
        ("recorded_answer",),
        fix.ROW_ORDER,
    )


@query("merge_waves", "SELECT * FROM v_merged")
def _(spark, sf):
    return merged(spark, sf)


@query(
    "merge_diagnostics",
    """SELECT (SELECT count(*) FROM v_plan_ids) AS planned_total, (SELECT count(*) FROM v_wave WHERE wave = 2) AS recovery_attempted,
       count(*) FILTER (result_source = 'wave1_original') AS first_wave_retained,
       count(*) FILTER (result_source = 'wave2_recovery') AS recovered,
       count(*) FILTER (extra_recovery_answers > 0) AS ids_answered_again,
       (SELECT count(*) FROM v_plan_ids) - count(*) FILTER (result_source = 'wave1_original') AS unresolved_after_first_wave,
       (SELECT count(*) FROM v_plan_ids) - count(*) AS still_unresolved,
       round(count(*) / (SELECT count(*) FROM v_plan_ids), 9) + 0.0 AS final_completeness FROM v_merged""",
)
def _(spark, sf):
    recovery = wave_rows(spark, sf).where("wave = 2")
    return present(rec.merge_diagnostics(planned_ids(spark, sf), recovery, merged(spark, sf)))


# -- gates ---------------------------------------------------------------------------------

view(
    "v_identity",
    """
SELECT 'x::e::o' || CAST(trial_id AS VARCHAR) || '::r' || CAST(replicate_id AS VARCHAR) AS observation_id, CAST(trial_id AS VARCHAR) AS trial_id,
       CAST(replicate_id AS BIGINT) AS replicate_number FROM v_planned
""",
)
# Damage: some plan rows twice, some with the next replicate, some under an id that was never planned.
view(
    "v_damaged",
    """
SELECT CASE WHEN n % 11 = 0 THEN observation_id || 'x' ELSE observation_id END AS observation_id, trial_id,
       replicate_number + CASE WHEN n % 7 = 0 THEN 1 ELSE 0 END AS replicate_number
FROM (SELECT *, CAST(trial_id AS BIGINT) AS n, unnest(range(CASE WHEN CAST(trial_id AS BIGINT) % 5 = 0 THEN 2 ELSE 1 END)) AS again FROM v_identity)
""",
)
view(
    "v_plan_violations",
    """
SELECT DISTINCT d.observation_id, CASE WHEN p.observation_id IS NULL THEN 'not_planned' ELSE 'other_identity' END AS violation
FROM v_damaged d LEFT JOIN v_identity p ON p.observation_id = d.observation_id
WHERE p.observation_id IS NULL OR d.trial_id IS DISTINCT FROM p.trial_id OR d.replicate_number IS DISTINCT FROM p.replicate_number
UNION ALL SELECT observation_id, 'repeated' FROM v_damaged GROUP BY observation_id HAVING count(*) > 1
""",
)
view(
    "v_class_counts",
    "SELECT row_class, count(*) AS n_rows, count(DISTINCT observation_id) AS n_ids FROM v_classified GROUP BY ALL",
)


def planned_identity(spark: SparkSession, sf: str) -> DataFrame:
    oid = sc.observation_id(F.lit("x"), F.lit("e"), F.concat(F.lit("o"), F.col("trial_id").cast("string")), F.col("replicate_id"))
    return planned_keys(spark, sf).select(oid.alias("observation_id"), F.col("trial_id").cast("string").alias("trial_id"), F.col("replicate_id").cast("bigint").alias("replicate_number"))


def damaged_plan(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("trial_id").cast("bigint")
    twice = planned_identity(spark, sf).withColumn("__again", F.explode(F.sequence(F.lit(1), F.when(n % 5 == 0, 2).otherwise(1))))
    return twice.select(
        F.when(n % 11 == 0, F.concat("observation_id", F.lit("x"))).otherwise(F.col("observation_id")).alias("observation_id"), "trial_id",
        (F.col("replicate_number") + F.when(n % 7 == 0, 1).otherwise(0)).alias("replicate_number"),
    )


@query("plan_violations", "SELECT * FROM v_plan_violations")
def _(spark, sf):
    return gates.plan_violations(damaged_plan(spark, sf), planned_identity(spark, sf))


def checks_sql(wanted: dict[str, tuple[str, str]]) -> str:
    rows = " UNION ALL ".join(f"SELECT '{name}' AS check_name, CAST(({found}) AS BIGINT) AS found, CAST(({want}) AS BIGINT) AS wanted" for name, (found, want) in wanted.items())
    return f"SELECT *, found = wanted AS ok FROM ({rows})"


def class_sql(row_class: str, what: str) -> str:
    return f"SELECT coalesce(max({what}), 0) FROM v_class_counts WHERE row_class = '{row_class}'"


TOTAL, NONE = "SELECT count(DISTINCT observation_id) FROM v_identity", "0"
CLASSES = {
    "no_unknown_rows": (class_sql("unknown", "n_rows"), NONE), "no_duplicate_answers": (class_sql("duplicate_valid", "n_ids"), NONE), "no_malformed_answers": (class_sql("malformed", "n_rows"), NONE),
}


@query(
    "recovery_preflight",
    checks_sql({"planned_count_matches_design": (TOTAL, TOTAL), "planned_ids_unique": ("SELECT count(*) - count(DISTINCT observation_id) FROM v_identity", NONE), **CLASSES, "recovery_creates_no_new_replicates": ("SELECT count(*) FROM v_plan_violations", NONE)}),
)
def _(spark, sf):
    planned = planned_identity(spark, sf)
    return gates.recovery_preflight(planned, classified(spark, sf), damaged_plan(spark, sf), planned.count())


@query(
    "wave_complete",
    checks_sql({
        "planned_count_matches_design": (TOTAL, f"({TOTAL}) + 1"), "cells_match_design": ("SELECT count(DISTINCT trial_id) FROM v_identity", "SELECT count(DISTINCT trial_id) FROM v_identity"),
        "every_answer_valid": (class_sql("valid", "n_ids"), f"({TOTAL}) + 1"), "nothing_unresolved": (f"({TOTAL}) - ({class_sql('valid', 'n_ids')})", NONE), **CLASSES,
    }),
)
def _(spark, sf):
    """Against a design of one observation more than planned."""
    planned = planned_identity(spark, sf)
    cells = planned.select("trial_id").distinct().count()
    return gates.wave_complete(planned, classified(spark, sf), planned.count() + 1, cells)


@query(
    "merge_complete",
    checks_sql({
        "planned_count_matches_design": ("SELECT count(*) FROM v_plan_ids", "SELECT count(*) FROM v_plan_ids"), "nothing_unresolved": ("(SELECT count(*) FROM v_plan_ids) - (SELECT count(*) FROM v_merged)", NONE),
        "every_observation_settled": ("SELECT count(*) FROM v_merged", "SELECT count(*) FROM v_plan_ids"), "no_observation_answered_again": ("SELECT count(*) FROM v_merged WHERE extra_recovery_answers > 0", NONE),
    }),
)
def _(spark, sf):
    planned, recovery = planned_ids(spark, sf), wave_rows(spark, sf).where("wave = 2")
    return gates.merge_complete(rec.merge_diagnostics(planned, recovery, merged(spark, sf)), planned.count())


# -- validation ----------------------------------------------------------------------------

VALIDATION = """SELECT o.observation_id, o.contrast_id, o.answer AS original_answer, o.reasoning_tokens, n.answer AS validation_answer,
       o.answer = n.answer AS agrees
       FROM (SELECT * FROM v_responses WHERE answer IS NOT NULL) o
       JOIN (SELECT observation_id - 1 AS observation_id, CASE WHEN observation_id % 3 = 0 THEN answer
                    ELSE CASE answer WHEN 'A' THEN 'B' WHEN 'B' THEN 'A' END END AS answer FROM v_responses) n
         ON n.observation_id = o.observation_id"""


def validation_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Each answered event against a rerun derived from the next event."""
    rows = answered(spark, sf)
    flipped = F.when(F.col("answer") == "A", "B").when(F.col("answer") == "B", "A")
    reruns = rows.select(
        (F.col("observation_id") - 1).alias("observation_id"),
        F.when(F.col("observation_id") % 3 == 0, F.col("answer")).otherwise(flipped).alias("answer"),
    )
    return rec.validation_rows(rows.where("answer IS NOT NULL"), reruns)


@query(
    "validation_agreement",
    f"""SELECT token_bin, count(*) AS n_validation_pairs, round(avg(agrees::INTEGER), 9) + 0.0 AS agreement_rate,
        round(avg((original_answer = 'A')::INTEGER), 9) + 0.0 AS original_a_rate,
        round(avg((validation_answer = 'A')::INTEGER), 9) + 0.0 AS validation_a_rate,
        round(avg((validation_answer = 'A')::INTEGER) - avg((original_answer = 'A')::INTEGER), 9) + 0.0 AS preference_shift
        FROM (SELECT *, CASE WHEN reasoning_tokens IS NULL THEN 'unknown' WHEN reasoning_tokens = 0 THEN '0'
                             WHEN reasoning_tokens < 100 THEN '1-99' WHEN reasoning_tokens < 500 THEN '100-499' ELSE '500+' END AS token_bin
              FROM ({VALIDATION}) WHERE agrees IS NOT NULL) GROUP BY ROLLUP (token_bin)""",
)
def _(spark, sf):
    return present(rec.validation_agreement(validation_pairs(spark, sf)))


@query(
    "validation_effects",
    """WITH r AS (SELECT *, CASE WHEN q % 4 = 0 THEN (CASE choice WHEN 'A' THEN story_b_id ELSE story_a_id END) ELSE chosen END AS chosen2
                  FROM v_judgements),
       c AS (SELECT contrast_id, instruction_condition, story_1_id, story_2_id, assignment, position,
                    avg((chosen = story_1_id)::INTEGER) AS o, avg((chosen2 = story_1_id)::INTEGER) AS n FROM r GROUP BY ALL),
       d AS (SELECT contrast_id, instruction_condition, story_1_id, story_2_id, count(*) AS k,
                    (sum(o) FILTER (assignment = 'forward') - sum(o) FILTER (assignment = 'flipped')) / 2 AS d_o,
                    (sum(n) FILTER (assignment = 'forward') - sum(n) FILTER (assignment = 'flipped')) / 2 AS d_n FROM c GROUP BY ALL)
       SELECT contrast_id, instruction_condition, story_1_id, story_2_id, round(d_o, 9) + 0.0 AS d_pair_original,
              round(d_n, 9) + 0.0 AS d_pair_validation, round(d_n - d_o, 9) + 0.0 AS d_pair_difference FROM d WHERE k = 4""",
)
def _(spark, sf):
    other = F.when(F.col("choice") == "A", "B").otherwise("A")
    rows = fix.judgements(spark, sf).withColumns(
        {
            "original_answer": F.col("choice"),
            "validation_answer": F.when(F.col("l_quantity").cast("int") % 4 == 0, other).otherwise(F.col("choice")),
        }
    )
    return present(rec.validation_effects(rows, V2))


# -- usage ---------------------------------------------------------------------------------

USAGE = """SELECT evaluator_id, count(*) AS n_attempts, sum(input_tokens)::BIGINT AS prompt_tokens,
       sum(output_tokens)::BIGINT AS completion_tokens, sum(reasoning_tokens)::BIGINT AS reasoning_tokens,
       sum(hit)::BIGINT AS cache_hit_prompt_tokens, sum(miss)::BIGINT AS cache_miss_prompt_tokens FROM v_responses GROUP BY ALL"""


@query("usage_totals", USAGE)
def _(spark, sf):
    return use.usage_totals(fix.responses(spark, sf), ("evaluator_id",))


def price_table(spark: SparkSession) -> DataFrame:
    return spark.sql(
        "SELECT * FROM VALUES ('e0', 0.07D, 0.27D, 1.10D), ('e1', 0.5D, 2.0D, 8.0D) "
        "AS t(evaluator_id, cache_hit_input, cache_miss_input, output)"
    )


@query(
    "cost_summary",
    f"""SELECT u.*, round((cache_hit_prompt_tokens * h + cache_miss_prompt_tokens * m) / 1e6, 9) + 0.0 AS estimated_input_cost_usd,
        round(completion_tokens * o / 1e6, 9) + 0.0 AS estimated_output_cost_usd,
        round((cache_hit_prompt_tokens * h + cache_miss_prompt_tokens * m) / 1e6 + completion_tokens * o / 1e6, 9) + 0.0 AS estimated_total_cost_usd,
        true AS cost_is_estimated, o IS NOT NULL AS is_priced
        FROM ({USAGE}) u LEFT JOIN (VALUES ('e0', 0.07::DOUBLE, 0.27::DOUBLE, 1.10::DOUBLE), ('e1', 0.5::DOUBLE, 2.0::DOUBLE, 8.0::DOUBLE)) t(e, h, m, o) ON e = evaluator_id""",
)
def _(spark, sf):
    usage = use.usage_totals(fix.responses(spark, sf), ("evaluator_id",))
    return present(use.cost_summary(usage, price_table(spark), ("evaluator_id",)))


@query(
    "response_models",
    "SELECT evaluator_id, response_model, count(*) AS n FROM v_responses GROUP BY ALL",
)
def _(spark, sf):
    return use.value_inventory(fix.responses(spark, sf), ("evaluator_id",), "response_model")


@query(
    "mixed_identity",
    """SELECT contrast_id, field, count(DISTINCT value) AS n_values, string_agg(DISTINCT value, ',' ORDER BY value) AS values
       FROM (SELECT contrast_id, 'evaluator_id' AS field, evaluator_id AS value FROM v_responses
             UNION ALL SELECT contrast_id, 'response_model', response_model FROM v_responses) GROUP BY ALL HAVING count(DISTINCT value) > 1""",
)
def _(spark, sf):
    mixed = use.mixed_identity(fix.responses(spark, sf), ("contrast_id",), ("evaluator_id", "response_model"))
    return mixed.withColumn("values", F.array_join("values", ","))


PEAK = "isodow(ts) <= 5 AND ((hour(ts) >= 1 AND hour(ts) < 4) OR (hour(ts) >= 6 AND hour(ts) < 10))"


@query(
    "peak_usage",
    f"""SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour_utc, {PEAK} AS is_peak, evaluator_id, count(*) AS n,
        sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens FROM v_responses GROUP BY ALL""",
)
def _(spark, sf):
    return use.peak_usage(fix.responses(spark, sf), ("evaluator_id",))


@query(
    "next_off_peak",
    f"""SELECT observation_id, strftime(CASE WHEN NOT ({PEAK}) THEN ts WHEN hour(ts) < 4 THEN date_trunc('day', ts) + INTERVAL 4 HOUR
        ELSE date_trunc('day', ts) + INTERVAL 10 HOUR END, '%Y-%m-%dT%H:%M:%SZ') AS next_off_peak FROM v_responses""",
)
def _(spark, sf):
    rows = fix.responses(spark, sf)
    return rows.select("observation_id", sc.utc_text(sc.next_off_peak(F.col("timestamp"))).alias("next_off_peak"))
