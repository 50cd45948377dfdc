"""Contract queries of design generation, gates, sampling and packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.contract.effects import present
from pairlens.contract.records import WS, planned_keys
from pairlens.contract.registry import query, view
from pairlens.contract.views import ROW_ORDER
from pairlens.functions import prompts as pr
from pairlens.functions import scalars as sc
from pairlens.functions.answers import strip
from pairlens.operators import design as ds
from pairlens.operators import effects as fx
from pairlens.operators import quality as q
from pairlens.operators import sampling as sp
from pairlens.operators.ordering import dealt
from pairlens.operators.resampling import items_of
from pairlens.sources import fixtures as fix

SEED = 42

# Design parameters of the examples (hand-written tables are part of a design, not data).
# The topic is a dealer of old prints; only the names of the dimensions are those of the design tables.
CONTRASTS = [
    dict(contrast_id="k0", dimension="provenance", a="island", b="mainland", a_clause="came off an island press", b_clause="came off a mainland press", expected_direction="a"),
    dict(contrast_id="k1", dimension="source_venue", a="almanac", b="handbill", a_clause="stood in an almanac", b_clause="was handed out at a market", expected_direction="a"),
    dict(contrast_id="k2", dimension="reception", a="nine_printings", b="pulped", a_clause="went through nine printings", b_clause="was sold for pulp", expected_direction="a"),
    dict(contrast_id="k3", dimension="user_opinion", a="framed", b="in_a_drawer", a_clause="hangs framed in my hall", b_clause="lies in my bottom drawer", expected_direction="a"),
    dict(contrast_id="k4", dimension="editing_status", a="proofed", b="untouched", a_clause="went past two proofreaders", b_clause="was never proofread", expected_direction="a"),
]
PROMPT_CONTRASTS = [dict(contrast_id="p0", dimension="prompt_context", a="none", b="weather", a_text="", b_text="The harbour is frozen this week.")]
DIMENSIONS = [
    dict(dimension="provenance", value_id="trunk", phrase="This lay in an attic trunk."),
    dict(dimension="provenance", value_id="auction", phrase="This went under the hammer in spring."),
    dict(dimension="provenance", value_id="kiosk", phrase="A kiosk printed this on demand."),
    dict(dimension="writer_status", value_id="apprentice", parent_value="trunk", phrase="The trunk's owner was an apprentice.", depends_on="provenance"),
    dict(dimension="writer_status", value_id="apprentice", parent_value="auction", phrase="The lot was an apprentice piece.", depends_on="provenance"),
    dict(dimension="reception", value_id="nine_printings", phrase="Nine printings were sold."),
]
CONDITIONS = [dict(id="neutral", context=""), dict(id="trunk", context="The text below lay in an attic trunk.")]
TASKS = [dict(id="marks", instruction="Give the text marks.")]
PAIR_CONDITIONS = [dict(id="neutral", a_context="", b_context=""), dict(id="trunk_vs_kiosk", a_context="This lay in an attic trunk.", b_context="A kiosk printed this on demand.")]
PILOT_INSTRUCTION = "Give marks to the two texts below."
INSTRUCTIONS = {"naturalistic": "Give the text below a mark between 1.0 and 10.0.", "text_only_invariance": "Give the wording of the text below, and nothing else, a mark between 1.0 and 10.0."}


def sql_text(text: str | None) -> str:
    return "NULL::VARCHAR" if text is None else "'" + text.replace("'", "''") + "'"


def sql_rows(rows: list[dict], fields: tuple[str, ...], name: str) -> str:
    body = ", ".join("(" + ", ".join(sql_text(r.get(f)) for f in fields) + ")" for r in rows)
    return f"(VALUES {body}) {name}({', '.join(fields)})"


def contrasts():
    return ds.literal_rows(CONTRASTS, ds.CONTRAST_FIELDS)


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """All documents as items; whole texts, stripped."""
    docs = fix.spread(fix.table(spark, sf, "documents"), "doc_id")
    return docs.select(
        F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("item_id"), strip(F.col("text")).alias("text")
    )


def neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """Each document with the next one: a pair table that grows with the documents."""
    docs = fix.table(spark, sf, "documents").select("doc_id", strip(F.col("text")).alias("text"), "lang")
    after = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("text_2"))

    def name(c):
        return F.concat(F.lit("d"), F.lpad(c.cast("string"), 9, "0"))

    return docs.join(after, "doc_id").select(
        name(F.col("doc_id")).alias("story_1_id"),
        name(F.col("doc_id") + 1).alias("story_2_id"),
        F.col("text").alias("text_1"),
        "text_2",
        "lang",
    )


view("v_docs", f"SELECT doc_id, 'd' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS item_id, trim(text, {WS}) AS text FROM documents")
view(
    "v_neighbours",
    """
SELECT a.item_id AS story_1_id, b.item_id AS story_2_id, a.text AS text_1, b.text AS text_2
FROM v_docs a JOIN v_docs b ON b.doc_id = a.doc_id + 1
""",
)
view(
    "v_counterbalanced",
    f"""
SELECT *, CASE WHEN top THEN a ELSE b END AS value_a, CASE WHEN top THEN b ELSE a END AS value_b,
       CASE WHEN top THEN a_clause ELSE b_clause END AS clause_a, CASE WHEN top THEN b_clause ELSE a_clause END AS clause_b
FROM (SELECT p.*, k.*, c.*, (assignment = 'forward') = (position = 'story1_as_a') AS top, story_1_id || '_vs_' || story_2_id AS pair_id,
             CASE WHEN position = 'story1_as_a' THEN story_1_id ELSE story_2_id END AS story_a_id,
             CASE WHEN position = 'story1_as_a' THEN story_2_id ELSE story_1_id END AS story_b_id,
             CASE WHEN position = 'story1_as_a' THEN text_1 ELSE text_2 END AS text_a,
             CASE WHEN position = 'story1_as_a' THEN text_2 ELSE text_1 END AS text_b
      FROM v_neighbours p, {sql_rows(CONTRASTS, ds.CONTRAST_FIELDS, 'k')},
           (VALUES ('forward', 'story1_as_a'), ('forward', 'story2_as_a'), ('flipped', 'story1_as_a'), ('flipped', 'story2_as_a')) c(assignment, position))
""",
)
PASSAGE = f"{sql_text(pr.PASSAGE_OPENING)} || ' Passage A ' || clause_a || ', while Passage B ' || clause_b || '.'"
BODY = "E'\\n\\nPassage A:\\n' || text_a || E'\\n\\nPassage B:\\n' || text_b || E'\\n\\n'"


@query("design_pairs", "SELECT a.item AS story_1_id, b.item AS story_2_id FROM (SELECT DISTINCT story_1_id AS item FROM v_pairs UNION SELECT story_2_id FROM v_pairs) a JOIN (SELECT DISTINCT story_1_id AS item FROM v_pairs UNION SELECT story_2_id FROM v_pairs) b ON a.item < b.item")
def _(spark, sf):
    items = items_of(fix.baseline(spark, sf)).withColumnRenamed("story_id", "item_id")
    return ds.unordered_pairs(items)


@query("design_ordered_pairs", "SELECT a.item AS story_a_id, b.item AS story_b_id FROM (SELECT DISTINCT story_1_id AS item FROM v_pairs UNION SELECT story_2_id FROM v_pairs) a JOIN (SELECT DISTINCT story_1_id AS item FROM v_pairs UNION SELECT story_2_id FROM v_pairs) b ON a.item <> b.item")
def _(spark, sf):
    items = items_of(fix.baseline(spark, sf)).withColumnRenamed("story_id", "item_id")
    return ds.ordered_pairs(items)


V2_SQL = f"""SELECT superblock || '__' || instruction_condition || '__' || assignment || '__' || position AS trial_id,
  superblock || '__' || instruction_condition AS block_id, superblock AS superblock_id, instruction_condition, contrast_id, dimension,
  story_1_id, story_2_id, story_a_id, story_b_id, assignment, position, value_a, value_b,
  sha256({PASSAGE} || E'\\n\\n' || sentence || {BODY} || {sql_text(pr.QUESTION_V2)}) AS prompt_sha256
  FROM (SELECT *, 'superblock__' || contrast_id || '__' || pair_id AS superblock FROM v_counterbalanced),
       (VALUES ('matched_control', {sql_text(pr.INSTRUCTIONS_V2['matched_control'])}), ('text_only', {sql_text(pr.INSTRUCTIONS_V2['text_only'])})) i(instruction_condition, sentence)"""


def manifest_v2(spark: SparkSession, sf: str) -> DataFrame:
    return ds.plain_manifest_v2(neighbours(spark, sf), contrasts())


@query("design_blocks", V2_SQL)
def _(spark, sf):
    return manifest_v2(spark, sf).select(
        "trial_id", "block_id", "superblock_id", "instruction_condition", "contrast_id", "dimension", "story_1_id",
        "story_2_id", "story_a_id", "story_b_id", "assignment", "position", F.col("context_a.value").alias("value_a"),
        F.col("context_b.value").alias("value_b"), "prompt_sha256",
    )


@query(
    "design_blocks_v1",
    f"""SELECT 'block__' || contrast_id || '__' || pair_id || '__' || regime || '__forced__plain_ab__' || assignment || '__' || position AS trial_id,
        regime AS evaluation_regime, sha256({PASSAGE} || sentence || {BODY} || {sql_text(pr.QUESTION_V1)}) AS prompt_sha256
        FROM v_counterbalanced, (VALUES ('naturalistic', ''), ('text_only_invariance', E'\\n\\n' || {sql_text(pr.SUPPRESSION_INSTRUCTION_V1)})) r(regime, sentence)""",
)
def _(spark, sf):
    return ds.plain_manifest_v1(neighbours(spark, sf), contrasts()).select("trial_id", "evaluation_regime", "prompt_sha256")


def _pairwise_sql(intro: str, mode: str) -> str:
    """Prompt text of the five-category task, with ``inv`` holding the optional sentence."""
    instruction = pr.TIE_INSTRUCTION if mode == "tie_allowed" else pr.FORCED_INSTRUCTION
    return (
        f"{intro} || E'\\n\\nStory A:\\n' || text_a || E'\\n\\nStory B:\\n' || text_b || inv || E'\\n\\n' || {sql_text(instruction)} "
        f"|| E'\\n\\n' || {sql_text(pr.CATEGORIES)} || E'\\n\\nReturn only JSON:\\n\\n' || {sql_text(pr._example(mode))}"
    )


INV = f"(VALUES ('naturalistic', ''), ('text_only_invariance', E'\\n\\n' || {sql_text(pr.INVARIANCE_INSTRUCTION)})) r(regime, inv)"
STORY = f"{sql_text(pr.PAIRWISE_OPENING)} || ' Story A ' || clause_a || ', while Story B ' || clause_b || '. ' || {sql_text(pr.PAIRWISE_CLOSING)}"


def _pairwise_query(mode: str) -> str:
    return f"""SELECT 'block__' || contrast_id || '__' || pair_id || '__' || regime || '__{mode}__' || assignment || '__' || position AS trial_id,
        regime AS evaluation_regime, '{mode}' AS choice_mode, sha256({_pairwise_sql(STORY, mode)}) AS prompt_hash FROM v_counterbalanced, {INV}"""


@query("design_pairwise", f"{_pairwise_query('forced')} UNION ALL {_pairwise_query('tie_allowed')}")
def _(spark, sf):
    pairs = neighbours(spark, sf)
    both = [ds.pairwise_manifest(pairs, contrasts(), choice_mode=m) for m in ("forced", "tie_allowed")]
    return both[0].unionByName(both[1]).select(
        "trial_id", "evaluation_regime", "choice_mode", sc.text_hash(F.col("prompt")).alias("prompt_hash")
    )


@query(
    "design_baselines",
    f"""WITH shown AS (SELECT DISTINCT pair_id, position, text_a, text_b FROM v_counterbalanced)
        SELECT 'baseline_block__' || pair_id || '__' || position AS trial_id, 'v1' AS design,
               sha256({sql_text(pr.PASSAGE_OPENING)} || {BODY} || {sql_text(pr.QUESTION_V1)}) AS prompt_sha256 FROM shown
        UNION ALL SELECT 'baseline_superblock__' || pair_id || '__' || position, 'v2',
               sha256({sql_text(pr.PASSAGE_OPENING)} || E'\\n\\n' || {sql_text(pr.INSTRUCTIONS_V2['matched_control'])} || {BODY} || {sql_text(pr.QUESTION_V2)}) FROM shown
        UNION ALL SELECT 'baseline_text_only_superblock__' || pair_id || '__' || position, 'v2_text_only',
               sha256({sql_text(pr.PASSAGE_OPENING)} || E'\\n\\n' || {sql_text(pr.INSTRUCTIONS_V2['text_only'])} || {BODY} || {sql_text(pr.QUESTION_V2)}) FROM shown""",
)
def _(spark, sf):
    pairs = neighbours(spark, sf)
    parts = [
        ds.baseline_manifest_v1(pairs).select("trial_id", F.lit("v1").alias("design"), "prompt_sha256"),
        ds.baseline_manifest_v2(pairs).select("trial_id", F.lit("v2").alias("design"), "prompt_sha256"),
        ds.baseline_manifest_v2(pairs, "text_only").select("trial_id", F.lit("v2_text_only").alias("design"), "prompt_sha256"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "design_prompt_scope",
    f"""SELECT 'context_prompt__p0__' || story_1_id || '_vs_' || story_2_id || '__' || value || '__' || regime AS trial_id, value,
        regime AS evaluation_regime, sha256({_pairwise_sql("opening || tail", 'forced')}) AS prompt_hash
        FROM (SELECT *, text_1 AS text_a, text_2 AS text_b, {sql_text(ds.PROMPT_INTRO)} AS opening FROM v_neighbours),
             (VALUES ('none', ''), ('weather', ' The harbour is frozen this week.')) v(value, tail), {INV}""",
)
def _(spark, sf):
    fields = ("contrast_id", "dimension", "a", "b", "a_text", "b_text")
    manifest = ds.prompt_manifest(neighbours(spark, sf), ds.literal_rows(PROMPT_CONTRASTS, fields))
    return manifest.select("trial_id", "value", "evaluation_regime", sc.text_hash(F.col("prompt")).alias("prompt_hash"))


INDEPENDENT = [r for r in DIMENSIONS if not r.get("depends_on")]


@query(
    "design_same_context",
    f"""SELECT 'context_pairwise_same__' || dimension || '__' || value_id || '__' || story_1_id || '_vs_' || story_2_id AS trial_id,
        sha256({_pairwise_sql(sql_text(pr.PAIRWISE_OPENING) + " || ' ' || phrase || ' ' || " + sql_text(pr.SAME_FOR_BOTH) + " || ' ' || " + sql_text(pr.PAIRWISE_CLOSING), 'forced')}) AS prompt_hash
        FROM (SELECT *, text_1 AS text_a, text_2 AS text_b, '' AS inv FROM v_neighbours), {sql_rows(INDEPENDENT, ('dimension', 'value_id', 'phrase'), 'd')}""",
)
def _(spark, sf):
    values = ds.literal_rows([dict(dimension=r["dimension"], value=r["value_id"], phrase=r["phrase"]) for r in INDEPENDENT], ("dimension", "value", "phrase"))
    manifest = ds.same_context_manifest(neighbours(spark, sf), values)
    return manifest.select("trial_id", sc.text_hash(F.col("prompt")).alias("prompt_hash"))


def dimensions(spark: SparkSession) -> DataFrame:
    rows = [
        (r["dimension"], r["value_id"], r.get("parent_value"), r["phrase"], r.get("depends_on"), "story", ["trunk", "auction"] if r.get("depends_on") else None)
        for r in DIMENSIONS
    ]
    return spark.createDataFrame(
        rows, "dimension string, value_id string, parent_value string, phrase string, depends_on string, scope string, applies_when array<string>"
    )


@query(
    "design_context_single",
    f"""SELECT 'context_single__' || item_id || '__' || condition_id || '__' || regime AS trial_id, item_id AS story_id, condition_id,
        context_text, regime AS evaluation_regime,
        sha256(CASE WHEN context_text = '' THEN '' ELSE context_text || E'\\n\\n' END || instruction || E'\\n\\nText:\\n\"\"\"\\n' || text || E'\\n\"\"\"') AS prompt_hash
        FROM v_docs, (VALUES ('neutral', ''), ('provenance__trunk', 'This lay in an attic trunk.'), ('provenance__auction', 'This went under the hammer in spring.'),
             ('provenance__kiosk', 'A kiosk printed this on demand.'), ('writer_status__apprentice', 'This lay in an attic trunk. The trunk''s owner was an apprentice.'),
             ('reception__nine_printings', 'Nine printings were sold.')) c(condition_id, context_text),
             (VALUES ('naturalistic', {sql_text(INSTRUCTIONS['naturalistic'])}), ('text_only_invariance', {sql_text(INSTRUCTIONS['text_only_invariance'])})) r(regime, instruction)""",
)
def _(spark, sf):
    manifest = ds.context_single_manifest(documents(spark, sf), ds.single_variable_conditions(dimensions(spark)), INSTRUCTIONS)
    return manifest.select(
        "trial_id", "story_id", "condition_id", "context_text", "evaluation_regime", sc.text_hash(F.col("prompt")).alias("prompt_hash")
    )


@query(
    "design_pilot",
    f"""SELECT 'single__' || item_id || '__' || c.id || '__{TASKS[0]['id']}' AS trial_id, 'single' AS type,
        sha256(CASE WHEN c.context = '' THEN '' ELSE c.context || E'\\n\\n' END || {sql_text(TASKS[0]['instruction'])} || E'\\n\\nText:\\n\"\"\"\\n' || text || E'\\n\"\"\"') AS prompt_hash
        FROM v_docs, {sql_rows(CONDITIONS, ('id', 'context'), 'c')}
        UNION ALL
        SELECT 'comparison__' || story_1_id || '__' || story_2_id || '__' || c.id, 'comparison',
        sha256({sql_text(PILOT_INSTRUCTION)} || E'\\n\\n' || CASE WHEN a_context = '' THEN '' ELSE a_context || E'\\n' END || E'STORY A:\\n\"\"\"\\n' || text_1 || E'\\n\"\"\"\\n\\n'
               || CASE WHEN b_context = '' THEN '' ELSE b_context || E'\\n' END || E'STORY B:\\n\"\"\"\\n' || text_2 || E'\\n\"\"\"')
        FROM v_neighbours, {sql_rows(PAIR_CONDITIONS, ('id', 'a_context', 'b_context'), 'c')}
        UNION ALL
        SELECT 'comparison_control__' || item_id || '__' || c.id, 'comparison_control',
        sha256({sql_text(PILOT_INSTRUCTION)} || E'\\n\\n' || CASE WHEN a_context = '' THEN '' ELSE a_context || E'\\n' END || E'STORY A:\\n\"\"\"\\n' || text || E'\\n\"\"\"\\n\\n'
               || CASE WHEN b_context = '' THEN '' ELSE b_context || E'\\n' END || E'STORY B:\\n\"\"\"\\n' || text || E'\\n\"\"\"')
        FROM v_docs, {sql_rows(PAIR_CONDITIONS, ('id', 'a_context', 'b_context'), 'c')}""",
)
def _(spark, sf):
    items = documents(spark, sf)
    pairs = neighbours(spark, sf).select(F.col("story_1_id").alias("story_a_id"), F.col("story_2_id").alias("story_b_id"))
    conditions = ds.literal_rows(PAIR_CONDITIONS, ("id", "a_context", "b_context"))
    parts = [
        ds.single_manifest(items, ds.literal_rows(CONDITIONS, ("id", "context")), ds.literal_rows(TASKS, ("id", "instruction"))),
        ds.comparison_manifest(pairs, items, conditions, PILOT_INSTRUCTION),
        ds.comparison_manifest(ds.self_pairs(items), items, conditions, PILOT_INSTRUCTION, control=True),
    ]
    shown = [p.select("trial_id", "type", sc.text_hash(F.col("prompt")).alias("prompt_hash")) for p in parts]
    return shown[0].unionByName(shown[1]).unionByName(shown[2])


@query(
    "planned_observations",
    """SELECT 'x::e::c0__' || o_orderkey || '::r' || r AS observation_id, 'c0__' || o_orderkey AS trial_id, r AS replicate_number, 'treatment' AS unit_kind
       FROM orders, (SELECT unnest([1, 2, 3]) AS r)""",
)
def _(spark, sf):
    trials = fix.table(spark, sf, "orders").select(F.concat_ws("__", F.lit("c0"), "o_orderkey").alias("trial_id"))
    return ds.planned_observations(trials, 3, "x", "e", "treatment")


@query(
    "replicates",
    """SELECT item_id, condition_id, unnest(range(1, CASE WHEN condition_id = 'neutral' THEN 6 ELSE 3 END)) AS replicate_number
       FROM v_docs, (VALUES ('neutral'), ('signal')) c(condition_id)""",
)
def _(spark, sf):
    trials = documents(spark, sf).select(
        "item_id", F.lit("context_single").alias("type"), F.explode(F.array(F.lit("neutral"), F.lit("signal"))).alias("condition_id")
    )
    return ds.expand_replicates(trials, 2, 5).drop("type")


# -- corpus --------------------------------------------------------------------------------

WORDS = f"len(regexp_extract_all(text, '[^' || {WS} || ']+'))"


@query("corpus_profile", f"SELECT item_id, sha256(text) AS sha256, {WORDS} AS word_count FROM v_docs")
def _(spark, sf):
    return ds.corpus_profile(documents(spark, sf))


@query("corpus_hash", "SELECT count(*) AS n_items, sha256(string_agg(item_id || ':' || sha256(text), chr(10) ORDER BY item_id)) AS corpus_hash FROM v_docs")
def _(spark, sf):
    return ds.corpus_hash(ds.corpus_profile(documents(spark, sf)))


@query(
    "prompt_size",
    f"""SELECT round(w, 9) + 0.0 AS avg_story_word_count, round(2 * w + 60, 9) + 0.0 AS avg_prompt_word_count,
        round((2 * w + 60) * 1.3, 9) + 0.0 AS avg_prompt_token_estimate, round((2 * w + 60) * calls, 6) + 0.0 AS total_word_estimate,
        round((2 * w + 60) * 1.3 * calls, 6) + 0.0 AS total_token_estimate FROM (SELECT avg({WORDS}) AS w FROM v_docs), (SELECT count(*) AS calls FROM v_planned)""",
)
def _(spark, sf):
    calls = planned_keys(spark, sf).count()  # counted from the plan, not from the design's size
    texts = fix.spread(fix.table(spark, sf, "documents"), "doc_id").select(F.col("doc_id").alias("item_id"), "text")
    return present(ds.prompt_size(ds.corpus_profile(texts), calls))


# -- gates ---------------------------------------------------------------------------------


def units(spark: SparkSession, sf: str) -> DataFrame:
    """Judgement rows as planned cells; every seventh line number never resolved."""
    return fix.judgements(spark, sf, replicates=True).withColumn(
        "parsing_status", F.when(F.col("l_linenumber") % 7 == 0, "unresolved").otherwise("resolved")
    )


UNIT = ("superblock_id", "replicate_number")
STATUS = """SELECT superblock_id, replicate_number, count(*) AS n_cells_present,
       count(DISTINCT instruction_condition || assignment || position) AS n_distinct_cells,
       count(*) FILTER (l_linenumber % 7 = 0) AS n_terminally_failed FROM v_judgements_rep GROUP BY ALL"""
COMPLETE = "n_cells_present = 8 AND n_distinct_cells = 8 AND n_terminally_failed = 0"


def status(spark: SparkSession, sf: str) -> DataFrame:
    cell = ("instruction_condition", "assignment", "position")
    return q.unit_status(dealt(units(spark, sf), fix.lines(spark, sf), UNIT), UNIT, cell, 8, F.col("parsing_status") == "resolved")


@query(
    "incomplete_reasons",
    f"""SELECT *, 8::BIGINT AS n_cells_expected, {COMPLETE} AS complete, CASE WHEN {COMPLETE} THEN NULL
        WHEN n_terminally_failed > 0 THEN 'terminally_incomplete' ELSE 'temporarily_incomplete' END AS reason FROM ({STATUS})""",
)
def _(spark, sf):
    return status(spark, sf)


@query(
    "complete_units",
    f"""SELECT j.superblock_id, j.replicate_number, j.instruction_condition, j.assignment, j.position, j.choice
        FROM v_judgements_rep j JOIN (SELECT * FROM ({STATUS}) WHERE {COMPLETE}) s
          ON s.superblock_id = j.superblock_id AND s.replicate_number = j.replicate_number""",
)
def _(spark, sf):
    rows = q.complete_rows(dealt(units(spark, sf), fix.lines(spark, sf), UNIT), status(spark, sf), UNIT, keys_not_null=True)
    return rows.select(*UNIT, "instruction_condition", "assignment", "position", "choice")


@query("unit_counts", f"SELECT count(*) FILTER ({COMPLETE}) AS n_complete, count(*) FILTER (NOT ({COMPLETE})) AS n_incomplete FROM ({STATUS})")
def _(spark, sf):
    return q.unit_counts(status(spark, sf))


@query(
    "resolved_cells",
    """SELECT contrast_id, instruction_condition, assignment, position, count(*) AS n_resolved_cells FROM v_judgements GROUP BY ALL
       UNION ALL SELECT NULL, instruction_condition, NULL, position, count(*) FROM v_baseline GROUP BY ALL""",
)
def _(spark, sf):
    by = ("contrast_id", "instruction_condition", "assignment", "position")
    nothing = F.lit(None).cast("string")
    blind = fix.baseline(spark, sf).select(
        nothing.alias("contrast_id"), "instruction_condition", nothing.alias("assignment"), "position"
    )
    return q.resolved_cells(fix.judgements(spark, sf).select(*by).unionByName(blind), by)


@query(
    "design_gate",
    """SELECT superblock_id || '__' || instruction_condition || '__' || replicate_number AS block_id, count(*) AS n_cells,
       array_to_string(list_sort(list(DISTINCT assignment || '/' || position)), ',') AS cells FROM v_judgements_rep GROUP BY 1 HAVING count(*) <> 4""",
)
def _(spark, sf):
    blocks = units(spark, sf).withColumn("block_id", F.concat_ws("__", "superblock_id", "instruction_condition", "replicate_number"))
    return q.block_violations(blocks)


DAMAGED = """SELECT lang, CASE lang WHEN 'de' THEN 'blocks' WHEN 'fr' THEN 'trials' WHEN 'es' THEN 'unique_ids' END AS hit, 5 * count(*) AS per_pair
       FROM documents d WHERE EXISTS (SELECT 1 FROM documents e WHERE e.doc_id = d.doc_id + 1) GROUP BY lang"""


@query(
    "manifest_violations",
    f"""WITH d AS ({DAMAGED}), n AS (SELECT coalesce(sum(per_pair) FILTER (lang = 'de'), 0) AS de,
             coalesce(sum(per_pair) FILTER (lang = 'fr'), 0) AS fr, coalesce(sum(per_pair) FILTER (lang = 'es'), 0) AS es FROM d)
        SELECT check_name, v::BIGINT AS n_violations, v = 0 AS ok FROM n,
          LATERAL (VALUES ('blocks', de + es), ('superblocks', de + es), ('trials', fr + es), ('unique_ids', es)) t(check_name, v)""",
)
def _(spark, sf):
    """Gates over a manifest that was damaged by language: a lost cell, another prompt, a repeated row."""
    # the language of the first text comes along from the pairs: a join here would shuffle every prompt
    rows = ds.plain_manifest_v2(neighbours(spark, sf), contrasts(), keep=("lang",))
    target = (
        (F.col("instruction_condition") == "text_only")
        & (F.col("assignment") == "flipped")
        & (F.col("position") == "story2_as_a")
    )
    kept = rows.where(~(target & (F.col("lang") == "de")))
    changed = kept.withColumn(
        "prompt", F.when(target & (F.col("lang") == "fr"), F.concat("prompt", F.lit("!"))).otherwise(F.col("prompt"))
    )
    manifest = changed.unionByName(changed.where(target & (F.col("lang") == "es"))).drop("lang")
    conditions = ("matched_control", "text_only")
    return q.check_report(
        {
            "blocks": q.block_violations(manifest),
            "superblocks": q.superblock_violations(manifest, conditions),
            "trials": q.trial_violations(
                manifest, response_format="plain_ab", instruction_conditions=conditions,
                contrast_ids=[c["contrast_id"] for c in CONTRASTS],
            ),
            "unique_ids": q.duplicate_ids(manifest, "trial_id"),
        }
    )


CONFIGURED = [("e0", "alpha"), ("e1", "beta")]
VERSIONED = """SELECT *, CASE WHEN l_linenumber = 1 THEN NULL WHEN model = 'e0' THEN 'v' || CAST(l_linenumber % 2 AS VARCHAR) ELSE 'v0' END AS version
       FROM v_judgements WHERE model IN ('e0', 'e1')"""


@query(
    "evaluator_partition",
    f"""SELECT CASE WHEN model = 'e0' THEN 'alpha#' || coalesce(version, 'unresolved') ELSE 'beta' END AS partition_id,
        contrast_id, count(*) AS n FROM ({VERSIONED}) GROUP BY ALL""",
)
def _(spark, sf):
    version = F.when(F.col("model") == "e0", F.concat(F.lit("v"), (F.col("l_linenumber") % 2).cast("string"))).otherwise("v0")
    rows = fix.judgements(spark, sf).drop("evaluator_id").withColumn("response_model", F.when(F.col("l_linenumber") != 1, version))
    configured = spark.createDataFrame(CONFIGURED, "model string, evaluator_id string")
    parts = q.split_versions(q.match_evaluators(rows, configured, ("model",)))
    return parts.groupBy("partition_id", "contrast_id").agg(F.count("*").alias("n"))


@query(
    "setting_mismatches",
    """SELECT 'evaluator_id' AS setting, evaluator_id AS found, 'e0' AS required, count(*) AS n FROM v_responses WHERE evaluator_id <> 'e0' GROUP BY ALL
       UNION ALL SELECT 'response_model', response_model, 'v1', count(*) FROM v_responses WHERE response_model <> 'v1' GROUP BY ALL""",
)
def _(spark, sf):
    return q.setting_mismatches(fix.responses(spark, sf), {"evaluator_id": "e0", "response_model": "v1"})


@query("regime_isolation", "SELECT count(*) FILTER (sampling_regime = 'low_variance_primary') AS n_kept, count(*) FILTER (sampling_regime <> 'low_variance_primary') AS n_excluded FROM v_attempts")
def _(spark, sf):
    return q.isolate(fix.attempts(spark, sf), F.col("sampling_regime") == "low_variance_primary")[1]


@query("fingerprint")
def _(spark, sf):
    """Row hashes are over Spark's own JSON, so there is no SQL to compare with."""
    return q.fingerprints({t: fix.table(spark, sf, t) for t in ("documents", "orders", "lineitem", "events")})


@query("shared_ids", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def _(spark, sf):
    return q.shared_ids(fix.table(spark, sf, "documents"), fix.table(spark, sf, "labels"), "doc_id")


# -- sampling ------------------------------------------------------------------------------


@query(
    "unit_limit",
    f"""SELECT superblock_id, count(*) AS n FROM v_judgements WHERE superblock_id IN
        (SELECT superblock_id FROM (SELECT DISTINCT superblock_id FROM v_judgements) ORDER BY md5('{SEED}:' || superblock_id), superblock_id LIMIT 20) GROUP BY ALL""",
)
def _(spark, sf):
    return sp.limit_units(fix.judgements(spark, sf), SEED, 20, "superblock_id").groupBy("superblock_id").agg(F.count("*").alias("n"))


@query(
    "first_units",
    f"""SELECT superblock_id, count(*) AS n FROM v_judgements WHERE superblock_id IN
        (SELECT superblock_id FROM v_judgements GROUP BY 1 ORDER BY min(row({ROW_ORDER})) LIMIT 20) GROUP BY ALL""",
)
def _(spark, sf):
    rows = sp.first_units(fix.judgements(spark, sf), 20, fix.ROW_ORDER, "superblock_id")
    return rows.groupBy("superblock_id").agg(F.count("*").alias("n"))


CELL_SQL = "concat_ws('/', instruction_condition, assignment, position)"


@query(
    "execution_order",
    f"""SELECT superblock_id, replicate_number, cell, 42 AS random_seed, row_number() OVER (ORDER BY md5('{SEED}:' || superblock_id || ':' || replicate_number), superblock_id,
        replicate_number, md5('{SEED}:' || superblock_id || ':' || replicate_number || ':' || cell), cell) AS execution_order_index
        FROM (SELECT *, {CELL_SQL} AS cell FROM v_judgements_rep)""",
)
def _(spark, sf):
    rows = fix.judgements(spark, sf, replicates=True).select(
        "superblock_id", "replicate_number", F.concat_ws("/", "instruction_condition", "assignment", "position").alias("cell")
    )
    return sp.execution_order(rows, SEED, "superblock_id", "replicate_number", "cell")


STRATA = ("instruction_condition", "contrast_id", "model")
SAMPLE_SIZE = 500
ROW_ID = "concat_ws('_', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d'))"
SEATS = f"""SELECT *, least(n, whole + CASE WHEN row_number() OVER (ORDER BY round(raw - whole, 12) DESC, {', '.join(STRATA)}) <= {SAMPLE_SIZE} - sum(whole) OVER () THEN 1 ELSE 0 END)::BIGINT AS seats
       FROM (SELECT *, floor(raw)::BIGINT AS whole FROM (SELECT {', '.join(STRATA)}, count(*) AS n,
             count(*) * {SAMPLE_SIZE} / sum(count(*)) OVER () AS raw FROM v_judgements GROUP BY ALL))"""


@query("sample_allocation", f"SELECT {', '.join(STRATA)}, n, seats FROM ({SEATS})")
def _(spark, sf):
    return sp.allocation(fix.judgements(spark, sf), STRATA, SAMPLE_SIZE)


@query(
    "stratified_sample",
    f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY {', '.join(STRATA)} ORDER BY md5('{SEED}:' || id), id) AS place
                   FROM (SELECT *, {ROW_ID} AS id FROM v_judgements))
        SELECT id, {', '.join(STRATA)} FROM r JOIN ({SEATS}) USING ({', '.join(STRATA)}) WHERE place <= seats""",
)
def _(spark, sf):
    identifier = F.concat_ws("_", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyyMMdd"))
    rows = fix.judgements(spark, sf).select(*STRATA, identifier.alias("id"))
    return sp.stratified_sample(rows, STRATA, SAMPLE_SIZE, SEED, "id")


# Conversations are units of several requests; the answers of a unit stay together.
MAX_REQUESTS, MAX_TOKENS = 40, 6000
PACKED = f"""WITH RECURSIVE u AS (
    SELECT conv_id, count(*) AS n_requests, sum(greatest(1, length(text) // 4))::BIGINT AS n_tokens, row_number() OVER (ORDER BY conv_id) AS pos
    FROM conversations GROUP BY conv_id),
  walk AS (SELECT conv_id, pos, n_requests AS r, n_tokens AS t, 1::BIGINT AS chunk FROM u WHERE pos = 1
    UNION ALL SELECT u.conv_id, u.pos,
      CASE WHEN w.r + u.n_requests > {MAX_REQUESTS} OR w.t + u.n_tokens > {MAX_TOKENS} THEN u.n_requests ELSE w.r + u.n_requests END,
      CASE WHEN w.r + u.n_requests > {MAX_REQUESTS} OR w.t + u.n_tokens > {MAX_TOKENS} THEN u.n_tokens ELSE w.t + u.n_tokens END,
      CASE WHEN w.r + u.n_requests > {MAX_REQUESTS} OR w.t + u.n_tokens > {MAX_TOKENS} THEN w.chunk + 1 ELSE w.chunk END
    FROM walk w JOIN u ON u.pos = w.pos + 1)
  SELECT u.conv_id, u.n_requests, u.n_tokens, u.conv_id AS arrival, walk.chunk FROM u JOIN walk ON walk.pos = u.pos"""


@query("pack_requests", PACKED)
def _(spark, sf):
    turns = fix.table(spark, sf, "conversations")
    packed_units = sp.request_units(turns, ("conv_id",), F.col("conv_id"), sc.estimated_tokens(F.col("text")))
    return sp.pack_requests(packed_units, F.floor(F.col("arrival") / 1000), MAX_REQUESTS, MAX_TOKENS)
