"""Design generation: pairs, counterbalanced blocks, manifests, replicates.

A pair list is an ordinary table.  ``unordered_pairs`` makes the complete one when the
full round robin is wanted; any other pair table works as well.  Pairs are enumerated
by cyclic offsets and joined by index, so every item produces the same number of rows
and no nested-loop join appears.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.functions import prompts as pr
from pairlens.functions.answers import WHITESPACE_CHARS, strip
from pairlens.functions.scalars import observation_id, text_hash
from pairlens.operators.effects import CELLS, POSITIONS
from pairlens.operators.ordering import indexed_by_text

# Rendering order of the story-scope dimensions.
DIMENSION_ORDER = ("provenance", "writer_status", "source_venue", "editing_status", "reception", "user_opinion")
REGIMES = ("naturalistic", "text_only_invariance")


def literal_rows(rows: Sequence[Mapping[str, str | None]], fields: Sequence[str]) -> Column:
    """A small hand-written table (contrasts, conditions, tasks) as an array of structs."""
    return F.array(*[F.struct(*[F.lit(r.get(f)).cast("string").alias(f) for f in fields]) for r in rows])


# -- pairs ---------------------------------------------------------------------------------


def unordered_pairs(items: DataFrame, item: str = "item_id") -> DataFrame:
    """Every unordered pair of distinct items once, story_1 < story_2.

    Item i meets items i+1 ... i+(n-1)/2 around a circle (and i+n/2 from one half when
    n is even): the load per item is even, and partners are found by an equi-join.
    """
    indexed = indexed_by_text(items.select(item).distinct(), item, "__i").withColumn("__i", F.col("__i") - 1).persist()
    n = indexed.count()
    reach = F.lit((n - 1) // 2) + F.when(F.lit(n % 2 == 0) & (F.col("__i") < n // 2), 1).otherwise(0)
    offsets = F.when(reach >= 1, F.sequence(F.lit(1), reach))
    stepped = indexed.select(F.col(item).alias("__a"), "__i", F.explode(offsets).alias("__d"))
    ahead = stepped.select("__a", ((F.col("__i") + F.col("__d")) % max(n, 1)).alias("__i"))
    met = ahead.join(indexed.withColumnRenamed(item, "__b"), "__i")
    return met.select(F.least("__a", "__b").alias("story_1_id"), F.greatest("__a", "__b").alias("story_2_id"))


def ordered_pairs(items: DataFrame, item: str = "item_id") -> DataFrame:
    """Every ordered pair of distinct items."""
    both = F.explode(
        F.array(
            F.struct(F.col("story_1_id").alias("a"), F.col("story_2_id").alias("b")),
            F.struct(F.col("story_2_id").alias("a"), F.col("story_1_id").alias("b")),
        )
    )
    return unordered_pairs(items, item).select(both.alias("p")).select(
        F.col("p.a").alias("story_a_id"), F.col("p.b").alias("story_b_id")
    )


def self_pairs(items: DataFrame, item: str = "item_id") -> DataFrame:
    """Each item against itself (identical-text controls)."""
    return items.select(F.col(item).alias("story_a_id"), F.col(item).alias("story_b_id"))


def select_items(items: DataFrame, wanted: Sequence[str], item: str = "item_id") -> DataFrame:
    """A fixed subset of items; a missing id is an error, not a smaller design."""
    chosen = items.where(F.col(item).isin(*wanted))
    found = {row[item] for row in chosen.select(item).distinct().collect()}
    missing = sorted(set(wanted) - found)
    if missing:
        raise ValueError(f"items not registered: {missing}")
    return chosen


def with_texts(pairs: DataFrame, items: DataFrame, first: str, second: str, item: str = "item_id") -> DataFrame:
    """Attach both texts to a pair table by two equi-joins."""
    one = items.select(F.col(item).alias(first), F.col("text").alias("text_1"))
    two = items.select(F.col(item).alias(second), F.col("text").alias("text_2"))
    return pairs.join(one, first).join(two, second)


# -- context packets -----------------------------------------------------------------------


def _order_of(dimension: Column) -> Column:
    return F.array_position(F.array(*[F.lit(d) for d in DIMENSION_ORDER]), dimension)


def render_packets(packets: DataFrame, dimensions: DataFrame) -> DataFrame:
    """One text per packet: the phrases of its values in the fixed dimension order.

    ``packets``: (packet_id, dimension, value_id).  ``dimensions``: (dimension,
    value_id, parent_value, phrase, depends_on); a phrase with a parent value is used
    only beside that parent.  A packet holds at most one value per dimension.
    """
    entries = packets.join(dimensions.select("dimension", "value_id", "parent_value", "phrase", "depends_on"), ["dimension", "value_id"])
    carriers = packets.select("packet_id", F.col("dimension").alias("depends_on"), F.col("value_id").alias("__parent"))
    resolved = entries.join(carriers, ["packet_id", "depends_on"], "left").where(
        "parent_value IS NULL OR parent_value = __parent"
    )
    ordered = F.array_sort(F.collect_list(F.struct(_order_of(F.col("dimension")).alias("o"), F.col("phrase").alias("p"))))
    return resolved.groupBy("packet_id").agg(F.array_join(F.transform(ordered, lambda e: e["p"]), " ").alias("context_text"))


def single_variable_conditions(dimensions: DataFrame) -> DataFrame:
    """One condition per story-scope value, plus the neutral one.

    A dependent dimension is pinned to the first parent value it applies to.
    ``dimensions`` also has ``scope`` and ``applies_when``.
    """
    story = dimensions.where(F.col("scope") == "story").where(F.col("dimension").isin(*DIMENSION_ORDER))
    values = story.select("dimension", "value_id", "depends_on", "applies_when").distinct()
    named = values.withColumn("packet_id", F.concat_ws("__", "dimension", "value_id"))
    own = named.select("packet_id", "dimension", "value_id")
    carrier = named.where("depends_on IS NOT NULL").select(
        "packet_id", F.col("depends_on").alias("dimension"), F.col("applies_when")[0].alias("value_id")
    )
    texts = render_packets(own.unionByName(carrier), story)
    treated = named.join(texts, "packet_id").select(
        F.col("packet_id").alias("condition_id"), "dimension", F.col("value_id").alias("value"), "context_text"
    )
    neutral = dimensions.sparkSession.sql(
        "SELECT 'neutral' AS condition_id, 'neutral' AS dimension, 'neutral' AS value, '' AS context_text"
    )
    return treated.unionByName(neutral)


# -- manifests -----------------------------------------------------------------------------


def single_manifest(items: DataFrame, conditions: Column, tasks: Column) -> DataFrame:
    """Pilot single-text trials: item x condition x task (arrays of (id, ...))."""
    rows = items.select("item_id", "text", F.explode(conditions).alias("c")).select("*", F.explode(tasks).alias("t"))
    return rows.select(
        F.concat_ws("__", F.lit("single"), "item_id", "c.id", "t.id").alias("trial_id"),
        F.lit("single").alias("type"),
        F.col("item_id").alias("story_id"),
        F.col("c.id").alias("condition_id"),
        F.col("t.id").alias("task_id"),
        pr.rating_prompt(F.col("text"), F.col("c.context"), F.col("t.instruction")).alias("prompt"),
    )


def comparison_manifest(
    pairs: DataFrame, items: DataFrame, conditions: Column, instruction: str, control: bool = False
) -> DataFrame:
    """Pilot comparisons over (story_a_id, story_b_id), or identical-text controls."""
    rows = with_texts(pairs, items, "story_a_id", "story_b_id").select("*", F.explode(conditions).alias("c"))
    kind = "comparison_control" if control else "comparison"
    ids = ["story_a_id"] if control else ["story_a_id", "story_b_id"]
    return rows.select(
        F.concat_ws("__", F.lit(kind), *ids, "c.id").alias("trial_id"),
        F.lit(kind).alias("type"),
        "story_a_id",
        "story_b_id",
        F.col("c.id").alias("condition_id"),
        pr.pilot_comparison_prompt(
            F.lit(instruction), F.col("text_1"), F.col("text_2"), F.col("c.a_context"), F.col("c.b_context")
        ).alias("prompt"),
    )


def context_single_manifest(items: DataFrame, conditions: DataFrame, instructions: Mapping[str, str]) -> DataFrame:
    """Item x context condition x regime.  ``conditions`` is a small design table."""
    regimes = literal_rows([{"regime": r, "instruction": t} for r, t in instructions.items()], ("regime", "instruction"))
    listed = conditions.agg(F.collect_list(F.struct(*conditions.columns)).alias("cs"))  # tens of rows
    rows = (
        items.select("item_id", "text")
        .crossJoin(F.broadcast(listed))  # one row
        .select("item_id", "text", F.explode("cs").alias("c"))
        .select("*", F.explode(regimes).alias("r"))
    )
    return rows.select(
        F.concat_ws("__", F.lit("context_single"), "item_id", "c.condition_id", "r.regime").alias("trial_id"),
        F.lit("context_single").alias("type"),
        F.col("item_id").alias("story_id"),
        F.col("c.dimension").alias("dimension"),
        F.col("c.value").alias("value"),
        F.col("c.condition_id").alias("condition_id"),
        F.col("c.context_text").alias("context_text"),
        F.col("r.regime").alias("evaluation_regime"),
        pr.rating_prompt(F.col("text"), F.col("c.context_text"), F.col("r.instruction")).alias("prompt"),
    )


CONTRAST_FIELDS = ("contrast_id", "dimension", "a", "b", "a_clause", "b_clause", "expected_direction")


def counterbalanced(pairs: DataFrame, contrasts: Column) -> DataFrame:
    """Cross a pair table with contrasts and the four cells.

    Forward gives value a to item 1; position says which item is displayed as A.  Adds
    displayed ids and texts and ``context_a``/``context_b`` (value, clause).
    """
    cells = F.array(*[F.struct(F.lit(a).alias("assignment"), F.lit(p).alias("position")) for a, p in CELLS])
    rows = pairs.select("*", F.explode(contrasts).alias("k")).select("*", F.explode(cells).alias("cell"))
    rows = rows.select("*", "cell.assignment", "cell.position").drop("cell")
    value_a = F.struct(F.col("k.a").alias("value"), F.col("k.a_clause").alias("clause"))
    value_b = F.struct(F.col("k.b").alias("value"), F.col("k.b_clause").alias("clause"))
    first_shown = F.col("position") == POSITIONS[0]
    forward = F.col("assignment") == "forward"
    # Item 1 carries a when forward; the displayed A carries a when it is item 1 and
    # forward, or item 2 and flipped.
    a_on_top = forward == first_shown
    return _displayed(rows, first_shown).withColumns(
        {
            "context_a": F.when(a_on_top, value_a).otherwise(value_b),
            "context_b": F.when(a_on_top, value_b).otherwise(value_a),
        }
    )


def _displayed(rows: DataFrame, first_shown: Column) -> DataFrame:
    shown = {
        "story_a_id": F.when(first_shown, F.col("story_1_id")).otherwise(F.col("story_2_id")),
        "story_b_id": F.when(first_shown, F.col("story_2_id")).otherwise(F.col("story_1_id")),
    }
    if "text_1" in rows.columns:
        shown["text_a"] = F.when(first_shown, F.col("text_1")).otherwise(F.col("text_2"))
        shown["text_b"] = F.when(first_shown, F.col("text_2")).otherwise(F.col("text_1"))
    return rows.withColumns(shown)


def _pair_id() -> Column:
    return F.concat_ws("_vs_", "story_1_id", "story_2_id")


_CELL_COLUMNS = (
    "trial_id", "block_id", "type", "choice_mode", "contrast_id", "dimension", "story_1_id", "story_2_id",
    "story_a_id", "story_b_id", "assignment", "position", "context_a", "context_b", "intro", "prompt",
)


def _finish(rows: DataFrame, extra: Sequence[str], hashed: bool) -> DataFrame:
    named = rows.withColumns(
        {
            "trial_id": F.concat_ws("__", "block_id", "assignment", "position"),
            "type": F.lit("context_pairwise"),
            "contrast_id": F.col("k.contrast_id"),
            "dimension": F.col("k.dimension"),
        }
    )
    columns = [*_CELL_COLUMNS, *extra]
    if hashed:
        named = named.withColumn("prompt_sha256", text_hash(F.col("prompt")))
        columns.append("prompt_sha256")
    return named.select(*columns)


def pairwise_manifest(
    pairs: DataFrame,
    contrasts: Column,
    regimes: Sequence[str] = REGIMES,
    choice_mode: str = "forced",
    rubric: str = "full",
) -> DataFrame:
    """Context benchmark: pairs (with texts) x contrasts x 4 cells x regimes."""
    rows = counterbalanced(pairs, contrasts)
    rows = rows.select("*", F.explode(F.array(*[F.lit(r) for r in regimes])).alias("evaluation_regime"))
    suffix = [] if rubric == "full" else [F.lit(rubric)]
    block = F.concat_ws(
        "__", F.lit("block"), "k.contrast_id", _pair_id(), "evaluation_regime", F.lit(choice_mode), *suffix
    )
    intro = pr.pairwise_intro(F.col("context_a.clause"), F.col("context_b.clause"))
    rows = rows.withColumns(
        {"block_id": block, "choice_mode": F.lit(choice_mode), "rubric": F.lit(rubric), "intro": intro}
    )
    prompt = pr.pairwise_prompt(
        F.col("intro"), F.col("text_a"), F.col("text_b"), F.col("evaluation_regime"), F.col("choice_mode")
    )
    return _finish(rows.withColumn("prompt", prompt), ("evaluation_regime", "rubric"), hashed=False)


def plain_manifest_v1(pairs: DataFrame, contrasts: Column, regimes: Sequence[str] = REGIMES) -> DataFrame:
    """Plain A/B treatment manifest of the first controllability design."""
    rows = counterbalanced(pairs, contrasts)
    rows = rows.select("*", F.explode(F.array(*[F.lit(r) for r in regimes])).alias("evaluation_regime"))
    block = F.concat_ws("__", F.lit("block"), "k.contrast_id", _pair_id(), "evaluation_regime", F.lit("forced"), F.lit("plain_ab"))
    rows = rows.withColumns(
        {
            "block_id": block,
            "choice_mode": F.lit("forced"),
            "response_format": F.lit("plain_ab"),
            "intro": pr.passage_intro(F.col("context_a.clause"), F.col("context_b.clause")),
        }
    )
    prompt = pr.passage_prompt(
        F.col("intro"), pr.instruction_v1(F.col("evaluation_regime")), F.col("text_a"), F.col("text_b"), pr.QUESTION_V1
    )
    return _finish(rows.withColumn("prompt", prompt), ("evaluation_regime", "response_format"), hashed=True)


def plain_manifest_v2(
    pairs: DataFrame,
    contrasts: Column,
    conditions: Sequence[str] = ("matched_control", "text_only"),
    keep: Sequence[str] = (),
) -> DataFrame:
    """Plain A/B treatment manifest with superblocks (pair x contrast) of both instructions.

    ``keep`` names columns of the pair table that every trial carries along.
    """
    rows = counterbalanced(pairs, contrasts)
    rows = rows.select("*", F.explode(F.array(*[F.lit(c) for c in conditions])).alias("instruction_condition"))
    rows = rows.withColumn("superblock_id", F.concat_ws("__", F.lit("superblock"), "k.contrast_id", _pair_id()))
    rows = rows.withColumns(
        {
            "block_id": F.concat_ws("__", "superblock_id", "instruction_condition"),
            "choice_mode": F.lit("forced"),
            "response_format": F.lit("plain_ab"),
            "expected_direction": F.col("k.expected_direction"),
            "intro": pr.passage_intro(F.col("context_a.clause"), F.col("context_b.clause")),
        }
    )
    prompt = pr.passage_prompt(
        F.col("intro"), pr.instruction_v2(F.col("instruction_condition")), F.col("text_a"), F.col("text_b"), pr.QUESTION_V2
    )
    extra = ("superblock_id", "instruction_condition", "response_format", "expected_direction", *keep)
    return _finish(rows.withColumn("prompt", prompt), extra, hashed=True)


def _baseline(pairs: DataFrame, prefix: str) -> DataFrame:
    rows = pairs.select("*", F.explode(F.array(*[F.lit(p) for p in POSITIONS])).alias("position"))
    rows = _displayed(rows, F.col("position") == POSITIONS[0])
    return rows.withColumns(
        {
            "block_id": F.concat_ws("__", F.lit(prefix), _pair_id()),
            "type": F.lit("context_pairwise"),
            "choice_mode": F.lit("forced"),
            "response_format": F.lit("plain_ab"),
            "intro": F.lit(pr.PASSAGE_OPENING),
        }
    ).withColumn("trial_id", F.concat_ws("__", "block_id", "position"))


_BASELINE_COLUMNS = (
    "trial_id", "block_id", "type", "choice_mode", "response_format", "story_1_id", "story_2_id", "story_a_id",
    "story_b_id", "position", "intro", "prompt",
)


def baseline_manifest_v1(pairs: DataFrame) -> DataFrame:
    """Blind baseline of the first controllability design (two positions)."""
    rows = _baseline(pairs, "baseline_block")
    prompt = pr.passage_prompt(F.col("intro"), F.lit(None).cast("string"), F.col("text_a"), F.col("text_b"), pr.QUESTION_V1)
    return rows.withColumn("prompt", prompt).select(
        *_BASELINE_COLUMNS,
        F.lit("naturalistic").alias("evaluation_regime"),
        F.lit("no_context_baseline").alias("contrast_id"),
        text_hash(F.col("prompt")).alias("prompt_sha256"),
    )


def baseline_manifest_v2(pairs: DataFrame, condition: str = "matched_control") -> DataFrame:
    """Blind baseline under one instruction; the text-only one is a separate condition."""
    prefix = "baseline_superblock" if condition == "matched_control" else f"baseline_{condition}_superblock"
    rows = _baseline(pairs, prefix).withColumn("instruction_condition", F.lit(condition))
    prompt = pr.passage_prompt(
        F.col("intro"), pr.instruction_v2(F.col("instruction_condition")), F.col("text_a"), F.col("text_b"), pr.QUESTION_V2
    )
    return rows.withColumn("prompt", prompt).select(
        *_BASELINE_COLUMNS, "instruction_condition", text_hash(F.col("prompt")).alias("prompt_sha256")
    )


def prompt_manifest(pairs: DataFrame, contrasts: Column, regimes: Sequence[str] = REGIMES) -> DataFrame:
    """Prompt-scope sentences present or absent: pairs x contrast x its two values.

    ``contrasts`` entries: (contrast_id, dimension, a, b, a_text, b_text).
    """
    values = F.array(
        F.struct(F.col("k.a").alias("value"), F.col("k.a_text").alias("text")),
        F.struct(F.col("k.b").alias("value"), F.col("k.b_text").alias("text")),
    )
    rows = pairs.select("*", F.explode(contrasts).alias("k")).select("*", F.explode(values).alias("v"))
    rows = rows.select("*", F.explode(F.array(*[F.lit(r) for r in regimes])).alias("evaluation_regime"))
    sentence = F.when(F.coalesce(F.col("v.text"), F.lit("")) != "", F.col("v.text"))
    intro = F.concat_ws(" ", F.lit(PROMPT_INTRO), sentence)
    prompt = pr.pairwise_prompt(intro, F.col("text_1"), F.col("text_2"), F.col("evaluation_regime"), F.lit("forced"))
    return rows.select(
        F.concat_ws("__", F.lit("context_prompt"), "k.contrast_id", _pair_id(), "v.value", "evaluation_regime").alias("trial_id"),
        F.lit("context_prompt").alias("type"),
        F.col("story_1_id").alias("story_a_id"),
        F.col("story_2_id").alias("story_b_id"),
        F.col("k.contrast_id").alias("contrast_id"),
        F.col("k.dimension").alias("dimension"),
        F.col("v.value").alias("value"),
        F.col("v.text").alias("prompt_context_text"),
        "evaluation_regime",
        F.lit("forced").alias("choice_mode"),
        prompt.alias("prompt"),
    )


# Fixed value: opening of the prompt-scope family.
PROMPT_INTRO = f"{pr.PAIRWISE_OPENING} {pr.PAIRWISE_CLOSING}"


def same_context_manifest(pairs: DataFrame, values: Column) -> DataFrame:
    """Round robin with one value for both items.

    ``values`` entries: (dimension, value, phrase) of dimensions that depend on no other.
    """
    rows = pairs.select("*", F.explode(values).alias("v"))
    intro = F.concat_ws(
        " ", F.lit(pr.PAIRWISE_OPENING), F.col("v.phrase"), F.lit(pr.SAME_FOR_BOTH), F.lit(pr.PAIRWISE_CLOSING)
    )
    prompt = pr.pairwise_prompt(intro, F.col("text_1"), F.col("text_2"), F.lit("naturalistic"), F.lit("forced"))
    return rows.select(
        F.concat_ws("__", F.lit("context_pairwise_same"), "v.dimension", "v.value", _pair_id()).alias("trial_id"),
        F.lit("context_pairwise_same").alias("type"),
        F.col("story_1_id").alias("story_a_id"),
        F.col("story_2_id").alias("story_b_id"),
        F.col("v.dimension").alias("dimension"),
        F.col("v.value").alias("value"),
        F.lit("naturalistic").alias("evaluation_regime"),
        F.lit("forced").alias("choice_mode"),
        prompt.alias("prompt"),
    )


# -- replicates and planned observations ---------------------------------------------------


def replicate_counts(treatment: int, neutral: int | None = None) -> tuple[int, int]:
    """Neutral defaults to the treatment count and may not be lower."""
    resolved = treatment if neutral is None else neutral
    if resolved < treatment:
        raise ValueError(f"neutral replicates ({resolved}) below treatment replicates ({treatment})")
    return treatment, resolved


def expand_replicates(trials: DataFrame, treatment: int, neutral: int | None = None) -> DataFrame:
    """One row per planned replicate; neutral single-text rows may get more."""
    treatment, neutral = replicate_counts(treatment, neutral)
    n = F.lit(treatment)
    if "condition_id" in trials.columns:
        is_neutral = (F.col("type") == "context_single") & (F.col("condition_id") == "neutral")
        n = F.when(F.coalesce(is_neutral, F.lit(False)), neutral).otherwise(treatment)
    return trials.select("*", F.explode(F.sequence(F.lit(1), n)).alias("replicate_number"))


def planned_observations(
    trials: DataFrame, replicates: int, experiment_id: str, evaluator_id: str, unit_kind: str
) -> DataFrame:
    """Planned observation ids of a manifest, independent of any execution order."""
    rows = trials.select("trial_id", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate_number"))
    oid = observation_id(F.lit(experiment_id), F.lit(evaluator_id), F.col("trial_id"), F.col("replicate_number"))
    return rows.select(oid.alias("observation_id"), "trial_id", "replicate_number", F.lit(unit_kind).alias("unit_kind"))


# -- corpus --------------------------------------------------------------------------------

_WORD = "[^" + "".join(f"\\x{{{ord(c):x}}}" for c in WHITESPACE_CHARS) + "]+"
#: Lines of a piece of the corpus listing.
LISTING_LINES = 10_000


def corpus_profile(items: DataFrame) -> DataFrame:
    """Content hash and whitespace word count of each stripped text."""
    text = strip(F.col("text"))
    return items.select(
        "item_id", text_hash(text).alias("sha256"), F.regexp_count(text, F.lit(_WORD)).cast("bigint").alias("word_count")
    )


def corpus_hash(profile: DataFrame) -> DataFrame:
    """Hash of the ordered ``id:sha256`` listing, the same at every size.

    The listing is sorted and joined to pieces in parallel; one open hash then runs over the pieces in
    order.  That pass is sequential by the nature of the hash, but holds one piece at a time.
    """
    line = F.concat_ws(":", "item_id", "sha256")
    ordered = profile.select("item_id", line.alias("line")).repartitionByRange("item_id").sortWithinPartitions("item_id")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for at, batch in enumerate(batches):
            lines = batch.column("line").to_pylist()
            for lo in range(0, len(lines), LISTING_LINES):
                some = lines[lo:lo + LISTING_LINES]
                yield pa.RecordBatch.from_pydict({"part": [part], "at": [at], "lo": [lo], "k": [len(some)], "text": ["\n".join(some)]})

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, n = hashlib.sha256(), 0
        for batch in batches:
            for k, text in zip(batch.column("k").to_pylist(), batch.column("text").to_pylist()):
                digest.update(("\n" if n else "").encode() + text.encode())
                n += k
        yield pa.RecordBatch.from_pydict({"n_items": [n], "corpus_hash": [digest.hexdigest()]})

    listed = ordered.mapInArrow(pieces, "part long, at long, lo long, k long, text string")
    in_order = listed.repartition(1).sortWithinPartitions("part", "at", "lo")
    return in_order.mapInArrow(hashed, "n_items long, corpus_hash string")


def prompt_size(profile: DataFrame, planned_calls: int) -> DataFrame:
    """Expected prompt size (two texts and about 60 fixed words, 1.3 tokens a word) and totals."""
    words = F.avg("word_count")
    prompt_words = 2 * words + 60
    return profile.agg(
        words.alias("avg_story_word_count"),
        prompt_words.alias("avg_prompt_word_count"),
        (prompt_words * 1.3).alias("avg_prompt_token_estimate"),
        (prompt_words * planned_calls).alias("total_word_estimate"),
        (prompt_words * 1.3 * planned_calls).alias("total_token_estimate"),
    )


def planned_calls(n_items: int, n_contrasts: int, conditions: int, treatment: int, baseline: int) -> int:
    """Calls of a complete design: pairs x contrasts x conditions x 4 cells, plus 2 blind positions."""
    pairs = n_items * (n_items - 1) // 2
    return pairs * n_contrasts * conditions * len(CELLS) * treatment + pairs * len(POSITIONS) * baseline
