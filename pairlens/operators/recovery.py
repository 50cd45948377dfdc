"""Classifying a finished wave, planning its recovery and merging the waves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.functions.answers import with_choice
from pairlens.functions.common import share
from pairlens.functions.scalars import token_bin, validation_id
from pairlens.operators.effects import PAIR, cell_rates, pair_effects
from pairlens.operators.ordering import indexed_by_text
from pairlens.session import hold

# Classes of a wave row and sources of a merged answer.
VALID, UNRESOLVED, DUPLICATE, UNKNOWN, MALFORMED = (
    "valid", "unresolved", "duplicate_valid", "unknown", "malformed",
)
FIRST_WAVE, RECOVERED = "wave1_original", "wave2_recovery"


def classify_rows(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """Add ``row_class`` to every result row of a wave.

    Needs observation_id, parsing_status, recorded_answer and last_response_text.  A
    row that claims to be resolved is malformed when its own text does not parse to
    the recorded answer; malformed rows do not take part in duplicate counting.
    """
    ids = planned.select("observation_id").distinct().withColumn("__planned", F.lit(True))
    resolved = F.coalesce(F.col("parsing_status") == "resolved", F.lit(False))
    reparses = F.coalesce(F.col("__parsed") == F.col("recorded_answer"), F.lit(False))

    def parsed(some: DataFrame) -> DataFrame:
        return with_choice(some, "last_response_text", "__parsed", "__parse_error").drop("__parse_error")

    # Texts are parsed once; only ids with several resolved rows are parsed again to count
    # the clean ones among them.
    several = rows.where(resolved).groupBy("observation_id").agg(F.count("*").alias("__k")).where("__k > 1")
    repeated = (
        parsed(rows.where(resolved).join(several, "observation_id", "left_semi"))
        .groupBy("observation_id")
        .agg(F.count_if(reparses).alias("__clean"))  # not a filter: that would parse below the join as well
        .where("__clean > 1")
    )
    tagged = parsed(rows).join(ids, "observation_id", "left")
    tagged = tagged.withColumn(
        "row_class",
        F.when(F.col("__planned").isNull(), UNKNOWN)
        .when(~resolved, UNRESOLVED)
        .when(~reparses, MALFORMED)
        .otherwise(VALID),
    ).drop("__planned", "__parsed")
    joined = tagged.join(repeated, "observation_id", "left")
    duplicate = (F.col("row_class") == VALID) & F.col("__clean").isNotNull()
    return joined.withColumn("row_class", F.when(duplicate, DUPLICATE).otherwise(F.col("row_class"))).drop("__clean")


def class_counts(classified: DataFrame) -> DataFrame:
    """Rows and distinct ids per class."""
    return classified.groupBy("row_class").agg(
        F.count("*").alias("n_rows"), F.count_distinct("observation_id").alias("n_ids")
    )


def valid_rows(classified: DataFrame) -> DataFrame:
    return classified.where(F.col("row_class") == VALID).drop("row_class")


def unresolved_plan(planned: DataFrame, classified: DataFrame) -> DataFrame:
    """Planned observations without one clean answer."""
    return planned.join(valid_rows(classified).select("observation_id"), "observation_id", "left_anti")


def recovery_plan(planned: DataFrame, classified: DataFrame) -> DataFrame:
    """Unresolved observations with their planned identity and a dense running index.

    A recovery can never create a replicate: every row comes from ``planned``.
    """
    return indexed_by_text(
        hold(unresolved_plan(planned, classified)), "observation_id", "execution_order_index", bounds_from=planned
    )


def merge_waves(
    planned: DataFrame, first_valid: DataFrame, recovery: DataFrame, carry: Sequence[str], arrival: Sequence[str]
) -> DataFrame:
    """First-wave answer where valid, else the earliest valid recovery answer, else absent.

    Unplanned ids and recovery answers to settled observations are ignored; the
    number of further recovery answers is reported per row.
    """
    earliest = F.min_by(F.struct(*carry), F.struct(*[F.col(c) for c in arrival]))
    settled = (
        recovery.where("parsing_status = 'resolved'")
        .groupBy("observation_id")
        .agg(earliest.alias("__r"), (F.count("*") - 1).alias("extra_recovery_answers"))
    )
    original = first_valid.select("observation_id", F.struct(*carry).alias("__v"))
    joined = planned.join(original, "observation_id", "left").join(settled, "observation_id", "left")
    first = F.col("__v").isNotNull()
    answer = F.coalesce("__v", "__r")
    return joined.where(answer.isNotNull()).select(
        *planned.columns,
        *[answer[c].alias(c) for c in carry],
        F.when(first, FIRST_WAVE).otherwise(RECOVERED).alias("result_source"),
        F.when(first, F.lit(0).cast("bigint")).otherwise(F.col("extra_recovery_answers")).alias("extra_recovery_answers"),
    )


def merge_diagnostics(planned: DataFrame, recovery: DataFrame, merged: DataFrame) -> DataFrame:
    """One row of counts; both sides are reduced to one row before they meet."""
    plan = planned.agg(F.count_distinct("observation_id").alias("planned_total"))
    tried = recovery.agg(F.count("*").alias("recovery_attempted"))
    kept = merged.agg(
        F.count_if(F.col("result_source") == FIRST_WAVE).alias("first_wave_retained"),
        F.count_if(F.col("result_source") == RECOVERED).alias("recovered"),
        F.count_if(F.col("extra_recovery_answers") > 0).alias("ids_answered_again"),
        F.count("*").alias("__merged"),
    )
    row = plan.crossJoin(tried).crossJoin(kept)  # one row each
    missing = F.col("planned_total") - F.col("__merged")
    return row.withColumns(
        {
            "unresolved_after_first_wave": F.col("planned_total") - F.col("first_wave_retained"),
            "still_unresolved": missing,
            "final_completeness": F.col("__merged").cast("double")
            / F.nullif(F.col("planned_total").cast("double"), F.lit(0.0)),
        }
    ).drop("__merged")


def validation_plan(sample: DataFrame) -> DataFrame:
    """Repeat judgements of a sample under ids that no plan can contain."""
    renamed = sample.withColumnRenamed("observation_id", "original_observation_id")
    with_ids = renamed.withColumn("validation_observation_id", validation_id(F.col("original_observation_id")))
    return indexed_by_text(with_ids, "original_observation_id", "execution_order_index")


def validation_rows(originals: DataFrame, reruns: DataFrame, shared: Sequence[str] = ()) -> DataFrame:
    """Original answers beside their repeat judgement."""
    side = reruns.select("observation_id", F.col("answer").alias("validation_answer"))
    return (
        originals.select(
            "observation_id", *shared, F.col("answer").alias("original_answer"),
            F.col("reasoning_tokens").alias("original_reasoning_tokens"),
        )
        .join(side, "observation_id")
        .withColumn("agrees_with_original", F.col("original_answer") == F.col("validation_answer"))
    )


def validation_agreement(rows: DataFrame) -> DataFrame:
    """Agreement, A rates and preference shift: overall (NULL bin) and by token bin."""
    answered = rows.where("agrees_with_original IS NOT NULL").withColumn(
        "token_bin", token_bin(F.col("original_reasoning_tokens"))
    )
    original_a, repeat_a = share(F.col("original_answer") == "A"), share(F.col("validation_answer") == "A")
    return answered.rollup("token_bin").agg(
        F.count("*").alias("n_validation_pairs"),
        share(F.col("agrees_with_original")).alias("agreement_rate"),
        original_a.alias("original_a_rate"),
        repeat_a.alias("validation_a_rate"),
        (repeat_a - original_a).alias("preference_shift"),
    )


def validation_effects(rows: DataFrame, group: Sequence[str]) -> DataFrame:
    """D_pair from the original answers against D_pair from the repeats, where calculable."""
    keys = [*group, *PAIR]

    def effects(answer: str, name: str) -> DataFrame:
        rated = cell_rates(rows.withColumn("choice", F.col(answer)), group)
        return pair_effects(rated, group).select(*keys, F.col("d_pair").alias(name))

    both = effects("original_answer", "d_pair_original").join(effects("validation_answer", "d_pair_validation"), keys)
    return both.withColumn("d_pair_difference", F.col("d_pair_validation") - F.col("d_pair_original"))
