"""Quality gates: each returns the violations; an empty result passes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.functions.common import null_safe_join, share
from pairlens.functions.scalars import first_item_chosen
from pairlens.functions.stats import pearson
from pairlens.operators.effects import ASSIGNMENTS, CELLS, PAIR, POSITIONS


class GateError(ValueError):
    """A gate found violations."""


def require_empty(violations: DataFrame, message: str, shown: int = 5) -> None:
    """Raise with a few examples when a gate has violations."""
    examples = violations.limit(shown).collect()
    if examples:
        raise GateError(f"{message}: {[row.asDict() for row in examples]}")


def duplicate_ids(rows: DataFrame, column: str) -> DataFrame:
    """Ids that occur more than once."""
    return rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).where("n > 1")


def shared_ids(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """Ids present in both spaces (must be none)."""
    return left.select(column).intersect(right.select(column))


def _violations(rows: DataFrame, key: str, checks: Mapping[str, Column]) -> DataFrame:
    """One (key, violation) row per failed check; a NULL verdict is a failure."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in checks.items()]))
    return rows.select(F.col(key), F.explode(failed).alias("violation"))


# -- design gates --------------------------------------------------------------------------


def contrast_violations(
    contrasts: DataFrame,
    dimensions: DataFrame | None = None,
    required_ids: Sequence[str] | None = None,
    one_per_dimension: bool = False,
    all_pairs_of: Sequence[str] | None = None,
) -> DataFrame:
    """Ill-formed contrasts.

    ``dimensions`` has (dimension, value_id, depends_on): values must be registered
    and the dimension must not depend on another one.  ``all_pairs_of`` demands every
    unordered pair of those labels exactly once.
    """
    named = [c for c in ("dimension", "a", "b", "a_clause", "b_clause") if c in contrasts.columns]
    checks = {f"missing_{c}": F.col(c).isNotNull() for c in named}
    checks["same_values"] = F.col("a") != F.col("b")
    if "expected_direction" in contrasts.columns:
        checks["bad_direction"] = F.col("expected_direction").isin("a", "b")
    if all_pairs_of is not None:
        checks["foreign_label"] = F.col("a").isin(*all_pairs_of) & F.col("b").isin(*all_pairs_of)
    found = [_violations(contrasts, "contrast_id", checks)]
    found.append(duplicate_ids(contrasts, "contrast_id").select("contrast_id", F.lit("duplicate_id").alias("violation")))
    if dimensions is not None:
        used = contrasts.select("contrast_id", "dimension", F.explode(F.array("a", "b")).alias("value_id"))
        unregistered = used.join(dimensions, ["dimension", "value_id"], "left_anti")
        found.append(unregistered.select("contrast_id", F.lit("unregistered_value").alias("violation")))
        dependent = dimensions.where("depends_on IS NOT NULL").select("dimension").distinct()
        found.append(
            contrasts.join(dependent, "dimension", "left_semi").select(
                "contrast_id", F.lit("dependent_dimension").alias("violation")
            )
        )
    if one_per_dimension:
        reused = contrasts.groupBy("dimension").agg(F.count("*").alias("n")).where("n > 1")
        found.append(
            contrasts.join(reused, "dimension", "left_semi").select("contrast_id", F.lit("reused_dimension").alias("violation"))
        )
    if required_ids is not None:
        found.append(
            contrasts.where(~F.col("contrast_id").isin(*required_ids)).select(
                "contrast_id", F.lit("unexpected_id").alias("violation")
            )
        )
        wanted = contrasts.sparkSession.createDataFrame([(i,) for i in required_ids], "contrast_id string")
        found.append(
            wanted.join(contrasts, "contrast_id", "left_anti").select("contrast_id", F.lit("absent_id").alias("violation"))
        )
    if all_pairs_of is not None:
        pairs = [(min(x, y), max(x, y)) for i, x in enumerate(all_pairs_of) for y in all_pairs_of[i + 1 :]]
        wanted = contrasts.sparkSession.createDataFrame(pairs, "low string, high string")
        have = contrasts.groupBy(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).agg(
            F.count("*").alias("n")
        )
        wrong = wanted.join(have, ["low", "high"], "left").where("n IS NULL OR n <> 1")
        found.append(wrong.select(F.concat_ws("|", "low", "high").alias("contrast_id"), F.lit("pair_not_once").alias("violation")))
    return reduce(DataFrame.unionByName, found)


def _cells_column(columns: Sequence[str]) -> Column:
    return F.array_sort(F.collect_set(F.concat_ws("/", *columns)))


def block_violations(trials: DataFrame, baseline: bool = False) -> DataFrame:
    """Blocks that do not hold exactly their cells (4, or 2 positions for a baseline)."""
    wanted = sorted(POSITIONS) if baseline else sorted("/".join(c) for c in CELLS)
    columns = ["position"] if baseline else ["assignment", "position"]
    # collect_set sees at most the handful of distinct cell labels, whatever the block size.
    grouped = trials.groupBy("block_id").agg(F.count("*").alias("n_cells"), _cells_column(columns).alias("cells"))
    exact = (F.col("n_cells") == len(wanted)) & (F.col("cells") == F.array(*[F.lit(c) for c in wanted]))
    return grouped.where(~exact).withColumn("cells", F.array_join("cells", ","))


def trial_violations(
    trials: DataFrame,
    trial_type: str = "context_pairwise",
    response_format: str | None = None,
    instruction_conditions: Sequence[str] | None = None,
    contrast_ids: Sequence[str] | None = None,
    baseline: bool = False,
) -> DataFrame:
    """Trials with a wrong kind, mode, format or condition, or whose hash is not their prompt's."""
    checks: dict[str, Column] = {
        "wrong_type": F.col("type") == trial_type,
        "not_forced": F.col("choice_mode") == "forced",
    }
    if response_format is not None:
        checks["wrong_format"] = F.col("response_format") == response_format
    if instruction_conditions is not None:
        checks["unexpected_condition"] = F.col("instruction_condition").isin(*instruction_conditions)
    if contrast_ids is not None:
        checks["unexpected_contrast"] = F.col("contrast_id").isin(*contrast_ids)
    if "prompt" in trials.columns and "prompt_sha256" in trials.columns:
        checks["hash_mismatch"] = F.col("prompt_sha256") == F.sha2(F.col("prompt").cast("binary"), 256)
    if baseline and "assignment" in trials.columns:
        checks["assigned_baseline"] = F.col("assignment").isNull()
    if not baseline:
        checks["unknown_assignment"] = F.col("assignment").isin(*ASSIGNMENTS)
    repeated = duplicate_ids(trials, "trial_id").select("trial_id", F.lit("duplicate_id").alias("violation"))
    return _violations(trials, "trial_id", checks).unionByName(repeated)


def superblock_violations(trials: DataFrame, conditions: Sequence[str]) -> DataFrame:
    """Superblocks without four cells under each condition."""
    counts = [F.count_if(F.col("instruction_condition") == c).alias(f"n_{c}") for c in conditions]
    grouped = trials.groupBy("superblock_id").agg(F.count("*").alias("n_cells"), *counts)
    exact = F.col("n_cells") == 4 * len(conditions)
    for c in conditions:
        exact = exact & (F.col(f"n_{c}") == 4)
    return grouped.where(~exact)


def packet_violations(packets: DataFrame, dimensions: DataFrame, applies: DataFrame) -> DataFrame:
    """Packet entries (packet_id, dimension, value_id) that cannot be rendered.

    ``dimensions``: (dimension, value_id, scope, depends_on); ``applies``:
    (dimension, parent_value) for dependent dimensions.
    """
    known = dimensions.select("dimension").distinct()
    unknown_dimension = packets.join(known, "dimension", "left_anti").select(
        "packet_id", F.lit("unknown_dimension").alias("violation")
    )
    wrong_scope = packets.join(
        dimensions.where("scope <> 'story'").select("dimension").distinct(), "dimension", "left_semi"
    ).select("packet_id", F.lit("not_story_scope").alias("violation"))
    unknown_value = (
        packets.join(known, "dimension", "left_semi")
        .join(dimensions, ["dimension", "value_id"], "left_anti")
        .select("packet_id", F.lit("unknown_value").alias("violation"))
    )
    parents = dimensions.where("depends_on IS NOT NULL").select("dimension", "depends_on").distinct()
    dependent = packets.join(parents, "dimension").select("packet_id", "dimension", "depends_on")
    carriers = packets.select("packet_id", F.col("dimension").alias("depends_on"), F.col("value_id").alias("parent_value"))
    with_parent = dependent.join(carriers, ["packet_id", "depends_on"], "left")
    missing_parent = with_parent.where("parent_value IS NULL").select("packet_id", F.lit("missing_parent").alias("violation"))
    bad_parent = (
        with_parent.where("parent_value IS NOT NULL")
        .join(applies, ["dimension", "parent_value"], "left_anti")
        .select("packet_id", F.lit("parent_not_applicable").alias("violation"))
    )
    return reduce(
        DataFrame.unionByName, [unknown_dimension, wrong_scope, unknown_value, missing_parent, bad_parent]
    )


# -- completeness --------------------------------------------------------------------------


def unit_status(
    rows: DataFrame, unit: Sequence[str], cell: Sequence[str], expected: int, resolved: Column
) -> DataFrame:
    """Cells present, failed and complete per unit, with the reason when incomplete.

    A unit is complete with exactly the expected number of rows, all of them distinct
    cells and resolved.  A failed cell makes the gap terminal; a merely missing one is
    temporary.  Works on a stream too, where the distinct cells of a unit are its state.
    """
    cells = F.struct(*cell)
    distinct = F.size(F.collect_set(cells)).cast("bigint") if rows.isStreaming else F.count_distinct(cells)
    status = rows.groupBy(*unit).agg(
        F.count("*").alias("n_cells_present"),
        distinct.alias("n_distinct_cells"),
        F.count_if(~F.coalesce(resolved, F.lit(False))).alias("n_terminally_failed"),
    )
    complete = (
        (F.col("n_cells_present") == expected)
        & (F.col("n_distinct_cells") == expected)
        & (F.col("n_terminally_failed") == 0)
    )
    return status.withColumns(
        {
            "n_cells_expected": F.lit(expected).cast("bigint"),
            "complete": complete,
            "reason": F.when(complete, F.lit(None).cast("string"))
            .when(F.col("n_terminally_failed") > 0, "terminally_incomplete")
            .otherwise("temporarily_incomplete"),
        }
    )


def complete_rows(rows: DataFrame, status: DataFrame, unit: Sequence[str], keys_not_null: bool = False) -> DataFrame:
    """Rows of the complete units.

    With ``keys_not_null`` both sides meet on plain equality, so that rows dealt by the unit stay where they are.
    """
    complete = status.where("complete").select(*unit)
    return rows.join(complete, list(unit), "left_semi") if keys_not_null else null_safe_join(rows, complete, unit, "left_semi")


def unit_counts(status: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return status.groupBy(*by).agg(
        F.count_if("complete").alias("n_complete"), F.count_if(~F.col("complete")).alias("n_incomplete")
    )


def resolved_cells(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Number of resolved rows per design cell; baseline rows have NULL contrast."""
    return rows.groupBy(*by).agg(F.count("*").alias("n_resolved_cells"))


def compliance(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """First-attempt outcomes per group; rows carry ``first_attempt_status``."""
    status = F.col("first_attempt_status")
    return rows.groupBy(*by).agg(
        F.count("*").alias("n_attempted"),
        *[F.count_if(status == s).alias(f"n_{s}") for s in ("valid", "invalid", "refusal", "api_error")],
        share(status == "valid").alias("valid_rate"),
    )


# -- evaluators ----------------------------------------------------------------------------


def match_evaluators(rows: DataFrame, configured: DataFrame, on: Sequence[str]) -> DataFrame:
    """Attach the configured evaluator; ``evaluator_id`` is NULL where none matches."""
    return null_safe_join(rows, configured, on, "left")


def split_versions(rows: DataFrame, evaluator: str = "evaluator_id", version: str = "response_model") -> DataFrame:
    """Split an evaluator that answered under several model versions.

    Adds ``partition_id``: the id itself, or ``id#version`` (``id#unresolved`` without
    a version) when more than one version was seen.  Rows without an evaluator are
    left out; completeness is judged after the split.
    """
    matched = rows.where(F.col(evaluator).isNotNull())
    seen = matched.groupBy(evaluator).agg(F.count_distinct(version).alias("__versions"))
    joined = matched.join(seen, evaluator)
    split = F.concat_ws("#", F.col(evaluator), F.coalesce(version, F.lit("unresolved")))
    return joined.withColumn("partition_id", F.when(F.col("__versions") > 1, split).otherwise(F.col(evaluator))).drop(
        "__versions"
    )


def mixed_versions(rows: DataFrame, evaluator: str = "evaluator_id", version: str = "response_model") -> DataFrame:
    """Evaluators with several versions (violations in strict mode)."""
    return (
        rows.where(F.col(evaluator).isNotNull())
        .groupBy(evaluator)
        .agg(F.count_distinct(version).alias("n_versions"))
        .where("n_versions > 1")
    )


def isolate(rows: DataFrame, keep: Column) -> tuple[DataFrame, DataFrame]:
    """Rows of one experiment or regime, and a one-row count of the excluded ones."""
    wanted = F.coalesce(keep, F.lit(False))
    return rows.where(wanted), rows.agg(F.count_if(wanted).alias("n_kept"), F.count_if(~wanted).alias("n_excluded"))


def setting_mismatches(rows: DataFrame, frozen: Mapping[str, object]) -> DataFrame:
    """Recorded settings that disagree with the frozen ones, with row counts."""
    entries = F.array(
        *[
            F.struct(
                F.lit(name).alias("setting"),
                F.col(name).cast("string").alias("found"),
                F.lit(str(value)).alias("required"),
            )
            for name, value in frozen.items()
        ]
    )
    long = rows.select(F.explode(entries).alias("e")).select("e.*")
    wrong = long.where(F.col("found").isNotNull() & (F.col("found") != F.col("required")))
    return wrong.groupBy("setting", "found", "required").agg(F.count("*").alias("n"))


# -- fingerprints --------------------------------------------------------------------------

_WORDS = 4


def fingerprint(rows: DataFrame, name: str) -> DataFrame:
    """Order-insensitive content hash of a table.

    Every row is hashed over its sorted columns; the words of the row hashes are
    summed exactly (DECIMAL), so duplicates count and partitioning does not matter.
    """
    row_hash = F.sha2(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}), 256)
    words = [
        F.conv(F.substring(F.col("__h"), 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)").alias(f"__w{i}")
        for i in range(_WORDS)
    ]
    sums = [F.coalesce(F.sum(f"__w{i}"), F.lit(0)).cast("string") for i in range(_WORDS)]
    hashed = rows.select(row_hash.alias("__h")).select(*words)
    return hashed.agg(F.count("*").alias("n_rows"), F.sha2(F.concat_ws(":", *sums), 256).alias("content_sha256")).select(
        F.lit(name).alias("table_name"), "n_rows", "content_sha256"
    )


def fingerprints(tables: Mapping[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [fingerprint(df, name) for name, df in tables.items()])


def drift(current: DataFrame, locked: DataFrame) -> DataFrame:
    """Tables whose fingerprint differs from the lock, or that only one side has."""
    lock = locked.select("table_name", F.col("content_sha256").alias("__l"), F.col("n_rows").alias("__n"))
    joined = current.join(lock, "table_name", "full")
    same = F.coalesce((F.col("content_sha256") == F.col("__l")) & (F.col("n_rows") == F.col("__n")), F.lit(False))
    return joined.where(~same).select("table_name", "n_rows", F.col("__n").alias("locked_rows"))


# -- reports -------------------------------------------------------------------------------


def check_report(checks: Mapping[str, DataFrame]) -> DataFrame:
    """One row per check: its number of violations and whether it passed."""
    rows = [
        violations.agg(F.count("*").alias("n_violations")).select(F.lit(name).alias("check_name"), "n_violations")
        for name, violations in checks.items()
    ]
    return reduce(DataFrame.unionByName, rows).withColumn("ok", F.col("n_violations") == 0)


def count_mismatch(rows: DataFrame, expected: int, column: str = "*") -> DataFrame:
    """A violation row when the (distinct) count is not the expected one."""
    counted = F.count("*") if column == "*" else F.count_distinct(column)
    return rows.agg(counted.alias("found")).where(F.col("found") != expected)


# -- reliability ---------------------------------------------------------------------------


def split_half_reliability(rows: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Correlation over pairs of item 1's win rate in odd and even replicates."""
    chosen = first_item_chosen(F.col("choice"), F.col("story_a_id"), F.col("story_b_id"), F.col("story_1_id"))
    odd = F.pmod(F.col("replicate_number"), F.lit(2)) == 1
    halves = rows.groupBy(*group, *PAIR).agg(
        share(F.when(odd, chosen)).alias("__odd"), share(F.when(~odd, chosen)).alias("__even")
    )
    both = halves.where("__odd IS NOT NULL AND __even IS NOT NULL")
    return both.groupBy(*group).agg(
        F.when(F.count("*") >= 2, pearson(F.col("__odd"), F.col("__even"))).alias("r_split_half"),
        F.count("*").alias("n_pairs"),
    )
