"""Token usage, cost and evaluator inventories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.functions.common import null_safe_join
from pairlens.functions.scalars import is_peak, utc_clock


def _usage_columns() -> list[Column]:
    hit, miss = F.col("prompt_cache_hit_tokens"), F.col("prompt_cache_miss_tokens")
    reported = F.count(hit) + F.count(miss) > 0

    def total(column: Column) -> Column:
        return F.coalesce(F.sum(column), F.lit(0))

    return [
        F.count("*").alias("n_attempts"),
        total(F.col("input_tokens")).alias("prompt_tokens"),
        total(F.col("output_tokens")).alias("completion_tokens"),
        total(F.col("reasoning_tokens")).alias("reasoning_tokens"),
        F.when(reported, total(hit)).alias("cache_hit_prompt_tokens"),
        F.when(reported, total(miss)).alias("cache_miss_prompt_tokens"),
    ]


def flatten_attempts(results: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row per recorded attempt of nested result rows."""
    return results.select(*keep, F.explode("attempts").alias("__a")).select(*keep, "__a.*")


def usage_totals(attempts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Token sums over every attempt; cache sums stay NULL when never reported."""
    return attempts.groupBy(*by).agg(*_usage_columns())


def cost_summary(usage: DataFrame, rates: DataFrame, on: Sequence[str]) -> DataFrame:
    """Estimated cost per evaluator; unpriced evaluators get NULL, never a guess.

    ``rates`` holds USD per million tokens: cache_hit_input, cache_miss_input, output.
    Without a reported cache split every prompt token is priced as a miss.
    """
    priced = null_safe_join(usage, rates, on, "left")
    million = F.lit(1_000_000.0)
    split = F.col("cache_hit_prompt_tokens") * F.col("cache_hit_input") + F.col("cache_miss_prompt_tokens") * F.col(
        "cache_miss_input"
    )
    flat = F.col("prompt_tokens") * F.col("cache_miss_input")
    cost_in = F.when(F.col("cache_hit_prompt_tokens").isNotNull(), split).otherwise(flat) / million
    cost_out = F.col("completion_tokens") * F.col("output") / million
    return priced.withColumns(
        {
            "estimated_input_cost_usd": cost_in,
            "estimated_output_cost_usd": cost_out,
            "estimated_total_cost_usd": cost_in + cost_out,
            "cost_is_estimated": F.lit(True),
            "is_priced": F.col("output").isNotNull(),
        }
    ).drop("cache_hit_input", "cache_miss_input", "output")


def value_inventory(attempts: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    """Counts of a reported value (response model, fingerprint) over every attempt."""
    return attempts.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("n"))


def as_map(inventory: DataFrame, by: Sequence[str], column: str, out: str) -> DataFrame:
    """An inventory as one map per group (few distinct values by nature)."""
    entries = F.sort_array(F.collect_list(F.struct(F.col(column), F.col("n"))))
    return inventory.groupBy(*by).agg(F.map_from_entries(entries).alias(out))


def evaluator_inventory(
    usage: DataFrame, models: DataFrame, units: DataFrame, by: Sequence[str]
) -> DataFrame:
    """Usage, observed response models and complete-unit counts side by side."""
    joined = null_safe_join(usage, as_map(models, by, "response_model", "response_models"), by, "left")
    return null_safe_join(joined, units, by, "left")


def mixed_identity(rows: DataFrame, by: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Identity fields with more than one distinct value inside a group."""
    long = rows.select(
        *by, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("p")
    ).select(*by, "p.field", "p.value")
    seen = long.where("value IS NOT NULL").groupBy(*by, "field").agg(
        F.count_distinct("value").alias("n_values"), F.sort_array(F.collect_set("value")).alias("values")
    )
    return seen.where("n_values > 1")


def peak_usage(rows: DataFrame, by: Sequence[str], instant: str = "timestamp") -> DataFrame:
    """Usage per UTC hour, split into peak and off-peak."""
    hour = F.date_format(F.date_trunc("hour", utc_clock(F.col(instant))), "yyyy-MM-dd HH:mm")
    tagged = rows.withColumns({"hour_utc": hour, "is_peak": is_peak(F.col(instant))})
    return tagged.groupBy("hour_utc", "is_peak", *by).agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
    )
