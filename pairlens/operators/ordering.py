"""Running totals, row numbers and dense indexes without a hot task.

A plain window sorts a whole key inside one task; with one key holding a third of
the rows that task is the job.  Here every key is first cut into buckets that
follow the order, bucket totals give each bucket its offset, and the remaining
window runs inside (key, bucket).  Results are exact whatever the buckets are;
the buckets only decide how evenly the work spreads.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlens.functions.common import null_safe_join, order_hash
from pairlens.session import hold

BUCKET = "__bucket"
#: Rows that one task sorts or groups at a time where the number of tasks follows the input.
TASK_ROWS = 500_000


def dealt(df: DataFrame, rows: int, keys: Sequence[str]) -> DataFrame:
    """Hash-partition by ``keys`` into at least the shuffle partitions, and more for many rows.

    ``rows`` is the (roughly) known number of rows, for instance that of the table they come from.
    With a fixed number of partitions the rows and the memory of one task grow with the input.
    """
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return df.repartition(max(usual, -(-rows // TASK_ROWS)), *keys)


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    bucket: Column,
    amount: Column,
    out: str,
    keys_not_null: bool = False,
    rows: int | None = None,
) -> DataFrame:
    """Add ``out`` = sum of ``amount`` over the rows strictly before this one, per key.

    ``bucket`` must not decrease along ``order`` and not be NULL.  ``order`` must be total
    for the result to be deterministic.  With ``keys_not_null`` the offsets meet the rows
    on plain equality, so that join and window share one shuffle; a NULL key is then an
    error, never a lost row.  With ``rows``, about as many rows as there are, the number of
    tasks of the window follows them (see :func:`dealt`).
    """
    keys = list(keys)
    tagged = df.withColumn(BUCKET, bucket).withColumn("__amount", amount)
    totals = tagged.groupBy(*keys, BUCKET).agg(F.sum("__amount").alias("__total"))
    # One row per (key, bucket): small even where the key itself is hot.
    across = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, BUCKET, F.coalesce(F.sum("__total").over(across), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy(*keys, BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    if rows is not None:
        tagged = dealt(tagged, rows, [*keys, BUCKET])
    if keys_not_null or not keys:
        joined = tagged.join(offsets, [*keys, BUCKET], "left")
        unmatched = F.raise_error(F.lit("NULL key in a running total over keys declared not null")).cast("bigint")
        joined = joined.withColumn("__offset", F.coalesce("__offset", unmatched))
    else:
        joined = null_safe_join(tagged, offsets, [*keys, BUCKET])
    total = F.col("__offset") + F.coalesce(F.sum("__amount").over(inside), F.lit(0))
    return joined.withColumn(out, total).drop(BUCKET, "__amount", "__offset")


def numbered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    bucket: Column,
    out: str = "row_number",
    keys_not_null: bool = False,
    rows: int | None = None,
) -> DataFrame:
    """Exact ``row_number`` per key along ``order`` (1-based)."""
    with_total = running_total(df, keys, order, bucket, F.lit(1).cast("bigint"), out, keys_not_null, rows)
    return with_total.withColumn(out, F.col(out) + 1)


def bucket_count(df: DataFrame) -> int:
    """As many buckets as shuffle partitions, so that the last window can use them all."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return min(4096, max(64, partitions))


def _cuts_below(cuts: Column, coarse: Column, step: int, value: Column, inclusive: bool) -> Column:
    """How many sorted cut points lie below ``value``; two short scans instead of a long one.

    ``coarse`` holds every ``step``-th cut point.
    """

    def below(some: Column) -> Column:
        return F.size(F.filter(some, lambda c: (c <= value) if inclusive else (c < value)))

    start = below(coarse) * step
    return start + below(F.slice(cuts, start + 1, step))


def value_buckets(df: DataFrame, keys: Sequence[str], value: str, n_buckets: int | None = None) -> DataFrame:
    """Add a bucket column that follows a numeric ``value`` inside each key.

    The cut points are approximate percentiles: a sketch of at most ``n_buckets``
    numbers per key, merged map-side.
    """
    keys = list(keys)
    n = n_buckets or bucket_count(df)
    step = max(2, math.isqrt(n))
    cuts = F.percentile_approx(F.col(value), [i / n for i in range(1, n)], 10 * n)
    bounds = df.groupBy(*keys).agg(F.array_distinct(cuts).alias("__cuts"))
    bounds = bounds.withColumn("__coarse", F.filter("__cuts", lambda _, i: i % step == step - 1))
    joined = null_safe_join(df, bounds, keys) if keys else df.crossJoin(F.broadcast(bounds))
    position = _cuts_below(F.col("__cuts"), F.col("__coarse"), step, F.col(value), inclusive=False)
    return joined.withColumn(BUCKET, F.coalesce(position, F.lit(0))).drop("__cuts", "__coarse")


def value_running_total(
    df: DataFrame, keys: Sequence[str], value: str, amount: Column, out: str, descending: bool = False
) -> DataFrame:
    """:func:`running_total` along a numeric column, distinct inside each key.

    The input is held: cut points, bucket totals and rows each read it once.
    """
    signed = -F.col(value) if descending else F.col(value)
    held = hold(df.withColumn("__signed", signed.cast("double")))
    bucketed = value_buckets(held, keys, "__signed").withColumnRenamed(BUCKET, "__vb")
    result = running_total(bucketed, keys, ["__signed"], F.col("__vb"), amount, out)
    return result.drop("__signed", "__vb")


def text_bounds(df: DataFrame, column: str, n_buckets: int | None = None) -> list[str]:
    """Cut points for a text column: quantiles of a bounded hash sample.

    At most 16 values per bucket reach the driver, however large the table is.
    """
    n_buckets = n_buckets or bucket_count(df)
    sampled = (
        df.select(F.col(column).alias("v"))
        .where("v is not null")
        .orderBy(order_hash("bounds", F.col("v")))
        .limit(16 * n_buckets)
        .collect()
    )
    values = sorted({row["v"].encode("utf-8") for row in sampled})
    step = max(1, len(values) // n_buckets)
    return [v.decode("utf-8") for v in values[step::step]]


def text_bucket(column: Column, bounds: Sequence[str]) -> Column:
    """Number of cut points not above the text."""
    if not bounds:
        return F.lit(0)
    step = max(2, math.isqrt(len(bounds)))
    cuts = F.array(*[F.lit(b) for b in bounds])
    every = [F.lit(b) for b in bounds[step - 1 :: step]]
    coarse = F.array(*every) if every else F.array().cast("array<string>")
    return _cuts_below(cuts, coarse, step, column, inclusive=True)


def indexed_by_text(df: DataFrame, column: str, out: str, bounds_from: DataFrame | None = None) -> DataFrame:
    """Dense 1-based index along a unique text column, over the whole table.

    ``bounds_from`` may name a cheaper table with similar values for the cut points;
    they only decide how evenly the work spreads.
    """
    bounds = text_bounds(df if bounds_from is None else bounds_from, column)
    return numbered(df, [], [column], text_bucket(F.col(column), bounds), out)


def indexed_by_hash(df: DataFrame, hash_column: str, then: Sequence[str | Column], out: str) -> DataFrame:
    """Dense 1-based index along a hexadecimal hash column (ties by ``then``).

    Hashes are uniform, so their leading digits are balanced buckets as they are.
    """
    bucket = F.substring(F.col(hash_column), 1, 3)
    return numbered(df, [], [hash_column, *then], bucket, out)


#: Rank error of the sketches that bracket a quantile, as a share of the group, and the size up to which a group is its own bracket.
SKETCH_ERROR, SMALL_GROUP = 1e-4, 40_000


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, wanted: Mapping[str, float]) -> DataFrame:
    """Exact quantiles of a numeric column per key, interpolated linearly between neighbours; NULLs do not count.

    A mergeable sketch gives each quantile a bracket that holds its order statistics for certain: twice the
    sketch's rank error on both sides.  A second pass counts the rows below each bracket and numbers the few
    inside it, so neither all values of a group nor all distinct ones are ever a task's state.
    """
    keys, names = list(keys), list(wanted)
    rows = df.select(*keys, F.col(value).cast("double").alias("__v")).where("__v IS NOT NULL")
    margin = 2 * SKETCH_ERROR
    ends = [e for p in wanted.values() for e in (max(0.0, p - margin), min(1.0, p + margin))]
    sketch = rows.groupBy(*keys).agg(
        F.count("*").alias("__n"), F.min("__v").alias("__least"), F.max("__v").alias("__most"),
        F.percentile_approx("__v", ends, round(1 / SKETCH_ERROR)).alias("__ends"),
    )
    small = F.col("__n") <= SMALL_GROUP

    def bracket(k: int) -> Column:
        at = F.lit(wanted[names[k]]) * (F.col("__n") - 1)
        low = F.when(small, F.col("__least")).otherwise(F.col("__ends")[2 * k])
        high = F.when(small, F.col("__most")).otherwise(F.col("__ends")[2 * k + 1])
        return F.struct(F.lit(k).alias("k"), at.alias("at"), low.alias("low"), high.alias("high"))

    bounds = sketch.select(*keys, F.array(*map(bracket, range(len(names)))).alias("__b"))
    met = null_safe_join(rows, bounds, keys) if keys else rows.crossJoin(F.broadcast(bounds))  # one row
    below = F.explode(F.transform("__b", lambda b: F.struct(b["k"].alias("k"), b["at"].alias("at"), (F.col("__v") < b["low"]).alias("under"), F.col("__v").between(b["low"], b["high"]).alias("inside"))))
    each = met.select(*keys, "__v", below.alias("b"))
    # equal values are one row, so a value that half of a group has is no load either
    inside = each.where("b.inside").groupBy(*keys, F.col("b.k").alias("__k"), F.col("b.at").alias("__at"), "__v").agg(F.count("*").alias("__c"))
    under = each.groupBy(*keys, F.col("b.k").alias("__k")).agg(F.sum(F.col("b.under").cast("long")).alias("__under"))
    upto = Window.partitionBy(*keys, "__k").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = null_safe_join(inside.withColumn("__upto", F.sum("__c").over(upto)), under, [*keys, "__k"])
    last = F.col("__upto") + F.col("__under")  # ranks of a value: from last - count to last - 1
    holds = lambda rank: (rank < last) & (rank >= last - F.col("__c"))
    low, high = F.floor("__at"), F.ceil("__at")
    pair = ranked.where(holds(low) | holds(high)).groupBy(*keys, "__k", "__at").agg(F.max(F.when(holds(low), F.col("__v"))).alias("__low"), F.max(F.when(holds(high), F.col("__v"))).alias("__high"))
    cut = pair.select(*keys, "__k", (F.col("__low") + (F.col("__high") - F.col("__low")) * (F.col("__at") - low)).alias("__q"))
    return cut.groupBy(*keys).agg(*[F.max(F.when(F.col("__k") == k, F.col("__q"))).alias(name) for k, name in enumerate(names)])
