"""Selecting, ordering, sampling and packing units of work."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlens.functions.common import null_safe_join, order_hash
from pairlens.operators.ordering import indexed_by_hash, numbered, running_total
from pairlens.session import ensure_checkpoint_dir


def select_rows(
    rows: DataFrame,
    only_type: str | None = None,
    id_prefix: str | None = None,
    conditions: Sequence[str] | None = None,
    contrasts: Sequence[str] | None = None,
    regimes: Sequence[str] | None = None,
) -> DataFrame:
    """Filter a manifest; filters that are not given do nothing."""
    kept = rows
    if only_type:
        kept = kept.where(F.col("type") == only_type)
    if id_prefix:
        kept = kept.where(F.col("trial_id").startswith(id_prefix))
    for column, wanted in (("condition_id", conditions), ("contrast_id", contrasts), ("evaluation_regime", regimes)):
        if wanted:
            kept = kept.where(F.col(column).isin(*wanted))
    return kept


def find_trial(trials: DataFrame, trial_id: str) -> DataFrame:
    """Point lookup of one trial."""
    return trials.where(F.col("trial_id") == trial_id).limit(1)


def unit_id(block: Column, trial: Column) -> Column:
    """Cells of a block form one unit; a trial without a block is its own."""
    return F.coalesce(block, trial)


def limit_units(rows: DataFrame, seed: int, n: int, unit: str = "unit_id") -> DataFrame:
    """All rows of ``n`` units drawn in a reproducible random order; units stay whole."""
    drawn = (
        rows.select(unit).distinct().orderBy(order_hash(seed, F.col(unit)), unit).limit(n)
    )
    return null_safe_join(rows, drawn, [unit], "left_semi")


def first_units(rows: DataFrame, n: int, arrival: Sequence[str], unit: str = "unit_id") -> DataFrame:
    """All rows of the first ``n`` units in first-seen order."""
    seen = rows.groupBy(unit).agg(F.min(F.struct(*[F.col(c) for c in arrival])).alias("__first"))
    return null_safe_join(rows, seen.orderBy("__first").limit(n).select(unit), [unit], "left_semi")


def execution_order(rows: DataFrame, seed: int, unit: str, replicate: str, cell: str) -> DataFrame:
    """Random order of (unit, replicate), random cells inside, as one dense index.

    Every (unit, replicate) is contiguous.  The index is exact over the whole table and
    needs no single-task sort: hash prefixes are the sort buckets.
    """
    hashed = rows.withColumns(
        {
            "__unit_hash": order_hash(seed, F.col(unit), F.col(replicate)),
            "__cell_hash": order_hash(seed, F.col(unit), F.col(replicate), F.col(cell)),
        }
    )
    ordered = indexed_by_hash(hashed, "__unit_hash", [unit, replicate, "__cell_hash", cell], "execution_order_index")
    return ordered.withColumn("random_seed", F.lit(seed)).drop("__unit_hash", "__cell_hash")


# -- stratified sample ---------------------------------------------------------------------


def allocation(rows: DataFrame, strata: Sequence[str], size: int) -> DataFrame:
    """Seats per stratum: proportional, whole, summing to exactly min(size, rows).

    Works on one row per stratum (largest remainder; ties by stratum).
    """
    return _seats(rows.groupBy(*strata).agg(F.count("*").alias("n")), strata, size)


def _seats(counts: DataFrame, strata: Sequence[str], size: int) -> DataFrame:
    every = Window.partitionBy(F.lit(0))
    exact = F.col("n") * F.lit(size) / F.sum("n").over(every)
    shares = counts.withColumn("__raw", exact).withColumns(
        {"__whole": F.floor("__raw"), "__rest": F.round(F.col("__raw") - F.floor("__raw"), 12)}
    )
    ranked = shares.withColumns(
        {
            "__left": F.lit(size) - F.sum("__whole").over(every),
            "__place": F.row_number().over(every.orderBy(F.desc("__rest"), *strata)),
        }
    )
    seats = F.col("__whole") + F.when(F.col("__place") <= F.col("__left"), 1).otherwise(0)
    return ranked.select(*strata, "n", F.least(seats, F.col("n")).alias("seats"))


#: Hexadecimal digits of the hash that the histogram of a stratum tells apart.
CUT_DIGITS = 3


def stratified_sample(rows: DataFrame, strata: Sequence[str], size: int, seed: int, identifier: str) -> DataFrame:
    """Reproducible proportional sample of exactly min(size, rows) rows, in two scans of the input.

    The first counts the rows of each stratum by the leading digits of their hash.  The digits at which a
    stratum's seats run out are its cut-off; the second scan keeps the rows up to it, and only they are
    moved and numbered, those on the cut-off itself to fill the seats that are left.
    """
    hashed = rows.withColumn("__h", order_hash(seed, F.col(identifier))).withColumn("__bin", F.substring("__h", 1, CUT_DIGITS))
    bins = hashed.groupBy(*strata, "__bin").agg(F.count("*").alias("__k"))
    seats = _seats(bins.groupBy(*strata).agg(F.sum("__k").alias("n")), strata, size)
    before = Window.partitionBy(*strata).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    counted = null_safe_join(bins.withColumn("__before", F.coalesce(F.sum("__k").over(before), F.lit(0))), seats, strata)
    reached = (F.col("__before") < F.col("seats")) & (F.col("__before") + F.col("__k") >= F.col("seats"))
    cuts = counted.where(reached).select(*strata, F.col("__bin").alias("__cut"), (F.col("seats") - F.col("__before")).alias("__free"))
    near = null_safe_join(hashed, cuts, strata).where("__bin <= __cut")
    place = F.row_number().over(Window.partitionBy(*strata, "__bin").orderBy("__h", identifier))
    chosen = near.withColumn("__place", place).where("__bin < __cut OR __place <= __free")
    return chosen.drop("__h", "__bin", "__cut", "__free", "__place")


# -- packing -------------------------------------------------------------------------------


def request_units(requests: DataFrame, unit: Sequence[str], order: Column, tokens: Column) -> DataFrame:
    """One row per unit with its number of requests, tokens and arrival order."""
    return requests.groupBy(*unit).agg(
        F.count("*").alias("n_requests"), F.sum(tokens).alias("n_tokens"), F.min(order).alias("arrival")
    )


def _furthest(units: DataFrame, scope: Sequence[str], amount: str, limit: int) -> DataFrame:
    """Last unit that still fits when a chunk starts at each unit.

    Cumulative amounts are cut into stretches of one limit.  A chunk that starts in one
    stretch ends in the next one or runs out before it, so the search window holds at
    most two limits' worth of units.
    """
    end, start = F.col(f"__{amount}") + F.col(amount), F.col(f"__{amount}")
    ends = units.select(*scope, "pos", end.alias("v"), F.lit(0).alias("kind"))
    asks = units.select(*scope, "pos", (start + limit).alias("v"), F.lit(1).alias("kind"))
    both = ends.unionByName(asks).withColumn("stretch", F.floor(F.col("v") / limit))
    inside = Window.partitionBy(*scope, "stretch").orderBy("v", "kind").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("__last", F.max(F.when(F.col("kind") == 0, F.col("pos"))).over(inside)).where("kind = 1")
    before = both.where("kind = 0").groupBy(*scope, (F.col("stretch") + 1).alias("stretch")).agg(F.max("pos").alias("__before"))
    joined = null_safe_join(seen, before, [*scope, "stretch"], "left")
    return joined.select(
        *scope, "pos", F.greatest(F.coalesce("__last", "__before", F.col("pos")), F.col("pos")).alias(f"__to_{amount}")
    )


def pack_requests(
    units: DataFrame,
    bucket: Column,
    max_requests: int | None = None,
    max_tokens: int | None = None,
    scope: Sequence[str] = (),
) -> DataFrame:
    """Chunk numbers of the greedy packing in arrival order, units kept whole.

    A chunk is closed when the next unit would exceed a limit; a unit above a limit is a
    chunk of its own.  Every unit knows where the chunk after its own would start, so the
    chunk starts are the units reachable from the first one; they are found by pointer
    doubling (log of the number of chunks joins) instead of a sequential walk.

    ``units``: scope, arrival (unique in scope), n_requests, n_tokens.  ``bucket`` must
    not decrease along arrival; it only balances the running totals.
    """
    scope = list(scope)
    if max_requests is None and max_tokens is None:
        return units.withColumn("chunk", F.lit(1).cast("bigint"))
    ensure_checkpoint_dir(units.sparkSession)
    placed = numbered(units, scope, ["arrival"], bucket, "pos")
    limits = {"n_requests": max_requests, "n_tokens": max_tokens}
    active = {k: v for k, v in limits.items() if v is not None}
    for amount in active:
        placed = running_total(placed, scope, ["arrival"], bucket, F.col(amount), f"__{amount}")
    placed = placed.checkpoint()
    nexts = placed.select(*scope, "pos")
    for amount, limit in active.items():
        nexts = null_safe_join(nexts, _furthest(placed, scope, amount, limit), [*scope, "pos"])
    reach = [F.col(f"__to_{a}") for a in active]
    furthest = reach[0] if len(reach) == 1 else F.least(*reach)
    jump = nexts.select(*scope, "pos", (furthest + 1).alias("to")).checkpoint()

    starts = placed.where("pos = 1").select(*scope, "pos")
    n_units = placed.count()
    span = 1
    jumps = [jump]
    while span < n_units:
        onward = jumps[-1].select(*scope, F.col("pos").alias("to"), F.col("to").alias("__far"))
        doubled = null_safe_join(jumps[-1], onward, [*scope, "to"]).select(*scope, "pos", F.col("__far").alias("to"))
        doubled = doubled.checkpoint()
        if doubled.isEmpty():
            break
        jumps.append(doubled)
        span *= 2
    for step in reversed(jumps):
        # Every reachable unit is one definite number of hops away, so none appears twice.
        hopped = null_safe_join(starts, step, [*scope, "pos"], "left")
        starts = hopped.select(*scope, F.explode(F.array_compact(F.array("pos", "to"))).alias("pos"))
    flagged = null_safe_join(
        placed, starts.withColumn("__starts", F.lit(1).cast("bigint")), [*scope, "pos"], "left"
    ).withColumn("__starts", F.coalesce("__starts", F.lit(0).cast("bigint")))
    chunked = running_total(flagged, scope, ["arrival"], bucket, F.col("__starts"), "chunk")
    return chunked.withColumn("chunk", F.col("chunk") + F.col("__starts")).drop(
        "pos", "__starts", *[f"__{a}" for a in active]
    )
