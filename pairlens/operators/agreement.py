"""Rank statistics and agreement with reference judgements.

No statistic here gathers a group or forms all pairs of it: ranks come from running
totals over distinct values, and so does Kendall's tau-b.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairlens.functions.common import null_safe_join, ratio
from pairlens.functions.scalars import chosen_item
from pairlens.operators.ordering import BUCKET, TASK_ROWS, bucket_count, dealt, value_buckets, value_running_total
from pairlens.session import ensure_checkpoint_dir, hold

# -- ranks ---------------------------------------------------------------------------------


def value_ranks(df: DataFrame, group: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """Per distinct value: tie-group size and average rank (1 = highest).

    ``weight`` counts a row that many times.
    """
    size = F.count("*") if weight is None else F.sum(weight)
    sizes = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(size.alias("tie_group_size"))
    above = value_running_total(sizes, group, value, F.col("tie_group_size"), "__above", descending=True)
    rank = F.col("__above") + (F.col("tie_group_size") + 1) / 2
    return above.withColumn("rank_position", rank.cast("double")).drop("__above")


def average_ranks(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Rows with their average rank and tie-group size; ties are never broken."""
    return null_safe_join(df, value_ranks(df, group, value), [*group, value])


def tie_groups(df: DataFrame, group: Sequence[str], item: str, value: str) -> DataFrame:
    """Tie groups with their sorted members, for display."""
    members = df.groupBy(*group, value).agg(F.sort_array(F.collect_list(item)).alias("members"))
    return null_safe_join(members, value_ranks(df, group, value), [*group, value])


def reference_scores(ranking: DataFrame, column: str = "ranking") -> DataFrame:
    """A best-first list as scores n - i (higher is better)."""
    return ranking.select(F.size(column).alias("n"), F.posexplode(column).alias("i", "item_id")).select(
        "item_id", (F.col("n") - F.col("i")).cast("double").alias("score")
    )


# -- item scores ---------------------------------------------------------------------------


def item_means(rows: DataFrame, conditions: Sequence[str], pooled: bool = False) -> DataFrame:
    """Mean rating per item, per condition and (``pooled``) over all of them.

    Pooled rows have NULL conditions; both levels come from one scan.  Ratings have at
    most one decimal, so they are summed exactly: ties between means are real and must
    not depend on the order of summation.
    """
    keys = ["model", "evaluation_regime"]
    total = F.sum(F.col("rating").cast("decimal(18,6)")).cast("double")
    columns = [(total / F.count("rating")).alias("mean_score"), F.count("*").alias("n")]
    if not pooled:
        return rows.groupBy(*keys, *conditions, "story_id").agg(*columns)
    sets = [[*keys, *conditions, "story_id"], [*keys, "story_id"]]
    return rows.groupingSets(sets, *keys, *conditions, "story_id").agg(*columns)


def win_tally(rows: DataFrame, group: Sequence[str]) -> DataFrame:
    """Wins, losses, ties, Copeland score and win rate per item."""
    winner = chosen_item(F.col("choice"), F.col("story_a_id"), F.col("story_b_id"))
    sides = rows.select(*group, winner.alias("__w"), F.explode(F.array("story_a_id", "story_b_id")).alias("story_id"))
    tally = sides.groupBy(*group, "story_id").agg(
        F.count_if(F.col("__w") == F.col("story_id")).alias("wins"),
        F.count_if(F.col("__w") != F.col("story_id")).alias("losses"),
        F.count_if(F.col("__w").isNull()).alias("ties"),
    )
    games = F.col("wins") + F.col("losses") + F.col("ties")
    return tally.withColumns(
        {
            "copeland": F.col("wins") - F.col("losses"),
            "games": games,
            "win_rate": (F.col("wins") + 0.5 * F.col("ties")).cast("double") / F.greatest(F.lit(1), games),
        }
    )


# -- rank correlation ----------------------------------------------------------------------


def spearman(df: DataFrame, group: Sequence[str], x: str, y: str) -> DataFrame:
    """Tie-aware Spearman per group, over the items that have both values."""
    points = hold(_points(df, group, x, y))
    rx = value_ranks(points, group, x, "__m").withColumnRenamed("rank_position", "__rx").drop("tie_group_size")
    ry = value_ranks(points, group, y, "__m").withColumnRenamed("rank_position", "__ry").drop("tie_group_size")
    ranked = null_safe_join(null_safe_join(points, rx, [*group, x]), ry, [*group, y])
    m, a, b = F.col("__m"), F.col("__rx"), F.col("__ry")
    sums = ranked.groupBy(*group).agg(
        F.sum("__m").alias("n_items"),
        F.sum(m * a * b).alias("__ab"), F.sum(m * a * a).alias("__aa"), F.sum(m * b * b).alias("__bb"),
        (F.min("__rx") < F.max("__rx")).alias("__vx"), (F.min("__ry") < F.max("__ry")).alias("__vy"),
    )
    # Average ranks always have mean (n + 1) / 2, so the centred sums need no second pass.
    n = F.col("n_items").cast("double")
    shift = n * (n + 1) * (n + 1) / 4
    scale = F.sqrt((F.col("__aa") - shift) * (F.col("__bb") - shift))
    rho = F.when(F.col("__vx") & F.col("__vy"), (F.col("__ab") - shift) / F.nullif(scale, F.lit(0.0)))
    return sums.select(*group, rho.alias("spearman"), "n_items")


def _points(df: DataFrame, group: Sequence[str], x: str, y: str) -> DataFrame:
    """Distinct (x, y) points of a group with their multiplicity."""
    common = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return common.groupBy(*group, x, y).agg(F.count("*").alias("__m"))


def _codes(df: DataFrame, group: Sequence[str], value: str, out: str) -> DataFrame:
    """Dense integer code of each distinct value, and the number of bits a group needs."""
    distinct = df.select(*group, value).distinct()
    coded = value_running_total(distinct, group, value, F.lit(1).cast("bigint"), out)
    bits = distinct.groupBy(*group).agg(F.length(F.bin(F.count("*") - 1)).alias(f"{out}_bits"))
    return null_safe_join(coded, bits, group)


def kendall_tau_b(df: DataFrame, group: Sequence[str], x: str, y: str) -> DataFrame:
    """Kendall's tau-b per group without forming pairs.

    Two different codes of x first differ at exactly one bit, so every pair that is not
    tied in x meets in exactly one node (level, prefix), on opposite sides.  Inside a node
    a running total along y tells how many points of the lower side lie below and above
    each point of the upper side: concordant minus discordant.  A point takes part in
    log(distinct x) nodes, and the running totals spread a hot node over tasks.  tau-b is
    symmetric; passing the coarser side as ``x`` is cheaper.
    """
    group = list(group)
    points = hold(_points(df, group, x, y))
    codes = _codes(points, group, x, "__c")
    ensure_checkpoint_dir(df.sparkSession)
    coded = null_safe_join(points, codes, [*group, x]).checkpoint()
    # All nodes of a bucket of y are in one place from here on: points are shuffled once, not once a level.
    # A point makes several nodes, so a task takes a quarter of the usual rows.
    load = 4 * coded.count()
    bucketed = value_buckets(coded, group, y, min(4096, max(bucket_count(coded), load // TASK_ROWS))).withColumnRenamed(BUCKET, "__vb")
    bucketed = dealt(bucketed, load, [*group, "__vb"])
    levels = bucketed.withColumn("__a", F.explode(F.sequence(F.lit(0), F.col("__c_bits") - 1)))
    upper = F.expr("(__c >> __a) & 1") == 1
    nodes = levels.withColumn("__p", F.expr("__c >> (__a + 1)")).groupBy(*group, "__a", "__p", "__vb", y).agg(
        F.coalesce(F.sum(F.when(~upper, F.col("__m"))), F.lit(0)).alias("__lo"),
        F.coalesce(F.sum(F.when(upper, F.col("__m"))), F.lit(0)).alias("__up"),
    )
    node = [*group, "__a", "__p"]
    # Inside a bucket, for every upper point: below - above, where above = all lower - below - level.
    # What lies in lower buckets is the same for a whole bucket, so it is added to the bucket's sums.
    inside = Window.partitionBy(*node, "__vb").orderBy(y).rowsBetween(Window.unboundedPreceding, -1)
    below = nodes.withColumn("__below", F.coalesce(F.sum("__lo").over(inside), F.lit(0)))
    buckets = below.groupBy(*node, "__vb").agg(
        F.sum(F.expr("cast(__up as decimal(19,0)) * (2 * __below + __lo)")).alias("__gain"),
        F.sum("__lo").alias("__lo"),
        F.sum("__up").alias("__up"),
    )
    lower = Window.partitionBy(*node).orderBy("__vb").rowsBetween(Window.unboundedPreceding, -1)
    placed = buckets.withColumn("__offset", F.coalesce(F.sum("__lo").over(lower), F.lit(0)))
    parts = placed.groupBy(*node).agg(
        F.sum(F.expr("__gain + cast(__up as decimal(19,0)) * (2 * __offset)")).alias("__gain"),
        F.sum("__lo").alias("__all_lo"),
        F.sum("__up").alias("__all_up"),
    )
    score = parts.groupBy(*group).agg(
        F.sum(F.expr("__gain - cast(__all_lo as decimal(19,0)) * __all_up")).alias("__s")
    )

    def tied(value: str, out: str) -> DataFrame:
        sizes = points.groupBy(*group, value).agg(F.sum("__m").alias("__k"))
        pairs = F.sum(F.expr("cast(__k as decimal(19,0)) * (__k - 1) / 2"))
        return sizes.groupBy(*group).agg(pairs.cast("double").alias(out), F.sum("__k").alias(f"{out}_n"))

    joined = null_safe_join(null_safe_join(score, tied(x, "__ta"), group), tied(y, "__tb"), group)
    n = F.col("__ta_n").cast("double")
    all_pairs = n * (n - 1) / 2
    scale = F.sqrt((all_pairs - F.col("__ta")) * (all_pairs - F.col("__tb")))
    return joined.select(
        *group,
        (F.col("__s").cast("double") / F.nullif(scale, F.lit(0.0))).alias("kendall_tau_b"),
        F.col("__ta_n").alias("n_items"),
    )


# -- reference judgements ------------------------------------------------------------------


def edge_concordance(scores: DataFrame, edges: DataFrame, group: Sequence[str], item: str, value: str) -> DataFrame:
    """Judged pairs whose winner also scores higher, lower or the same."""
    side = scores.select(*group, item, value)
    winners = side.withColumnRenamed(item, "winner").withColumnRenamed(value, "__w")
    losers = side.withColumnRenamed(item, "loser").withColumnRenamed(value, "__l")
    both = null_safe_join(edges.join(winners, "winner"), losers, [*group, "loser"])
    concordant, discordant = F.count_if(F.col("__w") > F.col("__l")), F.count_if(F.col("__w") < F.col("__l"))
    return both.groupBy(*group).agg(
        concordant.alias("concordant"),
        discordant.alias("discordant"),
        F.count_if(F.col("__w") == F.col("__l")).alias("tied"),
        F.count("*").alias("checked"),
        ratio(concordant, concordant + discordant).alias("concordant_rate"),
    )


def reference_comparison(
    scores: DataFrame, reference: DataFrame, edges: DataFrame, group: Sequence[str], item: str, value: str
) -> DataFrame:
    """tau-b, Spearman and edge concordance of item scores against the reference."""
    common = scores.join(reference.select(F.col("item_id").alias(item), F.col("score").alias("__ref")), item)
    tau = kendall_tau_b(common, group, value, "__ref").withColumnRenamed("n_items", "n_common")
    rho = spearman(common, group, value, "__ref").drop("n_items")
    agreed = edge_concordance(scores, edges, group, item, value)
    groups = scores.select(*group).distinct()
    joined = reduce(lambda a, b: null_safe_join(a, b, group, "left"), [tau, rho, agreed], groups)
    counts = {c: F.coalesce(c, F.lit(0)) for c in ("n_common", "concordant", "discordant", "tied", "checked")}
    return joined.withColumns(counts)


def reference_agreement(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Each judgement of a referenced pair: concordant, discordant or tied.

    ``edges`` must hold one judgement per unordered pair (``contradictions`` and
    ``duplicate_ids`` check that).
    """
    keyed = edges.select(
        F.least("winner", "loser").alias("__lo"), F.greatest("winner", "loser").alias("__hi"), "winner"
    )
    low, high = F.least("story_a_id", "story_b_id"), F.greatest("story_a_id", "story_b_id")
    joined = rows.withColumns({"__lo": low, "__hi": high}).join(keyed, ["__lo", "__hi"]).drop("__lo", "__hi")
    chosen = chosen_item(F.col("choice"), F.col("story_a_id"), F.col("story_b_id"))
    return joined.withColumns(
        {
            "chosen": F.coalesce(chosen, F.lit("tie")),
            "outcome": F.when(chosen.isNull(), "model_tied")
            .when(chosen == F.col("winner"), "concordant")
            .otherwise("discordant"),
        }
    ).withColumnRenamed("winner", "reference_winner")


def agreement_summary(outcomes: DataFrame, group: Sequence[str]) -> DataFrame:
    counts = {o: F.count_if(F.col("outcome") == o) for o in ("concordant", "discordant", "model_tied")}
    return outcomes.groupBy(*group).agg(
        *[c.alias(o) for o, c in counts.items()],
        F.count("*").alias("n"),
        ratio(counts["concordant"], counts["concordant"] + counts["discordant"]).alias("concordant_rate"),
    )


# -- total order from judgements -----------------------------------------------------------


def unknown_items(edges: DataFrame, items: DataFrame, item: str = "item_id") -> DataFrame:
    """Judged ids that are not registered."""
    used = edges.select(F.explode(F.array("winner", "loser")).alias(item)).distinct()
    return used.join(items.select(item), item, "left_anti")


def contradictions(edges: DataFrame) -> DataFrame:
    """Pairs judged both ways, self judgements included."""
    reverse = edges.select(F.col("loser").alias("winner"), F.col("winner").alias("loser")).distinct()
    both = edges.select("winner", "loser").distinct().join(reverse, ["winner", "loser"], "left_semi")
    return both.select(F.least("winner", "loser").alias("low"), F.greatest("winner", "loser").alias("high")).distinct()


def order_layers(items: DataFrame, edges: DataFrame, item: str = "item_id", rounds_per_job: int = 4) -> DataFrame:
    """Peel items without a remaining better one, layer by layer.

    Returns (item, layer); a NULL layer marks items on or behind a cycle.  The order is
    total and unique exactly when no layer is NULL and every layer has one item.  Each
    job unrolls a few rounds and writes its state to the checkpoint folder, so lineage
    stays short and a lost executor costs one job.
    """
    ensure_checkpoint_dir(items.sparkSession)
    state = items.select(item).distinct().withColumn("layer", F.lit(None).cast("int"))
    links = edges.select("winner", "loser").distinct()
    done, layer = 0, 0
    while True:
        for _ in range(rounds_per_job):
            layer += 1
            open_items = state.where("layer IS NULL").select(item)
            live = links.join(open_items.withColumnRenamed(item, "winner"), "winner", "left_semi")
            blocked = live.select(F.col("loser").alias(item)).distinct().withColumn("__b", F.lit(True))
            state = (
                state.join(blocked, item, "left")
                .withColumn("layer", F.when(F.col("layer").isNull() & F.col("__b").isNull(), layer).otherwise(F.col("layer")))
                .drop("__b")
            )
        state = state.checkpoint()
        counts = state.agg(F.count("layer").alias("placed"), F.count("*").alias("total")).first()
        if counts["placed"] == counts["total"] or counts["placed"] == done:
            return state
        done = counts["placed"]


def order_verdict(layers: DataFrame) -> DataFrame:
    """One row: number of layers, whether a cycle exists, whether the order is unique."""
    sizes = layers.groupBy("layer").agg(F.count("*").alias("k"))
    has_cycle = F.coalesce(F.max(F.col("layer").isNull()), F.lit(False))
    widest = F.coalesce(F.max(F.when(F.col("layer").isNotNull(), F.col("k"))), F.lit(0))
    return sizes.agg(
        F.count("layer").alias("n_layers"),
        has_cycle.alias("has_cycle"),
        (~has_cycle & (widest <= 1)).alias("is_unique"),
    )
