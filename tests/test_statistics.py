import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlens.functions.stats import pearson
from pairlens.operators import agreement as agr
from pairlens.operators import ordering as od
from pairlens.operators import quality as q
from pairlens.operators import resampling as rs
from tests.conftest import one, rows_of


def scores(spark, xs, ys=None, group="g"):
    ys = ys or xs
    return spark.createDataFrame([(group, f"i{i}", float(x), float(y)) for i, (x, y) in enumerate(zip(xs, ys))], "g string, item string, x double, y double")


def brute_tau(xs, ys):
    c = d = ta = tb = 0
    n = len(xs)
    for i in range(n):
        for j in range(i):
            a, b = xs[i] - xs[j], ys[i] - ys[j]
            ta += a == 0
            tb += b == 0
            c += a * b > 0
            d += a * b < 0
    n0 = n * (n - 1) / 2
    scale = math.sqrt((n0 - ta) * (n0 - tb))
    return (c - d) / scale if scale else None


def brute_ranks(v):
    return [sum(o > x for o in v) + (sum(o == x for o in v) + 1) / 2 for x in v]


def test_average_ranks(spark):
    ranked = agr.average_ranks(scores(spark, [5, 5, 1]), ("g",), "x")
    assert rows_of(ranked, "item", "rank_position", "tie_group_size") == [("i0", 1.5, 2), ("i1", 1.5, 2), ("i2", 3.0, 1)]
    groups = agr.tie_groups(scores(spark, [5, 5, 1]), ("g",), "item", "x")
    assert rows_of(groups, "x", "members") == [(1.0, ["i2"]), (5.0, ["i0", "i1"])]


@pytest.mark.parametrize("seed, levels", [(1, 3), (2, 50), (3, 7)])
def test_rank_statistics_against_brute_force(spark, seed, levels):
    rng = random.Random(seed)
    xs = [rng.randrange(levels) for _ in range(60)]
    ys = [x + rng.randrange(levels) for x in xs]
    df = scores(spark, xs, ys).unionByName(scores(spark, ys, xs[::-1], "h"))
    tau = {r["g"]: r["kendall_tau_b"] for r in agr.kendall_tau_b(df, ("g",), "x", "y").collect()}
    assert tau["g"] == pytest.approx(brute_tau(xs, ys)) and tau["h"] == pytest.approx(brute_tau(ys, xs[::-1]))
    rho = {r["g"]: r["spearman"] for r in agr.spearman(df, ("g",), "x", "y").collect()}
    assert rho["g"] == pytest.approx(np.corrcoef(brute_ranks(xs), brute_ranks(ys))[0, 1])


def test_undefined_statistics_are_null(spark):
    flat = scores(spark, [1, 1, 1], [1, 2, 3])
    assert one(agr.kendall_tau_b(flat, ("g",), "x", "y"))["kendall_tau_b"] is None
    assert one(agr.spearman(flat, ("g",), "x", "y"))["spearman"] is None
    assert one(agr.kendall_tau_b(scores(spark, [1]), ("g",), "x", "y"))["kendall_tau_b"] is None
    assert one(flat.agg(pearson(F.col("x"), F.col("y")).alias("r")))["r"] is None
    assert one(scores(spark, [0, 1, 2], [2, 1, 0]).agg(pearson(F.col("x"), F.col("y")).alias("r")))["r"] == pytest.approx(-1)


def test_split_half(spark):
    schema = "story_1_id string, story_2_id string, story_a_id string, story_b_id string, replicate_number int, choice string"
    rows = [(a, b, a, b, r, c) for a, b, c in (("a", "b", "A"), ("a", "c", "B"), ("b", "c", "A")) for r in range(1, 5)]
    got = one(q.split_half_reliability(spark.createDataFrame(rows, schema)))
    assert got["r_split_half"] == pytest.approx(1) and got["n_pairs"] == 3
    got = one(q.split_half_reliability(spark.createDataFrame(rows[:4], schema)))
    assert got["r_split_half"] is None and got["n_pairs"] == 1


def pair_values(spark, values, group="g"):
    return spark.createDataFrame([(group, a, b, float(v)) for (a, b), v in values.items()], "g string, story_1_id string, story_2_id string, d_pair double")


def brute_bootstrap(values, items, draws, seed):
    import hashlib

    out = []
    for draw in range(draws):
        m = dict.fromkeys(items, 0)
        for slot in range(len(items)):
            h = int(hashlib.md5(f"{seed}:{draw}:{slot}".encode()).hexdigest()[:15], 16)
            m[items[h % len(items)]] += 1
        w = {p: m[p[0]] * m[p[1]] for p in values}
        if sum(w.values()):
            out.append(sum(w[p] * v for p, v in values.items()) / sum(w.values()))
    return out


@pytest.mark.parametrize("cells, partitions", [(1_000_000, 8), (40, 8), (1, 2)])
def test_bootstrap_against_brute_force(spark, monkeypatch, cells, partitions):
    """Any cut of the draws gives the same sums, down to one draw in a slice and one pair at a time."""
    from itertools import combinations

    monkeypatch.setattr(rs, "CELLS", cells)
    rng = random.Random(5)
    items = [f"s{i}" for i in range(6)]
    values = {p: rng.uniform(-1, 1) for p in combinations(items, 2)}
    df = pair_values(spark, values).unionByName(pair_values(spark, {p: 2 * v for p, v in values.items()}, "h")).unionByName(pair_values(spark, {p: 3 * v for p, v in values.items()}, None))
    want = sorted(brute_bootstrap(values, items, 50, 7))
    got = rs.resampled_means(df.repartition(partitions), rs.items_of(df), ("g",), "d_pair", 50, 7).collect()
    for g, factor in (("g", 1), ("h", 2), (None, 3)):
        assert sorted(r["estimate"] for r in got if r["g"] == g) == pytest.approx([factor * v for v in want])
    ci = one(rs.ate_intervals(df, rs.items_of(df), ("g",), 50, 7).where("g = 'g'"))
    assert ci["ci_95_lo"] == pytest.approx(np.percentile(want, 2.5)) and ci["ci_90_hi"] == pytest.approx(np.percentile(want, 95))


def test_bootstrap_slices_stay_within_the_bound():
    for n, draws in ((12, 10_000), (5_000, 10_000), (3_000_000, 10_000), (7, 1)):
        per = rs.draws_per_slice(n, draws, 200)
        assert per >= 1 and (per == 1 or per * n <= rs.CELLS)
    m = rs.multiplicities(5, range(3, 9), 7)
    assert m.shape == (5, 6) and (m.sum(axis=0) == 5).all()
    assert (m == np.hstack([rs.multiplicities(5, range(k, k + 1), 7) for k in range(3, 9)])).all()


def test_multiplicities_of_many_items_and_pairs_that_are_not_copied(spark):
    want = np.zeros((23_457, 2))
    for k, draw in enumerate((9, 123)):
        for slot in range(len(want)):
            want[int(hashlib.md5(f"20260917:{draw}:{slot}".encode()).hexdigest()[:15], 16) % len(want), k] += 1
    assert (np.hstack([rs.multiplicities(len(want), range(draw, draw + 1), 20260917) for draw in (9, 123)]) == want).all()
    df = pair_values(spark, {("a", "b"): 1.0, ("b", "c"): 2.0})
    plan = rs.resampled_means(df, rs.items_of(df), ("g",), "d_pair", 50, 7)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan  # no pair is repeated for a slice of the draws


def test_rank_statistics_shuffle_no_level_and_no_distinct(spark):
    """Levels of tau-b are made behind the last shuffle of points; Spearman repeats no row for its distinct counts."""
    rng = random.Random(3)
    df = spark.createDataFrame([("g", float(rng.randrange(40)), float(rng.randrange(90))) for _ in range(300)], "g string, x double, y double")
    tau, rho = agr.kendall_tau_b(df, ("g",), "x", "y"), agr.spearman(df, ("g",), "x", "y")
    assert "Expand" not in rho._jdf.queryExecution().optimizedPlan().toString()
    lines = tau._jdf.queryExecution().sparkPlan().toString().split("\n")
    joined = [at for at, line in enumerate(lines) if "Generate" in line]
    assert joined and not any("Join" in line and "__below" in line for line in lines)
    depth = [len(line) - len(line.lstrip(" :+-")) for line in lines]
    above = [line for at, line in enumerate(lines[: joined[0]]) if depth[at] < depth[joined[0]]]
    assert sum("Window" in line for line in above) >= 2 and sum("Join" in line for line in above) <= 2


@pytest.mark.parametrize("small", [0, 40_000])
def test_exact_quantiles(spark, monkeypatch, small):
    """Brackets and whole groups give the same values, with ties, one value, NULLs and a NULL key."""
    monkeypatch.setattr(od, "SMALL_GROUP", small)
    monkeypatch.setattr(od, "SKETCH_ERROR", 0.01)
    rng = random.Random(3)
    groups = {"even": [rng.gauss(0, 5) for _ in range(3000)], "ties": [float(rng.randrange(4)) for _ in range(2500)], "flat": [1.5] * 900, None: [10.0 ** rng.randrange(-200, 200) for _ in range(2001)]}
    if small:
        groups |= {"one": [4.0], "two": [1.0, 2.0], "none": []}
    rows = [(g, v) for g, vs in groups.items() for v in [*vs, None]]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}
    quantiles = od.exact_quantiles(df, ["g"], "v", probs)
    got = {r["g"]: [r[k] for k in probs] for r in quantiles.collect()}
    assert got == {g: pytest.approx([np.percentile(vs, 100 * p) for p in probs.values()]) for g, vs in groups.items() if vs}
    whole = one(od.exact_quantiles(df.where("g = 'even'"), [], "v", probs))
    assert [whole[k] for k in probs] == pytest.approx(got["even"])
    plan = quantiles._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in plan and "collect_" not in plan


def test_constant_effect_is_equivalent_only_when_frozen(spark):
    from itertools import combinations

    rows = [("k", c, a, b, 0.01) for c in ("matched_control", "text_only") for a, b in combinations("abcde", 2)]
    df = spark.createDataFrame(rows, "contrast_id string, instruction_condition string, story_1_id string, story_2_id string, d_pair double")
    draws = rs.controllability_draws(df, rs.items_of(df), ("contrast_id",), 40, 3)
    assert one(rs.equivalence(draws, ("contrast_id",), 0.05, True))["verdict"] == "practically_invariant"
    assert one(rs.equivalence(draws, ("contrast_id",), 0.005, True))["verdict"] == "not_practically_invariant"
    assert one(rs.equivalence(draws, ("contrast_id",), 0.05, False))["verdict"] is None


def test_slope(spark):
    from itertools import combinations

    pairs = list(combinations("abcdef", 2))
    rows = [("k", a, b, float(i % 5), 0.3 - 0.2 * (i % 5)) for i, (a, b) in enumerate(pairs)]
    schema = "contrast_id string, story_1_id string, story_2_id string, baseline_strength double, d_pair double"
    df = spark.createDataFrame(rows, schema)
    fit = one(rs.ambiguity_fit(df, ("contrast_id",)))
    assert fit["beta"] == pytest.approx(-0.2) and fit["predicted_at_p50"] == pytest.approx(0.3 - 0.2 * np.percentile([r[3] for r in rows], 50))
    ci = one(rs.slope_intervals(df, rs.items_of(df), ("contrast_id",), 30, 1))
    assert ci["ci_95_lo"] == pytest.approx(-0.2) and ci["ci_95_hi"] == pytest.approx(-0.2)
    flat = df.withColumn("baseline_strength", F.lit(1.7))
    assert rs.ambiguity_fit(flat, ("contrast_id",)).isEmpty() and rs.slope_draws(flat, rs.items_of(flat), ("contrast_id",), 30, 1).isEmpty()


def test_total_order(spark):
    def verdict(edges, n=6):
        items = spark.createDataFrame([(f"i{k}",) for k in range(n)], "item_id string")
        table = spark.createDataFrame([(f"i{a}", f"i{b}") for a, b in edges], "winner string, loser string")
        layers = agr.order_layers(items, table)
        v = one(agr.order_verdict(layers))
        return (v["has_cycle"], v["is_unique"], v["n_layers"]), layers

    chain = [(i, i + 1) for i in range(5)] + [(0, 3)]
    state, layers = verdict(chain)
    assert state == (False, True, 6)
    assert rows_of(layers, "item_id", "layer") == [(f"i{k}", k + 1) for k in range(6)]
    assert verdict([e for e in chain if e != (2, 3)])[0][:2] == (False, False)
    assert verdict(chain + [(5, 0)])[0][:2] == (True, False)
    assert verdict(chain + [(5, 4)])[0][0] is True
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "c"), ("a", "c")], "winner string, loser string")
    assert rows_of(agr.contradictions(edges), "low", "high") == [("a", "b"), ("c", "c")]
    items = spark.createDataFrame([("a",), ("b",)], "item_id string")
    assert rows_of(agr.unknown_items(edges, items), "item_id") == [("c",)]


def test_running_totals_survive_a_hot_key(spark):
    rng = random.Random(9)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(5)}", i, float(rng.randrange(40))) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, i int, v double").repartition(11)
    got = {(r["k"], r["i"]): r["n"] for r in od.numbered(od.value_buckets(df, ["k"], "v").withColumnRenamed(od.BUCKET, "b"), ["k"], ["v", "i"], F.col("b"), "n").collect()}
    for key in {r[0] for r in rows}:
        ordered = sorted((v, i) for k, i, v in rows if k == key)
        assert [got[(key, i)] for _, i in ordered] == list(range(1, len(ordered) + 1))
    texts = df.select(F.concat(F.lit("id::"), F.md5(F.col("i").cast("string"))).alias("t"))
    indexed = od.indexed_by_text(texts, "t", "n").orderBy("n").collect()
    assert [r["n"] for r in indexed] == list(range(1, 2001)) and [r["t"] for r in indexed] == sorted(r["t"] for r in indexed)
