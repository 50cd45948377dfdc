import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from pairlens.contract import planning as pl
from pairlens.operators import design as ds
from pairlens.operators import quality as q
from pairlens.operators import sampling as sp
from pairlens.plans import manifests
from tests.conftest import one, rows_of


def items(spark, n=12):
    return spark.createDataFrame([(f"s{i:02d}", f" text {i} two  words\n") for i in range(n)], "item_id string, text string")


@pytest.mark.parametrize("n", [1, 2, 7, 12])
def test_pairs_are_complete(spark, n):
    ids = [f"s{i:02d}" for i in range(n)]
    assert rows_of(ds.unordered_pairs(items(spark, n)), "story_1_id", "story_2_id") == sorted(combinations(ids, 2))
    assert ds.ordered_pairs(items(spark, n)).distinct().count() == n * (n - 1)


def test_manifest_sizes(spark):
    v2 = manifests.controllability_v2(items(spark), pl.CONTRASTS)
    assert v2["treatment"].count() == 2640 and v2["treatment"].select("superblock_id").distinct().count() == 330
    assert v2["baseline"].count() == v2["baseline_text_only"].count() == 132
    v1 = manifests.controllability_v1(items(spark), pl.CONTRASTS)
    assert v1["treatment"].count() == 2640 and v1["baseline"].count() == 132
    index = ds.planned_observations(v2["treatment"], 10, "x", "e", "treatment")
    assert index.count() == 26400
    pilot = manifests.pilot(items(spark), pl.CONDITIONS, pl.TASKS, pl.PAIR_CONDITIONS, "Rate.", ["s00", "s01", "s02", "s03"])
    assert {r["type"]: r["count"] for r in pilot.groupBy("type").count().collect()} == {"single": 8, "comparison": 24, "comparison_control": 8}
    with pytest.raises(ValueError):
        manifests.pilot(items(spark, 3), pl.CONDITIONS, pl.TASKS, pl.PAIR_CONDITIONS, "Rate.", ["s00", "s09"])
    whole = manifests.context(items(spark, 4), pl.dimensions(spark), pl.CONTRASTS, pl.PROMPT_CONTRASTS, pl.INSTRUCTIONS)
    counts = {r["type"]: r["count"] for r in whole.groupBy("type").count().collect()}
    assert counts == {"context_single": 4 * 6 * 2, "context_pairwise": 6 * 5 * 4 * 2, "context_prompt": 6 * 2 * 2}
    assert manifests.tie_allowed(items(spark, 3), pl.CONTRASTS).count() == 3 * 5 * 4 * 2
    assert manifests.named_labels(items(spark, 3), pl.CONTRASTS[:2], "x").count() == 3 * 2 * 4
    assert ds.planned_calls(12, 5, 2, 10, 10) == 27720


def test_conditions_differ_only_in_the_instruction(spark):
    rows = manifests.controllability_v2(items(spark, 2), pl.CONTRASTS[:1])["treatment"].collect()
    from pairlens.functions import prompts as pr

    by_cell = {}
    for r in rows:
        sentence = pr.INSTRUCTIONS_V2[r["instruction_condition"]]
        assert sentence in r["prompt"]
        by_cell.setdefault((r["assignment"], r["position"]), set()).add(r["prompt"].replace(sentence, ""))
    assert len(by_cell) == 4 and all(len(v) == 1 for v in by_cell.values())
    top = {(r["assignment"], r["position"]): (r["story_a_id"], r["context_a"]["value"]) for r in rows}
    assert top == {
        ("forward", "story1_as_a"): ("s00", "island"), ("forward", "story2_as_a"): ("s01", "mainland"),
        ("flipped", "story1_as_a"): ("s00", "mainland"), ("flipped", "story2_as_a"): ("s01", "island"),
    }


def test_replicates(spark):
    trials = spark.createDataFrame([("context_single", "neutral"), ("context_single", "x"), ("context_pairwise", None)], "type string, condition_id string")
    got = ds.expand_replicates(trials, 2, 4).groupBy("type", "condition_id").count()
    assert sorted(r["count"] for r in got.collect()) == [2, 2, 4]
    with pytest.raises(ValueError):
        ds.replicate_counts(3, 2)


def test_contrast_gate(spark):
    dims = spark.createDataFrame([("d", "x", None), ("d", "y", None), ("w", "x", "d")], "dimension string, value_id string, depends_on string")
    rows = [("k1", "d", "x", "y"), ("k2", "d", "x", "x"), ("k3", "d", "x", "nope"), ("k4", "w", "x", "x"), ("k1", "d", "x", "y")]
    table = spark.createDataFrame(rows, "contrast_id string, dimension string, a string, b string").withColumns({"a_clause": F.lit("c"), "b_clause": F.lit("c")})
    found = set(rows_of(q.contrast_violations(table, dims, ("k1", "k9"), one_per_dimension=True), "contrast_id", "violation"))
    assert {("k2", "same_values"), ("k3", "unregistered_value"), ("k4", "dependent_dimension"), ("k1", "duplicate_id"), ("k9", "absent_id"), ("k2", "unexpected_id"), ("k3", "reused_dimension")} <= found
    pairs = table.where("contrast_id = 'k1'").limit(1)
    assert q.contrast_violations(pairs, all_pairs_of=["x", "y"]).isEmpty()
    assert rows_of(q.contrast_violations(pairs, all_pairs_of=["x", "y", "z"]), "contrast_id") == [("x|z",), ("y|z",)]


def test_packet_gate_and_rendering(spark):
    dims = pl.dimensions(spark)
    packets = [(1, "writer_status", "apprentice"), (1, "provenance", "auction"), (2, "writer_status", "apprentice"), (3, "writer_status", "apprentice"), (3, "provenance", "kiosk"), (4, "nope", "x"), (5, "provenance", "nope")]
    df = spark.createDataFrame(packets, "packet_id int, dimension string, value_id string")
    applies = spark.createDataFrame([("writer_status", "trunk"), ("writer_status", "auction")], "dimension string, parent_value string")
    assert rows_of(q.packet_violations(df, dims, applies), "packet_id", "violation") == [
        (2, "missing_parent"), (3, "parent_not_applicable"), (4, "unknown_dimension"), (5, "unknown_value"),
    ]
    assert one(ds.render_packets(df.where("packet_id = 1"), dims))["context_text"] == "This went under the hammer in spring. The lot was an apprentice piece."


def test_corpus(spark, monkeypatch):
    profile = ds.corpus_profile(items(spark, 3))
    assert {r["word_count"] for r in profile.collect()} == {4}
    import hashlib

    text = "\n".join(f"s{i:02d}:" + hashlib.sha256(f"text {i} two  words".encode()).hexdigest() for i in range(3))
    assert one(ds.corpus_hash(profile))["corpus_hash"] == hashlib.sha256(text.encode()).hexdigest()
    monkeypatch.setattr(ds, "LISTING_LINES", 1)
    again = one(ds.corpus_hash(profile.repartition(5)))["corpus_hash"]
    assert again == hashlib.sha256(text.encode()).hexdigest() != one(ds.corpus_hash(profile.limit(2)))["corpus_hash"]
    monkeypatch.setattr(ds, "LISTING_LINES", 777)  # the same listing beyond a hundred thousand lines
    many = spark.range(120_000).selectExpr("concat('i', id) AS item_id", "sha2(cast(id AS string), 256) AS sha256")
    lines = "\n".join(f"{i}:{hashlib.sha256(i[1:].encode()).hexdigest()}" for i in sorted(f"i{i}" for i in range(120_000)))  # in order of the id, not of the line
    got = one(ds.corpus_hash(many))
    assert (got["n_items"], got["corpus_hash"]) == (120_000, hashlib.sha256(lines.encode()).hexdigest())


def test_fingerprint_ignores_order_but_not_content(spark):
    df = items(spark, 9)
    base = one(q.fingerprint(df, "t"))["content_sha256"]
    assert base == one(q.fingerprint(df.repartition(5).select("text", "item_id"), "t"))["content_sha256"]
    assert base != one(q.fingerprint(df.union(df.limit(1)), "t"))["content_sha256"]
    lock = q.fingerprints({"t": df, "u": df})
    assert q.drift(q.fingerprints({"t": df, "u": df.repartition(3)}), lock).isEmpty()
    assert rows_of(q.drift(q.fingerprints({"t": df.limit(8), "u": df}), lock), "table_name") == [("t",)]


def greedy(units, max_requests, max_tokens):
    chunk, r, t, out = 1, 0, 0, []
    for n, k in units:
        if r and ((max_requests and r + n > max_requests) or (max_tokens and t + k > max_tokens)):
            chunk, r, t = chunk + 1, 0, 0
        r, t = r + n, t + k
        out.append(chunk)
    return out


@pytest.mark.parametrize("limits", [(None, 300), (10, 300), (1000, 100000)])
def test_packing_equals_greedy(spark, limits):
    rng = random.Random(sum(x or 0 for x in limits))
    units = [(rng.randrange(1, 6), rng.randrange(1, 150)) for _ in range(150)]
    rows = [("x", i, n, k) for i, (n, k) in enumerate(units)] + [("y", i, n, k) for i, (n, k) in enumerate(units[::-1])]
    df = spark.createDataFrame(rows, "ev string, arrival int, n_requests int, n_tokens int")
    got = sp.pack_requests(df, F.floor(F.col("arrival") / 20), *limits, scope=("ev",)).collect()
    for ev, order in (("x", units), ("y", units[::-1])):
        assert [r["chunk"] for r in sorted(got, key=lambda r: r["arrival"]) if r["ev"] == ev] == greedy(order, *limits)


def test_units_stay_whole_and_contiguous(spark):
    rows = [(f"u{u}", r, c) for u in range(9) for r in range(1, 4) for c in "abcd"]
    df = spark.createDataFrame(rows, "unit_id string, rep int, cell string")
    got = sp.execution_order(df, 5, "unit_id", "rep", "cell").orderBy("execution_order_index").collect()
    assert [r["execution_order_index"] for r in got] == list(range(1, len(rows) + 1))
    runs = [(r["unit_id"], r["rep"]) for r in got]
    assert all(len(set(runs[i : i + 4])) == 1 for i in range(0, len(runs), 4))
    again = sp.execution_order(df.repartition(7), 5, "unit_id", "rep", "cell").orderBy("execution_order_index").collect()
    assert got == again and got != sp.execution_order(df, 6, "unit_id", "rep", "cell").orderBy("execution_order_index").collect()
    limited = sp.limit_units(df, 5, 4)
    assert limited.count() == 48 and limited.select("unit_id").distinct().count() == 4
    first = sp.first_units(df.withColumn("n", F.monotonically_increasing_id()), 2, ("n",))
    assert rows_of(first.select("unit_id").distinct(), "unit_id") == [("u0",), ("u1",)]


@pytest.mark.parametrize("size", [0, 7, 50, 500])
def test_sample_is_exact(spark, size):
    rows = [(i, "big" if i < 70 else f"s{i % 5}") for i in range(100)]
    df = spark.createDataFrame(rows, "id int, stratum string")
    got = sp.stratified_sample(df, ("stratum",), size, 3, "id")
    assert got.count() == got.select("id").distinct().count() == min(size, 100)
    if size == 50:
        assert got.where("stratum = 'big'").count() == 35


def test_selection_filters(spark):
    df = spark.createDataFrame([("t1", "single", "x", None, None), ("t2", "context_pairwise", None, "k", "naturalistic")], "trial_id string, type string, condition_id string, contrast_id string, evaluation_regime string")
    assert sp.select_rows(df).count() == 2
    assert rows_of(sp.select_rows(df, only_type="single", conditions=["x"]), "trial_id") == [("t1",)]
    assert rows_of(sp.select_rows(df, id_prefix="t2", contrasts=["k"], regimes=["naturalistic"]), "trial_id") == [("t2",)]
    assert one(sp.find_trial(df, "t1"))["type"] == "single"


def test_manifest_gates_join_nothing_to_the_expanded_trials(spark):
    """Prompts of forty trials a pair must not go through a join's shuffle."""
    from pairlens.contract import load

    plan = load()[0]["manifest_violations"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().split("\n")
    depth = [len(line) - len(line.lstrip(" :+-")) for line in plan]
    joins = [at for at, line in enumerate(plan) if " Join " in line or "Join Inner" in line]
    assert joins
    for at in joins:
        end = next((k for k in range(at + 1, len(plan)) if depth[k] <= depth[at]), len(plan))
        assert not any("Generate explode" in line for line in plan[at + 1:end])


def test_tasks_of_dealt_rows_follow_their_number(spark):
    from pairlens.operators.ordering import TASK_ROWS, dealt, numbered

    rows = spark.range(100).select(F.lit("k").alias("k"), "id")
    assert dealt(rows, 10, ["id"]).rdd.getNumPartitions() == 8 and dealt(rows, 30 * TASK_ROWS, ["id"]).rdd.getNumPartitions() == 30
    got = numbered(rows, ["k"], ["id"], F.floor(F.col("id") / 10), keys_not_null=True, rows=20 * TASK_ROWS)
    assert "hashpartitioning" in got._jdf.queryExecution().executedPlan().toString() and rows_of(got, "row_number") == [(i,) for i in sorted(range(1, 101), key=lambda n: repr((n,)))]
