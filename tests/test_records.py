import pytest
from pyspark.sql import functions as F

from pairlens.operators import collapse as col
from pairlens.operators import gates
from pairlens.operators import recovery as rec
from pairlens.plans import waves
from pairlens.operators.quality import GateError
from tests.conftest import one, rows_of

LOG = "trial_id string, model string, replicate_id int, attempt_id int, ingest_order int, answer string, error string"


def log(spark, rows):
    return spark.createDataFrame(rows, LOG)


def test_last_success_wins_and_failures_are_absorbed(spark):
    rows = [
        ("t", "m", None, None, 1, None, "API call failed: 503"), ("t", "m", 1, 2, 2, "A", None), ("t", "m", 1, 3, 3, None, "bad"),
        ("u", "m", 1, 1, 4, None, "bad"), ("v", "m", 1, 1, 5, "A", None), ("v", "m", 1, 1, 6, "B", None),
    ]
    got = {r["trial_id"]: r for r in col.collapse_attempts(log(spark, rows)).collect()}
    assert (got["t"]["answer"], got["t"]["attempt_id"], got["t"]["absorbed_failures"]) == ("A", 2, 2)
    assert (got["u"]["resolved"], got["u"]["absorbed_failures"]) == (False, 0)
    assert (got["v"]["answer"], got["v"]["absorbed_failures"]) == ("B", 0)
    total = one(col.collapse_totals(col.collapse_attempts(log(spark, rows))))
    assert total.asDict() == dict(raw_attempts=6, completed=2, unresolved=1, absorbed_failures=2)
    numbers = col.next_attempt(log(spark, rows).select("trial_id").distinct().union(spark.createDataFrame([("new",)], "trial_id string")), log(spark, rows), ("trial_id",))
    assert rows_of(numbers, "trial_id", "next_attempt_id") == [("new", 1), ("t", 4), ("u", 2), ("v", 2)]


def test_completion_tolerates_absent_identity_but_not_another_prompt(spark):
    plan = spark.createDataFrame([("t", 1, "h", "p"), ("u", 1, "h", "p"), ("v", 1, "h", "p"), ("w", 1, None, "p")], "trial_id string, replicate_id int, prompt_sha256 string, provider string")
    schema = "trial_id string, replicate_id int, prompt_sha256 string, provider string, answer string, error string"
    done = spark.createDataFrame([("t", 1, "h", None, "A", None), ("u", 1, "old", "p", "A", None), ("v", 1, "h", "q", "A", None), ("w", 1, "x", "p", "A", None), ("w", 1, "x", "p", None, "e")], schema)
    key = ("trial_id", "replicate_id")
    assert rows_of(col.completed(plan, done, key, ("provider",)), "trial_id") == [("t",), ("w",)]
    assert rows_of(col.pending(plan, done, key, ("provider",)), "trial_id") == [("u",), ("v",)]


def test_metadata_prefers_the_row(spark):
    rows = spark.createDataFrame([("t", ("own",)), ("u", None), ("x", None)], "trial_id string, trial_meta struct<type: string>")
    manifest = spark.createDataFrame([("t", "man", "p"), ("u", "man", "p")], "trial_id string, type string, prompt string")
    got = col.with_metadata(rows, manifest, ("type",))
    assert rows_of(got, "trial_id", "type", "has_metadata") == [("t", "own", True), ("u", "man", True), ("x", None, False)]
    assert "prompt" not in got.columns


def test_fold_stops_at_first_valid(spark):
    rows = [("o", 1, "refusal", None), ("o", 2, "valid", "A"), ("o", 3, "valid", "B"), ("p", 1, "api_error", None), ("p", 2, "invalid", None)]
    df = spark.createDataFrame(rows, "observation_id string, attempt_number int, status string, answer string")
    got = {r["observation_id"]: r for r in col.fold_attempts(df, nested=("answer",)).collect()}
    assert (got["o"]["first_valid_response"], got["o"]["total_attempts"], got["o"]["refusal_status"], len(got["o"]["attempts"])) == ("A", 2, True, 2)
    assert (got["p"]["parsing_status"], got["p"]["total_attempts"], got["p"]["api_error_status"]) == ("unresolved", 2, True)


def test_resume_rules(spark):
    plan = spark.createDataFrame([(i,) for i in "abc"], "observation_id string")
    done = spark.createDataFrame([("a", "resolved"), ("b", "unresolved")], "observation_id string, parsing_status string")
    assert rows_of(col.unfinished(plan, done), "observation_id") == [("c",)]
    assert rows_of(col.unfinished(plan, done, valid_only=True), "observation_id") == [("b",), ("c",)]


WAVE = "observation_id string, parsing_status string, recorded_answer string, last_response_text string, arrival int"


def wave(spark, rows):
    return spark.createDataFrame(rows, WAVE)


def test_wave_classes_and_merge(spark):
    planned = spark.createDataFrame([(i, "treatment") for i in "abcdefg"], "observation_id string, unit_kind string")
    first = wave(spark, [
        ("a", "resolved", "A", "Passage A", 1), ("b", "unresolved", None, "tie", 2), ("c", "resolved", "A", "B", 3),
        ("d", "resolved", "A", "A", 4), ("d", "resolved", "A", "I prefer A", 5), ("zz", "resolved", "A", "A", 6), (None, "resolved", "A", "A", 7),
        ("e", "resolved", "A", "A", 8), ("e", "resolved", "B", "A", 9),
    ])
    classes = rec.classify_rows(first, planned)
    assert rows_of(classes, "arrival", "row_class") == [
        (1, "valid"), (2, "unresolved"), (3, "malformed"), (4, "duplicate_valid"), (5, "duplicate_valid"), (6, "unknown"), (7, "unknown"),
        (8, "valid"), (9, "malformed"),
    ]
    again = wave(spark, [("a", "resolved", "B", "B", 1), ("b", "unresolved", None, None, 2), ("b", "resolved", "B", "B", 4), ("b", "resolved", "A", "A", 3), ("q", "resolved", "A", "A", 5), ("c", "resolved", "B", "B", 6)])
    with pytest.raises(GateError):
        waves.merge(planned, first, again, ("recorded_answer",), ("arrival",))
    out = waves.merge(planned, first, again, ("recorded_answer",), ("arrival",), require_consistent=False)
    assert rows_of(out["merged"], "observation_id", "recorded_answer", "result_source") == [
        ("a", "A", "wave1_original"), ("b", "A", "wave2_recovery"), ("c", "B", "wave2_recovery"), ("e", "A", "wave1_original"),
    ]
    d = one(out["diagnostics"])
    assert (d["planned_total"], d["first_wave_retained"], d["recovered"], d["still_unresolved"], d["ids_answered_again"]) == (7, 2, 2, 3, 1)
    assert rows_of(out["recovery_plan"], "execution_order_index", "observation_id") == [(1, "b"), (2, "c"), (3, "d"), (4, "f"), (5, "g")]
    assert not waves.completeness_violations(out["diagnostics"], 7).isEmpty()
    with pytest.raises(GateError, match="nothing_unresolved: found 3, wanted 0"):
        waves.merge(planned, first, again, ("recorded_answer",), ("arrival",), require_consistent=False, expected_total=7)
    checks = {r["check_name"]: (r["found"], r["ok"]) for r in gates.wave_complete(planned, classes, 7, 7, cell="observation_id").collect()}
    assert checks["every_answer_valid"] == (2, False) and checks["no_duplicate_answers"] == (1, False) and checks["planned_count_matches_design"] == (7, True)
    good = wave(spark, [(i, "resolved", "A", "A", 1) for i in "abcdefg"])
    gates.require(gates.wave_complete(planned, rec.classify_rows(good, planned), 7, 7, cell="observation_id"), "wave")
    assert waves.merge(planned, good, again, ("recorded_answer",), ("arrival",), expected_total=7)["merged"].count() == 7


def test_recovery_plans_outside_the_planned_index(spark):
    schema = "observation_id string, trial_id string, replicate_number long"
    planned = spark.createDataFrame([("a", "t", 1), ("b", "t", 2), ("c", "u", None)], schema)
    plan = spark.createDataFrame([("a", "t", 1), ("a", "t", 1), ("b", "t", 3), ("x", "t", 1), (None, "t", 1), ("c", "u", None)], schema)
    assert rows_of(gates.plan_violations(plan, planned), "observation_id", "violation") == sorted([("a", "repeated"), ("b", "other_identity"), ("x", "not_planned"), (None, "not_planned")], key=repr)
    assert gates.plan_violations(planned, planned).isEmpty()


def test_validation_report(spark):
    schema = "observation_id string, answer string, reasoning_tokens int, contrast_id string, instruction_condition string, assignment string, position string, story_1_id string, story_2_id string, story_a_id string, story_b_id string"
    from pairlens.operators.effects import CELLS

    rows = [(f"{a}{p}", "A", t, "k", "matched_control", a, p, "x", "y", *(("x", "y") if p == "story1_as_a" else ("y", "x"))) for t, (a, p) in zip((None, 0, 50, 900), CELLS)]
    originals = spark.createDataFrame(rows, schema)
    reruns = originals.select("observation_id", F.when(F.col("assignment") == "forward", "A").otherwise("B").alias("answer"))
    out = waves.validation_report(originals, reruns)
    overall = one(out["agreement"].where("token_bin IS NULL"))
    assert overall["agreement_rate"] == 0.5 and overall["preference_shift"] == -0.5
    assert {r["token_bin"] for r in out["agreement"].collect()} == {None, "unknown", "0", "1-99", "500+"}
    assert one(out["effects"])["d_pair_original"] == 0.0
