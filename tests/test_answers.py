import json

import pytest
from pyspark.sql import functions as F

from pairlens.functions import answers as ans
from pairlens.functions import scalars as sc
from tests.conftest import one

ACCEPTED = [
    ("A", "A"), ("B", "B"), ("a", "A"), ("A.", "A"), ("  B  ", "B"), ("Passage A", "A"), ("Passage B.", "B"),
    ("I prefer A", "A"), ("I prefer Passage B", "B"), ("A: the ferry scene alone decides it.", "A"), ("**A**", "A"),
    ("`B`", "B"), ('"A"', "A"), ("passage b", "B"), ('{"choice": "A"}', "A"), ('{"overall_quality": "b"}', "B"),
    ('```json\n{"choice": "B"}\n```', "B"), ('```json{"choice": "B"}```', "B"), ("“A”", "A"), (" B　", "B"),
    ('{"overall_quality": " a ", "choice": "B"}', "A"), ("A\nbecause", "A"), ("```\nA\n```", "A"),
]
REJECTED = [
    ("tie", ans.HEDGED), ("Tie.", ans.HEDGED), ("Give both a ribbon", ans.HEDGED), ("neither", ans.HEDGED), ("Not sure which of them", ans.HEDGED),
    ("With this ink, hard to say", ans.HEDGED), ("To my ear about equal in rhythm", ans.HEDGED), ("My desk lamp can't decide and nor do I", ans.HEDGED),
    ("Toss-up", ans.HEDGED), ("A paints livelier cities", ans.HEDGED),
    ("At dusk both lanterns were lit.", ans.HEDGED),
    ("At noon the ferry leaves.", ans.NO_LETTER), ("Bread and salt", ans.NO_LETTER), ("Aé", ans.NO_LETTER), ("", ans.NO_LETTER),
    ('{"choice": "tie"}', ans.JSON_NO_LETTER), ('{"choice": 1}', ans.JSON_NO_LETTER), ("{}", ans.JSON_NO_LETTER),
    ('{"overall_quality": null, "choice": "A"}', ans.JSON_NO_LETTER), ("1", ans.JSON_NOT_OBJECT), ('["A"]', ans.JSON_NOT_OBJECT),
    ("true", ans.JSON_NOT_OBJECT), ('{"choice": "A"', ans.NO_LETTER), ('{"choice": "tie', ans.HEDGED), (None, "no_response_text"),
]


def test_plain_choices(spark):
    cases = [(i, t) for i, (t, _) in enumerate(ACCEPTED + REJECTED)]
    got = {r["i"]: r for r in ans.with_choice(spark.createDataFrame(cases, "i int, t string"), "t").collect()}
    for i, (text, letter) in enumerate(ACCEPTED):
        assert (got[i]["answer"], got[i]["error"]) == (letter, None), text
    for i, (text, code) in enumerate(REJECTED, start=len(ACCEPTED)):
        assert (got[i]["answer"], got[i]["error"]) == (None, code), text


def test_json_must_be_the_whole_text(spark):
    followed = ["4703443633947811 Achtern auf der Bank", '{"choice": "A"} as said', '{"choice": "A"}{"choice": "B"}', '"A" or so', "true story", "1, 2", '1] x', '"x", "y"] z', "[1] [2]", '{"choice": "A"},']
    whole = ['{"choice": "A"}', "12", "[1, 2]", '{"choice": "A"}\n']
    cases = [(i, t) for i, t in enumerate(followed + whole)]
    rows = spark.createDataFrame(cases, "i int, t string")
    got = {r["i"]: r for r in ans.with_choice(rows, "t").collect()}
    documents = {r["i"]: r["__doc"] is not None for r in ans.with_document(rows, "t").collect()}
    for i, text in enumerate(followed):
        assert got[i]["error"] not in (ans.JSON_NOT_OBJECT, ans.JSON_NO_LETTER) and not documents[i], text
        assert got[i]["answer"] == ("A" if text == '"A" or so' else None), text
    for i, text in enumerate(whole, start=len(followed)):
        assert documents[i] and got[i]["error"] in (None, ans.JSON_NOT_OBJECT), text


RATINGS = dict(plot_structure=3, prose_style=4, characterization=5, originality=1, overall_quality=2)
CHOICES = dict(plot_structure="A", prose_style="B", characterisation="A", originality="B", overall_quality="B")


def changed(base, **kw):
    return json.dumps({**base, **kw})


def without(base, key):
    return json.dumps({k: v for k, v in base.items() if k != key})


CASES = [
    ("single", None, None, json.dumps(RATINGS), None),
    ("single", None, None, changed(RATINGS, originality=True), "bad_integer_ratings"),
    ("single", None, None, changed(RATINGS, originality=3.0), "bad_integer_ratings"),
    ("single", None, None, changed(RATINGS, originality=6), "bad_integer_ratings"),
    ("single", None, None, without(RATINGS, "originality"), "bad_integer_ratings"),
    ("single", None, None, "[1]", "bad_integer_ratings"),
    ("context_single", None, None, changed(RATINGS, originality=7.3), None),
    ("context_single", None, None, changed(RATINGS, originality=10), None),
    ("context_single", None, None, changed(RATINGS, originality=7.35), "bad_decimal_ratings"),
    ("context_single", None, None, changed(RATINGS, originality=10.1), "bad_decimal_ratings"),
    ("context_single", None, None, changed(RATINGS, originality="7"), "bad_decimal_ratings"),
    ("context_single", None, None, changed(RATINGS, extra=1), "bad_decimal_ratings"),
    ("comparison", None, None, json.dumps(dict(story_a=RATINGS, story_b=RATINGS, preference=-2)), None),
    ("comparison", None, None, json.dumps(dict(story_a=RATINGS, story_b=RATINGS, preference=0.5)), "bad_preference"),
    ("comparison", None, None, json.dumps(dict(story_a=RATINGS, story_b=RATINGS, preference=3)), "bad_preference"),
    ("comparison", None, None, json.dumps(dict(story_a=RATINGS, story_b={}, preference=0)), "bad_story_b_ratings"),
    ("something_else", None, None, json.dumps(dict(story_a=RATINGS, preference=0)), "bad_comparison_fields"),
    ("context_pairwise", "forced", None, json.dumps(CHOICES), None),
    ("context_pairwise", None, None, changed(CHOICES, originality="tie"), "bad_choice_value"),
    ("context_prompt", "tie_allowed", None, changed(CHOICES, originality="tie"), None),
    ("context_pairwise", "tie_allowed", None, changed(CHOICES, originality="a"), "bad_choice_value"),
    ("context_pairwise", "forced", None, changed(CHOICES, characterization="A"), "bad_choice_fields"),
    ("context_pairwise", "forced", None, "A", "not_json"),
    ("context_pairwise", "forced", "plain_ab", "A", None),
    ("context_pairwise", "forced", None, "```json\n" + json.dumps(CHOICES) + "\n```", None),
    ("context_pairwise", "forced", None, None, "no_response_text"),
]


def test_rubrics(spark):
    df = spark.createDataFrame(
        [(i, *c[:4]) for i, c in enumerate(CASES)], "i int, type string, choice_mode string, response_format string, t string"
    )
    got = {r["i"]: r for r in ans.with_validation(df, "t").collect()}
    for i, case in enumerate(CASES):
        assert got[i]["error"] == case[4], case
        assert (got[i]["answer"] is None) == (case[4] is not None), case
    normal = json.loads(got[17]["answer"])
    assert normal["characterization"] == "A" and "characterisation" not in normal


def test_attempt_status(spark):
    df = spark.createDataFrame(
        [("A", None), (None, "API call failed: 429"), (None, "reads as ambiguous/hedged"), (None, "bad"), (None, None)],
        "answer string, error string",
    )
    got = [r[0] for r in df.select(sc.attempt_status(F.col("answer"), F.col("error"))).collect()]
    assert got == ["valid", "api_error", "refusal", "invalid", "invalid"]
    assert [r[0] for r in df.select(sc.is_retryable(F.col("error"))).collect()] == [False, True, False, False, False]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_peak_windows(spark, zone):
    cases = [
        ("2026-09-14T00:30:00Z", False, "2026-09-14T00:30:00Z"), ("2026-09-14T01:00:00Z", True, "2026-09-14T04:00:00Z"),
        ("2026-09-14T03:59:59Z", True, "2026-09-14T04:00:00Z"), ("2026-09-14T04:00:00Z", False, "2026-09-14T04:00:00Z"),
        ("2026-09-14T05:30:00Z", False, "2026-09-14T05:30:00Z"), ("2026-09-14T06:00:00Z", True, "2026-09-14T10:00:00Z"),
        ("2026-09-14T09:59:59Z", True, "2026-09-14T10:00:00Z"), ("2026-09-14T10:00:00Z", False, "2026-09-14T10:00:00Z"),
        ("2026-09-14T23:59:59Z", False, "2026-09-14T23:59:59Z"), ("2026-09-19T02:00:00Z", False, "2026-09-19T02:00:00Z"),
    ]
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(t,) for t, _, _ in cases], "t string").withColumn("ts", F.to_timestamp("t"))
        sc.require_instant(df, "ts")
        got = df.select("t", sc.is_peak(F.col("ts")), sc.utc_text(sc.next_off_peak(F.col("ts")))).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert [tuple(r) for r in got] == cases
    with pytest.raises(ValueError):
        sc.require_instant(df.withColumn("ts", F.col("ts").cast("timestamp_ntz")), "ts")


def test_ids_and_labels(spark):
    df = spark.createDataFrame([("e", "v", "t", 3)], "e string, v string, t string, r int")
    row = one(
        df.select(
            sc.observation_id(F.col("e"), F.col("v"), F.col("t"), F.col("r")).alias("o"),
            sc.request_id(F.col("t"), F.col("r"), F.lit(None)).alias("q"),
            sc.run_config_id(b=F.lit("x"), a=F.lit(1)).alias("c1"),
            sc.run_config_id(a=F.lit(1), b=F.lit("x")).alias("c2"),
            sc.token_bin(F.lit(99)).alias("bin"),
            sc.estimated_tokens(F.lit("abc")).alias("tok"),
            sc.display_name(F.col("t"), {"t": "Tee"}).alias("name"),
            sc.display_name(F.col("e"), {"t": "Tee"}).alias("other"),
        )
    )
    assert row["o"] == "e::v::t::r3" and row["q"].startswith("r_") and len(row["q"]) == 34
    assert row["c1"] == row["c2"] and len(row["c1"]) == 16
    assert (row["bin"], row["tok"], row["name"], row["other"]) == ("1-99", 1, "Tee", "e")
    labels = [
        (0.0, 0.0, "no_naturalistic_effect"), (0.0, 0.2, "invariance_effect_only"), (0.4, -0.1, "reversed"), (0.4, 0.1, "attenuated"),
        (0.4, 0.0, "attenuated"), (0.4, 0.7, "amplified"), (0.4, 0.4, "unchanged"), (-0.4, -0.3, "unchanged"),
    ]
    got = spark.createDataFrame(labels, "n double, i double, want string").select(
        sc.attenuation_label(F.col("n"), F.col("i")), "want"
    )
    assert all(a == b for a, b in got.collect())
