import json
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from pairlens import schemas
from pairlens.contract import planning as pl
from pairlens.operators import quality as q
from pairlens.operators.effects import CELLS, POSITIONS
from pairlens.plans import context, controllability_v1, controllability_v2, labels, pilot, reference
from pairlens.session import fresh_path
from pairlens.sources import readers, writers
from tests.conftest import one, rows_of

RATINGS = dict(plot_structure=3, prose_style=4, characterization=5, originality=1, overall_quality=2)


def jsonl(spark, rows):
    path = fresh_path(spark, "log")
    spark.createDataFrame([(json.dumps(r),) for r in rows], "value string").coalesce(1).write.text(path)
    return path


def test_pilot(spark):
    def answer(pref, a=0):
        return dict(story_a={k: v % 5 + 1 + (a if k == "originality" else 0) for k, v in RATINGS.items()}, story_b=RATINGS, preference=pref)

    rows = [
        dict(trial_id="comparison__x__y__self_vs_ai", model="m", replicate_id=1, attempt_id=1, parsed_response=None, validation_error="bad"),
        dict(trial_id="comparison__x__y__self_vs_ai", model="m", replicate_id=1, attempt_id=2, parsed_response=answer(1), validation_error=None),
        dict(trial_id="comparison__x__y__ai_vs_self", model="m", parsed_response=answer(0, 1), validation_error=None),
        dict(trial_id="comparison_control__x__neutral", model="m", parsed_response=answer(0), validation_error=None),
        dict(trial_id="single__x__neutral__rating", model="m", parsed_response=RATINGS, validation_error=None),
        dict(trial_id="odd", model="m", parsed_response=RATINGS, validation_error=None),
    ]
    out = pilot.analyse(readers.read_attempts(spark, jsonl(spark, rows)))
    assert one(out["totals"]).asDict() == dict(raw_attempts=6, completed=5, unresolved=0, absorbed_failures=1)
    assert rows_of(out["unrecognised_ids"], "trial_id") == [("odd",)]
    assert one(out["provenance_swaps"])["shift"] == 1
    assert one(out["control_summary"].where("condition IS NULL"))["tie_pct"] == 100.0
    means = {r["dimension"]: r["mean_ai_minus_other"] for r in out["rating_effect_means"].collect()}
    assert means == {**dict.fromkeys(RATINGS, 0.0), "originality": 0.5}
    wide = one(out["observation_summary"].where("trial_type = 'single'"))
    assert wide["a_characterization"] == 5 and wide["b_characterization"] is None and wide["preference"] is None
    target = fresh_path(spark, "csv")
    writers.write_tables({"swaps": out["provenance_swaps"], "controls": out["control_summary"]}, target)
    assert spark.read.option("header", True).csv(f"{target}/controls").count() == 2


def pair_trials(prefix, pair, contrast, regime, experiment, baseline=False):
    for a, p in CELLS if not baseline else [(None, p) for p in POSITIONS]:
        shown = pair if p == "story1_as_a" else pair[::-1]
        block = f"{prefix}__{contrast}__{pair[0]}_vs_{pair[1]}__{regime}"
        yield dict(
            trial_id=f"{block}__{a}__{p}", block_id=block, type="context_pairwise", choice_mode="forced", response_format="plain_ab",
            contrast_id=contrast, dimension="d", story_1_id=pair[0], story_2_id=pair[1], story_a_id=shown[0], story_b_id=shown[1],
            **({"assignment": a} if a else {}), position=p, evaluation_regime=regime, experiment_id=experiment, prompt="x",
        )


def favour_a(trial, strong=True):
    """Prefer the item that carries value a, otherwise item 1."""
    holder = trial["story_1_id"] if trial.get("assignment", "forward") == "forward" or not strong else trial["story_2_id"]
    return "A" if holder == trial["story_a_id"] else "B"


def attempt(trial, answer, replicate=1, **extra):
    return dict(
        trial_id=trial["trial_id"], model="m", provider="p", requested_model="m", replicate_id=replicate, attempt_id=1,
        sampling_regime="provider_default_secondary", response_text=answer, parsed_response={"overall_quality": answer} if len(answer) == 1 else json.loads(answer),
        validation_error=None, **extra,
    )


PAIRS = list(combinations(["s1", "s2", "s3"], 2))


def test_controllability_v1(spark):
    treat = [t for p in PAIRS for r in ("naturalistic", "text_only_invariance") for t in pair_trials("block", p, "k", r, "e1")]
    blind = [t for p in PAIRS for t in pair_trials("base", p, "no_context_baseline", "naturalistic", "b1", baseline=True)]

    def log(trials, strong):
        rows = [attempt(t, favour_a(t, strong(t))) for t in trials]
        for r in rows:
            r["parsed_response"] = r["response_text"]
        return readers.read_attempts(spark, jsonl(spark, rows))

    out = controllability_v1.analyse(
        log(treat, lambda t: t["evaluation_regime"] == "naturalistic"), readers.read_trials(spark, jsonl(spark, treat)),
        log(blind, lambda t: False), readers.read_trials(spark, jsonl(spark, blind)),
        "provider_default_secondary", ("e1", "b1"), {"k": "shown name"},
    )
    row = one(out["suppression"])
    assert (row["effect_naturalistic"], row["effect_text_only_invariance"], row["suppression_magnitude"], row["attenuation"], row["context"]) == (1.0, 0.0, 1.0, "attenuated", "shown name")
    assert one(out["unit_counts"]).asDict() == dict(n_complete=6, n_incomplete=0)
    assert {r["baseline_margin"] for r in out["baseline_margin"].collect()} == {1.0}
    assert all(r["r_margin_vs_abs_effect"] is None for r in out["margin_correlation"].collect())
    assert all(r["valid_rate"] == 1.0 for r in out["compliance"].collect()) and out["mixed_identity"].isEmpty()


def test_context_and_labels(spark):
    pairwise = [t for p in PAIRS for t in pair_trials("block", p, "k", "naturalistic", "x")]
    for t in pairwise:
        t.pop("response_format")
    singles = [
        dict(trial_id=f"context_single__{s}__{c}__naturalistic", type="context_single", story_id=s, dimension=d, value=c, condition_id=c, evaluation_regime="naturalistic")
        for s in ("s1", "s2", "s3") for c, d in (("neutral", "neutral"), ("v1", "sig"))
    ]
    prompt = [dict(trial_id=f"cp__{v}", type="context_prompt", story_a_id="s1", story_b_id="s2", contrast_id="p0", value=v, prompt_context_text=t, evaluation_regime="naturalistic", choice_mode="forced") for v, t in (("none", ""), ("aside", "x"))]

    def five(letter):
        return json.dumps({f: letter for f in RATINGS})

    rows = [attempt(t, five(favour_a(t))) for t in pairwise] + [attempt(t, five("A" if t["value"] == "none" else "B")) for t in prompt]
    rows += [attempt(t, json.dumps({f: 5.0 + i + (t["dimension"] != "neutral") for f in RATINGS})) for i, t in enumerate(singles)]
    rows += [attempt(dict(trial_id="gone"), five("A"))]
    attempts, manifest = readers.read_attempts(spark, jsonl(spark, rows)), readers.read_trials(spark, jsonl(spark, pairwise + singles + prompt))
    ranking = spark.createDataFrame([(["s1", "s2", "s3"],)], "ranking array<string>")
    edges = spark.createDataFrame([("s1", "s2"), ("s3", "s2")], "winner string, loser string")
    out = context.analyse(attempts, manifest, "provider_default_secondary", ranking, edges)
    assert rows_of(out["missing_metadata"], "trial_id") == [("gone",)]
    assert {r["mean_effect"] for r in out["effects_by_contrast"].collect()} == {1.0} and out["effects_by_contrast"].count() == 5
    assert {r["delta"] for r in out["treatment_deltas"].collect()} == {2.0}
    overall = one(out["pairwise_change_rates"].where("grouped_by = ''"))
    assert overall["change_rate"] == 1.0
    assert {r["changed"] for r in out["prompt_changes"].collect()} == {True} and out["prompt_changes"].count() == 5
    compared = {r["value"]: r["kendall_tau_b"] for r in out["single_reference_comparison"].collect()}
    assert compared == {"neutral": pytest.approx(-1.0), "v1": pytest.approx(-1.0)}
    assert one(out["reference_agreement"])["concordant_rate"] == 0.5
    assert {r["rank_position"] for r in out["pairwise_rankings"].collect()} == {2.0}
    assert out["regime_comparison"].isEmpty() and out["tie_rates"].isEmpty()
    names = spark.createDataFrame([("k", "L1", "L2")], "contrast_id string, label_a string, label_b string")
    matrix = labels.analyse(attempts, manifest, names, "provider_default_secondary", "x")["label_matrix"]
    assert rows_of(matrix, "row_label", "column_label", "directional_effect") == [("L1", "L1", 0.0), ("L1", "L2", 1.0), ("L2", "L1", -1.0), ("L2", "L2", 0.0)]


CONFIG = dict(
    design_version="v2", experiment_id="x", corpus_id="c", primary_evaluator=dict(evaluator_id="ev", provider="p", requested_model="m", reasoning_profile="low", role="primary"),
    replication_evaluators=[dict(evaluator_id="ev2", provider="p2", requested_model="m2", reasoning_profile="low", role="replication")], treatment_replicate_count=2,
    baseline_replicate_count=2, random_seed=1, bootstrap_draws=30, equivalence_margin=0.05, retry_limit=3, status="frozen",
)


def result(kind, meta, replicate, answer, provider="p", version="v1"):
    model = {"p": "m", "p2": "m2"}.get(provider, "m")
    n = f"{meta['story_1_id']}{meta['story_2_id']}{meta['position']}{meta.get('assignment')}{meta['instruction_condition']}{meta.get('contrast_id')}{provider}{version}"
    return dict(
        observation_id=f"{n}::r{replicate}", trial_id=n, replicate_number=replicate,
        **({"superblock_id": "sb" + meta["story_1_id"] + meta["story_2_id"]} if kind == "treatment" else {"block_id": "bl" + meta["story_1_id"] + meta["story_2_id"]}),
        evaluator=dict(provider=provider, requested_model=model, reasoning_profile="low"), trial_meta=meta, parsing_status="resolved",
        first_attempt_status="valid", first_valid_response=dict(overall_quality=answer),
        attempts=[dict(attempt_number=1, status="valid", response_text=answer, response_model=version, input_tokens=10, output_tokens=1)],
    )


def v2_rows(provider="p", version="v1", pairs=tuple(combinations("abcde", 2))):
    for s1, s2 in pairs:
        for r in (1, 2):
            for c in ("matched_control", "text_only"):
                base = dict(story_1_id=s1, story_2_id=s2, instruction_condition=c)
                for a, p in CELLS:
                    shown = (s1, s2) if p == "story1_as_a" else (s2, s1)
                    meta = dict(**base, contrast_id="k", assignment=a, position=p, story_a_id=shown[0], story_b_id=shown[1])
                    yield result("treatment", meta, r, favour_a(meta, c == "matched_control"), provider, version)
                for p in POSITIONS:
                    shown = (s1, s2) if p == "story1_as_a" else (s2, s1)
                    yield result("baseline", dict(**base, position=p, story_a_id=shown[0], story_b_id=shown[1]), r, "A" if r == 1 else ("A" if shown[0] == s1 else "B"), provider, version)


def test_controllability_v2(spark):
    rows = list(v2_rows()) + list(v2_rows("p2", "w1", [("a", "b")])) + list(v2_rows("p2", "w2", [("a", "c")])) + list(v2_rows("zz", "v", [("a", "b")]))
    results = readers.read_results(spark, jsonl(spark, rows))
    path = fresh_path(spark, "config")
    spark.createDataFrame([(json.dumps(CONFIG),)], "value string").coalesce(1).write.text(path)
    config = readers.read_study_config(spark, path)
    assert config.primary.evaluator_id == "ev" and config.settings("baseline")["replicates"] == 2
    prices = spark.createDataFrame([("p", "m", 0.1, 1.0, 2.0)], "provider string, requested_model string, cache_hit_input double, cache_miss_input double, output double")
    out = controllability_v2.analyse(results, config, frozen=True, rates=prices)
    assert out["unmatched_rows"].count() == 24
    assert rows_of(out["mixed_versions"], "evaluator_id") == [("ev2",)]
    ates = {(r["partition_id"], r["instruction_condition"]): r["ate"] for r in out["cue_ates"].collect()}
    assert ates[("ev", "matched_control")] == 1.0 and ates[("ev", "text_only")] == 0.0 and ("ev2#w1", "text_only") in ates
    verdict = {r["partition_id"]: r["verdict"] for r in out["equivalence_results"].collect()}
    assert verdict["ev"] == "practically_invariant"
    interval = one(out["controllability_intervals"].where("partition_id = 'ev' AND measure = 'magnitude_reduction'"))
    assert interval["ci_95_lo"] == interval["ci_95_hi"] == 1.0
    assert {r["n_complete"] for r in out["unit_counts"].where("partition_id = 'ev'").collect()} == {20}
    assert out["incomplete_units"].isEmpty() and out["leave_one_story_out"].where("partition_id = 'ev'").count() == 10
    assert one(out["cost_summary"].where("partition_id = 'ev'"))["is_priced"]
    assert one(out["evaluator_inventory"].where("partition_id = 'ev'"))["response_models"] == {"v1": 240}
    assert {r["instruction_only_effect"] for r in out["instruction_only_pair_effects"].collect()} == {0.0}
    with pytest.raises(q.GateError):
        controllability_v2.analyse(results, config, frozen=True, strict=True)
    documents = writers.headline(out["controllability_points"], out["equivalence_results"], out["unit_counts"])
    body = json.loads(one(documents.where("partition_id = 'ev'"))["document"])
    assert body["controllability_effects"][0]["ate_control"] == 1.0 and body["equivalence_results"][0]["verdict"] == "practically_invariant"


def test_revalidation(spark):
    manifest = spark.createDataFrame([("t", "context_pairwise", "forced", "plain_ab")], "trial_id string, type string, choice_mode string, response_format string")
    rows = spark.createDataFrame([("t", "I prefer B.", None, "old"), ("t", None, None, "API call failed: x"), ("gone", "A", None, "old")], "trial_id string, response_text string, answer string, error string")
    out = reference.revalidated(rows, manifest)
    assert rows_of(out, "reparse_status", "answer", "error") == [("no_response_text", None, "API call failed: x"), ("reparsed", "B", None), ("unknown_trial_id", None, "old")]
    assert {r["reparse_status"]: r["n_valid"] for r in reference.revalidation_counts(out).collect()} == {"reparsed": 1, "no_response_text": 0, "unknown_trial_id": 0}


def test_reference_ranking_and_freeze(spark):
    items = spark.createDataFrame([("a",), ("b",), ("c",)], "item_id string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "zz")], "winner string, loser string")
    out = reference.reference_ranking(items, edges)
    assert one(out["verdict"])["is_unique"] and rows_of(out["unknown_items"], "item_id") == [("zz",)]
    lock = q.fingerprints({"items": items})
    assert reference.design_frozen({"items": items}, lock, "frozen") and not reference.design_frozen({"items": items}, lock, "draft")
    assert not reference.design_frozen({"items": items.limit(1)}, lock, "frozen")


def test_readers(spark):
    path = fresh_path(spark, "dims")
    lines = [
        dict(dimension="provenance", scope="story", values=dict(self="I wrote this.")),
        dict(dimension="writer_status", scope="story", depends_on="provenance", applies_when=["self"], values=dict(first=dict(self="It is my first."))),
    ]
    spark.createDataFrame([(json.dumps(r),) for r in lines] + [("",)], "value string").coalesce(1).write.text(path)
    dims = readers.read_dimensions(spark, path)
    assert rows_of(dims, "dimension", "value_id", "parent_value", "phrase") == [("provenance", "self", None, "I wrote this."), ("writer_status", "first", "self", "It is my first.")]
    from pairlens.operators.design import single_variable_conditions

    assert ("writer_status__first", "I wrote this. It is my first.") in rows_of(single_variable_conditions(dims), "condition_id", "context_text")
    assert readers.read_optional(spark, fresh_path(spark, "absent"), schemas.EDGES).isEmpty()
    with pytest.raises(FileNotFoundError):
        readers.read_required(spark, [path, fresh_path(spark, "absent")], schemas.EDGES)
    bad = fresh_path(spark, "bad")
    spark.createDataFrame([('{"winner": "a", "loser": "b"}',), ("{oops",)], "value string").coalesce(1).write.text(bad)
    kept = readers.read_jsonl(spark, bad, schemas.EDGES, keep_corrupt=True).cache()
    assert kept.where("_corrupt_record IS NOT NULL").count() == 1
    with pytest.raises(Exception):
        readers.read_jsonl(spark, bad, schemas.EDGES).collect()


def test_items_and_delimiters(spark, tmp_path):
    folder = tmp_path / "texts"
    folder.mkdir()
    (folder / "a.txt").write_text("  one text\n")
    (folder / "b.txt").write_text('has """ inside')
    manifest = tmp_path / "items.jsonl"
    manifest.write_text('{"id": "a", "path": "texts/a.txt"}\n\n{"id": "b", "path": "texts/b.txt"}\n')
    items = readers.read_items(spark, str(manifest), str(tmp_path))
    assert rows_of(items, "item_id", "text") == [("a", "one text"), ("b", 'has """ inside')]
    assert rows_of(readers.delimiter_rejects(items), "item_id") == [("b",)]


def test_merged_output_is_split(spark):
    df = spark.createDataFrame([("a", "treatment"), ("b", "baseline")], "observation_id string, unit_kind string")
    path = fresh_path(spark, "merged")
    writers.split_by_unit_kind(df, path)
    assert spark.read.parquet(path + "/unit_kind=baseline").count() == 1
    writers.append_results(df, fresh_path(spark, "log"), "json")
