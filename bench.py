"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` (default sf0.1) and ``BENCH_CPUS`` (default 8) choose data and cores;
``BENCH_QUERIES`` (comma separated) narrows the list while iterating.  Each query is run
to completion with the no-op sink; the first is preceded by a small warm-up of the JVM.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "ate_by_contrast", "pair_effects", "directional_effects", "position_interaction", "per_item_effects",
    "leave_one_item_out", "regime_comparison", "label_matrix", "choice_changes", "treatment_deltas", "label_swap_shifts",
    "complete_units", "collapse_attempts", "pending_units", "wave_classification", "merge_waves", "recovery_plan",
    "parse_answers", "parse_texts", "validate_ratings", "avg_ranks_large", "kendall_tau_b_large", "spearman_large",
    "reference_comparison", "bootstrap_ate_ci", "bootstrap_controllability", "bootstrap_slope_ci", "ambiguity_fit",
    "execution_order", "stratified_sample", "pack_requests", "design_blocks", "corpus_profile", "usage_totals",
    "peak_usage", "evaluator_partition", "fingerprint", "stream_ingest",
)


def main() -> None:
    from pairlens.contract import load
    from pairlens.session import build_session, release_held

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load()
    queries["resolved_cells"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        release_held()
        spark.catalog.clearCache()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
