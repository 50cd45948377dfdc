"""Total order from pairwise judgements, re-validation of a log, design freezing checks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.functions.answers import with_validation
from pairlens.operators import agreement as agr
from pairlens.operators import collapse as col
from pairlens.operators import quality as q


def reference_ranking(items: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """Unknown ids, contradictions, layers and verdict.

    The layers are the ranking exactly when ``verdict.is_unique`` holds.
    """
    known = edges.join(items.select(F.col("item_id").alias("winner")), "winner", "left_semi").join(
        items.select(F.col("item_id").alias("loser")), "loser", "left_semi"
    )
    layers = agr.order_layers(items, known)
    return {
        "unknown_items": agr.unknown_items(edges, items),
        "contradictions": agr.contradictions(edges),
        "layers": layers,
        "verdict": agr.order_verdict(layers),
    }


def revalidated(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """Re-run the validators over recorded texts.

    Adds ``reparse_status``: rows without text or without metadata pass through
    unchanged.  Write the result to a new location.
    """
    fields = ("type", "choice_mode", "response_format")
    tagged = col.with_metadata(rows, manifest, fields)
    status = (
        F.when(F.col("response_text").isNull(), "no_response_text")
        .when(~F.col("has_metadata"), "unknown_trial_id")
        .otherwise("reparsed")
    )
    checked = with_validation(tagged.withColumn("reparse_status", status), "response_text", answer="__a", error="__e")
    again = F.col("reparse_status") == "reparsed"
    return checked.withColumns(
        {
            "answer": F.when(again, F.col("__a")).otherwise(F.col("answer")),
            "error": F.when(again, F.col("__e")).otherwise(F.col("error")),
        }
    ).drop("__a", "__e", "has_metadata", *fields)


def revalidation_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("reparse_status").agg(
        F.count("*").alias("n"), F.count_if(F.col("error").isNull()).alias("n_valid")
    )


def design_frozen(tables: Mapping[str, DataFrame], lock: DataFrame, status: str) -> bool:
    """Whether the design is marked frozen and none of its tables drifted from the lock."""
    return status == "frozen" and q.drift(q.fingerprints(tables), lock).isEmpty()
