"""Named-label analysis: pairwise effects as an antisymmetric label matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.operators import effects as fx
from pairlens.operators import quality as q
from pairlens.plans.context import categories_of, observations, pairwise_tables


def analyse(
    attempts: DataFrame, manifest: DataFrame, labels: DataFrame, sampling_regime: str, experiment_id: str | None = None
) -> dict[str, DataFrame]:
    """``labels``: (contrast_id, label_a, label_b)."""
    wanted = F.col("has_metadata") & F.col("sampling_regime").eqNullSafe(F.lit(sampling_regime))
    if experiment_id is not None:
        wanted = wanted & (F.col("experiment_id") == experiment_id)
    kept, excluded = q.isolate(observations(attempts, manifest), wanted)
    tables = pairwise_tables(fx.forced_pairwise(categories_of(kept.where("type = 'context_pairwise'"))))
    primary = tables["effects_by_contrast"].where("category = 'overall_quality'")
    return {
        "excluded": excluded,
        **tables,
        "label_matrix": fx.label_matrix(primary, labels, ("model", "evaluation_regime")),
    }
