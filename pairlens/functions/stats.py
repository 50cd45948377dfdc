"""Aggregate expressions for correlation and least squares."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pearson(x: Column, y: Column) -> Column:
    """Pearson correlation, NULL over no rows or a constant side.

    Built from the mergeable central moments, so it is one pass and combines
    map-side; the bare ``corr`` would divide by zero on a constant column.
    """
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    constant = (F.min(a) == F.max(a)) | (F.min(b) == F.max(b))
    spread = F.sqrt(F.var_pop(a) * F.var_pop(b))
    return F.when(~constant, F.covar_pop(a, b) / F.nullif(spread, F.lit(0.0)))


def slope_intercept(
    w: Column, wx: Column, wy: Column, wxx: Column, wxy: Column
) -> tuple[Column, Column]:
    """Weighted least squares of y on x from weighted sums; NULL when undetermined."""
    total = F.nullif(w, F.lit(0.0))
    mean_x, mean_y = wx / total, wy / total
    sxx = wxx - wx * mean_x
    # Relative guard: sums of a constant x leave rounding noise instead of an exact zero.
    usable = F.when(sxx > F.greatest(F.abs(wxx), F.lit(1e-300)) * 1e-12, sxx)
    slope = (wxy - wx * mean_y) / usable
    return slope, mean_y - slope * mean_x
