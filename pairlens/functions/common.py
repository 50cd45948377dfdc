"""Small expression helpers shared by every operator."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rounded(column: Column | str, digits: int = 9) -> Column:
    """Presentation rounding; adding 0.0 turns a negative zero into zero."""
    return F.round(column, digits) + F.lit(0.0)


def counter_draw(*parts: Column | str | int) -> Column:
    """A 60-bit pseudo-random integer that depends only on ``parts``.

    Draws are indexed by their parts (seed, draw, slot, ...) and keep no state, so
    any task can recompute any draw and a lost executor changes nothing.
    """
    text = F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def order_hash(*parts: Column | str | int) -> Column:
    """A hexadecimal sort key that shuffles rows reproducibly."""
    return F.md5(F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Null-safe equality over ``keys``; still an equi-join for the planner."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` with NULL = NULL, keeping one copy of each key (the left one)."""
    renamed = right.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in right.columns if c not in keys])
    condition = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    joined = left.join(renamed, condition, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"__{k}" for k in keys])


def share(flag: Column) -> Column:
    """Mean of a boolean column, NULL over no rows."""
    return F.avg(flag.cast("double"))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that is NULL, not an error, over a zero denominator."""
    return numerator.cast("double") / F.nullif(denominator.cast("double"), F.lit(0.0))
