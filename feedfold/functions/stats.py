"""Interval, agreement and ranking arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z_95 = 1.96


def share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def wilson_bounds(successes: Column, total: Column, z: float = Z_95) -> tuple[Column, Column, Column]:
    """(estimate, lower, upper) of the Wilson score interval; all zero for an empty sample."""
    n = total.cast("double")
    p = share(successes, total)
    z2 = z * z
    scale = 1 + F.try_divide(F.lit(z2), n)
    centre = p + F.try_divide(F.lit(z2), 2 * n)
    half = z * F.sqrt(F.try_divide(p * (1 - p) + F.try_divide(F.lit(z2), 4 * n), n))
    empty = total == 0

    def clamp(bound: Column) -> Column:
        return F.when(empty, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), bound / scale)))

    return p, clamp(centre - half), clamp(centre + half)


def wilson_columns(successes: Column, total: Column, prefix: str = "") -> list[Column]:
    estimate, lower, upper = wilson_bounds(successes, total)
    return [
        successes.cast("bigint").alias(f"{prefix}successes"),
        total.cast("bigint").alias(f"{prefix}total"),
        estimate.alias(f"{prefix}estimate"),
        lower.alias(f"{prefix}lower"),
        upper.alias(f"{prefix}upper"),
    ]


def stable_rank(review_id: Column | str, seed: int) -> Column:
    """Reproducible pseudo-random order key: the digest of seed and id."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col(review_id) if isinstance(review_id, str) else review_id), 256)
