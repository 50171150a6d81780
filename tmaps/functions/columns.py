"""Column helpers (all JVM-side expressions)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_TWO52 = float(2 ** 52)


def norm_col(arr: str) -> Column:
    """sqrt(Σ x²) of an array column."""
    return F.sqrt(F.aggregate(arr, F.lit(0.0), lambda s, x: s + x * x))


def sq_distance_col(a: str, b: str) -> Column:
    """Σ (a_k − b_k)² of two equal-length array columns."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def _unit(*cols) -> Column:
    """Uniform (0, 1) from the first 13 hex digits of an md5 of the keys' text, shifted
    by half a step: any engine with md5 can repeat it."""
    digits = F.substring(F.md5(F.concat_ws(":", *[c.cast("string") for c in cols])), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(_TWO52)


def gaussian_col(seed: int, *keys) -> Column:
    """N(0, 1) that depends only on (seed, keys) — Box-Muller on two hashed
    uniforms — so the start is the same under any partitioning."""
    u1 = _unit(F.lit(int(seed)), F.lit(1), *keys)
    u2 = _unit(F.lit(int(seed)), F.lit(2), *keys)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)
