"""Scalar and short-list functions used by features and metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: added to probabilities before clipping, and to softmax weights.
PROB_FLOOR = 1e-7


def positive_class(pair: Column) -> Column:
    """Second entry of a two-class label or score."""
    return F.get(pair, 1)


def clip01(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))


def softmax(values: Column) -> Column:
    """Softmax over a list of doubles, with the small floor added to every weight."""
    top = F.array_max(values)
    powers = F.transform(values, lambda x: F.exp(x - top))
    total = F.aggregate(powers, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(powers, lambda x: x / total + F.lit(PROB_FLOOR))


def tier_bias(eps: float) -> int:
    return int(1 / eps)


def tier_count(eps: float) -> int:
    return 2 * tier_bias(eps) + 2


def tier(cos: Column, eps: float = 0.1) -> Column:
    """Tier number of a similarity: ceil(cos / eps) shifted so that -1 gives 0."""
    return (F.ceil(cos * F.lit(float(round(1 / eps, 9)))) + tier_bias(eps)).cast("int")


def log_count(n: Column, base: float | None = None, add_one: bool = True) -> Column:
    """Logarithm of a count, of count + 1 by default; without it empty counts give 0."""
    value = (n + 1 if add_one else n).cast("double")
    result = F.ln(value) if base is None else F.ln(value) / F.lit(_ln(base))
    return result if add_one else F.when(n > 0, result).otherwise(F.lit(0.0))


def _ln(base: float) -> float:
    import math

    return math.log(base)


def percent_text(share: Column) -> Column:
    return F.format_string("%.2f%%", share * 100)


