"""Vector columns: quantisation and in-row products."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: int8 code of 1.0; stored vectors are value * QUANT_LEVELS cut toward zero.
QUANT_LEVELS = 127


def quantise(vec: Column) -> Column:
    """float32 vector to int8: clip to [-1, 1], times 127 in float32, cut toward zero."""
    one = F.lit(1.0).cast("float")
    return F.transform(
        vec,
        lambda x: (
            F.greatest(-one, F.least(one, x.cast("float"))) * F.lit(float(QUANT_LEVELS)).cast("float")
        ).cast("tinyint"),
    )


def dequantise(vec: Column) -> Column:
    """int8 vector back to float32."""
    return F.transform(
        vec, lambda x: (x.cast("float") / F.lit(float(QUANT_LEVELS)).cast("float")).cast("float")
    )


def dot(a: Column, b: Column) -> Column:
    """Inner product in double. Exact for int8 input; meant for short vectors and checks."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def normalise(vec: Column) -> Column:
    """Vector scaled to length 1; a zero vector stays zero."""
    length = F.sqrt(dot(vec, vec))
    return F.transform(
        vec, lambda x: F.when(length == 0, F.lit(0.0)).otherwise(F.try_divide(x.cast("double"), length))
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, 0 when either is zero."""
    product = dot(a, b)
    return F.when(product == 0, F.lit(0.0)).otherwise(
        F.try_divide(product, F.sqrt(dot(a, a) * dot(b, b)))
    )


def rank_value(cos: Column) -> Column:
    """Ranking value of a similarity: exact zeros sort below every real similarity."""
    return F.when(cos == 0, F.lit(-1.1)).otherwise(cos)


def sorted_similarities(cos: Column) -> Column:
    """Similarities with their positions, best first, newest first on ties."""
    pairs = F.transform(cos, lambda c, i: F.struct(c.alias("cos"), i.alias("pos")))
    return F.sort_array(pairs, False)
