"""Numeric functions as Column expressions: vectors, quotas, hashed choice, clipping, blending."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 where a norm is 0 or a component isn't finite."""
    value = F.try_divide(dot(a, b), norm(a) * norm(b))
    return F.when(value.isNull() | F.isnan(value), F.lit(0.0)).otherwise(value)


def unit(a: Column, epsilon: float = 1e-8) -> Column:
    """The vector over its norm plus epsilon, non-finite components as 0."""
    clean = F.transform(a, lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x.cast("double")))
    size = norm(clean) + epsilon
    return F.transform(clean, lambda x: x / size)


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def blend(clean: Column, degraded: Column, strength: Column) -> Column:
    """Element by element, clean * (1 - strength) + degraded * strength."""
    return F.zip_with(clean, degraded, lambda c, d: c * (1 - strength) + d * strength)


def linear_tone(pixels: Column, scale: Column, offset: Column) -> Column:
    return F.transform(pixels, lambda x: clip(x * scale + offset, 0.0, 255.0))


def fit_scale(width: Column, height: Column, longest: int) -> Column:
    """The factor that brings the longer side to `longest` at most; 1 where longest is 0."""
    return F.lit(1.0) if longest <= 0 else F.least(F.lit(1.0), F.lit(float(longest)) / F.greatest(width, height))


def hashed_uniform(*keys: Column | str | int) -> Column:
    """A uniform number in [0, 1) that depends on the keys alone; SQL: ('0x' || left(md5(k1 || ':' || k2 ...), 13)) / 2^52."""
    text = F.concat_ws(":", *((k if isinstance(k, Column) else F.lit(k)).cast("string") for k in keys))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def hashed_pick(size: Column | int, *keys: Column | str | int) -> Column:
    """A 0-based index below size that depends on the keys alone."""
    return F.floor(hashed_uniform(*keys) * size).cast("int")


def largest_remainder(weights: DataFrame, total: int, weight: str = "weight", order: str = "ord") -> DataFrame:
    """weights with `quota`: floors of the real shares, and what is left over one by one to the largest fractions, ties to
    the smaller `order`. The table of weights is a small dimension: one window over it all."""
    every = Window.partitionBy(F.lit(0))
    share = F.col(weight).cast("double") / F.sum(F.col(weight).cast("double")).over(every) * total
    shared = weights.withColumn("_share", share).withColumn("_floor", F.floor("_share"))
    left = F.lit(total) - F.sum("_floor").over(every)
    rank = F.row_number().over(every.orderBy(F.desc(F.col("_share") - F.col("_floor")), order))
    return shared.withColumn("quota", (F.col("_floor") + F.when(rank <= left, 1).otherwise(0)).cast("long")).drop("_share", "_floor")
