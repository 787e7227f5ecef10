"""Mergeable sketches of weighted quantiles.

A sketch is rows: for each key the weight in buckets of values that are alike to a share of their size. It is made by one aggregation with partial sums, merged by adding up, so wells
roll up to fields without their samples, and has as many rows as the values span buckets, however many samples there are. A quantile read from it lies in the very bucket of the exact
one, so it is off by at most the sketch's accuracy times the exact value. The exact way stays zones.weighted_quantiles().
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Added to bucket numbers, so that those of small values are positive too: buckets of both signs and zero are in the order of their values.
MIDDLE = 1 << 24


def _growth(accuracy: float) -> float:
    return (1 + accuracy) / (1 - accuracy)


def bucket(x: Column, accuracy: float) -> Column:
    """The bucket of a value: zero has its own, and those of negative values mirror the others."""
    near = F.ceil(F.log(F.abs(x)) / math.log(_growth(accuracy))).cast("long") + MIDDLE
    return F.when(x > 0, near).when(x < 0, -near).when(x == 0, F.lit(0).cast("long"))


def sketch(rows: DataFrame, value: str, keys: list[str], weight: str = "h", accuracy: float = 0.005) -> DataFrame:
    """(keys, bucket, weight, low, high) of the rows with a value and a positive weight; low and high are the least and greatest value in a bucket."""
    used = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value)) & (F.col(weight) > 0)).withColumn("bucket", bucket(F.col(value), accuracy))
    return used.groupBy(*keys, "bucket").agg(F.sum(weight).alias("weight"), F.min(value).alias("low"), F.max(value).alias("high"))


def merged(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """The sketch of fewer keys (or none), from those of more."""
    return sketches.groupBy(*keys, "bucket").agg(F.sum("weight").alias("weight"), F.min("low").alias("low"), F.max("high").alias("high"))


def quantiles(sketches: DataFrame, keys: list[str], at: tuple[float, ...] = (0.1, 0.5, 0.9), accuracy: float = 0.005) -> DataFrame:
    """(keys, wp10, wp50, ...): a value from the first bucket at which the cumulative weight reaches p of the total."""
    line = W.partitionBy(*keys)
    cum = sketches.withColumns({"_c": F.sum("weight").over(line.orderBy("bucket")), "_t": F.sum("weight").over(line)})
    g = _growth(accuracy)
    size = F.pow(F.lit(g), F.abs("bucket") - MIDDLE) * (2 / (1 + g))
    middle = F.when(F.col("bucket") == 0, 0.0).when(F.col("bucket") > 0, size).otherwise(-size)
    inside = F.struct("bucket", F.least(F.greatest(middle, F.col("low")), F.col("high")).alias("v"))
    return cum.groupBy(*keys).agg(*[F.min(F.when(F.col("_c") >= p * F.col("_t") - 1e-12, inside))["v"].alias(f"wp{int(100 * p)}") for p in at])
