"""Order over a whole table without bringing it into one partition.

Rows are dealt to ranges of the order (Spark samples the bounds), sorted within each, and written once with their place in their range. How much stands before a range
follows from one number for each range; only those numbers pass the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.store import written

#: Rows of an order that one task looks along; and the bits of monotonically_increasing_id() that hold a row's place in its partition.
STRETCH, PLACE = 1 << 16, 33


def _ranges(df: DataFrame, by: list) -> DataFrame:
    """df, written, with _range and its place in it (_place, from 0)."""
    dealt = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id())
    return written(dealt, "ranges").withColumns({"_range": F.shiftright("_id", PLACE), "_place": F.col("_id").bitwiseAND((1 << PLACE) - 1)}).drop("_id")


def _with_before(rows: DataFrame, amount: Column, name: str) -> tuple[DataFrame, int]:
    """rows with what stands before their range, and the total."""
    sums = sorted((r["_range"], r["s"]) for r in rows.groupBy("_range").agg(F.sum(amount).alias("s")).collect())  # one row for each range
    before, total = [], 0
    for k, s in sums:
        before.append((k, total))
        total += s or 0
    table = rows.sparkSession.createDataFrame(before, f"_range long, {name} {'double' if isinstance(total, float) else 'long'}")
    return rows.join(F.broadcast(table), "_range"), total


def ranked(df: DataFrame, by: list, name: str = "rank") -> DataFrame:
    """df with the place of each row in the order `by` (from 0). The order should be total; rows that tie in it stand in an order that is kept with the result."""
    rows, _ = _with_before(_ranges(df, by), F.lit(1), "_before")
    return rows.withColumn(name, F.col("_before") + F.col("_place")).drop("_range", "_place", "_before")


def running(df: DataFrame, by: list, amount: str, name: str = "upto") -> tuple[DataFrame, int]:
    """df with the sum of `amount` (nulls count nothing) up to and with each row in the order `by`, and the sum over all rows."""
    rows, total = _with_before(_ranges(df, by), F.col(amount), "_before")
    own = W.partitionBy("_range").orderBy("_place")
    return rows.withColumn(name, F.col("_before") + F.coalesce(F.sum(amount).over(own), F.lit(0))).drop("_range", "_place", "_before"), total


def with_next(df: DataFrame, rank: str, columns: dict[str, str], stretch: int = STRETCH) -> DataFrame:
    """df, whose rows are numbered 0, 1, 2 ... by `rank`, with columns of the following row (null for the last): {column: new name}. Stretches of the order are
    looked along one by one; the first row of a stretch is also dealt to the one before."""
    own = F.floor(F.col(rank) / stretch)
    at_border = (F.col(rank) % stretch == 0) & (F.col(rank) > 0)
    dealt = df.withColumn("_stretch", F.explode(F.when(at_border, F.array(own, own - 1)).otherwise(F.array(own))))
    line = W.partitionBy("_stretch").orderBy(rank)
    seen = dealt.withColumns({new: F.lead(c).over(line) for c, new in columns.items()})
    return seen.where(own == F.col("_stretch")).drop("_stretch")
