"""Partitions whose size doesn't grow with the table.

A shuffle has as many partitions as the session says, so what one task sorts grows with the input. Here the number follows from the rows: no task gets more than about ROWS
of them, unless one key has more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

#: Rows of a table that one task is dealt, about.
ROWS = 1 << 19


def parts(spark: SparkSession, rows: int) -> int | None:
    """How many partitions a table of so many rows needs; None where the session's number is enough."""
    n = -(-rows // ROWS)
    return n if n > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def dealt(df: DataFrame, n: int | None, *by: str | Column) -> DataFrame:
    """df with the rows of each key in one of n partitions: windows, sums and joins by these keys need no further shuffle."""
    return df.repartition(n, *by) if n else df.repartition(*by)
