"""Points close to each other: the greedy choice of centres in a given order, as joins of blocks.

In their order, a point that lies within the radius of an earlier centre joins the earliest such centre; any other becomes a centre. That is the first maximal independent
set of the order, and it is found in rounds: a point is a centre as soon as no undecided earlier point is near, and then all that are near it are decided.

Cells are so small that all points of a cell are near each other. So a cell can hold one centre at most, and only its first undecided point can be one: a round joins one
candidate of each cell with the points of its block of cells, never the points of a crowded cell with each other. Points are dealt once a round, to their block and to those that their radius
reaches into, so that a block decides alone which of its candidates are centres. Points in one place are one. The
number of rounds is that of the longest chain of decisions that wait for each other: a few for points in any but a spatial order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.store import written
from .spread import dealt, parts

#: Cells on a side of a block.
BLOCK = 16


def _cell(c: str, radius: float) -> Column:
    # a little less than the side of a square whose diagonal is the radius
    return F.floor(F.col(c) / (radius / math.sqrt(2) * (1 - 1e-9)))


def _block(cell: Column) -> Column:
    return F.floor(cell / BLOCK)


def _around(df: DataFrame, x: str, y: str, radius: float) -> DataFrame:
    """Each row once for each block (_bx, _by) that its radius may reach: those of the 25 cells about its own."""
    ends = [F.array_distinct(F.array(*[_block(_cell(c, radius) + k) for k in (-2, 2)])) for c in (x, y)]
    return df.withColumn("_bx", F.explode(ends[0])).withColumn("_by", F.explode(ends[1]))


def _own(x: str, y: str, radius: float) -> Column:
    return (F.col("_bx") == _block(_cell(x, radius))) & (F.col("_by") == _block(_cell(y, radius)))


def _near(radius: float) -> Column:
    dx, dy = F.col("_x") - F.col("_ox"), F.col("_y") - F.col("_oy")
    return F.sqrt(dx * dx + dy * dy) < radius


def _joined(left: DataFrame, right: DataFrame, on: list[str], radius: float, how: str) -> DataFrame:
    """left with the rows of right (_ox, _oy and more) in the same block that lie within the radius."""
    right = right.select(*[F.col(c).alias(f"_r{k}") for k, c in enumerate(on)], *[c for c in right.columns if c not in on])
    match = _near(radius)
    for k, c in enumerate(on):
        match &= F.col(c) == F.col(f"_r{k}")
    return left.join(right, match, how)


def close_groups(points: DataFrame, radius: float, keys: tuple[str, ...] = (), order: str = "point_id", x: str = "x", y: str = "y") -> DataFrame:
    """points with `centre`, the `order` value of the centre that each belongs to (its own, if it is one). Points without position (null, NaN or infinite) or with a null key have none.
    `order` must be unique for each key."""
    spark, names = points.sparkSession, [f"_k{k}" for k in range(len(keys))]
    given = [F.col(k).alias(n) for k, n in zip(keys, names)]
    has = F.lit(True)
    for c in (x, y):
        has &= F.col(c).isNotNull() & (F.abs(F.col(c)) < math.inf)
    for k in keys:
        has &= F.col(k).isNotNull()
    rows = written(points.select(*given, F.col(order).alias("_id"), F.when(has, F.col(x).cast("double")).alias("_x"), F.when(has, F.col(y).cast("double")).alias("_y"), F.struct(*points.columns).alias("_row")), "points")
    n, on = parts(spark, rows.count()), [*names, "_bx", "_by"]
    open_, centres = rows.where("_x IS NOT NULL").select(*names, "_id", "_x", "_y"), None
    while True:
        some = dealt(_around(open_, "_x", "_y", radius), n, *on).groupBy(*on, "_x", "_y").agg(F.min("_id").alias("_id"))
        cell = W.partitionBy(*on, _cell("_x", radius), _cell("_y", radius)).orderBy("_id")
        first = some.where(_own("_x", "_y", radius)).withColumn("_n", F.row_number().over(cell)).where("_n = 1").select(*on, F.col("_id").alias("_centre"), F.col("_x").alias("_ox"), F.col("_y").alias("_oy"))
        # no undecided point near a new centre is earlier than itself
        new = _joined(some, first, on, radius, "inner").groupBy(*on, "_centre").agg(F.min("_id").alias("_low"), F.first("_ox").alias("_ox"), F.first("_oy").alias("_oy")).where("_low = _centre")
        reach = dealt(_around(new.select(*names, "_centre", "_ox", "_oy"), "_ox", "_oy", radius), n, *on)
        by = _joined(some.where(_own("_x", "_y", radius)), reach, on, radius, "left").groupBy(*on, "_id", "_x", "_y").agg(F.min("_centre").alias("_to"), F.coalesce(F.max(F.col("_centre") == F.col("_id")), F.lit(False)).alias("_is"))
        done = written(by.select(*names, "_id", "_x", "_y", F.col("_is").alias("_chosen"), F.col("_to").isNull().alias("_left")), "decided")
        new = done.where("_chosen").select(*names, F.col("_id").alias("_centre"), F.col("_x").alias("_ox"), F.col("_y").alias("_oy"))
        centres = new if centres is None else centres.unionByName(new)
        open_ = done.where("_left").select(*names, "_id", "_x", "_y")
        left = open_.count()
        if not left:
            break
        n = parts(spark, left)
    n = parts(spark, rows.count())
    reach = dealt(_around(centres, "_ox", "_oy", radius), n, *on)
    # rows without position are dealt by what they have
    placed = dealt(rows.withColumns({"_bx": _block(_cell("_x", radius)), "_by": F.coalesce(_block(_cell("_y", radius)), F.xxhash64("_id"))}), n, *on)
    found = _joined(placed, reach, on, radius, "left").groupBy(*on, "_id").agg(F.first("_row").alias("_row"), F.min("_centre").alias("centre"))
    return found.select("_row.*", "centre")


def merge_close(points: DataFrame, radius: float, keys: tuple[str, ...] = ("surface_id",), order: str = "point_id", value: str = "v") -> DataFrame:
    """(keys, order, x, y, value, n): one point for each centre, at its place, with the mean value of all that belong to it. Points without position or value are left out."""
    rows = close_groups(points.where(F.col(value).isNotNull()).select(*keys, order, "x", "y", value), radius, keys, order).where("centre IS NOT NULL")
    own = F.when(F.col(order) == F.col("centre"), F.struct("x", "y"))
    return rows.groupBy(*keys, F.col("centre").alias(order)).agg(F.max(own).alias("at"), F.avg(value).alias(value), F.count("*").alias("n")).select(*keys, order, "at.x", "at.y", value, "n")
