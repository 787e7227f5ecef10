"""Well data derived from the driver's tables, the same way in Spark and in SQL.

Samples come from lineitem (a well per supplier), wells and their tops from supplier, sparse points and events from part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import depth as D
from ..operators import spread
from ..operators import zones as Z
from ..sources import store


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def parts(spark: SparkSession, sf_dir: str) -> int | None:
    """Partitions that the samples need; their number is read from the footers of the files."""
    return spread.parts(spark, read(spark, sf_dir, "lineitem").count())


def log_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """well_id, idx, md, gr, rhob, nphi, rt, cali; the samples of a well lie in one partition."""
    t = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    n = parts(spark, sf_dir)
    t = t.repartition(n, "l_suppkey") if n else t
    idx = F.row_number().over(W.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")) - 1
    missing = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")
    return t.withColumn("idx", idx.cast("long")).select(
        F.col("l_suppkey").alias("well_id"),
        "idx",
        (5000.0 + 0.5 * F.col("idx")).alias("md"),
        F.when(~missing, F.col("l_quantity") * 4.0).alias("gr"),
        (1.95 + F.abs("l_discount") * 10.0).alias("rhob"),
        (F.abs("l_tax") * 5.0).alias("nphi"),
        (0.2 + F.col("l_extendedprice") / 1000.0).alias("rt"),
        (7.5 + F.col("l_linenumber") * 0.5).alias("cali"),
    )


def wells(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    return s.select(
        F.col("s_suppkey").alias("well_id"),
        F.col("s_name").alias("name"),
        (41.0 + (F.col("s_suppkey") % 17) * 0.01).alias("lat"),
        (-104.0 - (F.col("s_suppkey") % 23) * 0.013).alias("lon"),
        (5000.0 + F.abs("s_acctbal") / 20.0).alias("kb"),
    )


def tops(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("well_id"))
    each = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(o).alias("off")) for n, o in (("Alpha", 30.0), ("Beta", 110.0), ("Gamma", 200.0))])
    t = w.select("well_id", F.explode(each).alias("t")).where("NOT (t.name = 'Beta' AND well_id % 13 = 0)")
    return t.select("well_id", F.col("t.name").alias("name"), (5000.0 + F.col("t.off") + ((F.col("well_id") * 7) % 11).cast("double")).alias("md"))


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = log_samples(spark, sf_dir).where((F.col("idx") % 60) == 0)
    return s.select("well_id", "md", F.least(F.lit(60.0), (F.col("md") - 5000.0) / 5.0).alias("inc"), ((F.col("well_id") * 37) % 360).cast("double").alias("azi"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Core plugs 0.2 off the sample depths."""
    n = read(spark, sf_dir, "supplier").agg(F.count("*").alias("n"), F.min("s_suppkey").alias("low"))
    p = read(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice", "p_brand")
    # one row: the number of wells and the first id
    return p.crossJoin(F.broadcast(n)).select(
        (F.col("low") + F.col("p_partkey") % F.col("n")).alias("well_id"),
        F.col("p_partkey").alias("point_id"),
        (5000.2 + 0.5 * ((F.col("p_partkey") * 7) % 600).cast("double")).alias("md"),
        (F.col("p_retailprice") / 10000.0).alias("core_phi"),
        F.col("p_brand").alias("label"),
    )


def samples_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log_samples(), written: for queries that read them several times."""
    return store.written(log_samples(spark, sf_dir), "samples")


def zones(spark: SparkSession, sf_dir: str, samples: DataFrame | None = None) -> DataFrame:
    return Z.build_zones(Z.extent(log_samples(spark, sf_dir) if samples is None else samples), tops(spark, sf_dir))


def zoned(spark: SparkSession, sf_dir: str, samples: DataFrame | None = None) -> DataFrame:
    """Samples inside zones, with their thickness h."""
    s = (log_samples(spark, sf_dir) if samples is None else samples).withColumn("h", Z.thickness())
    return D.zone_at(s, zones(spark, sf_dir, samples)).where("zone IS NOT NULL")


#: The same tables in SQL, as the head of a WITH clause.
CTE = """
WITH log_samples AS (
  SELECT well_id, idx, CAST(5000 AS DOUBLE) + CAST(0.5 AS DOUBLE) * idx AS md, gr, rhob, nphi, rt, cali FROM (
    SELECT l_suppkey AS well_id,
      row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS idx,
      CASE WHEN NOT (l_returnflag = 'R' AND l_linestatus = 'F') THEN l_quantity * CAST(4 AS DOUBLE) END AS gr,
      CAST(1.95 AS DOUBLE) + abs(l_discount) * CAST(10 AS DOUBLE) AS rhob,
      abs(l_tax) * CAST(5 AS DOUBLE) AS nphi,
      CAST(0.2 AS DOUBLE) + l_extendedprice / CAST(1000 AS DOUBLE) AS rt,
      CAST(7.5 AS DOUBLE) + l_linenumber * CAST(0.5 AS DOUBLE) AS cali
    FROM lineitem)),
wells AS (
  SELECT s_suppkey AS well_id, s_name AS name, CAST(41 AS DOUBLE) + (s_suppkey % 17) * CAST(0.01 AS DOUBLE) AS lat,
    CAST(-104 AS DOUBLE) - (s_suppkey % 23) * CAST(0.013 AS DOUBLE) AS lon, CAST(5000 AS DOUBLE) + abs(s_acctbal) / CAST(20 AS DOUBLE) AS kb
  FROM supplier),
tops AS (
  SELECT s_suppkey AS well_id, name, CAST(5000 AS DOUBLE) + off + CAST((s_suppkey * 7) % 11 AS DOUBLE) AS md
  FROM supplier, (VALUES ('Alpha', CAST(30 AS DOUBLE)), ('Beta', CAST(110 AS DOUBLE)), ('Gamma', CAST(200 AS DOUBLE))) AS t(name, off)
  WHERE NOT (name = 'Beta' AND s_suppkey % 13 = 0)),
stations AS (
  SELECT well_id, md, least(CAST(60 AS DOUBLE), (md - 5000) / CAST(5 AS DOUBLE)) AS inc, CAST((well_id * 37) % 360 AS DOUBLE) AS azi
  FROM log_samples WHERE idx % 60 = 0),
points AS (
  SELECT low + p_partkey % n AS well_id, p_partkey AS point_id, CAST(5000.2 AS DOUBLE) + CAST(0.5 AS DOUBLE) * ((p_partkey * 7) % 600) AS md,
    p_retailprice / CAST(10000 AS DOUBLE) AS core_phi, p_brand AS label
  FROM part, (SELECT count(*) AS n, min(s_suppkey) AS low FROM supplier)),
extent AS (SELECT well_id, min(md) AS start, max(md) AS td FROM log_samples GROUP BY well_id),
inside AS (
  SELECT t.well_id, t.name AS zone, t.md AS top, e.td, row_number() OVER (PARTITION BY t.well_id ORDER BY t.md, t.name) AS zone_no,
    lead(t.md) OVER (PARTITION BY t.well_id ORDER BY t.md, t.name) AS nxt
  FROM tops t JOIN extent e USING (well_id) WHERE t.md > e.start AND t.md < e.td),
zones AS (
  SELECT well_id, zone_no, zone, top, coalesce(nxt, td) AS base FROM inside
  UNION ALL
  SELECT e.well_id, 0, coalesce('Above ' || i.zone, 'Whole well'), e.start, coalesce(i.top, e.td)
  FROM extent e LEFT JOIN inside i ON i.well_id = e.well_id AND i.zone_no = 1),
weighted AS (
  SELECT *, abs(CASE WHEN up IS NOT NULL AND down IS NOT NULL THEN (down - up) / CAST(2 AS DOUBLE) ELSE coalesce(down, md) - coalesce(up, md) END) AS h
  FROM (SELECT *, lag(md) OVER (PARTITION BY well_id ORDER BY md) AS up, lead(md) OVER (PARTITION BY well_id ORDER BY md) AS down FROM log_samples)),
zoned AS (
  SELECT s.*, z.zone, z.zone_no, z.top AS zone_top FROM weighted s JOIN zones z ON z.well_id = s.well_id AND s.md >= z.top AND s.md < z.base)
"""


def rounded(df: DataFrame, *exact: str, digits: int = 6) -> DataFrame:
    """df with its doubles rounded, so that they compare across engines; -0.0 becomes 0.0."""
    return df.select(*[(F.round(F.col(c), digits) + 0.0).alias(c) if t == "double" and c not in exact else F.col(c) for c, t in df.dtypes])
