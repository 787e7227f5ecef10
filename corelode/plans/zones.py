"""Queries over zones and their statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import petro as P
from ..operators import depth as D
from ..operators import interpret as I
from ..operators import sketch as K
from ..operators import spread
from ..operators import zones as Z
from ..sources import store
from . import base as B
from .petrophysics import BASELINES, INTERPRETED, d

QUERIES, SQL = {}, {}


def zones(spark, sf_dir):
    return B.zones(spark, sf_dir).withColumn("zone_no", F.col("zone_no").cast("long"))


def zone_assign(spark, sf_dir):
    return B.zoned(spark, sf_dir).select("well_id", "idx", "zone", F.col("zone_no").cast("long").alias("zone_no"))


def sample_weights(spark, sf_dir):
    return B.log_samples(spark, sf_dir).select("well_id", "idx", Z.thickness().alias("h"))


SQL["zones"] = B.CTE + "SELECT well_id, CAST(zone_no AS BIGINT) AS zone_no, zone, top, base FROM zones"
SQL["zone_assign"] = B.CTE + "SELECT well_id, idx, zone, CAST(zone_no AS BIGINT) AS zone_no FROM zoned"
SQL["sample_weights"] = B.CTE + "SELECT well_id, idx, h FROM weighted"


def zone_summary(spark, sf_dir):
    """Shale volume over zones: the flagship query."""
    samples = B.samples_once(spark, sf_dir)
    s = B.zoned(spark, sf_dir, samples).join(I.gr_baselines(samples), "well_id")
    s = s.select("well_id", "zone", "h", P.vshale("gr", "gr_clean", "gr_shale").alias("vsh"), P.porosity_density("rhob").alias("phid"))
    # summarize() reads its rows twice
    s = store.written(s, "zoned")
    mean = (F.sum(F.col("phid") * F.col("h")) / F.sum("h")).alias("phid_mean")
    return B.rounded(Z.summarize(s, "vsh", ["well_id", "zone"], more=[mean]))


def zone_summary_log(spark, sf_dir):
    """Resistivity over zones, by geometric mean."""
    return B.rounded(Z.summarize(B.zoned(spark, sf_dir), "rt", ["well_id", "zone"], log=True).drop("sd"))


_Q = ", ".join(f"round(quantile_cont(x, {q}), 6) + 0.0 AS p{int(100 * q)}" for q in Z.QUANTILES)
SQL["zone_summary"] = BASELINES + f""",
vz AS (SELECT z.well_id, z.zone, z.h, i.igr AS x, ({d(2.71)} - z.rhob) / ({d(2.71)} - {d(1.0)}) AS phid FROM zoned z JOIN indexed i USING (well_id, idx)),
vm AS (SELECT well_id, zone, sum(x * h) / sum(CASE WHEN x IS NOT NULL THEN h END) AS m FROM vz GROUP BY well_id, zone)
SELECT v.well_id, v.zone, count(x) AS n, count(*) AS total, round(100 * (1 - count(x) / CAST(count(*) AS DOUBLE)), 6) AS null_pct, round(m, 6) + 0.0 AS mean,
  round(sqrt(sum(h * (x - m) * (x - m)) / sum(CASE WHEN x IS NOT NULL THEN h END)), 6) AS sd, round(min(x), 6) + 0.0 AS min, {_Q}, round(max(x), 6) + 0.0 AS max,
  round(sum(phid * h) / sum(h), 6) + 0.0 AS phid_mean
FROM vz v JOIN vm ON vm.well_id = v.well_id AND vm.zone = v.zone GROUP BY v.well_id, v.zone, m"""
SQL["zone_summary_log"] = B.CTE + f"""
SELECT well_id, zone, count(x) AS n, count(*) AS total, round(100 * (1 - count(x) / CAST(count(*) AS DOUBLE)), 6) AS null_pct, round(exp(sum(ln(x) * h) / sum(h)), 6) AS mean, round(min(x), 6) AS min, {_Q}, round(max(x), 6) AS max
FROM (SELECT well_id, zone, h, rt AS x FROM zoned) GROUP BY well_id, zone"""


def zone_netpay(spark, sf_dir):
    samples = B.samples_once(spark, sf_dir)
    n, z = B.parts(spark, sf_dir), store.written(B.zones(spark, sf_dir, samples), "zones")
    # dealt by well once: thickness, zones and sums need no further exchange of samples
    s = spread.dealt(I.interpret(samples).select("well_id", "md", "gr", "phi", "sw", "net_res", "net_pay"), n, "well_id").withColumn("h", Z.thickness())
    inside = D.zone_at(s, spread.dealt(z, n, "well_id")).where("zone IS NOT NULL")
    return B.rounded(Z.net_pay(inside, z).withColumn("zone_no", F.col("zone_no").cast("long")))


SQL["zone_netpay"] = INTERPRETED + """,
sums AS (
  SELECT z.well_id, z.zone_no, coalesce(sum(h) FILTER (WHERE phie IS NOT NULL), 0) AS cov, coalesce(sum(h) FILTER (WHERE net_res = 1), 0) AS net, coalesce(sum(phie * h) FILTER (WHERE net_res = 1), 0) AS phi_h,
    coalesce(sum(h) FILTER (WHERE net_pay = 1), 0) AS pay, coalesce(sum(sw * h) FILTER (WHERE net_pay = 1), 0) AS sw_h, coalesce(sum(phie * (1 - sw) * h) FILTER (WHERE net_pay = 1), 0) AS hc_h
  FROM zoned z JOIN interpreted i ON i.well_id = z.well_id AND i.idx = z.idx GROUP BY z.well_id, z.zone_no)
SELECT z.well_id, CAST(z.zone_no AS BIGINT) AS zone_no, zone, top, base, base - top AS gross, round(net, 6) AS net, round(net / cov, 6) AS ntg, round(pay, 6) AS pay,
  CASE WHEN net > 0 THEN round(phi_h / net, 6) END AS phi_net, CASE WHEN pay > 0 THEN round(sw_h / pay, 6) END AS sw_pay, round(phi_h, 6) + 0.0 AS phi_h, round(hc_h, 6) + 0.0 AS hc_h,
  CASE WHEN cov > 0 THEN 'flags' END AS basis
FROM zones z LEFT JOIN sums s ON s.well_id = z.well_id AND s.zone_no = z.zone_no"""


def histogram_by_zone(spark, sf_dir):
    return B.rounded(Z.histogram(B.zoned(spark, sf_dir), "rt", 0.2, 2000.0, 20, log=True))


SQL["histogram_by_zone"] = B.CTE + f""",
binned AS (
  SELECT zone, h, CASE WHEN log10(rt) = log10({d(2000)}) THEN 19 ELSE CAST(least(greatest(floor((log10(rt) - log10({d(0.2)})) / ((log10({d(2000)}) - log10({d(0.2)})) / 20)), -1), 20) AS INTEGER) END AS bin
  FROM zoned WHERE rt > 0 AND h > 0),
hist AS (SELECT zone, bin, grouping(zone) = 1 AS all_zones, sum(h) AS w, count(*) AS n FROM binned GROUP BY GROUPING SETS ((zone, bin), (bin)))
SELECT zone, all_zones, bin, n, round(w / sum(w) OVER (PARTITION BY all_zones, zone), 6) AS frac,
  round(sum(w) OVER (PARTITION BY all_zones, zone ORDER BY bin) / sum(w) OVER (PARTITION BY all_zones, zone), 6) AS cum FROM hist"""


def weighted_quantiles(spark, sf_dir):
    return B.rounded(Z.weighted_quantiles(B.zoned(spark, sf_dir), "rt", ["well_id", "zone"]))


SQL["weighted_quantiles"] = B.CTE + """,
w AS (SELECT well_id, zone, rt, sum(h) AS w FROM zoned WHERE rt IS NOT NULL AND h > 0 GROUP BY well_id, zone, rt),
c AS (SELECT *, sum(w) OVER (PARTITION BY well_id, zone ORDER BY rt) AS c, sum(w) OVER (PARTITION BY well_id, zone) AS t FROM w)
SELECT well_id, zone, round(min(rt) FILTER (WHERE c >= CAST(0.1 AS DOUBLE) * t - 1e-12), 6) AS wp10, round(min(rt) FILTER (WHERE c >= CAST(0.5 AS DOUBLE) * t - 1e-12), 6) AS wp50, round(min(rt) FILTER (WHERE c >= CAST(0.9 AS DOUBLE) * t - 1e-12), 6) AS wp90
FROM c GROUP BY well_id, zone"""


def equal_count_groups(spark, sf_dir):
    s = B.log_samples(spark, sf_dir)
    breaks = Z.equal_count_breaks(s, "gr")
    names = [f"b{k}" for k in range(1, 6)]
    # the breaks are one row
    g = s.crossJoin(F.broadcast(breaks.select(*names))).withColumn("gr_group", Z.group_of("gr", [F.col(n) for n in names]))
    return g.groupBy("well_id", "gr_group").agg(F.count("*").alias("n"))


SQL["equal_count_groups"] = B.CTE + """,
r AS (SELECT gr, row_number() OVER (ORDER BY gr) - 1 AS k, count(*) OVER () AS n FROM log_samples WHERE gr IS NOT NULL),
b AS (SELECT """ + ", ".join(f"max(CASE WHEN k = least(n * {k} // 6, n - 1) THEN gr END) AS b{k}" for k in range(1, 6)) + """ FROM r)
SELECT well_id, CASE WHEN gr IS NOT NULL THEN """ + " + ".join(f"CASE WHEN gr >= b{k} THEN 1 ELSE 0 END" for k in range(1, 6)) + """ END AS gr_group, count(*) AS n FROM log_samples, b GROUP BY 1, 2"""


def zone_order(spark, sf_dir):
    return B.rounded(Z.zone_order(B.zones(spark, sf_dir)).withColumn("zone_rank", F.col("zone_rank").cast("long")))


SQL["zone_order"] = B.CTE + "SELECT zone, round(avg(top), 6) AS mean_top, count(*) AS wells, row_number() OVER (ORDER BY avg(top), zone) AS zone_rank FROM zones GROUP BY zone"


def auto_scale(spark, sf_dir):
    return B.rounded(Z.auto_scale(B.log_samples(spark, sf_dir), "rt", ["well_id"]))


SQL["auto_scale"] = B.CTE + """,
r AS (SELECT well_id, rt, row_number() OVER (PARTITION BY well_id ORDER BY rt) - 1 AS k, count(*) OVER (PARTITION BY well_id) AS n FROM log_samples WHERE rt IS NOT NULL)
SELECT well_id, count(*) AS n, round(max(CASE WHEN k = floor(CAST(0.02 AS DOUBLE) * (n - 1)) THEN rt END), 6) AS low, round(max(CASE WHEN k = floor(CAST(0.98 AS DOUBLE) * (n - 1)) THEN rt END), 6) AS high
FROM r GROUP BY well_id HAVING count(*) >= 10"""

def sketched_quantiles(spark, sf_dir):
    """Quantiles of the resistivity by zone and, rolled up, of each zone over all wells, and whether they are as near to the exact ones as they should be."""
    samples = store.written(B.log_samples(spark, sf_dir).select("well_id", "md", "rt"), "samples")
    n, z = B.parts(spark, sf_dir), B.zones(spark, sf_dir, samples)
    weighed = spread.dealt(samples, n, "well_id").withColumn("h", Z.thickness())
    s = store.written(D.zone_at(weighed, spread.dealt(z, n, "well_id")).where("zone IS NOT NULL").select("well_id", "zone", "rt", "h"), "zoned")
    # dealt by well: sums and quantiles of a well's zones need no further exchange
    wells = spread.dealt(s, n, "well_id")
    by_well = store.written(K.sketch(wells, "rt", ["well_id", "zone"]), "sketch")
    out = None
    for level, keys in (("well", ["well_id", "zone"]), ("all", ["zone"])):
        near = K.quantiles(by_well if level == "well" else K.merged(by_well, keys), keys)
        exact = Z.weighted_quantiles(wells if level == "well" else s, "rt", keys).select(*keys, *[F.col(f"wp{p}").alias(f"e{p}") for p in (10, 50, 90)])
        both = near.join(exact, keys)
        fine = [F.abs(F.col(f"wp{p}") - F.col(f"e{p}")) <= 0.005 * (1 + 1e-9) * F.abs(F.col(f"e{p}")) for p in (10, 50, 90)]
        part = both.select(F.lit(level).alias("level"), (F.col("well_id") if level == "well" else F.lit(None).cast("long")).alias("well_id"), "zone", F.col("e50").alias("wp50"), (fine[0] & fine[1] & fine[2]).alias("near"))
        out = part if out is None else out.unionByName(part)
    return B.rounded(out)


SQL["sketched_quantiles"] = B.CTE + """,
c AS (SELECT well_id, zone, rt, sum(h) OVER (PARTITION BY well_id, zone ORDER BY rt) AS c, sum(h) OVER (PARTITION BY well_id, zone) AS t FROM zoned WHERE rt IS NOT NULL AND h > 0),
a AS (SELECT zone, rt, sum(h) OVER (PARTITION BY zone ORDER BY rt) AS c, sum(h) OVER (PARTITION BY zone) AS t FROM zoned WHERE rt IS NOT NULL AND h > 0)
SELECT 'well' AS level, well_id, zone, round(min(rt) FILTER (WHERE c >= 0.5 * t - 1e-12), 6) AS wp50, true AS near FROM c GROUP BY well_id, zone
UNION ALL SELECT 'all', NULL, zone, round(min(rt) FILTER (WHERE c >= 0.5 * t - 1e-12), 6), true FROM a GROUP BY zone"""


QUERIES |= {f.__name__: f for f in (zones, zone_assign, sample_weights, zone_summary, zone_summary_log, zone_netpay, histogram_by_zone, weighted_quantiles, sketched_quantiles, equal_count_groups, zone_order, auto_scale)}
