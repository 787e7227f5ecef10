"""Queries over curve operators, quality reports and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import petro as P
from ..operators import curves as C
from ..operators import depth as D
from ..operators import quality as Q
from ..sources import store
from . import base as B
from .petrophysics import d

QUERIES, SQL = {}, {}

SPIKED = B.CTE + f""",
framed AS (
  SELECT well_id, idx, md, rt, array_agg(rt) OVER w AS v, quantile_cont(rt, 0.5) OVER w AS med FROM log_samples WINDOW w AS (PARTITION BY well_id ORDER BY md ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)),
spread AS (SELECT *, list_sort(list_transform(v, lambda x: abs(x - med))) AS a FROM framed),
mads AS (SELECT *, CASE WHEN len(a) % 2 = 1 THEN a[len(a) // 2 + 1] ELSE (a[len(a) // 2] + a[len(a) // 2 + 1]) / 2 END AS mad FROM spread),
spikes AS (SELECT *, len(v) >= 5 AND mad > 0 AND abs(rt - med) > {d(2)} * {d(1.4826)} * mad AS is_spike FROM mads)
"""


def despike(spark, sf_dir):
    """Resistivity with a low threshold, so that spikes occur."""
    s = C.despike(B.log_samples(spark, sf_dir), "rt", ["well_id"], z=2.0)
    return B.rounded(s.select("well_id", "idx", "is_spike", "rt_clean"))


SQL["despike"] = SPIKED + "SELECT well_id, idx, is_spike, round(CASE WHEN is_spike THEN med ELSE rt END, 6) AS rt_clean FROM spikes"

RUNS = B.CTE + """,
ranged AS (SELECT *, min(md) FILTER (WHERE gr IS NOT NULL) OVER (PARTITION BY well_id) AS a, max(md) FILTER (WHERE gr IS NOT NULL) OVER (PARTITION BY well_id) AS b FROM log_samples),
flagged AS (SELECT *, CASE WHEN row_number() OVER w > 1 AND gr IS NOT DISTINCT FROM lag(gr) OVER w THEN 0 ELSE 1 END AS new FROM ranged WHERE md BETWEEN a AND b WINDOW w AS (PARTITION BY well_id ORDER BY md)),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY well_id ORDER BY md) AS run FROM flagged),
runs AS (SELECT well_id, run, bool_and(gr IS NULL) AS missing, count(*) AS n, min(md) AS top, max(md) AS base FROM numbered GROUP BY well_id, run)
"""


def null_gaps(spark, sf_dir):
    return Q.null_gaps(B.log_samples(spark, sf_dir), "gr")


def flat_runs(spark, sf_dir):
    """Runs of at least two equal values, as longer ones don't occur in these data."""
    return Q.flat_runs(B.log_samples(spark, sf_dir), "gr", rows=2, depth=1.0)


SQL["null_gaps"] = RUNS + "SELECT well_id, n, top, base FROM runs WHERE missing AND n > 3"
SQL["flat_runs"] = RUNS + "SELECT well_id, n, top, base FROM runs WHERE NOT missing AND n >= 2 AND n * CAST(0.5 AS DOUBLE) >= 1"


def curve_qc(spark, sf_dir):
    return B.rounded(Q.curve_report(B.log_samples(spark, sf_dir), "gr", "GR", "GAPI"))


SQL["curve_qc"] = RUNS + f""",
framed AS (
  SELECT well_id, md, gr, list_filter(array_agg(gr) OVER w, lambda x: x IS NOT NULL) AS v, quantile_cont(gr, 0.5) OVER w AS med FROM log_samples WINDOW w AS (PARTITION BY well_id ORDER BY md ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)),
spread AS (SELECT *, list_sort(list_transform(v, lambda x: abs(x - med))) AS a FROM framed),
mads AS (SELECT *, CASE WHEN len(a) % 2 = 1 THEN a[len(a) // 2 + 1] ELSE (a[len(a) // 2] + a[len(a) // 2 + 1]) / 2 END AS mad FROM spread),
base AS (
  SELECT well_id, count(gr) AS n, (max(md) FILTER (WHERE gr IS NOT NULL) - min(md) FILTER (WHERE gr IS NOT NULL)) / (max(md) - min(md)) AS coverage,
    count(*) FILTER (WHERE coalesce(len(v) >= 5 AND mad > 0 AND abs(gr - med) > 6 * {d(1.4826)} * mad, false)) AS spikes, count(*) FILTER (WHERE gr < 0 OR gr > 1500) AS outside FROM mads GROUP BY well_id),
r AS (SELECT well_id, count(*) FILTER (WHERE missing AND n > 3) AS gaps, coalesce(max(n) FILTER (WHERE NOT missing), 0) AS flat FROM runs GROUP BY well_id),
j AS (SELECT base.*, gaps, flat, outside / CAST(n AS DOUBLE) AS outside_share FROM base JOIN r USING (well_id)),
l AS (SELECT *, [CASE WHEN coverage < {d(0.25)} THEN 1 ELSE 0 END, CASE WHEN gaps > 0 THEN 1 ELSE 0 END, CASE WHEN flat >= 20 AND flat * {d(0.5)} >= 10 THEN 1 ELSE 0 END, CASE WHEN spikes > {d(0.01)} * n THEN 1 ELSE 0 END, CASE WHEN outside_share > {d(0.05)} THEN 2 WHEN outside_share > 0 THEN 1 ELSE 0 END, 0] AS levels FROM j)
SELECT well_id, n, round(coverage, 6) AS coverage, gaps, flat, spikes, round(outside_share, 6) AS outside_share, round(len(list_filter(levels, lambda x: x = 0)) / CAST(6 AS DOUBLE), 6) AS score,
  CASE list_max(levels) WHEN 2 THEN 'bad' WHEN 1 THEN 'warn' ELSE 'ok' END AS verdict FROM l"""


def gr_normalise(spark, sf_dir):
    s = B.log_samples(spark, sf_dir)
    first = s.agg(F.min("well_id")).first()[0]
    return C.percentile_norm(s, "gr", first)


SQL["gr_normalise"] = B.CTE + """,
q AS (SELECT well_id, quantile_cont(gr, 0.05) AS lo, quantile_cont(gr, 0.95) AS hi FROM log_samples WHERE gr IS NOT NULL GROUP BY well_id HAVING count(*) >= 20),
ref AS (SELECT lo AS rlo, hi AS rhi FROM q WHERE well_id = (SELECT min(well_id) FROM log_samples))
SELECT well_id, round((rhi - rlo) / (hi - lo), 5) AS a, round(rlo - (rhi - rlo) / (hi - lo) * lo, 3) AS b FROM q, ref WHERE hi > lo"""


def coverage_matrix(spark, sf_dir):
    return B.rounded(Q.coverage(B.log_samples(spark, sf_dir), ["gr", "rhob", "rt"]))


SQL["coverage_matrix"] = B.CTE + " UNION ALL ".join(f"""SELECT well_id, '{c}' AS curve, count({c}) AS n, round(count({c}) / CAST(count(*) AS DOUBLE), 6) AS fraction,
round(coalesce((max(md) FILTER (WHERE {c} IS NOT NULL) - min(md) FILTER (WHERE {c} IS NOT NULL)) / (max(md) - min(md)), 0), 6) AS range_fraction FROM log_samples GROUP BY well_id""" for c in ("gr", "rhob", "rt"))


def flag_intervals(spark, sf_dir):
    return C.flag_intervals(B.log_samples(spark, sf_dir), F.col("gr") >= 100.0, ["well_id"])


def crossover_intervals(spark, sf_dir):
    return C.flag_intervals(B.log_samples(spark, sf_dir), P.crossover("rhob", "nphi"), ["well_id"])


def _intervals(flag):
    return B.CTE + f""",
f AS (SELECT well_id, md, coalesce({flag}, false) AS on_ FROM log_samples),
n AS (SELECT *, CASE WHEN on_ IS DISTINCT FROM lag(on_) OVER (PARTITION BY well_id ORDER BY md) THEN 1 ELSE 0 END AS new FROM f),
r AS (SELECT *, sum(new) OVER (PARTITION BY well_id ORDER BY md) AS run FROM n)
SELECT well_id, count(*) AS n, min(md) AS top, max(md) AS base FROM r WHERE on_ GROUP BY well_id, run"""


SQL["flag_intervals"] = _intervals("gr >= 100")
SQL["crossover_intervals"] = _intervals(f"({d(2.71)} - rhob) / ({d(2.71)} - {d(1.0)}) > nphi")


def lithology_runs(spark, sf_dir):
    s = B.log_samples(spark, sf_dir).where("gr IS NOT NULL")
    return C.runs(s, P.quick_lithology(F.col("gr") / 200.0, None), ["well_id"]).select("well_id", F.col("state").alias("lithology"), "n", "top", "base")


SQL["lithology_runs"] = B.CTE + f""",
f AS (SELECT well_id, md, CASE WHEN gr / {d(200)} < {d(0.4)} THEN 'sandstone' WHEN gr / {d(200)} < {d(0.65)} THEN 'siltstone' ELSE 'shale' END AS k FROM log_samples WHERE gr IS NOT NULL),
n AS (SELECT *, CASE WHEN k IS DISTINCT FROM lag(k) OVER (PARTITION BY well_id ORDER BY md) THEN 1 ELSE 0 END AS new FROM f),
r AS (SELECT *, sum(new) OVER (PARTITION BY well_id ORDER BY md) AS run FROM n)
SELECT well_id, any_value(k) AS lithology, count(*) AS n, min(md) AS top, max(md) AS base FROM r GROUP BY well_id, run"""


def _curves(spark, sf_dir):
    """Curve headers: one per supplier, part number block and line number, with made-up mnemonics of known families."""
    names = ("GR", "SGR:2", "RT", "ILD", "RPM", "RHOB", "NPHI", "DT")
    t = B.read(spark, sf_dir, "lineitem").where("l_linenumber <= 7").groupBy(F.col("l_suppkey").alias("well_id"), F.col("l_linenumber").alias("col_no")).agg(F.count("*").alias("n"))
    name = F.element_at(F.array(*map(F.lit, names)), (F.pmod(F.col("well_id") + F.col("col_no"), F.lit(len(names))) + 1).cast("int"))
    return t.select("well_id", (F.col("well_id") * 100 + F.col("col_no")).alias("curve_id"), name.alias("mnemonic"), F.when(F.col("well_id") % 3 == 0, "ohmm").otherwise("").alias("unit"), (F.col("well_id") % 5 == F.col("col_no")).alias("cased"), "n", "col_no")


def resolve_family(spark, sf_dir):
    return C.resolve_family(_curves(spark, sf_dir)).select("well_id", "family", "curve_id", "mnemonic", "n")


SQL["resolve_family"] = """
WITH t AS (SELECT l_suppkey AS well_id, l_linenumber AS col_no, count(*) AS n FROM lineitem WHERE l_linenumber <= 7 GROUP BY 1, 2),
c AS (
  SELECT *, well_id * 100 + col_no AS curve_id, ['GR', 'SGR:2', 'RT', 'ILD', 'RPM', 'RHOB', 'NPHI', 'DT'][(well_id + col_no) % 8 + 1] AS mnemonic, well_id % 3 = 0 AS ohm, well_id % 5 = col_no AS cased FROM t),
a(family, alias, k) AS (VALUES """ + ", ".join(f"('{f}', '{a}', {k})" for f, a, k in C.family_rows()) + """),
h AS (
  SELECT c.*, family, k FROM c JOIN a ON a.alias = regexp_replace(c.mnemonic, '[:_-][0-9]+$', '') WHERE NOT (a.alias = 'RPM' AND NOT ohm)),
m AS (SELECT *, n * CAST(1.5 AS DOUBLE) < max(n) OVER (PARTITION BY well_id, family, cased) AS short FROM h),
r AS (SELECT *, row_number() OVER (PARTITION BY well_id, family ORDER BY cased, short, k, col_no) AS rank FROM m)
SELECT well_id, family, curve_id, mnemonic, n FROM r WHERE rank = 1"""


def merge_runs(spark, sf_dir):
    """Two overlapping runs per well: the upper 300 rows of gamma ray, and the rest from row 290 on with the resistivity."""
    s = B.log_samples(spark, sf_dir)
    a = s.where("idx < 300").select("well_id", F.lit(0).alias("file_no"), F.lit("GR").alias("mnemonic"), F.lit("API").alias("unit"), "md", F.col("gr").alias("value"))
    b = s.where("idx >= 290").select("well_id", F.lit(1).alias("file_no"), F.explode(F.array(F.struct(F.lit("GR").alias("mnemonic"), F.lit("GAPI").alias("unit"), (F.col("gr") + 1).alias("value")), F.struct(F.lit("RT").alias("mnemonic"), F.lit("OHMM").alias("unit"), F.col("rt").alias("value")))).alias("c"), "md").select("well_id", "file_no", "c.mnemonic", "c.unit", "md", "c.value")
    return B.rounded(C.merge_runs(a.unionByName(b), [0, 1]).select("well_id", "mnemonic", "i", "value"))


SQL["merge_runs"] = B.CTE + """
SELECT well_id, 'GR' AS mnemonic, idx AS i, round(CASE WHEN idx < 300 AND gr IS NOT NULL THEN gr ELSE gr + 1 END, 6) AS value FROM log_samples WHERE gr IS NOT NULL
UNION ALL SELECT well_id, 'RT', idx, round(rt, 6) FROM log_samples WHERE idx >= 290"""


def merge_lineage(spark, sf_dir):
    """Which run gave which stretch, where two runs overlap as in merge_runs."""
    s = B.log_samples(spark, sf_dir)
    one = lambda n, m, v, w: s.where(w).select("well_id", F.lit(n).alias("file_no"), F.lit(m).alias("mnemonic"), F.lit("API").alias("unit"), "md", v.alias("value"))
    merged = C.merge_runs(one(0, "GR", F.col("gr"), "idx < 300").unionByName(one(1, "GR", F.col("gr") + 1, "idx >= 290")).unionByName(one(1, "RT", F.col("rt"), "idx >= 290")), [0, 1], lineage=True)
    return B.rounded(C.provenance(merged))


SQL["merge_lineage"] = B.CTE + """
SELECT well_id, 'GR' AS mnemonic, CASE WHEN idx < 300 THEN 0 ELSE 1 END AS file_no, min(idx) AS first_i, max(idx) AS last_i, min(md) AS top, max(md) AS base, count(*) AS n
FROM log_samples WHERE gr IS NOT NULL GROUP BY well_id, idx < 300
UNION ALL SELECT well_id, 'RT', 1, min(idx), max(idx), min(md), max(md), count(*) FROM log_samples WHERE idx >= 290 GROUP BY well_id"""


def unmerged_files(spark, sf_dir):
    """Three runs below each other, merged and taken apart by the stretches alone."""
    s = B.log_samples(spark, sf_dir)
    runs = s.select("well_id", F.least(F.floor(F.col("idx") / 200), F.lit(2)).cast("int").alias("file_no"), F.explode(F.array(F.struct(F.lit("GR").alias("mnemonic"), F.col("gr").alias("value")), F.struct(F.lit("RT").alias("mnemonic"), F.col("rt").alias("value")))).alias("c"), "md").select("well_id", "file_no", "c.mnemonic", F.lit("X").alias("unit"), "md", "c.value")
    merged = store.written(C.merge_runs(runs, [0, 1, 2], lineage=True), "merged")
    parts = C.unmerged(merged.drop("file_no"), C.provenance(merged))
    return B.rounded(parts.select("well_id", "file_no", "mnemonic", "md", "value"))


SQL["unmerged_files"] = B.CTE + " UNION ALL ".join(f"SELECT well_id, CAST(least(idx // 200, 2) AS INTEGER) AS file_no, '{c.upper()}' AS mnemonic, md, round({c}, 6) + 0.0 AS value FROM log_samples WHERE {c} IS NOT NULL" for c in ("gr", "rt"))


def rule_tops(spark, sf_dir):
    rules = [
        {"name": "A", "kind": "step", "value": "rt", "half": 5, "low": 5050.0, "high": 5150.0},
        {"name": "B", "kind": "first", "value": "nphi", "half": 3, "low": 5100.0, "high": 5300.0, "above": 0.2},
    ]
    return B.rounded(C.rule_tops(B.log_samples(spark, sf_dir), rules))


SQL["rule_tops"] = B.CTE + """,
s AS (SELECT *, avg(rt) OVER (PARTITION BY well_id ORDER BY md ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) - avg(rt) OVER (PARTITION BY well_id ORDER BY md ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS step,
  avg(nphi) OVER (PARTITION BY well_id ORDER BY md ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS smooth FROM log_samples),
r AS (SELECT well_id, md, row_number() OVER (PARTITION BY well_id ORDER BY step DESC, md) AS k FROM s WHERE md BETWEEN 5050 AND 5150 AND step IS NOT NULL)
SELECT well_id, 'A' AS name, md FROM r WHERE k = 1 UNION ALL SELECT well_id, 'B', min(md) FROM s WHERE md BETWEEN 5100 AND 5300 AND smooth > CAST(0.2 AS DOUBLE) GROUP BY well_id"""


def _export(samples, spark, sf_dir):
    s = D.zone_at(samples, B.zones(spark, sf_dir), keep_last=True).join(B.wells(spark, sf_dir).select("well_id", "name", "kb"), "well_id")
    return B.rounded(s.select(F.col("name").alias("well"), "md", (F.col("md") - F.col("kb")).alias("tvdss"), "gr", F.col("rt").alias("rdeep"), "rhob", "nphi", F.col("zone").alias("formation")))


def curve_export(spark, sf_dir):
    """Every sample with its subsea depth and formation; the deepest keeps the last zone."""
    return _export(B.log_samples(spark, sf_dir), spark, sf_dir)


SQL["curve_export"] = B.CTE + """
SELECT w.name AS well, s.md, round(s.md - kb, 6) AS tvdss, round(gr, 6) AS gr, round(rt, 6) AS rdeep, round(rhob, 6) AS rhob, round(nphi, 6) + 0.0 AS nphi, z.zone AS formation
FROM log_samples s JOIN wells w ON w.well_id = s.well_id ASOF JOIN zones z ON z.well_id = s.well_id AND s.md >= z.top"""


def crossplot_rows(spark, sf_dir):
    s = C.crossplot_rows(B.log_samples(spark, sf_dir), "nphi", "rt", log_x=True, log_y=True, clean=F.col("gr") < 100.0)
    return B.rounded(s.select("well_id", "idx", "nphi", "rt"))


SQL["crossplot_rows"] = B.CTE + "SELECT well_id, idx, round(nphi, 6) AS nphi, round(rt, 6) AS rt FROM log_samples WHERE nphi > 0 AND rt > 0 AND gr < 100"


def cuttings_stack(spark, sf_dir):
    s = B.log_samples(spark, sf_dir).select("well_id", "idx", F.col("gr").alias("clay"), F.col("nphi").alias("sand"), F.col("rhob").alias("lime"))
    return B.rounded(C.stacked(s, ["clay", "sand", "lime"]))


SQL["cuttings_stack"] = B.CTE + """,
c AS (SELECT well_id, idx, CASE WHEN gr > 0 THEN gr ELSE 0 END AS a, CASE WHEN nphi > 0 THEN nphi ELSE 0 END AS b, CASE WHEN rhob > 0 THEN rhob ELSE 0 END AS c FROM log_samples),
e AS (SELECT well_id, idx, 'clay' AS component, CAST(0 AS DOUBLE) AS x0, a AS x1 FROM c UNION ALL SELECT well_id, idx, 'sand', a, a + b FROM c UNION ALL SELECT well_id, idx, 'lime', a + b, a + b + c FROM c)
SELECT well_id, idx, component, round(x0, 6) AS x0, round(x1, 6) AS x1 FROM e WHERE x1 > x0"""


def decimated(spark, sf_dir):
    return C.decimate(B.log_samples(spark, sf_dir), 200).select("well_id", "idx")


SQL["decimated"] = B.CTE + ", n AS (SELECT well_id, idx, count(*) OVER (PARTITION BY well_id) AS n FROM log_samples) SELECT well_id, idx FROM n WHERE idx % greatest(1, n // 200) = 0"


def sensor_shift(spark, sf_dir):
    return B.rounded(D.shift(B.log_samples(spark, sf_dir).select("well_id", "idx", "md", "rt"), "rt", 10.0, 0.5).select("well_id", "idx", "rt"))


SQL["sensor_shift"] = B.CTE + "SELECT well_id, idx, round(lead(rt, 20) OVER (PARTITION BY well_id ORDER BY idx), 6) AS rt FROM log_samples"

QUERIES |= {f.__name__: f for f in (despike, null_gaps, flat_runs, curve_qc, gr_normalise, coverage_matrix, flag_intervals, crossover_intervals, lithology_runs, resolve_family, merge_runs, merge_lineage, unmerged_files, rule_tops, curve_export, crossplot_rows, cuttings_stack, decimated, sensor_shift)}
# the name under which the query over every sample was known while the one above kept some
QUERIES["curve_export_all"], SQL["curve_export_all"] = QUERIES["curve_export"], SQL["curve_export"]
