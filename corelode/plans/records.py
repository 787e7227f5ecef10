"""Queries over edits, unions, surveys, texts and page words that the other modules leave out."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import curves as C
from ..operators import depth as D
from ..operators import interpret as I
from ..operators import quality as Q
from ..operators import surface as M
from ..operators import tables as T
from ..operators import tokens as K
from ..sources import export, las
from . import base as B
from .curves import _curves
from .depth import SURVEYED
from .petrophysics import BASELINES, INTERPRETED, d

QUERIES, SQL = {}, {}


def edited_curve(spark, sf_dir):
    """The resistivity of each well as its edits leave it: every third moved up by 10 ft, every fourth scaled, the others as they are."""
    w = F.col("s_suppkey")
    edits = B.read(spark, sf_dir, "supplier").where("s_suppkey % 12 <> 5").select(w.alias("well_id"), F.when(w % 3 == 0, 10.0).alias("offset"), F.lit(False).alias("despike"), F.when(w % 4 == 0, 2.0).alias("a"), F.when(w % 4 == 0, -1.0).alias("b"))
    return B.rounded(C.apply_edits(B.log_samples(spark, sf_dir).select("well_id", "idx", "md", "rt"), "rt", edits).select("well_id", "idx", "rt_edited"))


SQL["edited_curve"] = B.CTE + f"""SELECT well_id, idx, round((CASE WHEN well_id % 12 <> 5 AND well_id % 3 = 0 THEN lead(rt, 20) OVER w ELSE rt END) * CASE WHEN well_id % 12 <> 5 AND well_id % 4 = 0 THEN {d(2)} ELSE {d(1)} END
  - CASE WHEN well_id % 12 <> 5 AND well_id % 4 = 0 THEN 1 ELSE 0 END, 6) + 0.0 AS rt_edited FROM log_samples WINDOW w AS (PARTITION BY well_id ORDER BY idx)"""


def curve_families(spark, sf_dir):
    return C.family_of(_curves(spark, sf_dir)).select("curve_id", "mnemonic", "family")


SQL["curve_families"] = """
WITH t AS (SELECT l_suppkey AS well_id, l_linenumber AS col_no FROM lineitem WHERE l_linenumber <= 7 GROUP BY 1, 2),
c AS (SELECT well_id * 100 + col_no AS curve_id, ['GR', 'SGR:2', 'RT', 'ILD', 'RPM', 'RHOB', 'NPHI', 'DT'][(well_id + col_no) % 8 + 1] AS mnemonic FROM t)
SELECT curve_id, mnemonic, CASE regexp_replace(mnemonic, ':.*', '') WHEN 'GR' THEN 'GR' WHEN 'SGR' THEN 'GR' WHEN 'RT' THEN 'RD' WHEN 'ILD' THEN 'RD' WHEN 'RPM' THEN 'RM' ELSE mnemonic END AS family FROM c"""


def first_filled(spark, sf_dir):
    """Header fields of wells that several files (here orders lines of a supplier) give: each from the first that has it."""
    t = B.read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("well_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("file_no"), "l_partkey", "l_returnflag")
    one = t.groupBy("well_id", "file_no").agg(F.min("l_partkey").alias("p"), F.min("l_returnflag").alias("f"))
    return C.first_filled(one.select("well_id", "file_no", F.when(F.col("f") == "R", F.col("p")).alias("field_code"), F.when(F.col("p") % 50 == 0, F.col("f")).alias("status")), ["field_code", "status"])


SQL["first_filled"] = """
WITH t AS (SELECT l_suppkey AS well_id, l_orderkey * 10 + l_linenumber AS file_no, min(l_partkey) AS p, min(l_returnflag) AS f FROM lineitem GROUP BY 1, 2)
SELECT well_id, min_by(p, file_no) FILTER (WHERE f = 'R') AS field_code, min_by(f, file_no) FILTER (WHERE p % 50 = 0) AS status FROM t GROUP BY well_id"""


def replaced_tops(spark, sf_dir):
    """Tops with those of a second interpretation in place of their own, and its new ones."""
    t = B.tops(spark, sf_dir)
    new = t.where("name = 'Gamma' AND well_id % 4 = 0").withColumn("md", F.col("md") + 5.0).unionByName(t.where("name = 'Alpha' AND well_id % 6 = 0").withColumn("name", F.lit("Delta")))
    return C.replace_by_key(t, new, ["well_id", "name"])


SQL["replaced_tops"] = B.CTE + """SELECT well_id, name, CASE WHEN name = 'Gamma' AND well_id % 4 = 0 THEN md + 5 ELSE md END AS md FROM tops
UNION ALL SELECT well_id, 'Delta', md FROM tops WHERE name = 'Alpha' AND well_id % 6 = 0"""


def event_series(spark, sf_dir):
    e = B.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_orderstatus").alias("series"), F.col("o_orderpriority").alias("class"))
    return T.split_events(e).groupBy("series").agg(F.count("*").alias("events"))


SQL["event_series"] = "SELECT o_orderstatus || ': ' || o_orderpriority AS series, count(*) AS events FROM orders GROUP BY 1"


def nearest_well(spark, sf_dir):
    return B.rounded(M.nearest_point(B.wells(spark, sf_dir), 41.07, -104.1))


SQL["nearest_well"] = B.CTE + """,
k AS (SELECT well_id, 12742 * asin(sqrt(pow(sin((radians(41.07) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(41.07)) * pow(sin((radians(-104.1) - radians(lon)) / 2), 2))) AS km FROM wells)
SELECT well_id, round(km, 6) AS km FROM k ORDER BY round(km, 9), well_id LIMIT 1"""


def depth_window(spark, sf_dir):
    """Two curves of every well inside a depth window."""
    s = B.log_samples(spark, sf_dir)
    long = s.select("well_id", F.explode(F.array(*[F.struct(F.lit(c).alias("mnemonic"), F.col(c).alias("value")) for c in ("gr", "rt", "nphi")])).alias("c"), "md").select("well_id", "c.mnemonic", "md", "c.value")
    return B.rounded(las.subset(long, 5040.0, 5100.0, ["GR", "NPHI"]))


SQL["depth_window"] = B.CTE + " UNION ALL ".join(f"SELECT well_id, '{c}' AS mnemonic, md, round({c}, 6) + 0.0 AS value FROM log_samples WHERE md BETWEEN 5040 AND 5100" for c in ("gr", "nphi"))


def depth_reversals(spark, sf_dir):
    """Reversals and repeats where every 50th sample is recorded a foot too deep and every 75th at the depth before."""
    md = F.when(F.col("idx") % 50 == 7, F.col("md") + 1.0).when(F.col("idx") % 75 == 30, F.col("md") - 0.5).otherwise(F.col("md"))
    return Q.depth_problems(B.log_samples(spark, sf_dir).select("well_id", "idx", md.alias("md")), ["well_id"])


SQL["depth_reversals"] = B.CTE + """,
m AS (SELECT well_id, idx, CASE WHEN idx % 50 = 7 THEN md + 1 WHEN idx % 75 = 30 THEN md - 0.5 ELSE md END AS md FROM log_samples),
s AS (SELECT well_id, md - lag(md) OVER (PARTITION BY well_id ORDER BY idx) AS step FROM m)
SELECT well_id, CAST(sum(CASE WHEN step < 0 THEN 1 WHEN step IS NOT NULL THEN 0 END) AS BIGINT) AS reversals, CAST(sum(CASE WHEN step = 0 THEN 1 WHEN step IS NOT NULL THEN 0 END) AS BIGINT) AS repeats FROM s GROUP BY well_id"""


def survey_check(spark, sf_dir):
    """How far given vertical depths, off by a hundredth of the well's number, are from those recomputed."""
    survey = D.minimum_curvature(B.stations(spark, sf_dir))
    return B.rounded(D.survey_difference(survey, survey.select("well_id", "md", (F.col("tvd") + (F.col("well_id") % 100) / 100.0).alias("tvd"))))


SQL["survey_check"] = SURVEYED + f"SELECT well_id, round((well_id % 100) / {d(100)}, 6) + 0.0 AS max_difference FROM survey GROUP BY well_id"


def zone_table(spark, sf_dir):
    """Statistics of two curves side by side, a row for each zone. Means are sums in the order of depth: in any other order the last bit, and so a mean half-way between two
    roundings, changes from run to run. A zone's values are held, as by its percentiles."""
    z = B.zoned(spark, sf_dir)
    long = z.select("well_id", "zone", "md", F.explode(F.array(F.struct(F.lit("rt").alias("curve"), F.col("rt").alias("v")), F.struct(F.lit("nphi").alias("curve"), F.col("nphi").alias("v")))).alias("c")).select("well_id", "zone", "md", "c.*")
    held = F.array_sort(F.collect_list(F.when(F.col("v").isNotNull(), F.struct("md", "v"))))
    mean = F.aggregate(held, F.lit(0.0), lambda s, x: s + x["v"]) / F.count("v")
    by = long.groupBy("well_id", "zone", "curve").agg(mean.alias("mean"), *[F.percentile("v", F.lit(p / 100)).alias(f"p{p}") for p in (10, 50, 90)], F.count("v").alias("n"))
    return B.rounded(export.statistics_table(by, ["rt", "nphi"]))


SQL["zone_table"] = B.CTE + "SELECT well_id, zone, " + ", ".join(f"round(avg({c}), 6) + 0.0 AS {c}_mean, " + ", ".join(f"round(quantile_cont({c}, {p / 100}), 6) + 0.0 AS {c}_p{p}" for p in (10, 50, 90)) + f", count({c}) AS {c}_n" for c in ("rt", "nphi")) + " FROM zoned GROUP BY well_id, zone"


def saturation_by_index(spark, sf_dir):
    """Net pay of wells without a porosity log: by the resistivity index against the water line."""
    s = I.interpret(B.log_samples(spark, sf_dir).select("well_id", "idx", "md", "gr", "rt"))
    return B.rounded(s.select("well_id", "idx", "vsh", "r0", "net_res", "net_pay"))


SQL["saturation_by_index"] = BASELINES + f""",
w AS (SELECT well_id, CASE WHEN count(*) >= 50 THEN quantile_cont(rt, 0.1) END AS r0 FROM indexed WHERE igr < {d(0.5)} AND rt > 0 GROUP BY well_id)
SELECT i.well_id, idx, round(igr, 6) + 0.0 AS vsh, round(r0, 6) + 0.0 AS r0, CASE WHEN igr < {d(0.5)} THEN 1 ELSE 0 END AS net_res,
  CASE WHEN igr < {d(0.5)} AND rt > 0 AND least(sqrt(r0 / rt), 1) <= {d(0.6)} THEN 1 ELSE 0 END AS net_pay FROM indexed i LEFT JOIN w USING (well_id)"""


def shaly_saturation(spark, sf_dir):
    """Saturation by Simandoux against the resistivity of each well's own shale."""
    s = I.interpret(B.log_samples(spark, sf_dir), p=I.Parameters(sw_method="simandoux"))
    return B.rounded(s.select("well_id", "idx", "rsh", "sw"))


_SHALE, _PHI2 = "(vsh / rsh)", f"(pow(phie, {d(2)}) / {d(0.05)})"
SQL["shaly_saturation"] = INTERPRETED + f""",
shale AS (SELECT well_id, quantile_cont(rt, 0.5) AS rsh FROM effective WHERE vsh > {d(0.8)} AND rt > 0 GROUP BY well_id)
SELECT e.well_id, idx, round(rsh, 6) + 0.0 AS rsh, round(CASE WHEN rt > 0 AND phie > 0 THEN least(greatest(CASE WHEN vsh > 0 AND rsh > 0 THEN (sqrt({_SHALE} * {_SHALE} + 4 * {_PHI2} / rt) - {_SHALE}) / (2 * {_PHI2})
  ELSE sqrt({d(0.05)} / (pow(phie, {d(2)}) * rt)) END, 0), 1) END, 6) + 0.0 AS sw FROM effective e LEFT JOIN shale USING (well_id)"""


def text_values(spark, sf_dir):
    """Numbers, units and coordinates as texts give them, from part and supplier."""
    p = B.read(spark, sf_dir, "part").select("p_partkey", "p_size")
    k = F.col("p_size")
    signed = F.concat(F.format_string("%,d", k * 1000), F.when(F.col("p_partkey") % 2 == 0, F.lit(" W")).otherwise(F.lit(" E")))
    dms = F.concat((k % 60).cast("string"), F.lit(" "), ((k * 7) % 60).cast("string"), F.lit(" 30 "), F.when(F.col("p_partkey") % 3 == 0, F.lit("S")).otherwise(F.lit("N")))
    unit = F.element_at(F.array(*map(F.lit, ("gAPI", "ft/hr", "OHM.M", "Units"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    length = F.when(F.col("p_partkey") % 2 == 0, "m").otherwise("ft")
    return B.rounded(
        p.select(
            "p_partkey", S.leading_number(F.concat(k.cast("string"), F.lit(".5 in casing"))).alias("lead"), S.plain_number(signed).alias("plain"), S.coordinate(dms).alias("degrees"), S.unit_key(unit).alias("unit"),
            S.convert_length(k.cast("double"), length, "ft").alias("feet"), S.half_unit(k * 0.3).alias("half"), S.name_key(F.concat(F.lit("Well no. "), k.cast("string"), F.lit("-h"))).alias("name"), S.label_number(F.format_string("%,d ft", k * 1000)).alias("label"),
        )
    )


SQL["text_values"] = f"""
SELECT p_partkey, p_size + {d(0.5)} AS lead, CASE WHEN p_partkey % 2 = 0 THEN -1 ELSE 1 END * {d(1000)} * p_size AS plain,
  round(CASE WHEN p_partkey % 3 = 0 THEN -1 ELSE 1 END * (p_size % 60 + ((p_size * 7) % 60) / {d(60)} + 30 / {d(3600)}), 6) AS degrees,
  ['API', 'FT/HR', 'OHMM', ''][p_partkey % 4 + 1] AS unit, round(CASE WHEN p_partkey % 2 = 0 THEN p_size / {d(0.3048)} ELSE p_size END, 6) AS feet, floor(p_size * {d(0.3)} * 2 + {d(0.5)}) / 2 AS half,
  'WELLNO' || p_size || 'H' AS name, {d(1000)} * p_size AS label FROM part"""


def heading_fields(spark, sf_dir):
    """Header fields of log headings whose words come from the wells: a name beside its label, a company below its."""
    w = B.read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    parts = F.split("s_name", "#")
    word = lambda text, x, y, width: F.struct(text.alias("text"), F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(width).alias("w"))
    words = F.array(word(F.lit("WELL"), 10.0, 5.0, 30.0), word(F.get(parts, F.lit(0)), 60.0, 5.0, 50.0), word(F.get(parts, F.lit(1)), 114.0, 5.0, 60.0), word(F.lit("COMPANY:"), 10.0, 40.0, 60.0), word(F.concat(F.lit("Nation"), F.col("s_nationkey").cast("string")), 10.0, 56.0, 50.0))
    t = w.select(F.col("s_suppkey").alias("doc_id"), F.explode(words).alias("t")).select("doc_id", F.lit(0).alias("page"), "t.*", F.lit(10.0).alias("h"))
    return K.header_fields(K.phrases(t))


SQL["heading_fields"] = """SELECT s_suppkey AS doc_id, 'well' AS field, split_part(s_name, '#', 1) || ' ' || split_part(s_name, '#', 2) AS value FROM supplier
UNION ALL SELECT s_suppkey, 'company', 'Nation' || s_nationkey FROM supplier"""

QUERIES |= {f.__name__: f for f in (edited_curve, curve_families, first_filled, replaced_tops, event_series, nearest_well, depth_window, depth_reversals, survey_check, zone_table, saturation_by_index, shaly_saturation, text_values, heading_fields)}
