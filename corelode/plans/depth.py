"""Queries over directional surveys, depth frames, nearest pairs and resampling, and over maps made of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import depth as D
from ..operators import proximity as X
from ..operators import spread
from ..operators import surface as M
from . import base as B
from .petrophysics import d

QUERIES, SQL = {}, {}

SURVEYED = B.CTE + f""",
turned AS (
  SELECT *, radians(inc) AS i2, radians(azi) AS a2, lag(radians(inc)) OVER w AS i1, lag(radians(azi)) OVER w AS a1, lag(md) OVER w AS m1 FROM stations WINDOW w AS (PARTITION BY well_id ORDER BY md)),
bent AS (SELECT *, acos(least(greatest(cos(i2 - i1) - sin(i1) * sin(i2) * (1 - cos(a2 - a1)), -1), 1)) AS dl FROM turned),
halved AS (SELECT *, (md - m1) / 2 * CASE WHEN dl > 1e-9 THEN 2 / dl * tan(dl / 2) ELSE 1 END AS h FROM bent),
parts AS (
  SELECT *, CASE WHEN m1 IS NULL THEN md * cos(i2) ELSE h * (cos(i1) + cos(i2)) END AS dt,
    CASE WHEN m1 IS NULL THEN md * sin(i2) * cos(a2) ELSE h * (sin(i1) * cos(a1) + sin(i2) * cos(a2)) END AS dn,
    CASE WHEN m1 IS NULL THEN md * sin(i2) * sin(a2) ELSE h * (sin(i1) * sin(a1) + sin(i2) * sin(a2)) END AS de,
    CASE WHEN m1 IS NULL THEN {d(0)} ELSE degrees(dl) * 100 / (md - m1) END AS dls FROM halved),
survey AS (
  SELECT well_id, md, inc, azi, sum(dt) OVER w AS tvd, sum(dn) OVER w AS north, sum(de) OVER w AS east, dls FROM parts WINDOW w AS (PARTITION BY well_id ORDER BY md ROWS UNBOUNDED PRECEDING)),
next_station AS (SELECT *, lead(md) OVER w AS md2, lead(tvd) OVER w AS tvd2, lead(north) OVER w AS north2, lead(east) OVER w AS east2 FROM survey WINDOW w AS (PARTITION BY well_id ORDER BY md)),
along AS (
  SELECT s.well_id, s.idx, s.md, CASE WHEN n.md2 IS NULL THEN n.tvd + (s.md - n.md) * cos(radians(n.inc)) ELSE n.tvd + (s.md - n.md) / (n.md2 - n.md) * (n.tvd2 - n.tvd) END AS tvd,
    CASE WHEN n.md2 IS NULL THEN n.north + (s.md - n.md) * sin(radians(n.inc)) * cos(radians(n.azi)) ELSE n.north + (s.md - n.md) / (n.md2 - n.md) * (n.north2 - n.north) END AS north,
    CASE WHEN n.md2 IS NULL THEN n.east + (s.md - n.md) * sin(radians(n.inc)) * sin(radians(n.azi)) ELSE n.east + (s.md - n.md) / (n.md2 - n.md) * (n.east2 - n.east) END AS east
  FROM log_samples s ASOF JOIN next_station n ON s.well_id = n.well_id AND s.md >= n.md)
"""


def _survey(spark, sf_dir):
    return D.minimum_curvature(B.stations(spark, sf_dir))


def _along(spark, sf_dir):
    return D.along_survey(B.log_samples(spark, sf_dir).select("well_id", "idx", "md"), _survey(spark, sf_dir))


def min_curvature(spark, sf_dir):
    return B.rounded(_survey(spark, sf_dir))


def tvd_at_md(spark, sf_dir):
    return B.rounded(_along(spark, sf_dir).select("well_id", "idx", "tvd"))


def offset_at_md(spark, sf_dir):
    return B.rounded(_along(spark, sf_dir).select("well_id", "idx", "north", "east"))


SQL["min_curvature"] = SURVEYED + "SELECT well_id, md, round(inc, 6) + 0.0 AS inc, azi, round(tvd, 6) + 0.0 AS tvd, round(north, 6) + 0.0 AS north, round(east, 6) + 0.0 AS east, round(dls, 6) + 0.0 AS dls FROM survey"
SQL["tvd_at_md"] = SURVEYED + "SELECT well_id, idx, round(tvd, 6) + 0.0 AS tvd FROM along"
SQL["offset_at_md"] = SURVEYED + "SELECT well_id, idx, round(north, 6) + 0.0 AS north, round(east, 6) + 0.0 AS east FROM along"


def _positions(samples, spark, sf_dir):
    return B.rounded(D.path_positions(samples, B.wells(spark, sf_dir)).select("well_id", "idx", "lat", "lon"), digits=7)


def path_positions(spark, sf_dir):
    return _positions(_along(spark, sf_dir), spark, sf_dir)


SQL["path_positions"] = SURVEYED + f"""SELECT a.well_id, idx, round(lat + north * degrees({d(0.3048)} / {d(6371008.8)}), 7) AS lat, round(lon + east * degrees({d(0.3048)} / {d(6371008.8)}) / cos(radians(lat)), 7) AS lon
FROM along a JOIN wells w ON w.well_id = a.well_id"""


def md_from_tvd(spark, sf_dir):
    want = B.log_samples(spark, sf_dir).select("well_id", F.col("idx").alias("target_id"), (5000.3 + F.col("idx") * 0.4).alias("tvd"))
    return B.rounded(D.depth_from_tvd(want, _survey(spark, sf_dir)).select("well_id", "target_id", "md"))


SQL["md_from_tvd"] = SURVEYED + f""",
want AS (SELECT well_id, idx AS target_id, {d(5000.3)} + idx * {d(0.4)} AS z FROM log_samples),
hits AS (
  SELECT w.well_id, target_id, n.md AS m1, first_value(n.md) OVER (PARTITION BY w.well_id, target_id ORDER BY n.md) AS m0, first_value(n.tvd) OVER (PARTITION BY w.well_id, target_id ORDER BY n.md) AS t0, z, n.tvd AS t1, md2, tvd2, n.inc
  FROM want w JOIN next_station n ON n.well_id = w.well_id),
found AS (
  SELECT *, CASE WHEN z <= t0 THEN m0 - (t0 - z) WHEN tvd2 > t1 AND z >= t1 AND z <= tvd2 THEN m1 + (z - t1) / (tvd2 - t1) * (md2 - m1)
    WHEN md2 IS NULL AND z > t1 THEN m1 + (z - t1) / greatest(cos(radians(inc)), {d(0.05)}) END AS md FROM hits)
SELECT w.well_id, w.target_id, round(min_by(md, m1) FILTER (WHERE md IS NOT NULL), 6) + 0.0 AS md FROM want w LEFT JOIN found f ON f.well_id = w.well_id AND f.target_id = w.target_id GROUP BY w.well_id, w.target_id"""


def tvdss(spark, sf_dir):
    s = _along(spark, sf_dir).join(B.wells(spark, sf_dir).select("well_id", "kb"), "well_id")
    return B.rounded(s.select("well_id", "idx", D.subsea("tvd", "kb").alias("tvdss")))


def flatten_on_top(spark, sf_dir):
    s = D.flattened(B.log_samples(spark, sf_dir).select("well_id", "idx", "md"), B.tops(spark, sf_dir), "Beta")
    return B.rounded(s.select("well_id", "idx", "flat_z", "note"))


SQL["tvdss"] = SURVEYED + "SELECT a.well_id, idx, round(tvd - kb, 6) + 0.0 AS tvdss FROM along a JOIN wells w ON w.well_id = a.well_id"
SQL["flatten_on_top"] = B.CTE + "SELECT s.well_id, idx, round(coalesce(s.md - t.md, s.md), 6) + 0.0 AS flat_z, CASE WHEN t.md IS NULL THEN 'no such top: measured depth' END AS note FROM log_samples s LEFT JOIN tops t ON t.well_id = s.well_id AND t.name = 'Beta'"


def md_at_frame(spark, sf_dir):
    want = B.tops(spark, sf_dir).select("well_id", "name", (F.col("md") - 4999.75).alias("z"))
    frame = B.log_samples(spark, sf_dir).select("well_id", "md", (F.col("md") - 5000.0).alias("z"))
    return B.rounded(D.depth_from_frame(want, frame).select("well_id", "name", "md"))


SQL["md_at_frame"] = B.CTE + f"""SELECT t.well_id, name, round(least(t.md + {d(0.25)}, e.td), 6) AS md FROM tops t JOIN extent e ON e.well_id = t.well_id"""


def nearest_point_pair(spark, sf_dir):
    plugs = spread.dealt(B.points(spark, sf_dir).select("well_id", "point_id", "md", "core_phi"), B.parts(spark, sf_dir), "well_id")
    out = D.nearest(plugs, B.log_samples(spark, sf_dir).select("well_id", "md", "nphi"), ["nphi"], 1.0)
    return B.rounded(out.select("well_id", "point_id", "core_phi", "near_md", "near_nphi"))


SQL["nearest_point_pair"] = B.CTE + """,
r AS (
  SELECT p.well_id, p.point_id, p.core_phi, s.md, s.nphi, row_number() OVER (PARTITION BY p.point_id ORDER BY round(abs(s.md - p.md), 9), s.md DESC) AS k
  FROM points p LEFT JOIN log_samples s ON s.well_id = p.well_id AND s.md BETWEEN p.md - 1 AND p.md + 1)
SELECT well_id, point_id, round(core_phi, 6) AS core_phi, md AS near_md, round(nphi, 6) + 0.0 AS near_nphi FROM r WHERE k = 1"""


def resample_grid(spark, sf_dir):
    grid = B.log_samples(spark, sf_dir).where("idx % 2 = 0").select("well_id", (F.col("idx") / 2).cast("long").alias("i"), (F.col("md") + 0.2).alias("md"))
    return B.rounded(D.resample(grid, B.log_samples(spark, sf_dir).select("well_id", "md", "gr"), "gr", 1.5).select("well_id", "i", "gr"))


SQL["resample_grid"] = B.CTE + f""",
n AS (SELECT *, lead(md) OVER w AS md2, lead(gr) OVER w AS gr2 FROM log_samples WINDOW w AS (PARTITION BY well_id ORDER BY md))
SELECT well_id, idx // 2 AS i, round(CASE WHEN md2 IS NULL THEN NULL WHEN gr IS NOT NULL AND gr2 IS NOT NULL THEN gr + (md + {d(0.2)} - md) / (md2 - md) * (gr2 - gr) ELSE gr END, 6) + 0.0 AS gr FROM n WHERE idx % 2 = 0"""


def survey_summary(spark, sf_dir):
    return B.rounded(D.survey_summary(_survey(spark, sf_dir)))


SQL["survey_summary"] = SURVEYED + "SELECT well_id, count(*) AS stations, min(md) AS top_md, max(md) AS base_md, round(max(inc), 6) + 0.0 AS max_inc, round(max_by(sqrt(north * north + east * east), md), 6) + 0.0 AS displacement FROM survey GROUP BY well_id"


def inclination_from_tvd(spark, sf_dir):
    return B.rounded(D.inclination_from_positions(_survey(spark, sf_dir).select("well_id", "md", "tvd", "north", "east")).select("well_id", "md", "inc"), digits=4)


SQL["inclination_from_tvd"] = SURVEYED + "SELECT well_id, md, CASE WHEN lag(md) OVER w IS NOT NULL THEN round(degrees(acos(least(greatest((tvd - lag(tvd) OVER w) / (md - lag(md) OVER w), -1), 1))), 4) + 0.0 END AS inc FROM survey WINDOW w AS (PARTITION BY well_id ORDER BY md)"


def interval_thickness(spark, sf_dir):
    """Measured and true vertical thickness of every zone."""
    z = B.zones(spark, sf_dir)
    ends = z.select("well_id", "zone_no", F.explode(F.array("top", "base")).alias("md"))
    t = D.along_survey(ends, _survey(spark, sf_dir)).groupBy("well_id", "zone_no").agg((F.max("md") - F.min("md")).alias("dmd"), (F.max("tvd") - F.min("tvd")).alias("dtvd"))
    return B.rounded(t.withColumn("zone_no", F.col("zone_no").cast("long")))


SQL["interval_thickness"] = SURVEYED + """,
ends AS (SELECT well_id, zone_no, unnest([top, base]) AS md FROM zones),
placed AS (
  SELECT e.well_id, e.zone_no, e.md, CASE WHEN n.md2 IS NULL THEN n.tvd + (e.md - n.md) * cos(radians(n.inc)) ELSE n.tvd + (e.md - n.md) / (n.md2 - n.md) * (n.tvd2 - n.tvd) END AS tvd
  FROM ends e ASOF JOIN next_station n ON e.well_id = n.well_id AND e.md >= n.md)
SELECT well_id, CAST(zone_no AS BIGINT) AS zone_no, round(max(md) - min(md), 6) AS dmd, round(max(tvd) - min(tvd), 6) AS dtvd FROM placed GROUP BY well_id, zone_no"""


def events_at_depth(spark, sf_dir):
    """Core plugs inside the depth intervals (from orders) that contain them."""
    o = B.read(spark, sf_dir, "orders")
    n = B.read(spark, sf_dir, "supplier").agg(F.count("*").alias("n"), F.min("s_suppkey").alias("low"))
    # one row: the number of wells and the first id
    e = o.crossJoin(F.broadcast(n)).select((F.col("low") + F.col("o_orderkey") % F.col("n")).alias("well_id"), F.col("o_orderkey").alias("event_id"), (5000.0 + (F.col("o_orderkey") * 3 % 300).cast("double")).alias("top_md"), (5002.0 + (F.col("o_orderkey") * 3 % 300).cast("double")).alias("base_md"), F.col("o_orderpriority").alias("class"))
    hits = D.event_at(B.points(spark, sf_dir).select("well_id", "point_id", "md"), e)
    return hits.groupBy("well_id", "point_id", "class").agg(F.count("*").alias("events"))


SQL["events_at_depth"] = B.CTE + """,
e AS (SELECT low + o_orderkey % n AS well_id, CAST(5000 + o_orderkey * 3 % 300 AS DOUBLE) AS top_md, CAST(5002 + o_orderkey * 3 % 300 AS DOUBLE) AS base_md, o_orderpriority AS class FROM orders, (SELECT count(*) AS n, min(s_suppkey) AS low FROM supplier))
SELECT p.well_id, p.point_id, class, count(*) AS events FROM points p JOIN e ON e.well_id = p.well_id AND p.md BETWEEN top_md AND base_md GROUP BY ALL"""


def _frames(spark, sf_dir):
    """(modes, wells): every kind of depth frame, and wells without KB, without ground level or without either."""
    w = B.wells(spark, sf_dir)
    k = F.col("well_id")
    modes = w.select("well_id", F.when(k % 4 == 0, "MD").when(k % 4 == 1, "GL").when(k % 4 == 2, "TVDSS").otherwise("Beta").alias("mode"))
    return modes, w.select("well_id", F.when(k % 5 != 0, F.col("kb")).alias("kb"), F.when(k % 3 != 0, F.col("kb") - 12.0).alias("gl"))


def depth_frames(spark, sf_dir):
    """Every sample in the frame of its well; every other well has a survey."""
    modes, wells = _frames(spark, sf_dir)
    survey = _survey(spark, sf_dir).where("well_id % 2 = 1 OR well_id % 8 = 2")
    parameters = D.frame_parameters(modes, wells, B.tops(spark, sf_dir), survey)
    return B.rounded(D.framed(B.log_samples(spark, sf_dir).select("well_id", "idx", "md"), parameters, survey).drop("md"))


SQL["depth_frames"] = SURVEYED + f""",
m AS (SELECT well_id, well_id % 2 = 1 OR well_id % 8 = 2 AS surveyed, CASE well_id % 4 WHEN 0 THEN 'MD' WHEN 1 THEN 'GL' WHEN 2 THEN 'TVDSS' ELSE 'Beta' END AS mode,
  CASE WHEN well_id % 5 <> 0 THEN kb END AS kb, CASE WHEN well_id % 3 <> 0 THEN kb - 12 END AS gl FROM wells),
flat AS (SELECT t.well_id, CASE WHEN n.md2 IS NULL THEN n.tvd + (t.md - n.md) * cos(radians(n.inc)) ELSE n.tvd + (t.md - n.md) / (n.md2 - n.md) * (n.tvd2 - n.tvd) END AS top
  FROM (SELECT * FROM tops WHERE name = 'Beta') t ASOF JOIN next_station n ON t.well_id = n.well_id AND t.md >= n.md),
f AS (SELECT m.*, CASE mode WHEN 'GL' THEN CASE WHEN gl IS NOT NULL THEN coalesce(kb - gl, 0) END WHEN 'TVDSS' THEN coalesce(kb, gl) WHEN 'Beta' THEN top END AS off FROM m LEFT JOIN flat USING (well_id))
SELECT a.well_id, a.idx, round((CASE WHEN surveyed AND off IS NOT NULL THEN a.tvd ELSE a.md END) - coalesce(off, 0), 6) + 0.0 AS z,
  CASE WHEN off IS NULL THEN 'MD' WHEN mode = 'Beta' THEN 'FLAT' ELSE mode END AS kind,
  CASE WHEN mode = 'MD' THEN NULL WHEN off IS NULL THEN CASE WHEN mode = 'Beta' THEN 'no top Beta' WHEN mode = 'GL' AND kb IS NOT NULL THEN 'no ground level' ELSE 'no elevation' END
    ELSE nullif(concat_ws(', ', CASE WHEN mode <> 'Beta' AND kb IS NULL THEN 'from ground level' END, CASE WHEN surveyed THEN 'vertical by survey' END), '') END AS note
FROM along a JOIN f USING (well_id)"""


def nad27_shift(spark, sf_dir):
    lat, lon = S.nad27_to_wgs84("lat", "lon")
    return B.rounded(B.wells(spark, sf_dir).select("well_id", lat.alias("lat"), lon.alias("lon")), digits=8)


_A, _F = 6378206.4, 1 / 294.9786982
_E2, _DA, _DF = 2 * _F - _F * _F, 6378137.0 - 6378206.4, 1 / 298.257223563 - 1 / 294.9786982
SQL["nad27_shift"] = B.CTE + f""",
r AS (SELECT well_id, lat, lon, radians(lat) AS p, radians(lon) AS q, 1 - {d(repr(_E2))} * sin(radians(lat)) * sin(radians(lat)) AS w FROM wells)
SELECT well_id,
  round(lat + degrees((8 * sin(p) * cos(q) - 160 * sin(p) * sin(q) + 176 * cos(p) + {d(repr(_A * _DF + _F * _DA))} * sin(2 * p)) / ({d(repr(_A * (1 - _E2)))} / pow(w, {d(1.5)}))), 8) AS lat,
  round(lon + degrees((8 * sin(q) + 160 * cos(q)) / ({d(repr(_A))} / sqrt(w) * cos(p))), 8) AS lon FROM r"""

SECTION = B.CTE + f""",
section AS (SELECT *, row_number() OVER (ORDER BY lon ASC NULLS LAST, well_id) AS seq FROM wells),
pairs AS (SELECT seq, well_id, lead(well_id) OVER w AS next_id, lat, lon, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM section WINDOW w AS (ORDER BY seq))
"""


def well_distance(spark, sf_dir):
    return B.rounded(M.neighbours(M.section_order(B.wells(spark, sf_dir))).withColumn("seq", F.col("seq").cast("long")))


SQL["well_distance"] = SECTION + """SELECT seq, well_id, next_id, round(12742 * asin(sqrt(pow(sin((radians(lat2) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(lat2)) * pow(sin((radians(lon2) - radians(lon)) / 2), 2))), 6) AS km
FROM pairs WHERE next_id IS NOT NULL"""


def _faulted(spark, sf_dir):
    """Tops with Beta 100 deeper in every seventh well, so that some cross."""
    return B.tops(spark, sf_dir).withColumn("md", F.when((F.col("name") == "Beta") & (F.col("well_id") % 7 == 0), F.col("md") + 100.0).otherwise(F.col("md")))


_FAULTED = ", faulted AS (SELECT well_id, name, CASE WHEN name = 'Beta' AND well_id % 7 = 0 THEN md + 100 ELSE md END AS md FROM tops)"


def tops_crossing(spark, sf_dir):
    return M.crossing_tops(M.neighbours(M.section_order(B.wells(spark, sf_dir))), _faulted(spark, sf_dir))


def tops_missing(spark, sf_dir):
    section = M.section_order(B.wells(spark, sf_dir))
    return M.missing_tops(section, M.neighbours(section), B.tops(spark, sf_dir))


SQL["tops_crossing"] = SECTION + _FAULTED + """
SELECT p.well_id, p.next_id, a.name AS upper, b.name AS lower FROM pairs p JOIN faulted a ON a.well_id = p.well_id JOIN faulted b ON b.well_id = p.well_id AND a.md < b.md
JOIN faulted c ON c.well_id = p.next_id AND c.name = a.name JOIN faulted e ON e.well_id = p.next_id AND e.name = b.name WHERE e.md < c.md"""
SQL["tops_missing"] = SECTION + """,
reach AS (SELECT t.name, min(seq) AS first, max(seq) AS last FROM tops t JOIN section s ON s.well_id = t.well_id GROUP BY t.name)
SELECT DISTINCT CASE WHEN a.name IS NULL THEN p.well_id ELSE p.next_id END AS well_id, r.name FROM pairs p, reach r
LEFT JOIN tops a ON a.well_id = p.well_id AND a.name = r.name LEFT JOIN tops b ON b.well_id = p.next_id AND b.name = r.name
WHERE p.next_id IS NOT NULL AND (a.name IS NULL) <> (b.name IS NULL) AND r.first <= p.seq AND r.last >= p.seq"""


def isochore_values(spark, sf_dir):
    return B.rounded(M.isochore(B.wells(spark, sf_dir).select("well_id", "lat", "lon"), B.tops(spark, sf_dir), "Alpha", "Beta").select("well_id", "v", "reason"))


def structure_values(spark, sf_dir):
    return B.rounded(M.structure(B.wells(spark, sf_dir).select("well_id", "lat", "lon", "kb"), B.tops(spark, sf_dir), "Gamma").select("well_id", "v", "reason"))


SQL["isochore_values"] = B.CTE + """SELECT w.well_id, round(CASE WHEN b.md >= a.md THEN b.md - a.md END, 6) AS v, CASE WHEN a.md IS NULL THEN 'no Alpha' WHEN b.md IS NULL THEN 'no Beta' WHEN b.md < a.md THEN 'base above top' END AS reason
FROM wells w LEFT JOIN tops a ON a.well_id = w.well_id AND a.name = 'Alpha' LEFT JOIN tops b ON b.well_id = w.well_id AND b.name = 'Beta'"""
SQL["structure_values"] = B.CTE + "SELECT w.well_id, round(g.md - kb, 6) AS v, CASE WHEN g.md IS NULL THEN 'no Gamma' END AS reason FROM wells w LEFT JOIN tops g ON g.well_id = w.well_id AND g.name = 'Gamma'"


def _surfaces(spark, sf_dir):
    """Gamma structure maps, one for each group of wells."""
    w = B.wells(spark, sf_dir).withColumn("surface_id", F.floor(F.col("well_id") / 100))
    v = M.structure(w, B.tops(spark, sf_dir), "Gamma").where("v IS NOT NULL")
    return M.on_plane(v, ("surface_id",)).select("surface_id", F.col("well_id").alias("point_id"), "x", "y", "v")


def structure_surface(spark, sf_dir):
    return B.rounded(M.evaluate(M.fit_surfaces(_surfaces(spark, sf_dir), cells=40)), digits=3)


def structure_contours(spark, sf_dir):
    cells = M.evaluate(M.fit_surfaces(_surfaces(spark, sf_dir), cells=40))
    return B.rounded(M.contour_lines(cells, M.contour_steps(cells)), digits=3)


def plane_surface(spark, sf_dir):
    """Wells on a lattice of 5 columns a surface, with control values on a plane: the spline is the plane."""
    k = F.col("s_suppkey")
    x, y = (1000.0 * (k % 5)).cast("double"), (1000.0 * F.floor((k % 100) / 5)).cast("double")
    points = B.read(spark, sf_dir, "supplier").select(F.floor(k / 100).alias("surface_id"), F.col("s_suppkey").alias("point_id"), x.alias("x"), y.alias("y"), (100.0 + 0.01 * x - 0.02 * y).alias("v"))
    return B.rounded(M.evaluate(M.fit_surfaces(points, cells=40)), digits=3)


SQL["plane_surface"] = f"""
WITH p AS (SELECT s_suppkey // 100 AS surface_id, {d(1000)} * (s_suppkey % 5) AS x, {d(1000)} * ((s_suppkey % 100) // 5) AS y FROM supplier),
e AS (SELECT surface_id, max(x) AS w, max(y) AS h, greatest(max(x), max(y)) AS size FROM p GROUP BY surface_id HAVING count(*) >= 3 AND max(x) * max(y) >= 0.002 * pow(greatest(max(x), max(y)), 2)),
g AS (SELECT *, greatest({d(200)}, {d(0.15)} * size) AS pad, (size + 2 * greatest({d(200)}, {d(0.15)} * size)) / 40 AS cell FROM e),
n AS (SELECT *, unnest(range(0, CAST(ceil((w + 2 * pad) / cell) AS BIGINT) + 1)) AS i FROM g),
m AS (SELECT *, unnest(range(0, CAST(ceil((h + 2 * pad) / cell) AS BIGINT) + 1)) AS j FROM n),
c AS (SELECT *, i * cell - pad AS x, j * cell - pad AS y FROM m)
SELECT surface_id, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(x, 3) + 0.0 AS x, round(y, 3) + 0.0 AS y,
  CASE WHEN sqrt(pow(greatest(-x, x - w, 0), 2) + pow(greatest(-y, y - h, 0), 2)) <= pad * (1 + {d(1e-12)}) THEN round(100 + {d(0.01)} * x - {d(0.02)} * y, 3) + 0.0 END AS z FROM c"""


def merged_points(spark, sf_dir):
    """Points 10 m apart in threes, 100 m from the next three: the earlier end takes the middle one, the other end is a centre of its own. Odd threes are counted backwards."""
    s = B.log_samples(spark, sf_dir).select("well_id", "idx", "rt")
    three, k = F.floor(F.col("idx") / 3), F.col("idx") % 3
    order = F.col("idx") + F.when(three % 2 == 1, 2 - 2 * k).otherwise(0)
    points = s.select(F.col("well_id").alias("surface_id"), order.alias("point_id"), (100.0 * (three % 20) + 10.0 * k).alias("x"), (100.0 * F.floor(three / 20)).cast("double").alias("y"), F.col("rt").alias("v"))
    return B.rounded(X.merge_close(points, M.CLOSE_M), digits=6)


SQL["merged_points"] = B.CTE + f""",
s AS (SELECT well_id AS surface_id, idx // 3 AS three, idx % 3 AS k, CASE WHEN (idx // 3) % 2 = 1 THEN idx + 2 - 2 * (idx % 3) ELSE idx END AS point_id,
  {d(100)} * ((idx // 3) % 20) + {d(10)} * (idx % 3) AS x, {d(100)} * ((idx // 3) // 20) AS y, rt AS v FROM log_samples),
g AS (SELECT *, CASE WHEN three % 2 = 0 THEN CASE WHEN k = 2 THEN 2 ELSE 0 END WHEN k = 0 AND count(*) OVER t <> 2 THEN 0 ELSE count(*) OVER t - 1 END AS centre FROM s WINDOW t AS (PARTITION BY surface_id, three))
SELECT surface_id, min(CASE WHEN k = centre THEN point_id END) AS point_id, max(CASE WHEN k = centre THEN x END) AS x, max(y) AS y, round(avg(v), 6) + 0.0 AS v, count(*) AS n
FROM g GROUP BY surface_id, three, centre"""


def _cone(spark, sf_dir):
    """(cells, surfaces): a cone on a grid of 24 by 24 cells of 10 m for each well with so many samples."""
    i, j = (F.col("idx") % 24).cast("int"), F.floor(F.col("idx") / 24).cast("int")
    x, y = 10.0 * i, 10.0 * j
    # counted in the table itself, so that the samples are numbered only once
    whole = B.read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("surface_id")).count().where("count >= 576").select("surface_id")
    s = B.log_samples(spark, sf_dir).where("idx < 576")
    return s.select(F.col("well_id").alias("surface_id"), i.alias("i"), j.alias("j"), x.alias("x"), y.alias("y"), F.sqrt((x - 117.0) * (x - 117.0) + (y - 113.0) * (y - 113.0)).alias("z")), whole


def cone_contours(spark, sf_dir):
    """Rings about the top of a cone, and arcs where the grid ends: lines, points, and how far those are from the ring's radius at most."""
    cells, whole = _cone(spark, sf_dir)
    # only wells with all samples have a step; those without are left out there
    points = M.contour_paths(M.contour_segments(cells, whole.withColumn("step", F.lit(20.0)).hint("merge")))
    radius = F.sqrt((F.col("x") - 117.0) * (F.col("x") - 117.0) + (F.col("y") - 113.0) * (F.col("y") - 113.0))
    lines = points.groupBy("surface_id", "level", "line").agg(F.max("closed").alias("closed"), F.count(F.when(~F.col("closed") | (F.col("seq") > 0), 1)).alias("crossings"), F.max(F.abs(radius - F.col("level"))).alias("off"))
    by = lines.groupBy("surface_id", "level").agg(F.count("*").alias("lines"), F.count(F.when(F.col("closed"), 1)).alias("rings"), F.sum("crossings").alias("crossings"), F.max("off").alias("off"))
    return by.select("surface_id", "level", "lines", "rings", "crossings", (F.col("off") < 1.3).alias("round"))


SQL["cone_contours"] = B.CTE + f""",
c AS (SELECT well_id, idx % 24 AS i, idx // 24 AS j, sqrt(pow(10 * (idx % 24) - {d(117)}, 2) + pow(10 * (idx // 24) - {d(113)}, 2)) AS z FROM log_samples WHERE idx < 576),
w AS (SELECT well_id FROM c GROUP BY well_id HAVING count(*) = 576),
l AS (SELECT {d(20)} * unnest(range(1, 10)) AS level),
e AS (SELECT a.well_id, level FROM c AS a JOIN c AS b ON a.well_id = b.well_id AND b.i - a.i BETWEEN 0 AND 1 AND b.j - a.j BETWEEN 0 AND 1 AND (b.i, b.j) <> (a.i, a.j) JOIN l ON least(a.z, b.z) < level AND greatest(a.z, b.z) >= level)
SELECT well_id AS surface_id, level, CASE WHEN level < 113 THEN 1 WHEN level < 159 THEN 4 ELSE 3 END AS lines, CASE WHEN level < 113 THEN 1 ELSE 0 END AS rings, count(*) AS crossings, true AS round
FROM e JOIN w USING (well_id) GROUP BY well_id, level"""


QUERIES |= {f.__name__: f for f in (min_curvature, path_positions, tvd_at_md, offset_at_md, md_from_tvd, tvdss, depth_frames, flatten_on_top, md_at_frame, nearest_point_pair, resample_grid, survey_summary, inclination_from_tvd, interval_thickness, events_at_depth, nad27_shift, well_distance, tops_crossing, tops_missing, isochore_values, structure_values, structure_surface, structure_contours, plane_surface, merged_points, cone_contours)}
# names under which the queries over every sample were known while those above kept some
for _name in ("path_positions", "md_from_tvd"):
    QUERIES[f"{_name}_all"], SQL[f"{_name}_all"] = QUERIES[_name], SQL[_name]
