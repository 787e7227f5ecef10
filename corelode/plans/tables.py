"""Queries over well identity, matching of rows, import plans and incremental state."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import tables as T
from . import base as B

QUERIES, SQL = {}, {}

#: API-like numbers of suppliers, with and without the bore, separators and a lost zero.
API = "CASE k % 4 WHEN 0 THEN '05123' || lpad(CAST(k % 100000 AS VARCHAR), 5, '0') WHEN 1 THEN '05-123-' || lpad(CAST(k % 100000 AS VARCHAR), 5, '0') || '-01-00' WHEN 2 THEN '5123' || lpad(CAST(k % 100000 AS VARCHAR), 5, '0') ELSE 'UWI ' || CAST(k AS VARCHAR) END"


def _api(k):
    five = F.lpad((F.col(k) % 100000).cast("string"), 5, "0")
    n = F.col(k) % 4
    return F.when(n == 0, F.concat(F.lit("05123"), five)).when(n == 1, F.concat(F.lit("05-123-"), five, F.lit("-01-00"))).when(n == 2, F.concat(F.lit("5123"), five)).otherwise(F.concat(F.lit("UWI "), F.col(k).cast("string")))


def api_key(spark, sf_dir):
    s = B.read(spark, sf_dir, "supplier").select("s_suppkey", S.api_identity(S.clean_api(_api("s_suppkey"))).alias("a"))
    return s.select("s_suppkey", F.col("a.well").alias("well"), F.col("a.bore").alias("bore"), F.col("a.key").alias("key"), F.col("a.us").alias("us"), S.format_api("a").alias("formatted"))


_KEYED = f"""
WITH raw AS (SELECT s_suppkey, s_name, s_suppkey AS k, {API} AS api FROM supplier),
clean AS (SELECT *, CASE WHEN regexp_full_match(api, '[0-9 -]+') AND length(regexp_replace(api, '[^0-9]', '', 'g')) IN (9, 11, 13) AND api NOT LIKE '0%' THEN '0' || regexp_replace(api, '[^0-9]', '', 'g') ELSE api END AS c FROM raw),
digits AS (SELECT *, regexp_replace(c, '[^0-9]', '', 'g') AS d, NOT regexp_matches(c, '[A-Z]') AND length(regexp_replace(c, '[^0-9]', '', 'g')) BETWEEN 10 AND 14 AS us FROM clean),
keyed AS (
  SELECT *, CASE WHEN us THEN d[1:10] ELSE replace(c, ' ', '') END AS well, CASE WHEN NOT us THEN '' WHEN length(d) >= 12 THEN d[11:12] ELSE '00' END AS bore, us AND length(d) >= 12 AS has_bore FROM digits)
"""
SQL["api_key"] = _KEYED + "SELECT s_suppkey, well, bore, CASE WHEN us THEN well || '-' || bore ELSE well END AS key, us, CASE WHEN us THEN well[1:2] || '-' || well[3:5] || '-' || well[6:10] || '-' || bore ELSE well END AS formatted FROM keyed"


def _wells(spark, sf_dir):
    return B.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("well_id"), F.col("s_name").alias("name"), F.lit(None).cast("string").alias("alias"), S.clean_api(_api("s_suppkey")).alias("api"))


def _rows(spark, sf_dir):
    """Rows of side tables, from part: an API, a name in other spelling, or neither."""
    n = B.read(spark, sf_dir, "supplier").agg(F.count("*").alias("n"), F.min("s_suppkey").alias("low"))
    # one row: the number of wells and the first id
    p = B.read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice", "p_size").crossJoin(F.broadcast(n)).withColumn("w", F.col("low") + F.col("p_partkey") % F.col("n"))
    named = p.join(B.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("w"), "s_name"), "w", "left")
    kind = F.col("p_partkey") % 3
    return named.select(
        F.col("p_partkey").alias("row_id"),
        F.when(kind == 1, F.lower(F.regexp_replace("s_name", "#", " - "))).when(kind == 2, F.concat(F.lit("Other "), (F.col("p_partkey") % 7).cast("string"))).alias("name"),
        F.lit(None).cast("string").alias("alias"),
        F.when(kind == 0, S.clean_api(_api("w"))).alias("api"),
        "p_retailprice",
        "p_size",
    )


def match_wells(spark, sf_dir):
    return T.match_wells(_rows(spark, sf_dir), _wells(spark, sf_dir)).select("row_id", "well_id", "matched_by")


def unmatched_rows(spark, sf_dir):
    return T.unmatched(T.match_wells(_rows(spark, sf_dir), _wells(spark, sf_dir)))


_MATCHED = _KEYED + """,
r AS (
  SELECT p_partkey AS row_id, p_partkey % 3 AS kind, low + p_partkey % n AS w, p_retailprice, p_size FROM part, (SELECT count(*) AS n, min(s_suppkey) AS low FROM supplier)),
rows_ AS (
  SELECT r.*, CASE kind WHEN 1 THEN lower(replace(k.s_name, '#', ' - ')) WHEN 2 THEN 'Other ' || CAST(row_id % 7 AS VARCHAR) END AS name, CASE WHEN kind = 0 THEN k.c END AS api, k.well, k.bore, k.has_bore, k.us AND kind = 0 AS us
  FROM r LEFT JOIN keyed k ON k.s_suppkey = r.w),
hits AS (SELECT row_id, s_suppkey, r.bore = k.bore AS own FROM rows_ r JOIN keyed k ON r.us AND k.us AND r.well = k.well AND (NOT r.has_bore OR NOT k.has_bore OR r.bore = k.bore)),
one AS (SELECT row_id, CASE WHEN count(*) = 1 THEN min(s_suppkey) WHEN count(*) FILTER (WHERE own) = 1 THEN min(s_suppkey) FILTER (WHERE own) END AS w FROM hits GROUP BY row_id),
names AS (SELECT regexp_replace(upper(s_name), '[^A-Z0-9]', '', 'g') AS nk, min(s_suppkey) AS w FROM supplier GROUP BY 1),
matched AS (
  SELECT r.*, coalesce(o.w, n.w) AS well_id, CASE WHEN o.w IS NOT NULL THEN 'api' WHEN n.w IS NOT NULL THEN 'name' END AS matched_by
  FROM rows_ r LEFT JOIN one o ON o.row_id = r.row_id LEFT JOIN names n ON n.nk = regexp_replace(upper(r.name), '[^A-Z0-9]', '', 'g'))
"""
SQL["match_wells"] = _MATCHED + "SELECT row_id, well_id, matched_by FROM matched"
SQL["unmatched_rows"] = _MATCHED + "SELECT coalesce(name, api, '?') AS name, count(*) AS \"rows\" FROM matched WHERE well_id IS NULL GROUP BY 1"


def _values(spark, sf_dir):
    m = T.match_wells(_rows(spark, sf_dir), _wells(spark, sf_dir)).where("well_id IS NOT NULL")
    gl = (4900.0 + F.floor(F.col("p_size") / 10) * 10.0 + (F.col("row_id") % 3) * 0.02).cast("string")
    state = F.when(F.col("row_id") % 2 == 0, "Colorado").otherwise(" COLORADO ")
    each = F.array(F.struct(F.lit("gl").alias("field"), F.lit("num").alias("kind"), gl.alias("value")), F.struct(F.lit("state").alias("field"), F.lit("text").alias("kind"), state.alias("value")))
    return m.select("well_id", "row_id", F.explode(each).alias("v")).select("well_id", "row_id", "v.*")


def _current(spark, sf_dir):
    return B.read(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("well_id"), F.lit("gl").alias("field"), F.lit("4900.0").alias("current"))


def import_plan(spark, sf_dir):
    p = T.import_plan(_values(spark, sf_dir), _current(spark, sf_dir))
    return p.select("well_id", "field", "status", S.to_double("current").alias("current"), F.when(F.col("field") == "gl", F.round(S.to_double("choice"), 2)).alias("choice"), "offered", "votes")


SQL["import_plan"] = _MATCHED + """,
v AS (SELECT well_id, row_id, CAST(4900 AS DOUBLE) + (p_size // 10) * CAST(10 AS DOUBLE) + (row_id % 3) * CAST(0.02 AS DOUBLE) AS x FROM matched WHERE well_id IS NOT NULL),
g AS (SELECT well_id, floor(x / 10) AS chain, count(*) AS votes, min(row_id) AS first_row, arg_min(x, row_id) AS x FROM v GROUP BY 1, 2),
cur AS (SELECT s_suppkey AS well_id, CAST(4900 AS DOUBLE) AS current FROM supplier WHERE s_suppkey % 2 = 0),
j AS (SELECT g.*, current, coalesce(abs(x - current) <= CAST(0.05 AS DOUBLE), false) AS agrees FROM g LEFT JOIN cur USING (well_id)),
m AS (SELECT *, max(votes) OVER (PARTITION BY well_id) AS top FROM j),
b AS (
  SELECT well_id, any_value(current) AS current, count(*) AS offered, max(CASE WHEN agrees THEN 1 ELSE 0 END) AS agree, max(top) AS top, count(*) FILTER (WHERE votes = top) AS ties,
    arg_min(x, {'v': -votes, 'a': CASE WHEN agrees THEN 0 ELSE 1 END, 'r': first_row}) AS best FROM m GROUP BY well_id),
s AS (SELECT *, CASE WHEN offered = 1 AND current IS NULL THEN 'fill' WHEN offered = 1 AND agree = 1 THEN 'same' ELSE 'conflict' END AS status FROM b)
SELECT well_id, 'gl' AS field, status, current, round(CASE WHEN status = 'same' OR (offered > 1 AND ties > 1 AND current IS NOT NULL) THEN current ELSE best END, 2) AS choice, offered, top AS votes FROM s
UNION ALL SELECT well_id, 'state', 'fill', NULL, NULL, 1, count(*) FROM v GROUP BY well_id"""


def derived_elevations(spark, sf_dir):
    v = B.read(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("well_id"),
        F.explode(F.array(
            F.struct(F.lit("gl").alias("field"), (5000.0 + F.col("s_suppkey") % 50).cast("string").alias("value")),
            F.struct(F.lit("kbgl").alias("field"), F.lit("12.5").alias("value")),
            F.struct(F.lit("kb").alias("field"), F.when(F.col("s_suppkey") % 3 == 0, (5013.0 + F.col("s_suppkey") % 50 + F.col("s_suppkey") % 2).cast("string")).alias("value")),
        )).alias("v"),
    ).select("well_id", "v.*")
    return B.rounded(T.derived_elevations(v))


SQL["derived_elevations"] = """
WITH v AS (SELECT s_suppkey AS well_id, CASE WHEN s_suppkey % 3 = 0 THEN CAST(5013 + s_suppkey % 50 + s_suppkey % 2 AS DOUBLE) END AS kb, CAST(5000 + s_suppkey % 50 AS DOUBLE) AS gl, CAST(12.5 AS DOUBLE) AS kbgl FROM supplier)
SELECT well_id, kb, gl, kbgl, CASE WHEN kb IS NULL THEN round(gl + kbgl, 2) END AS derived_kb, coalesce(abs(kb - gl - kbgl) > CAST(0.5 AS DOUBLE), false) AS disagrees FROM v"""


def merge_targets(spark, sf_dir):
    """Orders as files: of a well by API, by name, or nameless."""
    n = B.read(spark, sf_dir, "supplier").agg(F.count("*").alias("n"), F.min("s_suppkey").alias("low"))
    # one row: the number of wells and the first id
    o = B.read(spark, sf_dir, "orders").select("o_orderkey").crossJoin(F.broadcast(n)).withColumn("w", F.col("low") + F.col("o_orderkey") % F.col("n"))
    k = F.col("o_orderkey") % 3
    five = F.lpad((F.col("w") % 100000).cast("string"), 5, "0")
    f = o.select(F.col("o_orderkey").alias("file_id"), F.when(k != 2, F.concat(F.lit("Well "), F.col("w").cast("string"))).alias("name"), F.when(k == 0, F.concat(F.lit("05123"), five, F.when(F.col("o_orderkey") % 2 == 0, "01").otherwise(""))).alias("api"))
    return T.merge_targets(f).select("file_id", "target")


SQL["merge_targets"] = """
WITH o AS (SELECT o_orderkey, low + o_orderkey % n AS w FROM orders, (SELECT count(*) AS n, min(s_suppkey) AS low FROM supplier)),
f AS (SELECT o_orderkey AS file_id, CASE WHEN o_orderkey % 3 <> 2 THEN 'WELL' || CAST(w AS VARCHAR) END AS nk, CASE WHEN o_orderkey % 3 = 0 THEN '05123' || lpad(CAST(w % 100000 AS VARCHAR), 5, '0') || CASE WHEN o_orderkey % 2 = 0 THEN '-01' ELSE '-00' END END AS key FROM o),
b AS (SELECT nk, count(DISTINCT key) AS bores, min(key) AS bore FROM f WHERE key IS NOT NULL AND nk IS NOT NULL GROUP BY nk)
SELECT file_id, coalesce(key, CASE WHEN bores = 1 THEN bore END, 'name:' || f.nk, 'file:' || CAST(file_id AS VARCHAR)) AS target FROM f LEFT JOIN b ON b.nk = f.nk"""


def merged_picks(spark, sf_dir):
    tops = B.tops(spark, sf_dir)
    picks = B.wells(spark, sf_dir).select("well_id", F.lit("Beta").alias("name"), F.lit(5100.0).alias("md"))
    return T.merge_picks(tops, picks)


SQL["merged_picks"] = B.CTE + "SELECT well_id, name, md FROM tops UNION ALL SELECT well_id, 'Beta', CAST(5100 AS DOUBLE) FROM wells WHERE well_id NOT IN (SELECT well_id FROM tops WHERE name = 'Beta')"


def event_summary(spark, sf_dir):
    """Hourly sums of the event stream, as the streaming summary gives them."""
    from ..streaming.ingest import hourly

    return B.rounded(hourly(B.read(spark, sf_dir, "events")).select("start", "event_type", "n", "total"))


SQL["event_summary"] = "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) + 0.0 AS total FROM events GROUP BY 1, 2"

QUERIES |= {f.__name__: f for f in (api_key, match_wells, unmatched_rows, import_plan, derived_elevations, merge_targets, merged_picks, event_summary)}
