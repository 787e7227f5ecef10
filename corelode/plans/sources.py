"""Queries over sources and sinks: logs written as LAS text and read again, delimited rows, and page text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import depth as D
from ..operators import tokens as K
from ..sources import export, las, store
from ..streaming import replace
from . import base as B
from .depth import SURVEYED
from .petrophysics import d

QUERIES, SQL = {}, {}
CURVES = [("gr", "GAPI"), ("rhob", "G/CC"), ("rt", "OHMM")]


def _files(spark, sf_dir):
    """LAS text of every well, as whole files."""
    survey = D.minimum_curvature(B.stations(spark, sf_dir))
    lines = export.las_lines(B.log_samples(spark, sf_dir), CURVES, B.wells(spark, sf_dir), B.tops(spark, sf_dir), survey, digits=10)
    return export.las_texts(lines).select(F.col("well_id").cast("string").alias("file"), "value")


def _dealt(texts):
    """(lines, headers) of texts that are a table; headers are written, and texts are dealt by file before they fall into lines."""
    return las.lines(texts.repartition("file")), store.written(las.headers(las.lines(texts)), "headers")


def _parsed(files):
    """(lines, headers) of texts, which are written: they are read several times by what follows, and made but once."""
    return _dealt(store.written(files.select("file", "value"), "texts"))


def _records(data):
    """Records, written: samples() counts them and then reads them again. The numbers of lines are written, too: wrapped lines are put together from them, others taken as they are."""
    return store.written(las.records(store.written(data, "data")), "records")


def las_round_trip(spark, sf_dir):
    rows, head = _parsed(_files(spark, sf_dir))
    long = las.samples(_records(las.data_rows(rows, las.file_facts(head))), las.curves(head))
    return B.rounded(long.select(F.col("file").cast("long").alias("well_id"), "mnemonic", "unit", F.col("idx").cast("long").alias("idx"), "md", "value"), digits=5)


SQL["las_round_trip"] = B.CTE + " UNION ALL ".join(f"SELECT well_id, '{c.upper()}' AS mnemonic, '{u}' AS unit, idx, md, round({c}, 5) + 0.0 AS value FROM log_samples" for c, u in CURVES)


def las_wells(spark, sf_dir):
    _, head = _parsed(_files(spark, sf_dir))
    w = las.wells(head, las.curves(head))
    return B.rounded(w.select(F.col("file").cast("long").alias("well_id"), "name", "lat", "lon", "kb", "depth_unit", "kb_suspect", las.datum_elevation().alias("datum")), digits=4)


SQL["las_wells"] = B.CTE + "SELECT well_id, name, round(lat, 4) AS lat, round(lon, 4) AS lon, round(kb, 4) AS kb, 'ft' AS depth_unit, false AS kb_suspect, round(kb, 4) AS datum FROM wells"


def las_survey(spark, sf_dir):
    rows, _ = _parsed(_files(spark, sf_dir))
    return B.rounded(las.survey(rows).select(F.col("file").cast("long").alias("well_id"), "md", "inc", "azi", "tvd"), digits=2)


SQL["las_survey"] = SURVEYED + "SELECT well_id, md, round(inc, 2) + 0.0 AS inc, azi, round(tvd, 2) + 0.0 AS tvd FROM survey"


def las_problems(spark, sf_dir):
    """Problems by kind, with a stray line in every fifth file."""
    files = _files(spark, sf_dir).withColumn("value", F.when(F.col("file").cast("long") % 5 == 0, F.concat("value", F.lit("\nbad row here"))).otherwise(F.col("value")))
    rows, head = _parsed(files)
    data = store.written(las.data_rows(rows, las.file_facts(head)), "data")
    return las.diagnose(rows, head, data, las.records(data)).groupBy("level", "category").agg(F.count("*").alias("files"))


SQL["las_problems"] = " UNION ALL ".join(f"SELECT 'warn' AS level, '{c}' AS category, count(*) AS files FROM supplier WHERE s_suppkey % 5 = 0" for c in ("rows", "width"))


def _dialect_folder(spark, sf_dir):
    """Logs one after another in text files of the shared folder, as many as there are tasks (a file for each would take longer to make than to read): every third well unwrapped,
    wrapped with swapped labels, and as LAS 3 with commas."""
    number = lambda c: F.coalesce(F.round(c, 6).cast("string"), F.lit(export.NULL_TEXT))
    s = B.log_samples(spark, sf_dir).select("well_id", F.col("well_id") % 3, *[number(c).alias(c) for c in ("md", "gr", "rhob", "rt")], F.col("md").alias("depth")).toDF("well_id", "kind", "md", "gr", "rhob", "rt", "depth")
    wrapped = F.concat_ws("\n", "md", F.concat_ws(" ", "gr", "rhob"), "rt")
    row = F.when(F.col("kind") == 0, F.concat_ws(" ", "md", "gr", "rhob", "rt")).when(F.col("kind") == 1, wrapped).otherwise(F.concat_ws(",", "md", "gr", "rhob", "rt"))
    body = s.groupBy("well_id", "kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("depth", row.alias("row")))), lambda x: x["row"]), "\n").alias("body"))
    version = F.when(F.col("kind") == 0, "~Version\nVERS. 2.0 :\nWRAP. NO :\n").when(F.col("kind") == 1, "~Version\nVERS. 1.2 :\nWRAP. YES :\n").otherwise("~Version\nVERS. 3.0 :\nDLM. COMMA :\n")
    label = lambda m, label, v: F.when(F.col("kind") == 1, F.concat(F.lit(f"{m}. {label} : "), F.col(v))).otherwise(F.concat(F.lit(f"{m}. "), F.col(v), F.lit(f" : {label}")))
    well = F.concat_ws("\n", label("WELL", "WELL", "name"), label("UWI", "UNIQUE WELL ID", "well_id"))
    curves = F.concat(F.when(F.col("kind") == 2, "\n~Log_Definition\n").otherwise("\n~Curves\n"), F.lit("DEPT.FT :\nGR.GAPI :\nRHOB.G/CC :\nRT.OHMM :\n"), F.when(F.col("kind") == 2, "~Log_Data | Log_Definition\n").otherwise("~A\n"))
    text = F.concat(version, F.lit(f"~Well\nNULL. {export.NULL_TEXT} : NULL\n"), well, curves, F.col("body"))
    path = store.new_path(spark, "logs")
    export.write_logs(body.join(B.wells(spark, sf_dir).select("well_id", "name"), "well_id").select(text.alias("value")), path)
    return path


def _ranged(spark, sf_dir):
    """(lines, their ranges) of those files, read in ranges of bytes."""
    # numbered once, and read from the table as often as needed
    raw = store.written(las.read_ranges(spark, _dialect_folder(spark, sf_dir), logs=True), "raw")
    known = store.written(las.ranges(raw), "ranges")
    return las.range_lines(raw, known), known


def _well_ids(head):
    """(file, well_id) as the logs tell."""
    return head.where("section = 'W' AND mnemonic = 'UWI'").select("file", F.col("value").cast("long").alias("well_id"))


def las_ranges(spark, sf_dir):
    rows, known = _ranged(spark, sf_dir)
    head = store.written(las.headers(rows), "headers")
    recs = _records(las.data_rows(rows, las.file_facts(head), known))
    long = las.samples(recs, las.curves(head).join(_well_ids(head), "file"))
    # depths are written in full
    return B.rounded(long.select("well_id", "mnemonic", "idx", "md", "value"), "md", digits=5)


SQL["las_ranges"] = B.CTE + " UNION ALL ".join(f"SELECT well_id, '{c.upper()}' AS mnemonic, idx, md, round({c}, 5) + 0.0 AS value FROM log_samples" for c, _ in CURVES)


def las_dialects(spark, sf_dir):
    """The name of each well, also where label and value are swapped, and what kind of file it is."""
    rows, _ = _ranged(spark, sf_dir)
    head = store.written(las.headers(rows), "headers")
    w = las.wells(head, las.curves(head)).join(las.file_facts(head), "file").join(_well_ids(head), "file")
    return w.select("well_id", "name", "wrap", "las3", "delimiter", F.col("n_curves").cast("long").alias("n_curves"))


SQL["las_dialects"] = "SELECT s_suppkey AS well_id, s_name AS name, s_suppkey % 3 = 1 AS wrap, s_suppkey % 3 = 2 AS las3, CASE WHEN s_suppkey % 3 = 2 THEN 'COMMA' ELSE 'SPACE' END AS delimiter, 4 AS n_curves FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem)"


def reopened_files(spark, sf_dir):
    """Two batches of logs, the second of them twice. It opens every fifth file again, with doubled values and in every tenth the name of another well, and brings older copies of every seventh."""
    s = B.samples_once(spark, sf_dir)

    def batch(wells, factor, modified, moved=None):
        gr = F.coalesce((F.col("gr") * factor).cast("string"), F.lit(export.NULL_TEXT))
        rows = s.where(wells).groupBy("well_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("md", F.concat_ws(" ", F.col("md").cast("string"), gr).alias("row")))), lambda x: x["row"]), "\n").alias("body"))
        name = F.when(F.lit(moved is not None) & (F.col("well_id") % 10 == 0), F.col("well_id") + (moved or 0)).otherwise(F.col("well_id"))
        text = F.concat(F.lit("~V\nVERS. 2.0 :\n~W\nWELL. "), name.cast("string"), F.lit(" : WELL\n~C\nDEPT.FT :\nGR.GAPI :\n~A\n"), F.col("body"))
        path = F.concat(F.lit(f"/in/{modified}/W"), F.col("well_id").cast("string"), F.lit(".las"))
        return rows.select(path.alias("path"), F.lit(modified).cast("timestamp").alias("modified"), text.alias("value"))

    def wells_of(files):
        head = las.headers(las.lines(files.select("file", "value")))
        return head.where("section = 'W' AND mnemonic = 'WELL'").select("file", F.col("value").alias("well_id"))

    def build(files):
        rows, head = _dealt(files.select("file", "value"))
        long = las.samples(_records(las.data_rows(rows, las.file_facts(head))), las.curves(head))
        by = long.groupBy("file").agg(F.count("*").alias("rows"), F.sum("value").alias("total"))
        return files.select("file", "well_id").join(by, "file").groupBy(F.col("well_id").cast("long").alias("well_id")).agg(F.sum("rows").alias("rows"), F.sum("total").alias("total"))

    at = store.new_path(spark, "ingest")
    handle = replace.replaced(replace.Files(spark, f"{at}/kept"), f"{at}/wells", wells_of, build)
    second = batch("well_id % 5 = 0", 2, "2024-03-01", 1_000_000).unionByName(batch("well_id % 7 = 0", 9, "2023-01-01"))
    for n, files in ((0, batch("true", 1, "2024-01-01")), (1, second), (1, second)):
        handle(files, n)
    return B.rounded(replace.table(spark, f"{at}/wells"), digits=4)


SQL["reopened_files"] = B.CTE + f"""SELECT CASE WHEN well_id % 10 = 0 THEN well_id + 1000000 ELSE well_id END AS well_id, count(*) AS rows,
  round(sum(gr) * CASE WHEN well_id % 5 = 0 THEN {d(2)} ELSE {d(1)} END, 4) + 0.0 AS total FROM log_samples GROUP BY well_id"""


def page_tokens(spark, sf_dir, samples=None):
    """Page text made of lineitem: a depth label every 60 samples of a well, pages of 300 samples, and stray numbers."""
    s = B.log_samples(spark, sf_dir) if samples is None else samples
    # no sample is both
    label, stray = F.col("idx") % 60 == 0, F.col("idx") % 150 == 75
    text = F.when(label, F.format_number("md", 0)).otherwise(F.col("idx").cast("string"))
    y = (F.col("idx") % 300).cast("double") * 2.0 + F.when(label, 0.0).otherwise(7.0)
    page = F.floor(F.col("idx") / 300).cast("int")
    return s.where(label | stray).select(F.col("well_id").alias("doc_id"), page.alias("page"), text.alias("text"), F.lit(40.0).alias("x"), y.alias("y"), F.lit(30.0).alias("w"), F.lit(10.0).alias("h"))


def page_scales(spark, sf_dir):
    # places and labels are read several times
    s = store.written(B.log_samples(spark, sf_dir).select("well_id", "idx", "md"), "places")
    labels = store.written(K.depth_labels(page_tokens(spark, sf_dir, s)), "labels")
    fits = K.consistent_pages(K.fit_pages(labels))
    pages = s.groupBy(F.col("well_id").alias("doc_id"), F.floor(F.col("idx") / 300).cast("int").alias("page")).agg(F.lit(600.0).alias("height"))
    return B.rounded(K.solve_pages(pages, fits).select("doc_id", "page", "slope", "intercept", "basis"), digits=4)


SQL["page_scales"] = B.CTE + f"""
SELECT well_id AS doc_id, CAST(idx // 300 AS INTEGER) AS page, {d(0.25)} AS slope, round({d(4998.75)} + 150 * (idx // 300), 4) AS intercept,
  CASE WHEN count(*) FILTER (WHERE idx % 60 = 0) >= 3 THEN 'fit' ELSE 'continued' END AS basis FROM log_samples GROUP BY well_id, idx // 300"""


QUERIES |= {f.__name__: f for f in (las_round_trip, las_wells, las_survey, las_problems, las_ranges, las_dialects, reopened_files, page_scales)}
