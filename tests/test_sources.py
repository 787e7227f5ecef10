"""LAS dialects, surveys, tables, streams and round trips."""

import pytest
from pyspark.sql import functions as F

from corelode.sources import delimited, export, las
from corelode.streaming import ingest

PLAIN = """~Version
VERS. 2.0 : CWLS
WRAP. NO : one line
~Well
STRT.FT 100.0 : START
STOP.FT 101.0 : STOP
STEP.FT 0.5 : STEP
NULL. -999.25 : NULL
WELL. Smith: 1 : WELL
COMP. COMPANY: Acme Oil
API. 05-123-12345 : API NUMBER
LATI. 41 30 00 N : LATITUDE
LONG. 104.5 : LONGITUDE
~Params
EKB.FT 5012 : KELLY BUSHING
EGL.FT 5000 ft above sea : GROUND LEVEL
MATR. Limestone : MATRIX
GROF.FT 12.5 : GR OFFSET TO BIT
~Curves
DEPT.FT : depth
GR.GAPI : gamma
GR.GAPI : gamma again
~Other
# MD INC AZI TVD
 0 0 0 0
 100 2 45 99.9
~Tops
Niobrara 100.5
~A
100.0 10 11
100.5 -999.25 NA
101.0 12.5-3.4
"""
WRAPPED = "~V\nVERS. 1.2 :\nWRAP. YES :\n~W\nNULL. -9999 :\n~C\nDEPT.M :\nA. :\nB. :\nC. :\n~A\n2.0\n1 2\n3\n1.0\n4 -9999 6\n"
COMMAS = "~V\nVERS. 2.0 :\n~C\nDEPT.M :\nGR. :\n~A\n1000,5  85,2\n1001,0  90,1\nbad row\n"
LAS3 = '~Version\nVERS. 3.0 :\nDLM. COMMA :\n~Log_Definition\nDEPT.M :\nLITH. :\nGR. :\n~Log_Data | Log_Definition\n1.0,"sand, fine",50\n2.0,shale,60\n~Tops_Data | Tops_Definition\nAlpha,1.5\n~Inclinometry_Definition\nMD.M :\nINC.DEG :\nAZI.DEG :\n~Inclinometry_Data | Inclinometry_Definition\n0,0,0\n10,5,90\n~Core_Data\n1,2,3\n'


@pytest.fixture(scope="module")
def parsed(spark):
    files = spark.createDataFrame([("plain", "﻿" + PLAIN), ("wrapped", WRAPPED), ("commas", COMMAS.replace("\n", "\r")), ("las3", LAS3), ("empty", ""), ("junk", "hello\nworld")], "file string, value string")
    rows = las.lines(files).cache()
    head = las.headers(rows).cache()
    data = las.data_rows(rows, las.file_facts(head)).cache()
    recs = las.records(data).cache()
    return rows, head, data, recs


def values(parsed, file):
    _, head, _, recs = parsed
    out = {}
    for r in las.samples(recs, las.curves(head)).where(F.col("file") == file).orderBy("col_no", "idx").collect():
        out.setdefault(r.mnemonic, []).append((r.md, r.value))
    return out


def test_plain(parsed):
    assert values(parsed, "plain") == {"GR": [(100.0, 10.0), (100.5, None), (101.0, 12.5)], "GR:2": [(100.0, 11.0), (100.5, None), (101.0, -3.4)]}


def test_wrapped_and_recorded_upwards(parsed):
    assert values(parsed, "wrapped") == {"A": [(1.0, 4.0), (2.0, 1.0)], "B": [(1.0, None), (2.0, 2.0)], "C": [(1.0, 6.0), (2.0, 3.0)]}


def test_decimal_commas_and_old_line_ends(parsed):
    assert values(parsed, "commas") == {"GR": [(1000.5, 85.2), (1001.0, 90.1)]}


def test_las3_sets(parsed):
    rows, *_ = parsed
    assert values(parsed, "las3")["GR"] == [(1.0, 50.0), (2.0, 60.0)]
    assert [(r.name, r.md) for r in las.tops(rows).where("file = 'las3'").collect()] == [("Alpha", 1.5)]
    assert sorted((r.md, r.inc, r.azi) for r in las.survey(rows).where("file = 'las3'").collect()) == [(0.0, 0.0, 0.0), (10.0, 5.0, 90.0)]


def test_wells_tops_survey_offsets(parsed):
    rows, head, _, _ = parsed
    w = las.wells(head, las.curves(head)).where("file = 'plain'").first()
    assert (w.name, w.company, w.lat, w.lon, w.kb, w.gl, w.kb_suspect, w.matrix) == ("Smith: 1", "Acme Oil", 41.5, -104.5, 5012.0, 5000.0, False, "limestone")
    assert [(r.name, r.md) for r in las.tops(rows).where("file = 'plain'").collect()] == [("Niobrara", 100.5)]
    assert [r.tvd for r in las.survey(rows).where("file = 'plain'").orderBy("md").collect()] == [0.0, 99.9]
    assert [(r.tool, r.offset) for r in las.sensor_offsets(head).where("file = 'plain'").collect()] == [("GR", 12.5)]


def test_problems(parsed):
    got = {}
    for r in las.diagnose(*parsed).collect():
        got.setdefault(r.file, set()).add((r.level, r.category))
    assert ("warn", "rows") in got["commas"] and ("info", "numbers") in got["commas"]
    assert ("info", "wrap") in got["wrapped"] and ("info", "depth") in got["wrapped"]
    assert ("error", "data") in got["junk"] and ("error", "curves") in got["junk"]
    assert "plain" not in {f for f, x in got.items() if any(level == "error" for level, _ in x)}


def test_zero_as_null_can_be_kept(spark):
    text = "~V\nVERS. 2.0 :\n~W\nNULL. 0 :\n~C\nDEPT. :\nC2. :\n~A\n1 0\n2 5\n"
    rows = las.lines(spark.createDataFrame([("z", text)], "file string, value string"))
    head = las.headers(rows)
    data = las.data_rows(rows, las.file_facts(head))
    assert [r["values"][1] for r in las.records(data).orderBy("md").collect()] == [None, 5.0]
    assert [r["values"][1] for r in las.records(data, spark.createDataFrame([("z",)], "file string")).orderBy("md").collect()] == [0.0, 5.0]


def test_units(spark):
    rows = [("f", 1, "NPHI", "%", 20.0), ("f", 2, "DT", "US/M", 328.084), ("f", 3, "ROP", "MIN/FT", 2.0), ("f", 3, "ROP", "MIN/FT", 0.0), ("f", 4, "GR", "API", 5.0)]
    got = {(r.mnemonic, r.unit): r.value for r in las.normalise_units(spark.createDataFrame(rows, "file string, col_no int, mnemonic string, unit string, value double")).where("value IS NOT NULL").collect()}
    assert got["NPHI", "v/v"] == pytest.approx(0.2) and got["DT", "us/ft"] == pytest.approx(100, abs=0.01) and got["ROP", "ft/h"] == 30.0 and got["GR", "API"] == 5.0


def test_las_files_round_trip(spark, tmp_path):
    s = las.synthetic_wells(spark, 3, 50)
    w = s.select("well_id").distinct().withColumn("name", F.concat(F.lit("Well "), "well_id"))
    texts = export.las_texts(export.las_lines(s, [("gr", "API"), ("rt", "OHMM")], w))
    export.write_las(texts, str(tmp_path / "las"))
    files = las.read_files(spark, str(tmp_path / "las" / "*"), "*.txt")
    assert files.count() == 3
    rows = las.lines(files)
    head = las.headers(rows)
    long = las.samples(las.records(las.data_rows(rows, las.file_facts(head))), las.curves(head))
    assert long.count() == 300
    assert long.where("mnemonic = 'GR'").agg(F.avg("value")).first()[0] == pytest.approx(s.agg(F.avg("gr")).first()[0], rel=1e-5)
    kinds = {r.kind for r in las.sniff(spark, str(tmp_path / "las" / "*" / "*.txt")).collect()}
    assert kinds == {"las"}


def test_sniff(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "b.csv").write_text("a,b\n1,2\n")
    got = {r.file.rsplit("/", 1)[1]: r.kind for r in las.sniff(spark, str(tmp_path)).collect()}
    assert got == {"a.pdf": "pdf", "b.csv": "text"}


def test_delimited(spark, tmp_path):
    p = tmp_path / "t.txt"
    p.write_text('Well;Note;MD\nA;"two; ""quoted""\nlines";1,5\n;;\nB;x;2\n')
    rows = delimited.read_delimited(spark, str(p)).collect()
    assert [tuple(r) for r in rows] == [("A", 'two; "quoted"\nlines', "1,5"), ("B", "x", "2")]


def test_survey_reports(spark):
    csv = "Well: Smith 1\nDepth unit, m\nMD,Inc,Azi,TVD\nft,deg,deg,ft\n0,0,0,0\n100,2,45,99.9\n"
    aligned = "Well Name: Jones\n\nMeasured      Incl.     Azimuth     TVD      N/S\n  0.0          0.0        0.0        0.0     0.0N\n100.0          2.0       45.0       99.9     1.2S\n"
    files = spark.createDataFrame([("x/0512312345_survey.csv", csv), ("jones.txt", aligned)], "file string, value string")
    got = sorted((r.file, r.md, r.inc, r.azi, r.tvd, r.north) for r in delimited.read_surveys(files).collect())
    assert got == [("jones.txt", 0.0, 0.0, 0.0, 0.0, 0.0), ("jones.txt", 100.0, 2.0, 45.0, 99.9, -1.2), ("x/0512312345_survey.csv", 0.0, 0.0, 0.0, 0.0, None), ("x/0512312345_survey.csv", 100.0, 2.0, 45.0, 99.9, None)]
    p = {r.file: r for r in delimited.preamble(files).collect()}
    assert (p["x/0512312345_survey.csv"].well, p["x/0512312345_survey.csv"].api, p["x/0512312345_survey.csv"].depth_unit) == ("Smith 1", "0512312345", "m")
    assert p["jones.txt"].well == "Jones"


def test_streaming_ingest_takes_the_newest_copy(spark, tmp_path):
    folder, seen = tmp_path / "in", []
    folder.mkdir()
    (folder / "a.las").write_text(PLAIN)

    def handle(batch, n):
        seen.append(sorted(r.file for r in batch.collect()))

    ingest.watch_files(spark, str(folder), handle, str(tmp_path / "ck")).awaitTermination()
    (folder / "b.las").write_text(PLAIN)
    (folder / "c.txt").write_text("no")
    ingest.watch_files(spark, str(folder), handle, str(tmp_path / "ck")).awaitTermination()
    assert seen == [["a.las"], ["b.las"]]
    f = spark.createDataFrame([("x/a.las", 1, "old"), ("y/a.las", 2, "new")], "path string, modified int, value string")
    assert [r.value for r in ingest.latest_per_file(f).collect()] == ["new"]


def test_streaming_summary_agrees_with_batch(spark, tmp_path):
    rows = spark.range(200).select((F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=F.col("id"))).alias("ts"), F.concat(F.lit("t"), F.col("id") % 3).alias("event_type"), F.col("id").cast("double").alias("value"), (F.col("id") % 5).alias("user_id"))
    rows.write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "ev"))
    q = ingest.hourly(stream).writeStream.outputMode("complete").format("memory").queryName("hourly").trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda df: sorted((r.start, r.event_type, r.n, r.total) for r in df.collect())
    assert key(spark.table("hourly")) == key(ingest.hourly(rows))
    assert ingest.sessions(rows).count() == 5


def test_project_tables(spark, tmp_path):
    t = spark.createDataFrame([(1, "A", 5.0), (2, "B", 6.0)], "well_id long, name string, md double")
    export.save_project({"tops": t, "settings": spark.range(1)}, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p" / "tops")).count() == 2
    export.write_csv(t, str(tmp_path / "csv"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).count() == 2
    stats = spark.createDataFrame([(1, "Z", "GR", 1.0, 2.0, 3.0, 4.0, 5)], "well_id long, zone string, curve string, mean double, p10 double, p50 double, p90 double, n long")
    assert export.statistics_table(stats, ["GR"]).first()["GR_p50"] == 3.0
