"""Order, close points, surfaces and contours over many partitions, against plain versions; and logs read in ranges of bytes against whole files."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corelode import plans
from corelode.operators import curves, interpret, order, proximity, spread, surface, zones
from corelode.sources import las
from corelode.sources.store import written

from .test_sources import COMMAS, LAS3, PLAIN, WRAPPED


def no_single_partition(df):
    return "SinglePartition" not in df._jdf.queryExecution().executedPlan().toString()


# --- order


def test_ranks_and_neighbours(spark):
    r = random.Random(1)
    values = [(k, r.choice([None, *range(40)])) for k in range(500)]
    df = spark.createDataFrame(values, "id long, v int").repartition(7)
    got = order.ranked(df, [F.col("v").asc_nulls_last(), "id"], "place")
    want = sorted(values, key=lambda x: (x[1] is None, x[1] or 0, x[0]))
    assert [(x.id, x.v) for x in got.orderBy("place").collect()] == want
    assert sorted(x.place for x in got.collect()) == list(range(500))
    nxt = order.with_next(got, "place", {"id": "after"}, stretch=16)
    assert no_single_partition(nxt)
    follows = {x.id: x.after for x in nxt.collect()}
    assert follows == {a[0]: b[0] if b else None for a, b in zip(want, [*want[1:], None], strict=True)}


def test_ranks_of_nothing(spark):
    none = order.ranked(spark.createDataFrame([], "id long"), ["id"])
    assert none.count() == 0 and order.with_next(none, "rank", {"id": "after"}).count() == 0
    assert order.running(spark.createDataFrame([], "v long, m long"), ["v"], "m")[1] == 0


def test_running_sums(spark):
    rows = [(k, (k * 7) % 5 or None) for k in range(300)]
    got, total = order.running(spark.createDataFrame(rows, "v long, m long").repartition(5), ["v"], "m")
    assert total == sum(m or 0 for _, m in rows)
    assert {x.v: x.upto for x in got.collect()} == {v: sum(m or 0 for _, m in rows[: v + 1]) for v, _ in rows}


def test_equal_count_breaks_of_a_table(spark):
    rows = [(float(k % 60),) for k in range(600)] + [(None,)]
    df = spark.createDataFrame(rows, "v double").repartition(6)
    got = zones.equal_count_breaks(df, "v")
    assert got.first().asDict() == {"min": 0.0, "b1": 10.0, "b2": 20.0, "b3": 30.0, "b4": 40.0, "b5": 50.0, "max": 59.0}


# --- close points


def plain_centres(points, radius):
    centres, out = [], {}
    for i, x, y in sorted(points):
        if x is None or y is None:
            out[i] = None
            continue
        near = [c for c in centres if math.hypot(c[1] - x, c[2] - y) < radius]
        if near:
            out[i] = near[0][0]
        else:
            centres.append((i, x, y))
            out[i] = i
    return out


def cloud(kind):
    r = random.Random(kind)
    if kind == "crowded":
        return [(k, r.uniform(0, 40), r.uniform(0, 40)) for k in range(300)]
    if kind == "spread":
        return [(k, r.uniform(-500, 500), r.uniform(-500, 500)) for k in range(300)]
    if kind == "one place":
        return [(k, 5.0, 5.0) for k in range(200)] + [(900, None, 1.0), (901, 20.0, 5.0), (902, 19.9, 5.0)]
    if kind == "chain":
        return [(k, 10.0 * k, 0.0) for k in range(14)]
    return [(k, 7.5 * r.randrange(8), 7.5 * r.randrange(8)) for k in range(150)]  # distances of just the radius


@pytest.mark.parametrize("kind", ["crowded", "spread", "one place", "chain", "lattice"])
def test_close_groups(spark, kind):
    points = cloud(kind)
    df = spark.createDataFrame(points, "point_id long, x double, y double").withColumn("_cx", F.lit("clash")).repartition(3)
    assert {r.point_id: r.centre for r in proximity.close_groups(df, 15.0).collect()} == plain_centres(points, 15.0)


def test_merged_points_keep_the_first_place_and_the_mean(spark):
    rows = [(s, k, x, y, v) for s in (1, 2) for k, x, y, v in ((0, 0.0, 0.0, 1.0), (1, 10.0, 0.0, 3.0), (2, 20.0, 0.0, 5.0), (3, 0.0, 1.0, None))]
    got = proximity.merge_close(spark.createDataFrame(rows, "surface_id long, point_id long, x double, y double, v double"), 15.0).collect()
    assert sorted(map(tuple, got)) == [(s, *p) for s in (1, 2) for p in ((0, 0.0, 0.0, 2.0, 2), (2, 20.0, 0.0, 5.0, 1))]
    assert proximity.merge_close(spark.createDataFrame([], "surface_id long, point_id long, x double, y double, v double"), 15.0).count() == 0


# --- surfaces


def test_hulls_in_shares(spark):
    g = np.random.default_rng(2)
    xy = np.round(g.standard_normal((400, 2)) * 100, 0)
    df = spark.createDataFrame([(s, float(x), float(y)) for s in (1, 2) for x, y in xy], "surface_id long, x double, y double")
    want = surface.convex_hull(xy[:, 0], xy[:, 1])
    for r in surface.hulls(df, share=50).collect():
        assert np.allclose(np.column_stack([r.hx, r.hy]), want)


def test_evaluation_in_blocks_is_that_of_the_whole(spark):
    g = np.random.default_rng(5)
    rows = [(1, k, float(x), float(y), float(np.sin(x / 900) + y / 1000)) for k, (x, y) in enumerate(g.uniform(0, 5000, (60, 2)))]
    fits = surface.fit_surfaces(spark.createDataFrame(rows, "surface_id long, point_id long, x double, y double, v double"), cells=20).cache()
    whole, parts = ({(r.i, r.j): r.z for r in surface.evaluate(fits, *how).collect()} for how in ((1000, 1000), (3, 7)))
    assert whole.keys() == parts.keys() and all((a is None) == (parts[k] is None) and (a is None or abs(a - parts[k]) < 1e-6) for k, a in whole.items())
    f = fits.first()
    z = {(r.point_id): r.v for r in spark.createDataFrame(rows, "surface_id long, point_id long, x double, y double, v double").collect()}
    assert f.reason is None and len(f.w) == len(z)


def grid(spark, f, n=20, sid=1):
    cells = [(sid, i, j, float(i), float(j), f(i, j)) for i in range(n) for j in range(n)]
    return spark.createDataFrame(cells, "surface_id long, i int, j int, x double, y double, z double").repartition(4)


def lines_of(spark, cells, step):
    steps = spark.createDataFrame([(1, float(step))], "surface_id long, step double")
    out = {}
    for r in surface.contour_paths(surface.contour_segments(cells, steps)).orderBy("level", "line", "seq").collect():
        out.setdefault((r.level, r.line), []).append((r.seq, r.x, r.y, r.closed))
    return out


def test_rings_are_closed_and_follow_their_level(spark):
    got = lines_of(spark, grid(spark, lambda i, j: math.hypot(i - 9.3, j - 9.6)), 2.0)
    rings = {k: v for k, v in got.items() if k[0] < 9}
    assert sorted(rings) == [(2.0, 0), (4.0, 0), (6.0, 0), (8.0, 0)]
    for (level, _), points in rings.items():
        assert [p[0] for p in points] == list(range(len(points))) and all(p[3] for p in points)
        assert points[0][1:3] == points[-1][1:3]
        assert all(abs(math.hypot(x - 9.3, y - 9.6) - level) < 0.2 for _, x, y, _ in points)
        assert all(math.dist(a[1:3], b[1:3]) < 1.5 for a, b in zip(points, points[1:], strict=False))


def test_open_lines_and_holes(spark):
    plane = lines_of(spark, grid(spark, lambda i, j: float(i)), 2.5)
    assert {k[0] for k in plane} == {2.5 * k for k in range(1, 8)}
    for (level, _), points in plane.items():
        assert {x for _, x, _, _ in points} == {level} and not points[0][3]
        ys = [y for _, _, y, _ in points]
        assert (ys == sorted(ys) or ys == sorted(ys, reverse=True)) and {0.0, 19.0} == {min(ys), max(ys)}
    holed = lines_of(spark, grid(spark, lambda i, j: None if j == 10 else float(i)), 5.0)
    assert len(holed) == 6  # each level in two parts
    assert lines_of(spark, grid(spark, lambda i, j: 1.0), 5.0) == {}


def walked(segments):
    """contour_paths() of collected segments, by walking them one by one."""
    levels = {}
    for r in segments:
        levels.setdefault(r.level, {})[tuple(r.a)] = r
    out = {}
    for level, at in levels.items():
        reached, firsts = {tuple(r.b) for r in at.values()}, []
        left = dict(at)
        for closed, begins in ((False, [a for a in at if a not in reached]), (True, sorted(at))):
            for a in begins:
                points, edge = [], a
                while edge in left:
                    r = left.pop(edge)
                    points.append((r.x1, r.y1))
                    edge = tuple(r.b)
                if points:
                    firsts.append((a, closed, [*points, (r.x2, r.y2)]))
        for line, (_, closed, points) in enumerate(sorted(firsts)):
            out[(level, line)] = [(k, x, y, closed) for k, (x, y) in enumerate(points)]
    return out


@pytest.mark.parametrize("tile", [256, 5, 2])
def test_lines_do_not_depend_on_tiles(spark, monkeypatch, tile):
    """Rings and open lines, also about a hole, that lie in one tile or pass through many, in batches of a few rows; where none leaves its tile, there is nothing to link between tables."""
    tables = []
    monkeypatch.setattr(surface, "TILE", tile)
    monkeypatch.setattr(surface, "written", lambda df, what: tables.append(what) or written(df, what))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        cells = grid(spark, lambda i, j: None if (i, j) == (7, 12) else 3 * math.sin(i / 2.3) + 2 * math.cos(j / 1.9) + 0.01 * i * j)
        want = walked(surface.contour_segments(cells, spark.createDataFrame([(1, 1.0)], "surface_id long, step double")).collect())
        assert sum(p[0][3] for p in want.values()) > 3 and sum(not p[0][3] for p in want.values()) > 3
        assert lines_of(spark, cells, 1.0) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert tables == ["chains"] or tile < 20


# --- logs in ranges


def long_log(n, wrapped=False, reverse=False):
    r = random.Random(n)
    depth = [1000 + 0.5 * k for k in range(n)]
    rows = [(d, r.random(), -9999 if k % 7 == 0 else k, r.random()) for k, d in enumerate(reversed(depth) if reverse else depth)]
    head = WRAPPED[: WRAPPED.index("~A")] if wrapped else WRAPPED[: WRAPPED.index("~A")].replace("YES", "NO")
    body = [f"{d}\n{a:.6f} {b}\n{c:.6f}" if wrapped else f"{d} {a:.6f} {b} {c:.6f}" for d, a, b, c in rows]
    return head + "# a comment\n~A\n" + "\n".join(body) + "\n"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("logs")
    third = LAS3[: LAS3.index("1.0,")] + "".join(f'{k / 2},"sand, {k}",{k * 3}\n' for k in range(400)) + LAS3[LAS3.index("~Tops_Data") :]
    texts = {"plain": "﻿" + PLAIN, "wrapped": WRAPPED, "commas": COMMAS.replace("\n", "\r"), "las3": LAS3, "third": third, "long": long_log(700), "long_wrapped": long_log(700, True), "up": long_log(500, reverse=True), "crlf": long_log(300).replace("\n", "\r\n"), "junk": "hello\nworld", "bad": long_log(50) + "not a row\n1 2\n"}
    for name, text in texts.items():
        (at / f"{name}.las").write_bytes(text.encode())
    return str(at)


def parsed(rows, known=None):
    head = las.headers(rows)
    data = las.data_rows(rows, las.file_facts(head), known)
    return head, data, las.records(data)


def told(df, *columns):
    name = F.regexp_extract("file", "([^/]*)$", 1).alias("file")
    return sorted(map(str, df.select(name, *columns).collect()))


def test_ranges_give_what_whole_files_give(spark, folder, monkeypatch):
    monkeypatch.setattr(las, "STRETCH", 64)
    whole = las.lines(las.read_files(spark, folder, "*.las"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    opened = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1500b")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        raw = las.read_ranges(spark, folder, "*.las")
        known = las.ranges(raw).cache()
        rows = las.range_lines(raw, known).cache()
        assert known.groupBy("file").count().agg(F.max("count")).first()[0] > 5
        assert told(rows, "line", "text", "section") == told(whole, "line", "text", "section")
        a, b = parsed(rows, known), parsed(whole)
        assert told(a[1], "line", "tokens", "bad", "comma") == told(b[1], "line", "tokens", "bad", "comma")
        assert told(a[2], "row_no", "md", "values") == told(b[2], "row_no", "md", "values")
        long = [las.samples(x[2], las.curves(x[0])) for x in (a, b)]
        assert told(long[0], "col_no", "mnemonic", "idx", "md", "value") == told(long[1], "col_no", "mnemonic", "idx", "md", "value")
        assert told(las.diagnose(rows, *a), "level", "category", "detail") == told(las.diagnose(whole, *b), "level", "category", "detail")
        for f in (las.tops, las.survey):
            assert told(f(rows), "md") == told(f(whole), "md")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.set("spark.sql.files.openCostInBytes", opened)


def test_logs_one_after_another_give_what_each_gives(spark, tmp_path):
    """Logs longer and shorter than a range, after lines of no log."""
    texts = [long_log(300), long_log(3), long_log(200, True), long_log(4, True), long_log(5), long_log(250, reverse=True), LAS3, "﻿" + long_log(6)]
    (tmp_path / "a.txt").write_text("\n".join(texts[:4]) + "\n")
    (tmp_path / "b.txt").write_text("# logs of a year\n\n" + "\n".join(t.removeprefix("\ufeff") for t in texts[4:]))
    whole = las.lines(spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "file string, value string"))
    before, opened = (spark.conf.get(f"spark.sql.files.{c}") for c in ("maxPartitionBytes", "openCostInBytes"))
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1500b")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        raw = las.read_ranges(spark, str(tmp_path), "*.txt", logs=True)
        known = las.ranges(raw).cache()
        rows = las.range_lines(raw, known).cache()
        assert known.agg(F.max("parts")).first()[0] > 3 and known.groupBy("text_file", "range").count().agg(F.max("count")).first()[0] > 2
        a, b = parsed(rows.where("text != '# logs of a year'"), known), parsed(whole)
        assert a[0].select("file").distinct().count() == len(texts)
        same = lambda x, y, *columns: sorted(map(str, x.select(*columns).collect())) == sorted(map(str, y.select(*columns).collect()))
        assert same(rows.where("text != '# logs of a year'"), whole, "line", "text", "section")
        assert same(a[1], b[1], "line", "tokens", "bad", "comma") and same(a[2], b[2], "row_no", "md", "values")
        assert same(las.samples(a[2], las.curves(a[0])), las.samples(b[2], las.curves(b[0])), "col_no", "mnemonic", "idx", "md", "value")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.set("spark.sql.files.openCostInBytes", opened)


def test_logs_of_many_wells_are_few_files(spark):
    """A file for each well takes longer to make than its well to read."""
    from corelode.plans import base, sources

    sf = "/root/testdata/sf0.001"
    at = sources._dialect_folder(spark, sf)
    assert len(spark.read.text(at).inputFiles()) <= base.log_samples(spark, sf).rdd.getNumPartitions()


@pytest.mark.parametrize("line", ["1,2,3", " 1.5 , -2e-3,.25 ", "1,,3", "1,1.2.3,4", "1,1e999,3", "1,2-3,4", '"1",2,3', "a,1,2", "1,NA,x", "1,1234567890123456789012345,2"])
def test_listed_numbers_are_read_like_any_others(spark, monkeypatch, line):
    rows = las.lines(spark.createDataFrame([("f", LAS3[: LAS3.index("1.0,")] + line + "\n")], "file string, value string"))
    facts = las.file_facts(las.headers(rows))
    got = las.data_rows(rows, facts).select("tokens", "bad").collect()
    monkeypatch.setattr(las, "LISTED", "^(?!)")
    assert got == las.data_rows(rows, facts).select("tokens", "bad").collect() and len(got) == 1


def test_order_of_a_log_recorded_upwards(spark, folder, monkeypatch):
    monkeypatch.setattr(las, "STRETCH", 64)
    head, _, recs = parsed(las.lines(las.read_files(spark, folder, "up.las")))
    got = [r.md for r in las.samples(recs, las.curves(head)).where("col_no = 1").orderBy("idx").collect()]
    assert got == [1000 + 0.5 * k for k in range(500)]


# --- ingest that replaces


def test_batches_replace_move_and_repeat(spark, tmp_path):
    from corelode.streaming import replace

    def batch(*rows):
        return spark.createDataFrame([(f"/in/{day}/{file}", day, value) for file, day, value in rows], "path string, modified string, value string").withColumn("modified", F.col("modified").cast("timestamp"))

    wells_of = lambda files: files.select("file", F.substring_index("value", ":", 1).alias("well_id"))
    build = lambda files: files.groupBy("well_id").agg(F.sum(F.substring_index("value", ":", -1).cast("int")).alias("total"), F.count("*").alias("files"))
    handle = replace.replaced(replace.Files(spark, f"{tmp_path}/kept", buckets=4), f"{tmp_path}/wells", wells_of, build)
    now = lambda: {r.well_id: (r.total, r.files) for r in replace.table(spark, f"{tmp_path}/wells").collect()}
    first = batch(("a", "2024-01-02", "w1:1"), ("b", "2024-01-02", "w1:10"), ("c", "2024-01-02", "w2:5"), ("d", "2024-01-02", "w3:7"))
    handle(first, 0)
    assert now() == {"w1": (11, 2), "w2": (5, 1), "w3": (7, 1)}
    # b is opened again and belongs to w2 now, c came earlier than what is there, d moves away from w3, two copies of a come at once
    second = batch(("b", "2024-02-01", "w2:20"), ("c", "2023-01-01", "w2:500"), ("d", "2024-02-01", "w4:8"), ("a", "2024-02-01", "w1:2"), ("a", "2024-02-03", "w1:3"))
    for _ in range(2):
        handle(second, 1)
        assert now() == {"w1": (3, 1), "w2": (25, 2), "w4": (8, 1)}
    handle(first, 0)  # an old batch once more knows nothing of later ones, which come again after it
    handle(second, 1)
    assert now() == {"w1": (3, 1), "w2": (25, 2), "w4": (8, 1)}
    handle(batch(("e", "2024-03-01", "w3:1")).where("false"), 2)
    assert now() == {"w1": (3, 1), "w2": (25, 2), "w4": (8, 1)}


def test_batches_make_only_their_wells(spark, tmp_path):
    """All wells share one bucket; a batch hands the files of its own wells on, whichever batch they came in, and the others stay as they are."""
    from corelode.streaming import replace

    seen = []

    def build(files):
        seen.append(sorted((r.well_id, r.value) for r in files.collect()))
        return files.groupBy("well_id").agg(F.sum(F.substring_index("value", ":", -1).cast("int")).alias("total"))

    batch = lambda day, *rows: spark.createDataFrame([(f"/in/{day}/{f}", day, v) for f, v in rows], "path string, modified string, value string").withColumn("modified", F.col("modified").cast("timestamp"))
    wells_of = lambda files: files.select("file", F.substring_index("value", ":", 1).alias("well_id"))
    handle = replace.replaced(replace.Files(spark, f"{tmp_path}/kept", buckets=1), f"{tmp_path}/wells", wells_of, build)
    now = lambda: {r.well_id: r.total for r in replace.table(spark, f"{tmp_path}/wells").collect()}
    first, second = batch("2024-01-01", ("a", "w1:1"), ("b", "w2:2"), ("c", "w3:3"), ("d", "w1:4")), batch("2024-02-01", ("a", "w1:10"), ("b", "w4:20"))
    for n, files in ((0, first), (1, second), (1, second), (0, first)):
        handle(files, n)
    again = [("w1", "w1:10"), ("w1", "w1:4"), ("w4", "w4:20")]
    assert seen[1:3] == [again, again] and len(seen[0]) == len(seen[3]) == 4
    assert now() == {"w1": 14, "w3": 3, "w4": 20}


def test_sensor_offsets_name_their_curves(spark):
    head = "~V\nVERS. 2.0 :\n~W\nNULL. -999.25 :\n~P\nGROF.FT 45 : GR OFFSET TO BIT\nRESO.FT 90 : BIT TO SENSOR RESISTIVITY\nDENS.FT 250 : DENSITY OFFSET\nBHT.DEGF 180 : TEMPERATURE\nDREF. BIT : DEPTH REFERENCE\n~C\nDEPT.{u} : depth\nGR.GAPI :\nRPD.OHMM :\nRPS.OHMM :\n~A\n1 2 3 4\n"
    files = spark.createDataFrame([("feet", head.format(u="FT")), ("metres", head.format(u="M")), ("sensor", head.format(u="FT").replace("DREF. BIT", "DREF. SENSOR, NOT BIT"))], "file string, value string")
    h = las.headers(las.lines(files))
    got = {(r.file, r.tool): (r.offset, r.curves, r.at_bit) for r in las.sensor_offsets(h, las.curves(h)).collect()}
    both = {("GR", 45.0): ["GR"], ("Resistivity", 90.0): ["RPD", "RPS"]}
    want = {(f, t): (v, c, f == "feet") for f in ("feet", "sensor") for (t, v), c in both.items()}
    assert got == want | {("metres", "GR"): (45.0, ["GR"], True)}


# --- sketches


def test_sketched_quantiles_are_near_and_merge(spark):
    from corelode.operators import sketch

    g = np.random.default_rng(4)
    rows = [(int(k % 3), float(v), float(h)) for k, (v, h) in enumerate(zip(np.concatenate([np.exp(g.standard_normal(900) * 3), -np.exp(g.standard_normal(300)), np.zeros(30)]), g.uniform(0.1, 2, 1230), strict=True))]
    df = spark.createDataFrame([*rows, (0, None, 1.0), (0, 5.0, 0.0), (0, 5.0, None), (0, float("nan"), 1.0)], "k int, v double, h double").repartition(5)
    at = (0.05, 0.25, 0.5, 0.75, 0.95)
    whole = sketch.sketch(df, "v", ["k"])
    names = [f"wp{int(100 * p)}" for p in at]
    clean = df.where("NOT isnan(v)")
    for near, exact in ((sketch.quantiles(whole, ["k"], at), zones.weighted_quantiles(clean, "v", ["k"], at)), (sketch.quantiles(sketch.merged(whole, []), [], at), zones.weighted_quantiles(clean, "v", [], at))):
        a, b = ({r.asDict().get("k"): [r[n] for n in names] for r in x.collect()} for x in (near, exact))
        assert a.keys() == b.keys()
        for k in a:
            assert all(abs(x - y) <= 0.005 * (1 + 1e-9) * abs(y) for x, y in zip(a[k], b[k], strict=True)), (k, a[k], b[k])
    assert sketch.merged(whole, []).count() < 2200
    assert sketch.quantiles(sketch.sketch(df.where("false"), "v", ["k"]), ["k"]).count() == 0


def test_contours_join_no_side_through_the_driver(spark):
    """Written edges take a few bits each, so their size says nothing of how large they are in memory."""
    cells = spark.range(144).select(F.lit(1).alias("surface_id"), (F.col("id") % 12).cast("int").alias("i"), F.floor(F.col("id") / 12).cast("int").alias("j"))
    cells = cells.withColumns({"x": F.col("i") * 10.0, "y": F.col("j") * 10.0}).withColumn("z", F.hypot(F.col("x") - 57.0, F.col("y") - 53.0))
    lines = surface.contour_paths(surface.contour_segments(cells, spark.createDataFrame([(1, 20.0)], "surface_id int, step double")))
    assert lines.select("level", "line").distinct().count() > 1
    assert "BroadcastHashJoin" not in lines._jdf.queryExecution().toString()


def test_close_groups_deal_points_to_few_blocks(spark):
    g = np.random.default_rng(4)
    df = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(g.uniform(-2000, 2000, (500, 2)))], "point_id long, x double, y double")
    assert proximity._around(df, "x", "y", 15.0).count() < 2 * 500
    odd = spark.createDataFrame([(0, 1, 1.0, 1.0), (0, 2, float("nan"), 1.0), (0, 3, None, 1.0), (0, 4, 2.0, float("inf")), (None, 5, 1.0, 1.0), (0, 6, 2.0, 2.0)], "s long, point_id long, x double, y double")
    assert {r.point_id: r.centre for r in proximity.close_groups(odd, 15.0, ("s",)).collect()} == {1: 1, 2: None, 3: None, 4: None, 5: None, 6: 1}


@pytest.mark.parametrize("name", ["edited_curve", "nearest_point_pair", "sensor_shift", "flat_runs", "null_gaps"])
def test_partitions_follow_the_samples(spark, monkeypatch, name):
    query, at = plans.QUERIES[name], "/root/testdata/sf0.001"
    want = sorted(map(repr, query(spark, at).collect()))
    monkeypatch.setattr(spread, "ROWS", 500)
    got = query(spark, at)
    n = -(-spark.read.parquet(f"{at}/lineitem.parquet").count() // 500)
    assert got.rdd.getNumPartitions() == n > 4
    assert sorted(map(repr, got.collect())) == want


def test_edits_keep_wells_without_any(spark):
    rows = [(w, 0.5 * k, float(k)) for w in (1, 2) for k in range(4)]
    edits = spark.createDataFrame([(1, None, None, 2.0, None)], "well_id long, offset double, despike boolean, a double, b double")
    got = curves.apply_edits(spark.createDataFrame(rows, "well_id long, md double, v double"), "v", edits).collect()
    assert sorted((r.well_id, r.md, r.v_edited) for r in got) == [(w, md, v * (2 if w == 1 else 1)) for w, md, v in rows]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_page_scales_read_their_samples_once(spark):
    assert "lineitem" not in plan_of(plans.QUERIES["page_scales"](spark, "/root/testdata/sf0.001"))


def test_quantiles_by_well_need_no_exchange_by_value(spark):
    assert not re.search(r"hashpartitioning\(well_id#\d+L?, zone#\d+, rt#", plan_of(plans.QUERIES["sketched_quantiles"](spark, "/root/testdata/sf0.001")))


def test_interpretation_reads_samples_twice_at_most(spark):
    g = np.random.default_rng(6)
    rows = [(w, 0.5 * k, float(v)) for w in (1, 2) for k, v in enumerate(g.integers(20, 40, 300) * 5)]
    samples = written(spark.createDataFrame(rows, "well_id long, md double, gr double"), "samples")
    assert plan_of(interpret.interpret(samples)).count("FileScan") <= 4  # two of them of the wells' sources
    for r in interpret.gr_baselines(samples).collect():
        v = np.array([x for w, _, x in rows if w == r.well_id])
        hot = np.median(v) + 2.5 * np.median(np.abs(v - np.median(v)))
        cool = v[v <= hot]
        assert r.hot == hot and abs(r.hot_fraction - (1 - len(cool) / len(v))) < 1e-12
        assert (r.gr_clean, r.gr_shale) == tuple(np.floor(np.quantile(*a) + 0.5) for a in ((v, 0.02), (cool, 0.95)))
