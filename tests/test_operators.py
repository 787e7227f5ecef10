"""Operators against hand-made cases and invariants."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from corelode.operators import curves as C
from corelode.operators import depth as D
from corelode.operators import interpret as I
from corelode.operators import quality as Q
from corelode.operators import surface as M
from corelode.operators import tables as T
from corelode.operators import tokens as K
from corelode.operators import zones as Z


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def log(spark, values, step=0.5, top=1000.0, well=1):
    return frame(spark, [(well, k, top + step * k, v) for k, v in enumerate(values)], "well_id long, idx long, md double, v double")


def test_quarter_circle(spark):
    st = frame(spark, [(1, 10.0 * k, 0.9 * k, 90.0) for k in range(101)], "well_id long, md double, inc double, azi double")
    last = D.minimum_curvature(st).orderBy(F.desc("md")).first()
    assert last.tvd == pytest.approx(2000 / math.pi, abs=1e-6)
    assert last.east == pytest.approx(2000 / math.pi, abs=1e-6)
    assert last.dls == pytest.approx(9.0)


def test_along_survey_ends_and_inverse(spark):
    st = frame(spark, [(1, 100.0, 0.0, 0.0), (1, 200.0, 60.0, 90.0), (1, 300.0, 60.0, 90.0)], "well_id long, md double, inc double, azi double")
    s = D.minimum_curvature(st).cache()
    d = frame(spark, [(1, m) for m in (50.0, 150.0, 250.0, 400.0)] + [(2, 10.0)], "well_id long, md double")
    got = {(r.well_id, r.md): r for r in D.along_survey(d, s).collect()}
    assert got[1, 50.0].tvd == pytest.approx(50.0)
    end = s.where("md = 300").first()
    assert got[1, 400.0].tvd == pytest.approx(end.tvd + 50.0)
    assert got[1, 400.0].east == pytest.approx(end.east + 100 * math.sin(math.pi / 3))
    assert got[2, 10.0].tvd is None
    back = D.depth_from_tvd(frame(spark, [(k, r.tvd, r.md) for (k, _), r in got.items() if r.tvd is not None], "well_id long, tvd double, want double"), s).collect()
    assert all(r.md == pytest.approx(r.want, abs=1e-6) for r in back)


def test_survey_drops_repeated_depths_and_inverts(spark):
    st = frame(spark, [(1, 0.0, 0.0, 0.0), (1, 100.0, 10.0, 45.0), (1, 100.0, 12.0, 45.0), (1, 200.0, 20.0, 45.0)], "well_id long, md double, inc double, azi double")
    s = D.minimum_curvature(st)
    assert s.count() == 3
    inv = D.inclination_from_positions(s.drop("inc", "azi")).orderBy("md").collect()
    assert 4 < inv[1].inc < 6 and inv[1].azi == pytest.approx(45.0)
    assert D.survey_difference(s, s).first().max_difference == 0


def test_resample_is_identity_on_its_own_grid_and_respects_gaps(spark):
    s = log(spark, [1.0, 2.0, None, 4.0, 5.0])
    grid = s.select("well_id", "idx", "md")
    assert [r.v for r in D.resample(grid, s.select("well_id", "md", "v"), "v", 1.5).orderBy("idx").collect()] == [1.0, 2.0, None, 4.0, 5.0]
    fine = frame(spark, [(1, m) for m in (999.0, 1000.25, 1000.6, 1000.9, 1001.25, 1005.0)], "well_id long, md double")
    assert [r.v for r in D.resample(fine, s.select("well_id", "md", "v"), "v", 1.5).orderBy("md").collect()] == [None, 1.5, 2.0, None, 4.0, None]
    wide = frame(spark, [(1, 0.0, 1.0), (1, 10.0, 2.0)], "well_id long, md double, v double")
    assert D.resample(frame(spark, [(1, 5.0)], "well_id long, md double"), wide, "v", 1.5).first().v is None


def test_nearest_takes_the_deeper_of_two(spark):
    right = frame(spark, [(1, 10.0, "a"), (1, 11.0, "b")], "well_id long, md double, n string")
    got = D.nearest(frame(spark, [(1, 10.5), (1, 10.2), (1, 20.0)], "well_id long, md double"), right, ["n"], 1.0).orderBy("md").collect()
    assert [r.near_n for r in got] == ["a", "b", None]


def test_carry_is_linear_in_the_samples_of_a_well(spark):
    """40,000 samples of one well; a frame to the end of the well took minutes."""
    n = 40_000
    left = spark.range(n).select(F.lit(1).alias("well_id"), F.col("id").alias("k"), (F.col("id") * 0.5 + 0.1).alias("md")).cache()
    right = spark.range(n).select(F.lit(1).alias("well_id"), (F.col("id") * 0.5).alias("md"), F.col("id").alias("v")).cache()
    left.count(), right.count()
    began = time.time()
    got = D.carry(left, right, ["v"], ["well_id"]).agg(F.sum("prev_v"), F.sum("next_v"), F.count("next_v")).first()
    assert time.time() - began < 5
    assert tuple(got) == (n * (n - 1) // 2, n * (n - 1) // 2, n - 1)


def test_depths_from_tvd_and_frame_against_every_bracket(spark):
    r = random.Random(4)
    rows, want_t, want_f, targets = [], {}, {}, []
    for well in range(4):
        z, line = 0.0, []
        for k in range(60):
            z += r.uniform(-2.0, 4.0)
            line.append((well, 10.0 * k + 100, round(z, 3), r.uniform(0, 100)))
        rows += line
        for t in range(80):
            want = round(r.uniform(-5, line[-1][2] + 20), 2)
            targets.append((well, t, want))
            first = next((k for k, x in enumerate(line) if x[2] >= want), None)
            if first is None:
                want_t[well, t] = line[-1][1] + (want - line[-1][2]) / max(math.cos(math.radians(line[-1][3])), 0.05)
                want_f[well, t] = line[-1][1]
            elif first == 0:
                want_t[well, t], want_f[well, t] = line[0][1] - (line[0][2] - want), line[0][1]
            else:
                a, b = line[first - 1], line[first]
                want_t[well, t] = want_f[well, t] = a[1] + (want - a[2]) / (b[2] - a[2]) * 10.0
    survey = frame(spark, rows, "well_id long, md double, tvd double, inc double")
    asked = frame(spark, [*targets, (9, 0, 1.0)], "well_id long, k long, tvd double")
    got = {(x.well_id, x.k): x.md for x in D.depth_from_tvd(asked, survey).collect()}
    assert got.pop((9, 0)) is None
    assert got == pytest.approx(want_t)
    got = {(x.well_id, x.k): x.md for x in D.depth_from_frame(asked.withColumnRenamed("tvd", "z"), survey.select("well_id", "md", F.col("tvd").alias("z"))).collect()}
    assert got == pytest.approx(want_f)


def test_event_intervals(spark):
    e = frame(spark, [(1, 95.0, 305.0, "x"), (1, 400.0, None, "y")], "well_id long, top_md double, base_md double, class string")
    d = frame(spark, [(1, m) for m in (94.0, 100.0, 200.0, 305.0, 400.0)], "well_id long, md double")
    assert sorted((r.md, r["class"]) for r in D.event_at(d, e).collect()) == [(100.0, "x"), (200.0, "x"), (305.0, "x"), (400.0, "y")]


def test_frames_and_flattening(spark):
    tops = frame(spark, [(1, "A", 1001.0)], "well_id long, name string, md double")
    s = log(spark, [1.0] * 5).unionByName(log(spark, [1.0], well=2))
    got = {(r.well_id, r.md): (r.flat_z, r.note) for r in D.flattened(s, tops, "A").collect()}
    assert got[1, 1000.0] == (-1.0, None) and got[2, 1000.0][0] == 1000.0 and got[2, 1000.0][1]
    f = log(spark, [0.0, 5.0, 3.0, 8.0]).withColumnRenamed("v", "z")
    assert [r.md for r in D.depth_from_frame(frame(spark, [(1, 4.0), (1, 99.0), (1, -3.0)], "well_id long, z double"), f).orderBy("z").collect()] == [1000.0, 1000.4, 1001.5]


def test_zone_weights_cover_the_span_and_zones_are_half_open(spark):
    s = log(spark, [1.0] * 101).withColumn("h", Z.thickness())
    assert s.agg(F.sum("h")).first()[0] == pytest.approx(50.0 + 0.5)
    tops = frame(spark, [(1, "A", 1010.0), (1, "B", 1030.0), (1, "out", 2000.0), (1, "edge", 1000.0)], "well_id long, name string, md double")
    z = Z.build_zones(Z.extent(s), tops)
    assert [(r.zone, r.top, r.base) for r in z.orderBy("top").collect()] == [("Above A", 1000.0, 1010.0), ("A", 1010.0, 1030.0), ("B", 1030.0, 1050.0)]
    at = {r.md: r.zone for r in D.zone_at(s, z).collect()}
    assert (at[1009.5], at[1010.0], at[1050.0]) == ("Above A", "A", None)
    assert {r.md: r.zone for r in D.zone_at(s, z, keep_last=True).collect()}[1050.0] == "B"
    assert Z.build_zones(Z.extent(s), tops.where("false")).first().zone == "Whole well"


def test_summary_and_histogram(spark):
    rows = [(1, "z", v, h) for v, h in ((10.0, 1.0), (20.0, 3.0), (None, 1.0), (1000.0, 1.0), (-5.0, 0.5))]
    s = frame(spark, rows, "well_id long, zone string, v double, h double")
    r = Z.summarize(s.where("v < 100 OR v IS NULL"), "v", ["well_id", "zone"], log=True).first()
    assert (r.n, r.total) == (2, 4) and r["mean"] == pytest.approx(math.exp((math.log(10) + 3 * math.log(20)) / 4))
    h = {(r.all_zones, r.bin): r.frac for r in Z.histogram(s, "v", 0, 100, 10).collect()}
    assert h[False, 1] == pytest.approx(1 / 5.5) and h[True, 10] == pytest.approx(1 / 5.5) and h[False, -1] == pytest.approx(0.5 / 5.5)
    w = Z.weighted_quantiles(s.where("v BETWEEN 0 AND 100"), "v", ["well_id"]).first()
    assert (w.wp10, w.wp50, w.wp90) == (10.0, 20.0, 20.0)
    g = Z.equal_count_breaks(frame(spark, [(float(k),) for k in range(60)], "v double"), "v").first()
    assert (g.min, g.b1, g.b5, g.max) == (0.0, 10.0, 50.0, 59.0)


def test_despike(spark):
    v = [10.0 + 0.1 * (k % 3) for k in range(40)]
    v[20] = 50.0
    out = C.despike(log(spark, v), "v", ["well_id"]).orderBy("md").collect()
    assert [r.idx for r in out if r.is_spike] == [20]
    assert out[20].v_clean == pytest.approx(10.1, abs=0.06)
    flat = [5.0] * 20
    flat[10] = 9.0
    assert C.despike(log(spark, flat), "v", ["well_id"]).where("is_spike").count() == 0
    logs = [100.0 * 1.01 ** (k % 4) for k in range(30)]
    logs[15] = 1e6
    assert [r.idx for r in C.despike(log(spark, logs), "v", ["well_id"], log=True).where("is_spike").collect()] == [15]


def test_edits_start_from_the_original(spark):
    s = log(spark, [float(k) for k in range(20)])
    e = frame(spark, [(1, 1.0, False, 2.0, 1.0)], "well_id long, offset double, despike boolean, a double, b double")
    got = {r.idx: r.v_edited for r in C.apply_edits(s, "v", e).collect()}
    assert got[5] == pytest.approx((5 + 2) * 2 + 1) and got[19] is None
    none = {r.idx: r.v_edited for r in C.apply_edits(s, "v", e.where("false")).collect()}
    assert none == {k: float(k) for k in range(20)}


def test_percentile_normalisation(spark):
    r = random.Random(1)
    v = [r.random() for _ in range(200)]
    s = log(spark, v).unionByName(log(spark, [3 * x + 7 for x in v], well=2)).unionByName(log(spark, v[:5], well=3))
    got = {x.well_id: (x.a, x.b) for x in C.percentile_norm(s, "v", 1).collect()}
    assert got[1] == (1.0, 0.0) and got[2] == pytest.approx((1 / 3, -7 / 3), abs=1e-3) and 3 not in got


def test_resolve_family(spark):
    rows = [(1, 1, "CGR", "API", False, 100, 1), (1, 2, "GR:2", "API", True, 100, 2), (1, 3, "SGR", "API", False, 100, 3), (1, 4, "RPM", "", False, 90, 4), (2, 5, "GR", "API", False, 10, 1), (2, 6, "SGR", "API", False, 100, 2), (2, 7, "RPM", "ohm.m", False, 100, 3)]
    c = frame(spark, rows, "well_id long, curve_id long, mnemonic string, unit string, cased boolean, n long, col_no int")
    got = {(r.well_id, r.family): r.curve_id for r in C.resolve_family(c).collect()}
    assert got == {(1, "GR"): 3, (2, "GR"): 6, (2, "RM"): 7}
    pins = frame(spark, [(2, "GR", "GR")], "well_id long, family string, mnemonic string")
    assert {(r.well_id, r.family): r.curve_id for r in C.resolve_family(c, pins).collect()}[2, "GR"] == 5


def run(spark, file_no, name, rows, unit="API"):
    return frame(spark, [(1, file_no, name, unit, m, v) for m, v in rows], "well_id long, file_no int, mnemonic string, unit string, md double, value double")


def test_merge_runs(spark):
    a = run(spark, 0, "GR", [(100.0, 10.0), (100.5, 11.0), (101.0, 12.0)])
    b = run(spark, 1, "GR", [(101.0, 99.0), (101.5, 14.0), (102.0, 15.0)], "GAPI")
    got = C.merge_runs(a.unionByName(b), [0, 1]).orderBy("i").collect()
    assert [(r.mnemonic, r.value) for r in got] == [("GR", v) for v in (10.0, 11.0, 12.0, 14.0, 15.0)]
    once = got
    again = C.merge_runs(run(spark, 0, "GR", [(r.md, r.value) for r in once]), [0]).orderBy("i").collect()
    assert [r.value for r in again] == [r.value for r in once]
    long = [(100.0 + 0.5 * k, float(k)) for k in range(60)]
    both = C.merge_runs(run(spark, 0, "GR", long).unionByName(run(spark, 1, "GR", [(m, v + 1) for m, v in long])), [0, 1])
    assert {r.mnemonic: r.n for r in both.groupBy("mnemonic").agg(F.count("*").alias("n")).collect()} == {"GR": 60, "GR:2": 60}


def test_quality_report(spark):
    v = [None] * 5 + [50.0 + (k * 7) % 11 for k in range(60)] + [None] * 6 + [80.0] * 30 + [70.0]
    r = Q.curve_report(log(spark, v), "v", "GR", "GAPI").first()
    assert (r.gaps, r.flat, r.verdict) == (1, 30, "warn")
    assert Q.null_gaps(log(spark, v), "v").count() == 1
    assert Q.flat_runs(log(spark, v), "v").first().n == 30
    assert Q.curve_report(log(spark, [None] * 10), "v", "GR").first().verdict == "bad"
    assert Q.curve_report(log(spark, [5000.0 + k for k in range(50)]), "v", "GR", "API").first().verdict == "bad"
    d = Q.depth_problems(frame(spark, [(1, 0, 1.0), (1, 1, 2.0), (1, 2, 1.5), (1, 3, 1.5)], "well_id long, idx long, md double"), ["well_id"]).first()
    assert (d.reversals, d.repeats) == (1, 1)


def test_interpretation_falls_back_by_source(spark):
    n = 100
    base = [(1, k, 1000.0 + k, 20.0 + k, 2.4, 0.2, 10.0) for k in range(n)]
    s = frame(spark, base, "well_id long, idx long, md double, gr double, rhob double, nphi double, rt double")
    src = I.sources(s).first()
    assert (src.vsh_source, src.phi_source) == ("GR", "neutron-density")
    assert I.sources(s.drop("nphi")).first().phi_source == "density"
    assert I.sources(s.drop("rhob")).first().phi_source == "neutron"
    sand = I.interpret(s.drop("rhob", "nphi"))
    assert sand.agg(F.sum("net_res")).first()[0] > 0 and sand.where("phi IS NOT NULL").count() == 0
    shaly = I.interpret(s, p=I.Parameters(sw_method="simandoux"))
    assert shaly.where("sw IS NULL AND phie > 0").count() == 0
    warm = I.interpret(s, frame(spark, [(1, 200.0)], "well_id long, bht double")).agg(F.avg("sw")).first()[0]
    cold = I.interpret(s).agg(F.avg("sw")).first()[0]
    assert warm < cold


def test_tables_guess_and_records(spark):
    tops = frame(spark, [("A 1", "403712345", "Niobrara", "6,100"), ("A 1", "403712345", "Codell", "6400"), ("B-2", "", "Niobrara", "7000")], "`Well Name` string, `API 10` string, `Marker / Formation Top` string, `Top (ft MD)` string")
    g = T.guess(tops)
    assert g["kind"] == "tops" and g["sure"]
    assert sorted((r.api or "", r.top, r.md) for r in T.records(tops, "tops", g["map"]).collect()) == [("", "Niobrara", 7000.0), ("0403712345", "Codell", 6400.0), ("0403712345", "Niobrara", 6100.0)]
    head = frame(spark, [("A 1", "0403712345", "5000", "5012.5", "41.5", "22-Apr-2021")], "`Well Name` string, API string, `GL (ft)` string, `KB - final` string, Latitude string, `Spud Date` string")
    assert T.guess(head)["kind"] == "header"
    assert {r.field: r.value for r in T.records(head, "header", {}).collect()} == {"api": "0403712345", "gl": "5000.0", "kb": "5012.5", "lat": "41.5", "spud": "2021-04-22"}
    core = frame(spark, [("A", str(6000 + k), str(12.5 + k), "0.1") for k in range(6)], "well string, depth string, `porosity (%)` string, perm_md string")
    g = T.guess(core)
    assert g["kind"] == "points"
    pts = T.percent_to_fraction(T.records(core, "points", g["map"]))
    assert {r.series: r.m < 1 for r in pts.groupBy("series").agg(F.max("value").alias("m")).collect()} == {"POROSITY": True, "PERM_MD": True}
    sv = frame(spark, [("A", "0", "1", "10"), ("A", "100", "2", "20")], "well string, md string, incl string, azim string")
    assert T.guess(sv)["kind"] == "survey"


def test_matching(spark):
    w = frame(spark, [(1, "Carpenter 126-0408H", None, "0512312345"), (2, "Other", "Carp", "051231234501"), (3, "Third", None, None)], "well_id long, name string, alias string, api string")
    rows = [(1, "carpenter 126 0408h", None, None), (2, None, None, "05-123-12345"), (3, "x", "CARP", None), (4, None, None, "05-123-12345-01"), (5, "nobody", None, "99"), (6, "third", None, "0599999999")]
    got = {r.row_id: (r.well_id, r.matched_by) for r in T.match_wells(frame(spark, rows, "row_id long, name string, alias string, api string"), w).collect()}
    assert got == {1: (1, "name"), 2: (1, "api"), 3: (2, "name"), 4: (2, "api"), 5: (None, None), 6: (3, "name")}


def test_plan_and_targets(spark):
    v = frame(spark, [(1, "gl", "num", "5000", 1), (1, "gl", "num", "5000.02", 2), (1, "gl", "num", "5100", 3), (1, "field", "text", "Honor Rancho", 4), (2, "gl", "num", "10", 5), (2, "state", "text", "CO", 6), (3, "gl", "num", "1", 7), (3, "gl", "num", "2", 8)], "well_id long, field string, kind string, value string, row_id long")
    cur = frame(spark, [(1, "gl", "4000"), (2, "gl", "10.01"), (3, "gl", "2")], "well_id long, field string, current string")
    got = {(r.well_id, r.field): (r.status, r.choice) for r in T.import_plan(v, cur).collect()}
    assert got == {(1, "gl"): ("conflict", "5000"), (1, "field"): ("fill", "Honor Rancho"), (2, "gl"): ("same", "10.01"), (2, "state"): ("fill", "CO"), (3, "gl"): ("conflict", "2")}
    assert {(r.well_id, r.field): r.value for r in T.apply_plan(cur, T.import_plan(v, cur)).collect()}[1, "gl"] == "5000"
    f = frame(spark, [(1, "W1", "0512312345"), (2, "w-1", None), (3, "W1", None), (4, "W9", "051231234502"), (5, None, None)], "file_id long, name string, api string")
    t = {r.file_id: r.target for r in T.merge_targets(f).collect()}
    assert t[1] == t[2] == t[3] and t[4] == "0512312345-02" and t[5] == "file:5"


def test_surface_reproduces_a_plane_and_refuses(spark):
    r = np.random.default_rng(3)
    pts = [(1, k, float(x), float(y), float(100 + 0.01 * x - 0.02 * y)) for k, (x, y) in enumerate(r.uniform(0, 5000, (12, 2)))]
    pts += [(2, k, 100.0 * k, 200.0 * k, 1.0) for k in range(5)] + [(3, 0, 0.0, 0.0, 1.0), (3, 1, 5.0, 0.0, 1.0), (3, 2, 900.0, 5.0, 1.0)]
    fits = M.fit_surfaces(frame(spark, pts, "surface_id long, point_id long, x double, y double, v double"), cells=20).cache()
    assert {x.surface_id: x.reason for x in fits.collect()} == {1: None, 2: "control points lie on a line", 3: "fewer than three control points"}
    cells = M.evaluate(fits).where("z IS NOT NULL").cache()
    assert cells.select(F.max(F.abs(F.col("z") - (100 + 0.01 * F.col("x") - 0.02 * F.col("y"))))).first()[0] < 0.05
    lines = M.contour_lines(cells, M.contour_steps(cells)).collect()
    assert lines and all(abs(100 + 0.01 * x.x1 - 0.02 * x.y1 - x.level) < 0.1 for x in lines)


def test_page_calibration(spark):
    words = [(1, 0, w, x, y, 30.0, 10.0) for w, x, y in (("WELL", 10.0, 5.0), ("Smith", 60.0, 5.0), ("1", 95.0, 5.0), ("COMPANY:", 10.0, 40.0), ("Acme", 10.0, 55.0))]
    labels = [(1, p, f"{5000 + 50 * p + 10 * k:,}", 40.0, 100.0 * k, 30.0, 10.0) for p in (1, 2, 4) for k in range(5)] + [(1, 1, "777", 40.0, 130.0, 30.0, 10.0)]
    t = frame(spark, words + labels, "doc_id long, page int, text string, x double, y double, w double, h double")
    ph = K.phrases(t.where("page = 0"))
    assert "Smith 1" in {r.text for r in ph.collect()}
    assert {r.field: r.value for r in K.header_fields(ph).collect()} == {"well": "Smith 1", "company": "Acme"}
    fits = K.consistent_pages(K.fit_pages(K.depth_labels(t.where("page > 0"))))
    assert {r.page: round(r.slope, 6) for r in fits.collect()} == {1: 0.1, 2: 0.1, 4: 0.1}
    pages = frame(spark, [(1, p, 500.0) for p in range(1, 6)], "doc_id long, page int, height double")
    solved = {r.page: r for r in K.solve_pages(pages, fits).collect()}
    assert solved[3].basis == "continued" and solved[3].top_md == pytest.approx(solved[2].base_md) and solved[5].top_md == pytest.approx(solved[4].base_md)
    spans = {r.page: (r.from_md, r.to_md) for r in K.page_spans(K.solve_pages(pages, fits), 5060.0, 5120.0).collect()}
    assert spans[1][0] == pytest.approx(5060.0)


def test_places_from_api_numbers(spark):
    w = frame(spark, [(1, "05123123450000", None, "123"), (2, "05123123450000", "Colorado", "Weld"), (3, "UWI 9", None, None)], "well_id long, api string, state string, county string")
    places = frame(spark, [("05", "123", "CO", "Weld"), ("05", "001", "CO", "Adams")], "state_code string, county_code string, state string, county string")
    assert {r.well_id: (r.state, r.county) for r in T.fill_place(w, places).collect()} == {1: ("CO", "Weld"), 2: ("Colorado", "Weld"), 3: (None, None)}


def test_tvd_curve_stands_in_for_a_survey(spark):
    s = frame(spark, [(1, float(m), 0.5 * m if m > 100 else float(m)) for m in range(0, 400, 10)] + [(2, 5.0, 5.0), (2, 6.0, 6.0)], "well_id long, md double, tvd double")
    got = D.tvd_stations(s, most=10).orderBy("md").collect()
    assert {r.well_id for r in got} == {1} and len(got) <= 14 and got[-1].inc == pytest.approx(60.0)


def test_fields_of_headers():
    want = {
        "Well Name": "name", "UWI": "api", "API 14": "api", "Operator Name": "company", "Well Status": "status", "KB to GL (ft)": "kbgl", "KB - final": "kb", "RKB Elevation": "kb",
        "Ground Elevation": "gl", "Surface Latitude (WGS84)": "lat", "SHL_Long": "lon", "X": "x", "X (UTM)": "x", "X section": None, "Elevation Datum": "datum_ref", "Datum": "crs",
        "Total Depth TVD (ft)": "td_tvd", "TD (ft MD)": "td_md", "Well Type": "type", "Completion Date": "completed", "County / Parish": "county", "GR": None, "": None,
    }
    assert {h: T.field_of(h) for h in want} == want
    assert [T.header_unit(h) for h in ("Top (ft MD)", "depth_m", "TVD [metres]", "MD")] == ["ft", "m", "m", None]


def test_guess_tells_kinds_apart(spark):
    rows = [("A", str(100 * k), str(100 * k + 20), "sand" if k % 2 else "shale", str(k / 7)) for k in range(12)]
    five = "`well` string, `from` string, `to` string, `description` string, `show` string"
    g = T.guess(frame(spark, rows, five))
    assert g["kind"] == "events" and (g["map"]["top"], g["map"]["base"], g["map"]["label"]) == ("from", "to", "description")
    often = frame(spark, [("A", "sand", str(k)) for k in range(9)], "well string, formation string, md string")
    assert T.guess(often)["kind"] == "events" and not T.guess(often)["sure"]
    assert T.guess(frame(spark, rows[:0], five))["kind"] == "unknown"
    profile = T.profile(frame(spark, [("A", "1,5"), ("A", " "), ("B", "x"), (None, "2")], "a string, b string"))
    assert profile["a"] == {"rows": 4, "filled": 3, "numeric": 0.0, "distinct": 2}
    assert profile["b"]["filled"] == 3 and profile["b"]["numeric"] == pytest.approx(2 / 3)
