"""Queries over the petrophysical functions and the interpretation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import petro as P
from ..functions import sql
from ..operators import interpret as I
from ..sources import store
from . import base as B

QUERIES, SQL = {}, {}

BASELINES = B.CTE + """,
mids AS (SELECT well_id, quantile_cont(gr, 0.5) AS med, quantile_cont(gr, 0.02) AS p2 FROM log_samples WHERE gr IS NOT NULL GROUP BY well_id),
devs AS (SELECT s.well_id, med, p2, med + CAST(2.5 AS DOUBLE) * quantile_cont(abs(gr - med), 0.5) AS hot FROM log_samples s JOIN mids USING (well_id) WHERE gr IS NOT NULL GROUP BY s.well_id, med, p2),
baselines AS (
  SELECT s.well_id, floor(p2 + CAST(0.5 AS DOUBLE)) AS gr_clean, floor(quantile_cont(CASE WHEN gr <= hot THEN gr END, 0.95) + CAST(0.5 AS DOUBLE)) AS gr_shale, hot,
    1 - count(CASE WHEN gr <= hot THEN 1 END) / CAST(count(*) AS DOUBLE) AS hot_fraction
  FROM log_samples s JOIN devs USING (well_id) WHERE gr IS NOT NULL GROUP BY s.well_id, p2, hot),
indexed AS (
  SELECT s.*, b.gr_clean, b.gr_shale, CASE WHEN gr_shale <> gr_clean AND gr IS NOT NULL THEN least(greatest((gr - gr_clean) / (gr_shale - gr_clean), 0), 1) END AS igr
  FROM log_samples s JOIN baselines b USING (well_id))
"""


def gr_baselines(spark, sf_dir):
    return B.rounded(I.gr_baselines(B.log_samples(spark, sf_dir)))


QUERIES["gr_baselines"] = gr_baselines
SQL["gr_baselines"] = BASELINES + "SELECT well_id, gr_clean, gr_shale, round(hot, 6) AS hot, round(hot_fraction, 6) AS hot_fraction FROM baselines"

_VSH = {
    "linear": "igr",
    "larionov_tertiary": "CAST(0.083 AS DOUBLE) * (pow(CAST(2 AS DOUBLE), CAST(3.7 AS DOUBLE) * igr) - 1)",
    "larionov_older": "CAST(0.33 AS DOUBLE) * (pow(CAST(2 AS DOUBLE), CAST(2 AS DOUBLE) * igr) - 1)",
    "clavier": "CAST(1.7 AS DOUBLE) - sqrt(greatest(CAST(0 AS DOUBLE), CAST(3.38 AS DOUBLE) - (igr + CAST(0.7 AS DOUBLE)) * (igr + CAST(0.7 AS DOUBLE))))",
}


def _vsh(method):
    def query(spark, sf_dir):
        s = B.log_samples(spark, sf_dir)
        j = s.join(I.gr_baselines(s), "well_id")
        return B.rounded(j.select("well_id", "idx", P.vshale("gr", "gr_clean", "gr_shale", method).alias("vsh")))

    return query


for _m, _sql in _VSH.items():
    QUERIES[f"vsh_{_m}"] = _vsh(_m)
    SQL[f"vsh_{_m}"] = BASELINES + f"SELECT well_id, idx, CASE WHEN igr IS NOT NULL THEN round({_sql}, 6) + 0.0 END AS vsh FROM indexed"


def _columns(name, sql, **columns):
    """A query of row functions over the samples, with its SQL expressions."""

    def query(spark, sf_dir):
        return B.rounded(B.log_samples(spark, sf_dir).select("well_id", "idx", *[c.alias(k) for k, c in columns.items()]))

    QUERIES[name] = query
    parts = ", ".join(f"round({e}, 6) + 0.0 AS {k}" if k not in ("bad", "wash", "lithology") else f"{e} AS {k}" for k, e in sql.items())
    SQL[name] = B.CTE + f"SELECT well_id, idx, {parts} FROM log_samples"


def d(x) -> str:
    return f"CAST({x} AS DOUBLE)"


class _Lazy:
    """Column expressions made when a session exists."""

    def __init__(self, make):
        self.make = make

    def alias(self, name):
        return self.make().alias(name)


PHID = f"(({d(2.71)} - rhob) / ({d(2.71)} - {d(1.0)}))"
_columns("phi_density", {"limestone": PHID, "sandstone": f"({d(2.65)} - rhob) / ({d(2.65)} - {d(1.0)})", "dolomite": f"({d(2.87)} - rhob) / ({d(2.87)} - {d(1.0)})"}, **{k: _Lazy(lambda k=k: P.porosity_density("rhob", P.MATRIX_DENSITY[k])) for k in ("limestone", "sandstone", "dolomite")})
_columns("phi_nd_avg", {"phi": f"(nphi + {PHID}) / {d(2)}"}, phi=_Lazy(lambda: P.porosity_neutron_density("nphi", P.porosity_density("rhob"))))
_columns("phi_nd_rms", {"phi": f"sqrt((nphi * nphi + {PHID} * {PHID}) / {d(2)})"}, phi=_Lazy(lambda: P.porosity_neutron_density("nphi", P.porosity_density("rhob"), "rms")))
DT = f"({d(45)} + nphi * {d(120)})"
_columns("phi_sonic", {"phi": f"least(greatest({d(0.625)} * ({DT} - {d(55.5)}) / {DT}, 0), 1)"}, phi=_Lazy(lambda: P.porosity_sonic(45.0 + F.col("nphi") * 120.0)))
WARM = f"({d(60)} + ({d(200)} - {d(60)}) * md / {d(6000)})"
RW = f"({d(0.05)} * ({d(75)} + {d(6.77)}) / ({WARM} + {d(6.77)}))"
_columns("rw_arps", {"temperature": WARM, "rw": RW}, temperature=_Lazy(lambda: P.temperature("md", 60, 200, 6000)), rw=_Lazy(lambda: P.water_resistivity(0.05, 75, P.temperature("md", 60, 200, 6000))))
ARCHIE = f"CASE WHEN rt > 0 AND nphi > 0 THEN least(greatest(pow({d(0.05)} / (pow(nphi, {d(2)}) * rt), {d(0.5)}), 0), 1) END"
_columns("sw_archie", {"sw": ARCHIE}, sw=_Lazy(lambda: P.saturation_archie("rt", "nphi", 0.05)))
_CLAY, _LEAD = f"(gr / {d(200)} / {d(4)})", f"(pow(nphi, {d(2)}) / {d(0.05)})"
_columns(
    "sw_simandoux",
    {"sw": f"CASE WHEN gr > 0 THEN CASE WHEN rt > 0 AND nphi > 0 THEN least(greatest((sqrt({_CLAY} * {_CLAY} + {d(4)} * {_LEAD} / rt) - {_CLAY}) / ({d(2)} * {_LEAD}), 0), 1) END ELSE {ARCHIE} END"},
    sw=_Lazy(lambda: P.saturation_simandoux("rt", "nphi", 0.05, F.col("gr") / 200.0, 4.0)),
)
_columns("sw_ri", {"sw": f"CASE WHEN rt > 0 THEN least(greatest(pow({d(3)} / rt, {d(0.5)}), 0), 1) END"}, sw=_Lazy(lambda: P.saturation_index("rt", 3.0)))
DLR = f"(log10(rt / {d(5)}) + {d(-2.5)} * (rhob - {d(2.5)}))"
_columns("toc_passey", {"delta": DLR, "toc": f"greatest({DLR} * pow({d(10)}, {d(2.297)} - {d(0.1688)} * {d(10)}), 0)"}, delta=_Lazy(lambda: P.delta_log_r("rt", 5.0, "rhob", 2.5)), toc=_Lazy(lambda: P.organic_carbon(P.delta_log_r("rt", 5.0, "rhob", 2.5))))
_columns("bad_hole", {"wash": f"cali - {d(8.5)} > 1", "bad": f"cali - {d(8.5)} > 1 OR abs(nphi - {d(0.2)}) > {d(0.15)}"}, wash=_Lazy(lambda: P.washout("cali", 8.5)), bad=_Lazy(lambda: P.bad_hole("cali", 8.5, F.col("nphi") - 0.2)))
_columns("vsh_sp", {"vsh": f"least(greatest((rt - {d(5)}) / ({d(60)} - {d(5)}), 0), 1)"}, vsh=_Lazy(lambda: P.vshale_sp("rt", 5.0, 60.0)))
_columns("pickett", {"rt_line": f"CASE WHEN nphi > 0 THEN {d(0.05)} / (pow(nphi, {d(2)}) * pow({d(0.5)}, {d(2)})) END"}, rt_line=_Lazy(lambda: P.pickett_resistivity(P.positive("nphi"), 0.5, 0.05)))
_PE = f"({d(1)} + nphi * {d(12)})"
_columns(
    "quick_lithology",
    {"lithology": f"CASE WHEN gr IS NULL THEN NULL WHEN {_PE} >= 4 AND gr / {d(200)} < {d(0.4)} THEN 'limestone' WHEN {_PE} >= {d(3.5)} AND gr / {d(200)} < {d(0.75)} THEN 'marl' WHEN {_PE} < {d(2.6)} AND gr / {d(200)} < {d(0.4)} THEN 'sandstone' WHEN gr / {d(200)} < {d(0.65)} THEN 'siltstone' ELSE 'shale' END"},
    lithology=_Lazy(lambda: P.quick_lithology(F.col("gr") / 200.0, 1.0 + F.col("nphi") * 12.0)),
)

INTERPRETED = BASELINES + f""",
bits AS (SELECT well_id, quantile_cont(cali, 0.1) AS bit FROM log_samples GROUP BY well_id),
porous AS (
  SELECT i.*, b.bit, igr AS vsh, {PHID} AS phid, least(greatest((nphi + {PHID}) / {d(2)}, 0), {d(0.5)}) AS phit, coalesce(cali - b.bit > 1, false) AS bad_hole
  FROM indexed i JOIN bits b USING (well_id)),
effective AS (SELECT *, coalesce(phit * (1 - vsh), phit) AS phie FROM porous),
wet AS (SELECT *, CASE WHEN rt > 0 AND phie > 0 THEN least(greatest(pow({d(0.05)} / (pow(phie, {d(2)}) * rt), {d(0.5)}), 0), 1) END AS sw FROM effective),
net AS (SELECT *, phie * sw AS bvw, CASE WHEN NOT bad_hole AND (vsh < {d(0.5)} OR vsh IS NULL) AND phie >= {d(0.06)} THEN 1 ELSE 0 END AS net_res FROM wet),
interpreted AS (SELECT *, CASE WHEN net_res = 1 AND sw <= {d(0.6)} THEN 1 ELSE 0 END AS net_pay FROM net)
"""


def interpretation(spark, sf_dir):
    s = I.interpret(B.log_samples(spark, sf_dir))
    return B.rounded(s.select("well_id", "idx", "vsh", "phid", "phit", "phie", "sw", "bvw"))


def net_flags(spark, sf_dir):
    s = I.interpret(B.log_samples(spark, sf_dir))
    return s.select("well_id", "idx", "bad_hole", "net_res", "net_pay")


def organic_carbon(spark, sf_dir):
    samples = B.samples_once(spark, sf_dir)
    above = B.zones(spark, sf_dir, samples).where("zone_no = 0 AND zone != 'Whole well'")
    # the baselines and the result both read what was interpreted
    s = I.organic_carbon(store.written(I.interpret(samples), "interpreted"), above)
    return B.rounded(s.select("well_id", "idx", "rt_base", "rhob_base", "toc"))


QUERIES |= {"interpretation": interpretation, "net_flags": net_flags, "organic_carbon": organic_carbon}
SQL["interpretation"] = INTERPRETED + "SELECT well_id, idx, round(vsh, 6) + 0.0 AS vsh, round(phid, 6) + 0.0 AS phid, round(phit, 6) + 0.0 AS phit, round(phie, 6) + 0.0 AS phie, round(sw, 6) + 0.0 AS sw, round(bvw, 6) + 0.0 AS bvw FROM interpreted"
SQL["net_flags"] = INTERPRETED + "SELECT well_id, idx, bad_hole, net_res, net_pay FROM interpreted"
SQL["organic_carbon"] = INTERPRETED + f""",
cuts AS (SELECT well_id, quantile_cont(rt, 0.5) AS cut FROM interpreted WHERE rt > 0 AND rhob IS NOT NULL AND vsh > {d(0.6)} GROUP BY well_id),
above AS (SELECT well_id, top, base FROM zones WHERE zone_no = 0 AND zone <> 'Whole well'),
lean AS (
  SELECT i.well_id, rt, rhob FROM interpreted i JOIN above z ON z.well_id = i.well_id AND i.md >= z.top AND i.md < z.base
  WHERE rt > 0 AND rhob IS NOT NULL AND NOT coalesce(vsh < {d(0.5)}, false)
  UNION ALL
  SELECT u.well_id, rt, rhob FROM interpreted u JOIN cuts USING (well_id) LEFT JOIN above z USING (well_id)
  WHERE rt > 0 AND rhob IS NOT NULL AND vsh > {d(0.6)} AND rt <= cut AND z.well_id IS NULL),
tocbase AS (SELECT well_id, quantile_cont(rt, 0.5) AS rt_base, quantile_cont(rhob, 0.5) AS rhob_base FROM lean GROUP BY well_id HAVING count(*) >= 20)
SELECT i.well_id, idx, round(rt_base, 6) AS rt_base, round(rhob_base, 6) AS rhob_base,
  CASE WHEN vsh >= {d(0.35)} AND NOT bad_hole THEN round(least(greatest((log10(rt / rt_base) - {d(2.5)} * (rhob - rhob_base)) * pow({d(10)}, {d(2.297)} - {d(0.1688)} * {d(10)}), 0), 20), 6) + 0.0 END AS toc
FROM interpreted i LEFT JOIN tocbase USING (well_id)"""


def sql_functions(spark, sf_dir):
    """The equations called in SQL text."""
    sql.register(spark)
    text = """
    SELECT well_id, idx, vshale_larionov_older(gr, 20, 150) AS vsh, porosity_density(rhob) AS phid, porosity_neutron_density_rms(nphi, porosity_density(rhob, 2.65)) AS phit,
      saturation_archie(rt, nphi, 0.05) AS sw, saturation_simandoux(rt, nphi, rw => 0.05, vsh => gr / 200, rsh => 4) AS shaly, water_resistivity(0.05, 75, temperature_at(md, 60, 180, 6000)) AS rw,
      organic_carbon(delta_log_r_density(rt, 5, rhob, 2.5)) AS toc, washout(cali, 8.5) AS wash, quick_lithology(gr / 200, 1 + nphi * 12) AS lithology
    FROM {samples}"""
    return B.rounded(spark.sql(text, samples=B.log_samples(spark, sf_dir)))


_V, _D65, _D71 = f"least(greatest((gr - 20) / {d(130)}, 0), 1)", f"(({d(2.65)} - rhob) / {d(1.65)})", f"(({d(2.71)} - rhob) / {d(1.71)})"
_RT, _NPHI = "CASE WHEN rt > 0 THEN rt END", "CASE WHEN nphi > 0 THEN nphi END"
_CLAY, _LEAD = f"(gr / {d(200)} / {d(4)})", f"(pow({_NPHI}, {d(2)}) / {d(0.05)})"
_ARCHIE = f"pow({d(0.05)} / (pow({_NPHI}, {d(2)}) * {_RT}), {d(0.5)})"
_bounded = lambda x: f"CASE WHEN {x} IS NOT NULL THEN least(greatest({x}, 0), 1) END"
_SHALY = f"((sqrt({_CLAY} * {_CLAY} + 4 * {_LEAD} / ({_RT})) - {_CLAY}) / (2 * {_LEAD}))"
SQL["sql_functions"] = B.CTE + f"""
SELECT well_id, idx, round(CASE WHEN gr IS NOT NULL THEN {d(0.33)} * (pow({d(2)}, 2 * {_V}) - 1) END, 6) + 0.0 AS vsh, round({_D71}, 6) + 0.0 AS phid,
  round(sqrt((nphi * nphi + {_D65} * {_D65}) / 2), 6) + 0.0 AS phit, round({_bounded(_ARCHIE)}, 6) + 0.0 AS sw,
  round(CASE WHEN gr > 0 THEN {_bounded(_SHALY)} ELSE {_bounded(_ARCHIE)} END, 6) + 0.0 AS shaly,
  round({d(0.05)} * {d(81.77)} / ({d(60)} + {d(120)} * md / {d(6000)} + {d(6.77)}), 6) + 0.0 AS rw, round(greatest({DLR} * pow({d(10)}, {d(2.297)} - {d(0.1688)} * {d(10)}), 0), 6) + 0.0 AS toc, cali - {d(8.5)} > 1 AS wash,
  CASE WHEN gr IS NULL THEN NULL WHEN {_PE} >= 4 AND gr / {d(200)} < {d(0.4)} THEN 'limestone' WHEN {_PE} >= {d(3.5)} AND gr / {d(200)} < {d(0.75)} THEN 'marl' WHEN {_PE} < {d(2.6)} AND gr / {d(200)} < {d(0.4)} THEN 'sandstone' WHEN gr / {d(200)} < {d(0.65)} THEN 'siltstone' ELSE 'shale' END AS lithology
FROM log_samples"""
QUERIES["sql_functions"] = sql_functions
