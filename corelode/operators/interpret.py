"""Interpretation of wells from whatever curves they have: shale volume, porosity, saturation, net flags, organic carbon.

Which source a well uses is one aggregation of what is available; it joins back as one row per well, and all columns are
then built-in expressions over the samples.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import petro as P
from ..functions.scalars import round_half_up
from ..sources.store import written

CURVES = ("gr", "sp", "rhob", "nphi", "rt", "dt", "nmr", "cali", "drho", "pe")


@dataclass(frozen=True)
class Parameters:
    """Defaults of the interpretation; wells may override clean and shale lines, bit, matrix and temperatures."""

    vsh_method: str = "linear"
    matrix: str = "auto"
    fluid: float = 1.0
    porosity_method: str = "average"
    a: float = 1.0
    m: float = 2.0
    n: float = 2.0
    rw: float = 0.05
    rw_temperature: float = 75.0
    surface_temperature: float = 60.0
    sw_method: str = "archie"
    sw_porosity: str = "effective"
    cut_vsh: float = 0.5
    cut_phi: float = 0.06
    cut_sw: float = 0.6
    maturity: float = 10.0


def gr_baselines(samples: DataFrame, gr: str = "gr") -> DataFrame:
    """(well_id, gr_clean, gr_shale, hot, hot_fraction): P2, and P95 of the values up to median + 2.5 median deviations, both rounded to whole units."""
    x = samples.where(F.col(gr).isNotNull())
    # each value once, with how often it occurs: three passes go over these
    x = x.groupBy("well_id", gr).agg(F.count("*").alias("_m"))
    mid = x.groupBy("well_id").agg(F.percentile(gr, F.lit(0.5), F.col("_m")).alias("med"), F.percentile(gr, F.lit(0.02), F.col("_m")).alias("p2"))
    dev = x.join(mid, "well_id").groupBy("well_id", "med", "p2").agg(F.percentile(F.abs(F.col(gr) - F.col("med")), F.lit(0.5), F.col("_m")).alias("mad"))
    dev = dev.withColumn("hot", F.col("med") + 2.5 * F.col("mad"))
    cool = F.when(F.col(gr) <= F.col("hot"), F.col(gr))
    out = x.join(dev, "well_id").groupBy("well_id", "p2", "hot").agg(F.percentile(cool, F.lit(0.95), F.col("_m")).alias("p95"), (1.0 - F.coalesce(F.sum(F.when(F.col(gr) <= F.col("hot"), F.col("_m"))), F.lit(0)) / F.sum("_m")).alias("hot_fraction"))
    return out.select("well_id", round_half_up("p2").cast("double").alias("gr_clean"), round_half_up("p95").cast("double").alias("gr_shale"), "hot", "hot_fraction")


def _complete(samples: DataFrame) -> DataFrame:
    return samples.withColumns({c: F.lit(None).cast("double") for c in CURVES if c not in samples.columns} | {c: F.lit(None).cast("double") for c in ("tvd",) if c not in samples.columns})


def sources(samples: DataFrame, wells: DataFrame | None = None, p: Parameters = Parameters()) -> DataFrame:
    """One row per well: baselines, sources of shale volume and porosity, bit size, matrix and scales. wells may give
    gr_clean, gr_shale, bit_size, matrix, bht."""
    s = _complete(samples)
    q = lambda c, v: F.percentile(c, F.lit(v))
    have = s.groupBy("well_id").agg(
        *[(F.count(c) > 0).alias(f"has_{c}") for c in CURVES],
        q("sp", 0.02).alias("sp_sand"),
        q("sp", 0.9).alias("sp_shale"),
        q("cali", 0.1).alias("gauge"),
        F.when(q("nmr", 0.5) > 1.5, 0.01).otherwise(1.0).alias("nmr_scale"),
        F.max(F.coalesce("tvd", "md")).alias("td"),
    )
    own = {"o_clean": "gr_clean", "o_shale": "gr_shale", "o_bit": "bit_size", "o_matrix": "matrix", "bht": "bht"}
    given = wells.select("well_id", *[(F.col(c) if c in wells.columns else F.lit(None)).cast("string" if c == "matrix" else "double").alias(n) for n, c in own.items()]) if wells is not None else None
    out = have.join(gr_baselines(s), "well_id", "left")
    out = out.join(given, "well_id", "left") if given is not None else out.withColumns({n: F.lit(None).cast("string" if n == "o_matrix" else "double") for n in own})
    auto = F.coalesce("o_matrix", F.lit("limestone")) if p.matrix == "auto" else F.lit(p.matrix)
    out = out.withColumn("matrix", auto).withColumns({"gr_clean": F.coalesce("o_clean", "gr_clean"), "gr_shale": F.coalesce("o_shale", "gr_shale"), "bit": F.coalesce("o_bit", "gauge")})
    pick = lambda table, default: F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[F.col("matrix")], F.lit(default))
    neutron = F.col("has_nphi") if p.porosity_method != "density" else F.lit(False)
    return out.withColumns({
        "rho_matrix": pick(P.MATRIX_DENSITY, 2.71),
        "dt_matrix": pick(P.MATRIX_TRANSIT, 55.5),
        "vsh_source": F.when(F.col("has_gr") & F.col("gr_clean").isNotNull() & F.col("gr_shale").isNotNull(), "GR").when(F.col("has_sp"), "SP"),
        "phi_source": F.when(F.col("has_rhob") & neutron, "neutron-density").when(F.col("has_rhob"), "density").when(F.col("has_nmr"), "NMR").when(F.col("has_dt"), "sonic").when(F.col("has_nphi"), "neutron"),
    }).select("well_id", "has_rt", "sp_sand", "sp_shale", "nmr_scale", "td", "bht", "gr_clean", "gr_shale", "hot", "hot_fraction", "bit", "matrix", "rho_matrix", "dt_matrix", "vsh_source", "phi_source")


def interpret(samples: DataFrame, wells: DataFrame | None = None, p: Parameters = Parameters()) -> DataFrame:
    """samples with vsh, phid, phit, phie, phi (the one used for saturation), sw, bvw, bad_hole, washout, net_res and net_pay.

    Missing porosity fails the net cutoff, missing shale volume passes it. Without a bottom-hole temperature the water
    resistivity stays as given. Wells without porosity get net sand from shale volume alone, and pay from the resistivity index over the P10
    of at least 50 net samples."""
    # one row a well, joined twice
    s = _complete(samples).join(written(sources(samples, wells, p), "sources"), "well_id")
    by_gr = P.vshale("gr", F.col("gr_clean"), F.col("gr_shale"), p.vsh_method)
    by_sp = P.vshale_of_index(P.vshale_sp("sp", F.col("sp_sand"), F.col("sp_shale")), p.vsh_method)
    vsh = F.when(F.col("vsh_source") == "GR", by_gr).when(F.col("vsh_source") == "SP", by_sp)
    phid = P.porosity_density("rhob", F.col("rho_matrix"), p.fluid)
    phit = (
        F.when(F.col("phi_source") == "density", F.col("phid"))
        .when(F.col("phi_source") == "neutron-density", P.porosity_neutron_density("nphi", "phid", p.porosity_method))
        .when(F.col("phi_source") == "NMR", F.col("nmr") * F.col("nmr_scale"))
        .when(F.col("phi_source") == "sonic", P.porosity_sonic("dt", F.col("dt_matrix")))
        .when(F.col("phi_source") == "neutron", F.col("nphi"))
    )
    s = s.withColumns({"vsh": vsh, "phid": phid}).withColumn("phit", P.clamp(phit, 0, 0.5))
    s = s.withColumn("phie", F.coalesce(F.col("phit") * (1.0 - F.col("vsh")), F.col("phit")))
    s = s.withColumn("phi", F.col("phit") if p.sw_porosity == "total" else F.col("phie"))
    warm = P.temperature(F.coalesce("tvd", "md"), p.surface_temperature, F.col("bht"), F.col("td"))
    rw = F.coalesce(P.water_resistivity(p.rw, p.rw_temperature, warm), F.lit(p.rw))
    if p.sw_method == "simandoux":
        rsh = s.where("vsh > 0.8 AND rt > 0").groupBy("well_id").agg(F.percentile("rt", F.lit(0.5)).alias("rsh"))
        s = s.join(rsh, "well_id", "left")
        sw = P.saturation_simandoux("rt", "phi", rw, "vsh", "rsh", p.a, p.m)
    else:
        sw = P.saturation_archie("rt", "phi", rw, p.a, p.m, p.n)
    s = s.withColumns({"sw": sw, "washout": P.washout("cali", "bit"), "bad_hole": P.bad_hole("cali", "bit", "drho")})
    s = s.withColumn("bvw", F.col("phi") * F.col("sw"))
    clean, bad = F.coalesce(F.col("vsh") < p.cut_vsh, F.lit(False)), F.col("bad_hole")
    r0 = s.where(F.col("phi_source").isNull() & F.col("vsh_source").isNotNull() & clean & ~bad & (F.col("rt") > 0)).groupBy("well_id").agg(F.when(F.count("rt") >= 50, F.percentile("rt", F.lit(0.1))).alias("r0"))
    s = s.join(r0, "well_id", "left")
    porous = F.col("phi_source").isNotNull()
    passes = F.when(porous, (clean | F.col("vsh").isNull()) & F.coalesce(F.col("phi") >= p.cut_phi, F.lit(False))).otherwise(F.col("vsh_source").isNotNull() & clean)
    s = s.withColumn("net_res", (~bad & passes).cast("int"))
    wet = F.when(porous, F.col("sw")).otherwise(P.saturation_index("rt", "r0", p.n))
    return s.withColumn("net_pay", ((F.col("net_res") == 1) & F.coalesce(wet <= p.cut_sw, F.lit(False))).cast("int"))


def organic_carbon(interpreted: DataFrame, baseline_zone: DataFrame | None = None, p: Parameters = Parameters(), least: int = 20) -> DataFrame:
    """interpreted with toc, by density delta log R. The baseline is the median of rt and rhob where vsh isn't under 0.5 inside
    baseline_zone (well_id, top, base), or else in the lower-resistivity half of vsh over 0.6; at least 20 samples. Carbon is given in
    fine rock (vsh from 0.35 or photoelectric factor from 3.5) and good hole, at most 20 percent."""
    usable = interpreted.where("rt > 0 AND rhob IS NOT NULL").select("well_id", "md", "rt", "rhob", "vsh")
    shaly = usable.where("vsh > 0.6")
    half = shaly.groupBy("well_id").agg(F.percentile("rt", F.lit(0.5)).alias("cut"))
    lean = shaly.join(half, "well_id").where("rt <= cut").select("well_id", "rt", "rhob")
    if baseline_zone is not None:
        inside = usable.join(baseline_zone.select("well_id", "top", "base"), "well_id").where("md >= top AND md < base AND NOT coalesce(vsh < 0.5, false)").select("well_id", "rt", "rhob")
        lean = lean.join(baseline_zone.select("well_id").distinct(), "well_id", "left_anti").unionByName(inside)
    base = lean.groupBy("well_id").agg(F.count("*").alias("n"), F.percentile("rt", F.lit(0.5)).alias("rt_base"), F.percentile("rhob", F.lit(0.5)).alias("rhob_base")).where(F.col("n") >= least).drop("n")
    toc = P.organic_carbon(P.delta_log_r("rt", F.col("rt_base"), "rhob", F.col("rhob_base")), p.maturity)
    fine = F.coalesce(F.col("vsh") >= 0.35, F.lit(False)) | F.coalesce(F.col("pe") >= 3.5, F.lit(False))
    joined = interpreted.join(base, "well_id", "left")
    return joined.withColumn("toc", F.when(fine & ~F.col("bad_hole"), P.clamp(toc, 0, 20)))
