"""The petrophysical equations as SQL functions of a session.

Each is a temporary SQL function whose body is the very expression that the Column function builds, so Catalyst inlines it and plans are the same whichever way it is called.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import petro as P

Arguments = dict[str, str | float | None]

#: Function: its parameters (with a default where they may be left out, else None; text parameters as a type), and what builds it of their names.
FUNCTIONS: dict[str, tuple[Arguments, str, Callable[..., Column]]] = {
    "gamma_index": ({"gr": None, "clean": None, "shale": None}, "DOUBLE", P.gamma_index),
    **{f"vshale_{m}": ({"gr": None, "clean": None, "shale": None}, "DOUBLE", lambda gr, clean, shale, m=m: P.vshale(gr, clean, shale, m)) for m in ("linear", "larionov_tertiary", "larionov_older", "clavier")},
    "vshale_sp": ({"sp": None, "sand": None, "shale": None}, "DOUBLE", P.vshale_sp),
    "porosity_density": ({"rhob": None, "matrix": 2.71, "fluid": 1.0}, "DOUBLE", P.porosity_density),
    **{f"porosity_neutron_density_{m}": ({"neutron": None, "density": None}, "DOUBLE", lambda neutron, density, m=m: P.porosity_neutron_density(neutron, density, m)) for m in ("average", "rms")},
    "porosity_sonic": ({"dt": None, "matrix": 55.5}, "DOUBLE", P.porosity_sonic),
    "temperature_at": ({"depth": None, "surface": None, "bottom": None, "total_depth": None}, "DOUBLE", P.temperature),
    "water_resistivity": ({"rw": None, "at": None, "temperature": None}, "DOUBLE", P.water_resistivity),
    "saturation_archie": ({"rt": None, "phi": None, "rw": None, "a": 1.0, "m": 2.0, "n": 2.0}, "DOUBLE", P.saturation_archie),
    "saturation_simandoux": ({"rt": None, "phi": None, "rw": None, "vsh": None, "rsh": None, "a": 1.0, "m": 2.0}, "DOUBLE", P.saturation_simandoux),
    "saturation_index": ({"rt": None, "r0": None, "n": 2.0}, "DOUBLE", P.saturation_index),
    **{f"delta_log_r_{k}": ({"rt": None, "rt_base": None, "log": None, "log_base": None}, "DOUBLE", lambda rt, rt_base, log, log_base, k=k: P.delta_log_r(rt, rt_base, log, log_base, k)) for k in P.DELTA_LOG_R},
    "organic_carbon": ({"delta": None, "maturity": 10.0}, "DOUBLE", P.organic_carbon),
    "washout": ({"caliper": None, "bit": None}, "BOOLEAN", P.washout),
    "bad_hole": ({"caliper": None, "bit": None, "correction": None}, "BOOLEAN", P.bad_hole),
    "pickett_resistivity": ({"phi": None, "sw": None, "rw": None, "a": 1.0, "m": 2.0, "n": 2.0}, "DOUBLE", P.pickett_resistivity),
    "quick_lithology": ({"vsh": None, "pe": None}, "STRING", P.quick_lithology),
    "crossover": ({"rhob": None, "nphi": None, "matrix": 2.71, "fluid": 1.0}, "BOOLEAN", P.crossover),
}


def body(spark: SparkSession, parameters: Arguments, build: Callable[..., Column]) -> str:
    """The SQL text of an expression over double columns of these names."""
    frame = spark.createDataFrame([], ", ".join(f"`{p}` double" for p in parameters))
    made = frame.select(build(*[F.col(f"`{p}`") for p in parameters]).alias("made"))
    return made._jdf.queryExecution().analyzed().expressions().apply(0).child().sql()


def register(spark: SparkSession, prefix: str = "") -> list[str]:
    """Makes the functions known to the session; returns their names."""
    for name, (parameters, kind, build) in FUNCTIONS.items():
        listed = ", ".join(f"`{p}` DOUBLE" + (f" DEFAULT {v}D" if v is not None else "") for p, v in parameters.items())
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({listed}) RETURNS {kind} RETURN {body(spark, parameters, build)}")
    return [prefix + name for name in FUNCTIONS]
