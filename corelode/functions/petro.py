"""Published petrophysical equations as functions from Column to Column.

Everything stays in built-in expressions. Missing values are null and propagate; a clamp never turns a null into a
bound. Units: g/cc, ohm.m, us/ft, degrees F, v/v.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Matrix densities (g/cc) and sonic transit times (us/ft) of the three usual rocks.
MATRIX_DENSITY = {"sandstone": 2.65, "limestone": 2.71, "dolomite": 2.87}
MATRIX_TRANSIT = {"sandstone": 55.5, "limestone": 47.6, "dolomite": 43.5}
# Response of the delta log R method to each porosity log.
DELTA_LOG_R = {"density": -2.5, "sonic": 0.02, "neutron": 4.0}
# Neutron reading of each rock on a log calibrated to limestone or to sandstone, and the photoelectric
# factor and density of pure minerals (chart overlays).
NEUTRON_OFFSET = {
    "limestone": {"sandstone": -0.035, "limestone": 0.0, "dolomite": 0.02},
    "sandstone": {"sandstone": 0.0, "limestone": 0.035, "dolomite": 0.055},
}
PE_POINTS = {"Quartz": (1.81, 2.65), "Calcite": (5.08, 2.71), "Dolomite": (3.14, 2.87), "Anhydrite": (5.05, 2.98)}


def col(x) -> Column:
    """A column by name, a Column as it is, a number as a double."""
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(None if x is None else float(x)).cast("double")


def clamp(x, low, high) -> Column:
    x = col(x)
    return F.when(x.isNotNull(), F.least(F.greatest(x, col(low)), col(high)))


def positive(x) -> Column:
    """x where it is above zero, else null."""
    x = col(x)
    return F.when(x > 0, x)


def gamma_index(gr, clean, shale) -> Column:
    span = col(shale) - col(clean)
    return clamp(F.when(span != 0, (col(gr) - col(clean)) / span), 0, 1)


def vshale_of_index(index, method: str = "linear") -> Column:
    """Shale volume of a gamma-ray index: linear, Larionov 1969 (Tertiary or older rocks) or Clavier 1971."""
    i = col(index)
    if method == "larionov_tertiary":
        return 0.083 * (F.pow(F.lit(2.0), 3.7 * i) - 1.0)
    if method == "larionov_older":
        return 0.33 * (F.pow(F.lit(2.0), 2.0 * i) - 1.0)
    if method == "clavier":
        inside = 3.38 - (i + 0.7) * (i + 0.7)
        return 1.7 - F.sqrt(F.when(inside.isNotNull(), F.greatest(inside, F.lit(0.0))))
    if method == "linear":
        return i
    raise ValueError(f"unknown shale volume method: {method}")


def vshale(gr, clean, shale, method: str = "linear") -> Column:
    return vshale_of_index(gamma_index(gr, clean, shale), method)


def vshale_sp(sp, sand, shale) -> Column:
    """Shale volume from spontaneous potential, whichever way it deflects; null where both lines are equal."""
    return gamma_index(sp, sand, shale)


def porosity_density(rhob, matrix=2.71, fluid=1.0) -> Column:
    return (col(matrix) - col(rhob)) / (col(matrix) - col(fluid))


def porosity_neutron_density(neutron, density, method: str = "average") -> Column:
    """Average or root mean square of both; whichever exists where one is missing."""
    n, d = col(neutron), col(density)
    both = (n + d) / 2.0 if method == "average" else F.sqrt((n * n + d * d) / 2.0)
    return F.coalesce(both, d, n)


def porosity_sonic(dt, matrix=55.5) -> Column:
    """Raymer, Hunt and Gardner 1980, field form."""
    t = positive(dt)
    return clamp(0.625 * (t - col(matrix)) / t, 0, 1)


def temperature(depth, surface, bottom, total_depth) -> Column:
    """Linear between the surface and the bottom-hole temperature at total depth; null without either."""
    return col(surface) + (col(bottom) - col(surface)) * col(depth) / positive(total_depth)


def water_resistivity(rw, at, temperature_) -> Column:
    """Arps 1953 (degrees F)."""
    return col(rw) * (col(at) + 6.77) / (col(temperature_) + 6.77)


def saturation_archie(rt, phi, rw, a=1.0, m=2.0, n=2.0) -> Column:
    """Archie 1942; null where resistivity or porosity is missing or not positive."""
    return clamp(F.pow(col(a) * col(rw) / (F.pow(positive(phi), col(m)) * positive(rt)), 1.0 / col(n)), 0, 1)


def saturation_simandoux(rt, phi, rw, vsh, rsh, a=1.0, m=2.0) -> Column:
    """Simandoux 1963 with n = 2, as a quadratic; Archie where there is no shale or no shale resistivity."""
    r, p = positive(rt), positive(phi)
    clay = col(vsh) / positive(rsh)
    lead = F.pow(p, col(m)) / (col(a) * col(rw))
    shaly = clamp((F.sqrt(clay * clay + 4.0 * lead / r) - clay) / (2.0 * lead), 0, 1)
    return F.when((col(vsh) > 0) & (col(rsh) > 0), shaly).otherwise(saturation_archie(rt, phi, rw, a, m, 2.0))


def saturation_index(rt, r0, n=2.0) -> Column:
    """From the resistivity index, without porosity."""
    return clamp(F.pow(positive(r0) / positive(rt), 1.0 / col(n)), 0, 1)


def delta_log_r(rt, rt_base, log, log_base, kind: str = "density") -> Column:
    """Passey 1990: separation of the resistivity and a porosity log from their shale baselines."""
    return F.log10(positive(rt) / col(rt_base)) + DELTA_LOG_R[kind] * (col(log) - col(log_base))


def organic_carbon(delta, maturity=10.0) -> Column:
    """Passey 1990, weight percent, not below zero."""
    toc = col(delta) * F.pow(F.lit(10.0), 2.297 - 0.1688 * col(maturity))
    return F.when(toc.isNotNull(), F.greatest(toc, F.lit(0.0)))


def washout(caliper, bit, tolerance=1.0) -> Column:
    return F.coalesce(col(caliper) - col(bit) > tolerance, F.lit(False))


def bad_hole(caliper, bit, correction=None, tolerance=1.0, correction_tolerance=0.15) -> Column:
    return washout(caliper, bit, tolerance) | F.coalesce(F.abs(col(correction)) > correction_tolerance, F.lit(False))


def pickett_resistivity(phi, sw, rw, a=1.0, m=2.0, n=2.0) -> Column:
    """Resistivity of a saturation line at a porosity: the inverse of Archie."""
    return col(a) * col(rw) / (F.pow(col(phi), col(m)) * F.pow(col(sw), col(n)))


def quick_lithology(vsh, pe, sand_vsh=0.4, shale_vsh=0.65, lime_pe=4.0, marl_pe=3.5, marl_vsh=0.75, sand_pe=2.6) -> Column:
    """Lithology class from shale volume and, where there is one, the photoelectric factor; null without shale volume.
    Clean rock is limestone, sandstone or siltstone by its factor; a high factor in shalier rock means marl."""
    v, p = col(vsh), col(pe)
    clean = v < sand_vsh
    by_factor = F.when(clean & (p >= lime_pe), "limestone").when((v < marl_vsh) & (p >= marl_pe), "marl").when(clean & (p >= sand_pe), "siltstone")
    by_shale = F.when(clean, "sandstone").when(v < shale_vsh, "siltstone").when(v >= shale_vsh, "shale")
    return F.coalesce(by_factor, by_shale)


def crossover(rhob, nphi, matrix=2.71, fluid=1.0, offset=0.0) -> Column:
    """Whether the density porosity exceeds the neutron porosity on matching scales (gas, or a lighter matrix)."""
    return F.coalesce(porosity_density(rhob, matrix, fluid) > col(nphi) + offset, F.lit(False))
