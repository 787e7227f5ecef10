"""Zones between formation tops, and the statistics of curves over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .order import running

QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9)


def build_zones(extent: DataFrame, tops: DataFrame) -> DataFrame:
    """(well_id, zone_no, zone, top, base) from each well's extent (well_id, start, td) and its tops strictly inside it: each top
    to the next or to td, the part above the first, or the whole well where there is none. Zones are half open."""
    inside = tops.select("well_id", "name", "md").join(extent, "well_id").where("md > start AND md < td")
    line = W.partitionBy("well_id").orderBy("md", "name")
    named = inside.select("well_id", F.row_number().over(line).alias("zone_no"), F.col("name").alias("zone"), F.col("md").alias("top"), F.lead("md").over(line).alias("next"), "td")
    named = named.select("well_id", "zone_no", "zone", "top", F.coalesce("next", "td").alias("base"))
    first = named.where("zone_no = 1").select("well_id", F.col("zone").alias("first"), F.col("top").alias("first_top"))
    lead = extent.join(first, "well_id", "left").select("well_id", F.lit(0).alias("zone_no"), F.coalesce(F.concat(F.lit("Above "), "first"), F.lit("Whole well")).alias("zone"), F.col("start").alias("top"), F.coalesce("first_top", "td").alias("base"))
    return named.unionByName(lead)


def extent(samples: DataFrame) -> DataFrame:
    return samples.groupBy("well_id").agg(F.min("md").alias("start"), F.max("md").alias("td"))


def thickness(z: str = "md", keys: tuple[str, ...] = ("well_id",), order: str = "md") -> Column:
    """Weight of a sample: half the distance between its neighbours, the whole distance to the only one at the ends."""
    line = W.partitionBy(*keys).orderBy(order)
    up, down = F.lag(z).over(line), F.lead(z).over(line)
    return F.abs(F.when(up.isNotNull() & down.isNotNull(), (down - up) / 2.0).otherwise(F.coalesce(down, F.col(z)) - F.coalesce(up, F.col(z))))


def summarize(zoned: DataFrame, value: str, keys: list[str], weight: str = "h", log: bool = False, more: list[Column] | None = None) -> DataFrame:
    """Weighted statistics of a curve: n, total, null_pct, mean (geometric for log curves), sd (population, not for log
    curves), min, unweighted P10 to P90 (linear between ranks), max, and `more` named aggregates of the same pass. Rows outside any zone must be gone. The spread is a second pass
    about the means of the first."""
    x = F.when(F.col(value) > 0, F.col(value)) if log else F.col(value)
    h = F.when(x.isNotNull(), F.col(weight))
    mean = F.exp(F.sum(F.log(x) * h) / F.sum(h)) if log else F.sum(x * h) / F.sum(h)
    parts = zoned.groupBy(*keys).agg(F.count(x).alias("n"), F.count("*").alias("total"), mean.alias("mean"), F.min(x).alias("min"), F.percentile(x, F.array(*map(F.lit, QUANTILES))).alias("q"), F.max(x).alias("max"), *(more or []))
    extra = parts.columns[len(keys) + 6 :]
    if not log:
        centre = zoned.groupBy(*keys).agg((F.sum(x * h) / F.sum(h)).alias("m"))
        spread = zoned.join(centre, keys).groupBy(*keys).agg(F.sqrt(F.sum(h * (x - F.col("m")) * (x - F.col("m"))) / F.sum(h)).alias("sd"))
        parts = parts.join(spread, keys, "left")
    else:
        parts = parts.withColumn("sd", F.lit(None).cast("double"))
    names = [f"p{int(100 * q)}" for q in QUANTILES]
    return parts.select(*keys, "n", "total", (100.0 * (1.0 - F.col("n") / F.col("total"))).alias("null_pct"), "mean", "sd", "min", *[F.get("q", F.lit(k)).alias(n) for k, n in enumerate(names)], "max", *extra)


def net_pay(zoned: DataFrame, zones: DataFrame, gr_cutoff: float = 75.0) -> DataFrame:
    """Thickness sums per well and zone: gross, net, ntg (net over the thickness with porosity), pay, phi_net, sw_pay, phi_h,
    hc_h, basis. zoned has h, phi, sw, net_res and net_pay (0/1), and gr; zones without porosity use the gamma-ray cutoff."""
    h, phi, sw = F.col("h"), F.col("phi"), F.col("sw")
    net, pay = F.coalesce(F.col("net_res") > 0.5, F.lit(False)), F.coalesce((F.col("net_pay") > 0.5) & sw.isNotNull(), F.lit(False))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    total = lambda cond, x: zero(F.sum(F.when(cond, x)))
    by = zoned.groupBy("well_id", "zone_no").agg(
        total(phi.isNotNull(), h).alias("cov"),
        total(net, h).alias("net"),
        total(net, phi * h).alias("phi_h"),
        total(pay, h).alias("pay"),
        total(pay, sw * h).alias("sw_h"),
        total(pay, phi * (1.0 - sw) * h).alias("hc_h"),
        total(F.col("gr").isNotNull(), h).alias("gr_cov"),
        total(F.col("gr") < gr_cutoff, h).alias("gr_net"),
    )
    flags = F.col("cov") > 0
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return zones.join(by, ["well_id", "zone_no"], "left").select(
        "well_id", "zone_no", "zone", "top", "base",
        (F.col("base") - F.col("top")).alias("gross"),
        F.when(flags, F.col("net")).otherwise(F.col("gr_net")).alias("net"),
        F.when(flags, ratio("net", "cov")).otherwise(ratio("gr_net", "gr_cov")).alias("ntg"),
        F.when(flags, F.col("pay")).alias("pay"),
        F.when(flags, ratio("phi_h", "net")).alias("phi_net"),
        F.when(flags, ratio("sw_h", "pay")).alias("sw_pay"),
        F.when(flags, F.col("phi_h")).alias("phi_h"),
        F.when(flags, F.col("hc_h")).alias("hc_h"),
        F.when(flags, "flags").when(F.col("gr_cov") > 0, "gr").alias("basis"),
    )


def histogram(zoned: DataFrame, value: str, low: float, high: float, bins: int = 20, log: bool = False, weight: str = "h", zone: str = "zone") -> DataFrame:
    """Share of thickness per bin for each zone and for all (zone null): bin -1 is below the range, `bins` above it, and the
    top edge is in the last bin; frac and cum (from below)."""
    f = F.log10 if log else (lambda x: x)
    x = F.when(F.col(value) > 0, F.col(value)) if log else F.col(value)
    lo, hi = f(F.lit(float(low))), f(F.lit(float(high)))
    place = F.floor((f(x) - lo) / ((hi - lo) / bins)).cast("int")
    place = F.when(f(x) == hi, bins - 1).otherwise(F.least(F.greatest(place, F.lit(-1)), F.lit(bins)))
    rows = zoned.where(x.isNotNull() & (F.col(weight) > 0)).select(F.col(zone).alias("zone"), place.alias("bin"), F.col(weight).alias("w"))
    # one pass over the rows; the sums by bin are then rolled up
    sums = rows.groupBy("zone", "bin").agg(F.sum("w").alias("w"), F.count("*").alias("n"))
    both = sums.groupingSets([[F.col("zone"), F.col("bin")], [F.col("bin")]], "zone", "bin").agg(F.sum("w").alias("w"), F.sum("n").alias("n"), F.grouping("zone").alias("all"))
    line = W.partitionBy("all", "zone")
    return both.select("zone", F.col("all").cast("boolean").alias("all_zones"), "bin", "n", (F.col("w") / F.sum("w").over(line)).alias("frac"), (F.sum("w").over(line.orderBy("bin")) / F.sum("w").over(line)).alias("cum"))


def weighted_quantiles(zoned: DataFrame, value: str, keys: list[str], at: tuple[float, ...] = (0.1, 0.5, 0.9), weight: str = "h") -> DataFrame:
    """The first value at which the cumulative weight reaches p of the total, for each p."""
    rows = zoned.where(F.col(value).isNotNull() & (F.col(weight) > 0)).groupBy(*keys, value).agg(F.sum(weight).alias("_w"))
    line = W.partitionBy(*keys)
    cum = rows.withColumns({"_c": F.sum("_w").over(line.orderBy(value)), "_t": F.sum("_w").over(line)})
    return cum.groupBy(*keys).agg(*[F.min(F.when(F.col("_c") >= p * F.col("_t") - 1e-12, F.col(value))).alias(f"wp{int(100 * p)}") for p in at])


def equal_count_breaks(samples: DataFrame, value: str, groups: int = 6, keys: tuple[str, ...] = ()) -> DataFrame:
    """min, max and the inner breaks b1.. that split a curve's values into groups of equal count (rank floor(k n / groups))."""
    counts = samples.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_m"))
    if keys:
        upto = F.sum("_m").over(W.partitionBy(*keys).orderBy(value))
        cum = counts.withColumns({"_upto": upto, "_n": F.sum("_m").over(W.partitionBy(*keys))})
    else:  # the values of a whole table have no partition of their own
        cum, n = running(counts, [value], "_m", "_upto")
        cum = cum.withColumn("_n", F.lit(n))
    rank = lambda k: F.least(F.floor(F.col("_n") * k / groups), F.col("_n") - 1)
    return cum.groupBy(*keys).agg(F.min(value).alias("min"), *[F.min(F.when(F.col("_upto") > rank(k), F.col(value))).alias(f"b{k}") for k in range(1, groups)], F.max(value).alias("max"))


def group_of(value, breaks: list) -> Column:
    """Number of breaks at or below the value."""
    return F.when(F.col(value).isNotNull(), sum((F.when(F.col(value) >= b, 1).otherwise(0) for b in breaks), F.lit(0)))


def zone_order(zones: DataFrame) -> DataFrame:
    """Zones ranked by their mean top over all wells."""
    mean = zones.groupBy("zone").agg(F.avg("top").alias("mean_top"), F.count("*").alias("wells"))
    return mean.withColumn("zone_rank", F.row_number().over(W.orderBy("mean_top", "zone")))


def auto_scale(samples: DataFrame, value: str, keys: list[str], log: bool = False, least: int = 10) -> DataFrame:
    """(low, high) for showing a curve: the values at ranks floor(0.02 (n-1)) and floor(0.98 (n-1)), widened to whole decades for log curves."""
    x = F.when(F.col(value) > 0, F.col(value)) if log else F.col(value)
    rows = samples.where(x.isNotNull())
    line = W.partitionBy(*keys)
    ranked = rows.withColumns({"_r": F.row_number().over(line.orderBy(value)) - 1, "_n": F.count("*").over(line)})
    at = lambda p: F.max(F.when(F.col("_r") == F.floor(p * (F.col("_n") - 1)), F.col(value)))
    out = ranked.groupBy(*keys).agg(F.count("*").alias("n"), at(0.02).alias("low"), at(0.98).alias("high")).where(F.col("n") >= least)
    if log:
        out = out.withColumns({"low": F.pow(F.lit(10.0), F.floor(F.log10("low"))), "high": F.pow(F.lit(10.0), F.ceil(F.log10("high")))})
    return out
