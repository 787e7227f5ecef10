"""Curve operators: despiking, edits, family resolution, run lengths and merging of logging runs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import unit_key
from ..sources.store import written
from .depth import EXACT, resample

#: How deep a resistivity channel reads, by the letter or the inches that end its name.
LETTERS = {"D": "RD", "M": "RM", "S": "RS"}
#: Channels that are named by a rule. Arrays: prefix, what follows it, the suffix; lettered: stems with D, M or S.
LETTERED = ("R", "IL", "LL", "RP")
ARRAYS = ((("AT", "AHT", "AF", "AO", "RT"), (90, 60, 30, 20, 10), ""), (("P", "A"), (40, 34, 28, 22, 16), "H"))
RANKED = {"RLA": (5, 4, 3, 2, 1), "M2R": (9, 6, 3, 2, 1)}
#: The measurement itself under its own name, which tools of every maker use: symbol, then word.
OWN = {
    "GR": ("GR", "GAMMA"), "SP": ("SP", "SSP"), "CAL": ("CALI", "CAL"), "BS": ("BS", "BIT"), "RD": ("RT",), "RHOB": ("RHOB", "DEN", "DENS"), "NPHI": ("NPHI", "NPOR", "PHIN"),
    "DPHI": ("DPHI", "DPOR"), "DRHO": ("DRHO",), "PE": ("PE", "PEF"), "DT": ("DT", "AC"), "ROP": ("ROP",), "TG": ("TG", "TGAS", "GAS"), "CCL": ("CCL",), "BOND": ("BI", "BOND"), "AMP": ("AMP", "CBL"), "RS": ("RXO", "SFL", "MSFL"),
}
#: What single makers' tools call it, by tool.
TOOLS = {
    "telemetry and spectral gamma ray": {"GR": ("SGR", "ECGR", "HSGR", "CGR")},
    "lithology density and compensated neutron": {"RHOB": ("RHOZ", "RHO8"), "NPHI": ("TNPH", "APLC"), "PE": ("PEFZ", "PEF8"), "DRHO": ("HDRA",), "DPHI": ("DPHZ",), "CAL": ("HCAL", "LCAL")},
    "compensated Z-density": {"RHOB": ("ZDEN", "ZDNC"), "DRHO": ("ZCOR",), "NPHI": ("CNC", "CNCF")},
    "array sonic": {"DT": ("DTCO", "DTC", "DT24")},
    "shallow focused": {"RS": ("SFLU", "MCFL")},
    "surface and cement": {"ROP": ("ROPA",), "TG": ("TOTGAS",), "AMP": ("AMP3FT",), "BOND": ("BONDIX",)},
}


def _families() -> dict[str, tuple[str, ...]]:
    """The names of each family, most preferred first: own names, then those made by a rule, then single tools."""
    out: dict[str, list[str]] = {f: list(names) for f, names in OWN.items()}
    put = lambda family, name: out.setdefault(family, []).append(name)
    for stem in LETTERED:
        for letter, family in LETTERS.items():
            put(family, stem + letter)
    for prefixes, inches, suffix in ARRAYS:
        for prefix in prefixes:
            for n in inches:
                put("RD" if n > (60 if not suffix else 30) else "RM" if n > 20 else "RS", f"{prefix}{n}{suffix}")
    for prefix, ranks in RANKED.items():
        for n in ranks:
            put("RS" if n < 3 else "RD" if n in ranks[:1] or (prefix == "RLA" and n == 4) else "RM", f"{prefix}{n}")
    for channels in TOOLS.values():
        for family, names in channels.items():
            for name in names:
                put(family, name)
    return {f: tuple(dict.fromkeys(names)) for f, names in out.items()}


FAMILIES = _families()
# Families that are shown and judged on a log scale.
LOG_FAMILIES = ("RD", "RM", "RS", "TG")


def family_rows() -> list[tuple[str, str, int]]:
    """(family, alias, rank) of every alias."""
    return [(f, a, k) for f, aliases in FAMILIES.items() for k, a in enumerate(aliases)]


def plain_mnemonic(name) -> Column:
    """A mnemonic without case and run suffix."""
    return F.regexp_replace(F.upper(F.col(name) if isinstance(name, str) else name), r"[:_-][0-9]+$", "")


def resolve_family(curves: DataFrame, pins: DataFrame | None = None) -> DataFrame:
    """(well_id, family, curve_id, mnemonic): the best curve of each family in each well. curves: well_id, curve_id, mnemonic,
    unit, cased, n, col_no. Open hole before cased; among those, curves with less than two thirds of the largest count come last;
    then alias order and column. RPM is a resistivity only with an ohm unit or beside RPS or RPD. pins (well_id, family,
    mnemonic) override the choice."""
    spark = curves.sparkSession
    aliases = spark.createDataFrame(family_rows(), "family string, alias string, alias_rank int")
    c = curves.withColumn("alias", plain_mnemonic("mnemonic"))
    phase = F.max(F.when(F.col("alias").isin("RPS", "RPD"), 1).otherwise(0)).over(W.partitionBy("well_id"))
    rotary = (F.col("alias") == "RPM") & ~F.coalesce(F.upper("unit").rlike("OHM"), F.lit(False)) & (phase == 0)
    hit = c.withColumn("_rotary", rotary).where("not _rotary").drop("_rotary").join(F.broadcast(aliases), "alias")
    if pins is not None:
        hit = hit.join(pins.select("well_id", "family", F.col("mnemonic").alias("_pin")), ["well_id", "family"], "left")
    else:
        hit = hit.withColumn("_pin", F.lit(None).cast("string"))
    cased = F.coalesce(F.col("cased"), F.lit(False))
    most = F.max("n").over(W.partitionBy("well_id", "family", cased))
    order = W.partitionBy("well_id", "family").orderBy(F.coalesce(F.col("mnemonic") != F.col("_pin"), F.lit(True)), cased, F.col("_short"), "alias_rank", "col_no")
    ranked = hit.withColumn("_short", F.col("n") * 1.5 < most).withColumn("_k", F.row_number().over(order))
    return ranked.where("_k = 1").select("well_id", "family", "curve_id", "mnemonic", "unit", "n")


def family_of(curves: DataFrame) -> DataFrame:
    """curves with the families that their mnemonics belong to (null for none)."""
    aliases = curves.sparkSession.createDataFrame(family_rows(), "family string, alias string, alias_rank int")
    return curves.withColumn("alias", plain_mnemonic("mnemonic")).join(F.broadcast(aliases.select("family", "alias")), "alias", "left").drop("alias")


def despike(samples: DataFrame, value: str, keys: list[str], window: int = 11, z: float = 6.0, log: bool = False) -> DataFrame:
    """samples with is_spike and <value>_clean: a value more than z scaled median deviations from the median of the rows around
    it becomes that median. At least five values are needed, and a deviation of zero marks nothing."""
    x = F.when(F.col(value) > 0, F.log10(value)) if log else F.col(value)
    line = W.partitionBy(*keys).orderBy("md")
    frame = line.rowsBetween(-max(1, window // 2), max(1, window // 2))
    around = samples.withColumn("_spike_x", x).withColumns({"_spike_v": F.collect_list("_spike_x").over(frame), "_spike_med": F.percentile("_spike_x", F.lit(0.5)).over(frame)})
    away = F.array_sort(F.transform("_spike_v", lambda v: F.abs(v - F.col("_spike_med"))))
    n = F.size("_spike_v")
    half = F.floor(n / 2).cast("int")
    mad = F.when(n % 2 == 1, F.get("_spike_a", half)).otherwise((F.get("_spike_a", half - 1) + F.get("_spike_a", half)) / 2.0)
    spike = F.coalesce((n >= 5) & (F.col("_spike_mad") > 0) & (F.abs(F.col("_spike_x") - F.col("_spike_med")) > z * 1.4826 * F.col("_spike_mad")), F.lit(False))
    median = F.pow(F.lit(10.0), "_spike_med") if log else F.col("_spike_med")
    marked = around.withColumn("_spike_a", away).withColumn("_spike_mad", mad).withColumn("is_spike", spike)
    return marked.select(*samples.columns, "is_spike", F.when(F.col("is_spike"), median).otherwise(F.col(value)).alias(f"{value}_clean"))


def runs(rows: DataFrame, state: Column, keys: list[str], order: str = "md") -> DataFrame:
    """Runs of equal state along the order: keys, state, run_no, n, top, base (first and last position). Nulls form runs too."""
    line = W.partitionBy(*keys).orderBy(order)
    s = rows.withColumn("state", state)
    new = F.when(F.row_number().over(line) == 1, 0).when(F.lag("state").over(line).eqNullSafe(F.col("state")), 0).otherwise(1)
    numbered = s.withColumn("_new", new).withColumn("run_no", F.sum("_new").over(line))
    return numbered.groupBy(*keys, "run_no").agg(F.first("state").alias("state"), F.count("*").alias("n"), F.min(order).alias("top"), F.max(order).alias("base"))


def flag_intervals(rows: DataFrame, flag: Column, keys: list[str], order: str = "md") -> DataFrame:
    """Intervals in which a flag holds (null counts as not)."""
    return runs(rows, F.coalesce(flag, F.lit(False)), keys, order).where("state").select(*keys, "n", "top", "base")


def percentile_norm(samples: DataFrame, value: str, reference: int, low: float = 0.05, high: float = 0.95, least: int = 20) -> DataFrame:
    """(well_id, a, b): value * a + b puts each well's P5 and P95 on those of the reference well. a is rounded to 5 and b to 3
    decimals; wells with too few values or no spread have none."""
    q = samples.where(F.col(value).isNotNull()).groupBy("well_id").agg(F.count(value).alias("n"), F.percentile(value, F.array(F.lit(low), F.lit(high))).alias("q"))
    q = q.where(F.col("n") >= least).select("well_id", F.get("q", F.lit(0)).alias("lo"), F.get("q", F.lit(1)).alias("hi"))
    ref = q.where(F.col("well_id") == reference).select(F.col("lo").alias("rlo"), F.col("hi").alias("rhi"))
    # the reference is one row
    both = q.where("hi > lo").join(F.broadcast(ref), how="inner")
    a = (F.col("rhi") - F.col("rlo")) / (F.col("hi") - F.col("lo"))
    return both.withColumn("_a", a).select("well_id", F.round("_a", 5).alias("a"), F.round(F.col("rlo") - F.col("_a") * F.col("lo"), 3).alias("b"))


def apply_edits(samples: DataFrame, value: str, edits: DataFrame) -> DataFrame:
    """samples with <value>_edited, always from the original: shift (md + offset), then despike, then value * a + b. edits: one row
    per well with offset, despike (boolean), a, b; missing parts change nothing."""
    e = edits.select("well_id", F.col("offset").alias("_off"), F.col("despike").alias("_spk"), F.col("a").alias("_a"), F.col("b").alias("_b"))
    nothing = {"_off": F.lit(0.0), "_spk": F.lit(False), "_a": F.lit(1.0), "_b": F.lit(0.0)}
    line = W.partitionBy("well_id").orderBy("md")
    base = samples.withColumn("_d", F.col("md") - F.lag("md").over(line)).join(e, "well_id", "left").withColumns({c: F.coalesce(c, v) for c, v in nothing.items()}).withColumn("_step", F.median("_d").over(W.partitionBy("well_id")))
    moved = base.select("well_id", (F.col("md") - F.col("_off")).alias("md"), F.col(value).alias("_v"))
    shifted = resample(base, moved, "_v", 3.0 * F.col("_step")).withColumn("_v", F.when(F.col("_off") == 0, F.col(value)).otherwise(F.col("_v")))
    clean = despike(shifted, "_v", ["well_id"])
    out = F.when(F.col("_spk"), F.col("_v_clean")).otherwise(F.col("_v")) * F.col("_a") + F.col("_b")
    return clean.select(*samples.columns, out.alias(f"{value}_edited"))


def median_step(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Median of the positive depth steps."""
    line = W.partitionBy(*keys).orderBy("md")
    d = samples.select(*keys, (F.col("md") - F.lag("md").over(line)).alias("d")).where("d > 1e-9")
    return d.groupBy(*keys).agg(F.median("d").alias("step"))


def merge_grid(samples: DataFrame, most: int | None = None, rows_at_once: int = 1 << 16) -> DataFrame:
    """(well_id, i, md, grid_step): one grid per well over all its files, at the smallest median step; with `most`, doubled until it has at most so many rows. The rows of
    a well are made in stretches, so that a long grid isn't one array."""
    steps = median_step(samples, ["well_id", "file_no"]).groupBy("well_id").agg(F.min("step").alias("step"))
    ends = samples.groupBy("well_id").agg(F.min("md").alias("top"), F.max("md").alias("bot"))
    g = ends.join(steps, "well_id", "left").withColumn("step", F.coalesce("step", F.lit(0.5)))
    over = F.greatest(F.lit(0.0), F.ceil(F.log2((F.col("bot") - F.col("top")) / F.col("step") / most))) if most else F.lit(0.0)
    g = g.withColumn("grid_step", F.col("step") * F.pow(F.lit(2.0), F.when(F.col("bot") > F.col("top"), over).otherwise(0.0)))
    g = g.withColumn("n", F.round((F.col("bot") - F.col("top")) / F.col("grid_step")).cast("long"))
    g = g.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / rows_at_once))))
    g = g.withColumn("i", F.explode(F.sequence(F.col("k") * rows_at_once, F.least(F.col("n"), (F.col("k") + 1) * rows_at_once - 1))))
    return g.select("well_id", "i", F.round(F.col("top") + F.col("i") * F.col("grid_step"), 6).alias("md"), "grid_step")


def merge_runs(samples: DataFrame, files: Iterable[int], lineage: bool = False) -> DataFrame:
    """(well_id, mnemonic, i, md, value): the files of each well on one grid; with lineage also file_no, the file that each value is from. samples: well_id, file_no, mnemonic, unit, md, value.
    A file's curve is spliced into the one of the same name and unit (the earlier file wins) unless they overlap in more
    than max(20, a tenth of the smaller) rows; then it stays beside it as NAME:2, NAME:3. `files` are the file numbers, which are folded in order."""
    files = list(files)
    # every file reads them several times
    samples = written(samples, "runs")
    grid = written(merge_grid(samples), "grid")
    ends = samples.groupBy("well_id", "file_no").agg(F.min("md").alias("_top"), F.max("md").alias("_bot"))
    steps = written(median_step(samples, ["well_id", "file_no"]).join(ends, ["well_id", "file_no"]), "steps")
    base = None
    for k, f in enumerate(files):
        part = samples.where(F.col("file_no") == f)
        curves = part.select("well_id", "mnemonic", unit_key("unit").alias("unit")).distinct()
        gap = F.greatest(3.0 * F.coalesce("step", F.lit(0.0)), 1.5 * F.col("grid_step"))
        # beyond a file's ends there is none of its values
        target = grid.join(steps.where(F.col("file_no") == f).drop("file_no"), "well_id").where((F.col("md") > F.col("_top") - EXACT) & (F.col("md") < F.col("_bot") + EXACT)).drop("_top", "_bot").join(curves, "well_id")
        placed = resample(target.withColumn("_gap", gap), part.select("well_id", "mnemonic", "md", "value"), "value", F.col("_gap"), ("well_id", "mnemonic"))
        new = placed.where("value IS NOT NULL").select("well_id", plain_mnemonic("mnemonic").alias("name"), "unit", F.lit(1).alias("copy"), "i", "md", "value", F.lit(f).alias("file_no"))
        new = written(new, "placed")
        if base is None:
            base = new
            continue
        # the newest copy of a curve is the one that a later file may go on
        newest = base.groupBy("well_id", "name", "unit").agg(F.max("copy").alias("last"))
        old = base.join(newest, ["well_id", "name", "unit"]).where("copy = last").select("well_id", "name", "unit", "i", "last", F.lit(1).alias("there"))
        both = new.drop("copy").join(old, ["well_id", "name", "unit", "i"], "left")
        overlap = both.groupBy("well_id", "name", "unit").agg(F.count("there").alias("overlap"), F.count("*").alias("add"))
        have = old.groupBy("well_id", "name", "unit", "last").agg(F.count("*").alias("have"))
        fate = overlap.join(have, ["well_id", "name", "unit"], "left").select("well_id", "name", "unit", F.when(F.col("have").isNull(), 1).when(F.col("overlap") > F.greatest(F.lit(20.0), 0.1 * F.least("have", "add")), F.col("last") + 1).otherwise(F.col("last")).cast("int").alias("copy"))
        new = new.drop("copy").join(fate, ["well_id", "name", "unit"])
        base = base.unionByName(new.join(base.select("well_id", "name", "unit", "copy", "i"), ["well_id", "name", "unit", "copy", "i"], "left_anti").select(*base.columns))
        if 0 < k < len(files) - 1:  # else the plan of every file holds those of all before it, several times
            base = written(base, "merged")
    # names that differ only in unit or copy are numbered in order
    number = F.dense_rank().over(W.partitionBy("well_id", "name").orderBy("copy", "unit"))
    return base.withColumn("_k", number).select("well_id", F.when(F.col("_k") > 1, F.concat_ws(":", "name", "_k")).otherwise(F.col("name")).alias("mnemonic"), "i", "md", "value", *(["file_no"] if lineage else []))


def provenance(merged: DataFrame) -> DataFrame:
    """(well_id, mnemonic, file_no, first_i, last_i, top, base, n): which file gave which stretch of each curve, from merge_runs() with lineage. A stretch goes on over rows without value."""
    found = runs(merged.withColumn("_at", F.struct("i", "md")), F.col("file_no"), ["well_id", "mnemonic"], "_at")
    return found.select("well_id", "mnemonic", F.col("state").alias("file_no"), F.col("top.i").alias("first_i"), F.col("base.i").alias("last_i"), F.col("top.md").alias("top"), F.col("base.md").alias("base"), "n")


def unmerged(merged: DataFrame, stretches: DataFrame, rows_at_once: int = 4096) -> DataFrame:
    """merged (well_id, mnemonic, i, md, value) taken apart again: with the file_no of the stretch that each value lies in, from provenance(). A range join by blocks of the grid."""
    block = lambda c: F.floor(F.col(c) / rows_at_once)
    s = stretches.select("well_id", "mnemonic", "file_no", "first_i", "last_i", F.explode(F.sequence(block("first_i"), block("last_i"))).alias("_block"))
    return merged.withColumn("_block", block("i")).join(s, ["well_id", "mnemonic", "_block"]).where("i BETWEEN first_i AND last_i").drop("_block", "first_i", "last_i")


def first_filled(parts: DataFrame, fields: list[str]) -> DataFrame:
    """One row per well: each field from its first file that has it."""
    return parts.groupBy("well_id").agg(*[F.min(F.when(F.col(f).isNotNull(), F.struct("file_no", F.col(f).alias("v"))))["v"].alias(f) for f in fields])


def replace_by_key(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new in place of those of the same key."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def stacked(samples: DataFrame, components: list[str]) -> DataFrame:
    """Cumulative start and end of each positive component, in the given order: component, x0, x1."""
    positive = lambda c: F.when(F.col(c) > 0, F.col(c)).otherwise(0.0)
    edges, at = [], F.lit(0.0)
    for c in components:
        edges.append(F.struct(F.lit(c).alias("component"), at.alias("x0"), (at + positive(c)).alias("x1")))
        at = at + positive(c)
    keys = [c for c in samples.columns if c not in components]
    return samples.select(*keys, F.explode(F.array(*edges)).alias("e")).select(*keys, "e.*").where("x1 > x0")


def decimate(samples: DataFrame, most: int, keys: tuple[str, ...] = ("well_id",)) -> DataFrame:
    """Every k-th sample of each group, k such that about `most` stay."""
    line = W.partitionBy(*keys)
    ranked = samples.withColumns({"_k": F.row_number().over(line.orderBy("md")) - 1, "_n": F.count("*").over(line)})
    return ranked.where(F.pmod("_k", F.greatest(F.lit(1), F.floor(F.col("_n") / most))) == 0).drop("_k", "_n")


def moving_mean(value: str, keys: list[str], half: int, order: str = "md") -> Column:
    """Centred mean of the values in 2 half + 1 rows."""
    return F.avg(value).over(W.partitionBy(*keys).orderBy(order).rowsBetween(-half, half))


def largest_step(samples: DataFrame, value: str, half: int, low: float, high: float, rising: bool = True) -> DataFrame:
    """(well_id, md, step): where, inside [low, high], the mean of the rows below exceeds that of the rows above the most."""
    line = W.partitionBy("well_id").orderBy("md")
    step = F.avg(value).over(line.rowsBetween(0, half - 1)) - F.avg(value).over(line.rowsBetween(-half, -1))
    s = samples.withColumn("_s", step if rising else -step).where(F.col("md").between(low, high) & F.col("_s").isNotNull())
    best = s.groupBy("well_id").agg(F.max(F.struct(F.col("_s"), (-F.col("md")).alias("_m"))).alias("b"))
    return best.select("well_id", (-F.col("b._m")).alias("md"), F.col("b._s").alias("step"))


def rule_tops(samples: DataFrame, rules: list[dict]) -> DataFrame:
    """(well_id, name, md) from rules: {"name", "kind": "step" or "first", "value", "half", "low", "high", "rising"} or {..., "above": x},
    the first depth at which the smoothed value passes x."""
    out = None
    for r in rules:
        if r["kind"] == "step":
            found = largest_step(samples, r["value"], r["half"], r["low"], r["high"], r.get("rising", True))
        else:
            smooth = samples.withColumn("_v", moving_mean(r["value"], ["well_id"], r["half"]))
            found = smooth.where(F.col("md").between(r["low"], r["high"])).groupBy("well_id").agg(F.min(F.when(F.col("_v") > r["above"], F.col("md"))).alias("md")).where("md IS NOT NULL")
        found = found.select("well_id", F.lit(r["name"]).alias("name"), "md")
        out = found if out is None else out.unionByName(found)
    return out


def crossplot_rows(samples: DataFrame, x: str, y: str, log_x: bool = False, log_y: bool = False, clean: Column | None = None) -> DataFrame:
    """Rows with both values, above zero on log axes and, where asked, in clean rock (a condition; null doesn't pass)."""
    ok = F.col(x).isNotNull() & F.col(y).isNotNull()
    for name, log in ((x, log_x), (y, log_y)):
        ok = ok & (F.col(name) > 0) if log else ok
    return samples.where(ok if clean is None else ok & F.coalesce(clean, F.lit(False)))
