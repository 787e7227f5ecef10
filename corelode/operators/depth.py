"""Depth-ordered joins: as-of carries, nearest pairs, resampling, directional surveys and depth frames.

The core shape is union and carry: rows of both sides go through one shuffle by well and one sort by depth, and
windows carry the previous and next row of the other side to each (the next one over the descending order). No range
join and no per-well Python is needed, and several results over the same window specification share its sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import EARTH_RADIUS_M

EXACT = 1e-6


def carry(left: DataFrame, right: DataFrame, values: list[str], keys: list[str], on: str = "md", sides: tuple[str, ...] = ("prev", "next")) -> DataFrame:
    """left with, for each of `values` (and `on`) of right, prev_<name> (last right row at or above the left row's
    depth) and next_<name> (first at or below). Rows of right at equal depth count on both sides; a null depth finds nothing."""
    rest = [c for c in left.columns if c not in (*keys, on)]
    packed = F.struct(F.col(on).alias(on), *[F.col(v).alias(v) for v in values])
    a = left.select(*keys, on, F.struct(*rest).alias("_left") if rest else F.lit(1).alias("_left"), F.lit(None).alias("_right"))
    b = right.where(F.col(on).isNotNull()).select(*keys, on, F.lit(None).alias("_left"), packed.alias("_right"))
    both = a.unionByName(b)
    well = W.partitionBy(*keys)
    # RANGE frames include rows at the same depth; both run from the start of their order, so that a row adds to what is
    # there (frames to the end are computed anew for each row)
    frames = {
        "prev": F.last("_right", ignorenulls=True).over(well.orderBy(F.col(on).asc_nulls_last()).rangeBetween(W.unboundedPreceding, W.currentRow)),
        "next": F.last("_right", ignorenulls=True).over(well.orderBy(F.col(on).desc_nulls_last()).rangeBetween(W.unboundedPreceding, W.currentRow)),
    }
    for s in sides:
        both = both.withColumn(f"_{s}", F.when(F.col(on).isNotNull(), frames[s]))
    out = [F.col(f"_{s}")[v].alias(f"{s}_{v}") for s in sides for v in (on, *values)]
    kept = [F.col("_left")[c].alias(c) for c in rest]
    return both.where(F.col("_left").isNotNull()).select(*keys, on, *kept, *out)


def zone_at(samples: DataFrame, zones: DataFrame, keep_last: bool = False) -> DataFrame:
    """samples with the zone [top, base) that holds them; with keep_last, samples at or below the last base get the last zone."""
    marks = zones.select("well_id", F.col("top").alias("md"), "zone", "base", "zone_no")
    found = carry(samples, marks, ["zone", "base", "zone_no"], ["well_id"], sides=("prev",))
    inside = F.lit(True) if keep_last else F.col("md") < F.col("prev_base")
    return found.select(*samples.columns, F.when(inside, F.col("prev_zone")).alias("zone"), F.when(inside, F.col("prev_zone_no")).alias("zone_no"), F.when(inside, F.col("prev_md")).alias("zone_top"))


def nearest(left: DataFrame, right: DataFrame, values: list[str], tolerance: float, keys: tuple[str, ...] = ("well_id",)) -> DataFrame:
    """left with near_md and near_<value>: the right row nearest in depth within the tolerance; of two as near, the deeper."""
    found = carry(left, right, values, list(keys))
    up, down = F.col("md") - F.col("prev_md"), F.col("next_md") - F.col("md")
    deeper = F.col("prev_md").isNull() | (F.round(down - up, 9) <= 0)
    ok = F.when(deeper, down).otherwise(up) <= tolerance
    pick = lambda v: F.when(ok, F.when(deeper, F.col(f"next_{v}")).otherwise(F.col(f"prev_{v}"))).alias(f"near_{v}")
    return found.select(*left.columns, pick("md"), *[pick(v) for v in values])


def resample(grid: DataFrame, samples: DataFrame, value: str, max_gap, keys: tuple[str, ...] = ("well_id",)) -> DataFrame:
    """The grid's rows with the value interpolated between its neighbours: a sample within 1e-6 is taken as it is, beyond
    the ends and across gaps over max_gap (a number or a Column of the grid) there is none, and between a value and a missing one the nearer counts."""
    found = carry(grid, samples, [value], list(keys))
    gap = max_gap if isinstance(max_gap, Column) else F.lit(float(max_gap))
    span = F.col("next_md") - F.col("prev_md")
    t = (F.col("md") - F.col("prev_md")) / span
    a, b = F.col(f"prev_{value}"), F.col(f"next_{value}")
    mixed = F.when(span <= gap, F.when(a.isNotNull() & b.isNotNull(), a + t * (b - a)).when(t < 0.5, a).otherwise(b))
    out = F.when(F.abs(F.col("md") - F.col("prev_md")) < EXACT, a).when(F.abs(F.col("next_md") - F.col("md")) < EXACT, b).otherwise(mixed)
    return found.select(*grid.columns, out.alias(value))


def shift(samples: DataFrame, value: str, offset, step) -> DataFrame:
    """The curve moved from bit depth to sensor depth by its offset, on the same depths."""
    moved = samples.select("well_id", (F.col("md") - offset).alias("md"), value)
    return resample(samples.drop(value), moved, value, F.lit(3.0) * step if isinstance(step, Column) else 3.0 * step)


def minimum_curvature(stations: DataFrame) -> DataFrame:
    """stations (well_id, md, inc, azi in degrees) with tvd, north, east and dls (degrees per 100). The first station is reached
    straight along its own direction. Of stations at one depth the first stays."""
    line = W.partitionBy("well_id").orderBy("md")
    one = stations.withColumn("_n", F.row_number().over(W.partitionBy("well_id", "md").orderBy("inc", "azi"))).where("_n = 1").drop("_n")
    r = one.withColumns({"_i": F.radians("inc"), "_a": F.radians("azi")}).withColumns({"_i0": F.lag("_i").over(line), "_a0": F.lag("_a").over(line), "_m0": F.lag("md").over(line)})
    i1, i2, a1, a2 = (F.col(c) for c in ("_i0", "_i", "_a0", "_a"))
    cosine = F.cos(i2 - i1) - F.sin(i1) * F.sin(i2) * (1.0 - F.cos(a2 - a1))
    bend = F.acos(F.when(cosine.isNotNull(), F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0))))
    half = (F.col("md") - F.col("_m0")) / 2.0 * F.when(bend > 1e-9, 2.0 / bend * F.tan(bend / 2.0)).otherwise(1.0)
    first = F.col("_m0").isNull()
    straight = F.col("md") * F.sin(i2)
    parts = r.withColumns({
        "_t": F.when(first, F.col("md") * F.cos(i2)).otherwise(half * (F.cos(i1) + F.cos(i2))),
        "_n": F.when(first, straight * F.cos(a2)).otherwise(half * (F.sin(i1) * F.cos(a1) + F.sin(i2) * F.cos(a2))),
        "_e": F.when(first, straight * F.sin(a2)).otherwise(half * (F.sin(i1) * F.sin(a1) + F.sin(i2) * F.sin(a2))),
        "dls": F.when(first, 0.0).otherwise(F.degrees(bend) * 100.0 / (F.col("md") - F.col("_m0"))),
    })
    run = line.rowsBetween(W.unboundedPreceding, 0)
    return parts.select(*stations.columns, F.sum("_t").over(run).alias("tvd"), F.sum("_n").over(run).alias("north"), F.sum("_e").over(run).alias("east"), "dls")


def survey_difference(recomputed: DataFrame, given: DataFrame) -> DataFrame:
    """Largest disagreement of recomputed and given tvd per well."""
    g = given.select("well_id", "md", F.col("tvd").alias("given_tvd"))
    return recomputed.join(g, ["well_id", "md"]).groupBy("well_id").agg(F.max(F.abs(F.col("tvd") - F.col("given_tvd"))).alias("max_difference"))


def inclination_from_positions(stations: DataFrame) -> DataFrame:
    """inc and azi from md, tvd, north and east of consecutive stations; null where the step can't be one. Offsets of more than 1e5 are
    grid coordinates; only their differences count, as for any others."""
    line = W.partitionBy("well_id").orderBy("md")
    d = {c: F.col(c) - F.lag(c).over(line) for c in ("md", "tvd", "north", "east")}
    ratio = F.when(d["md"] > 0, d["tvd"] / d["md"])
    return stations.withColumns({
        "inc": F.degrees(F.acos(F.when(ratio.isNotNull(), F.least(F.greatest(ratio, F.lit(-1.0)), F.lit(1.0))))),
        "azi": F.pmod(F.degrees(F.atan2(d["east"], d["north"])), F.lit(360.0)),
    })


def along_survey(depths: DataFrame, survey: DataFrame) -> DataFrame:
    """depths (well_id, md) with tvd, north and east at md: linear between stations, below the last along its direction; above the
    first, tvd runs parallel to depth and the offsets shrink in proportion to md. Null without a survey."""
    values = ["tvd", "north", "east", "inc", "azi"]
    found = carry(depths, survey, values, ["well_id"])
    span = F.col("next_md") - F.col("prev_md")
    t = F.when(span > 0, (F.col("md") - F.col("prev_md")) / span).otherwise(0.0)
    between = lambda c: F.col(f"prev_{c}") + t * (F.col(f"next_{c}") - F.col(f"prev_{c}"))
    beyond, inc, azi = F.col("md") - F.col("prev_md"), F.radians("prev_inc"), F.radians("prev_azi")
    above, below = F.col("prev_md").isNull(), F.col("next_md").isNull()
    scale = F.when(F.col("next_md") > 0, F.col("md") / F.col("next_md")).otherwise(0.0)
    pick = lambda c, up, down: F.when(above, up).when(below, F.col(f"prev_{c}") + beyond * down).otherwise(between(c)).alias(c)
    return found.select(
        *depths.columns,
        pick("tvd", F.col("next_tvd") - (F.col("next_md") - F.col("md")), F.cos(inc)),
        pick("north", F.col("next_north") * scale, F.sin(inc) * F.cos(azi)),
        pick("east", F.col("next_east") * scale, F.sin(inc) * F.sin(azi)),
    )


def depth_from_tvd(targets: DataFrame, survey: DataFrame) -> DataFrame:
    """targets (well_id, tvd) with md: the first bracket of stations in which tvd increases past the target; above the first
    station parallel to it, below the last along its direction (cosine not under 0.05); null where neither reaches it.

    The first bracket that reaches a depth is one that raises the running maximum of tvd, and those are in the order of their tvd: a target takes
    the first at or below it by one carry, whatever the number of stations."""
    line = W.partitionBy("well_id").orderBy("md")
    above = F.max("tvd").over(line.rowsBetween(W.unboundedPreceding, -1))
    steps = survey.select(
        "well_id",
        F.lag("md").over(line).alias("m1"),
        F.lag("tvd").over(line).alias("t1"),
        F.col("md").alias("m2"),
        F.col("tvd"),
        above.alias("_above"),
    )
    rising = steps.where("_above IS NULL OR tvd > _above").drop("_above")
    end = survey.groupBy("well_id").agg(F.max_by(F.struct("md", "tvd", F.greatest(F.cos(F.radians("inc")), F.lit(0.05)).alias("slope")), "md").alias("_end"))
    found = carry(targets, rising, ["m1", "t1", "m2"], ["well_id"], on="tvd", sides=("next",)).join(end, "well_id", "left")
    z, t2 = F.col("tvd"), F.col("next_tvd")
    inside = F.when(F.col("next_m1").isNull(), F.col("next_m2") - (t2 - z)).otherwise(F.col("next_m1") + (z - F.col("next_t1")) / (t2 - F.col("next_t1")) * (F.col("next_m2") - F.col("next_m1")))
    below = F.when(z > F.col("_end.tvd"), F.col("_end.md") + (z - F.col("_end.tvd")) / F.col("_end.slope"))
    return found.select(*targets.columns, F.when(F.col("next_m2").isNotNull(), inside).otherwise(below).alias("md"))


def subsea(tvd, datum) -> Column:
    """Depth below sea level, positive downwards."""
    return F.col(tvd) - F.col(datum)


def flattened(depths: DataFrame, tops: DataFrame, name: str, z: str = "md") -> DataFrame:
    """depths with flat_z: the frame's depth against that of a top; wells without it fall back to md, with a note."""
    top = tops.where(F.col("name") == name).groupBy("well_id").agg(F.min(z).alias("_top"))
    joined = depths.join(top, "well_id", "left")
    return joined.select(*depths.columns, F.coalesce(F.col(z) - F.col("_top"), F.col("md")).alias("flat_z"), F.when(F.col("_top").isNull(), F.lit("no such top: measured depth")).alias("note"))


def frame_parameters(modes: DataFrame, wells: DataFrame, tops: DataFrame, survey: DataFrame | None = None) -> DataFrame:
    """(well_id, kind, surveyed, offset, note): how depths of a well are shown. modes: well_id and mode, which is MD, GL, TVDSS or the name of a top; wells: kb and gl. A frame is a vertical
    depth less an offset: the KB above ground for GL (nothing, where only the ground is known: depths count from there), the datum for TVDSS, the top's own vertical depth to flatten
    on it. Where what a frame asks for is missing, the well falls back to MD, and the note says why."""
    first = tops.groupBy("well_id", F.col("name").alias("mode")).agg(F.min("md").alias("md"))
    asked = first.join(modes, ["well_id", "mode"])
    if survey is None:
        placed, with_survey = asked.withColumn("tvd", F.col("md")), modes.select("well_id").limit(0)
    else:
        placed, with_survey = along_survey(asked, survey).withColumn("tvd", F.coalesce("tvd", "md")), survey.select("well_id").distinct()
    m = modes.join(wells.select("well_id", "kb", "gl"), "well_id", "left").join(placed.select("well_id", "mode", F.col("tvd").alias("_top")), ["well_id", "mode"], "left").join(with_survey.withColumn("_s", F.lit(True)), "well_id", "left")
    mode, kb, gl = F.col("mode"), F.col("kb"), F.col("gl")
    offset = F.when(mode == "GL", F.when(gl.isNotNull(), F.coalesce(kb - gl, F.lit(0.0)))).when(mode == "TVDSS", F.coalesce(kb, gl)).when(mode != "MD", F.col("_top"))
    kind = F.when(offset.isNull(), "MD").when(mode.isin("GL", "TVDSS"), mode).otherwise("FLAT")
    missing = F.when(mode == "GL", F.when(kb.isNull(), "no elevation").otherwise("no ground level")).when(mode == "TVDSS", "no elevation").when(mode != "MD", F.concat(F.lit("no top "), mode))
    from_ground = F.when(mode.isin("GL", "TVDSS") & kb.isNull(), "from ground level")
    surveyed = F.coalesce("_s", F.lit(False)) & (kind != "MD")
    note = F.when(kind == "MD", missing).otherwise(F.nullif(F.concat_ws(", ", from_ground, F.when(surveyed, "vertical by survey")), F.lit("")))
    return m.select("well_id", kind.alias("kind"), surveyed.alias("surveyed"), F.coalesce(offset, F.lit(0.0)).alias("offset"), note.alias("note"))


def framed(depths: DataFrame, parameters: DataFrame, survey: DataFrame | None = None) -> DataFrame:
    """depths (well_id, md) with z, kind and note, by frame_parameters()."""
    placed = depths.withColumn("tvd", F.lit(None).cast("double")) if survey is None else along_survey(depths, survey).drop("north", "east")
    # one row a well
    j = placed.join(parameters, "well_id")
    return j.select(*depths.columns, (F.when(F.col("surveyed"), F.col("tvd")).otherwise(F.col("md")) - F.col("offset")).alias("z"), "kind", "note")


def depth_from_frame(targets: DataFrame, frame: DataFrame, z: str = "z") -> DataFrame:
    """targets (well_id, z) with md: the first crossing of z along the hole; the ends of the log beyond it. As in
    depth_from_tvd, the samples that raise the running maximum of z decide, by one carry."""
    line = W.partitionBy("well_id").orderBy("md")
    steps = frame.where(F.col(z).isNotNull()).select("well_id", F.lag("md").over(line).alias("m1"), F.lag(z).over(line).alias("z1"), F.col("md").alias("m2"), F.col(z), F.max(z).over(line.rowsBetween(W.unboundedPreceding, -1)).alias("_above"))
    rising = steps.where(F.col("_above").isNull() | (F.col(z) > F.col("_above"))).drop("_above")
    end = frame.groupBy("well_id").agg(F.max("md").alias("_end"))
    found = carry(targets, rising, ["m1", "z1", "m2"], ["well_id"], on=z, sides=("next",)).join(end, "well_id")
    crossing = F.col("next_m1") + (F.col(z) - F.col("next_z1")) / (F.col(f"next_{z}") - F.col("next_z1")) * (F.col("next_m2") - F.col("next_m1"))
    hit = F.when(F.col("next_m1").isNull(), F.col("next_m2")).otherwise(crossing)
    return found.select(*targets.columns, F.coalesce(hit, F.when(F.col(z).isNotNull(), F.col("_end"))).alias("md"))


def survey_summary(survey: DataFrame) -> DataFrame:
    """Stations, depth range, largest inclination and horizontal displacement of the last station, per well."""
    return survey.groupBy("well_id").agg(
        F.count("*").alias("stations"),
        F.min("md").alias("top_md"),
        F.max("md").alias("base_md"),
        F.max("inc").alias("max_inc"),
        F.max_by(F.hypot("north", "east"), "md").alias("displacement"),
    )


def event_at(depths: DataFrame, events: DataFrame, tolerance: float = 0.0, bin_size: float = 100.0) -> DataFrame:
    """depths joined to the events (top_md, base_md, class) that contain them. Both sides are put in depth bins, so the
    join is an equi-join on (well, bin) whatever the number of events."""
    low, high = F.col("top_md") - tolerance, F.coalesce("base_md", "top_md") + tolerance
    e = events.withColumn("_bin", F.explode(F.sequence(F.floor(low / bin_size), F.floor(high / bin_size)))).withColumns({"_low": low, "_high": high})
    d = depths.withColumn("_bin", F.floor(F.col("md") / bin_size))
    return d.join(e, ["well_id", "_bin"]).where(F.col("md").between(F.col("_low"), F.col("_high"))).drop("_bin", "_low", "_high")


def tvd_stations(curve: DataFrame, most: int | None = None) -> DataFrame:
    """Stations from a TVD curve, with the inclination of each step; only where it is shallower than md. `most`: every k-th sample, so that a well has about so many."""
    line, well = W.partitionBy("well_id").orderBy("md"), W.partitionBy("well_id")
    rows = curve.where("tvd IS NOT NULL").withColumns({"_k": F.row_number().over(line) - 1, "_n": F.count("*").over(well), "_off": F.max(F.col("md") - F.col("tvd")).over(well)})
    some = rows.where("_off > 0.5").where(F.pmod("_k", F.greatest(F.lit(1), F.ceil(F.col("_n") / most))) == 0 if most else F.lit(True))
    ratio = (F.lead("tvd").over(line) - F.col("tvd")) / (F.lead("md").over(line) - F.col("md"))
    back = (F.col("tvd") - F.lag("tvd").over(line)) / (F.col("md") - F.lag("md").over(line))
    r = F.coalesce(ratio, back)
    return some.select("well_id", "md", F.degrees(F.acos(F.when(r.isNotNull(), F.least(F.greatest(r, F.lit(-1.0)), F.lit(1.0))))).alias("inc"), "tvd")


def path_positions(offsets: DataFrame, wells: DataFrame, metres_per_unit: float = 0.3048) -> DataFrame:
    """offsets (well_id, md, north, east) with lat and lon along the path from each well's surface position."""
    turn = F.degrees(F.lit(metres_per_unit) / EARTH_RADIUS_M)
    w = wells.select("well_id", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    return offsets.join(w, "well_id").select(*offsets.columns, (F.col("_lat") + F.col("north") * turn).alias("lat"), (F.col("_lon") + F.col("east") * turn / F.cos(F.radians("_lat"))).alias("lon"))
