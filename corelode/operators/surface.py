"""Maps: control points, thin-plate surfaces, grids, contours, and neighbours in a section."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import LATITUDE_M, LONGITUDE_M, haversine_km, nice_step
from ..sources.store import written
from .order import ranked, with_next
from .proximity import merge_close

SMOOTHING, CLOSE_M, MARGIN, LEAST_MARGIN, CELLS = 1e-4, 15.0, 0.15, 200.0, 160
#: Control points that one surface may have: the solve is cubic in them.
MOST_POINTS = 2000
#: Grid edges along the side of a tile in which one task links the segments of a level.
TILE = 256


def on_plane(points: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """points with x, y in metres about the mean position (of each group)."""
    centre = points.groupBy(*keys).agg(F.avg("lat").alias("_lat0"), F.avg("lon").alias("_lon0"))
    # without keys the centre is one row
    both = points.join(centre, list(keys)) if keys else points.crossJoin(F.broadcast(centre))
    return both.select(*points.columns, ((F.col("lon") - F.col("_lon0")) * LONGITUDE_M * F.cos(F.radians("_lat0"))).alias("x"), ((F.col("lat") - F.col("_lat0")) * LATITUDE_M).alias("y"))


def isochore(wells: DataFrame, tops: DataFrame, upper: str, lower: str, tvd: str = "md") -> DataFrame:
    """wells with v, the true vertical thickness from one top to another, and reason where there is none."""
    top = lambda n: tops.where(F.col("name") == n).groupBy("well_id").agg(F.min(tvd))
    a, b = top(upper).toDF("well_id", "_a"), top(lower).toDF("well_id", "_b")
    j = wells.join(a, "well_id", "left").join(b, "well_id", "left")
    reason = F.when(F.col("_a").isNull(), F.concat(F.lit("no "), F.lit(upper))).when(F.col("_b").isNull(), F.concat(F.lit("no "), F.lit(lower))).when(F.col("_b") < F.col("_a"), "base above top").when(F.col("lat").isNull() | F.col("lon").isNull(), "no location")
    return j.select(*wells.columns, F.when(reason.isNull(), F.col("_b") - F.col("_a")).alias("v"), reason.alias("reason"))


def structure(wells: DataFrame, tops: DataFrame, name: str, tvd: str = "md") -> DataFrame:
    """wells with v, the subsea depth of a top (positive down), and reason where there is none."""
    t = tops.where(F.col("name") == name).groupBy("well_id").agg(F.min(tvd).alias("_t"))
    reason = F.when(F.col("_t").isNull(), F.concat(F.lit("no "), F.lit(name))).when(F.col("kb").isNull(), "no datum elevation").when(F.col("lat").isNull() | F.col("lon").isNull(), "no location")
    return wells.join(t, "well_id", "left").select(*wells.columns, F.when(reason.isNull(), F.col("_t") - F.col("kb")).alias("v"), reason.alias("reason"))


def convex_hull(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Counterclockwise hull vertices, by the monotone chain."""
    points = sorted(set(zip(x.tolist(), y.tolist(), strict=True)))
    if len(points) < 3:
        return np.array(points)

    def chain(ps):
        out: list[tuple[float, float]] = []
        for p in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(points) + chain(points[::-1]))


def hull_area(hull: np.ndarray) -> float:
    if len(hull) < 3:
        return 0.0
    x, y = hull[:, 0], hull[:, 1]
    return float(abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2)


def _basis(r2: np.ndarray) -> np.ndarray:
    return np.where(r2 > 0, r2 * np.log(np.where(r2 > 0, r2, 1)), 0.0)


FIT = "surface_id long, reason string, x0 double, y0 double, scale double, c0 double, c1 double, c2 double, px array<double>, py array<double>, w array<double>, hx array<double>, hy array<double>, pad double, cell double, nx int, ny int"


def hulls(points: DataFrame, share: int = 100_000) -> DataFrame:
    """(surface_id, hx, hy): the convex hull of each surface's points, counterclockwise. Hulls of shares of the points come first, then the hull of those."""

    def outer(pdf: pd.DataFrame) -> pd.DataFrame:
        h = convex_hull(pdf.x.to_numpy(float), pdf.y.to_numpy(float))
        return pd.DataFrame({"surface_id": pdf.surface_id.iloc[0], "x": h[:, 0], "y": h[:, 1]})

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        h = convex_hull(pdf.x.to_numpy(float), pdf.y.to_numpy(float))
        return pd.DataFrame([{"surface_id": pdf.surface_id.iloc[0], "hx": h[:, 0].tolist(), "hy": h[:, 1].tolist()}])

    # of the points in one place, of one column and of one row only the ends can be corners
    ends = points.groupBy("surface_id", "x").agg(F.min("y").alias("a"), F.max("y").alias("b")).select("surface_id", "x", F.explode(F.array("a", "b")).alias("y")).distinct()
    sizes = ends.groupBy("surface_id").agg(F.ceil(F.count("*") / share).alias("shares"))
    dealt = ends.join(sizes, "surface_id").withColumn("share", F.pmod(F.xxhash64("x", "y"), F.col("shares"))).select("surface_id", "share", "x", "y")
    parts = dealt.groupBy("surface_id", "share").applyInPandas(outer, "surface_id long, x double, y double")
    return parts.groupBy("surface_id").applyInPandas(whole, "surface_id long, hx array<double>, hy array<double>")


def fit_surfaces(points: DataFrame, cells: int = CELLS, smoothing: float = SMOOTHING) -> DataFrame:
    """One row per surface_id of points (surface_id, point_id, x, y, v): a thin-plate spline (Duchon 1977) in scaled coordinates, its hull and
    grid; or the reason why there is none (too few, too many or collinear points, singular system). Points closer than CLOSE_M share the first one's place and their mean
    value. Merging, hull and grid are joins and aggregations; the dense solve of one surface is one task's work, all surfaces in parallel."""
    merged = written(merge_close(points.select("surface_id", "point_id", "x", "y", "v"), CLOSE_M), "merged")
    facts = merged.groupBy("surface_id").agg(
        F.count("*").alias("n"), F.avg("x").alias("x0"), F.avg("y").alias("y0"), (F.max("x") - F.min("x")).alias("dx"), (F.max("y") - F.min("y")).alias("dy"), F.min("x").alias("x_low"), F.min("y").alias("y_low")
    )
    size = F.greatest("dx", "dy")
    hull = hulls(merged)
    turned = F.zip_with("hx", F.concat(F.slice("hy", 2, F.greatest(F.size("hy") - 1, F.lit(0))), F.slice("hy", 1, 1)), lambda a, b: a * b)
    back = F.zip_with("hy", F.concat(F.slice("hx", 2, F.greatest(F.size("hx") - 1, F.lit(0))), F.slice("hx", 1, 1)), lambda a, b: a * b)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v)
    area = (total(turned) - total(back)) / 2
    known = points.select("surface_id").distinct().join(facts, "surface_id", "left").join(hull, "surface_id", "left")
    reason = F.when(F.coalesce("n", F.lit(0)) < 3, "fewer than three control points").when(F.col("n") > MOST_POINTS, f"more than {MOST_POINTS} control points").when((F.size("hx") < 3) | (area < 0.002 * size * size), "control points lie on a line")
    known = written(known.withColumns({"reason": reason, "scale": size}), "surfaces")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("point_id")
        x, y, v = (pdf[c].to_numpy(float) for c in "xyv")
        x0, y0, size, n = pdf.x0.iloc[0], pdf.y0.iloc[0], pdf.scale.iloc[0], len(pdf)
        px, py = (x - x0) / size, (y - y0) / size
        m = np.zeros((n + 3, n + 3))
        m[:n, :n] = _basis((px[:, None] - px) ** 2 + (py[:, None] - py) ** 2) + smoothing * np.eye(n)
        m[:n, n:] = np.column_stack([np.ones(n), px, py])
        m[n:, :n] = m[:n, n:].T
        row = {"surface_id": pdf.surface_id.iloc[0], "px": px.tolist(), "py": py.tolist()}
        try:
            s = np.linalg.solve(m, np.concatenate([v, np.zeros(3)]))
        except np.linalg.LinAlgError:
            return pd.DataFrame([row | {"w": None, "c0": None, "c1": None, "c2": None}])
        return pd.DataFrame([row | {"w": s[:n].tolist(), "c0": s[n], "c1": s[n + 1], "c2": s[n + 2]}])

    ready = merged.join(known.where("reason IS NULL").select("surface_id", "x0", "y0", "scale"), "surface_id")
    solved = ready.groupBy("surface_id").applyInPandas(fit, "surface_id long, px array<double>, py array<double>, w array<double>, c0 double, c1 double, c2 double")
    pad = F.greatest(F.lit(LEAST_MARGIN), MARGIN * F.col("scale"))
    out = known.join(solved, "surface_id", "left").withColumn("reason", F.coalesce("reason", F.when(F.col("w").isNull(), "singular system"))).withColumn("pad", pad).withColumn("cell", (F.col("scale") + 2 * F.col("pad")) / cells)
    count = lambda d: (F.ceil((F.col(d) + 2 * F.col("pad")) / F.col("cell")) + 1).cast("int")
    fine = F.col("reason").isNull()
    out = out.withColumns({"nx": count("dx"), "ny": count("dy")})
    return out.select(*[(F.col(c) if c in ("surface_id", "reason") else F.when(fine, F.col(c))).cast(t).alias(c) for c, t in (x.split() for x in FIT.split(", "))])


def evaluate(fits: DataFrame, rows_at_once: int = 16, points_at_once: int = 512) -> DataFrame:
    """(surface_id, i, j, x, y, z): the grid of each surface, z null outside the hull and its margin. A product in blocks: each band of grid rows meets
    each block of control points in a task of its own choosing, and their shares of z are summed up, so neither a large grid nor many points are one task's work."""
    good = fits.where("reason IS NULL")
    corner = good.select("surface_id", "x0", "y0", "scale", "c0", "c1", "c2", "hx", "hy", "pad", "cell", "nx", "ny", F.array_min("hx").alias("x_low"), F.array_min("hy").alias("y_low"))
    bands = corner.withColumn("band", F.explode(F.sequence(F.lit(0), F.floor((F.col("ny") - 1) / rows_at_once).cast("int"))))
    part = lambda c: F.slice(c, F.col("block") * points_at_once + 1, points_at_once).alias(c)
    blocks = good.withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.size("px") - 1) / points_at_once).cast("int")))).select("surface_id", "block", part("px"), part("py"), part("w"))
    pairs = bands.join(blocks, "surface_id").repartition("surface_id", "band", "block")

    def shares(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                j = np.arange(r.band * rows_at_once, min((r.band + 1) * rows_at_once, r.ny))
                i, j = (a.ravel() for a in np.meshgrid(np.arange(r.nx), j))
                x, y = r.x_low - r.pad + i * r.cell, r.y_low - r.pad + j * r.cell
                sx, sy, px, py, w = (x - r.x0) / r.scale, (y - r.y0) / r.scale, np.array(r.px), np.array(r.py), np.array(r.w)
                z = _basis((sx[:, None] - px) ** 2 + (sy[:, None] - py) ** 2) @ w
                inside = np.ones(len(z), bool)
                if r.block == 0:  # the plane, and the margin, whose edge is inside
                    z = z + r.c0 + r.c1 * sx + r.c2 * sy
                    inside = hull_distance(x, y, np.array(r.hx), np.array(r.hy)) <= r.pad * (1 + 1e-12)
                yield pd.DataFrame({"surface_id": r.surface_id, "i": i.astype(np.int32), "j": j.astype(np.int32), "x": x, "y": y, "z": z, "inside": inside})

    cells = pairs.mapInPandas(shares, "surface_id long, i int, j int, x double, y double, z double, inside boolean").groupBy("surface_id", "i", "j", "x", "y")
    return cells.agg(F.sum("z").alias("z"), F.min("inside").alias("inside")).withColumn("z", F.when(F.col("inside"), F.col("z"))).drop("inside")


def hull_distance(x: np.ndarray, y: np.ndarray, hx: np.ndarray, hy: np.ndarray) -> np.ndarray:
    """Distance to a convex counterclockwise hull, 0 inside."""
    out, inside = np.full(len(x), np.inf), np.ones(len(x), bool)
    for ax, ay, bx, by in zip(hx, hy, np.roll(hx, -1), np.roll(hy, -1), strict=True):
        dx, dy = bx - ax, by - ay
        inside &= dx * (y - ay) - dy * (x - ax) >= 0
        t = np.clip(((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy), 0, 1)
        out = np.minimum(out, np.hypot(x - ax - t * dx, y - ay - t * dy))
    return np.where(inside, 0.0, out)


def contour_steps(cells: DataFrame, about: int = 10) -> DataFrame:
    """(surface_id, step): a round interval for about so many levels."""
    ends = cells.groupBy("surface_id").agg(F.min("z").alias("lo"), F.max("z").alias("hi")).where("hi > lo")
    return ends.select("surface_id", nice_step(F.col("hi") - F.col("lo"), about).alias("step"))


def contour_levels(cells: DataFrame, about: int = 10) -> DataFrame:
    """(surface_id, level) at a round interval."""
    ends = cells.groupBy("surface_id").agg(F.min("z").alias("lo"), F.max("z").alias("hi"))
    step = ends.join(contour_steps(cells, about), "surface_id")
    first, last = F.ceil(F.col("lo") / F.col("step")), F.floor(F.col("hi") / F.col("step"))
    return step.where(last >= first).select("surface_id", "step", F.explode(F.sequence(first, last)).alias("k")).select("surface_id", (F.col("k") * F.col("step")).alias("level"))


def contour_segments(cells: DataFrame, steps: DataFrame) -> DataFrame:
    """(surface_id, level, a, b, x1, y1, x2, y2): segments in which the multiples of each surface's step cross the two triangles of every full grid cell, from the grid
    edge a to b (three numbers each), with the higher ground to the left. Levels are made from each triangle's own lowest and highest corner, so there is nothing to join but the step. A
    corner on a level counts as above it."""
    corner = F.struct("x", "y", "z", "i", "j")
    row, column = W.partitionBy("surface_id", "j").orderBy("i"), W.partitionBy("surface_id", "i").orderBy("j")
    c = cells.withColumn("p", corner).withColumn("right", F.lead("p").over(row))
    c = c.withColumns({"up": F.lead("p").over(column), "diagonal": F.lead("right").over(column)}).where("p.z IS NOT NULL AND right.z IS NOT NULL AND up.z IS NOT NULL AND diagonal.z IS NOT NULL")
    both = F.array(*[F.struct(F.col("p").alias("c0"), F.col(a).alias("c1"), F.col(b).alias("c2")) for a, b in (("right", "diagonal"), ("diagonal", "up"))])  # both counterclockwise
    t = c.join(steps, "surface_id").select("surface_id", "step", F.explode(both).alias("t")).select("surface_id", "step", *[F.col(f"t.c{k}.{v}").alias(f"{v}{k}") for k in range(3) for v in "xyzij"])
    t = t.withColumns({"first": F.floor(F.least("z0", "z1", "z2") / F.col("step")) + 1, "last": F.floor(F.greatest("z0", "z1", "z2") / F.col("step"))}).where("last >= first")
    t = t.withColumn("k", F.explode(F.sequence("first", "last"))).withColumn("level", F.col("k") * F.col("step"))
    # going round the triangle, the level is crossed once downwards and once upwards: the segment leads from the one to the other
    over = [F.col(f"z{k}") >= F.col("level") for k in range(3)]
    side = lambda at: F.when(at(0, 1), 0).when(at(1, 2), 1).otherwise(2)
    t = t.withColumns({"down": side(lambda k, m: over[k] & ~over[m]), "rise": side(lambda k, m: ~over[k] & over[m])})
    of = lambda v, k: F.when(k == 0, F.col(f"{v}0")).when(k == 1, F.col(f"{v}1")).otherwise(F.col(f"{v}2"))
    for name in ("down", "rise"):
        here, there = F.col(name), F.pmod(F.col(name) + 1, F.lit(3))
        # from the same end whichever triangle asks, so that both get the same point
        swap = (of("i", here) > of("i", there)) | ((of("i", here) == of("i", there)) & (of("j", here) > of("j", there)))
        t = t.withColumns({f"{name}_a": F.when(swap, there).otherwise(here), f"{name}_b": F.when(swap, here).otherwise(there)})
        t = t.withColumns({f"{name}_{v}{e}": of(v, F.col(f"{name}_{e}")) for v in "xyzij" for e in "ab"})
        t = t.withColumn(f"{name}_s", (F.col("level") - F.col(f"{name}_za")) / (F.col(f"{name}_zb") - F.col(f"{name}_za")))
    at = lambda n, v: F.col(f"{n}_{v}a") + F.col(f"{n}_s") * (F.col(f"{n}_{v}b") - F.col(f"{n}_{v}a"))
    edge = lambda n: F.struct(F.col(f"{n}_ia").alias("i"), F.col(f"{n}_ja").alias("j"), (F.col(f"{n}_ib") - F.col(f"{n}_ia") + 2 * (F.col(f"{n}_jb") - F.col(f"{n}_ja"))).alias("way"))
    return t.select("surface_id", "level", edge("down").alias("a"), edge("rise").alias("b"), at("down", "x").alias("x1"), at("down", "y").alias("y1"), at("rise", "x").alias("x2"), at("rise", "y").alias("y2"))


def contour_lines(cells: DataFrame, steps: DataFrame) -> DataFrame:
    """(surface_id, level, x1, y1, x2, y2): contour_segments() without their edges."""
    return contour_segments(cells, steps).select("surface_id", "level", "x1", "y1", "x2", "y2")


def chains(segments: DataFrame) -> DataFrame:
    """(surface_id, level, first, end, n, low, low_at, closed, out, x, y): contour_segments() linked within tiles of TILE by TILE grid edges, one row for each chain: the edge it begins at
    and the one it ends at, its n segments' smallest edge and which segment that is, whether it is a ring, whether it ends in another tile, and its n + 1 points. A chain begins where none of its
    tile leads to, a ring at its smallest edge. A level of a tile has at most two segments for each of its cells; that is all that a task holds at a time besides a batch of rows."""
    tile, types = TILE, dict(segments.dtypes)
    at = lambda e, v: F.floor(F.col(f"{e}.{v}") / tile)
    # segments of a level of a tile follow each other, in the order of their edges
    own = W.partitionBy("surface_id", "ti", "tj", "level").orderBy("a")
    rows = segments.withColumns({"ti": at("a", "i"), "tj": at("a", "j")}).withColumn("no", F.row_number().over(own))
    way = lambda e: F.col(f"{e}.way").cast("long").alias(f"{e}w")
    inner = lambda e, v: (F.col(f"{e}.{v}") - F.col(f"t{v}") * tile).alias(f"{e}{v}")
    rows = rows.select("surface_id", "level", "no", "ti", "tj", *[c for e in "ab" for c in (inner(e, "i"), inner(e, "j"), way(e))], "x1", "y1", "x2", "y2")
    edge = lambda e: F.struct(*[(F.col(f"t{v}") * tile + F.col(f"{e}{v}")).cast("int").alias(v) for v in "ij"], F.col(f"{e}w").cast("int").alias("way"))
    three = "fi long, fj long, fw long, ei long, ej long, ew long, li long, lj long, lw long"
    linked = rows.mapInArrow(lambda batches: _link(batches, tile), f"surface_id {types['surface_id']}, level double, ti long, tj long, {three}, n long, low_at long, closed boolean, out boolean, x array<double>, y array<double>")
    return linked.select("surface_id", "level", edge("f").alias("first"), edge("e").alias("end"), "n", edge("l").alias("low"), "low_at", "closed", "out", "x", "y")


def _link(batches, tile: int):
    """chains() of batches of rows, which stand group by group, numbered from 1 (`no`) in the order of their edges."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        begins = np.flatnonzero(rows["no"].to_numpy() == 1)
        # the last group may go on in the next batch
        if len(begins) > 1:
            yield _linked(rows.slice(0, begins[-1]), tile)
        held = rows.slice(begins[-1])
    if held is not None and held.num_rows:
        yield _linked(held, tile)


def _linked(rows: pa.Table, tile: int) -> pa.RecordBatch:
    rows = rows.combine_chunks()
    c = {name: rows[name].to_numpy() for name in rows.column_names if name != "surface_id"}
    n = rows.num_rows
    each, none = np.arange(n), n
    ways, w = np.unique(np.concatenate([c["aw"], c["bw"]]), return_inverse=True)
    group = np.cumsum(c["no"] == 1)
    place = lambda e, way: ((group * tile + c[f"{e}i"]) * tile + c[f"{e}j"]) * len(ways) + way
    inside = (c["bi"] >= 0) & (c["bi"] < tile) & (c["bj"] >= 0) & (c["bj"] < tile)
    a, b = place("a", w[:n]), place("b", w[n:])
    to = np.minimum(np.searchsorted(a, b), n - 1)
    # nothing is pointed at twice; `none` points at itself
    joined = np.flatnonzero(inside & (a[to] == b))
    target, first = np.unique(to[joined], return_index=True)
    follow = np.full(n + 1, none)
    follow[joined[first]] = target
    # rounds that double how far each sees: what still sees something after all of them lies on a ring, whose smallest edge is that of the lowest row
    rounds = int(n).bit_length()
    jump, low = follow.copy(), np.append(each, none)
    for _ in range(rounds):
        if (jump == none).all():
            break
        low, jump = np.minimum(low, low[jump]), jump[jump]
    ring = jump[:n] != none
    follow[:n][ring & (follow[:n] == low[:n])] = none
    jump, far, end = follow.copy(), np.append((follow[:n] != none).astype(np.int64), 0), np.append(each, none)
    for _ in range(rounds):
        if (jump == none).all():
            break
        end, far, jump = np.where(jump == none, end, end[jump]), far + far[jump], jump[jump]
    end, far = end[:n], far[:n]
    order = np.lexsort((-far, end))
    begin = np.flatnonzero(np.append(True, end[order][1:] != end[order][:-1]))
    size = np.diff(np.append(begin, n))
    head, last = order[begin], order[begin + size - 1]
    lowest = np.minimum.reduceat(order, begin)
    # the points of each chain: where its segments begin, and where its last one ends
    offsets = np.append(0, np.cumsum(size + 1))
    starts = np.ones(offsets[-1], bool)
    starts[offsets[1:] - 1] = False

    def points(v: str) -> pa.Array:
        out = np.empty(offsets[-1])
        out[starts], out[~starts] = c[f"{v}1"][order], c[f"{v}2"][last]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(out))

    column = lambda name, at: pa.array(c[name][at].astype(np.int64))
    closed = ring[head]
    out = {"surface_id": rows["surface_id"].combine_chunks().take(pa.array(head)), "level": pa.array(c["level"][head]), "ti": column("ti", head), "tj": column("tj", head)}
    out = {k: v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v for k, v in out.items()}
    out |= {f"{name}{v}": column(f"{e}{v}", at) for name, e, at in (("f", "a", head), ("e", "b", last), ("l", "a", lowest)) for v in "ijw"}
    out |= {"n": pa.array(size.astype(np.int64)), "low_at": pa.array(far[head] - far[lowest]), "closed": pa.array(closed), "out": pa.array(~inside[last] & ~closed), "x": points("x"), "y": points("y")}
    return pa.RecordBatch.from_pydict(out)


def _lines_of_chains(rows: DataFrame) -> DataFrame:
    """(surface_id, level, id, start, length, first, turn, closed): for each open chain (by its first edge) how many segments of its line stand before it, how many there are, and the edge by which
    lines are numbered; a ring of several chains is closed, begins in the chain that holds its smallest edge, and turn segments later than that chain. Found by pointer jumping over chains: each
    round doubles how far a chain sees, and the rounds are as many as the logarithm of a level's chains."""
    key = ["surface_id", "level"]
    # written edges take a few bits each, so that Spark would take millions of them for a table to broadcast
    wide = lambda df: df.hint("merge")
    nodes = rows.where("NOT closed").select(*key, F.col("first").alias("id"), F.when(F.col("out"), F.col("end")).alias("next"), "n", F.struct("low", F.col("first").alias("chain"), F.col("low_at").alias("at")).alias("low"))
    nodes = nodes.join(wide(nodes.select(*key, F.col("id").alias("next"), F.lit(True).alias("on"))), [*key, "next"], "left")
    # ends point nowhere; low is the smallest edge seen so far
    links = written(nodes.select(*key, "id", F.when(F.col("on"), F.col("next")).alias("next"), "n", "low"), "links")
    most = links.groupBy(*key).count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]

    def joined(state: DataFrame, *more: str) -> DataFrame:
        """What each chain sees, with what the one that it points at sees."""
        far = state.select(*key, F.col("id").alias("next"), F.col("next").alias("next2"), *[F.col(c).alias(f"{c}2") for c in more])
        return state.join(wide(far), [*key, "next"], "left")

    state = links.select(*key, "id", "next", "low")
    for _ in range(max(1, most.bit_length())):  # a ring sees all of itself after as many
        if state.where("next IS NOT NULL").isEmpty():
            break
        state = written(joined(state, "low").select(*key, "id", F.col("next2").alias("next"), F.least("low", "low2").alias("low")), "links")
    rings = state.where("next IS NOT NULL").select(*key, "id", F.col("low").alias("ring"))
    # rings are cut before the chain with their smallest edge
    cut = links.join(wide(rings), [*key, "id"], "left")
    begin = written(cut.select(*key, "id", F.when(~F.coalesce(F.col("next") == F.col("ring.chain"), F.lit(False)), F.col("next")).alias("next"), F.col("n").alias("far"), "ring"), "cut")
    # how many segments there are from each chain on to the end of its line, and which chain that is
    state = begin.select(*key, "id", "next", "far", F.when(F.col("next").isNull(), F.col("id")).alias("end"))
    while not (state := written(state, "ranks")).where("next IS NOT NULL").isEmpty():
        state = joined(state, "far", "end").select(*key, "id", F.col("next2").alias("next"), (F.col("far") + F.coalesce("far2", F.lit(0))).alias("far"), F.coalesce("end", "end2").alias("end"))
    ends = state.groupBy(*key, "end").agg(F.max("far").alias("length"), F.max_by("id", "far").alias("head"))
    ring = F.col("ring")
    placed = state.select(*key, "id", "far", "end").join(wide(ends), [*key, "end"]).join(wide(begin.select(*key, "id", "ring")), [*key, "id"])
    return placed.select(*key, "id", (F.col("length") - F.col("far")).alias("start"), "length", F.coalesce(ring["low"], "head").alias("first"), F.coalesce(ring["at"], F.lit(0)).alias("turn"), ring.isNotNull().alias("closed"))


def contour_paths(segments: DataFrame) -> DataFrame:
    """(surface_id, level, line, seq, x, y, closed): contour_segments() linked to lines. Every grid edge that a line crosses ends one segment and begins the next, so the segments are linked
    lists and rings. They are linked within tiles first (chains()); only where a chain ends in another tile are chains linked with each other. `line` numbers the lines of a level by their first
    segment in the order of grid edges; rings begin at their smallest edge and return to it. Points that follow each other in one place (a corner on a level) are kept."""
    key = ["surface_id", "level"]
    wide = lambda df: df.hint("merge")
    rows = written(chains(segments), "chains")
    if rows.where("out").isEmpty():
        at = rows.withColumn("line", F.row_number().over(W.partitionBy(*key).orderBy("first")) - 1).select(*key, "line", "closed", F.lit(0).cast("long").alias("start"), F.col("n").alias("length"), "x", "y")
    else:
        whole = rows.where("closed").select(*key, F.col("first").alias("id"), F.lit(0).cast("long").alias("start"), F.col("n").alias("length"), "first", F.lit(0).cast("long").alias("turn"), "closed")
        placed = written(_lines_of_chains(rows).unionByName(whole), "placed")
        lines = placed.select(*key, "first").distinct().withColumn("line", F.row_number().over(W.partitionBy(*key).orderBy("first")) - 1)
        at = rows.select(*key, F.col("first").alias("id"), "n", "x", "y").join(wide(placed), [*key, "id"]).join(wide(lines), [*key, "first"])
        # the chain in which a ring begins and ends is two pieces of it
        turn = F.col("turn").cast("int")
        piece = lambda start, lo, n: F.struct(start.alias("start"), *[F.slice(c, lo, n).alias(c) for c in "xy"])
        two = F.array(piece(F.lit(0).cast("long"), turn + 1, F.size("x")), piece(F.col("length") - F.col("turn"), F.lit(1), turn + 1))
        one = F.array(F.struct((F.col("start") - F.col("turn")).alias("start"), "x", "y"))
        at = at.withColumn("p", F.explode(F.when((F.col("turn") > 0) & (F.col("start") == 0), two).otherwise(one))).select(*key, "line", "closed", "length", "p.start", "p.x", "p.y")
    points = at.select(*key, "line", "closed", "start", "length", (F.size("x") - 1).alias("n"), F.posexplode(F.arrays_zip("x", "y")).alias("pos", "p"))
    # the last point of a piece is the first of the next one, but for the end of the line
    points = points.withColumn("seq", F.col("start") + F.col("pos")).where("pos < n OR seq = length")
    return points.select(*key, "line", "seq", "p.x", "p.y", "closed")


def section_order(wells: DataFrame) -> DataFrame:
    """wells with seq, from west to east, wells without position last."""
    return ranked(wells, [F.col("lon").asc_nulls_last(), "well_id"], "seq").withColumn("seq", F.col("seq") + 1)


def neighbours(section: DataFrame) -> DataFrame:
    """(seq, well_id, next_id, km): consecutive wells of a section and their distance."""
    nxt = with_next(section.withColumn("_at", F.col("seq") - 1), "_at", {"well_id": "next_id", "lat": "_lat", "lon": "_lon"})
    return nxt.where("next_id IS NOT NULL").select("seq", "well_id", "next_id", haversine_km("lat", "lon", "_lat", "_lon").alias("km"))


def crossing_tops(pairs: DataFrame, tops: DataFrame, z: str = "md", tolerance: float = 0.0) -> DataFrame:
    """(well_id, next_id, upper, lower): shared tops of neighbours whose order turns over from one to the other."""
    t = tops.select("well_id", "name", F.col(z).alias("z"))
    shared = pairs.join(t, "well_id").join(t.select(F.col("well_id").alias("next_id"), "name", F.col("z").alias("z2")), ["next_id", "name"])
    a = shared.select("well_id", "next_id", F.col("name").alias("upper"), F.col("z").alias("az"), F.col("z2").alias("az2"))
    b = shared.select("well_id", "next_id", F.col("name").alias("lower"), F.col("z").alias("bz"), F.col("z2").alias("bz2"))
    return a.join(b, ["well_id", "next_id"]).where((F.col("az") < F.col("bz")) & (F.col("bz2") < F.col("az2") - tolerance)).select("well_id", "next_id", "upper", "lower")


def missing_tops(section: DataFrame, pairs: DataFrame, tops: DataFrame) -> DataFrame:
    """(well_id, name): tops that one of two neighbours has and the other hasn't, though wells on both sides of the gap have it; the well is the one without it."""
    placed = tops.join(section.select("well_id", "seq"), "well_id")
    reach = placed.groupBy("name").agg(F.min("seq").alias("first"), F.max("seq").alias("last"))
    has = tops.select("well_id", "name").distinct()
    left = pairs.join(has, "well_id").select("well_id", "next_id", "seq", "name", F.lit(True).alias("a"))
    right = pairs.join(has.select(F.col("well_id").alias("next_id"), "name"), "next_id").select("well_id", "next_id", "seq", "name", F.lit(True).alias("b"))
    both = left.join(right, ["well_id", "next_id", "seq", "name"], "full").where("a IS NULL OR b IS NULL").join(reach, "name")
    # the name occurs at or before the left well, and at or after it
    return both.where("first <= seq AND last >= seq").select(F.when(F.col("a").isNull(), F.col("well_id")).otherwise(F.col("next_id")).alias("well_id"), "name").distinct()


def nearest_point(points: DataFrame, lat: float, lon: float) -> DataFrame:
    """The control point nearest to a position."""
    d = points.withColumn("km", haversine_km("lat", "lon", lat, lon))
    return d.agg(F.min_by("well_id", F.struct("km", "well_id")).alias("well_id"), F.min("km").alias("km"))
