"""Centroid clustering of integer vectors: rounds of nearest-centroid assignment and exact means.

Method: Shallot search. A vector carries bounds between rounds: the nearest centroid and no less than its distance (upper), the second nearest, and no more than the
distance to any centroid but the nearest (lower); both move with the centroids. Where the bounds don't settle the vector, it is compared with both remembered centroids, and the
search starts from the closer one: the others are scanned in the order of their distance from it, as long as they lie in the ball that may still hold a first or second
(distance to the start plus distance to the second so far), which shrinks with every better second. Bounds only ever leave out a
centroid that is strictly farther; what survives is compared by squared distance in integers, so ties go to the smaller number and results don't depend on rounding.

A round is one pass over a written table in Arrow batches, and an aggregation of a row for each centroid and task. The driver holds k centroids, whatever the data; a
group of equal vectors costs what its rows cost.

Defined results: vectors that are null, of another length, or hold a null, a non-finite component or one above MOST in size (whose squared distance might not fit a long)
are left out. Rows that share an id are vectors of their own; a null id is a start only where there are fewer than k ids. Equal vectors get equal clusters; equal centroids share
nothing: the smaller number takes all. With fewer vectors than k there are as many centroids as vectors. Centroids without vectors stay where they are. Extra columns
are left out. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import dropped, written

#: Components of kept vectors are no larger: 64 squared differences of 64 times this fit a long.
MOST = 2.0**20
STATE = "vec_id {id}, q array<int>, cluster int, second int, upper double, lower double, distance long, compared int"


class Centroids:
    """k integer centroids, what lies between them, and how far they moved."""

    def __init__(self, points: np.ndarray, before: np.ndarray | None = None):
        self.points = points
        k = len(points)
        gaps = np.array([self.squares(points, np.full(k, j)) for j in range(k)], np.int64)
        self.gap = np.sqrt(gaps.astype(np.float64))
        # each centroid's others, nearest first
        self.order = np.array([[j for j in np.argsort(self.gap[i], kind="stable") if j != i] for i in range(k)], np.int64).reshape(k, k - 1)
        self.half = self.gap[np.arange(k), self.order[:, 0]] / 2 if k > 1 else np.full(k, np.inf)
        diff = points - (points if before is None else before)
        self.moved = np.sqrt((diff * diff).sum(1).astype(np.float64))
        # how far any other than i has moved
        self.others = np.array([max([0.0, *np.delete(self.moved, i)]) for i in range(k)])

    def squares(self, q: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The squared distance of each vector to its centroid `at`, in integers."""
        diff = q - self.points[at]
        return (diff * diff).sum(1)


def assign(q: np.ndarray, known: tuple[np.ndarray, ...] | None, c: Centroids, exact: bool = False) -> tuple[np.ndarray, ...]:
    """(cluster, second, upper, lower, distance, compared) of vectors, from those of the round before (None: the first). `distance` is -1 where the bounds settled it, unless
    exact; `compared` is with how many centroids a vector was compared."""
    n, k = len(q), len(c.points)
    compared, distance = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    if known is None:
        a, b = np.zeros(n, np.int64), np.full(n, min(1, k - 1), np.int64)
        upper, lower = np.full(n, np.inf), np.zeros(n)
    else:
        a, b, upper, lower = (x.copy() for x in known)
        upper += c.moved[a]
        lower -= c.others[a]

    def measured(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        compared[rows] += 1
        return c.squares(q[rows], at)

    def unsettled(rows: np.ndarray) -> np.ndarray:
        bound = np.maximum(lower[rows], c.half[a[rows]])
        slack = 1e-9 + 1e-12 * (upper[rows] + c.gap.max(initial=0) + c.moved.max(initial=0))
        return rows[~(upper[rows] + slack < bound)]

    if k == 1:
        lower[:] = np.inf
    rows = np.arange(n) if known is None else unsettled(np.arange(n))
    distance[rows] = measured(rows, a[rows])
    upper[rows] = np.sqrt(distance[rows].astype(np.float64))
    if known is not None:
        rows = unsettled(rows)
    if k > 1 and len(rows):
        best, first, second = a[rows], distance[rows], b[rows]
        next_ = measured(rows, second)
        swap = (next_ < first) | ((next_ == first) & (second < best))
        best, second = np.where(swap, second, best), np.where(swap, best, second)
        first, next_ = np.where(swap, next_, first), np.where(swap, first, next_)
        start, skip = best.copy(), second.copy()
        from_start = np.sqrt(first.astype(np.float64))
        on = np.arange(len(rows))
        for t in range(k - 1):
            j = c.order[start[on], t]
            reach = from_start[on] + np.sqrt(next_[on].astype(np.float64))
            near = c.gap[start[on], j] <= reach * (1 + 1e-12) + 1e-9
            on, j = on[near], j[near]
            if not len(on):
                break
            new = j != skip[on]
            r, j = on[new], j[new]
            d = measured(rows[r], j)
            wins = (d < first[r]) | ((d == first[r]) & (j < best[r]))
            nears = ~wins & ((d < next_[r]) | ((d == next_[r]) & (j < second[r])))
            w, s = r[wins], r[nears]
            second[w], next_[w] = best[w], first[w]
            best[w], first[w] = j[wins], d[wins]
            second[s], next_[s] = j[nears], d[nears]
        a[rows], b[rows], distance[rows] = best, second, first
        upper[rows], lower[rows] = np.sqrt(first.astype(np.float64)), np.sqrt(next_.astype(np.float64))
    if exact:
        rest = np.flatnonzero(distance < 0)
        distance[rest] = measured(rest, a[rest])
    return a, b, upper, lower, distance, compared


def _assigned(c: Centroids, exact: bool):
    kinds = [pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.int32()]
    names = ["cluster", "second", "upper", "lower", "distance", "compared"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            q = batch.column("q").flatten().to_numpy().astype(np.int64).reshape(len(batch), -1)
            known = tuple(batch.column(x).to_numpy() for x in names[:4]) if "cluster" in batch.schema.names else None
            found = assign(q, known, c, exact)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("q"), *[pa.array(x, t) for x, t in zip(found, kinds, strict=True)]], names=["vec_id", "q", *names])

    return run


def whole_vectors(vectors: DataFrame, dims: int, scale: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, q): the kept vectors with floor(scale * x) for each component."""
    x = F.col(vector_col)
    fine = (F.size(x) == dims) & F.forall(x, lambda v: F.coalesce(F.abs(v.cast("double")) <= MOST, F.lit(False)))
    return vectors.where(fine).select(F.col(id_col).alias("vec_id"), F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("int")).alias("q"))


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: str = "1", id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, q, cluster, second, upper, lower, distance, compared) per kept vector, in a written table, and the centroids. Starts are the vectors whose `seed:id` has the smallest SHA-256."""
    if dims * (2 * (MOST * scale + 1)) ** 2 >= 2**63:
        raise ValueError(f"squared distances of {dims} components times {scale} may not fit a long")
    state = written(whole_vectors(vectors, dims, scale, id_col, vector_col), "vectors")
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    starts = state.orderBy(draw.asc_nulls_last(), "q").limit(k).select("q").collect()
    schema = STATE.format(id=state.schema["vec_id"].dataType.simpleString())
    points, before = np.array([r.q for r in starts], np.int64).reshape(len(starts), dims), None
    for r in range(rounds + 1):
        c = Centroids(points, before) if len(points) else None
        done = written(state.mapInArrow(_assigned(c, r == rounds), schema), "assigned")
        dropped(state)
        state = done
        if r == rounds or c is None:
            break
        sums = state.groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(F.col("q")[i].cast("long")).alias(f"s{i}") for i in range(dims)])
        before, points = points, points.copy()
        for row in sums.collect():  # one row for each centroid
            points[row.cluster] = [row[f"s{i}"] // row.n for i in range(dims)]
    return state, points


def op12_centroids(spark, sf_dir: str) -> DataFrame:
    found, points = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    inertia = {r.cluster: r.s for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # one row for each centroid
    digests = [(k, inertia[k], sum(inertia.values()), hashlib.sha256(",".join(map(str, p.tolist())).encode()).hexdigest()) for k, p in enumerate(points) if k in inertia]
    table = spark.createDataFrame(digests, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(k: int, rounds: int, dims: int, scale: int) -> str:
    parts = [f"""WITH
n AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings WHERE len(embedding) = {dims}),
u AS MATERIALIZED (SELECT r, vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM n),
g AS MATERIALIZED (SELECT r FROM u GROUP BY r HAVING count(CASE WHEN isfinite(x) THEN 1 END) = {dims}),
v AS MATERIALIZED (SELECT r, vec_id, i, floor({scale} * x)::BIGINT AS x FROM u JOIN g USING (r)),
p AS MATERIALIZED (SELECT r, row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST) - 1 AS k FROM n JOIN g USING (r) QUALIFY k < {k}),
c0 AS MATERIALIZED (SELECT k, i, x FROM v JOIN p USING (r))"""]
    for t in range(rounds + 1):
        parts.append(f"""a{t} AS MATERIALIZED (
  SELECT r, k, d FROM (SELECT r, k, sum((v.x - c.x) * (v.x - c.x)) AS d FROM v JOIN c{t} AS c USING (i) GROUP BY r, k)
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, k) = 1)""")
        if t < rounds:
            parts.append(f"""s{t} AS MATERIALIZED (SELECT k, i, sum(x) AS s, count(*) AS m FROM v JOIN a{t} USING (r) GROUP BY k, i),
c{t + 1} AS MATERIALIZED (SELECT c.k, c.i, CASE WHEN m IS NULL THEN c.x ELSE ((s - (((s % m) + m) % m)) // m)::BIGINT END AS x FROM c{t} AS c LEFT JOIN s{t} USING (k, i))""")
    return ",\n".join(parts) + f"""
SELECT n.vec_id, a.k::INTEGER AS cluster, a.d::BIGINT AS distance, (sum(a.d) OVER (PARTITION BY a.k))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia, h.sha AS centroid_sha256
FROM a{rounds} AS a JOIN n USING (r) JOIN (SELECT k, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS sha FROM c{rounds} GROUP BY k) AS h USING (k)"""


OP12_SQL = _sql(16, 3, 64, 64)
