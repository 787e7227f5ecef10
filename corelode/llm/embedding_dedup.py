"""Embedding near-dedup: vectors of one label whose cosine reaches a threshold, as links and components.

Method: sorted projection passes. In each pass a vector's signs against random hyperplanes, concatenated, are its sort
key. All vectors of a label that share the key's first bits are a run, and a run is compared whole, block against block in
double precision, however large it is, so neither dense groups nor partition borders hide a pair. How many bits a label
takes follows from its number of distinct vectors (runs of spread-out vectors hold about RUN). A pair at the threshold shares
`bits` signs with probability (1 - angle / pi) ** bits whatever the other vectors are, so the number of passes follows
from that too: as many as leave at most MISS of such pairs unseen, at least PASSES. Where runs would save nothing over that many
passes, the label is one run and the result is exact. Passes are independent and run a few at a time; the links they verify are united into components.
Dense groups cost the square of their size in each pass.

The members of a component are then compared block against block, which counts every link of every member without
emitting a pair. Equal vectors (known by 128 bits of their label and components) are one vertex with a multiplicity, so copies cost nothing. Float vectors travel as floats;
products are taken in double precision.

Defined results: vectors that are null, empty, zero or hold a null or non-finite component, and vectors without label,
link with nothing; vectors of different length never link; a row with a null id is returned with no links. Ties go to the smallest id. Repeated rows of an id
each count as a vector. Other columns of the input, whatever their names, aren't returned. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as X
from .frames import join_dealt, written
from .graph import components

PASSES, RUN, BITS, BLOCK = 16, 512, 62, 2048
#: Passes that are shuffled at a time; what they wrote may go before the next.
AT_ONCE = 4
#: Share of the pairs at the threshold that all passes together may leave unseen.
MISS = 1e-6


def _matrix(column) -> np.ndarray:
    """Float vectors of one length as double rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 1))


def _units(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)  # no overflow or underflow in the norm
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _plan(cosine: float, least: int) -> list[tuple[int, int]]:
    """For each number of bits that a label's size asks for: the bits it takes, and its passes."""
    alike = 1 - math.acos(max(-1.0, min(1.0, cosine))) / math.pi
    plan = []
    for bits in range(BITS + 1):
        missed = 1 - alike**bits
        passes = 1 if missed <= 0 else max(least, math.ceil(math.log(MISS) / math.log(missed))) if missed < 1 else 2**BITS
        plan.append((bits, passes) if bits and passes < 2**bits else (0, 1))
    return plan


def _keys(seed: int, vectors: bool, low: int, high: int):
    """A row for each vector and pass low .. high - 1 with the key of its run; without vectors, a count for each run of the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("dim").to_numpy()
            for dim in np.unique(sizes):
                part = batch.filter(pa.array(sizes == dim))
                bits, passes, label = (part.column(c).to_numpy().astype(np.int64) for c in ("bits", "passes", "label"))
                unit = _units(_matrix(part.column("embedding"))) if bits.any() else None
                for p in range(low, min(high, int(passes.max()))):
                    key = np.zeros(len(part), np.int64)
                    if unit is not None:
                        planes = np.random.default_rng([seed, p, int(dim)]).standard_normal((int(dim), BITS))
                        some = np.flatnonzero((bits > 0) & (passes > p))
                        signs = (unit[some] @ planes) > 0
                        key[some] = (signs << np.arange(BITS - 1, -1, -1, dtype=np.int64)).sum(axis=1) >> (BITS - bits[some])
                    pick = np.flatnonzero(passes > p)
                    if vectors:
                        rows = part.take(pa.array(pick))
                        more, names = [rows.column(c) for c in ("rep", "embedding")], ["rep", "embedding"]
                        key, own = key[pick], label[pick]
                    else:
                        runs, n = np.unique(np.stack([label[pick], key[pick]], axis=1), axis=0, return_counts=True)
                        own, key, more, names = runs[:, 0], runs[:, 1], [pa.array(n.astype(np.int64))], ["n"]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), p, np.int32)), pa.array(key), pa.array(own), pa.array(np.full(len(key), dim, np.int32)), *more], names=["pass", "key", "label", "dim", *names])

    return run


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n vertices the smallest one that the edges (i, j) connect it with."""
    of = np.arange(n)
    while len(i):
        low = np.arange(n)
        np.minimum.at(low, np.maximum(i, j), np.minimum(i, j))
        while (low[low] != low).any():
            low = low[low]
        of, i, j = low[of], low[i], low[j]
        apart = i != j
        i, j = i[apart], j[apart]
    return of


def _compared(cosine: float):
    """Links inside a block or between two blocks of a run, thinned to what connects them."""
    keys = ["pass", "label", "dim", "key", "bi", "bj"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in X.whole_groups(batches, keys):
            rep, own, bi, bj = (t.column(c).to_numpy() for c in ("rep", "own", "bi", "bj"))
            vectors = t.column("embedding").combine_chunks()
            for lo, hi in zip(at[:-1], at[1:], strict=True):
                if hi - lo < 2:
                    continue
                unit, ids = _units(_matrix(vectors.slice(lo, hi - lo))), rep[lo:hi]
                if bi[lo] == bj[lo]:
                    i, j = np.nonzero(np.triu(unit @ unit.T >= cosine, 1))
                else:
                    a, b = np.flatnonzero(own[lo:hi] == bi[lo]), np.flatnonzero(own[lo:hi] == bj[lo])
                    i, j = np.nonzero(unit[a] @ unit[b].T >= cosine)
                    i, j = a[i], b[j]
                of = _forest(len(ids), i, j)
                linked = np.flatnonzero(of != np.arange(len(ids)))
                if len(linked):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[linked]), pa.array(ids[of[linked]])], names=["a", "b"])

    return run


def _counted(cosine: float):
    """Links of each member with the copies of the others, block against block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in X.whole_groups(batches, ["component", "bi", "bj"]):
            rep, copies, own = t.column("rep").to_numpy(), t.column("copies").to_numpy(), t.column("own").to_numpy()
            bi, bj = t.column("bi").to_numpy(), t.column("bj").to_numpy()
            vectors, links = t.column("embedding").combine_chunks(), np.zeros(len(t), np.int64)
            for lo, hi in zip(at[:-1], at[1:], strict=True):
                unit = _units(_matrix(vectors.slice(lo, hi - lo)))
                if bi[lo] == bj[lo]:
                    near = unit @ unit.T >= cosine
                    np.fill_diagonal(near, False)
                    links[lo:hi] = near @ copies[lo:hi]
                else:  # pairs inside a block count where it meets itself
                    a, b = np.flatnonzero(own[lo:hi] == bi[lo]), np.flatnonzero(own[lo:hi] == bj[lo])
                    near = unit[a] @ unit[b].T >= cosine
                    links[lo + a], links[lo + b] = near @ copies[lo + b], copies[lo + a] @ near
            yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(links)], names=["rep", "links"])

    return run


def _in_blocks(rows: DataFrame, keys: list[str], *more: str) -> DataFrame:
    """Sends each row of a key with `blocks` blocks to all pairs of blocks that its own is part of."""
    return (
        rows.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(*keys, F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), "own", "rep", "embedding", *more)
        .repartition(*keys, "bi", "bj")
        .sortWithinPartitions(*keys, "bi", "bj")
    )


def embedding_links(vectors: DataFrame, cosine: float = 0.98, passes: int = PASSES, seed: int = 11, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id for every row."""
    kind = vectors.schema[vec_col].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"
    given = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast(kind).alias("embedding"), F.col(label_col).cast("long").alias("label"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce((F.size("embedding") > 0) & ~F.exists("embedding", bad) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    same = ["k1", "k2"]
    good = given.where(sound).withColumns({k: F.xxhash64(F.lit(n), "label", F.size("embedding"), "embedding") for n, k in enumerate(same)})
    reps = good.groupBy(*same, "label").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
    reps = written(reps.withColumn("dim", F.size("embedding")), "vectors")
    plan = F.array(*[F.struct(F.lit(b).alias("bits"), F.lit(p).cast("long").alias("passes")) for b, p in _plan(cosine, passes)])
    asked = F.greatest(F.ceil(F.log2(F.count("*") / RUN)), F.lit(0)).cast("int")
    # written, so that a few labels or a few large runs are seen to be few and aren't dealt out by their keys
    labels = written(reps.groupBy("label", "dim").agg(F.element_at(plan, asked + 1).alias("plan")).select("label", "dim", "plan.*"), "labels")
    reps_of = reps.select("label", "dim", "rep", "embedding").join(labels, ["label", "dim"])
    run = ["pass", "label", "dim", "key"]
    of = "pass int, key long, label long, dim int"
    links = None
    for low in range(0, labels.agg(F.coalesce(F.max("passes"), F.lit(1))).first()[0], AT_ONCE):
        span = low, low + AT_ONCE
        large = reps_of.mapInArrow(_keys(seed, False, *span), f"{of}, n long").groupBy(*run).agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks")).where("blocks > 1")
        keyed = reps_of.mapInArrow(_keys(seed, True, *span), f"{of}, rep long, embedding {kind}").join(written(large, "large"), run, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        some = written(_in_blocks(keyed, run).mapInArrow(_compared(cosine), "a long, b long"), "links")
        links = some if links is None else links.unionByName(some)
    found = written(components(links).withColumnRenamed("id", "rep"), "found")
    sizes = found.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    members = join_dealt(found, sizes, ["component"], "rep").join(reps.select("rep", "copies", "embedding"), "rep")
    counts = _in_blocks(members, ["component"], "copies").mapInArrow(_counted(cosine), "rep long, links long").groupBy("rep").agg(F.sum("links").alias("links"))
    whole = reps.drop("embedding").join(found, "rep", "left").join(counts, "rep", "left").select(*same, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    alone = given.where(~sound).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return join_dealt(good.select("vec_id", *same), whole, same, "vec_id").select("vec_id", "n_links", "component_id").unionByName(alone)


def op5_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    found = embedding_links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))

