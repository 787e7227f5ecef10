"""MinHash near-dedup: documents whose word-shingle sets are similar, as connected components.

Method: chosen-path set similarity join. Each set is embedded as MINS minwise tokens. In each of TREES independent trees
a node sends every member on along COORDINATES chosen minwise tokens, one child per token value; small nodes are
compared exhaustively (by the minwise tokens). In a large one every member is compared with one of them, the pivot: members that are like it are linked with it and so with
each other. The others (the rest) are compared in blocks with each other and with all members if they are few, and otherwise the node branches again, up to DEPTH levels,
after which the rest is compared in any case. With two chosen coordinates a pair of similarity s survives a level with probability
1 - (1 - s)^2 at least once, whatever the depth with at least the fixed point of p = 1 - (1 - s p)^2 (0.969 for 0.85), so
four trees miss a pair in about a million. What a node passes on is a spanning forest of its similar members, never its pairs.
Members of the resulting loose components are then compared on their full sets, which confirms every link and finds every other one inside the component: a component that is
one block at once; of a larger one every member with the component's first document, and the members that this doesn't link (the rest) block against block with each other and with all
others. So a large group of near copies costs one comparison a member, and a large component of loosely related documents the product of its rest and its size.

Equal sets are one vertex from the start, so groups of copies cost nothing later.

Defined results: a null or empty text, or one without words, has the empty set and links with nothing; a text of fewer
words than a shingle has its whole sequence as its only shingle. A row with a null id keeps its set size; it gets a null component and is kept.
Repeated rows of an id count as one vertex. Ties go to the smallest id. Other input columns, whatever their names, aren't returned by components_of(). A very long text is one set, never
a part of it. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as X
from .frames import for_shares, hot_keys, in_shares, join_dealt, written
from .graph import components

MINS, TREES, COORDINATES, DEPTH = 64, 4, 2, 3
#: Members of a node or block that are compared at once; blocks of unlike members up to which a large node is compared instead of branching.
BLOCK, WIDE = 512, 4
#: Shingles and members of a block in the comparison on full sets.
BLOCK_SHINGLES, BLOCK_MEMBERS = 200_000, 256
#: Rows of a node, component or set that go to one task where it is joined.
HOT = 20_000
#: Chance that the minwise comparison misses a pair just at the threshold.
MISS = 1e-5

_U = np.uint64
_rng = np.random.default_rng(97)
_MUL = _rng.integers(0, 2**62, MINS, dtype=np.uint64) * _U(2) + _U(1)
_ADD = _rng.integers(0, 2**63, MINS, dtype=np.uint64)


def least_matches(share: float) -> int:
    """Minwise tokens of MINS that a pair of this similarity shares, but for a chance of MISS."""
    below = 0.0
    for m in range(MINS + 1):
        below += math.comb(MINS, m) * share**m * (1 - share) ** (MINS - m)
        if below > MISS:
            return m
    return MINS


def _shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of each text, distinct and sorted within it, and where each text's begin."""
    words = X.find_words(data, offsets)
    h = words.hashes(lower=True)
    count = np.diff(words.first)
    owner = words.owner()
    all_ = X.fold(h, size)
    whole = np.flatnonzero(owner[: len(all_)] == owner[size - 1 :]) if len(all_) else np.zeros(0, np.int64)
    parts, owners = [all_[whole]], [owner[whole]]
    for n in range(1, size):
        short = np.flatnonzero(count == n)
        if len(short):
            runs = X.fold(h, n)
            parts.append(X.mix(runs[words.first[short]] + _U(n)))
            owners.append(short)
    s, o = np.concatenate(parts), np.concatenate(owners)
    order = np.lexsort((s, o))
    s, o = s[order], o[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (o[1:] != o[:-1])
    s, o = s[new], o[new]
    return s, np.searchsorted(o, np.arange(len(offsets)))


def _binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary rows values[ends[i]:ends[i+1]]."""
    offs = (ends * values.itemsize).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def _profile(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in X.chunks(batch, "text"):
                s, first = _shingles(data, offsets, size)
                n = np.diff(first)
                some = np.flatnonzero(n)
                at = first[some]
                mins = np.zeros((len(n), MINS), np.uint32)
                s1, s2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
                if len(some):
                    for c in range(MINS):
                        low = np.minimum.reduceat((s ^ _ADD[c]) * _MUL[c], at)
                        mins[some, c] = (X.mix(low) >> _U(32)).astype(np.uint32)
                    s1[some] = np.add.reduceat(X.mix(s ^ _U(0xA0761D6478BD642F)), at)
                    s2[some] = np.add.reduceat(X.mix(s ^ _U(0xE7037ED1A0B428DB)), at)
                sketch = _binary(mins.reshape(-1), np.arange(len(n) + 1) * MINS)
                ids = batch.column("doc_id").slice(rows.start, rows.stop - rows.start)
                yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), sketch], names=["doc_id", "n", "s1", "s2", "sketch"])

    return run


def _sketches(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, MINS), np.uint32)
    _, offs, data = column.buffers()
    start = np.frombuffer(offs, np.int32, 1, column.offset * 4)[0]
    return np.frombuffer(data, np.uint32, len(column) * MINS, int(start)).reshape(-1, MINS)


def _children(level: int):
    """Sends each member of a node (at level 0 of each tree's root) to the children of its chosen coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sketch = _sketches(batch.column("sketch"))
            rep, known = batch.column("rep"), batch.column("known")
            nodes = [X.mix(np.full(len(batch), t + 1, np.uint64)) for t in range(TREES)] if level == 0 else [batch.column("node").to_numpy().view(np.uint64)]
            keys, row = [], np.arange(len(batch))
            for node in nodes:
                # distinct coordinates, chosen by the node alone
                start = X.mix(node + _U(level)) % _U(MINS)
                step = X.mix(node ^ _U(0x9FB21C651E98DF25)) % _U(MINS // 2) * _U(2) + _U(1)
                for k in range(COORDINATES):
                    c = (start + step * _U(k)) % _U(MINS)
                    keys.append(X.mix(node ^ X.mix(sketch[row, c.astype(np.int64)].astype(np.uint64) + (c << _U(32)) + _U(1))))
            n = len(keys)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.concat_arrays([rep] * n), pa.concat_arrays([known] * n)], names=["node", "rep", "known"])

    return run


def _star(least: int):
    """Marks members of large nodes that are similar to their node's pivot: known becomes the pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = (_sketches(batch.column("sketch")) == _sketches(batch.column("pivot_sketch"))).sum(axis=1) >= least
            pivot, known = batch.column("pivot").to_numpy(), batch.column("known").fill_null(-1).to_numpy()
            fresh = near & (known < 0)
            known = pa.array(np.where(fresh, pivot, known), mask=~fresh & (known < 0))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("node", "rep", "members", "sketch")], known, pa.array(np.where(near, pivot, -1), mask=~near)], names=["node", "rep", "members", "sketch", "known", "link"])

    return run


def _similar(least: int):
    """Spanning forests of the similar members of each node (or pair of its blocks); members that are known to be
    linked with the same pivot are one vertex, so that only what is new is passed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in X.whole_groups(batches, ["node", "bi", "bj"]):
            rep, sketch = t.column("rep").to_numpy(), _sketches(t.column("sketch"))
            known = t.column("known").fill_null(-1).to_numpy()
            size = np.diff(at)
            a, b = [], []
            two = at[:-1][size == 2]
            hit = two[(sketch[two] == sketch[two + 1]).sum(axis=1) >= least] if len(two) else two
            a.append(rep[hit]), b.append(rep[hit + 1])
            for lo in np.flatnonzero(size > 2):
                part = slice(at[lo], at[lo + 1])
                # known members first: then they are the roots of what joins them
                order = np.argsort(known[part] < 0, kind="stable")
                s, r, k = sketch[part][order], rep[part][order], known[part][order]
                same = np.zeros((len(r), len(r)), np.uint8)
                for c in range(MINS):
                    same += s[:, c][:, None] == s[:, c][None, :]
                joined = (k[:, None] == k[None, :]) & (k >= 0)[:, None]
                i, j = X.forest((same >= least) | joined)
                new = (k[i] < 0) | (k[i] != k[j])
                i, j = i[new], j[new]
                # members of one known group need one edge between them and the root
                _, one = np.unique(np.where(k[i] >= 0, k[i], -1 - r[i]), return_index=True)
                a.append(r[i[one]]), b.append(r[j[one]])
            if sum(map(len, a)):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return run


def _crossed(members: DataFrame, key: str, near, *more: str) -> DataFrame:
    """Members of a key in `rests` blocks of rest and `cores` blocks of others (near): each block of the rest meets every block in a group (key, bi, bj);
    bi <= bj among the rest, and bj is below zero for the others."""
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    pair = lambda i, j: F.struct(i.cast("int").alias("bi"), j.cast("int").alias("bj"))
    own = F.pmod(F.xxhash64("rep"), F.when(near, F.col("cores")).otherwise(F.col("rests")))
    across = F.transform(upto("rests"), lambda k: pair(k, -1 - own))
    within = F.transform(upto("rests"), lambda k: pair(F.least(k, own), F.greatest(k, own)))
    others = F.when(F.col("cores") > 0, F.transform(upto("cores"), lambda k: pair(own, -1 - k))).otherwise(F.array().cast("array<struct<bi:int,bj:int>>"))
    return members.select(key, F.explode(F.when(near, across).otherwise(F.concat(within, others))).alias("m"), "rep", *more).select(key, "m.bi", "m.bj", "rep", *more)


def _dealt(blocks: DataFrame, key: str) -> DataFrame:
    return blocks.repartition(key, "bi", "bj").sortWithinPartitions(key, "bi", "bj")


def loose_links(reps: DataFrame, least: int) -> DataFrame:
    """Links (a, b) that connect all that the trees find similar by minwise tokens."""
    found, level = None, 0
    rows = reps.select("rep", "sketch", F.lit(None).cast("long").alias("known")).mapInArrow(_children(0), "node long, rep long, known long")
    while True:
        rows = written(rows, "nodes")
        sizes = rows.groupBy("node").agg(F.count("*").alias("members"), F.min("rep").alias("pivot")).where("members > 1")
        # large nodes carry their pivot's sketch, so that only the node's own key is joined, in shares
        pivots = reps.select(F.col("rep").alias("pivot"), F.col("sketch").alias("pivot_sketch"))
        large = sizes.where(F.col("members") > BLOCK).join(pivots, "pivot")
        nodes = written(sizes.where(F.col("members") <= BLOCK).withColumn("pivot_sketch", F.lit(None).cast("binary")).unionByName(large), "sizes")
        members = written(join_dealt(rows, nodes, ["node"], "rep", HOT).join(reps.select("rep", "sketch"), "rep"), "members")
        few = members.where(F.col("members") <= BLOCK).select("node", "rep", "members", "sketch", "known")
        many = members.where(F.col("members") > BLOCK).mapInArrow(_star(least), "node long, rep long, members long, sketch binary, known long, link long")
        many = written(many, "stars")
        stars = many.where("link IS NOT NULL AND link != rep").select(F.col("rep").alias("a"), F.col("link").alias("b"))
        rest = many.groupBy("node").agg(F.ceil(F.count_if(F.col("link").isNull()) / BLOCK).cast("int").alias("rests"), F.ceil(F.count("link") / BLOCK).cast("int").alias("cores")).where("rests > 0")
        open_ = written(join_dealt(many, rest, ["node"], "rep", HOT), "open")
        last = level == DEPTH - 1
        now = open_ if last else open_.where(F.col("rests") <= WIDE)
        one = few.select("node", F.lit(0).alias("bi"), F.lit(0).alias("bj"), "rep", "sketch", "known")
        blocks = _dealt(one.unionByName(_crossed(now, "node", F.col("link").isNotNull(), "sketch", "known")), "node")
        links = blocks.mapInArrow(_similar(least), "a long, b long").unionByName(stars)
        found = links if found is None else found.unionByName(links)
        wide = open_.where(F.col("rests") > WIDE)
        if last or wide.isEmpty():
            return found
        level += 1
        rows = wide.select("node", "rep", "sketch", "known").mapInArrow(_children(level), "node long, rep long, known long").distinct()


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in X.chunks(batch, "text"):
                s, first = _shingles(data, offsets, size)
                part = batch.slice(rows.start, rows.stop - rows.start)
                yield pa.RecordBatch.from_arrays([part.column("component"), part.column("rep"), pa.array(np.diff(first)), _binary(s, first)], names=["component", "rep", "n", "shingles"])

    return run


def _set_values(column) -> tuple[np.ndarray, np.ndarray]:
    """The values of binary rows of 64-bit hashes, one after the other, and where each row's begin and the last ends."""
    _, offs, data = column.buffers()
    ends = np.frombuffer(offs, np.int32, len(column) + 1, column.offset * 4) // 8
    return np.frombuffer(data, np.uint64, int(ends[-1])) if data is not None else np.zeros(0, np.uint64), ends


def _near_first(share: tuple[int, int]):
    """Whether each member is linked with the first document of its component, whose row (kind 0) comes before its share's others."""
    num, den = share

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, root = None, np.zeros(0, np.uint64)
        for batch in batches:
            component, rep, kind, n = (batch.column(c).to_numpy() for c in ("component", "rep", "kind", "n"))
            values, ends = _set_values(batch.column("shingles"))
            near = np.zeros(len(batch), bool)
            at = np.flatnonzero(np.concatenate([[True], (component[1:] != component[:-1]) | (kind[1:] != kind[:-1])])) if len(batch) else []
            for a, b in zip(at, [*at[1:], len(batch)], strict=True):
                if kind[a] == 0:
                    of, root = component[a], np.sort(values[ends[a] : ends[a + 1]])
                elif of == component[a]:
                    v = values[ends[a] : ends[b]]
                    spot = np.minimum(np.searchsorted(root, v), len(root) - 1)
                    sums = np.concatenate([[0], np.cumsum(root[spot] == v)])
                    both = sums[ends[a + 1 : b + 1] - ends[a]] - sums[ends[a:b] - ends[a]]
                    near[a:b] = den * both >= num * (n[a:b] + len(root) - both)
            some = pa.array(kind == 1)
            out = pa.RecordBatch.from_arrays([pa.array(component), pa.array(rep), pa.array(n), pa.array(near)], names=["component", "rep", "n", "near"])
            yield out.filter(some)

    return run


def _confirmed(share: tuple[int, int]):
    """Spanning forests of the links between the members of a pair of blocks, by their full sets."""
    num, den = share

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in X.whole_groups(batches, ["component", "bi", "bj"]):
            rep = t.column("rep").to_numpy()
            values, ends = _set_values(t.column("shingles").combine_chunks())
            a, b = [], []
            for lo, hi in zip(at, at[1:], strict=False):
                if hi - lo < 2:
                    continue
                n = np.diff(ends[lo : hi + 1]).astype(np.int64)
                v, row = values[ends[lo] : ends[hi]], np.repeat(np.arange(hi - lo), n)
                order = np.argsort(v, kind="stable")
                v, row = v[order], row[order]
                new = np.ones(len(v), bool)
                new[1:] = v[1:] != v[:-1]
                which = np.cumsum(new) - 1
                shared = np.bincount(which) > 1
                column_of = np.cumsum(shared) - 1
                pick = shared[which]
                row, which = row[pick], column_of[which[pick]]
                both = np.zeros((hi - lo, hi - lo), np.float32)
                for c in range(0, int(shared.sum()), 4096):
                    some = slice(*np.searchsorted(which, [c, c + 4096]))
                    x = np.zeros((hi - lo, 4096), np.float32)
                    x[row[some], which[some] - c] = 1
                    both += x @ x.T
                both = np.rint(both).astype(np.int64)
                i, j = X.forest(den * both >= num * (n[:, None] + n[None, :] - both))
                a.append(rep[lo:hi][i]), b.append(rep[lo:hi][j])
            if sum(map(len, a)):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return run


def _block_count(n, which=None):
    """Blocks of the members for which `which` holds."""
    one = F.lit(1) if which is None else F.when(which, 1)
    size = n if which is None else F.when(which, n)
    return F.coalesce(F.greatest(F.ceil(F.sum(size) / BLOCK_SHINGLES), F.ceil(F.sum(one) / BLOCK_MEMBERS)), F.lit(0)).cast("int")


def _large_links(sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Links (a, b) that connect what is linked inside components of many blocks. sets: component, rep, n, shingles."""
    hot = hot_keys(sets, ["component"], HOT)
    first = for_shares(sets.where("rep = component"), hot, ["component"]).withColumn("kind", F.lit(0))
    rows = in_shares(sets, hot, ["component"], "rep").withColumn("kind", F.lit(1)).unionByName(first)
    dealt = rows.repartition("component", "_share").sortWithinPartitions("component", "_share", "kind").select("component", "rep", "kind", "n", "shingles")
    star = written(dealt.mapInArrow(_near_first(share), "component long, rep long, n long, near boolean"), "star")
    rest = star.groupBy("component").agg(_block_count(F.col("n"), ~F.col("near")).alias("rests"), _block_count(F.col("n"), F.col("near")).alias("cores")).where("rests > 0")
    members = join_dealt(star, rest, ["component"], "rep", HOT).join(sets.select("rep", "shingles"), "rep")
    pairs = _crossed(members, "component", F.col("near"), "shingles")
    found = _dealt(pairs, "component").mapInArrow(_confirmed(share), "a long, b long")
    return found.unionByName(star.where("near and rep != component").select(F.col("rep").alias("a"), F.col("component").alias("b")))


def components_of(docs: DataFrame, shingle: int = 5, share: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: components of the links between documents that share share[0] of share[1]
    parts of the union of their sets of `shingle`-word shingles (letters A-Z without case)."""
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    profile = written(given.mapInArrow(_profile(shingle), "doc_id long, n long, s1 long, s2 long, sketch binary"), "profile")
    same = ["n", "s1", "s2"]
    solid = profile.where("n > 0 and doc_id is not null")
    reps = written(solid.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.min("sketch").alias("sketch")), "reps")
    loose = written(components(loose_links(reps.select("rep", "sketch"), least_matches(share[0] / share[1]))).withColumnRenamed("id", "rep"), "loose")
    sizes = loose.join(reps.select("rep", "n"), "rep").groupBy("component").agg(_block_count(F.col("n")).alias("blocks"))
    close = written(join_dealt(loose, sizes, ["component"], "rep", HOT), "close")
    held = "component long, rep long, n long, shingles binary"
    members = lambda some: given.join(some, given.doc_id == some.rep).select("rep", "component", "text").dropDuplicates(["rep"]).mapInArrow(_sets(shingle), held)
    small = members(close.where("blocks = 1")).withColumns({"bi": F.lit(0), "bj": F.lit(0)})
    links = small.repartition("component").sortWithinPartitions("component").select("component", "bi", "bj", "rep", "shingles").mapInArrow(_confirmed(share), "a long, b long")
    if not close.where("blocks > 1").isEmpty():
        links = links.unionByName(_large_links(written(members(close.where("blocks > 1")), "sets"), share))
    final = components(links).withColumnRenamed("id", "rep")
    of = reps.select(*same, "rep").join(final, "rep", "left").select(*same, F.coalesce("component", "rep").alias("component_id"))
    alone = F.col("n").eqNullSafe(0) | F.col("doc_id").isNull()
    linked = join_dealt(profile.where("n > 0").where(~alone).select("doc_id", *same), of, same, "doc_id", HOT)
    return linked.select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(profile.where(alone).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def op3_near_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = components_of(docs, shingle=3, share=(85, 100))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
