"""Suffix-array dedup: removes bytes that repeat a string of `width` bytes which starts earlier in the corpus.

Method: hash-compared suffix sort. Suffixes are sorted by mergesort; two suffixes are compared by their longest common extension, which a binary search over prefix
polynomial hashes finds in a logarithmic number of steps, and by the byte after it. The common extensions of neighbours in the sorted order are then compared byte by byte:
where a hash has lied the suffixes are sorted again by their bytes.

What is sorted. Any two equal windows of `width` bytes hold the same anchor (the smallest hash of `core` bytes in them) at the same place, so only suffixes that start at anchors are
sorted, one for some `width / 2` bytes, and each only against those of equal anchors, to the right (the suffix from the anchor) and to the left (that of the reversed text before it). A
window occurs earlier exactly if an earlier anchor's extensions to both sides reach its ends. Anchors that occur once are no-one's copies and go no further. Of those that occur with
the same windows around them (equal bytes, known by a 128-bit BLAKE2 digest) all but the first are settled at once; only the first of each such class is sorted, and only where an anchor has several
classes. The classes of an anchor of more than HOT (a frequent phrase in ever new surroundings) don't meet in one task: each of their windows goes on as a row known by its
digest, and Spark's windows, dealt in shares first, mark all but the first.

Texts are shuffled once, by id: the pass that cuts out what is to be sorted and the one that removes bytes read the same exchange.

Defined results: a null or empty text has no bytes and keeps none; a text shorter than `width` loses nothing. Rows with a null id are returned whole and are nobody's source. Rows that share an
id are parts of one document, in the order of a hash of their text: a repeated row repeats its first and loses what the first keeps. Ids must be integers. Very long texts
are read whole, in blocks that overlap by a window. Removed bytes may cut characters, so what is kept is binary. Extra columns are left out. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops as X
from .frames import HOT_KEYS, for_shares, in_shares, join_dealt, written

#: Bytes of one text handled at once; classes of an anchor that meet in one task; and shares that equal windows of hot anchors are dealt to first.
BLOCK, HOT, SHARES = 1 << 22, 4096, 64
#: Anchors of a key that go to one task where the repeated ones are picked.
MANY = 20_000
#: `at` packs the place of an anchor, how far before it its first window starts, and how many more windows follow.
BITS = 10
LOW = (1 << BITS) - 1
_U = np.uint64


def core_of(width: int) -> int:
    if not 5 <= width < LOW:
        raise ValueError(f"a width from 5 to {LOW - 1} is asked for")
    return max(2, width // 5)


def anchors_of(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(key, text index, place in the text, first window start in data, number of windows) of the anchors of texts data[offsets[i]:offsets[i+1]]."""
    core = core_of(width)
    span = width - core + 1
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    for lo in range(0, max(len(data) - width + 1, 0), BLOCK):
        part = data[lo : lo + BLOCK + width - 1]
        own = owner[lo : lo + BLOCK + width - 1]
        hashes = X.fold(X._BYTE[part], core, 0)
        low = (hashes & ~_U(0xFFFFFF)) | np.arange(len(hashes), dtype=np.uint64)
        step = 1
        while step * 2 <= span:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        if span > step:
            low = np.minimum(low[: -(span - step)], low[span - step :])
        at = np.flatnonzero(own[: len(low)] == own[width - 1 :])
        if not len(at):
            continue
        anchor = (low[at] & _U(0xFFFFFF)).astype(np.int64)
        head = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        n = np.diff(np.append(head, len(at)))
        first, anchor = at[head], anchor[head]
        text = own[anchor]
        yield hashes[anchor], text, anchor + lo - offsets[text], first + lo, n


def _pack(place: np.ndarray, before: np.ndarray, n: np.ndarray) -> np.ndarray:
    return (place << (2 * BITS)) | (before << BITS) | (n - 1)


def _keys(width: int):
    """(key, n) for the anchors of each chunk of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in X.chunks(batch, "text"):
                for key, *_ in anchors_of(data, offsets, width):
                    u, n = np.unique(key, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n)], names=["key", "n"])

    return run


def _anchors(width: int):
    """(key, digest, doc_id, at): the digest is that of all bytes that the anchor's windows cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, base = batch.column("doc_id").to_numpy(), batch.column("base").to_numpy()
            for rows, data, offsets in X.chunks(batch, "text"):
                raw = data.tobytes()
                for key, text, place, first, n in anchors_of(data, offsets, width):
                    before = place + offsets[text] - first
                    digests = b"".join([hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(first.tolist(), (first + n - 1 + width).tolist(), strict=True)])
                    digest = pa.Array.from_buffers(pa.binary(), len(key), [None, pa.py_buffer(np.arange(0, 16 * len(key) + 1, 16, dtype=np.int32)), pa.py_buffer(digests)])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.view(np.int64)), digest, pa.array(ids[rows][text]), pa.array(_pack(place + base[rows][text], before, n))], names=["key", "digest", "doc_id", "at"]
                    )

    return run


def _asked(batch: pa.RecordBatch) -> Iterator[tuple[bytes, int, int, np.ndarray, np.ndarray]]:
    """(bytes, id, base, keys, ats) of each row that has asked-for anchors in its own part of the document."""
    ids, bases, lists = batch.column("doc_id").to_pylist(), batch.column("base").to_pylist(), batch.column("asked")
    text = batch.column("text")
    for i, (doc, base) in enumerate(zip(ids, bases, strict=True)):
        raw = (text[i].as_py() or "").encode()
        own = lists[i].values
        key, at = own.field("key").to_numpy(), own.field("at").to_numpy()
        place = (at >> (2 * BITS)) - base
        fits = (place >= 0) & (place < len(raw))
        if fits.any():
            yield raw, doc, base, key[fits], at[fits]


def _bodies(width: int):
    """(key, doc_id, at, body): the bytes that the windows of each asked-for anchor cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, doc, base, key, at in _asked(batch):
                lo = (at >> (2 * BITS)) - base - ((at >> BITS) & LOW)
                body = [raw[a:b] for a, b in zip(lo.tolist(), (lo + (at & LOW) + width).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(key), doc)), pa.array(at), pa.array(body, pa.binary())], names=["key", "doc_id", "at", "body"])
            X.release()

    return run


def _windows(width: int):
    """(digest, doc_id, start) of each window of the asked-for anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, doc, base, _, at in _asked(batch):
                n = (at & LOW) + 1
                start = np.repeat((at >> (2 * BITS)) - base - ((at >> BITS) & LOW), n) + X.ranges(n)
                digests = [hashlib.blake2b(raw[a : a + width], digest_size=16).digest() for a in start.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(np.full(len(start), doc)), pa.array(start + base)], names=["digest", "doc_id", "start"])
            X.release()

    return run


class Suffixes:
    """Strings data[start:end] that are compared by prefix polynomial hashes."""

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray):
        self.data, self.start, self.length = data, start, end - start
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(X._BYTE[data] * X.powers(0, n), out=self.sums[1:])
        self.back = X.powers(0, n + 1, True)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many bytes i and j have in common at their beginning, as far as hashes tell."""
        a, b = self.start[i], self.start[j]
        sa, sb, ba, bb = self.sums[a], self.sums[b], self.back[a], self.back[b]
        lo, hi = np.zeros(len(i), np.int64), np.minimum(self.length[i], self.length[j])
        for _ in range(int(hi.max(initial=0)).bit_length()):
            mid = (lo + hi + 1) >> 1
            same = (self.sums[a + mid] - sa) * ba == (self.sums[b + mid] - sb) * bb
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def less(self, i: np.ndarray, j: np.ndarray, common: np.ndarray | None = None) -> np.ndarray:
        """Whether i stands before j: the byte after what they have in common decides, else the length."""
        c = self.common(i, j) if common is None else common
        ended = (c >= self.length[i]) | (c >= self.length[j])
        top = len(self.data) - 1
        x, y = self.data[np.minimum(self.start[i] + c, top)], self.data[np.minimum(self.start[j] + c, top)]
        return np.where(ended, self.length[i] < self.length[j], x < y)

    def sorted(self, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order of the suffixes within each group (groups start at `heads`), and what each has in common with the one before it (-1 for the first of a group)."""
        n = len(self.start)
        order, size = np.arange(n), np.diff(np.append(heads, n))
        top, tail = np.repeat(heads, size), np.repeat(heads + size, size)
        run = 1
        while run < int(size.max(initial=0)):
            slot = np.flatnonzero(tail - top > run)  # groups that are sorted already rest
            own = (slot - top[slot]) % (2 * run)
            pair, right = slot - own, own >= run
            lo = np.where(right, pair, np.minimum(pair + run, tail[slot]))
            hi = np.where(right, pair + run, np.minimum(pair + 2 * run, tail[slot]))
            item, sibling = order[slot], lo.copy()
            open_ = np.flatnonzero(lo < hi)
            while len(open_):  # merging: where a suffix belongs among those of the other run
                mid = (lo[open_] + hi[open_]) >> 1
                x, y = item[open_], order[mid]
                on = np.where(right[open_], ~self.less(x, y), self.less(y, x))
                lo[open_], hi[open_] = np.where(on, mid + 1, lo[open_]), np.where(on, hi[open_], mid)
                open_ = open_[lo[open_] < hi[open_]]
            to = pair + (own - np.where(right, run, 0)) + (lo - sibling)
            merged = order.copy()
            merged[to] = item
            order, run = merged, run * 2
        common = np.full(n, -1)
        at = np.setdiff1d(np.arange(n), heads)
        i, j = order[at - 1], order[at]
        common[at] = self.common(i, j)
        if not self._true(i, j, common[at]):
            order = np.array(sorted(range(n), key=lambda k: (top[k], self.bytes(k))), np.int64)
            common[at] = [self._count(a, b) for a, b in zip(order[at - 1].tolist(), order[at].tolist(), strict=True)]
        return order, common

    def bytes(self, k: int) -> bytes:
        return self.data[self.start[k] : self.start[k] + self.length[k]].tobytes()

    def _count(self, i: int, j: int) -> int:
        x, y = self.bytes(i), self.bytes(j)
        return next((k for k, (a, b) in enumerate(zip(x, y, strict=False)) if a != b), min(len(x), len(y)))

    def _true(self, i: np.ndarray, j: np.ndarray, common: np.ndarray) -> bool:
        """Whether the bytes agree with what the hashes said of neighbours."""
        step = X.ranges(common)
        a, b = np.repeat(self.start[i], common) + step, np.repeat(self.start[j], common) + step
        if not np.array_equal(self.data[a], self.data[b]):
            return False
        inside = (common < self.length[i]) & (common < self.length[j])
        if (self.data[(self.start[i] + common)[inside]] == self.data[(self.start[j] + common)[inside]]).any():
            return False
        return not self.less(j, i, common).any()


def repeated_windows(data: np.ndarray, ends: np.ndarray, at: np.ndarray, heads: np.ndarray, width: int) -> np.ndarray:
    """Which windows of anchors (rows, ordered by place; groups of equal anchors start at `heads`) an earlier row of the group has too: a matrix of rows and distances
    from the window's start to the anchor. Row i has the bytes data[ends[i]:ends[i+1]]."""
    n, before, more = len(at), (at >> BITS) & LOW, at & LOW
    anchor = ends[:-1] + before
    out = np.zeros((n, int(before.max(initial=0)) + 1), bool)
    r_order, r_common = Suffixes(data, anchor, np.minimum(ends[1:], anchor + width)).sorted(heads)
    size = len(data)
    l_order, l_common = Suffixes(np.ascontiguousarray(data[::-1]), size - anchor, size - ends[:-1]).sorted(heads)
    right, left = np.empty(n, np.int64), np.empty(n, np.int64)
    for d in range(out.shape[1]):
        rows = np.flatnonzero((before - more <= d) & (d <= before))
        if len(rows) < 2:
            continue
        right[r_order] = np.cumsum(r_common < width - d)
        left[l_order] = np.cumsum(l_common < d)
        code = right[rows] * (n + 1) + left[rows]
        by = np.argsort(code, kind="stable")
        same = code[by[1:]] == code[by[:-1]]
        out[rows[by[1:][same]], d] = True
    return out


def _runs(hits: np.ndarray, doc: np.ndarray, place: np.ndarray) -> list[pa.Array]:
    """(doc_id, start, n) of the marked windows: those of one row that follow each other are one run."""
    flat = np.zeros((len(hits), hits.shape[1] + 2), np.int8)
    flat[:, 1:-1] = hits
    edge = np.diff(flat, axis=1)
    row, lo = np.nonzero(edge == 1)
    _, hi = np.nonzero(edge == -1)
    return [pa.array(doc[row]), pa.array(place[row] - (hi - 1)), pa.array(hi - lo)]


def _sorted_groups(width: int):
    """Runs of repeated windows, from rows (key, doc_id, at, body) in that order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in X.whole_groups(batches, ["key"]):
            bounds = at if at[-1] == len(table) else np.append(at, len(table))
            lo = 0
            while lo < len(bounds) - 1:  # some thousand rows at once
                hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + 2 * HOT, "right")) - 1)
                part = table.slice(int(bounds[lo]), int(bounds[hi] - bounds[lo])).combine_chunks()
                body = part.column("body").combine_chunks() if isinstance(part.column("body"), pa.ChunkedArray) else part.column("body")
                _, offs, raw = body.cast(pa.large_binary()).buffers()
                body = body.cast(pa.large_binary())
                ends = np.frombuffer(offs, np.int64, len(body) + 1, body.offset * 8)
                data = np.frombuffer(raw, np.uint8)[ends[0] : ends[-1]]
                where = part.column("at").to_numpy()
                hits = repeated_windows(data, ends - ends[0], where, bounds[lo:hi] - bounds[lo], width)
                if hits.any():
                    yield pa.RecordBatch.from_arrays(_runs(hits, part.column("doc_id").to_numpy(), where >> (2 * BITS)), names=["doc_id", "start", "n"])
                lo = hi

    return run


def _cut(width: int):
    """(doc_id, n_bytes, n_removed, n_spans, kept) of texts with their runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bases, marks = batch.column("base").to_numpy(), batch.column("marks")
            for rows, data, offsets in X.chunks(batch, "text"):
                part = marks.slice(rows.start, rows.stop - rows.start)
                flat, lens = part.flatten(), part.value_lengths().fill_null(0).to_numpy()
                row = np.repeat(np.arange(len(lens)), lens)
                lo, size = np.zeros(0, np.int64), np.zeros(0, np.int64)
                if len(flat):
                    lo = flat.field("start").to_numpy() - bases[rows][row]
                    size = flat.field("n").to_numpy() - 1 + width
                fits = (lo >= 0) & (lo + size <= np.diff(offsets)[row])  # marks of another part of the document don't
                lo, size = lo[fits] + offsets[row[fits]], size[fits]
                edge = np.zeros(len(data) + 1, np.int64)
                np.add.at(edge, lo, 1)
                np.add.at(edge, lo + size, -1)
                gone = np.cumsum(edge[:-1]) > 0
                starts = gone.copy()
                starts[1:] &= ~gone[:-1]
                border = offsets[:-1][np.diff(offsets) > 0]
                starts[border] = gone[border]
                total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[offsets])
                kept = data[~gone]
                ends = np.concatenate([[0], np.cumsum(~gone)])[offsets].astype(np.int32)
                body = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(kept.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(rows.start, rows.stop - rows.start), pa.array(np.diff(offsets)), pa.array(total(gone)), pa.array(total(starts)), body],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
                )

    return run


def _placed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, base): base is where a row's text stands in its document, 0 unless ids repeat."""
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("doc_id is not null")
    if given.groupBy("doc_id").count().where("count > 1").isEmpty():
        return given.withColumn("base", F.lit(0).cast("long"))
    earlier = W.partitionBy("doc_id").orderBy(F.xxhash64("text")).rowsBetween(W.unboundedPreceding, -1)
    return written(given.withColumn("base", F.coalesce(F.sum(F.octet_length("text").cast("long")).over(earlier), F.lit(0).cast("long"))), "placed")


def _after_first(rows: DataFrame, keys: list[str | Column]) -> Column:
    return F.row_number().over(W.partitionBy(*keys).orderBy("doc_id", "start"))


def repeats(given: DataFrame, width: int) -> DataFrame:
    """(doc_id, start, n): runs of n windows, the first at `start`, that occur earlier. `given` has doc_id, text and base."""
    again = written(given.mapInArrow(_keys(width), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1"), "again")
    most = max(MANY, (again.agg(F.sum("n")).first()[0] or 0) // HOT_KEYS)
    # fewer than HOT_KEYS rows: each key has more than a HOT_KEYS-th part of these anchors
    hot = written(again.where(F.col("n") > most).select("key", F.ceil(F.col("n") / most).alias("_shares")), "hot")
    anchors = in_shares(given.mapInArrow(_anchors(width), "key long, digest binary, doc_id long, at long"), hot, ["key"], "doc_id")
    found = anchors.join(for_shares(again.select("key"), hot, ["key"]), ["key", "_share"]).drop("_share")
    found = written(found.withColumn("shape", F.col("at").bitwiseAND((1 << (2 * BITS)) - 1)), "anchors")
    kind = ["key", "digest", "shape"]
    classes = written(found.groupBy(*kind).agg(F.min(F.struct("doc_id", "at")).alias("first"), F.count("*").alias("n")), "classes")
    firsts = classes.where("n > 1").select(*kind, "first")
    windows = (F.col("at").bitwiseAND(LOW) + 1).alias("n")
    start = (F.shiftright("at", 2 * BITS) - F.shiftright("at", BITS).bitwiseAND(LOW)).alias("start")
    settled = join_dealt(found, firsts, kind, "doc_id").where("doc_id != first.doc_id or at != first.at").select("doc_id", start, windows)
    settled = written(settled, "settled")
    several = classes.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    met = written(join_dealt(classes.select("key", "first.doc_id", "first.at"), several, ["key"], "doc_id"), "met")

    def asked(which: str) -> DataFrame:
        lists = met.where(which).groupBy("doc_id").agg(F.collect_list(F.struct("key", "at")).alias("asked"))
        return given.join(lists, "doc_id")

    parts = [settled]
    if not met.where(f"m <= {HOT}").isEmpty():
        bodies = asked(f"m <= {HOT}").mapInArrow(_bodies(width), "key long, doc_id long, at long, body binary")
        parts.append(bodies.repartition("key").sortWithinPartitions("key", "doc_id", "at").mapInArrow(_sorted_groups(width), "doc_id long, start long, n long"))
    if not met.where(f"m > {HOT}").isEmpty():
        dealt = asked(f"m > {HOT}").mapInArrow(_windows(width), "digest binary, doc_id long, start long").withColumn("share", F.pmod(F.xxhash64("doc_id", "start"), F.lit(SHARES)))
        dealt = dealt.withColumn("rank", _after_first(dealt, ["digest", "share"]))
        last = dealt.where("rank = 1").select("digest", "doc_id", "start")
        later = dealt.where("rank > 1").select("doc_id", "start").unionByName(last.withColumn("rank", _after_first(last, ["digest"])).where("rank > 1").select("doc_id", "start"))
        parts.append(later.withColumn("n", F.lit(1).cast("long")))
    marks = parts[0]
    for p in parts[1:]:
        marks = marks.unionByName(p)
    return marks


def suffix_dedup(docs: DataFrame, width: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept), one row per row of docs."""
    if not isinstance(docs.schema[id_col].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise TypeError(f"{id_col} must be an integer")
    given = _placed(docs, id_col, text_col)
    marks = repeats(given, width).groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("marks"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    done = given.join(marks, "doc_id", "left").mapInArrow(_cut(width), schema)
    text = F.coalesce(F.col(text_col), F.lit(""))
    zero = F.lit(0).cast("long")
    rest = docs.where(F.col(id_col).isNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), text.cast("binary").alias("kept"))
    return done.unionByName(rest)


def op13_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    done = suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
