"""Line dedup: lines that many documents share stay only in the last document that holds them.

Method: sharded cuckoo filters backed by exact reference counts. The index is three tables in the shared folder: refs
(key, document), counts (key, documents, last document) and filters (one cuckoo filter per shard, over the keys that at
least `least` documents hold). A document's lines are first looked up in the filter of their shard; only hits go on to the exact join
with the counts, so a false hit costs a row and never a line. insert() and delete() touch the counts of the keys concerned and add
or remove fingerprints of keys that cross the threshold, so deleting documents brings back what their lines had removed.

A line's key is known by the 128-bit hash of its stripped and lower-cased bytes, in all tables.

Defined results: a null or empty text is one empty line; a line without `chars` code points (after stripping) is never
dropped; repeated lines of one document count once as a document, and so do all rows of one id; of the rows of the last id that holds a line each keeps it. A row
with a null id neither counts nor loses lines. A very long text or line is handled whole. An input column named like an output is replaced. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops as X
from .frames import without, written

STRIP = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Keys per shard, and lines that one task looks up.
SHARD_KEYS, LOOKUPS = 500_000, 500_000
#: Documents of one line that go to one task when the exact counts are joined; lines of more are dealt out.
HOT = 100_000
SLOTS = 4
#: Partitions that are asked for at most; tasks of a larger number of lines just take more of them.
MOST_TASKS = 10_000


class CuckooFilter:
    """Approximate set of 64-bit hashes that supports deletion: 16-bit fingerprints in two possible buckets."""

    def __init__(self, table: np.ndarray):
        self.table = table

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        buckets = 1 << max(2, int(np.ceil(np.log2(max(keys, 1) / (0.8 * SLOTS)))))
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    @classmethod
    def of(cls, data: bytes) -> CuckooFilter:
        return cls(np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy())

    def bytes(self) -> bytes:
        return self.table.tobytes()

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = X.mix(hashes.astype(np.int64).view(np.uint64) ^ np.uint64(0x2545F4914F6CDD1D))
        prints = (h >> np.uint64(48)).astype(np.uint16)
        prints[prints == 0] = 1
        mask = np.uint64(len(self.table) - 1)
        one = h & mask
        return prints, one.astype(np.int64), (one ^ self._jump(prints)).astype(np.int64)

    def _jump(self, prints: np.ndarray) -> np.ndarray:
        return X.mix(prints.astype(np.uint64)) & np.uint64(len(self.table) - 1)

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        f, a, b = self._places(hashes)
        return (self.table[a] == f[:, None]).any(axis=1) | (self.table[b] == f[:, None]).any(axis=1)

    def insert(self, hashes: np.ndarray) -> np.ndarray:
        """Adds the hashes; returns those that found no place (then a larger filter must be built)."""
        lost = []
        for h, f, a, b in zip(hashes.tolist(), *(x.tolist() for x in self._places(hashes)), strict=True):
            at = a
            for kick in range(500):
                free = np.flatnonzero(self.table[at] == 0)
                if len(free):
                    self.table[at, free[0]] = f
                    break
                if kick == 0 and (free := np.flatnonzero(self.table[b] == 0)).size:
                    self.table[b, free[0]] = f
                    break
                slot = kick % SLOTS
                f, self.table[at, slot] = int(self.table[at, slot]), f
                at ^= int(self._jump(np.array([f], np.uint16))[0])
            else:
                lost.append(h)
        return np.array(lost, np.int64)

    def delete(self, hashes: np.ndarray) -> None:
        for f, a, b in zip(*(x.tolist() for x in self._places(hashes)), strict=True):
            for at in (a, b):
                if (slot := np.flatnonzero(self.table[at] == f)).size:
                    self.table[at, slot[0]] = 0
                    break


def filter_of(hashes: np.ndarray) -> CuckooFilter:
    """A filter that holds all the hashes."""
    room = len(hashes)
    while True:
        made = CuckooFilter.sized(room)
        if not len(made.insert(hashes)):
            return made
        room = 2 * len(made.table) * SLOTS


def _line_hash(line: bytes, chars: int) -> tuple[int, int] | None:
    import xxhash

    key = line.strip(STRIP)
    if len(key) < chars:
        return None
    key = key.lower()  # bytes: only A-Z
    if len(key) < 4 * chars and sum((c & 0xC0) != 0x80 for c in key) < chars if not key.isascii() else False:
        return None
    h = xxhash.xxh3_128_intdigest(key)
    return (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63)


def _refs(chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for rows, data, offsets in X.chunks(batch, "text"):
                raw, bounds = data.tobytes(), offsets.tolist()
                h1, h2, row = [], [], []
                for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    for x, y in {h for line in raw[a:b].split(b"\n") if (h := _line_hash(line, chars))}:
                        h1.append(x), h2.append(y), row.append(rows.start + i)
                if row:
                    yield pa.RecordBatch.from_arrays([pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), ids.take(pa.array(row))], names=["h1", "h2", "doc_id"])

    return run


def line_refs(docs: DataFrame, chars: int, id_col: str, text_col: str) -> DataFrame:
    """(h1, h2, doc_id): the distinct long lines of each document."""
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    return given.mapInArrow(_refs(chars), "h1 long, h2 long, doc_id long")


def _counts(refs: DataFrame) -> DataFrame:
    return refs.groupBy("h1", "h2").agg(F.count_distinct("doc_id").alias("documents"), F.max("doc_id").alias("last"))


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t, at in X.whole_groups(batches, ["shard"]):
        hashes, shard = t.column("h1").to_numpy(), t.column("shard").to_numpy()
        data = [filter_of(hashes[a:b]).bytes() for a, b in zip(at, at[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([pa.array(shard[at[:-1]]), pa.array(data, pa.binary())], names=["shard", "filter"])


def _change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard's filter (first row) with hashes taken out (step -1) and put in (step 1); null where they don't fit."""
    for t, at in X.whole_groups(batches, ["shard"]):
        for a, b in zip(at, at[1:], strict=False):
            part = t.slice(a, b - a)
            step, h1 = part.column("step").to_numpy(), part.column("h1").fill_null(0).to_numpy()
            old = [x for x in part.column("filter").to_pylist() if x is not None]
            made = CuckooFilter.of(old[0]) if old else CuckooFilter.sized(int((step == 1).sum()))
            made.delete(h1[step == -1])
            full = len(made.insert(h1[step == 1])) > 0
            yield pa.RecordBatch.from_arrays([part.column("shard").combine_chunks().slice(0, 1), pa.array([None if full else made.bytes()], pa.binary())], names=["shard", "filter"])


def _share(h1: np.ndarray, h2: np.ndarray, doc: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Which of the shares of its line's documents each row belongs to; hot: rows h1, h2, shares, ordered by (h1, h2)."""
    out = np.zeros(len(h1), np.int64)
    some = np.flatnonzero(np.isin(h1, hot[:, 0]))
    at = np.searchsorted(hot[:, 0], h1[some])
    while len(some):  # lines that agree in the first hash only stand next to each other
        found = hot[at, 1] == h2[some]
        rows = some[found]
        out[rows] = (X.mix(doc[rows].view(np.uint64)) % hot[at[found], 2].astype(np.uint64)).astype(np.int64)
        some, at = some[~found], at[~found] + 1
        more = at < len(hot)
        some, at = some[more], at[more]
        more = hot[at, 0] == h1[some]
        some, at = some[more], at[more]
    return out


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose hash may be in their shard's filter, with their line's share; the filter's row (kind 0) and the hot lines
    (kind 1, with the number of shares as their document) come before the shard's others."""
    shard, current, hot = None, None, np.zeros((0, 3), np.int64)
    for batch in batches:
        s, kind = batch.column("shard").to_numpy(), batch.column("kind").to_numpy()
        h1, h2, doc = (batch.column(c).fill_null(0).to_numpy() for c in ("h1", "h2", "doc_id"))
        keep, share = np.zeros(len(s), bool), np.zeros(len(s), np.int64)
        at = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (kind[1:] != kind[:-1])])) if len(s) else []
        for a, b in zip(at, [*at[1:], len(s)], strict=True):
            if s[a] != shard:
                shard, current, hot = s[a], None, np.zeros((0, 3), np.int64)
            if kind[a] == 0:
                current = CuckooFilter.of(batch.column("filter")[int(a)].as_py())
            elif kind[a] == 1:
                hot = np.unique(np.concatenate([hot, np.stack([h1[a:b], h2[a:b], doc[a:b]], axis=1)]), axis=0)
            elif current is not None:
                keep[a:b] = current.contains(h1[a:b])
                share[a:b] = _share(h1[a:b], h2[a:b], doc[a:b], hot)
        if keep.any():
            hit = batch.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([*[hit.column(c) for c in ("h1", "h2", "doc_id")], pa.array(share[keep])], names=["h1", "h2", "doc_id", "share"])


def _filters(shared: DataFrame, shards: int) -> DataFrame:
    keyed = shared.select(F.pmod("h1", F.lit(shards)).alias("shard"), "h1").repartition("shard").sortWithinPartitions("shard")
    return keyed.mapInArrow(_build, "shard long, filter binary")


class LineIndex:
    """Line counts of a corpus with the filters of its shared lines; immutable, changes give a new index."""

    def __init__(self, refs: DataFrame, counts: DataFrame, filters: DataFrame, shards: int, least: int, chars: int, id_col: str, text_col: str):
        self.refs, self.counts, self.filters, self.shards = refs, counts, filters, shards
        self.least, self.chars, self.id_col, self.text_col = least, chars, id_col, text_col

    @classmethod
    def build(cls, docs: DataFrame, least: int = 5, chars: int = 40, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        refs = written(line_refs(docs, chars, id_col, text_col), "refs")
        counts = written(_counts(refs), "counts")
        shared = counts.where(F.col("documents") >= least)
        shards = max(1, -(-shared.count() // SHARD_KEYS))
        filters = written(_filters(shared, shards), "filters")
        return cls(refs, counts, filters, shards, least, chars, id_col, text_col)

    def _changed(self, refs: DataFrame, touched: DataFrame) -> LineIndex:
        """The index with these refs, of which only the keys of `touched` differ."""
        keys = touched.select("h1", "h2").distinct()
        fresh = written(_counts(refs.join(keys, ["h1", "h2"], "left_semi")), "fresh")
        counts = written(self.counts.join(keys, ["h1", "h2"], "left_anti").unionByName(fresh), "counts")
        shared = counts.where(F.col("documents") >= self.least)
        asked = -(-shared.count() // SHARD_KEYS)
        if asked > self.shards:  # twice as many at least, so that a growing index is seldom built anew
            shards = max(asked, 2 * self.shards)
            return LineIndex(refs, counts, written(_filters(shared, shards), "filters"), shards, self.least, self.chars, self.id_col, self.text_col)
        was = self.counts.where(F.col("documents") >= self.least).join(keys, ["h1", "h2"], "left_semi").select("h1", "h2")
        now = fresh.where(F.col("documents") >= self.least).select("h1", "h2")
        shard = F.pmod("h1", F.lit(self.shards)).alias("shard")
        none = F.lit(None).cast("binary").alias("filter")
        steps = was.join(now, ["h1", "h2"], "left_anti").select(shard, "h1", F.lit(-1).alias("step"), none).unionByName(now.join(was, ["h1", "h2"], "left_anti").select(shard, "h1", F.lit(1).alias("step"), none))
        rows = self.filters.select("shard", F.lit(None).cast("long").alias("h1"), F.lit(0).alias("step"), "filter").unionByName(steps)
        filters = written(rows.repartition("shard").sortWithinPartitions("shard").mapInArrow(_change, "shard long, filter binary"), "filters")
        full = filters.where("filter is null").select("shard")
        if not full.isEmpty():
            again = _filters(shared.join(full, F.pmod(shared["h1"], F.lit(self.shards)) == full["shard"], "left_semi"), self.shards)
            filters = written(filters.where("filter is not null").unionByName(again), "filters")
        return LineIndex(refs, counts, filters, self.shards, self.least, self.chars, self.id_col, self.text_col)

    def insert(self, docs: DataFrame) -> LineIndex:
        new = written(line_refs(docs, self.chars, self.id_col, self.text_col), "refs")
        return self._changed(written(self.refs.unionByName(new), "refs"), new)

    def delete(self, ids: DataFrame) -> LineIndex:
        """ids: a frame whose first column is the ids of documents to take out."""
        gone = ids.select(F.col(f"`{ids.columns[0]}`").cast("long").alias("doc_id")).distinct()
        touched = written(self.refs.join(gone, "doc_id", "left_semi"), "touched")
        return self._changed(written(self.refs.join(gone, "doc_id", "left_anti"), "refs"), touched)

    def drops(self, refs: DataFrame) -> DataFrame:
        """(doc_id, h1, h2): the lines that documents lose. refs: a written table. As many tasks look lines up as there are
        LOOKUPS lines, each with its shard's filter."""
        salts = max(1, -(-refs.count() // (LOOKUPS * self.shards)))
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt")
        null = lambda c: F.lit(None).cast("binary" if c == "filter" else "long").alias(c)
        shares = F.ceil(F.col("documents") / HOT)
        shared = self.counts.where(F.col("documents") >= self.least).select("h1", "h2", "last", shares.alias("shares"))
        shard = F.pmod("h1", F.lit(self.shards)).alias("shard")
        filters = self.filters.select("shard", every, F.lit(0).alias("kind"), null("h1"), null("h2"), null("doc_id"), "filter")
        hot = shared.where("shares > 1").select(shard, every, F.lit(1).alias("kind"), "h1", "h2", F.col("shares").alias("doc_id"), null("filter"))
        lines = refs.select(shard, F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt"), F.lit(2).alias("kind"), "h1", "h2", "doc_id", null("filter"))
        rows = lines.unionByName(filters).unionByName(hot)
        dealt = rows.repartition(min(salts * self.shards, MOST_TASKS), "shard", "salt").sortWithinPartitions("shard", "salt", "kind")
        hits = dealt.mapInArrow(_probe, "h1 long, h2 long, doc_id long, share long")
        shared = shared.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1))).drop("shares")
        return hits.join(shared, ["h1", "h2", "share"]).where("doc_id < last").select("doc_id", "h1", "h2")

    def dedup(self, docs: DataFrame, refs: DataFrame | None = None) -> DataFrame:
        """docs with n_lines, n_dropped and, as its text, the lines that stay. refs: its line_refs as a written table, where at hand."""
        refs = written(line_refs(docs, self.chars, self.id_col, self.text_col), "refs") if refs is None else refs
        lost = self.drops(refs).groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list(F.struct("h1", "h2")).alias("_lost"))
        docs = without(docs, "n_lines", "n_dropped", "_id", "_lost")
        joined = docs.join(lost, F.col(self.id_col).cast("long") == F.col("_id"), "left").drop("_id")
        schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
        return joined.mapInArrow(_without_lines(self.chars, docs.columns, self.text_col), schema)


def _without_lines(chars: int, names: list[str], text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lost = batch.column("_lost")
            for rows, data, offsets in X.chunks(batch, text_col):
                raw, bounds = data.tobytes(), offsets.tolist()
                part = batch.slice(rows.start, rows.stop - rows.start)
                some = part.column("_lost").is_valid().to_numpy(zero_copy_only=False)
                lines, dropped, texts = [], [], []
                for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    text = raw[a:b]
                    lines.append(text.count(b"\n") + 1)
                    if some[i]:
                        gone = {(h["h1"], h["h2"]) for h in lost[rows.start + i].as_py()}
                        stay = [x for x in text.split(b"\n") if _line_hash(x, chars) not in gone]
                        text = b"\n".join(stay)
                        dropped.append(lines[-1] - len(stay))
                    else:
                        dropped.append(0)
                    texts.append(text)
                text = pa.array(texts, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*[text if c == text_col else part.column(c) for c in names], pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], names=[*names, "n_lines", "n_dropped"])

    return run


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    index = LineIndex.build(docs)
    return index.dedup(docs, index.refs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
shared AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT k.*, coalesce(k.doc_id < s.last, false) AS gone FROM keyed k LEFT JOIN shared s USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
