"""Substring dedup: removes words that repeat a passage which starts earlier in the corpus.

Method: De Bruijn compaction. Every window of `width` words is an edge of the De Bruijn graph of (width - 1)-word
nodes. Neighbouring edges that share their minimiser (the smallest hash of an inner `core`-word run) travel together as
one row, so a shuffle on the minimiser brings equal edges together at a fraction of a row per edge. Edges that occur
again are joined to the coordinate of their first occurrence. The edges of a minimiser of more than HOT rows (a passage or line that very many documents hold) don't
travel together: each goes on as a row of its own, keyed by its hash too, and Spark's aggregation finds its first occurrence; so do those of a minimiser that has too many
distinct ones to hold. Consecutive repeated edges whose sources are also consecutive are compacted into paths (one row per repeated span). Every path keeps its source coordinate; the words
of both ends are digested and compared, and only paths whose words agree are removed.

Defined results: a null or empty text has no words; a text of fewer than `width` words has no window. Rows whose id is
null are returned untouched, and are nobody's source. The id is expected to be unique; repeated rows of the same id and
text don't count as copies of each other and each get the same result. A very long text is handled whole, in blocks of words that overlap by a window. An empty table gives an
empty result. Extra columns of the input are kept; those named like an output or a mark used here (n_words, n_removed, kept_text, _checks, _text, _id, _spans) are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops as X
from .frames import HOT_KEYS, for_shares, hot_keys, in_shares, join_dealt, without, written

CORE = 8
#: Words of one text handled at once.
BLOCK = 1 << 22
EDGES = "anchor long, doc_id long, pos long, off int, hashes binary, n long, src_doc long, src_pos long"
RUNS = "doc_id long, pos long, n long, src_doc long, src_pos long"
#: Runs, and open edges: rows with a hash and without a source.
FOUND = RUNS + ", anchor long, hash long"
#: Distinct edges of one anchor that a task holds; and rows of an anchor, edge or source that go to one task where they meet.
HELD, HOT = 1 << 18, 20_000
_U = np.uint64


def _islands(doc, pos, sdoc, spos) -> np.ndarray:
    """Start indexes of runs in which position and source advance together (input ordered by doc, pos)."""
    if not len(pos):
        return np.zeros(0, np.int64)
    new = np.ones(len(pos), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + 1) | (sdoc[1:] != sdoc[:-1]) | (spos[1:] != spos[:-1] + 1)
    return np.flatnonzero(new)


def _runs(doc, pos, sdoc, spos) -> list[np.ndarray]:
    at = _islands(doc, pos, sdoc, spos)
    n = np.diff(np.append(at, len(pos)))
    return [doc[at], pos[at], n, sdoc[at], spos[at]]


def _edges_of(ids: np.ndarray, owner: np.ndarray, local: np.ndarray, hashes: np.ndarray, width: int) -> pa.RecordBatch | None:
    """Edge rows of a block of words, and finished runs for edges that repeat within the block."""
    win = X.fold(hashes, width, 1)
    core = X.fold(X.mix(hashes ^ _U(0x5851F42D4C957F2D)), CORE, 0)
    good = owner[: len(win)] == owner[width - 1 :]
    if not good.any():
        return None
    span = width - CORE + 1
    low = (core & ~_U(0xFFFFFF)) | np.arange(len(core), dtype=np.uint64)
    step = 1
    while step * 2 <= span:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if span > step:
        low = np.minimum(low[: -(span - step)], low[span - step :])
    at = np.flatnonzero(good)
    anchor = (low[at] & _U(0xFFFFFF)).astype(np.int64)
    win, key, doc, pos = win[at], core[anchor], ids[owner[at]], local[at]
    # edges that repeat in this block: all but the first of each are settled here
    fresh = np.ones(len(at), bool)
    heads = np.ones(len(at), bool)
    heads[1:] = anchor[1:] != anchor[:-1]
    u, times = np.unique(key[heads], return_counts=True)
    again = u[times > 1]
    done = [np.zeros(0, np.int64)] * 5
    if len(again):
        spot = np.minimum(np.searchsorted(again, key), len(again) - 1)
        some = np.flatnonzero(again[spot] == key)
        order = some[np.lexsort((pos[some], doc[some], win[some]))]
        same = np.zeros(len(order), bool)
        same[1:] = win[order[1:]] == win[order[:-1]]
        first = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
        here, there = order[same], first[same]
        keep = (doc[here] != doc[there]) | (pos[here] != pos[there])
        here, there = here[keep], there[keep]
        fresh[here] = False
        by = np.argsort(here, kind="stable")
        here, there = here[by], there[by]
        done = _runs(doc[here], pos[here], doc[there], pos[there])
    k = np.flatnonzero(fresh)
    start = np.ones(len(k), bool)
    start[1:] = (k[1:] != k[:-1] + 1) | (anchor[k[1:]] != anchor[k[:-1]])
    start = np.flatnonzero(start)
    first = k[start]
    rows, more = len(first), len(done[0])
    ends = np.append(start, len(k)) * 8
    blob = pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(win[k])])
    none = lambda n, t: pa.nulls(n, t)
    i64 = pa.int64()
    cat = lambda a, b: pa.concat_arrays([a, b])
    return pa.RecordBatch.from_arrays(
        [
            cat(pa.array(key[first].view(np.int64)), none(more, i64)),
            pa.array(np.concatenate([doc[first], done[0]])),
            pa.array(np.concatenate([pos[first], done[1]])),
            cat(pa.array((anchor[first] - at[first]).astype(np.int32)), none(more, pa.int32())),
            cat(blob, none(more, pa.binary())),
            cat(none(rows, i64), pa.array(done[2])),
            cat(none(rows, i64), pa.array(done[3])),
            cat(none(rows, i64), pa.array(done[4])),
        ],
        names=["anchor", "doc_id", "pos", "off", "hashes", "n", "src_doc", "src_pos"],
    )


def _edge_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            for rows, data, offsets in X.chunks(batch, "text"):
                words = X.find_words(data, offsets)
                hashes, owner = words.hashes(), words.owner()
                local = np.arange(len(hashes)) - words.first[:-1][owner] if len(owner) else owner
                for lo in range(0, max(len(hashes) - width + 1, 0), BLOCK):
                    part = slice(lo, lo + BLOCK + width - 1)
                    if (out := _edges_of(all_ids[rows], owner[part], local[part], hashes[part], width)) is not None:
                        yield out

    return run


def _anchor_counts(width: int):
    """(anchor, n): the edge rows of each anchor in a batch, and of all together (a null anchor)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _edge_rows(width)(batches):
            anchor = rows.column("anchor").drop_null().to_numpy()
            key, n = np.unique(anchor, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([*key.tolist(), None], pa.int64()), pa.array([*n.tolist(), len(anchor)], pa.int64())], names=["anchor", "n"])

    return run


def _placed(hashes: np.ndarray, place: np.ndarray) -> np.ndarray:
    """What tells edges of one anchor apart: their whole hash, and their place against the anchor."""
    return hashes ^ X.mix(place.astype(np.uint64) + _U(1))


def _opened(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Edge rows as open edges, one row each."""
    anchor, doc, pos, off = (batch.column(c).to_numpy() for c in ("anchor", "doc_id", "pos", "off"))
    column = batch.column("hashes")
    _, offs, data = column.buffers()
    ends = np.frombuffer(offs, np.int32, len(batch) + 1, column.offset * 4)
    count = np.diff(ends) // 8
    hashes = np.frombuffer(data, np.uint64, count=int(ends[-1] - ends[0]) // 8, offset=int(ends[0]))
    row, step = np.repeat(np.arange(len(anchor)), count), X.ranges(count)
    h = _placed(hashes, off[row] - step)
    none = pa.nulls(len(row), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(doc[row]), pa.array(pos[row] + step), none, none, none, pa.array(anchor[row]), pa.array(h.view(np.int64))], names=[x.split()[0] for x in FOUND.split(", ")])


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of edges that occurred before, from edge rows ordered by (anchor, doc_id, pos); rows marked _hot are opened. Memory: one batch and at
    most HELD distinct edges of the anchor that the batch ends in; the distinct edges of a larger anchor are passed on open."""
    names = [x.split()[0] for x in FOUND.split(", ")]
    last, held = None, None  # the anchor that may go on, and its distinct edges: hash, doc, pos
    passed = False  # whether the edges of that anchor are passed on

    def rows(run: list, key: list | None = None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*run, *(key or [pa.nulls(len(run[0]), pa.int64())] * 2)], names=names)

    for batch in batches:
        settled = batch.filter(batch.column("hashes").is_null())
        if len(settled):
            yield rows([settled.column(c) for c in names[:5]])
        batch = batch.filter(batch.column("hashes").is_valid())
        if "_hot" in batch.schema.names:
            hot = batch.filter(batch.column("_hot"))
            if len(hot):
                yield _opened(hot)
            batch = batch.filter(pc.invert(batch.column("_hot")))
        if not len(batch):
            continue
        anchor, doc, pos, off = (batch.column(c).to_numpy() for c in ("anchor", "doc_id", "pos", "off"))
        _, offs, data = batch.column("hashes").buffers()
        ends = np.frombuffer(offs, np.int32, len(batch) + 1, batch.column("hashes").offset * 4)
        count = np.diff(ends) // 8
        hashes = np.frombuffer(data, np.uint64, count=int(ends[-1] - ends[0]) // 8, offset=int(ends[0]))
        many = np.zeros(len(anchor), bool)
        many[1:] = anchor[1:] == anchor[:-1]
        many[:-1] |= many[1:]
        many |= anchor == anchor[-1]
        if last is not None:
            many |= anchor == last
        pick = np.repeat(many, count)
        row = np.repeat(np.arange(len(anchor)), count)[pick]
        step = X.ranges(count)[pick]
        # an edge is known by its anchor, its place against it, and its hash
        h, a, d, p = _placed(hashes[pick], off[row] - step), anchor[row], doc[row], pos[row] + step
        if held is not None and len(a) and a[0] == last:
            h, d, p = (np.concatenate(x) for x in zip(held, (h, d, p), strict=True))
            a = np.concatenate([np.full(len(h) - len(a), last), a])
        order = np.lexsort((h, a))
        same = np.zeros(len(order), bool)
        x, y = order[1:], order[:-1]
        same[1:] = (h[x] == h[y]) & (a[x] == a[y])
        first = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
        here, there = order[same], first[same]
        keep = (d[here] != d[there]) | (p[here] != p[there])
        here, there = here[keep], there[keep]
        by = np.lexsort((p[here], d[here]))
        here, there = here[by], there[by]
        if len(here):
            yield rows([pa.array(v) for v in _runs(d[here], p[here], d[there], p[there])])
        distinct = order[~same]
        on = (a[distinct] == last) if passed else np.zeros(len(distinct), bool)
        passed = bool(passed and anchor[-1] == last)
        last = anchor[-1]
        tail = distinct[a[distinct] == last]
        passed |= len(tail) > HELD
        if passed:
            on |= a[distinct] == last
            tail = tail[:0]
        if on.any():
            k, none = np.sort(distinct[on]), pa.nulls(int(on.sum()), pa.int64())
            yield rows([pa.array(d[k]), pa.array(p[k]), none, none, none], [pa.array(a[k]), pa.array(h[k].view(np.int64))])
        tail = np.sort(tail)
        held = (h[tail], d[tail], p[tail])


def _closed(found: DataFrame) -> DataFrame:
    """The runs, and one for each open edge that occurs earlier among the open ones."""
    runs, edges = found.where("hash is null").drop("anchor", "hash"), found.where("hash is not null").select("anchor", "hash", "doc_id", "pos")
    first = edges.groupBy("anchor", "hash").agg(F.min(F.struct("doc_id", "pos")).alias("src"), F.count("*").alias("times")).where("times > 1").drop("times")
    again = join_dealt(edges, first, ["anchor", "hash"], "doc_id", HOT).where("doc_id != src.doc_id or pos != src.pos")
    return runs.unionByName(again.select("doc_id", "pos", F.lit(1).cast("long").alias("n"), F.col("src.doc_id").alias("src_doc"), F.col("src.pos").alias("src_pos")))


def repeated_paths(docs: DataFrame, width: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Compacted repeated paths: doc_id, pos, n (edges), src_doc, src_pos. The words pos .. pos + n + width - 2 of
    doc_id equal those that start at src_pos in src_doc, which is earlier."""
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    counts = given.mapInArrow(_anchor_counts(width), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    counts = written(counts.where(F.col("anchor").isNull() | (F.col("n") > HOT)), "anchors")
    total = counts.where("anchor is null").agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    # fewer than HOT_KEYS rows: each has more than a HOT_KEYS-th part of all edge rows
    hot = counts.where(F.col("anchor").isNotNull() & (F.col("n") > total // HOT_KEYS)).select("anchor", F.lit(True).alias("_hot"))
    edges = given.mapInArrow(_edge_rows(width), EDGES).join(F.broadcast(hot), "anchor", "left").withColumn("_hot", F.coalesce("_hot", F.lit(False)))
    # an edge without an anchor is settled; it is dealt out by its document, and so are those of hot anchors
    by = F.coalesce(F.when(~F.col("_hot"), F.col("anchor")), F.xxhash64("doc_id", "pos"))
    found = edges.repartition(by).sortWithinPartitions("anchor", "doc_id", "pos").mapInArrow(_repeats, FOUND)
    runs = _closed(written(found, "found"))
    line = W.partitionBy("doc_id").orderBy("src_doc", F.col("src_pos") - F.col("pos"), "pos")
    follows = (F.lag("src_doc").over(line) == F.col("src_doc")) & (F.lag(F.col("src_pos") + F.col("n")).over(line) == F.col("src_pos")) & (F.lag(F.col("pos") + F.col("n")).over(line) == F.col("pos"))
    runs = runs.withColumn("new", F.when(follows, 0).otherwise(1)).withColumn("path", F.sum("new").over(line))
    return runs.groupBy("doc_id", "path").agg(F.min("pos").alias("pos"), F.sum("n").alias("n"), F.min("src_doc").alias("src_doc"), F.min("src_pos").alias("src_pos")).drop("path")


def _cut(width: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column("_spans")
            for rows, data, offsets in X.chunks(batch, "_text"):
                words = X.find_words(data, offsets)
                n, raw = len(words.starts), data.tobytes()
                edge = np.zeros(n + 1, np.int64)
                part = spans.slice(rows.start, rows.stop - rows.start)
                flat, lens = part.flatten(), part.value_lengths().fill_null(0).to_numpy()
                digests = []
                if len(flat):
                    lo = words.first[:-1][np.repeat(np.arange(len(lens)), lens)] + flat.field("pos").to_numpy()
                    hi = lo + flat.field("n").to_numpy() + width - 1
                    cut = flat.field("cut").to_numpy(zero_copy_only=False)
                    np.add.at(edge, lo[cut], 1)
                    np.add.at(edge, hi[cut], -1)
                    for a, b in zip(words.starts[lo].tolist(), words.ends[hi - 1].tolist(), strict=True):
                        digests.append(hashlib.blake2b(b" ".join(raw[a:b].split()), digest_size=16).digest())
                gone = np.cumsum(edge)[:n] > 0
                sums = np.concatenate([[0], np.cumsum(gone)])
                removed = sums[words.first[1:]] - sums[words.first[:-1]]
                kept = np.flatnonzero(~gone)
                # copy the kept words, each followed by a space, into one buffer
                size = words.ends[kept] - words.starts[kept] + 1
                out = np.full(int(size.sum()), 0x20, np.uint8)
                ends = np.cumsum(size)
                mark = np.zeros(len(data) + 1, np.int8)
                mark[words.starts[kept]] = 1
                mark[words.ends[kept]] -= 1
                body = np.ones(len(out), bool)
                body[ends - 1] = False
                out[body] = data[np.cumsum(mark[:-1], dtype=np.int8) > 0]
                stop = np.concatenate([[0], ends])[np.searchsorted(kept, words.first)]
                start, stop = stop[:-1], np.maximum(stop[1:] - 1, stop[:-1])
                joined = out.tobytes()
                texts = pa.array([joined[a:b].decode() for a, b in zip(start.tolist(), stop.tolist(), strict=True)], pa.string())
                flat = pa.StructArray.from_arrays([flat.field("pos"), flat.field("n"), flat.field("cut"), pa.array(digests, pa.binary())], names=["pos", "n", "cut", "digest"])
                checks = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)), flat)
                rest = [batch.column(c).slice(rows.start, rows.stop - rows.start) for c in names]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(np.diff(words.first)), pa.array(removed), texts, checks], names=[*names, "n_words", "n_removed", "kept_text", "_checks"])

    return run


def remove_paths(docs: DataFrame, paths: DataFrame, width: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with n_words, n_removed, kept_text (the kept words joined by one space) and _checks: the digest of the words
    of each path that ends (cut) or starts (not cut) in the document. A document has at most one row for each of its spans."""
    asked = paths.select("doc_id", "pos", "n", F.lit(True).alias("cut")).unionByName(paths.select(F.col("src_doc").alias("doc_id"), F.col("src_pos").alias("pos"), "n", F.lit(False).alias("cut")).distinct())
    spans = asked.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list(F.struct("pos", "n", "cut")).alias("_spans"))
    rest = without(docs, "n_words", "n_removed", "kept_text", "_checks", "_text", "_id", "_spans", text_col)
    names = rest.columns
    joined = docs.select(*[f"`{c}`" for c in names], F.col(text_col).alias("_text")).join(spans, F.col(id_col).cast("long") == F.col("_id"), "left").drop("_id")
    schema = T.StructType([*rest.schema.fields, *T._parse_datatype_string("n_words long, n_removed long, kept_text string, _checks array<struct<pos:long,n:long,cut:boolean,digest:binary>>").fields])
    return joined.mapInArrow(_cut(width, names), schema)


def substring_dedup(docs: DataFrame, width: int = 20, id_col: str = "doc_id", text_col: str = "text", finish: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """docs (without the text) with n_words, n_removed and kept_text. `finish` is applied to the result before it is
    written to the shared folder; it must keep the id and _checks, which goes at last."""
    paths = written(repeated_paths(docs, width, id_col, text_col), "paths")
    result = written(finish(remove_paths(docs, paths, width, id_col, text_col)), "cut")
    ends = result.select(F.col(id_col).alias("doc_id"), F.explode("_checks").alias("c")).select("doc_id", "c.*").dropDuplicates(["doc_id", "pos", "n", "cut"])
    copies = paths.join(ends.where("cut").drop("cut"), ["doc_id", "pos", "n"])
    sources = ends.where("not cut").select(F.col("doc_id").alias("src_doc"), F.col("pos").alias("src_pos"), "n", F.col("digest").alias("there"))
    source = ["src_doc", "src_pos", "n"]
    hot = hot_keys(paths, source, HOT)
    wrong = in_shares(copies, hot, source, "doc_id").join(for_shares(sources, hot, source), [*source, "_share"]).where("digest != there").select(*paths.columns)
    if wrong.isEmpty():
        return result.drop("_checks")
    # hashes agreed but words don't: the documents concerned are done again without those paths
    wrong = written(wrong, "wrong")
    at = wrong.select(F.col("doc_id").alias(id_col)).distinct()
    right = paths.join(wrong, paths.columns, "left_anti")
    again = finish(remove_paths(docs.join(at, id_col, "left_semi"), right.join(at, right.doc_id == at[id_col], "left_semi"), width, id_col, text_col))
    return result.join(at, id_col, "left_anti").unionByName(again).drop("_checks")


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = substring_dedup(docs, finish=lambda df: df.withColumn("kept_sha256", F.sha2("kept_text", 256)).drop("kept_text"))
    return done.select("doc_id", "n_words", "n_removed", "kept_sha256")
