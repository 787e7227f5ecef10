"""Mixing sources to target weights: which blocks of which source go into the mix, and how often.

Method: the words of each source, in a fixed pseudorandom order of its documents, are packed into blocks of `block` words (a block may hold parts
of several documents). Every source gets a number of slots from its target. For each output shard the numbers of its slots that fall to the
sources are drawn from a multinomial over the sources' shares, so every shard is mixed like the whole; a source's slots are numbered through its
shards, and the numbers are stretched by the small share by which all draws together miss its target, so that the totals are exact. The slots of a source are
mapped to its blocks by index through pseudorandom permutations (one for each epoch: a Feistel network with cycle walking, so that no
permutation is ever stored), and slots and blocks are joined by (source, index). A source is repeated at most twice, and each epoch takes a
block at most once, so no document exceeds twice its size.

Targets: sources in code point order (null last) weigh 3, 1, 2, repeating, and share `ratio` of all words; a target
stops at `most` times its source's size and the excess goes to the others by weight, until none is above (solved at once by
ordering the sources by size against weight).

The number of slots is the target in blocks, rounded, so a source's taken words miss its target by about a block at most.
Everything is a function of the rows and the seed: reruns agree. What is gathered on the driver is one row for each source.

Defined results: a null or empty text has size 0 and is never taken; a null source is a source of its own; rows with a
null id take part like others; a row is known by the hashes of its id, source and whole text and by its number among equal rows, so repeated rows of
an id are documents of their own and no text is read for another. Of rows equal in these, the other columns may be given in any order. Input columns named like the
marks used here (`_k1`, `_k2`, `_copy`, `_epoch`, `_parts`) are kept by documents and don't disturb. A very long text is many parts of blocks, each cut from the whole text. Ties
in size change nothing. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops as X
from .frames import written

BLOCK_WORDS, SHARD_SLOTS, SEED = 128, 100_000, 5
#: Documents that a running sum goes over in one task.
STRIDE = 1024
#: Slots that a task makes from their counts; and the most tasks that are asked for.
TASK_SLOTS, MOST_TASKS = 50_000, 10_000
KEY = ["k1", "k2", "copy"]
# The weights of the sources in turn.
WEIGHTS = (3, 1, 2)
_U = np.uint64


def _keys(doc_id, source, text) -> list:
    """Two hashes (128 bits) of a row's id, source and whole text."""
    parts = [F.isnull(doc_id), F.coalesce(doc_id, F.lit(0)), F.isnull(source), F.coalesce(source, F.lit("")), F.coalesce(text, F.lit(""))]
    return [F.xxhash64(F.lit(seed), *parts) for seed in (1, 2)]


def _copy(k1: str, k2: str, order: list):
    """The number of a row among the rows with its hashes."""
    return F.row_number().over(W.partitionBy(k1, k2).orderBy(*order)).cast("long")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, offsets in X.chunks(batch, "text"):
            part = batch.slice(rows.start, rows.stop - rows.start)
            size = np.diff(X.find_words(data, offsets).first)
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("doc_id", "source", "k1", "k2")], pa.array(size)], names=["doc_id", "source", "k1", "k2", "size"])


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, k1, k2, size in words, copy)."""
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    k1, k2 = _keys(F.col("doc_id"), F.col("source"), F.col("text"))
    counted = given.withColumns({"k1": k1, "k2": k2}).mapInArrow(_count, "doc_id long, source string, k1 long, k2 long, size long")
    return counted.withColumn("copy", _copy("k1", "k2", ["size"]))


def targets(sized: DataFrame, ratio: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, rank, source_size, target): one row per source, so the windows over all of them are small."""
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by = by.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())).cast("long"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), ((F.col("rank") - 1) % len(WEIGHTS) + 1).cast("int"))
    by = by.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    order = W.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    level = (ratio * F.sum("source_size").over(W.partitionBy()) - before) / F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    by = by.withColumn("level", level)
    # the level of the first source that stays below its cap holds for all after it
    by = by.withColumn("level", F.min(F.when(F.col("cap") > F.col("level") * F.col("weight"), F.struct((F.col("cap") / F.col("weight")).alias("o"), "rank", "level"))).over(W.partitionBy())["level"])
    return by.select("source", "rank", "source_size", F.when(F.col("cap") <= F.col("level") * F.col("weight"), F.col("cap")).otherwise(F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def packed(sized: DataFrame, plan: DataFrame, documents: int, block: int = BLOCK_WORDS) -> DataFrame:
    """(rank, index, k1, k2, copy, start, words): the parts of documents that each block holds. The running sum over a
    source goes through strides of its documents, so a source of any size is many tasks' work."""
    strides = max(1, documents // STRIDE)
    rows = sized.where("size > 0").join(plan.select("source", "rank"), sized.source.eqNullSafe(plan.source)).select("rank", *KEY, "size")
    rows = rows.withColumn("stride", F.pmod(F.xxhash64("k1", "copy", F.lit(SEED)), F.lit(strides)))
    sums = rows.groupBy("rank", "stride").agg(F.sum("size").alias("all"))
    sums = sums.select("rank", "stride", (F.sum("all").over(W.partitionBy("rank").orderBy("stride")) - F.col("all")).alias("base"))
    place = W.partitionBy("rank", "stride").orderBy(*KEY)
    rows = rows.withColumn("end", F.sum("size").over(place.rowsBetween(W.unboundedPreceding, 0))).join(sums, ["rank", "stride"])
    rows = rows.withColumn("end", F.col("base") + F.col("end")).withColumn("begin", F.col("end") - F.col("size"))
    parts = rows.withColumn("index", F.explode(F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("end") - 1) / block))))
    low, high = F.greatest("begin", F.col("index") * block), F.least("end", (F.col("index") + 1) * block)
    return parts.select("rank", "index", *KEY, (low - F.col("begin")).alias("start"), (high - low).alias("words"))


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Places of index under the permutation of 0..n-1 that key names: a Feistel network over the next power of four,
    walked until it is below n."""
    half = np.maximum(1, np.ceil(np.log2(np.maximum(n, 2)) / 2)).astype(np.uint64)
    mask = (_U(1) << half) - _U(1)
    out = index.astype(np.uint64)
    todo = np.ones(len(out), bool)
    while todo.any():
        a, b = out[todo] >> half[todo], out[todo] & mask[todo]
        for r in range(4):
            a, b = b, a ^ (X.mix(b + key[todo] + _U(r * 0x9E3779B97F4A7C15 % 2**64)) & mask[todo])
        out[todo] = (a << half[todo]) | b
        todo[todo] = out[todo] >= n[todo].astype(np.uint64)
    return out.astype(np.int64)


def _draw(want: list[tuple[int, int, int]], shards: int, seed: int):
    """For each shard a multinomial draw of its slots over the sources (rank, blocks, slots)."""
    rank, blocks, slots = (np.array(x, np.int64) for x in zip(*want, strict=True))
    total = int(slots.sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column("id").to_pylist():
                size = total // shards + (shard < total % shards)
                n = np.random.default_rng([seed, shard]).multinomial(size, slots / total)
                yield pa.RecordBatch.from_arrays([pa.array(rank), pa.array(blocks), pa.array(slots), pa.array(np.full(len(rank), shard)), pa.array(n.astype(np.int64))], names=["rank", "blocks", "slots", "shard", "n"])

    return run


def _map_slots(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank, blocks, shard, slot = (batch.column(c).to_numpy() for c in ("rank", "blocks", "shard", "slot"))
            epoch = slot // np.maximum(blocks, 1)
            key = X.mix(rank.astype(np.uint64) + _U(seed) * _U(1_000_003)) + X.mix(epoch.astype(np.uint64) + _U(77))
            index = permuted(slot % np.maximum(blocks, 1), blocks, key) if len(slot) else slot
            yield pa.RecordBatch.from_arrays([pa.array(rank), pa.array(shard), pa.array(slot), pa.array(epoch), pa.array(index)], names=["rank", "shard", "slot", "epoch", "index"])

    return run


def drawn(plan: DataFrame, block: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """(rank, shard, slot, epoch, index): the block that each slot of each source takes; a source's slots are 0 .. its number - 1."""
    blocks = F.ceil(F.col("source_size") / block)
    share = F.try_divide("target", "source_size")  # null where a source has no words
    # one row for each source
    want = [tuple(r) for r in plan.select("rank", blocks, F.coalesce(F.least(F.round(share * blocks).cast("long"), 2 * blocks), F.lit(0).cast("long")).alias("slots")).where("slots > 0").collect()]
    total = sum(w[2] for w in want)
    spark, out = plan.sparkSession, "rank long, shard long, slot long, epoch long, index long"
    if not total:
        return spark.createDataFrame([], out)
    shards = max(8, -(-total // SHARD_SLOTS))
    counts = spark.range(shards).mapInArrow(_draw(want, shards, seed), "rank long, blocks long, slots long, shard long, n long")
    whole = W.partitionBy("rank")
    counts = counts.withColumn("end", F.sum("n").over(whole.orderBy("shard").rowsBetween(W.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(whole))
    # a source's drawn numbers, stretched to its target: each shard's count changes by the same small share
    drawn_to = lambda c: F.when(c == F.col("all"), F.col("slots")).otherwise(F.least(F.floor(c * (F.col("slots") / F.col("all"))), F.col("slots")))
    dealt_to = lambda k: F.floor(F.col("slots") * k / shards)
    low = F.when(F.col("all") > 0, drawn_to(F.col("end") - F.col("n"))).otherwise(dealt_to(F.col("shard")))
    high = F.when(F.col("all") > 0, drawn_to(F.col("end"))).otherwise(dealt_to(F.col("shard") + 1))
    spans = counts.select("rank", "blocks", "shard", low.alias("low"), high.alias("high")).where("low < high")
    # few rows that become many: without a number of its own the shuffle would end in one task
    dealt = spans.repartition(min(max(8, total // TASK_SLOTS), MOST_TASKS))
    slots = dealt.select("rank", "blocks", "shard", F.explode(F.sequence(F.col("low"), F.col("high") - 1)).alias("slot"))
    return slots.mapInArrow(_map_slots(seed), out)


def mix(docs: DataFrame, ratio: float = 1.5, most: float = 2.0, block: int = BLOCK_WORDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sizes, targets, parts): parts holds one row for each part of a document that a slot takes: shard, slot, rank,
    epoch, index, k1, k2, copy, start, words."""
    sized = written(sizes(docs, id_col, text_col, source_col), "sizes")
    plan = written(targets(sized, ratio, most), "targets")
    # the size of the slots can't be seen from the few targets that they are drawn from: without the hint they are broadcast
    slots = drawn(plan, block, seed).hint("merge")
    parts = packed(sized, plan, sized.count(), block).join(slots, ["rank", "index"])
    return sized, plan, parts


def taken(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken), one row per row of docs."""
    sized, plan, parts = mix(docs, **options)
    rows = sized.join(plan, sized.source.eqNullSafe(plan.source)).select("doc_id", *KEY, "size", "source_size", "target")
    got = parts.groupBy(*KEY).agg(F.sum("words").alias("words"))
    return rows.join(got, KEY, "left").select("doc_id", "size", "source_size", "target", F.coalesce("words", F.lit(0)).cast("long").alias("taken"))


def _slice(names: list[str], text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in X.chunks(batch, text_col):
                part, words, raw = batch.slice(rows.start, rows.stop - rows.start), X.find_words(data, offsets), data.tobytes()
                texts = []
                for i, spans in enumerate(part.column("_parts of the mix").to_pylist()):
                    lo, n = int(words.first[i]), int(words.first[i + 1] - words.first[i])
                    joined: list[list[int]] = []
                    for s in sorted(spans, key=lambda s: s["start"]):
                        if joined and joined[-1][1] == s["start"]:
                            joined[-1][1] += s["words"]
                        else:
                            joined.append([s["start"], s["start"] + s["words"]])
                    if joined == [[0, n]]:
                        texts.append(raw[offsets[i] : offsets[i + 1]])
                    else:
                        texts.append(b"\n".join(raw[words.starts[lo + a] : words.ends[lo + b - 1]] for a, b in joined))
                text = pa.array(texts, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([text if c == text_col else part.column(c) for c in names], names=names)

    return run


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix as rows of docs: one for each row and epoch with the parts of its text that were taken (all of it,
    as it was, where all its blocks were)."""
    _, _, parts = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    of = parts.groupBy(*[F.col(k).alias(f"_{k}") for k in KEY], F.col("epoch").alias("_epoch")).agg(F.collect_list(F.struct("start", "words")).alias("_parts"))
    of = of.withColumnsRenamed({"_k1": "_of1", "_k2": "_of2", "_copy": "_of_copy"})
    # the rows go through as one struct, so no name of theirs can clash
    k1, k2 = _keys(F.col(f"`{id_col}`").cast("long"), F.col(f"`{source_col}`"), F.col(f"`{text_col}`"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(k1.alias("_k1"), k2.alias("_k2"), row.alias("_row")).withColumn("_copy", _copy("_k1", "_k2", ["_k1"]))
    # the copy isn't a key of the join (its test mixes both sides), so the shuffle by hashes that numbers the copies serves the join too
    same = (F.col("_k1") == F.col("_of1")) & (F.col("_k2") == F.col("_of2")) & (F.col("_copy") - F.col("_of_copy") == 0)
    joined = rows.join(of, same).select(*[F.col("_row").getField(c).alias(c) for c in docs.columns], F.col("_parts").alias("_parts of the mix"))
    return joined.mapInArrow(_slice(docs.columns, text_col), T.StructType(docs.schema.fields))


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    return taken(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
