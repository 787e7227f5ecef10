"""Quality classifier: a document is a bag of passages, scored by gated attention.

Method: attention-based multiple-instance learning. A text is cut into passages of PASSAGE words. The encoder of a passage adds the learned embeddings of its
words (a table of BUCKETS rows, taken by the words' hashes; their mean) to a learned layer over its form (letter case, digits, signs, word lengths, how much repeats), under a
tanh; gated attention weights, learned from document labels alone, say how much each passage counts, and a logistic unit scores the weighted sum of the passages'
encodings. All of it is trained together. Scoring takes every passage of every text and runs where the texts are; only the model (some 70 kilobytes) is sent to the tasks.

Training uses at most SAMPLE labelled documents and PASSAGES passages (documents in the order of a hash of their id, whole texts; one whose passages alone are more
isn't learned from), which is 20 megabytes at most, fitted on the driver with a fixed seed. Rows whose crc32 of the id (as text) leaves 1 on division by 3 are never learned from.

Defined results: a null or empty text is one passage without words; it gets a score like any other. Labels that are null are
ignored; of several labels of one id the smallest counts. Without labelled rows of both kinds, or with empty tables, every score is 0.5. Repeated rows and ids are scored row by row
and learned from as rows of their own, within the bounds. A very long text is scored over all its passages. A row with a null id is scored and counts as held out
only if its remainder says so (null: false). An input column named like an output is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops as X
from .frames import without, written

PASSAGE, SAMPLE, PASSAGES = 48, 3000, 100_000
#: Rows of the embedding table (a power of two), widths of the layers, and the fitting.
BUCKETS, HIDDEN, ATTENTION = 1024, 16, 8
BATCH, STEPS, RATE, DECAY = 256, 300, 0.02, 1e-4

_CLASSES = np.full(256, 7, np.int64)
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".,;:'\"()-", b"!?", b"|/\\<>={}[]_", b"*#%&$@^~+`")):
    _CLASSES[list(_chars)] = _k
_CLASSES[128:] = 8
_CLASSES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 9
KINDS = 9
FEATURES = KINDS + 9


@dataclass
class Bags:
    """Passages of texts: their form (a row each), the buckets of their words (n words each), and where each text's passages begin."""

    form: np.ndarray
    words: np.ndarray
    n: np.ndarray
    first: np.ndarray

    def of(self, texts: np.ndarray) -> Bags:
        """The bags of these texts, in their order."""
        size = np.diff(self.first)[texts]
        at = np.repeat(self.first[:-1][texts], size) + X.ranges(size)
        begin = np.cumsum(self.n) - self.n
        words = self.words[np.repeat(begin[at], self.n[at]) + X.ranges(self.n[at])]
        return Bags(self.form[at], words, self.n[at], np.concatenate([[0], np.cumsum(size)]))


def passages(data: np.ndarray, offsets: np.ndarray) -> Bags:
    """The passages of each text (every text has at least one)."""
    words = X.find_words(data, offsets)
    n = np.diff(words.first)
    count = np.maximum(1, -(-n // PASSAGE))
    first = np.concatenate([[0], np.cumsum(count)])
    total = int(first[-1])
    out = np.zeros((total, FEATURES))
    if not len(words.starts):
        return Bags(out, np.zeros(0, np.uint16), np.zeros(total, np.int64), first)
    owner = words.owner()
    passage = first[owner] + (np.arange(len(owner)) - words.first[owner]) // PASSAGE
    size = (words.ends - words.starts).astype(np.float64)
    in_passage = np.bincount(passage, minlength=total).astype(np.float64)
    letters = np.bincount(passage, size, total)
    w, b = np.maximum(in_passage, 1), np.maximum(letters, 1)
    kind = _CLASSES[data]
    for k in range(KINDS):
        sums = np.concatenate([[0], np.cumsum(kind == k)])
        out[:, k] = np.bincount(passage, sums[words.ends] - sums[words.starts], total) / b
    hashes = words.hashes(lower=True)
    last = kind[words.ends - 1]
    begin = kind[words.starts]
    inner = np.zeros(len(owner), bool)
    inner[1:] = passage[1:] == passage[:-1]
    twin = np.zeros(len(owner), bool)
    twin[1:] = inner[1:] & (hashes[1:] == hashes[:-1])
    order = np.lexsort((hashes, passage))
    fresh = np.ones(len(owner), bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (passage[order][1:] != passage[order][:-1])
    k = KINDS
    mean = letters / w
    out[:, k] = np.log1p(mean)
    out[:, k + 1] = np.sqrt(np.maximum(np.bincount(passage, size**2, total) / w - mean**2, 0)) / (1 + mean)
    out[:, k + 2] = np.bincount(passage[order], fresh, total) / w
    out[:, k + 3] = np.bincount(passage, twin, total) / w
    out[:, k + 4] = np.bincount(passage, last >= 4, total) / w
    out[:, k + 5] = np.bincount(passage, (begin >= 3) & (begin < 8), total) / w
    out[:, k + 6] = np.bincount(passage, begin == 0, total) / w
    out[:, k + 7] = np.log1p(in_passage) / 4
    # how much the text repeats itself, the same for all its passages
    order = np.lexsort((hashes, owner))
    new = np.ones(len(owner), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    share = np.bincount(owner[order], new, len(n)) / np.maximum(n, 1)
    out[:, k + 8] = np.repeat(np.where(n >= PASSAGE, share, 1.0), count)
    return Bags(out, (hashes >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.uint16), in_passage.astype(np.int64), first)


@dataclass
class Model:
    """Weights of the encoder (word embeddings e, form layer w, b), gated attention (v, u, a) and scorer (c, d), with the form's scale."""

    mean: np.ndarray
    scale: np.ndarray
    e: np.ndarray
    w: np.ndarray
    b: np.ndarray
    v: np.ndarray
    u: np.ndarray
    a: np.ndarray
    c: np.ndarray
    d: np.ndarray

    def embedded(self, bags: Bags) -> np.ndarray:
        """The mean embedding of each passage's words; a few thousand passages at a time, so that a long text needs no more."""
        out = np.zeros((len(bags.n), self.e.shape[1]))
        end = np.cumsum(bags.n)
        for lo in range(0, len(bags.n), 4096):
            n = bags.n[lo : lo + 4096]
            some = np.flatnonzero(n)
            if len(some):
                begin = end[lo] - n[0]
                at = (end[lo : lo + 4096] - n - begin)[some]
                out[lo + some] = np.add.reduceat(self.e[bags.words[begin : end[lo + len(n) - 1]]], at, axis=0) / n[some, None]
        return out

    def forward(self, bags: Bags):
        n, at = np.diff(bags.first), bags.first[:-1]
        z = (bags.form - self.mean) / self.scale
        h = np.tanh(z @ self.w + self.embedded(bags) + self.b)
        t, g = np.tanh(h @ self.v), 1 / (1 + np.exp(-np.clip(h @ self.u, -40, 40)))
        s = (t * g) @ self.a
        s = np.exp(s - np.repeat(np.maximum.reduceat(s, at), n))
        share = s / np.repeat(np.add.reduceat(s, at), n)
        m = np.add.reduceat(h * share[:, None], at, axis=0)
        return z, h, t, g, share, m, 1 / (1 + np.exp(-np.clip(m @ self.c + self.d, -40, 40)))

    def score(self, bags: Bags) -> np.ndarray:
        return self.forward(bags)[-1]

    def gradients(self, bags: Bags, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean log loss over the texts and its derivative by each weight."""
        z, h, t, g, share, m, p = self.forward(bags)
        n, at = np.diff(bags.first), bags.first[:-1]
        err = (p - y) / len(y)
        back = np.repeat(err[:, None] * self.c, n, axis=0)
        dshare = (back * h).sum(axis=1)
        ds = share * (dshare - np.repeat(np.add.reduceat(share * dshare, at), n))
        dt, dg = ds[:, None] * self.a * g * (1 - t**2), ds[:, None] * self.a * t * g * (1 - g)
        dh = (back * share[:, None] + dt @ self.v.T + dg @ self.u.T) * (1 - h**2)
        word = np.repeat(dh / np.maximum(bags.n, 1)[:, None], bags.n, axis=0)
        order = np.argsort(bags.words, kind="stable")
        used, start = np.unique(bags.words[order], return_index=True)
        de = np.zeros_like(self.e)
        if len(used):
            de[used] = np.add.reduceat(word[order], start, axis=0)
        loss = -np.mean(y * np.log(np.maximum(p, 1e-12)) + (1 - y) * np.log(np.maximum(1 - p, 1e-12)))
        return float(loss), {"e": de, "w": z.T @ dh, "b": dh.sum(axis=0), "v": h.T @ dt, "u": h.T @ dg, "a": ((t * g) * ds[:, None]).sum(axis=0), "c": m.T @ err, "d": err.sum(keepdims=True)}


WEIGHTS = ("e", "w", "b", "v", "u", "a", "c", "d")


def fresh(bags: Bags, seed: int = 3) -> Model:
    """Weights to start from; all words start alike."""
    rng = np.random.default_rng(seed)
    start = lambda *s: rng.standard_normal(s) / np.sqrt(s[0])
    return Model(bags.form.mean(axis=0), bags.form.std(axis=0) + 1e-3, np.zeros((BUCKETS, HIDDEN)), start(FEATURES, HIDDEN), np.zeros(HIDDEN), start(HIDDEN, ATTENTION), start(HIDDEN, ATTENTION), start(ATTENTION), start(HIDDEN), np.zeros(1))


def fit(bags: Bags, y: np.ndarray, seed: int = 3) -> Model | None:
    """Adam on the mean log loss of batches of texts, with weight decay; None without both kinds of label."""
    if not len(y) or y.min() == y.max():
        return None
    rng, model = np.random.default_rng(seed), fresh(bags, seed)
    moments = {k: (np.zeros_like(getattr(model, k)), np.zeros_like(getattr(model, k))) for k in WEIGHTS}
    order = np.zeros(0, np.int64)
    for step in range(1, STEPS + 1):
        if len(order) < min(BATCH, len(y)):
            order = np.concatenate([order, rng.permutation(len(y))])
        some, order = order[:BATCH], order[BATCH:]
        _, grads = model.gradients(bags.of(some), y[some])
        for k in WEIGHTS:
            value, (one, two) = getattr(model, k), moments[k]
            grad = grads[k] + DECAY * value
            one += 0.1 * (grad - one)
            two += 0.001 * (grad**2 - two)
            value -= RATE * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.999**step)) + 1e-8)
    return model


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, offsets in X.chunks(batch, "text"):
            bags = passages(data, offsets)
            part = batch.slice(rows.start, rows.stop - rows.start)
            begin = np.concatenate([[0], np.cumsum(bags.n)])
            spans = list(zip(bags.first, bags.first[1:], strict=False))
            form = [bags.form[a:b].astype(np.float32).tobytes() for a, b in spans]
            n = [bags.n[a:b].astype(np.uint16).tobytes() for a, b in spans]
            words = [bags.words[begin[a] : begin[b]].tobytes() for a, b in spans]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("quality"), pa.array(np.diff(bags.first)), *[pa.array(x, pa.binary()) for x in (form, n, words)]],
                names=["doc_id", "quality", "passages", "form", "n", "words"],
            )


def learnable(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """(doc_id, quality): at most `sample` labelled ids that may be learned from."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.min(label_col).cast("int").alias("quality"))
    free = known.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    return free.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, most: int = PASSAGES) -> Model | None:
    """The model, from the labelled documents among docs: `sample` documents and `most` passages at most."""
    chosen = learnable(labels, id_col, sample=sample)
    # at most `sample` rows of two numbers
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc_id")
    bags = written(texts.mapInArrow(_encode, "doc_id long, quality int, passages long, form binary, n binary, words binary"), "bags")
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.xxhash64("words", "form")]
    small = bags.where(F.col("passages") <= most).select("*", order[2].alias("mark")).orderBy(order[0], "doc_id", "mark").limit(sample)
    # a window over at most `sample` rows
    so_far = F.sum("passages").over(W.orderBy(order[0], "doc_id", "mark").rowsBetween(W.unboundedPreceding, 0))
    rows = small.withColumn("so_far", so_far).where(F.col("so_far") <= most).select("doc_id", "quality", "form", "n", "words", "so_far").collect()
    rows.sort(key=lambda r: r["so_far"])
    if not rows:
        return None
    read = lambda c, t: [np.frombuffer(r[c], t) for r in rows]
    n = read("n", np.uint16)
    first = np.concatenate([[0], np.cumsum([len(x) for x in n])])
    whole = Bags(np.concatenate(read("form", np.float32)).reshape(-1, FEATURES).astype(np.float64), np.concatenate(read("words", np.uint16)), np.concatenate(n).astype(np.int64), first)
    return fit(whole, np.array([r["quality"] for r in rows], np.float64))


def _score(model: Model | None, names: list[str], text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in X.chunks(batch, text_col):
                part = batch.slice(rows.start, rows.stop - rows.start)
                scores = model.score(passages(data, offsets)) if model is not None else np.full(len(offsets) - 1, 0.5)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(scores)], names=[*names, "score"])

    return run


def scored(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """docs with the score of each text."""
    docs = without(docs, "score")
    return docs.mapInArrow(_score(model, docs.columns, text_col), T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))


def op9_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return scored(docs, model).select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
