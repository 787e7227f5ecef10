"""Byte-level BPE encoding and decoding with a given rank file.

Method: bytes are mapped to Latin-1 characters so that an Aho-Corasick automaton of the vocabulary finds the longest
token at every place of a pre-token. Encoding walks the places with the longest token first and backtracks to shorter
ones wherever two neighbouring tokens couldn't both come out of the merges (a test of the pair alone, memoised; a place
that failed is marked and never tried again, so the work is linear). The one token sequence that passes is exactly what
applying the merges by rank gives.

Defined results: a null or empty text has no tokens and decodes to empty text. Special tokens don't exist: their
strings are ordinary text. An input column named like an output column is replaced.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops as X
from .frames import without

#: Entries of each memo that are held before they are set aside; twice as many are kept at most.
MEMO = 1 << 17


class _Memo(dict):
    """What `make` gives for a key. When it is large, trim() sets what it holds aside until it is large again: what is asked for in between is taken over, the rest
    goes, so frequent keys aren't made anew."""

    def __init__(self, make):
        self.make, self.aside = make, {}

    def __missing__(self, key):
        value = self.aside.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value

    def trim(self):
        if len(self) > MEMO:
            self.aside = dict(self)
            self.clear()


def read_ranks(rank_file: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line.strip())}


def token_bytes(ranks: dict[bytes, int]) -> list[bytes]:
    """The bytes of each id."""
    out = [b""] * (max(ranks.values()) + 1)
    for token, r in ranks.items():
        out[r] = token
    return out


class Codec:
    """Encoder for one vocabulary, with its inverse. Made once in each task and gone with it: workers are reused, and
    would keep tens of megabytes for nothing."""

    def __init__(self, rank_file: bytes, pattern: str):
        import ahocorasick
        import regex

        ranks = self.ranks = read_ranks(rank_file)
        self.bytes = token_bytes(ranks)
        self.size = len(self.bytes)
        self.find = regex.compile(pattern).findall
        # single bytes are looked up, so that the automaton doesn't report one at every place
        self.single = [ranks.get(bytes([b]), -1) for b in range(256)]
        self.length = [len(t) for t in self.bytes]
        self.tree = ahocorasick.Automaton()
        for token, r in ranks.items():
            if len(token) > 1:
                self.tree.add_word(token.decode("latin-1"), (len(token) - 1, r))
        self.tree.make_automaton()
        # the next shorter token that begins the same way
        self.shorter = [-1] * self.size
        for token, r in ranks.items():
            for n in range(len(token) - 1, 0, -1):
                if (p := ranks.get(token[:n])) is not None:
                    self.shorter[r] = p
                    break
        self.parts: list[tuple[int, int] | None] = [None] * self.size
        self.merged: dict[tuple[int, int], int] = {}
        for r in sorted(ranks.values()):
            token, left = self.bytes[r], self.shorter[r]
            while left >= 0:
                right = ranks.get(token[len(self.bytes[left]) :])
                if left < r and right is not None and right < r and self._fit((left, right)):
                    self.parts[r] = (left, right)
                    self.merged[left, right] = r
                    break
                left = self.shorter[left]
        self.fits = _Memo(self._fit)
        self.words = _Memo(self._word)

    def _fit(self, pair: tuple[int, int]) -> bool:
        """Whether the two tokens can stand side by side in an encoding: undoing their merges from the latest to the
        earliest, no merge across the border may come before the one that was undone."""
        a, b = pair
        limit = self.size
        while True:
            if self.merged.get((a, b), limit) < limit:
                return False
            pa_, pb_ = self.parts[a], self.parts[b]
            if pa_ is None and pb_ is None:
                return True
            # of the two the later merge is undone; of equal ones the right, as merges go from the left
            if pb_ is None or (pa_ is not None and a > b):
                limit, a = a, pa_[1]
            else:
                limit, b = b + 1, pb_[0]

    def _word(self, word: str) -> tuple[int, ...]:
        raw = word.encode("utf-8", "surrogatepass")
        if (whole := self.ranks.get(raw)) is not None:
            return (whole,)
        longest = list(map(self.single.__getitem__, raw))
        for end, (before, r) in self.tree.iter(raw.decode("latin-1")):
            longest[end - before] = r
        length, shorter, fits = self.length, self.shorter, self.fits
        out: list[int] = []
        stop = len(raw)
        dead = bytearray(stop + 1)
        at, token, last = 0, longest[0], -1
        while at < stop:
            while token >= 0:
                end = at + length[token]
                if not dead[end] and (last < 0 or fits[last, token]):
                    break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at, last = end, token
                token = longest[at] if at < stop else -1
            else:  # nothing may follow `last` here
                dead[at] = 1
                if not out:
                    raise ValueError("the vocabulary lacks single bytes")
                token = out.pop()
                at -= length[token]
                token, last = shorter[token], out[-1] if out else -1
        return tuple(out)

    def encode(self, text: str) -> np.ndarray:
        ids = np.fromiter(chain.from_iterable(map(self.words.__getitem__, self.find(text))), np.int32)
        self.words.trim()
        self.fits.trim()
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


def _encoder(ranks, pattern: str, text_col: str, names: list[str], out: str, exact: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(ranks.value, pattern)
        for batch in batches:
            for rows, data, offsets in X.chunks(batch, text_col):
                raw, bounds = data.tobytes(), offsets.tolist()
                ids = [codec.encode(raw[a:b].decode("utf-8", "replace")) for a, b in zip(bounds, bounds[1:], strict=False)]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
                part = batch.slice(rows.start, rows.stop - rows.start)
                more = {out: lists}
                if exact:
                    more[exact] = pa.array([codec.decode(x.tolist()) == raw[a:b] for x, a, b in zip(ids, bounds, bounds[1:], strict=False)], pa.bool_())
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], *more.values()], names=[*names, *more])

    return run


def _decoder(ranks, ids_col: str, names: list[str], out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = token_bytes(read_ranks(ranks.value)).__getitem__
        for batch in batches:
            step = 512
            for lo in range(0, len(batch), step):
                part = batch.slice(lo, step)
                lists = part.column(ids_col)
                flat, ends = lists.flatten().to_numpy(zero_copy_only=False).tolist(), np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())]).tolist()
                texts = pa.array([b"".join(map(of, flat[a:b])) for a, b in zip(ends, ends[1:], strict=False)], pa.binary())
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], texts], names=[*names, out])

    return run


def vocabulary(spark: SparkSession, rank_file: str):
    """The rank file, read on the driver and broadcast (a vocabulary: under a megabyte for 50,000 tokens)."""
    with open(rank_file, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, ranks, pattern: str, text_col: str = "text", ids_col: str = "tokens", exact_col: str | None = None, keep_text: bool = True) -> DataFrame:
    """docs with the token ids of text_col. exact_col: also whether decoding them gives the text again, found where they are
    made. keep_text=False leaves the text out of the result, so that it isn't sent back from Python."""
    docs = without(docs, ids_col, *([exact_col] if exact_col else []))
    kept = [f for f in docs.schema.fields if keep_text or f.name != text_col]
    added = [T.StructField(ids_col, T.ArrayType(T.IntegerType())), *([T.StructField(exact_col, T.BooleanType())] if exact_col else [])]
    return docs.mapInArrow(_encoder(ranks, pattern, text_col, [f.name for f in kept], ids_col, exact_col), T.StructType([*kept, *added]))


def decode(docs: DataFrame, ranks, ids_col: str = "tokens", bytes_col: str = "decoded") -> DataFrame:
    """docs with the bytes that the token ids stand for (bytes: a cut sequence may end inside a character)."""
    docs = without(docs, bytes_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(bytes_col, T.BinaryType())])
    return docs.mapInArrow(_decoder(ranks, ids_col, docs.columns, bytes_col), schema)


def public_codec(spark: SparkSession):
    """(ranks, pattern) of the public 50k byte vocabulary."""
    import public_tokenizers as P

    return vocabulary(spark, P.path("byte_bpe_50k.tiktoken")), P.PATTERN


def op2_byte_bpe(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    coder = public_codec(spark)
    done = decode(encode(docs, *coder, keep_text=False), coder[0])
    return done.select(
        "doc_id",
        F.size("tokens").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("tokens").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
