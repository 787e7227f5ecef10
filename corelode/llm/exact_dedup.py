"""Exact dedup: of texts that are equal up to white space the row with the smallest id stays.

Method: content sort, with DataFrame functions only. Sampled splitters range-partition the normalised bytes (their first PREFIX
characters, then a hash that orders what shares them, then a salt), each partition is sorted externally, and equal texts stand next to each other: within a
run of equal bytes (compared in full) the smallest id is the run's head and stays.

Only keys of more than MOST rows (and of more than a KEYS-th part of all, so that there are fewer than KEYS of them, whose table of about 10 MB at most is
broadcast) are salted, by the id. The heads of their runs, one for some MOST rows, are sorted by content once more and neighbours compared in full again; the rows of
these runs take the answer by the run's SHA-256 and salt. All other rows have it from their run.

Splitters are made of short keys, so the sample that Spark takes of them stays small however long the texts are.

Defined results: a null text counts as empty (and so equals other empty ones); texts of white space only equal a single space, not the
empty text; a row with a null id can't be kept in favour of one with an id (nulls last) and a text that only such rows have gets a null keep_id, kept true for all of
them; repeated rows of one id and text are in one group and all kept. A very long text is sorted and compared whole. An input column named like an output is replaced. An
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .frames import without, written

#: Leading characters that splitters hold; rows that a salt of a key holds; and the most keys that are salted.
PREFIX, MOST, KEYS = 24, 1000, 200_000
SPACES = "[\\x20\\x09-\\x0D]+"


def normalised(text):
    """Column: the text with each run of white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def _grouped(run, rows):
    """The smallest id of a run and how many rows it stands for."""
    return F.min("head").over(run).alias("head"), F.sum(rows).over(run).alias("rows")


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of docs."""
    given = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("body"))
    given = given.withColumns({"prefix": F.substring("body", 1, PREFIX), "order": F.xxhash64("body")})
    most = max(MOST, docs.count() // KEYS)
    # fewer than KEYS rows: each key has more than a KEYS-th part of all
    hot = written(given.groupBy("prefix", "order").agg(F.ceil(F.count("*") / most).alias("salts")).where("salts > 1"), "hot")
    salted = F.coalesce(F.pmod(F.xxhash64("doc_id"), "salts"), F.lit(-1).cast("long"))
    dealt = given.join(F.broadcast(hot), ["prefix", "order"], "left").select("doc_id", "body", "prefix", "order", salted.alias("salt"))
    keys = ["prefix", "order", "salt"]
    dealt = dealt.repartitionByRange(*keys)
    run = W.partitionBy(*keys, "body")
    seen = dealt.withColumn("head", F.col("doc_id")).select(
        "doc_id",
        "salt",
        F.unhex(F.sha2("body", 256)).alias("sha"),
        *_grouped(run, F.lit(1)),
        # one row of each run of a salted key keeps the text, to be compared again
        F.when((F.col("salt") >= 0) & (F.row_number().over(run.orderBy("doc_id")) == 1), F.struct("prefix", "order", "body")).alias("text"),
    )
    seen = written(seen, "runs")
    again = seen.where("text IS NOT NULL").select("sha", "salt", "head", "rows", "text.*")
    heads = again.select("sha", "salt", *_grouped(W.partitionBy("prefix", "order", "body"), F.col("rows")))
    alone = seen.where("salt < 0").select("doc_id", "sha", "head", "rows")
    found = alone.unionByName(seen.where("salt >= 0").select("doc_id", "sha", "salt").join(heads, ["sha", "salt"]).select("doc_id", "sha", "head", "rows"))
    return found.select("doc_id", F.col("head").alias("keep_id"), F.col("rows").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("head")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay. Of an id with several texts each stays or goes by itself."""
    stay = copies(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")).distinct()
    docs = without(docs, "_id", "_sha")
    same = docs[id_col].eqNullSafe(stay["_id"]) & (F.sha2(normalised(docs[text_col]), 256) == stay["_sha"])
    return docs.join(stay, same, "left_semi")


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return copies(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP10_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents),
g AS (SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY body)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.body) AS text_sha256
FROM n JOIN g USING (body)
"""
