"""A corpus pipeline of five stages over `documents`, each written as Parquet and read again by the next.

Quality classification, line dedup, near dedup, mixing and tokenisation, by the operators of corelode.llm. All stages but
the last return the columns of documents; n_chars always is the length of the text. After mixing, a document has one row
for each time that (parts of) it are in the mix: at most two.

Defined results: the quality stage scores null and empty texts like any other; line dedup makes a null text an empty one; near dedup keeps texts
without words and rows with a null id; the mix takes nothing of a text without words. Repeated rows of an id are one document to line and near dedup (all or none of them stay there) and
documents of their own to the other stages. Very long texts go through every stage whole. Columns besides those of documents are left out, so their names can't clash. An empty table gives an
empty result.

Texts go to Python in batches of BATCH_ROWS rows at most (the session's limit is lowered to that), which bounds what executors hold of them outside their heap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corelode.llm.byte_bpe import encode, public_codec
from corelode.llm.frames import written
from corelode.llm.line_dedup import LineIndex
from corelode.llm.mixing import mixed_documents
from corelode.llm.near_dedup import components_of
from corelode.llm.quality import scored, train

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Scores below this are rejected.
QUALITY = 0.5
#: Rows of a batch that goes to Python.
BATCH_ROWS, BATCH_KEY = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels, doesn't reject."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, model).where(F.col("score") >= QUALITY).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many share (in all but the last of them)."""
    index = LineIndex.build(docs)
    return _measured(index.dedup(docs, index.refs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies (five-word shingles, similarity of 0.8 or more)."""
    keep = components_of(docs, shingle=5, share=(80, 100)).where("doc_id <=> component_id").select("doc_id").distinct()
    return docs.join(keep, docs.doc_id.eqNullSafe(keep.doc_id), "left_semi").select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources at their target weights."""
    return _measured(mixed_documents(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether decoding them gives the text again."""
    done = encode(docs, *public_codec(spark), exact_col="exact", keep_text=False)
    return done.select("doc_id", "lang", "source", "n_chars", "tokens", F.size("tokens").cast("long").alias("n_tokens"), "exact")


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("tokens", tokens),
]
#: SQL can express neither a trained classifier nor the drawing of the mix; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    if not 0 < int(spark.conf.get(BATCH_KEY)) <= BATCH_ROWS:
        spark.conf.set(BATCH_KEY, BATCH_ROWS)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
