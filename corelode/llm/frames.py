"""Small DataFrame helpers shared by the corpus operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The most keys that are dealt out in shares (their table is broadcast).
HOT_KEYS = 200_000


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without the columns of these names: an input column named like an output is replaced by that output."""
    low = {n.lower() for n in names}
    return df.select(*[f"`{c}`" for c in df.columns if c.lower() not in low])


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, else the checkpoint folder that was set, else one below the warehouse."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    have = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not at and have.isDefined():
        return have.get()
    at = at or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
    if not have.isDefined():
        spark.sparkContext.setCheckpointDir(at)
    return at


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes a table that written() made, through Spark's file system layer."""
    spark = df.sparkSession
    for f in {x.rpartition("/")[0] for x in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def hot_keys(rows: DataFrame, keys: list[str], most: int, total: int | None = None) -> DataFrame:
    """(keys, _shares): the keys of more than `most` rows, and in how many shares their rows go. Each also has more than a HOT_KEYS-th part of all
    rows, so there are fewer than HOT_KEYS of them, whatever the data: the table may be broadcast."""
    limit = max(most, (rows.count() if total is None else total) // HOT_KEYS)
    return written(rows.groupBy(*keys).agg(F.ceil(F.count("*") / limit).alias("_shares")).where("_shares > 1"), "hot")


def in_shares(rows: DataFrame, hot: DataFrame, keys: list[str], by: str) -> DataFrame:
    """rows with the _share of their key that they belong to, dealt by the column `by`."""
    share = F.coalesce(F.pmod(F.xxhash64(by), "_shares"), F.lit(0).cast("long"))
    return rows.join(F.broadcast(hot), keys, "left").withColumn("_share", share).drop("_shares")


def for_shares(rows: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    """rows once for each _share of their key."""
    shares = F.sequence(F.lit(0).cast("long"), F.coalesce("_shares", F.lit(1)).cast("long") - 1)
    return rows.join(F.broadcast(hot), keys, "left").withColumn("_share", F.explode(shares)).drop("_shares")


def join_dealt(rows: DataFrame, table: DataFrame, keys: list[str], by: str, most: int = 50_000) -> DataFrame:
    """rows (a written table) joined with a table of few rows a key: a key of more than `most` rows is dealt out over shares, so none is one task's work."""
    hot = hot_keys(rows, keys, most)
    return in_shares(rows, hot, keys, by).join(for_shares(table, hot, keys), [*keys, "_share"]).drop("_share")
