"""Sinks: LAS text, CSV tables and Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.petro import col

NULL_TEXT = "-999.25"


def significant(x, digits: int = 7) -> Column:
    """x rounded to so many significant digits."""
    v = col(x)
    scale = F.pow(F.lit(10.0), (digits - 1) - F.floor(F.log10(F.abs(v))))
    return F.when(v == 0, 0.0).otherwise(F.round(v * scale) / scale)


def number_text(x, digits: int = 7) -> Column:
    return F.coalesce(significant(x, digits).cast("string"), F.lit(NULL_TEXT))


def plain_mnemonic(text) -> Column:
    """A mnemonic without signs that a header line can't hold."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(col(text), "[^\\x20-\\x7e]", ""), r"[.:\s]+", "_"), "^_+|_+$", "")


def _line(mnemonic, unit, value, description) -> Column:
    return F.concat(F.lit(" "), F.rpad(F.concat(mnemonic, F.lit("."), unit), 14, " "), F.lit(" "), F.rpad(F.coalesce(value, F.lit("")), 30, " "), F.lit(" : "), description)


def las_lines(samples: DataFrame, curves: list[tuple[str, str]], wells: DataFrame, tops: DataFrame | None = None, survey: DataFrame | None = None, digits: int = 7) -> DataFrame:
    """(well_id, part, no, text): the lines of a LAS 2.0 file per well. samples: well_id, md and a column per curve; curves: (column, unit), whose
    mnemonics are the column names, numbered where they repeat; wells: well_id, name and, where there are, api, kb, gl, lat, lon, bht."""
    order = W.partitionBy("well_id").orderBy("md")
    step = samples.withColumn("_d", F.col("md") - F.lag("md").over(order)).groupBy("well_id").agg(F.min("md").alias("strt"), F.max("md").alias("stop"), F.median("_d").alias("m"), F.max(F.abs("_d")).alias("most"), F.min(F.abs("_d")).alias("few"))
    even = (F.col("most") - F.col("few")) <= F.greatest(F.lit(1e-4), F.col("m") * 2e-3)
    w = wells.join(step.withColumn("step", F.when(even, F.col("m")).otherwise(0.0)), "well_id")
    have = lambda c: F.col(c).cast("string") if c in wells.columns else F.lit(None).cast("string")
    lit = F.lit
    fixed = [
        (0, lit("~VERSION INFORMATION")), (1, _line(lit("VERS"), lit(""), lit("2.0"), lit("CWLS LOG ASCII STANDARD - VERSION 2.0"))), (2, _line(lit("WRAP"), lit(""), lit("NO"), lit("ONE LINE PER DEPTH STEP"))),
        (10, lit("~WELL INFORMATION")), (11, _line(lit("STRT"), lit("FT"), number_text("strt"), lit("START DEPTH"))), (12, _line(lit("STOP"), lit("FT"), number_text("stop"), lit("STOP DEPTH"))),
        (13, _line(lit("STEP"), lit("FT"), number_text("step"), lit("STEP"))), (14, _line(lit("NULL"), lit(""), lit(NULL_TEXT), lit("NULL VALUE"))), (15, _line(lit("WELL"), lit(""), F.col("name"), lit("WELL"))),
    ]
    optional = [(16, "api", "API", ""), (17, "lat", "LATI", "DEG"), (18, "lon", "LONG", "DEG")]
    params = [(31, "kb", "EKB", "FT"), (32, "gl", "EGL", "FT"), (33, "bht", "BHT", "")]
    heads = [F.struct(lit(n).alias("no"), t.alias("text")) for n, t in fixed]
    heads += [F.when(have(c).isNotNull(), F.struct(lit(n).alias("no"), _line(lit(m), lit(u), have(c), lit(m)).alias("text"))) for n, c, m, u in optional + params]
    heads.append(F.struct(lit(30).alias("no"), lit("~PARAMETER INFORMATION").alias("text")))
    used: dict[str, int] = {"DEPT": 1}
    names = []
    for c, _ in curves:
        used[c.upper()] = used.get(c.upper(), 0) + 1
        names.append(c.upper() if used[c.upper()] == 1 else f"{c.upper()}_{used[c.upper()]}")
    heads.append(F.struct(lit(100).alias("no"), lit("~CURVE INFORMATION").alias("text")))
    heads.append(F.struct(lit(101).alias("no"), _line(lit("DEPT"), lit("FT"), lit(""), lit("MEASURED DEPTH")).alias("text")))
    heads += [F.struct(lit(102 + k).alias("no"), _line(lit(n), lit(u), lit(""), lit(n)).alias("text")) for k, (n, (_, u)) in enumerate(zip(names, curves, strict=True))]
    heads.append(F.struct(lit(900).alias("no"), lit("~OTHER INFORMATION").alias("text")))
    out = w.select("well_id", F.explode(F.array_compact(F.array(*heads))).alias("h")).select("well_id", F.lit(0).alias("part"), F.col("h.no").cast("double").alias("no"), "h.text")
    if tops is not None:
        t = tops.select("well_id", F.lit(0).alias("part"), (40.0 + F.row_number().over(order) / 1e6).alias("no"), _line(F.concat(F.lit("TOP_"), F.upper(plain_mnemonic("name"))), F.lit("FT"), F.round("md", 2).cast("string"), F.concat(F.lit("TOP "), F.col("name"))).alias("text"))
        out = out.unionByName(t)
    if survey is not None:
        head = survey.select("well_id").distinct().select("well_id", F.lit(0).alias("part"), F.lit(901.0).alias("no"), F.lit(" MD INC AZI TVD").alias("text"))
        s = survey.select("well_id", F.lit(0).alias("part"), (902.0 + F.row_number().over(order) / 1e6).alias("no"), F.concat_ws(" ", F.lit(""), *[number_text(c) for c in ("md", "inc", "azi", "tvd")]).alias("text"))
        out = out.unionByName(head).unionByName(s)
    start = wells.select("well_id", F.lit(1).alias("part"), F.lit(0.0).alias("no"), F.lit("~A  DEPT " + " ".join(names)).alias("text"))
    rows = samples.select("well_id", F.lit(2).alias("part"), F.col("md").alias("no"), F.concat_ws(" ", F.lpad(number_text("md", digits), 11, " "), *[F.lpad(number_text(c, digits), max(12, digits + 3), " ") for c, _ in curves]).alias("text"))
    return out.unionByName(start).unionByName(rows)


def las_texts(lines: DataFrame) -> DataFrame:
    """(well_id, value): one whole text per well. A file is one value, so it is as large as its well."""
    rows = F.array_sort(F.collect_list(F.struct("part", "no", "text")))
    return lines.groupBy("well_id").agg(F.array_join(F.transform(rows, lambda x: x["text"]), "\n").alias("value"))


def write_las(texts: DataFrame, path: str) -> None:
    """One folder of text per well."""
    texts.select("well_id", "value").write.partitionBy("well_id").text(path)


def write_logs(texts: DataFrame, path: str) -> None:
    """Texts one after another, a file for each task; las.read_ranges(logs=True) takes them apart again."""
    texts.select("value").write.text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", "true").csv(path)


def statistics_table(summary: DataFrame, curves: list[str]) -> DataFrame:
    """One row per well and zone from long statistics (well_id, zone, curve, mean, p10, p50, p90, n): columns <curve>_<statistic>."""
    wide = summary.groupBy("well_id", "zone").pivot("curve", curves).agg(*[F.first(c).alias(c) for c in ("mean", "p10", "p50", "p90", "n")])
    return wide


def save_project(tables: dict[str, DataFrame], path: str, buckets: int = 64) -> None:
    """Tables as Parquet; those with a well are partitioned by a bucket of it, so that changed wells can be overwritten alone."""
    for name, df in tables.items():
        if "well_id" in df.columns:
            df = df.withColumn("well_bucket", F.pmod(F.xxhash64("well_id"), F.lit(buckets)))
            df.repartition("well_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("well_bucket").parquet(f"{path}/{name}")
        else:
            df.write.mode("overwrite").parquet(f"{path}/{name}")
