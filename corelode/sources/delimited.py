"""Delimited tables and survey reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S


def sniff_delimiter(header: str) -> str:
    """Tab, semicolon or comma, by their counts in the header line."""
    tabs, commas, semis = header.count("\t"), header.count(","), header.count(";")
    return "\t" if tabs and tabs >= commas else ";" if semis > commas else ","


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """A table of text columns; quoted cells may hold the delimiter, quotes and line ends. Only the first line goes to the driver."""
    first = spark.read.text(path).where(F.trim("value") != "").first()
    sep = sniff_delimiter(first[0].lstrip("﻿") if first else "")
    t = spark.read.option("header", "true").option("sep", sep).option("quote", '"').option("escape", '"').option("multiLine", "true").option("ignoreLeadingWhiteSpace", "true").option("ignoreTrailingWhiteSpace", "true").csv(path)
    return t.toDF(*[c.lstrip("﻿") for c in t.columns]).na.drop("all")


# Words by which survey columns are known.
COLUMNS = {"md": r"^(MD|DEPTH|DEPT|MEASURED|MEAS)", "inc": r"^(INC|INCL|INCLINATION|DEV|DRIFT)", "azi": r"^(AZ|AZI|AZM|AZIM|AZIMUTH)", "tvd": r"^TVD$|^VERTICAL", "north": r"^(N/S|N/-S|NS|N-S|NORTH|\+N/-S)", "east": r"^(E/W|E/-W|EW|E-W|EAST|\+E/-W)", "dls": r"^(DLS|DOGLEG)"}


def _signed(w) -> Column:
    """A number that may carry a hemisphere letter."""
    v = S.to_double(F.regexp_replace(w, r"[NSEWnsew,]", ""))
    return F.when(F.upper(w).rlike("[SW]$"), -F.abs(v)).otherwise(v)


def _at(word) -> Column:
    """Place of a word in the text, from 1."""
    return F.position(word, F.col("text"))


def preamble(files: DataFrame) -> DataFrame:
    """(file, well, api, depth_unit, azimuth_reference) from what stands above the columns, and from the file's name."""
    body, name = F.col("value"), F.element_at(F.split("file", "/"), -1)
    get = lambda p: F.nullif(F.trim(F.regexp_extract(body, p, 1)), F.lit(""))
    in_name = F.nullif(F.regexp_extract(name, r"(?:^|[^0-9])([0-9]{10}(?:[0-9]{2}){0,2})(?:[^0-9]|$)", 1), F.lit(""))
    unit = S.length_unit(F.regexp_extract(body, r"(?im)depth[^\n]*?\b(ft|feet|m|meters?|metres?)\b", 1))
    return files.select(
        "file",
        F.coalesce(get(r"(?im)^\s*(?:well|well name|wellbore)\s*[:=,\t]\s*([^\n,;\t]+)"), F.regexp_replace(F.regexp_replace(name, r"\.[A-Za-z]+$", ""), r"[_\s-]*(directional|survey|dev)[_\s-]*", "")).alias("well"),
        F.coalesce(in_name, get(r"(?im)^\s*(?:api|uwi)[^:=\n]*[:=,\t]\s*([0-9][0-9 -]+)")).alias("api"),
        F.coalesce(unit, F.lit("ft")).alias("depth_unit"),
        F.lower(get(r"(?im)azimuth[^\n]*?\b(true|grid|magnetic)\b")).alias("azimuth_reference"),
    )


def read_surveys(files: DataFrame) -> DataFrame:
    """(file, line, md, inc, azi, tvd, north, east, dls) of survey reports (file, value): the first line that names depth, inclination and azimuth gives
    the columns; lines below it that start with as many numbers are stations. Delimited lines match by place; lines of aligned text match each
    number to the column whose middle is nearest to its own."""
    rows = files.select("file", F.posexplode(F.split("value", "\r\n|\r|\n")).alias("line", "text")).where("trim(text) != ''")
    delimiter = F.when(F.col("text").contains("\t"), "\t").when(F.col("text").contains(";"), ";").when(F.col("text").contains(","), ",")
    comma = F.transform(F.split("text", "[\t;,]"), lambda w: F.trim(w))
    # aligned text: cells are apart by two blanks or more in the header, by any blank below it
    title = F.regexp_extract_all("text", F.lit(r"(\S+(?: \S+)*)"))
    cells = F.when(delimiter.isNotNull(), comma).otherwise(title)
    kind = lambda p: F.array_position(F.transform("cells", lambda c: F.upper(c).rlike(p)), True)
    rows = rows.withColumn("cells", cells)
    found = F.struct(*[kind(p).alias(k) for k, p in COLUMNS.items()])
    heads = rows.where((kind(COLUMNS["md"]) > 0) & (kind(COLUMNS["inc"]) > 0) & (kind(COLUMNS["azi"]) > 0))
    heads = heads.withColumn("places", F.transform("cells", lambda c: _at(c) + F.length(c) / 2.0))
    head = heads.groupBy("file").agg(F.min_by(F.struct(F.col("line").alias("at"), found.alias("cols"), "places", delimiter.alias("sep")), "line").alias("h"))
    data = rows.join(head, "file").where("line > h.at")
    words = F.when(F.col("h.sep").isNotNull(), comma).otherwise(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    data = data.withColumn("words", words)

    def cell(name: str) -> Column:
        k = F.col(f"h.cols.{name}").cast("int")
        by_place = F.get("words", k - 1)
        where = F.get("h.places", k - 1)
        line_ends = F.transform("words", lambda w: _at(w) + F.length(w) / 2.0)
        near = F.array_position(F.transform(line_ends, lambda e: F.abs(e - where)), F.array_min(F.transform(line_ends, lambda e: F.abs(e - where)))).cast("int")
        aligned = F.when(F.size("words") == F.size("h.places"), by_place).otherwise(F.get("words", near - 1))
        return _signed(F.when(k > 0, F.when(F.col("h.sep").isNotNull(), by_place).otherwise(aligned)))

    out = data.select("file", "line", *[cell(c).alias(c) for c in COLUMNS])
    return out.where("md IS NOT NULL AND inc IS NOT NULL AND azi IS NOT NULL AND inc BETWEEN 0 AND 180")
