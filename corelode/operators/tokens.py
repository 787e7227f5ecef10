"""Calibration of scanned logs from their page text: words to phrases, depth labels to a depth scale, header fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import label_number

# Labels of header fields on log headings.
HEADER_LABELS = {"well": "^WELL( NAME)?:?$", "company": "^(COMPANY|OPERATOR):?$", "field": "^FIELD:?$", "county": "^COUNTY:?$", "state": "^STATE:?$", "api": "^API( NO| NUMBER)?[.:]?$", "kb": "^(K\\.?B\\.?|KELLY BUSHING):?$", "gl": "^(G\\.?L\\.?|GROUND LEVEL):?$"}


def phrases(tokens: DataFrame, gap: float = 1.2) -> DataFrame:
    """(doc_id, page, line_no, phrase_no, text, x, y, w, h): words of one line (middles within half a height) joined where the gap between
    them is under 1.2 heights. tokens: doc_id, page, text, x, y, w, h."""
    page = W.partitionBy("doc_id", "page")
    t = tokens.where("trim(text) != ''").withColumn("_m", F.col("y") + F.col("h") / 2.0)
    down = page.orderBy("_m", "x")
    t = t.withColumn("_l", F.when(F.col("_m") - F.lag("_m").over(down) <= 0.5 * F.col("h"), 0).otherwise(1)).withColumn("line_no", F.sum("_l").over(down))
    across = W.partitionBy("doc_id", "page", "line_no").orderBy("x")
    apart = F.col("x") - (F.lag("x").over(across) + F.lag("w").over(across)) >= gap * F.col("h")
    t = t.withColumn("_p", F.when(apart | F.lag("x").over(across).isNull(), 1).otherwise(0)).withColumn("phrase_no", F.sum("_p").over(across))
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "text"))), lambda s: s["text"]), " ")
    return t.groupBy("doc_id", "page", "line_no", "phrase_no").agg(words.alias("text"), F.min("x").alias("x"), F.min("y").alias("y"), (F.max(F.col("x") + F.col("w")) - F.min("x")).alias("w"), F.max("h").alias("h"))


def depth_labels(tokens: DataFrame) -> DataFrame:
    """Words that read as a depth: doc_id, page, x, y (middle), md."""
    return tokens.select("doc_id", "page", (F.col("x") + F.col("w") / 2.0).alias("x"), (F.col("y") + F.col("h") / 2.0).alias("y"), "h", label_number("text").alias("md")).where("md IS NOT NULL")


def fit_pages(labels: DataFrame, tolerance: float = 0.5, least: int = 3, neighbours: int = 4) -> DataFrame:
    """(doc_id, page, slope, intercept, n): md = slope * y + intercept of the depth labels of each page, robust against other numbers. Labels of one column
    (middles within two heights) propose scales with their next four below; the proposal that most labels agree with (at least three) is fitted by least
    squares, once more without labels that are off."""
    col = W.partitionBy("doc_id", "page", F.floor(F.col("x") / (4 * F.col("h")))).orderBy("y")
    pairs = labels.withColumns({"_n": F.collect_list(F.struct("y", "md")).over(col.rowsBetween(1, neighbours))}).select("doc_id", "page", "y", "md", F.explode("_n").alias("b"))
    slope = (F.col("b.md") - F.col("md")) / (F.col("b.y") - F.col("y"))
    prop = pairs.where("b.y > y AND b.md > md").select("doc_id", "page", slope.alias("s"), (F.col("md") - slope * F.col("y")).alias("c")).distinct()
    votes = prop.join(labels.select("doc_id", "page", F.col("y").alias("ly"), F.col("md").alias("lmd"), F.col("h").alias("lh")), ["doc_id", "page"])
    agree = F.abs(F.col("lmd") - (F.col("s") * F.col("ly") + F.col("c"))) <= tolerance * F.col("s") * F.col("lh")
    best = votes.where(agree).groupBy("doc_id", "page", "s", "c").agg(F.count_distinct("lmd").alias("n")).where(F.col("n") >= least)
    best = best.groupBy("doc_id", "page").agg(F.max_by(F.struct("s", "c"), F.struct("n", -F.col("s"), -F.col("c"))).alias("p"))

    def fitted(scale: DataFrame) -> DataFrame:
        j = labels.join(scale, ["doc_id", "page"]).where(F.abs(F.col("md") - (F.col("p.s") * F.col("y") + F.col("p.c"))) <= tolerance * F.col("p.s") * F.col("h"))
        return j.groupBy("doc_id", "page").agg(F.struct(F.regr_slope("md", "y").alias("s"), F.regr_intercept("md", "y").alias("c")).alias("p"), F.count("*").alias("n")).where(F.col("n") >= least)

    out = fitted(fitted(best).drop("n"))
    return out.select("doc_id", "page", F.col("p.s").alias("slope"), F.col("p.c").alias("intercept"), "n")


def consistent_pages(fits: DataFrame, off: float = 0.03, least: int = 3) -> DataFrame:
    """fits without pages whose scale is more than 3 percent off the document's median (of three fits or more)."""
    doc = W.partitionBy("doc_id")
    t = fits.withColumns({"_m": F.percentile("slope", F.lit(0.5)).over(doc), "_n": F.count("*").over(doc)})
    return t.where((F.col("_n") < least) | (F.abs(F.col("slope") / F.col("_m") - 1) <= off)).drop("_m", "_n")


def solve_pages(pages: DataFrame, fits: DataFrame) -> DataFrame:
    """(doc_id, page, slope, intercept, top_md, base_md, basis) of every page (doc_id, page, height): its own fit, or the scale of the last fitted page carried on
    by the heights between, or of the next one carried back."""
    j = pages.join(fits.select("doc_id", "page", "slope", "intercept"), ["doc_id", "page"], "left")
    up = W.partitionBy("doc_id").orderBy("page")
    start = F.coalesce(F.sum("height").over(up.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    j = j.withColumn("_start", start)
    own = F.when(F.col("slope").isNotNull(), F.struct("slope", "intercept", "_start", "page"))
    down = W.partitionBy("doc_id").orderBy(F.col("page").desc())
    j = j.withColumns({"_a": F.last(own, ignorenulls=True).over(up), "_b": F.last(own, ignorenulls=True).over(down)})
    # the nearer fit counts, the earlier one of two as near
    back = F.col("_a").isNull() | (F.col("_b").isNotNull() & (F.col("_b.page") - F.col("page") < F.col("page") - F.col("_a.page")))
    from_ = F.when(back, F.col("_b")).otherwise(F.col("_a"))
    j = j.withColumn("_f", from_)
    slope = F.col("_f.slope")
    intercept = F.col("_f.intercept") + slope * (F.col("_start") - F.col("_f._start"))
    basis = F.when(F.col("slope").isNotNull(), "fit").when(slope.isNotNull(), "continued")
    return j.select("doc_id", "page", slope.alias("slope"), intercept.alias("intercept"), intercept.alias("top_md"), (intercept + slope * F.col("height")).alias("base_md"), basis.alias("basis"))


def page_spans(solved: DataFrame, top: float, base: float) -> DataFrame:
    """The part of each page inside a depth window, as depths and as y."""
    low, high = F.greatest("top_md", F.lit(float(top))), F.least("base_md", F.lit(float(base)))
    y = lambda md: (md - F.col("intercept")) / F.col("slope")
    return solved.where(low < high).select("doc_id", "page", low.alias("from_md"), high.alias("to_md"), y(low).alias("from_y"), y(high).alias("to_y"))


def header_fields(phrase: DataFrame) -> DataFrame:
    """(doc_id, field, value): the phrase beside a label, else below it, else above it, nearest first."""
    label = F.coalesce(*[F.when(F.upper("text").rlike(p), f) for f, p in HEADER_LABELS.items()])
    named = phrase.withColumn("field", label)
    a = named.where("field IS NOT NULL").select("doc_id", "page", "field", F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("w").alias("aw"), F.col("h").alias("ah"))
    b = named.where("field IS NULL").select("doc_id", "page", "text", "x", "y", "w", "h")
    j = a.join(b, ["doc_id", "page"])
    beside = (F.abs(F.col("y") - F.col("ay")) <= 0.6 * F.col("ah")) & (F.col("x") >= F.col("ax") + F.col("aw")) & (F.col("x") - F.col("ax") - F.col("aw") < 15 * F.col("ah"))
    over = (F.col("x") < F.col("ax") + F.col("aw") + 2 * F.col("ah")) & (F.col("x") + F.col("w") > F.col("ax") - 2 * F.col("ah"))
    below = over & (F.col("y") > F.col("ay")) & (F.col("y") - F.col("ay") < 3 * F.col("ah"))
    above = over & (F.col("y") < F.col("ay")) & (F.col("ay") - F.col("y") < 3 * F.col("ah"))
    rank = F.when(beside, 0).when(below, 1).when(above, 2)
    far = F.hypot(F.col("x") - F.col("ax"), F.col("y") - F.col("ay"))
    return j.where(rank.isNotNull()).groupBy("doc_id", "field").agg(F.min_by("text", F.struct(F.col("page"), rank.alias("r"), far.alias("d"), F.col("text"))).alias("value"))
