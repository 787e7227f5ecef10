"""Filter interaction audit: what each filter removes, given those that ran before it, for every order of the filters.

Method: existential self-join. A document fails the copy filter if a left semi-join on the text's hash, the exact text and a smaller id finds it a
partner. The ids that it marks are united with those that fail the other filters (a bit for each filter), and the combinations of bits are counted
for each part of the corpus. Everything after that works on these counts, of which there are at most 2 ** filters a part and label.

The partner side holds one row for each text that occurs more than once, with its smallest id, which decides the same; texts are counted before they
are shuffled, and a hash of many rows is dealt out over shares, so a text that a third of the corpus holds is nobody's single task.

Defined results: a null text is empty (no words: it fails A alone, and E if an earlier text is empty too); a null part is the empty string; a row with a null id is
no document's earlier copy, has none, and no label. Rows that share an id are documents of their own; a label holds for all of them, and of several labels of an id the highest.
Very long texts are read whole. Extra columns are left out. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import for_shares, hot_keys, in_shares, written

SPACES = "[\\x20\\x09-\\x0D]+"
#: Rows of one text hash that go to one task.
HOT = 1000
#: The letter of the filter that the self-join decides.
COPY = "E"

#: What a document fails, by the columns text, n_words, n_distinct.
FILTERS: dict[str, Callable[[], Column]] = {
    "A": lambda: F.col("n_words") < 200,
    "B": lambda: 100 * F.col("n_distinct") < 50 * F.col("n_words"),
    "C": lambda: 100 * F.length(F.regexp_replace("text", "[^A-Z]+", "")) > 3 * F.length("text"),
    "D": lambda: F.col("text").rlike("[#$%&*|]"),
}


def _copies(texts: DataFrame, facts: DataFrame) -> DataFrame:
    """The rows (without the text) whose text a smaller id has too."""
    firsts = texts.groupBy("hash", "text").agg(F.min("doc_id").alias("first"), F.count("*").alias("times")).where("times > 1").drop("times")
    hot = hot_keys(facts, ["hash"], HOT)
    a, b = in_shares(texts, hot, ["hash"], "doc_id").alias("a"), for_shares(firsts, hot, ["hash"]).alias("b")
    same = (F.col("a.hash") == F.col("b.hash")) & (F.col("a.text") == F.col("b.text")) & (F.col("a._share") == F.col("b._share"))
    return a.join(b, same & (F.col("b.first") < F.col("a.doc_id")), "left_semi").drop("text", "_share")


def combinations(docs: DataFrame, labels: DataFrame, filters: dict[str, Callable[[], Column]] = FILTERS, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, bits, good, toxic, n): how many documents of a part fail just these filters; bit k stands for the k-th filter, the last for copies."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), text.alias("text"), F.xxhash64(text).alias("hash"), F.xxhash64(text, F.lit(1)).alias("check"))
    words = texts.withColumn("words", F.array_remove(F.split("text", SPACES), ""))
    counted = words.withColumns({"n_words": F.size("words"), "n_distinct": F.size(F.array_distinct("words"))}).drop("words")
    fails = sum((F.when(f(), 1 << k).otherwise(0) for k, f in enumerate(filters.values())), F.lit(0))
    key = ["doc_id", "part", "hash", "check"]
    facts = written(counted.select(*key, fails.alias("bits")), "facts")
    marked = _copies(texts, facts).select(*key, F.lit(1 << len(filters)).alias("bits"), F.lit(0).alias("n"))
    # rows that agree in all of the key have the same text, so they fail the same filters
    each = facts.withColumn("n", F.lit(1)).unionByName(marked).groupBy(*key).agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))
    known = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    return each.join(known, "doc_id", "left").groupBy("part", "bits", yes("good"), yes("toxic")).agg(F.sum("n").alias("n"))


def audit(counts: DataFrame, letters: str = "".join(FILTERS) + COPY) -> DataFrame:
    """One row per part, order of the filters and step, from combinations()."""
    k = len(letters)
    bit = {x: 1 << i for i, x in enumerate(letters)}
    orders = [("".join(o), i + 1, o[i], sum(bit[x] for x in o[:i])) for o in permutations(letters) for i in range(k)]
    # the step of a filter after a set of others is the same whatever their order: one count for each pair, in how many orders it stands
    pairs = sorted({(f, bit[f], before, factorial(bin(before).count("1")) * factorial(k - 1 - bin(before).count("1"))) for _, _, f, before in orders})
    steps = F.array(*[F.struct(F.lit(f).alias("filter"), F.lit(b).alias("bit"), F.lit(before).alias("before"), F.lit(times).cast("long").alias("times")) for f, b, before, times in pairs])
    failing, earlier = F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("bits").bitwiseAND(F.col("before")) != 0
    total = lambda what, name: F.sum(F.when(what, F.col("n")).otherwise(0)).alias(name)
    at = counts.withColumn("step", F.explode(steps)).select("part", "bits", "good", "toxic", "n", "step.*").groupBy("part", "filter", "before", "times").agg(
        total(~earlier & ~failing, "kept"),
        total(~earlier & failing, "removed"),
        total(earlier & failing, "redundant"),
        total(F.col("bits") == F.col("bit"), "unique_fails"),
        total(~earlier & failing & F.col("good"), "good_lost"),
        total(~earlier & failing & F.col("toxic"), "toxic_lost"),
    )
    at = at.groupBy("part", "filter").agg(F.collect_list(F.struct("before", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")).alias("at"), F.sum(F.col("removed") * F.col("times")).alias("shapley"))
    at = at.select("part", "filter", "shapley", F.inline("at"))
    table = counts.sparkSession.createDataFrame(orders, "filter_order string, step int, filter string, before int")
    return at.join(F.broadcast(table), ["filter", "before"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    counts = written(combinations(docs.select("doc_id", "text", "lang"), labels.select("doc_id", "quality", "toxic")), "combinations")
    return audit(counts)


OP11_SQL = r"""
WITH RECURSIVE
w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
e AS (SELECT text, min(doc_id) AS first FROM w GROUP BY text),
f AS (
  SELECT w.part, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic,
    (CASE WHEN len(words) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * length(regexp_replace(w.text, '[^A-Z]', '', 'g')) > 3 * length(w.text) THEN 4 ELSE 0 END)
    + (CASE WHEN regexp_matches(w.text, '[#$%&*|]') THEN 8 ELSE 0 END) + (CASE WHEN e.first < w.doc_id THEN 16 ELSE 0 END) AS bits
  FROM w JOIN e USING (text) LEFT JOIN l USING (doc_id)),
c AS (SELECT part, bits, good, toxic, count(*) AS n FROM f GROUP BY ALL),
x AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(letter, bit)),
o AS (
  SELECT letter AS filter_order, bit AS used, 1 AS k FROM x
  UNION ALL SELECT filter_order || letter, used + bit, k + 1 FROM o, x WHERE (used & bit) = 0),
s AS (
  SELECT o.filter_order, p.k AS step, x.bit, p.used - x.bit AS before
  FROM o JOIN o AS p ON o.k = 5 AND p.filter_order = left(o.filter_order, p.k) JOIN x ON x.letter = right(p.filter_order, 1)),
r AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN (bits & (before + bit)) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN (bits & before) = 0 AND (bits & bit) <> 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN (bits & before) <> 0 AND (bits & bit) <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN bits = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN (bits & before) = 0 AND (bits & bit) <> 0 AND good THEN n ELSE 0 END) AS good_lost,
    sum(CASE WHEN (bits & before) = 0 AND (bits & bit) <> 0 AND toxic THEN n ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM r
"""
