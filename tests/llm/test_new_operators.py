"""Filter audit, centroid clustering and suffix dedup against plain versions, with every edge."""

import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corelode.llm import centroids, chat_format, exact_dedup, filter_audit, suffix_dedup
from corelode.llm.queries import QUERIES, SQL

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


# --- filter audit


def plain_audit(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    docs = []
    for i, text, lang in rows:
        t = text or ""
        w = WORD.findall(t)
        fails = ("A" if len(w) < 200 else "") + ("B" if 100 * len(set(w)) < 50 * len(w) else "") + ("C" if 100 * len(re.findall("[A-Z]", t)) > 3 * len(t) else "")
        fails += ("D" if re.search("[#$%&*|]", t) else "") + ("E" if i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows) else "")
        docs.append((lang or "", fails, i in good, i in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                shapley[f] += len(gone)
                fail = [d for d in own if f in d[1]]
                out[part, "".join(order), k + 1] = [len(left), len(gone), len(fail) - len(gone), sum(d[1] == f for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone)]
        for key, v in out.items():
            if key[0] == part:
                v.append(shapley[key[1][key[2] - 1]])
    return {k: tuple(v) for k, v in out.items()}


def audited(spark, rows, labels, hot=1000):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("bits", F.lit("clash")).repartition(3)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    before, filter_audit.HOT = filter_audit.HOT, hot
    try:
        got = filter_audit.audit(filter_audit.combinations(docs, known)).collect()
    finally:
        filter_audit.HOT = before
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got}


@pytest.mark.parametrize("hot", [1000, 2])
def test_audit_agrees_with_a_plain_count(spark, hot):
    r = random.Random(2)
    words = [f"w{k}é" for k in range(300)]
    texts = [" ".join(r.choice(words[: r.choice([5, 300])]) for _ in range(r.choice([3, 210, 400]))) for _ in range(12)]
    texts += [t.upper() for t in texts[:3]] + [t + " 5%" for t in texts[3:6]] + ["", None, " \n ", "x" * 70_000]
    rows = [(k, texts[k % 5] if k % 3 == 0 else r.choice(texts), r.choice(["en", "de", "", None])) for k in range(90)]
    rows += [(7, rows[7][1], rows[7][2]), (7, "other text", "en"), (None, texts[0], "en"), (None, texts[0], "en"), (900, texts[0], None)]
    labels = [(k, k % 2, int(k % 5 == 0)) for k in range(0, 95, 3)] + [(3, 0, 1), (None, 1, 1), (5000, 1, 1)]
    assert audited(spark, rows, labels, hot) == plain_audit(rows, labels)


def test_audit_of_nothing(spark):
    assert audited(spark, [], [(1, 1, 1)]) == {}


def test_audit_rows_of_a_part(spark):
    got = audited(spark, [(1, "a b", "en")], [])
    assert len(got) == 600 and {k[2] for k in got} == {1, 2, 3, 4, 5} and got["en", "BCDEA", 5] == (0, 1, 0, 1, 0, 0, 120)


def test_copies_don_t_meet_in_pairs(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("the same text").alias("text"), F.lit("en").alias("lang"))
    counts = filter_audit.combinations(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert sorted((r.bits, r.n) for r in counts) == [(1, 1), (17, 3999)]


# --- centroid clustering


def plain_clusters(rows, k=16, rounds=3, dims=64):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) and abs(x) <= centroids.MOST for x in v)]
    # a null id has no hash and comes last
    centres = [q for _, q in sorted(kept, key=lambda r: (r[0] is None, "" if r[0] is None else sha(f"1:{r[0]}"), r[1]))[:k]]
    for r in range(rounds + 1):
        where = [min(range(len(centres)), key=lambda c: (sum((a - b) ** 2 for a, b in zip(q, centres[c], strict=True)), c)) for _, q in kept]
        if r < rounds:
            for c in range(len(centres)):
                own = [q for (_, q), w in zip(kept, where, strict=True) if w == c]
                if own:
                    centres[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return sorted((str(i), w, sum((a - b) ** 2 for a, b in zip(q, centres[w], strict=True))) for (i, q), w in zip(kept, where, strict=True)), centres


def vectors(n, seed=4, copies=0):
    g = np.random.default_rng(seed)
    mids = g.standard_normal((6, 64))
    rows = [(k, (mids[k % 6] + 0.4 * g.standard_normal(64)).astype(np.float32).tolist()) for k in range(n)]
    return rows + [(n + k, rows[0][1]) for k in range(copies)]


EDGES = [(900, None), (901, []), (902, [0.0] * 63), (903, [None] + [0.0] * 63), (904, [float("nan")] + [0.0] * 63), (905, [float("inf")] + [0.0] * 63), (906, [3e38] * 64), (907, [0.0] * 64), (907, [0.0] * 64), (None, [0.5] * 64)]


@pytest.mark.parametrize("rows", [vectors(150, copies=80) + EDGES, vectors(5), EDGES, EDGES[:7], []], ids=["many", "fewer than centroids", "edges", "none whole", "empty"])
def test_clusters_agree_with_plain_rounds(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cluster", F.lit("clash")).repartition(3)
    found, points = centroids.cluster(df)
    want, centres = plain_clusters(rows)
    assert sorted((str(r.vec_id), r.cluster, r.distance) for r in found.collect()) == want
    assert points.tolist() == centres


def test_bounds_leave_centroids_out_and_keep_ties():
    g = np.random.default_rng(1)
    for trial in range(40):
        k, d, n = int(g.integers(1, 17)), int(g.integers(1, 9)), 300
        mids = g.integers(-30, 30, (6, d))
        q = (mids[g.integers(0, 6, n)] + g.integers(-3, 4, (n, d))).astype(np.int64)
        points, before, known, compared = q[g.choice(n, k)].copy(), None, None, 0
        for r in range(4):
            c = centroids.Centroids(points, before)
            got = centroids.assign(q, known, c, r == 3)
            squares = ((q[:, None] - points[None]) ** 2).sum(2)
            best = squares.argmin(1)  # the first of equal ones
            assert (got[0] == best).all(), trial
            compared += got[5].sum()
            known, before, points = got[:4], points, points.copy()
            for j in range(k):
                if (best == j).any():
                    points[j] = q[best == j].sum(0) // (best == j).sum()
        assert (got[4] == squares.min(1)).all()
        assert compared < 4 * n * k or k < 3


def test_components_must_fit(spark):
    with pytest.raises(ValueError):
        centroids.cluster(spark.createDataFrame([], "vec_id long, embedding array<float>"), dims=4096, scale=4096)


# --- suffix dedup


def plain_suffixes(rows, width):
    seen, out = {}, []
    parts = {}
    placed = []
    for i, text in rows:
        t = (text or "").encode()
        placed.append((i, parts.get(i, 0), t))
        parts[i] = parts.get(i, 0) + len(t)
    for i, base, t in placed:
        for k in range(len(t) - width + 1):
            at = (i, base + k)
            if i is not None:
                seen[t[k : k + width]] = min(seen.get(t[k : k + width], at), at)
    for i, base, t in placed:
        gone = [False] * len(t)
        for k in range(len(t) - width + 1):
            if i is not None and seen[t[k : k + width]] < (i, base + k):
                gone[k : k + width] = [True] * width
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((str(i), len(t), sum(gone), spans, sha(bytes(b for b, g in zip(t, gone, strict=True) if not g))))
    return sorted(out)


def byte_corpus(seed, width, n=60, alphabet="abcdefghij é"):
    r = random.Random(seed)
    piece = lambda k: "".join(r.choice(alphabet) for _ in range(k))
    shared = [piece(r.randint(1, 3 * width)) for _ in range(8)]
    rows = [(k, " ".join(r.choice(shared) if r.random() < 0.6 else piece(r.randint(0, 2 * width)) for _ in range(r.randint(0, 6)))) for k in range(n)]
    rows += [(n, None), (n + 1, ""), (n + 2, "ab" * (3 * width)), (n + 3, rows[3][1]), (n + 4, rows[3][1] + "x"), (n + 5, piece(width)), (n + 6, piece(width - 1))]
    return rows


def deduped(spark, rows, width):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit(1)).repartition(4)
    got = suffix_dedup.suffix_dedup(df, width)
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, sha(bytes(r.kept))) for r in got.collect())


@pytest.mark.parametrize("width", [10, 100])
def test_suffix_dedup(spark, width):
    rows = byte_corpus(width, width) + [(None, "ab" * (2 * width)), (None, None)]
    assert deduped(spark, rows, width) == plain_suffixes(rows, width)


@pytest.mark.parametrize("alphabet", ["ab", "a"])
def test_suffix_dedup_of_periodic_texts(spark, alphabet):
    rows = byte_corpus(8, 20, 25, alphabet)
    assert deduped(spark, rows, 20) == plain_suffixes(rows, 20)


def test_suffix_dedup_of_hot_anchors_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 3)
    monkeypatch.setattr(suffix_dedup, "SHARES", 2)
    monkeypatch.setattr(suffix_dedup, "MANY", 4)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 128)
    rows = byte_corpus(5, 20, 80)
    assert deduped(spark, rows, 20) == plain_suffixes(rows, 20)


def test_suffix_dedup_of_repeated_ids(spark):
    """Rows of an id are parts of one document: a repeated row loses what its first keeps."""
    text = "".join(random.Random(1).choices("abcdefgh", k=150))
    got = deduped(spark, [(1, text), (1, text), (1, "short"), (2, text[20:140] + "!")], 100)
    assert sorted(x[2] for x in got) == [0, 0, 120, 150]


def test_suffix_dedup_of_long_texts_and_nothing(spark):
    r = random.Random(3)
    long = "".join(r.choice("abcdefghijklmnop ") for _ in range(700_000))
    rows = [(1, long), (2, long[300_000:300_500] + "#" + long[:99]), (3, "x" + long)]
    got = {x[0]: x for x in deduped(spark, rows, 100)}
    assert got["1"][2:4] == (0, 0) and got["2"][2:4] == (500, 1) and got["3"][2:4] == (700_000, 1)
    assert deduped(spark, [], 100) == []


def test_suffix_dedup_asks_for_integers(spark):
    with pytest.raises(TypeError):
        suffix_dedup.suffix_dedup(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_lying_hashes_are_found_out(monkeypatch):
    """With hashes that make all bytes equal the order still is that of the bytes."""
    r = random.Random(2)
    strings = ["".join(r.choice("ab") for _ in range(r.randint(0, 12))).encode() for _ in range(60)]
    ends = np.cumsum([0, *map(len, strings)])
    data = np.frombuffer(b"".join(strings), np.uint8)
    heads = np.array([0, 20, 21])
    for liar in (False, True):
        if liar:
            monkeypatch.setattr(suffix_dedup.X, "_BYTE", np.ones(256, np.uint64))
        order, common = suffix_dedup.Suffixes(data, ends[:-1], ends[1:]).sorted(heads)
        for lo, hi in ((0, 20), (20, 21), (21, 60)):
            got = [strings[k] for k in order[lo:hi]]
            assert got == sorted(strings[lo:hi])
            assert common[lo] == -1
            for k in range(lo + 1, hi):
                a, b = strings[order[k - 1]], strings[order[k]]
                assert common[k] == next((t for t in range(min(len(a), len(b))) if a[t] != b[t]), min(len(a), len(b)))


# --- the queries


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("new")
    rows = [(i, t, ["en", "de", None][(i or 0) % 3]) for i, t in byte_corpus(11, 100, 80)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(k, k % 2, int(k % 4 == 0)) for k in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(vectors(120, copies=30) + [(999, None)], "vec_id long, embedding array<float>").write.parquet(f"{at}/embeddings.parquet")
    return str(at), rows


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_centroids"])
def test_new_queries_agree_with_their_sql(spark, sf, name):
    con = pytest.importorskip("duckdb").connect()
    for t in ("documents", "labels", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf[0]}/{t}.parquet/*.parquet'")
    df = QUERIES[name](spark, sf[0])
    columns = sorted(df.columns)
    want = con.sql(SQL[name]).project(", ".join(columns)).fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in df.select(*columns).collect())


def test_op13(spark, sf):
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op13_suffix_dedup"](spark, sf[0]).collect())
    assert got == plain_suffixes([r[:2] for r in sf[1]], 100)


# --- earlier operators


def test_exact_dedup_of_ids_with_several_texts(spark):
    df = spark.createDataFrame([(0, "zzz"), (1, "aaa"), (1, "zzz"), (1, "aaa"), (None, "n"), (2, None), (3, "")], "doc_id long, text string").withColumn("_sha", F.lit("clash"))
    assert sorted(map(str, exact_dedup.exact_dedup(df).select("doc_id", "text").collect())) == sorted(["Row(doc_id=0, text='zzz')", *["Row(doc_id=1, text='aaa')"] * 2, "Row(doc_id=None, text='n')", "Row(doc_id=2, text=None)"])


def test_records_that_are_no_json_or_hold_lists(spark):
    records = ["not json", "[1, 2", "7", None, '{"prompt": ["p", "q"], "response": "r"}', '{"messages": []}', '{"messages": [{"role": "user", "content": "a"}]}', "[" * 100_000]
    turns = chat_format.turns_of(spark.createDataFrame(list(enumerate(records)), "conv_id long, record string"))
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat_format.read_back(chat_format.format_chat(turns)).collect()}
    assert got == {4: [("user", "p\nq"), ("assistant", "r")], 6: [("user", "a")]}
    assert chat_format.unmapped(turns).agg(F.sum("records")).first()[0] == 5
