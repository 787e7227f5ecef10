"""The corpus operators against plain versions, on small inputs with every edge: nulls, empty and long texts, ties, repeats, empty
tables and clashing columns."""

import hashlib
import math
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corelode.llm import byte_bpe, chat_format, embedding_dedup, exact_dedup, graph, licenses, line_dedup, mixing, near_dedup, quality, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall(text or "")


def corpus(seed=3, n=60):
    r = random.Random(seed)
    vocabulary = [f"w{k}é" if k % 9 == 0 else f"W{k}" for k in range(400)]
    text = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    shared = text(45)
    rows = []
    for k in range(n):
        t = text(r.randint(1, 150))
        if k % 5 == 0:
            t = t + " " + shared
        if k % 7 == 0 and rows:
            t = rows[r.randrange(len(rows))][1]
        if k % 11 == 0 and rows and rows[-1][1]:
            w = rows[-1][1].split(" ")
            w[len(w) // 2] = "edited"
            t = " ".join(w)
        rows.append((k, t, "en", f"s{k % 4}", 0))
    rows += [(n, None, None, None, None), (n + 1, "", "en", "s1", 0), (n + 2, " \n\t ", "en", "s1", 4), (n + 3, "one", "en", None, 3), (n + 4, "de " * 400, "en", "s2", 1200), (n + 5, "one two", "en", "s0", 7), (n + 6, "one two", "en", "s0", 7)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plain_substring(rows, width=20):
    seen, out = set(), {}
    for i, text, *_ in sorted(rows):
        w = words(text)
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            window = tuple(w[k : k + width])
            if window in seen:
                gone[k : k + width] = [True] * width
            seen.add(window)
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out


def test_substring_dedup(spark, docs, rows):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.substring_dedup(docs).collect()}
    assert got == plain_substring(rows)


def test_substring_dedup_edges(spark):
    long = " ".join(f"x{k}" for k in range(30))
    rows = [(2, long), (1, long), (None, long), (3, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", F.lit(7)).withColumn("_spans", F.lit(1))
    out = substring_dedup.substring_dedup(d)
    assert out.columns == ["doc_id", "n_words", "n_removed", "kept_text"]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in out.collect()}
    assert got == {1: (30, 0), 2: (30, 30), None: (30, 0), 3: (0, 0)}
    twice = spark.createDataFrame([(1, long), (1, long)], "doc_id long, text string")
    assert [r.n_removed for r in substring_dedup.substring_dedup(twice).collect()] == [0, 0]
    assert substring_dedup.substring_dedup(empty(spark)).count() == 0


def test_substring_paths_of_repeats_across_batches(spark):
    """The same passage in many documents: each path names an earlier source with the same words."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        r = random.Random(1)
        passage = [f"p{k}" for k in range(50)]
        rows = [(k, " ".join([f"a{k}_{j}" for j in range(r.randint(0, 30))] + passage + [f"b{k}_{j}" for j in range(r.randint(0, 30))])) for k in range(40)]
        d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        paths = substring_dedup.repeated_paths(d).collect()
        text = {i: words(t) for i, t in rows}
        assert {p.doc_id for p in paths} == set(range(1, 40))
        for p in paths:
            assert (p.src_doc, p.src_pos) < (p.doc_id, p.pos)
            assert text[p.doc_id][p.pos : p.pos + p.n + 19] == text[p.src_doc][p.src_pos : p.src_pos + p.n + 19]
        got = {x.doc_id: (x.n_words, x.n_removed, x.kept_text) for x in substring_dedup.substring_dedup(d).collect()}
        assert got == plain_substring(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("hot", [1, 5, 30])
def test_substring_dedup_of_hot_passages(spark, docs, rows, monkeypatch, hot):
    """The edges of hot minimisers are opened and dealt out; what is removed stays the same."""
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    r = random.Random(2)
    passage = " ".join(f"p{k}" for k in range(45))
    more = [(100 + k, " ".join(f"a{k}_{j}" for j in range(r.randint(0, 30))) + " " + passage + f" {passage[:90]} b{k}", "en", "s", 0) for k in range(40)]
    d = docs.unionByName(spark.createDataFrame(more, SCHEMA))
    got = {x.doc_id: (x.n_words, x.n_removed, x.kept_text) for x in substring_dedup.substring_dedup(d).collect()}
    assert got == plain_substring([*rows, *more])


@pytest.fixture(scope="module")
def codec(spark):
    return byte_bpe.public_codec(spark)


def reference_encoding():
    import base64

    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_matches_library_and_round_trips(spark, docs, rows, codec):
    odd = ["a" * 5000, "ab" * 2000, "中文" * 50, "<|endoftext|>", "café \U0001f600  \n\n x", "  ", "'s 'll don't", "1234567890" * 30]
    d = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(1000 + k, t) for k, t in enumerate(odd)], "doc_id long, text string")).withColumn("tokens", F.lit("clash"))
    out = byte_bpe.decode(byte_bpe.encode(d, *codec), codec[0]).collect()
    plain = reference_encoding()
    assert len(out) == len(rows) + len(odd)
    for r in out:
        assert r.tokens == plain.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
    assert byte_bpe.decode(byte_bpe.encode(empty(spark), *codec), codec[0]).count() == 0
    checked = byte_bpe.encode(d, *codec, exact_col="same", keep_text=False)
    assert "text" not in checked.columns and "same" in checked.columns
    assert sorted((x.doc_id, list(x.tokens)) for x in checked.collect()) == sorted((x.doc_id, list(x.tokens)) for x in out)
    assert checked.where("same IS NULL OR NOT same").count() == 0


def shingles(text, k):
    w = words((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def plain_components(rows, k, num, den):
    sets = {r[0]: shingles(r[1], k) for r in rows}
    label = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((label[a], label[b]))
                label = {i: x if v == y else v for i, v in label.items()}
    return {i: (len(sets[i]), label[i]) for i in sets}


@pytest.mark.parametrize(("k", "share"), [(3, (85, 100)), (5, (80, 100)), (1, (50, 100))])
def test_near_dedup(docs, rows, k, share):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.components_of(docs, k, share).collect()}
    assert got == plain_components(rows, k, *share)


@pytest.mark.parametrize(("hot", "wide"), [(10, 0), (1000, 2)])
def test_near_dedup_large_family_of_edits(spark, monkeypatch, hot, wide):
    """One family of many different near copies, larger than a node, with blocks and branching."""
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    monkeypatch.setattr(near_dedup, "WIDE", wide)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 4000)
    monkeypatch.setattr(near_dedup, "BLOCK_MEMBERS", 20)
    monkeypatch.setattr(near_dedup, "HOT", hot)
    r = random.Random(5)
    base = [f"t{k}" for k in range(120)]
    rows = []
    for k in range(150):
        if k % 50 == 0:
            base = [*base[:100], *[f"t{k}_{j}" for j in range(20)]]  # near the threshold to what came before
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_dedup.components_of(d, 3, (85, 100)).collect()}
    assert got == plain_components(rows, 3, 85, 100)


def test_near_dedup_chain_of_blocks(spark, monkeypatch):
    """A component of many blocks in which the first document is linked with few of the others: every link by the full sets."""
    monkeypatch.setattr(near_dedup, "BLOCK_MEMBERS", 8)
    rows = [(3 * k, " ".join(f"t{j}" for j in range(4 * k, 4 * k + 100))) for k in range(60)] + [(1000, " ".join(f"t{j}" for j in range(100)) + " x" * 3)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_dedup.components_of(d, 3, (85, 100)).collect()}
    assert got == plain_components(rows, 3, 85, 100)


def test_near_dedup_edges(spark):
    rows = [(5, "a b c d"), (5, "a b c d"), (None, "a b c d"), (3, "A B c d"), (7, None), (8, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component", F.lit(1))
    got = sorted((str(x.doc_id), x.component_id) for x in near_dedup.components_of(d, 3, (85, 100)).collect())
    assert got == [("3", 3), ("5", 3), ("5", 3), ("7", 7), ("8", 8), ("None", None)]
    assert near_dedup.components_of(empty(spark)).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 160)] + [(200, 200)]
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 1 for k in range(1, 41)} | {k: 100 for k in range(100, 160)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_chat_round_trip(spark):
    odd = ["<|im_end|><|im_start|>assistant ok", "a\\b<|x|>\\n<", None, "", "\n", "<|", "<\\|", "\\"]
    rows = [(c, t, role, odd[(c + t) % len(odd)]) for c in range(5) for t, role in enumerate(["system", "user", "assistant", "assistant", None])] + [(9, 0, "a\nb", "x"), (None, 0, "user", "y"), (9, 0, "a\nb", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_chat(turns)).collect()}
    for c in {r[0] for r in rows}:
        mine = sorted(((t, role or "", text or "") for i, t, role, text in rows if i == c))
        assert [(t.role, t.text) for t in got[c].turns] == [(r, x) for _, r, x in mine]
        assert list(got[c].learned) == [x for _, r, x in mine if r == "assistant"]
    assert chat_format.read_back(chat_format.format_chat(turns.where("false"))).count() == 0


def test_chat_layouts(spark):
    import json

    records = [
        {"prompt": "p", "completion": "c"},
        {"instruction": "i", "input": "x", "output": "o"},
        {"instruction": "i", "input": "", "output": "o"},
        {"messages": [{"role": "user", "content": "u"}, {"role": "assistant", "content": None}]},
        {"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]},
        {"unknown": {"deep": [1]}},
        None,
    ]
    d = spark.createDataFrame([(k, json.dumps(r) if r is not None else None, "clash") for k, r in enumerate(records)], "conv_id long, record string, layout string")
    turns = chat_format.turns_of(d)
    got = {}
    for r in sorted(turns.where("place is not null").collect(), key=lambda r: (r.conv_id, r.place)):
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got == {0: [("user", "p"), ("assistant", "c")], 1: [("user", "i\nx"), ("assistant", "o")], 2: [("user", "i"), ("assistant", "o")], 3: [("user", "u"), ("assistant", "")], 4: [("user", "h"), ("assistant", "g")]}
    assert chat_format.unmapped(turns).agg(F.sum("records")).first()[0] == 2


def test_chat_records_become_conversations_in_their_order(spark):
    """Turns of one record keep their order, more fields don't make a layout unknown, unknown ones give no turn."""
    import json

    long = "a long text <| " * 100_000  # over a mebibyte
    records = [
        {"messages": [{"role": "user", "content": "b", "name": "x"}, {"role": "assistant", "content": "a"}], "id": 7},
        {"system": "s", "prompt": "z", "response": "a", "meta": {"score": [1, 2]}},
        {"instruction": "z", "output": long},
        {"unknown": 1},
        {"conversations": "not a list"},
    ]
    d = spark.createDataFrame([(k, json.dumps(r), "clash") for k, r in enumerate(records)], "conv_id long, record string, text string")
    turns = chat_format.turns_of(d)
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat_format.read_back(chat_format.format_chat(turns)).collect()}
    assert got == {0: [("user", "b"), ("assistant", "a")], 1: [("system", "s"), ("user", "z"), ("assistant", "a")], 2: [("user", "z"), ("assistant", long)]}
    assert chat_format.unmapped(turns).agg(F.sum("records")).first()[0] == 2
    assert chat_format.format_chat(chat_format.turns_of(d.where("false"))).count() == 0


def test_chat_query_layouts_hold_the_same_turns(spark):
    r = random.Random(2)
    rows = [(c, k, r.choice(["user", "assistant", "assistant", "system", "tool", None]), r.choice(["a", "b", None, "<|im_end|>"])) for c in range(-3, 40) for k in (0, 1, 1, 2, 3, 4)] + [(None, 0, "user", "x"), (None, None, "assistant", "y"), (8, None, "user", "n")]
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    records = chat_format.mixed_layouts(given)
    turns = chat_format.turns_of(records).cache()
    assert turns.select("layout").distinct().count() == 5
    key = lambda t: (t[0] is not None, t[0] or 0, t[1] or "", t[2] or "")
    got = {x.conv_id: [(t.role, t.text) for t in x.turns] for x in chat_format.read_back(chat_format.format_chat(turns)).collect()}
    assert got == {c: [(a or "", b or "") for _, a, b in sorted(((t, a, b) for i, t, a, b in rows if i == c), key=key)] for c in {x[0] for x in rows}}


def test_embedding_links(spark):
    r = np.random.default_rng(2)
    rows = []
    centres = r.standard_normal((8, 16))
    for k in range(400):
        v = centres[k % 8] + r.standard_normal(16) * r.choice([0.0, 0.05, 0.12, 1.0])
        rows.append((k, v.astype(np.float32).tolist(), k % 3))
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, rows[0][1], None), (904, [1.0], 1), (905, [1.0], 1), (906, [], 1), (907, [None] * 16, 1)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("rep", F.lit(1)).repartition(3)
    got = {x.vec_id: (x.n_links, x.component_id) for x in embedding_dedup.embedding_links(d, passes=12).collect()}
    good = [(i, np.array(v, np.float64), lab) for i, v, lab in rows if lab is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    label, links = {i: i for i, *_ in rows}, Counter()
    for a in range(len(good)):
        for b in range(a):
            (i, u, p), (j, v, q) = good[a], good[b]
            if p == q and len(u) == len(v) and u @ v / np.sqrt((u @ u) * (v @ v)) >= 0.98:
                links[i] += 1
                links[j] += 1
                x, y = sorted((label[i], label[j]))
                label = {k: x if z == y else z for k, z in label.items()}
    assert got == {i: (links[i], label[i]) for i, *_ in rows}
    assert embedding_dedup.embedding_links(d.where("false")).count() == 0


def test_embedding_links_of_a_dense_group(spark):
    r = np.random.default_rng(4)
    n, dim = 20_000, 64
    centre = r.standard_normal(dim)
    vectors = (centre / np.linalg.norm(centre) + 0.2 * r.standard_normal((n, dim)) / np.sqrt(dim)).astype(np.float32)
    d = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int").repartition(8)
    got = {x.vec_id: (x.n_links, x.component_id) for x in embedding_dedup.embedding_links(d).collect()}
    unit = vectors.astype(np.float64)
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    links, edges = np.zeros(n, np.int64), []
    for lo in range(0, n, 1000):
        i, j = np.nonzero(unit[lo : lo + 1000] @ unit.T >= 0.98)
        i += lo
        i, j = i[i != j], j[i != j]
        links += np.bincount(i, minlength=n)
        edges.append(np.stack([i, j]))
    edges, label = np.concatenate(edges, axis=1), np.arange(n)
    while (label[edges[0]] != label[edges[1]]).any():
        np.minimum.at(label, edges[0], label[edges[1]])
    assert 1000 < np.bincount(label).max() < n
    assert [got[k] for k in range(n)] == list(zip(links.tolist(), label.tolist(), strict=True))


def test_embedding_recall_at_the_threshold(spark):
    """20,000 spread-out vectors of one label with 2,000 planted pairs at cosines of 0.98 to 0.985: the passes find all but one in a hundred
    at most (by their plan one in a million)."""
    r = np.random.default_rng(8)
    n, pairs, dim = 20_000, 2_000, 64
    unit = lambda v: v / np.sqrt((v * v).sum(axis=1, keepdims=True))
    v = unit(r.standard_normal((n, dim)))
    side = r.standard_normal((pairs, dim))
    side = unit(side - (side * v[:pairs]).sum(axis=1, keepdims=True) * v[:pairs])
    c = r.uniform(0.98001, 0.985, (pairs, 1))
    v = np.concatenate([v, c * v[:pairs] + np.sqrt(1 - c * c) * side])
    d = spark.createDataFrame([(k, x.tolist(), 0) for k, x in enumerate(v)], "vec_id long, embedding array<double>, label int").repartition(8)
    assert embedding_dedup._plan(0.98, embedding_dedup.PASSES)[6][0] == 6  # such a label is not compared whole
    got = {x.vec_id: x.component_id for x in embedding_dedup.embedding_links(d).collect()}
    assert len(got) == n + pairs
    assert sum(got[n + k] == k for k in range(pairs)) >= 0.99 * pairs
    assert all(got[k] == k for k in range(n))


def hot_edges(n, distinct):
    """Edge rows of one minimiser: n documents with two edges, of which the second repeats after `distinct` documents."""
    doc = np.arange(n)
    hashes = [np.array([2 * k, 2 * (k % distinct) + 1], np.uint64).tobytes() for k in range(n)]
    none = pa.nulls(n, pa.int64())
    zero = np.zeros(n, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(zero + 7), pa.array(doc), pa.array(zero), pa.array(zero.astype(np.int32) + 9), pa.array(hashes, pa.binary()), none, none, none], names=["anchor", "doc_id", "pos", "off", "hashes", "n", "src_doc", "src_pos"])


def test_substring_memory_of_a_hot_minimiser():
    batch = hot_edges(600_000, 600_000)
    tracemalloc.start()
    for _ in substring_dedup._repeats(batch.slice(lo, 10_000) for lo in range(0, len(batch), 10_000)):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 48 << 20


@pytest.mark.parametrize("most", [0, 10, 150, 10_000])
def test_substring_edges_of_a_hot_minimiser(spark, monkeypatch, most):
    monkeypatch.setattr(substring_dedup, "HELD", most)
    batch = hot_edges(300, 100)
    other = pa.RecordBatch.from_arrays([pa.array(np.full(300, 8)) if c == "anchor" else batch.column(c) for c in batch.schema.names], names=batch.schema.names)
    both = pa.Table.from_batches([batch, other]).combine_chunks().to_batches()[0]
    found = [r for out in substring_dedup._repeats(both.slice(lo, 70) for lo in range(0, 600, 70)) for r in out.to_pylist()]
    runs = substring_dedup._closed(spark.createDataFrame([tuple(r.values()) for r in found], substring_dedup.FOUND)).collect()
    got = Counter()
    for r in runs:
        assert r.src_doc < r.doc_id and (r.doc_id - r.src_doc) % 100 == 0 and r.pos - r.src_pos == 0
        for k in range(r.n):
            got[r.doc_id, r.pos + k] += 1
    assert got == {(k, 1): 2 for k in range(100, 300)}


def plain_lines(rows, least=5, chars=40):
    space = " \t\n\x0b\x0c\r"
    key = lambda line: line.strip(space).translate(LOWER)
    holders = {}
    for i, text, *_ in rows:
        for line in (text or "").split("\n"):
            holders.setdefault(key(line), set()).add(i)
    out = {}
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if not (len(key(x)) >= chars and len(holders[key(x)]) >= least and i < max(holders[key(x)]))]
        out[i] = (len(lines), len(lines) - len(stay), "\n".join(stay))
    return out


def line_rows():
    r = random.Random(8)
    common = ["Éa shared line that is longer than forty characters", "another line that many documents share, of some length", "exactly forty code points long, so it isé", "short"]
    rows = []
    for k in range(40):
        lines = [r.choice(common) if r.random() < 0.4 else f"own line {k} {j} " + "x" * r.randint(0, 60) for j in range(r.randint(1, 8))]
        lines = [x.upper() if r.random() < 0.2 and x.isascii() else "  " + x + "\t" if r.random() < 0.2 else x for x in lines]
        rows.append((k, "\n".join(lines)))
    return rows + [(50, None), (51, ""), (52, "\n"), (53, common[0] + "\n" + common[0])]


def test_line_dedup_insert_and_delete(spark):
    rows = line_rows()
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit(1)).repartition(3)
    read = lambda df: {r.doc_id: (r.n_lines, r.n_dropped, r.text or "") for r in df.collect()}
    index = line_dedup.LineIndex.build(d)
    assert read(index.dedup(d)) == plain_lines(rows)
    first = d.where("doc_id < 20")
    grown = line_dedup.LineIndex.build(first).insert(d.where("doc_id >= 20"))
    assert read(grown.dedup(d)) == plain_lines(rows)
    back = grown.delete(d.where("doc_id >= 20").select("doc_id"))
    assert read(back.dedup(first)) == plain_lines([x for x in rows if x[0] < 20])
    assert line_dedup.LineIndex.build(d.where("false")).dedup(d.where("false")).count() == 0


def test_line_dedup_counts_ids_not_rows(spark):
    line = "a line that is surely longer than forty characters"
    five = spark.createDataFrame([(1, line)] * 5 + [(2, line)], "doc_id long, text string")
    assert [(r.n_dropped, r.text) for r in line_dedup.LineIndex.build(five).dedup(five).collect()] == [(0, line)] * 6
    six = spark.createDataFrame([(k, f"{line}\nown {k}") for k in (1, 1, 2, 3, 4, 5, 5)] + [(None, line)], "doc_id long, text string")
    got = sorted(line_dedup.LineIndex.build(six).dedup(six).collect(), key=lambda r: (r.doc_id or 0, r.text))
    assert [(r.doc_id, r.n_dropped) for r in got] == [(None, 0), (1, 1), (1, 1), (2, 1), (3, 1), (4, 1), (5, 0), (5, 0)]


@pytest.mark.parametrize(("hot", "lookups"), [(1, 10), (3, 1000)])
def test_line_dedup_of_lines_with_many_documents(spark, monkeypatch, hot, lookups):
    """Hot lines are dealt out in shares and lookups in many tasks; texts of over a mebibyte are handled whole."""
    monkeypatch.setattr(line_dedup, "HOT", hot)
    monkeypatch.setattr(line_dedup, "LOOKUPS", lookups)
    rows = [*line_rows(), (60, "\n".join([f"a line of its own in a very long text, number {k}" for k in range(25_000)] + [line_rows()[-1][1]]))]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.text or "") for r in line_dedup.LineIndex.build(d).dedup(d).collect()} == plain_lines(rows)


def test_shares_of_lines_that_agree_in_one_hash():
    hot = np.array([[5, 1, 2], [5, 7, 3], [9, 0, 4]], np.int64)
    h1, h2 = np.array([5, 5, 9, 5, 4]), np.array([7, 1, 0, 8, 1])
    doc = np.arange(5)
    got = line_dedup._share(h1, h2, doc, hot)
    mixed = line_dedup.X.mix(doc.view(np.uint64))
    assert got.tolist() == [int(mixed[0] % np.uint64(3)), int(mixed[1] % np.uint64(2)), int(mixed[2] % np.uint64(4)), 0, 0]


def test_line_dedup_grows_tenfold(spark):
    text = lambda lo, hi: "\n".join(f"a line that several documents hold in common, number {k}" for k in range(lo, hi))
    rows = [(k, text(0, 100) if k < 5 else text(100, 1000)) for k in range(10)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    grown = line_dedup.LineIndex.build(d.where("doc_id < 5")).insert(d.where("doc_id >= 5"))
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.text or "") for r in grown.dedup(d).collect()} == plain_lines(rows)


def test_cuckoo_filter():
    h = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 5000)
    f = line_dedup.filter_of(h)
    assert f.contains(h).all()
    other = np.random.default_rng(2).integers(-(2**63), 2**63 - 1, 20000)
    assert f.contains(other).mean() < 0.01
    f.delete(h[:2500])
    assert line_dedup.CuckooFilter.of(f.bytes()).contains(h[2500:]).all()
    assert f.contains(h[:2500]).mean() < 0.01


def test_licenses(spark):
    texts = [None, "", "Released under the MIT License.", "x\nthe gnu General public\nLICENSE cc-by", "Licensed under the Apache License, Version 2.0.", "apache licence", "été mit license " + "mit license " * 3, "word " * 500 + "released under some mit license"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("labels", F.lit(0))
    got = {r.doc_id: r for r in licenses.license_scan(d).collect()}
    assert (got[0].n_words, got[0].n_base, got[0].first_word, got[0].labels, got[0].score) == (0, 0, None, "", 0.0)
    assert got[1].n_words == 0
    assert (got[2].base_labels, got[2].labels, got[2].first_word) == ("mit", "mit", 3)
    assert (got[3].base_labels, got[3].n_base, got[3].first_word, got[3].last_word) == ("cc-by,gpl", 2, 2, 6)
    assert got[4].labels == "apache,apache-2.0"
    assert (got[5].labels, got[5].score) == ("", 0.0)
    assert (got[6].n_base, got[6].first_word, got[6].last_word) == (4, 1, 7)
    assert got[7].labels == "mit" and got[7].n_words == 505
    assert licenses.license_scan(empty(spark)).count() == 0


def test_licenses_of_wrapped_texts(spark):
    wrapped = {
        "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction",
        "bsd": "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions",
        "apache-2.0": " * you may not use this file except in compliance with the License.\r\n * You may obtain a copy of the License at\r\n *",
        "isc": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that",
        "gpl-3.0": "you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3",
    }
    before = "some code\n" * 37
    texts = [x + t for t in wrapped.values() for x in ("", before)]
    got = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for k, label in enumerate(wrapped):
        for i in (2 * k, 2 * k + 1):
            assert label in got[i].labels.split(",") and got[i].score >= 0.8


def plain_licenses(text, share=0.8, templates=licenses.TEMPLATES, phrases=licenses.PHRASES):
    """Phrase places and template containment of every block, word by word."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOWER))
    w = split(text or "")
    places = sorted((k, label) for p, label in phrases.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
    base = {label for _, label in places}
    best = {}
    for label, t in templates:
        words_ = split(t)
        want = set(words_)
        need = len(want) if len(want) < licenses.WHOLE else math.ceil(share * len(want))
        stride = licenses.STRIDE
        while stride < len(words_):
            stride *= 2
        for lo in range(0, len(w), stride):
            n = len(want & set(w[lo : lo + 2 * stride]))
            if n >= need:
                best[label] = max(best.get(label, 0.0), n / len(want))
    score = 1.0 if places else max(best.values(), default=0.0)
    return len(w), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted(base)), ",".join(sorted(base | set(best))), pytest.approx(score)


def test_licenses_against_a_plain_version(spark):
    r = random.Random(5)
    own = [("one", " ".join(f"k{k}" for k in range(12))), ("two", " ".join(f"k{k}" for k in range(6, 40))), ("few", "k1 k2 k3"), ("twice", "k9 k9 " + " ".join(f"m{k}" for k in range(15)))]
    vocabulary = [w for _, t in own for w in t.split()] + ["x", "MIT", "license", "cc", "By", "é"]
    texts = [None, "", " ".join(t for _, t in own)]
    for _ in range(150):
        parts = []
        for _ in range(r.randint(1, 6)):
            t = r.choice(own)[1].split()
            parts += [w for w in t if r.random() < 0.9] if r.random() < 0.6 else r.choices(vocabulary, k=r.randint(1, 30))
            r.random() < 0.3 and r.shuffle(parts)
        texts.append("".join(w + r.choice([" ", "\n# ", ", "]) for w in parts))
    for templates, given in ((own, texts), (licenses.TEMPLATES, [t for _, t in licenses.TEMPLATES] + ["\n".join("// " + x for x in t.split(",")) for _, t in licenses.TEMPLATES] + [" ".join(r.sample(t.split(), k=len(t.split()) * 5 // 6)) for _, t in licenses.TEMPLATES])):
        d = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")
        got = {x.doc_id: x for x in licenses.license_scan(d, templates=templates).collect()}
        for k, text in enumerate(given):
            x = got[k]
            assert (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels, x.labels, x.score) == plain_licenses(text, templates=templates), text


def test_licenses_of_repeats_and_long_texts(spark):
    long = "word " * 400_000 + dict(licenses.TEMPLATES)["mit"]  # over a mebibyte
    d = spark.createDataFrame([(1, long), (1, "mit license"), (1, "mit license"), (None, "mit license")], "doc_id long, text string")
    got = licenses.license_scan(d).collect()
    assert sorted((str(r.doc_id), r.n_words > 400_000, r.labels) for r in got) == [("1", False, "mit"), ("1", False, "mit"), ("1", True, "mit"), ("None", False, "mit")]


def test_licenses_of_a_long_template(spark):
    long = [f"t{k}" for k in range(90)]
    texts = [" ".join(["x"] * k + long) + " x\n" * 50 for k in (0, 1, 31, 45, 64, 89, 200)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = licenses.license_scan(d, templates=(("long", " ".join(long)),)).collect()
    assert [(r.labels, r.score) for r in got] == [("long", 1.0)] * len(texts)


def plain_targets(size, source, ratio=1.5, most=2.0):
    total = {}
    for k, s in source.items():
        total[s] = total.get(s, 0) + size[k]
    order = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    out, free, left = {}, set(order), ratio * sum(total.values())
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * total[s]]
        if not over:
            return out | share, total
        for s in over:
            out[s] = most * total[s]
            left -= out[s]
            free.discard(s)
    return out, total


def test_mixing(spark, rows):
    d = spark.createDataFrame(rows, SCHEMA).withColumn("rank", F.lit(1))
    got = {r.doc_id: r for r in mixing.taken(d, block=16).collect()}
    size = {r[0]: len(words(r[1])) for r in rows}
    source = {r[0]: r[3] for r in rows}
    want, total = plain_targets(size, source)
    by = Counter()
    for k, r in got.items():
        assert r["size"] == size[k] and r.source_size == total[source[k]]
        assert r.target == pytest.approx(want[source[k]])
        assert 0 <= r.taken <= 2 * size[k]
        by[source[k]] += r.taken
    for s in total:
        assert abs(by[s] - want[s]) <= 32
    again = {r.doc_id: r.taken for r in mixing.taken(d.repartition(5), block=16).collect()}
    assert again == {k: r.taken for k, r in got.items()}
    assert mixing.taken(empty(spark)).count() == 0


def plain_place(x, n, rank, epoch, seed=mixing.SEED):
    """The Feistel permutation with cycle walking, in plain integers."""
    m64 = (1 << 64) - 1

    def mixed(v):
        v = v & m64
        v = ((v ^ (v >> 30)) * 0xBF58476D1CE4E5B9) & m64
        v = ((v ^ (v >> 27)) * 0x94D049BB133111EB) & m64
        return v ^ (v >> 31)

    key = (mixed(rank + seed * 1_000_003) + mixed(epoch + 77)) & m64
    half = max(1, math.ceil(math.log2(max(n, 2)) / 2))
    mask = (1 << half) - 1
    while True:
        a, b = x >> half, x & mask
        for r in range(4):
            a, b = b, a ^ (mixed(b + key + r * 0x9E3779B97F4A7C15 % 2**64) & mask)
        x = (a << half) | b
        if x < n:
            return x


def test_mixing_takes_what_a_plain_version_takes(spark, rows, monkeypatch):
    """Every word of every slot by hand: packing in order, one block for each slot, and the sum for each row."""
    monkeypatch.setattr(mixing, "STRIDE", 16)
    given = [*rows, (5, "another text of the id five", "en", "s1", 0), (None, "no id at all", "en", None, 0), (None, "no id at all", "en", None, 0)]
    d = spark.createDataFrame(given, SCHEMA)
    block = 16
    sized = mixing.sizes(d).withColumn("stride", F.pmod(F.xxhash64("k1", "copy", F.lit(mixing.SEED)), F.lit(len(given) // 16))).collect()
    want, total = plain_targets({k: r["size"] for k, r in enumerate(sized)}, {k: r.source for k, r in enumerate(sized)})
    ranks = {s: k + 1 for k, s in enumerate(sorted(total, key=lambda s: (s is None, (s or "").encode())))}
    taken = Counter()
    for s in total:
        line = [r for r in sorted((r for r in sized if r.source == s), key=lambda r: (r.stride, r.k1, r.k2, r.copy)) for _ in range(r["size"])]
        n = math.ceil(len(line) / block)
        slots = min(math.floor(want[s] / total[s] * n + 0.5), 2 * n) if n else 0
        for slot in range(slots):
            k = plain_place(slot % n, n, ranks[s], slot // n)
            for r in line[k * block : (k + 1) * block]:
                taken[r.doc_id, r.k1, r.copy] += 1
    got = sorted((str(r.doc_id), r["size"], r.taken) for r in mixing.taken(d, block=block).collect())
    assert got == sorted((str(r.doc_id), r["size"], taken[r.doc_id, r.k1, r.copy]) for r in sized)


def test_mixing_draws_each_shard_from_the_shares(spark, monkeypatch):
    """Shards of nearly one size, each mixed like the whole; all slots once."""
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 500)
    plan = spark.createDataFrame([(1, 160_000, 160_000.0), (2, 480_000, 800_000.0), (3, 16, 16.0), (4, 0, 0.0)], "rank long, source_size long, target double")
    got = mixing.drawn(plan, block=16).collect()
    by = Counter((r["rank"], r.shard) for r in got)
    assert sorted((r["rank"], r.slot) for r in got) == [(1, k) for k in range(10_000)] + [(2, k) for k in range(50_000)] + [(3, 0)]
    shards = 1 + max(r.shard for r in got)
    assert shards == 121
    for shard in range(shards):
        size = sum(by[k, shard] for k in (1, 2, 3))
        assert abs(size - 60_001 / shards) < 60
        assert abs(by[1, shard] / size - 1 / 6) < 0.09
    spread = np.std([by[1, k] for k in range(shards)])
    assert 0.6 < spread / math.sqrt(496 * 5 / 36) < 1.5


def test_mixing_reads_no_text_for_another(spark):
    """Two rows of one id, one short: each gives its own words only."""
    long, short, third = (" ".join(f"{c}{k}" for k in range(n)) for c, n in (("a", 100), ("b", 3), ("c", 50)))
    d = spark.createDataFrame([(1, long, "en", "s", 0), (1, short, "en", "s", 0), (2, third, "en", "s", 0), (2, third, "en", "s", 1)], SCHEMA).withColumn("_k1", F.lit("kept")).coalesce(1)
    whole = {long: set(words(long)), short: set(words(short)), third: set(words(third))}
    out = mixing.mixed_documents(d, block=4).collect()
    assert all(r._k1 == "kept" and r.text and any(set(words(r.text)) <= w for w in whole.values()) for r in out)
    assert sum(len(words(r.text)) for r in out) == sum(r.taken for r in mixing.taken(d, block=4).collect())
    huge = " ".join(f"h{k}" for k in range(200_000))  # over a mebibyte
    d = spark.createDataFrame([(1, huge, "en", "s", 0), (2, short, "en", "s", 0)], SCHEMA)
    got = Counter(w for r in mixing.mixed_documents(d).collect() for w in words(r.text))
    assert sum(got.values()) == sum(r.taken for r in mixing.taken(d).collect()) and max(got.values()) <= 2
    assert set(got) <= set(words(huge)) | set(words(short))


def test_mixing_source_without_words(spark, rows):
    given = [*rows, (801, "", "en", "s1b", 0), (802, None, "en", "s1b", 0), (803, " \n", "en", "s1b", 2)]
    d = spark.createDataFrame(given, SCHEMA)
    got = {r.doc_id: r for r in mixing.taken(d, block=16).collect()}
    assert len(got) == len(given)
    assert all((got[k]["size"], got[k].source_size, got[k].target, got[k].taken) == (0, 0, 0.0, 0) for k in (801, 802, 803))
    want, _ = plain_targets({r[0]: len(words(r[1])) for r in given}, {r[0]: r[3] for r in given})
    by = Counter()
    for r in given:
        assert got[r[0]].target == pytest.approx(want[r[3]])
        by[r[3]] += got[r[0]].taken
    assert all(abs(by[s] - want[s]) <= 32 for s in want)
    assert sum(len(words(r.text)) for r in mixing.mixed_documents(d, block=16).collect()) == sum(by.values())
    alone = mixing.taken(d.where("source = 's1b'")).collect()
    assert sorted((r.doc_id, r.target, r.taken) for r in alone) == [(k, 0.0, 0) for k in (801, 802, 803)]


def test_mixed_documents(spark, rows):
    d = spark.createDataFrame(rows, SCHEMA)
    out = mixing.mixed_documents(d, block=16)
    assert out.columns == d.columns
    got = Counter()
    text = {r[0]: r[1] or "" for r in rows}
    for r in out.collect():
        got[r.doc_id] += len(words(r.text))
        assert r.text == text[r.doc_id] or set(words(r.text)) <= set(words(text[r.doc_id]))
    taken = {r.doc_id: r.taken for r in mixing.taken(d, block=16).collect()}
    assert {k: v for k, v in taken.items() if v} == dict(got)


def test_permutation():
    for n in (1, 2, 3, 17, 1000):
        p = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 5, np.uint64))
        assert sorted(p.tolist()) == list(range(n))


def test_quality_learns_and_scores_everything(spark):
    r = random.Random(4)
    syllables = ["an", "er", "the", "ing", "or", "al"]
    good = lambda: " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(r.randint(5, 200))).capitalize() + "."
    bad = lambda: (lambda w: " ".join([w] * r.randint(20, 200)))("".join(r.choice(syllables) for _ in range(3)))
    rows = [(k, good() if k % 3 else bad(), int(k % 3 > 0)) for k in range(400)]
    d = spark.createDataFrame([(k, t) for k, t, _ in rows] + [(1000, None), (1001, ""), (None, "a b c")], "doc_id long, text string").withColumn("score", F.lit("x"))
    labels = spark.createDataFrame([(k, q, 0) for k, _, q in rows[:300]] + [(5, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(d, labels)
    got = {x.doc_id: x.score for x in quality.scored(d, model).collect()}
    assert len(got) == 403 and all(0 <= s <= 1 for s in got.values())
    right = [(got[k] >= 0.5) == (q == 1) for k, _, q in rows[300:]]
    assert np.mean(right) > 0.95
    assert quality.train(d, labels.where("quality = 1")) is None
    assert {x.score for x in quality.scored(d, None).collect()} == {0.5}
    assert quality.scored(empty(spark), model).count() == 0


def test_learnable_leaves_out_the_held_out_third(spark):
    import zlib

    labels = spark.createDataFrame([(k, 1, 0) for k in range(200)], "doc_id long, quality int, toxic int")
    got = {r.doc_id for r in quality.learnable(labels).collect()}
    assert got == {k for k in range(200) if zlib.crc32(str(k).encode()) % 3 != 1}


def some_bags(r, docs=60):
    size = r.integers(1, 5, docs)
    first = np.concatenate([[0], np.cumsum(size)])
    n = r.integers(0, 6, first[-1])
    return quality.Bags(r.standard_normal((first[-1], quality.FEATURES)), r.integers(0, quality.BUCKETS, n.sum()).astype(np.uint16), n, first)


def test_attention_gradients_are_those_of_the_loss():
    r = np.random.default_rng(1)
    bags, y = some_bags(r, 12), (np.arange(12) % 2).astype(float)
    model = quality.fresh(bags)
    model.e[:] = r.standard_normal(model.e.shape)
    _, grads = model.gradients(bags, y)
    for k in quality.WEIGHTS:
        value = getattr(model, k)
        spots = [np.unravel_index(i, value.shape) for i in r.choice(value.size, min(value.size, 6), replace=False)]
        if k == "e":
            spots = [(int(w), j) for w, j in zip(bags.words[:6], range(6), strict=True)]
        for at in spots:
            was, step, both = value[at], 1e-5, []
            for s in (1, -1):
                value[at] = was + s * step
                both.append(model.gradients(bags, y)[0])
            value[at] = was
            assert grads[k][at] == pytest.approx((both[0] - both[1]) / (2 * step), rel=1e-4, abs=1e-9)


def test_attention_finds_the_passage_that_counts():
    """Labels that hang on one passage's form, or on one word somewhere in the text."""
    for by_word in (False, True):
        r = np.random.default_rng(0)
        bags, y = some_bags(r, 400), (np.arange(400) % 2).astype(float)
        one = bags.first[:-1] + r.integers(0, np.diff(bags.first))
        if by_word:
            bags.n[one] = np.maximum(bags.n[one], 1)
            bags.words = r.integers(10, quality.BUCKETS, bags.n.sum()).astype(np.uint16)
            bags.words[(np.cumsum(bags.n) - bags.n)[one[y == 1]]] = 7
        else:
            bags.form[one, 3] += 4 * y
        p = quality.fit(bags, y).score(bags)
        assert ((p >= 0.5) == (y == 1)).mean() > 0.9


def test_quality_sample_is_bounded_in_passages(spark):
    rows = [(k, "word " * (48 * (k % 5 + 1)), k % 2) for k in range(60)] + [(100, "word " * 48 * 20_000, 1)]
    d = spark.createDataFrame([x[:2] for x in rows] + [rows[0][:2]] * 3, "doc_id long, text string")
    labels = spark.createDataFrame([(k, q, 0) for k, _, q in rows], "doc_id long, quality int, toxic int")
    seen = []
    real = quality.fit
    quality.fit = lambda bags, y: seen.append((len(bags.n), len(y))) or real(bags, y)
    try:
        model = quality.train(d, labels, most=50)
    finally:
        quality.fit = real
    assert seen[0][0] <= 50 and seen[0][0] > 40 and model is not None
    got = quality.scored(d, model).collect()
    assert len(got) == 64 and all(0 <= x.score <= 1 for x in got)


@pytest.mark.parametrize("most", [1, 2, 1000])
def test_exact_dedup(spark, monkeypatch, most):
    """Without salts, with salts of the larger groups, and with salts of all groups."""
    monkeypatch.setattr(exact_dedup, "MOST", most)
    rows = [(5, "a  b"), (2, "a b"), (9, "a\tb"), (1, None), (3, ""), (4, " "), (6, "\n\n"), (7, "x" * 2_000_000), (8, "x" * 2_000_000), (None, "a b"), (None, "alone"), (2, "a b"), (11, "A b")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("keep_id", F.lit(0)).repartition(3)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    want = sorted(((str(i), min((x for x in groups[norm(t)] if x is not None), default=None), len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows), key=str)
    got = sorted(((str(r.doc_id), r.keep_id, r.group_size, r.text_sha256) for r in exact_dedup.copies(d).collect()), key=str)
    assert got == want
    assert sorted(r.doc_id for r in exact_dedup.exact_dedup(d.where("doc_id is not null")).collect()) == [1, 2, 2, 4, 7, 11]
    assert exact_dedup.copies(empty(spark)).count() == 0


def test_pipeline_stages(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    r = random.Random(6)
    syllables = ["an", "er", "the", "ing", "or", "al", "tion", "re"]
    good = lambda n: " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(n))
    footer = "this footer line stands in very many of the documents here"
    rows = []
    for k in range(150):
        t = good(r.randint(60, 120)) + ("\n" + footer if k % 3 == 0 else "")
        if k % 10 == 9:
            t = rows[-1][1]
        if k % 5 == 2:
            t = "spam " * 80
        rows.append((k, t, "en", f"s{k % 3}", len(t)))
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, int(k % 5 != 2), 0) for k, *_ in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path)).cache()
        seen[name] = docs.collect()
    clean = [x for x in rows if not x[1].startswith("spam")]
    assert {x.doc_id for x in seen["quality"]} == {x[0] for x in clean}
    assert {x.doc_id: x.text for x in seen["line_dedup"]} == {i: v[2] for i, v in plain_lines([x[:2] for x in clean]).items()}
    want = plain_components([(x.doc_id, x.text) for x in seen["line_dedup"]], 5, 80, 100)
    assert {x.doc_id for x in seen["near_dedup"]} == {i for i, (_, c) in want.items() if i == c}
    assert all(tuple(seen[n][0].asDict()) == tuple(pipeline.COLUMNS) for n in ("quality", "line_dedup", "near_dedup", "mixing"))
    assert all(x.n_chars == len(x.text) for x in seen["mixing"])
    assert all(x.exact and x.n_tokens == len(x.tokens) for x in seen["tokens"])
    assert pipeline.run(spark, str(tmp_path)).count() == len(seen["tokens"])
