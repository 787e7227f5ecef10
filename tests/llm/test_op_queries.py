"""The registered queries over small tables on disk: digests and columns as their contracts state, against plain versions or SQL."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from corelode.llm.queries import QUERIES, SQL

from .test_corpus import SCHEMA, corpus, plain_components, plain_licenses, plain_lines, plain_substring, reference_encoding, words


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    common = "a line that is held by many of these small documents"
    out = []
    for i, t, *rest in corpus(seed=9):
        if t and r.random() < 0.5:
            t = f"{t}\n{common}\nReleased under the MIT License."
        out.append((i, t, *rest))
    return out


@pytest.fixture(scope="module")
def sf(spark, rows, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, SCHEMA).repartition(2).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i, *_ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    turns = [(c, k, role, f"said {c} {k} <|im_end|> \\ é") for c in range(4) for k, role in enumerate(["system", "user", "assistant", "user", "assistant"])] + [(4, 0, "user", None)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{at}/conversations.parquet")
    g = np.random.default_rng(4)
    vecs = [(k, (np.eye(8)[k % 3] + g.standard_normal(8) * 0.03 * (k % 4)).astype(np.float32).tolist(), k % 2) for k in range(80)]
    spark.createDataFrame(vecs, "vec_id long, embedding array<float>, label int").write.parquet(f"{at}/embeddings.parquet")
    return str(at)


def result(spark, name, sf, key="doc_id"):
    return {r[key]: r for r in QUERIES[name](spark, sf).collect()}


def test_op1(spark, sf, rows):
    got = result(spark, "op1_substring_dedup", sf)
    assert {k: (r.n_words, r.n_removed, r.kept_sha256) for k, r in got.items()} == {k: (a, b, sha(c)) for k, (a, b, c) in plain_substring(rows).items()}


def test_op2(spark, sf, rows):
    got, plain = result(spark, "op2_byte_bpe", sf), reference_encoding()
    for i, t, *_ in rows:
        ids = plain.encode_ordinary(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(t or ""))


def test_op3(spark, sf, rows):
    got = result(spark, "op3_near_dedup", sf)
    assert {k: (r.n_shingles, r.component_id, r.kept) for k, r in got.items()} == {k: (n, c, k == c) for k, (n, c) in plain_components(rows, 3, 85, 100).items()}


def test_op5(spark, sf):
    got = result(spark, "op5_embedding_dedup", sf, "vec_id")
    vecs = {r.vec_id: (np.array(r.embedding, np.float64), r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    label, links = {k: k for k in vecs}, dict.fromkeys(vecs, 0)
    for a in vecs:
        for b in vecs:
            (u, p), (v, q) = vecs[a], vecs[b]
            if a < b and p == q and u @ v / np.sqrt((u @ u) * (v @ v)) >= 0.98:
                links[a] += 1
                links[b] += 1
                x, y = sorted((label[a], label[b]))
                label = {k: x if z == y else z for k, z in label.items()}
    assert {k: (r.n_links, r.component_id, r.kept) for k, r in got.items()} == {k: (links[k], label[k], label[k] == k) for k in vecs}


def test_op6(spark, sf, rows):
    got = result(spark, "op6_line_dedup", sf)
    assert {k: (r.n_lines, r.n_dropped, r.kept_sha256) for k, r in got.items()} == {k: (a, b, sha(c)) for k, (a, b, c) in plain_lines(rows).items()}


def test_op7(spark, sf, rows):
    got = result(spark, "op7_license_scan", sf)
    for i, t, *_ in rows:
        x = got[i]
        assert (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels, x.labels, x.score) == plain_licenses(t)


def test_op8(spark, sf, rows):
    got = result(spark, "op8_mixing", sf)
    assert {k: r["size"] for k, r in got.items()} == {i: len(words(t)) for i, t, *_ in rows}
    assert all(0 <= r.taken <= 2 * r["size"] and r.target <= 2 * r.source_size for r in got.values())


def test_op9(spark, sf, rows):
    got = result(spark, "op9_quality", sf)
    assert {k: r.held_out for k, r in got.items()} == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i, *_ in rows}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_agree_with_their_sql(spark, sf, name):
    con = pytest.importorskip("duckdb").connect()
    for t in ("documents", "conversations", "labels", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet/*.parquet'")
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    want = con.sql(SQL[name]).project(", ".join(columns)).fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in df.select(*columns).collect())
