"""Quality on held-out labels, vector searches against brute force, the pipeline, and the registered queries."""

import math
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.llm import ball_tree, crf_quality, graph_ann, queries
from lamina.llm import vectors as vectors_module
from tests.llm.test_dedup import shingles
from tests.llm.test_sharding_mixing_warc import stable_hash, water_fill

DIR = "/root/testdata/sf0.01"


def test_quality_on_held_out(spark):
    got = {r.doc_id: r for r in queries.op2_crf_quality(spark, DIR).collect()}
    labels = duckdb.sql(f"select doc_id, quality from '{DIR}/labels.parquet'").fetchall()
    held = [(d, q) for d, q in labels if zlib.crc32(str(d).encode()) % 4 == 2]
    assert all(got[d].held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d, _ in labels)
    right = [got[d].predicted == q for d, q in held]
    assert len(right) > 50 and np.mean(right) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())


def test_forward_backward_equals_enumeration():
    r = np.random.default_rng(0)
    u, t = r.normal(size=(9, 2)), r.normal(size=(2, 2))
    begin = np.array([0, 4, 5, 9])
    marginal, pairs = crf_quality.forward_backward(u, t, begin)
    want_pairs = np.zeros((2, 2))
    for a, e in zip(begin, begin[1:], strict=False):
        n = e - a
        total, m = 0.0, np.zeros((n, 2))
        p2 = np.zeros((2, 2))
        for code in range(2**n):
            y = [(code >> i) & 1 for i in range(n)]
            w = np.exp(sum(u[a + i, y[i]] for i in range(n)) + sum(t[y[i], y[i + 1]] for i in range(n - 1)))
            total += w
            for i in range(n):
                m[i, y[i]] += w
            for i in range(n - 1):
                p2[y[i], y[i + 1]] += w
        assert marginal[a:e] == pytest.approx(m / total)
        want_pairs += p2 / total
    assert pairs == pytest.approx(want_pairs)


def test_quality_edge_cases(spark):
    good, bad = "A plain line of words.\nAnother line of them, here.", "X$$$ Y&&& Z###\nW*** V%%% U$$$"
    d = spark.createDataFrame([(i, good if i % 3 else bad, 1.0) for i in range(90)] + [(500, None, 2.0), (501, "", 2.0), (502, "\n\n", 2.0), (None, good, 2.0), (503, bad + "\n" + good * 400, 2.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(90)] + [(1, None, 0), (None, 1, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    got = crf_quality.classify(d, labels).collect()
    assert len(got) == 95
    assert all(r.predicted == int(r.doc_id % 3 > 0) for r in got if r.doc_id is not None and r.doc_id < 90)
    assert len({r.score for r in got if r.doc_id in (500, 501, 502)}) == 1
    assert crf_quality.classify(d.limit(0), labels).count() == 0 and crf_quality.classify(d, labels.limit(0)).first().score == 0.5
    assert crf_quality.keep_good(d, labels).columns == d.columns


def vectors(spark, n=900, dim=12):
    r = np.random.default_rng(4)
    x = r.normal(size=(n, dim)).astype(np.float32)
    x[5] = x[200] = x[201] = x[7]
    x[300] = 0
    rows = [(i, [float(v) for v in x[i]], 1, 0.5) for i in range(n)]
    extra = [(n, None, 1, 0.5), (n + 1, [float("nan")] * dim, 1, 0.5), (n + 2, [None] * dim, 1, 0.5), (n + 3, [float("inf")] + [0.0] * (dim - 1), 1, 0.5), (n + 4, [], 1, 0.5), (None, [1.0] * dim, 1, 0.5)]
    return x, spark.createDataFrame(rows + extra, "vec_id long, embedding array<float>, shard int, score double")


def test_ball_tree_is_exact(spark):
    x, df = vectors(spark)
    z = np.floor(256 * x.astype(np.float64)).astype(np.int64)
    got = {}
    for r in ball_tree.top_k(df, F.col("vec_id") % 50 == 0, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert sorted(got) == list(range(0, 900, 50))
    for q, rows in got.items():
        s = z @ z[q]
        want = sorted(((-s[i], i) for i in range(900) if i != q))[:5]
        assert rows == [(i, -v) for v, i in want]
    assert ball_tree.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert ball_tree.top_k(df.filter("vec_id in (0, 3, 4)"), F.col("vec_id") % 50 == 0).count() == 2


def test_ball_tree_keeps_every_finite_vector(spark):
    r = np.random.default_rng(6)
    x = r.normal(size=(400, 6)).astype(np.float32)
    x[3], x[50, 2], x[51, 2], x[100, 0] = 3e30, 2e6, -2e6, 3e9  # scaled: 7.7e32, 5e8, -5e8 and 7.7e11
    x[200:220] *= np.float32(1e6)  # scores above 2**53
    x[300, 1] = -3e38
    z = [[int(np.floor(256 * np.float64(v))) for v in row] for row in x]
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for row in ball_tree.top_k(df, F.col("vec_id") % 50 == 0, 5).orderBy("query_id", "rank").collect():
        got.setdefault(row.query_id, []).append((row.vec_id, row.score))
    assert sorted(got) == list(range(0, 400, 50))
    for q, rows in got.items():
        s = [min(max(sum(a * b for a, b in zip(v, z[q], strict=True)), -(1 << 63)), (1 << 63) - 1) for v in z]
        assert rows == [(i, -v) for v, i in sorted((-s[i], i) for i in range(400) if i != q)[:5]]
    assert any(2**53 < abs(v) < 2**63 - 1 for rows in got.values() for _, v in rows)


def test_graph_recall(spark):
    x, df = vectors(spark)
    got = {}
    for r in graph_ann.nearest(df, F.col("vec_id") % 20 == 0, 20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    y = x.astype(np.float64)
    assert 300 not in got and sorted(got) == [i for i in range(0, 900, 20) if i != 300]
    hits = []
    for q, rows in got.items():
        s = y @ y[q]
        want = sorted((-s[i], i) for i in range(900) if i not in (q, 300))[:20]
        hits.append(len({i for i, _ in rows} & {i for _, i in want}) / 20)
        assert len(rows) == 20 and all(v == pytest.approx(s[i]) for i, v in rows) and q not in dict(rows)
        assert rows == sorted(rows, key=lambda r: (-r[1], r[0]))
    assert np.mean(hits) >= 0.95
    assert graph_ann.nearest(df.filter("vec_id in (0, 3)"), F.col("vec_id") % 20 == 0).count() == 1
    assert graph_ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_graph_is_connected_and_without_repeats():
    r = np.random.default_rng(4)
    for n, dim in ((1, 3), (2, 3), (57, 12), (900, 12), (1500, 64)):
        g = graph_ann.Graph(r.normal(size=(n, dim)).astype(np.float32))
        assert g.reached().all()
        for row in g.edges:
            row = row[row >= 0]
            assert len(set(row.tolist())) == len(row)


def test_graph_of_equal_vectors():
    x = np.ones((500, 4))
    q, ids, s = graph_ann.search_shard(graph_ann.build(x, np.arange(500), 20), x[:2], np.array([0, 1]), 20)
    assert ids[q == 0].tolist() == list(range(1, 21)) and ids[q == 1].tolist() == [0, *range(2, 21)] and (s == 4).all()


def test_graph_recall_in_a_full_shard():
    """A shard of its full size, of Gaussian vectors."""
    n = vectors_module.SHARD_ROWS
    x = np.random.default_rng(1).normal(size=(n, 64))
    own = np.random.default_rng(2).choice(n, 200, replace=False)
    index = vectors_module.unpacked(vectors_module.packed(graph_ann.build(x, np.arange(n), 20)))
    q, ids, _ = graph_ann.search_shard(index, x[own], own, 20)
    s = x[own] @ x.T
    s[np.arange(200), own] = -np.inf
    true = np.argsort(-s, axis=1)[:, :20]
    assert np.mean([len(np.intersect1d(t, ids[q == i])) / 20 for i, t in zip(own, true, strict=True)]) >= 0.9


@pytest.mark.parametrize("search", [lambda d, k: ball_tree.top_k(d, F.col("vec_id") % 50 == 0, k, 1), lambda d, k: graph_ann.nearest(d, F.col("vec_id") % 50 == 0, k)])
def test_repeated_vec_ids(spark, search):
    """A query asks once, with its least vector; every other row is a candidate, also where ids repeat."""
    rows = [(0, [3.0, 1.0]), (0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [5.0, 5.0]), (1, [5.0, 5.0]), (2, [4.0, 4.0]), (3, [1.0, 1.0]), (4, [4.0, 4.0]), (2, [2.0, 1.0])]
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 5).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 15), (0, 2, 1, 15), (0, 3, 2, 12), (0, 4, 4, 12), (0, 5, 2, 4)]


def test_registered_queries_equal_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.sql(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        got = queries.queries()[name](spark, "/root/testdata/sf0.001")
        rel = con.sql(sql)
        assert sorted(got.columns) == sorted(rel.columns), name
        assert sorted(map(str, (tuple(r) for r in got.select(*rel.columns).collect()))) == sorted(map(str, rel.fetchall())), name


def plain_pipeline(rows, field):
    """The five stages over (doc_id, text, source), in plain Python."""
    rows = [r for r in rows if crf_quality.score(field, [r[1] or ""])[0] >= 0.7]
    sets = {r[0]: shingles(r[1] or "", 5) for r in rows}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and (both := len(sets[a] & sets[b])) and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    rows = [r for r in rows if find(r[0]) == r[0]]
    first = {}
    for d, t, _ in sorted(rows):
        data = (t or "").encode()
        for p in range(len(data) - 99):
            first.setdefault(data[p : p + 100], (d, p))
    out = []
    for d, t, s in rows:
        data = (t or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - 99):
            if first[data[p : p + 100]] < (d, p):
                gone[p : p + 100] = b"\1" * 100
        chars, at = [], 0
        for c in t or "":
            n = len(c.encode())
            chars.append("" if all(gone[at : at + n]) else c)
            at += n
        out.append((d, "".join(chars), s))
    copies = {r.doc_id: r.copies for r in plain_mix(out)}
    return [(d, t) for d, t, _ in out for _ in range(copies[d])]


class Mixed:
    def __init__(self, doc_id, copies):
        self.doc_id, self.copies = doc_id, copies


def plain_mix(rows):
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for d, t, _ in rows}
    by = {}
    for d, _, s in rows:
        by.setdefault(s, []).append(d)
    sizes = {s: sum(size[d] for d in ds) for s, ds in by.items()}
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(by, key=lambda s: (s is None, s or "")))}
    target = water_fill(sizes, weights, 1.5, 2)
    out = []
    for s, ds in by.items():
        at = 0
        for d in sorted(ds, key=lambda d: (stable_hash("mix", d, size[d]) % 32, stable_hash("mix", d, size[d]))):
            n = max(0, math.ceil((target[s] - (at + size[d] / 2)) / sizes[s])) if size[d] else 1
            at += size[d]
            out.append(Mixed(d, n))
    return out


def test_pipeline_equals_plain_python(spark):
    import base64

    import corpus_pipeline as cp
    import public_tokenizers as P
    import tiktoken

    d = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    field = crf_quality.train(docs, labels)
    want = plain_pipeline([(r.doc_id, r.text, r.source) for r in docs.select("doc_id", "text", "source").collect()], field)
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    code = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = sorted((r.doc_id, r.ids) for r in cp.run(spark, d).collect())
    assert len(got) > 50 and got == sorted((i, code.encode_ordinary(t)) for i, t in want)


def test_pipeline_stages(spark):
    """Nulls, empty and very long texts, ties, repeated rows and clashing names in every stage."""
    import corpus_pipeline as cp

    good = lambda k: " ".join(f"word{(k * 7 + j) % 90} stands here" for j in range(30)) + "."
    rows = [(i, good(i), "en", "s", 1, 0.5, "clash") for i in range(12)] + [(3, good(3), "en", "s", 1, 0.5, "clash"), (3, good(40), "en", "s", 1, 0.5, None), (None, good(50), "en", None, 1, None, None), (60, None, None, "s", None, 0.5, None), (61, "", "en", "t", 0, 0.5, None), (62, "\n".join(good(k) for k in range(3000)), "en", "t", 0, 0.5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _score double, ranges string")
    for k, (_, stage) in enumerate(cp.STAGES):
        before, empty = docs.columns, stage(spark, docs.limit(0), "/root/testdata/sf0.001")
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert empty.count() == 0 and empty.columns == out.columns
        assert out.columns == (before if k < 4 else ["doc_id", "n_tokens", "ids"])
        ids = [r.doc_id for r in out.select("doc_id").collect()]
        if k == 1:
            assert len(ids) == len(set(ids)) + 1 and ids.count(3) == 2  # the repeated row goes, the other text of its id stays
        if k in (2, 4):
            assert len(ids) == len(rows)


def test_names():
    found = queries.queries()
    assert [sum(k.startswith(f"op{n}_") for k in found) for n in range(1, 11)] == [1] * 10
