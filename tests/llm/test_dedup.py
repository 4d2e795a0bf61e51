"""Suffix-array dedup and near-duplicate detection against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.llm import _graph, minhash_dedup, suffix_dedup

DOCS = "doc_id long, text string, lo long, name string, n int"


def brute_repeats(rows, length):
    out = {}
    starts = {}
    for doc, data in rows:
        for p in range(len(data) - length + 1):
            s = data[p : p + length]
            if s not in starts or (doc, p) < starts[s]:
                starts[s] = (doc, p)
    for doc, data in rows:
        cov = bytearray(len(data))
        for p in range(len(data) - length + 1):
            if starts[data[p : p + length]] < (doc, p):
                cov[p : p + length] = b"\1" * length
        spans = sum(1 for i, c in enumerate(cov) if c and (i == 0 or not cov[i - 1]))
        kept = bytes(c for c, m in zip(data, cov, strict=True) if not m)
        out[doc] = (len(data), sum(cov), spans, hashlib.sha256(kept).hexdigest())
    return out


def passages(seed):
    r = random.Random(seed)
    base = ["".join(r.choice("abcdé \n") for _ in range(r.randint(60, 400))) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(r.randint(0, 4)):
            b = r.choice(base)
            a = r.randint(0, len(b))
            parts.append(b[a:] if r.random() < 0.5 else "".join(r.choice("xyz ") for _ in range(r.randint(0, 150))))
        rows.append((i, "".join(parts)))
    rows += [(100, "a" * 1000), (101, "ab" * 300), (102, "a" * 99), (103, "a" * 100), (104, "")]
    return rows


@pytest.mark.parametrize("seed", [4, 5])
def test_suffix_dedup_equals_brute_force(spark, seed):
    rows = passages(seed)
    d = spark.createDataFrame([(i, t, 1, "clash", 2) for i, t in rows] + [(105, None, 1, None, None), (3, rows[3][1], 1, None, None)], DOCS)
    got = suffix_dedup.dedup_digests(d).collect()
    want = brute_repeats([(i, t.encode()) for i, t in rows], 100) | {105: (0, 0, 0, hashlib.sha256(b"").hexdigest())}
    assert len(got) == len(rows) + 2
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want
    assert sum(r.n_removed for r in got) > 5000


def test_one_name_with_very_many_blocks(spark):
    """A line in 1,500 documents, each time among other words."""
    r = random.Random(2)
    word = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    line = "THE SAME LINE STANDS IN EVERY DOCUMENT, AND IT IS LONGER THAN A WINDOW OF A HUNDRED BYTES, BY SOME WORDS."
    rows = [(i, word(r.randint(20, 60)) + (line if i % 3 else line[:40]) + word(r.randint(20, 60))) for i in range(1500)]
    got = suffix_dedup.dedup_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got} == brute_repeats([(i, t.encode()) for i, t in rows], 100)
    assert sum(x.n_removed > 0 for x in got) == 999


def test_suffix_dedup_of_repeated_rows_and_shared_ids(spark):
    r = random.Random(9)
    word = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    a, b, c = word(300), word(260), word(240)
    first = word(150) + a + word(70)  # the repeated row holds the first place of a
    rows = [(1, first), (1, first), (2, a + word(90)), (3, word(50) + a[20:] + "!"), (4, b), (4, word(130) + b + word(40)), (4, word(200)), (None, c + word(60)), (None, word(400)), (None, "x" + c), (5, c)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    twin = {x.text: x.twin for x in d.select("text", F.xxhash64(F.col("text").cast("binary")).alias("twin")).collect()}
    want = brute_repeats([((-1 if i is None else i, twin[t]), t.encode()) for i, t in dict.fromkeys(rows)], 100)
    got = suffix_dedup.dedup_digests(d).collect()
    assert sorted(((-1 if x.doc_id is None else x.doc_id), x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got) == sorted((-1 if i is None else i, *want[-1 if i is None else i, twin[t]]) for i, t in rows)
    kept = [hashlib.sha256(x.text.encode()).hexdigest() for x in suffix_dedup.dedup_texts(d).collect()]
    assert sorted(kept) == sorted(x.kept_sha256 for x in got)
    assert [x.n_removed for x in got if x.doc_id == 1] == [0, 0]


def test_pieces_of_long_texts(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 512)
    r = random.Random(1)
    text = "".join(r.choice("ab") for _ in range(3000)).encode()
    docs = [(1, text), (2, b"zz" + text[700:2600] + b"q" * 300)]
    found = [suffix_dedup.anchors(b) for b in suffix_dedup._pieces(docs, 100)]
    owned = {}
    for a in found:
        for doc, lo, n in zip(a["doc_id"].tolist(), a["lo"].tolist(), a["n"].tolist(), strict=True):
            for p in range(lo, lo + n):
                assert (doc, p) not in owned
                owned[doc, p] = 1
    assert len(owned) == sum(len(t) - 99 for _, t in docs)


def test_dedup_texts_keeps_rows_and_utf8(spark):
    p = "é" * 120
    d = spark.createDataFrame([(1, "x" + p, 5), (2, "è" + p + "tail", 6), (3, None, 7), (4, p, 8)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: r for r in suffix_dedup.dedup_texts(d).collect()}
    assert got[1].text == "xé" + "é" * 49 or len(got[1].text) < 121  # a run of one letter repeats itself too
    assert got[3].text is None and got[3].n_chars == 7 and got[2].text.startswith("è") and got[2].text.endswith("tail")
    assert all(r.text is None or r.n_chars == len(r.text) or r.doc_id == 3 for r in got.values())
    assert suffix_dedup.dedup_digests(d.limit(0)).count() == 0


def shingles(text, k):
    w = text.encode().lower().split()
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def near(seed, n=50):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcde") for _ in range(4))
    rows = []
    for g in range(8):
        base = [word() for _ in range(r.randint(20, 90))]
        for _ in range(r.randint(1, 8)):
            w = list(base)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = word()
            rows.append(" ".join(w) if r.random() < 0.7 else "\n".join(w).upper())
    rows += ["", "   ", "one", "ONE", "one two", "one two three"]
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("words", [2, 5])
@pytest.mark.parametrize("blocks", [256, 3])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, words, blocks):
    monkeypatch.setattr(minhash_dedup, "BLOCK_DOCS", blocks)
    monkeypatch.setattr(minhash_dedup, "CHUNK_DOCS", 4 * blocks)
    rows = near(words)
    sets = {i: shingles(t, words) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and (both := len(sets[i] & sets[j])) and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    d = spark.createDataFrame([(i, t, 1, "clash", 2) for i, t in rows] + [(900, None, 1, None, None), (None, rows[0][1], 1, None, None), (0, rows[0][1], 1, None, None)], DOCS)
    got = minhash_dedup.near_duplicates(d, words, 80).collect()
    assert len(got) == len(rows) + 3
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        elif r.doc_id == 900:
            assert (r.n_shingles, r.component_id, r.kept) == (0, 900, True)
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), find(r.doc_id), find(r.doc_id) == r.doc_id)
    if blocks == 256 and words == 5:
        kept = minhash_dedup.keep_one(d, words, 80)
        assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({find(i) for i in sets} | {900})


def test_links_that_no_centre_sees(spark, monkeypatch):
    """One band that holds everything: a chain of near copies, of which few are near the smallest."""
    monkeypatch.setattr(minhash_dedup, "band_keys", lambda s, rows, bands: np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(s), bands)).copy())
    monkeypatch.setattr(minhash_dedup, "BLOCK_DOCS", 7)
    monkeypatch.setattr(minhash_dedup, "CHUNK_DOCS", 11)
    chain = lambda at, i: " ".join(f"w{at}x{k}" for k in range(4 * i, 4 * i + 60))
    rows = [(1000 + i, chain(0, i)) for i in range(40)] + [(i, chain(1, i)) for i in range(30)] + [(2000 + i, chain(2 + i, 0)) for i in range(20)]
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1000 + i: 1000 for i in range(40)} | {i: 0 for i in range(30)} | {2000 + i: 2000 + i for i in range(20)}


def test_rows_that_share_a_doc_id(spark):
    words = lambda a: " ".join(f"{a}{k}" for k in range(30))
    rows = [(5, words("a"), 1), (5, words("b"), 2), (5, words("b").upper(), 3), (5, words("b"), 2), (6, words("b"), 4), (None, words("b"), 5), (7, "", 6), (7, None, 7), (7, "x " * 40_000, 8)]
    d = spark.createDataFrame(rows, "doc_id long, text string, n long")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(d).collect()), key=str)
    assert got == sorted([(5, 5, True)] * 4 + [(6, 5, False), (None, None, True)] + [(7, 7, True)] * 3, key=str)
    kept = minhash_dedup.keep_one(d).collect()
    assert sorted(r.text[:2] for r in kept if r.doc_id == 5) in (["a0", "b0"], ["B0", "a0"]) and sum(r.doc_id is None for r in kept) == 1
    assert sorted((r.text or "")[:2] for r in kept if r.doc_id == 7) == ["", "", "x "]
    assert not any(r.doc_id == 6 for r in kept)
    assert minhash_dedup.near_duplicates(d.limit(0)).count() == 0 and minhash_dedup.keep_one(d.limit(0)).count() == 0


def test_signatures_estimate_similarity():
    r = np.random.default_rng(2)
    a = np.unique(r.integers(0, 2**63, 900).astype(np.uint64))
    b = np.concatenate([a[:800], np.unique(r.integers(0, 2**63, 100).astype(np.uint64))])
    s = minhash_dedup.signatures([a, b, a[:1], np.zeros(0, np.uint64), np.concatenate([a] * 1)], 400)
    assert s.shape == (4, 400) and abs((s[0] == s[1]).mean() - 0.8) < 0.08 and (s[0] == s[3]).all()
    long = np.unique(r.integers(0, 2**63, 20_000).astype(np.uint64))
    assert (minhash_dedup.signatures([long], 50)[0] == np.minimum(minhash_dedup.signatures([long[:9000]], 50)[0], minhash_dedup.signatures([long[9000:]], 50)[0])).all()


def test_components(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 200), (200, 150), (7, 3)] + [(500, x) for x in range(501, 560)]
    got = {r.node: r.component for r in _graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 31)} | {200: 100, 150: 100} | {x: 500 for x in range(501, 560)}
    assert _graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
