"""Token blocks and byte-level BPE: exact round trips against the libraries."""

import base64
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lamina.llm import byte_bpe, token_blocks

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_scan_equals_steps():
    rnd = np.random.default_rng(0)
    for n in (1, 2, 255, 256, 257, 70_000):
        sym = rnd.integers(0, 11, n).astype(np.uint8)
        state, want = byte_bpe.S_START, []
        for s in sym.tolist():
            state = byte_bpe._step(state, s)
            want.append(state)
        assert byte_bpe.scan_states(sym).tolist() == want


PIECES = ["'", "s", "t", "r", "e", "v", "l", "m", "d", " ", "\n", "\t", "a", "É", "1", "٣", ".", "\u00a0", "\u3000", "日", "🙂", "'re", "'ll"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=20).map("".join))
def test_ids_equal_tiktoken(reference, text):
    assert next(byte_bpe.vocabulary(PATH).encode([text])) == reference.encode_ordinary(text)


def test_long_pieces(reference):
    v = byte_bpe.vocabulary(PATH)
    for t in ("ab" * 3000, "a" * 3000, "x1" * 500 + "é" * 900, " " * 3000, "\n" * 700 + "x"):
        ids = next(v.encode([t]))
        assert ids == reference.encode_ordinary(t) and v.decode(ids) == t.encode()
        ends = v.offsets(ids)
        assert v.decode_slices(ids, ends, 7) == t.encode() and v.decode_slices([], v.offsets([])) == b""
        assert ends[-1] == len(t.encode()) and v.decode(ids[1:3]) == t.encode()[ends[0] : ends[2]]


def test_bpe_documents(spark, reference):
    rows = [(1, "Hello's world", 5), (2, None, 6), (3, "", 7), (None, "x", 8), (1, "Hello's world", 5), (4, "long " * 50_000, 9)]
    d = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = byte_bpe.encode_documents(d, with_offsets=True)
    by = {r.doc_id: r for r in got.collect()}
    assert got.count() == 6 and all(by[i].ids == reference.encode_ordinary(t or "") and by[i].n_tokens == len(by[i].ids) for i, t, _ in rows)
    assert {r.doc_id: bytes(r.data) for r in byte_bpe.decode_documents(got).collect()}[1] == b"Hello's world"
    assert byte_bpe.encode_documents(d.limit(0)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5000])
@pytest.mark.parametrize("kind", ["small", "outliers", "wide", "equal"])
def test_blocks_round_trip(n, kind):
    r = np.random.default_rng(n)
    x = {"small": r.integers(0, 50, n), "outliers": np.where(r.random(n) < 0.05, r.integers(0, 2**32, n), r.integers(1000, 1100, n)), "wide": r.integers(0, 2**32, n), "equal": np.full(n, 7)}[kind].astype(np.uint32)
    data = token_blocks.encode_file([5, None], np.array([n // 2, n - n // 2], np.uint32), x)
    f = token_blocks.TokenFile(data)
    assert f.read().tolist() == x.tolist() and f.counts.tolist() == [n // 2, n - n // 2] and f.null.tolist() == [0, 1]
    for a, b in ((0, 5), (100, 300), (n - 3, n), (n, n + 5)):
        assert f.read(max(0, a), b).tolist() == x[max(0, a) : b].tolist()
    if kind == "outliers" and n == 5000:
        assert len(data) < 3 * n and int(f.extra.sum()) > 0


def test_token_files(spark):
    texts = ["Hello, World! it's a <|endoftext|> Éa ﬁ", "x<|ENDOFTEXT|>y<|startoftext|> <|end", None, "word <|endoftext|>ly, " * 60_000, "", "a\x1cb\x85c İ Σας", "same", "same", "num 123 x" * 300, "ÀÉ café’s."]
    rows = [(20 - i if i != 5 else None, t, i) for i, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "doc_id long, text string, count int")
    got = {r.doc_id: r for r in token_blocks.read_token_files(spark, token_blocks.write_token_files(d)).collect()}
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    at = 0
    for doc, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        assert (got[doc].start, got[doc].n_tokens, got[doc].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), text
        at += len(ids)
    assert token_blocks.read_token_files(spark, token_blocks.write_token_files(d.limit(0))).count() == 0
    again = token_blocks.read_token_files(spark, token_blocks.write_token_files(spark.createDataFrame([(1, "b"), (1, "a a"), (1, "b"), (0, "c")], "doc_id long, text string"))).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens) for r in again] == [(0, 0, 2), (1, 2, 3), (1, 5, 2), (1, 7, 2)] and again[2].ids_crc32 == again[3].ids_crc32


def test_words_equal_library():
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    w = token_blocks.Words(P.path("word_bpe_49k.json"), 2)
    random.seed(3)
    for _ in range(3000):
        s = "".join(random.choice("aBcÉéñß .,!?'’-1２Ⅷ日🙂́\n\t ") for _ in range(random.randint(0, 12)))
        assert np.frombuffer(w.encode(s), "<u4").tolist() == [*t.encode(s, add_special_tokens=False).ids, 2], repr(s)
