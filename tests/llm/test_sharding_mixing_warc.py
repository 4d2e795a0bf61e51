"""Sharding, mixing and WARC against plain Python on small tables with nulls, ties and clashing columns."""

import hashlib
import os
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.llm import mixing, sharding, warc
from lamina.llm._common import local_path

DOCS = "doc_id long, text string, source string, shard string, _block int"


def docs(spark):
    rows = [(i, f"word {'x ' * (i % 7)}é", f"s{i % 4}" if i % 5 else None, "clash", 1) for i in range(200)]
    return spark.createDataFrame([*rows, (200, None, "s0", "clash", 1), (201, "", "s1", None, None), (202, " \t\n", "s9", None, None), (3, "word x x x é", "s3", None, None), (None, "null id", "s1", None, None)], DOCS)


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
    return b


def test_jump_hash_is_the_published_one():
    keys = np.random.default_rng(1).integers(0, 2**64, 500, np.uint64)
    for n in (1, 2, 16, 17, 1000):
        assert sharding.jump_hash(keys, n).tolist() == [jump(int(k), n) for k in keys]


def test_shards(spark):
    got = sharding.shard_documents(docs(spark), 16).collect()
    assert len(got) == 205
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert all(r.grown_shard in (r.shard, 16) for r in got) and any(r.grown_shard == 16 for r in got)
    by = {r.doc_id: r for r in got}
    assert by[200].size == 1 and by[201].text_crc32 == 0 and by[0].text_crc32 == zlib.crc32("word é".encode()) and by[0].size == 8
    assert len({r.shard for r in got if r.doc_id == 3}) == 1
    assert sharding.shard_documents(docs(spark).limit(0), 4).count() == 0


def stable_hash(salt, *keys):
    return int(hashlib.md5("/".join([salt, *("null" if k is None else str(k) for k in keys)]).encode()).hexdigest()[:15], 16)


def test_shards_equal_plain_python(spark):
    rows = [(i % 300 if i % 4 else None, "x" * (i % 5)) for i in range(1000)] + [(7, "same")] * 50 + [(8, "y" * 2_000_000)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    place = {d: [jump(stable_hash("jump", d), n) for n in (16, 17)] for d in {d for d, _ in rows}}
    want, at = [], {}
    of = lambda d, t: (d, len(t) + 1, zlib.crc32(t.encode()))
    order = sorted((of(d, t) for d, t in rows), key=lambda r: (stable_hash("slot", *r) % 8, r[0] is not None, r[0] or 0, *r[1:]))
    for r in order:
        shard, grown = place[r[0]]
        want.append((*r, "key", shard, at.get(shard, 0), grown))
        at[shard] = at.get(shard, 0) + 1
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def water_fill(sizes, weights, share, most):
    caps = {s: most * n for s, n in sizes.items()}
    budget, open_, target = share * sum(sizes.values()), set(sizes), {}
    while open_:
        level = budget / sum(weights[s] for s in open_)
        over = {s for s in open_ if level * weights[s] > caps[s]}
        if not over:
            return target | {s: level * weights[s] for s in open_}
        for s in over:
            target[s] = caps[s]
            budget -= caps[s]
        open_ -= over
    return target


def test_mix(spark):
    d = docs(spark)
    rows = mixing.mix(d).collect()
    assert len(rows) == 205
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = water_fill(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 1.5, 2)
    for s in sizes:
        own = [r for r in rows if r.source == s]
        assert own[0].target == pytest.approx(want[s]) and own[0].source_size == sizes[s]
        assert abs(sum(r.taken for r in own) - want[s]) <= max(r.size for r in own) / 2 + 1e-9
    assert all(r.taken in (0, r.size, 2 * r.size) and len(r.positions) == r.copies and all(0 <= p <= 1 for p in r.positions) for r in rows)
    assert all(r.size == len(re.findall(r"[^\x20\x09-\x0D]+", "word " + "x " * (r.doc_id % 7) + "é")) for r in rows if r.doc_id is not None and r.doc_id < 200 and r.doc_id != 3)
    again = mixing.mix(d.repartition(7)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r.source or "", r.copies, r.positions)
    assert sorted(map(key, again)) == sorted(map(key, rows))
    assert mixing.mix(d.limit(0)).count() == 0
    positions = [r.position for r in mixing.in_training_order(mixing.mix(d)).collect()]
    assert positions == sorted(positions)
    mixed = mixing.mixed_documents(d)
    assert mixed.columns == d.columns and mixed.filter("doc_id = 200").count() == 1
    # the pipeline's rows stand in training order, those without words last
    where = {}
    for r in mixing.mix(d).collect():
        for p in r.positions or [2.0]:
            where.setdefault((r.doc_id, r.source, r.size), set()).add(p)
    at, last = 0.0, mixed.collect()
    for r in last:
        later = [p for p in where[r.doc_id, r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))] if p >= at]
        assert later, (r, at)
        at = min(later)
    assert at == 2.0 and len(last) == sum(max(1, r.copies) if r.size == 0 else r.copies for r in mixing.mix(d).collect())


def test_mix_of_repeated_and_shared_rows(spark):
    rows = [(1, "a b c", "s")] * 40 + [(None, "w " * k, "s") for k in range(1, 30)] + [(2, "x " * 100_000, "t"), (2, "y " * 100_000, "t"), (3, "z", None)]
    d = spark.createDataFrame([(*r, 0.5, 1) for r in rows], "doc_id long, text string, source string, target double, copies int")
    got = mixing.mix(d).collect()
    assert len(got) == len(rows) and {r.source_size for r in got if r.source == "t"} == {200_000}
    for s in ("s", "t", None):
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own) / 2
    assert len({tuple(r.positions) for r in got if r.doc_id == 1 and r.copies}) > 1  # equal rows have places of their own


def test_inverted_schedule(spark):
    seg = mixing._segments(((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))
    u = [i / 40 for i in range(41)]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in u], "u double").select(mixing.invert(F.col("u"), seg)).collect()]
    assert got == pytest.approx([(-0.5 + (0.25 + 2 * x) ** 0.5) for x in u], abs=1e-9)  # the integral is (t + t^2) / 2


def test_warc_round_trip(spark):
    big = "<p>" + "a" * 200
    rows = [(1, "http://a", big, "x"), (2, "http://b", big, None), (3, None, "small", None), (4, "u\r\nX: y", "small", None), (5, "", None, None), (6, "c", big + "é", None), (None, "n", big, None), (7, "p", "\r\n\r\nWARC/1.1\r\n" * 20, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    records, gaps = warc.read_archives(spark, warc.write_archives(pages))
    got = {r.page_id: r for r in records.collect()}
    assert len(got) == 8 and gaps.count() == 0
    for page, _, html, _ in rows:
        data = (html or "").encode()
        assert (got[page].payload_bytes, got[page].payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
    assert [(got[i].record_type, got[i].refers_to) for i in (1, 2, 3, 4, None)] == [("response", None), ("revisit", 1), ("response", None), ("response", None), ("revisit", 1)]
    assert warc.read_archives(spark, warc.write_archives(pages.limit(0)))[0].count() == 0


def test_warc_keeps_pages_with_control_characters_in_the_url(spark):
    big = "<p>" + "b" * 200
    codes = [*range(32), 127]
    pages = spark.createDataFrame([(c, f"{chr(c)}http://a/{chr(c)}é{chr(c)}", big) for c in codes], "page_id long, url string, html string")
    records, gaps = warc.read_archives(spark, warc.write_archives(pages))
    got = {r.page_id: r for r in records.collect()}
    assert gaps.count() == 0 and sorted(got) == codes
    assert all(got[c].url == f"%{c:02X}http://a/%{c:02X}é%{c:02X}" for c in codes)
    assert [got[c].refers_to for c in codes] == [None] + [0] * (len(codes) - 1)


def archive(n, compressed):
    recs = [warc.record("response", f"{warc.ID}{i}", p := bytes([65 + i]) * 50, hashlib.sha256(p).hexdigest()) for i in range(n)]
    return [warc.member(r) if compressed else r for r in recs]


@pytest.mark.parametrize("compressed", [True, False])
def test_salvage(compressed):
    parts = archive(5, compressed)
    whole = b"".join(parts)
    assert [len(warc.salvage(whole).records), warc.salvage(whole).gaps] == [5, []]
    broken = bytearray(whole)
    at = len(parts[0]) + len(parts[1]) // 2
    broken[at : at + 4] = b"\0\0\0\0"
    got = warc.salvage(bytes(broken))
    assert [r[1]["warc-record-id"] for r in got.records] == [f"<{warc.ID}{i}>" for i in (0, 2, 3, 4)]
    assert got.gaps == [(len(parts[0]), len(parts[0]) + len(parts[1]), None, None)]
    junk = b"junk" + whole + b"tail"
    got = warc.salvage(junk)
    assert len(got.records) == 5 and got.gaps == [(0, 4, None, None), (4 + len(whole), 8 + len(whole), None, None)]
    cut = warc.salvage(whole[:-7])  # a member without its last seven bytes still inflates
    assert len(cut.records) == 4 + compressed and cut.gaps == [(len(whole) - len(parts[4]), len(whole) - 7, None, None)]
    assert warc.salvage(b"").records == []


def test_salvage_inside_a_member():
    parts = archive(5, False)
    bad = parts[2].replace(b"C" * 50, b"C" * 49 + b"x")
    one = warc.member(b"".join([*parts[:2], bad, *parts[3:]]))
    ids = lambda got: [int(r[1]["warc-record-id"].rpartition(":")[2][:-1]) for r in got.records]
    got = warc.salvage(one + warc.member(parts[2]))
    at = len(parts[0] + parts[1])
    assert ids(got) == [0, 1, 3, 4, 2] and got.gaps == [(0, len(one), at, at + len(bad))]
    stored = warc.member(b"".join(parts), 0)  # not compressed, so a fault stays where it is
    cut = warc.salvage(stored[: len(stored) // 2])
    assert ids(cut) == [0, 1] and cut.gaps == [(0, len(stored) // 2, None, None)]
    wrong = warc.salvage(stored[:-8] + b"\0" * 8 + parts[0])  # its CRC fails, the digests hold
    assert ids(wrong) == [0, 1, 2, 3, 4, 0] and wrong.gaps == [(0, len(stored), None, None)]
    assert ids(warc.salvage(one + warc.member(parts[1]), most_inflated=100)) == [0, 1, 3, 4, 1]
    empty = warc.member(b"no record")
    assert warc.salvage(empty + one[:0]).gaps == [(0, len(empty), None, None)]


def test_reading_time_grows_with_the_archive():
    one = archive(1, True)[0]

    def took(n):
        data, t = one * n, time.perf_counter()
        assert len(warc.salvage(data).records) == n
        return time.perf_counter() - t

    took(500)
    assert took(16_000) < 9 * took(4_000)


def test_pages_that_share_an_id(spark):
    big, other = "<p>" + "a" * 200, "<p>" + "b" * 200
    rows = [(5, "b", big), (5, "a", big), (5, "a", big), (5, "c", other), (6, "z", big), (None, "n", other), (None, None, other), (None, "q", "r" * 300), (None, None, "r" * 300), (7, "x", "same"), (7, "x", "same"), (8, "l", "y" * 3_000_000)]
    records, gaps = warc.round_trip(spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, archive string, offset int"))
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to, r.url) for r in records.collect()), key=str)
    want = [(5, 203, "response", None, "a"), (5, 203, "revisit", 5, "a"), (5, 203, "revisit", 5, "b"), (5, 203, "response", None, "c"), (6, 203, "revisit", 5, "z"), (None, 203, "revisit", 5, "n"), (None, 203, "revisit", 5, None), (None, 300, "response", None, None), (None, 300, "revisit", None, "q"), (7, 4, "response", None, "x"), (7, 4, "response", None, "x"), (8, 3_000_000, "response", None, "l")]
    assert got == sorted(want, key=str) and gaps.count() == 0


def test_a_damaged_archive_through_spark(spark):
    pages = spark.createDataFrame([(i, f"u{i}", f"<p>{i}" + "a" * 150) for i in range(20)], "page_id long, url string, html string").coalesce(1)
    path = warc.write_archives(pages)
    files = f"{local_path(path)}/files"
    name = [x for x in os.listdir(files) if x.endswith(".warc.gz")][0]
    with open(f"{files}/{name}", "rb") as f:
        data = bytearray(f.read())
    at, end = (warc.salvage(bytes(data)).records[i][0] for i in (10, 11))
    data[at + 60 : at + 90] = b"\0" * 30
    with open(f"{files}/{name}", "wb") as f:
        f.write(data)
    records, gaps = warc.read_archives(spark, path)
    (gap,) = gaps.collect()
    assert records.count() == 19 and gap.archive == name and (gap.start, gap.end, gap.inner_start) == (at, end, None)
