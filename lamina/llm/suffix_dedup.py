"""Suffix-array dedup: removes every byte covered by a long string that also starts earlier.

Prefix doubling over positions, where a position's rank is a name (fingerprint) of what stands there:
each round names longer strings, groups equal names, and drops the positions whose name is unique.
Sorting every byte position of the corpus in every round would move many times the input, so the
rounds go from few positions to many:

1. 32 bytes, at anchors only. Names are counted alone before places travel with them. Of every window of `length` bytes the anchor is the position whose
   32-byte name is least (leftmost of equals), so equal windows have equal anchors at equal offsets
   and no repeat can be missed. An anchor owns the run of consecutive windows that choose it.
2. The anchor's whole block, i.e. all bytes of the windows that it owns. A block that stood earlier
   is covered as a whole. Of each distinct block only the first place goes on, and only if the
   anchor's name stands in other blocks too; the rest is unique or settled.
3. The windows of a block are dealt to ranges by the offset of the anchor in them. All windows of a
   range share its core, the bytes that each of them holds (92 of 100), and the core's name is the
   range's rank. Again a range that stood earlier is covered as a whole, and only the first places
   of ranges that share a core with a different range go on.
4. `length` bytes, from the pairs at the offsets 32 and 36, at every window that is left. A window
   that stood earlier is covered.

Grouping is by name with partial sums, so a passage in a third of all documents is no hot key, and
text never meets text. A start is (doc_id, twin, byte position), where twin is a hash of the text;
only strictly smaller starts are earlier.

Edge cases: null or empty text has 0 bytes and loses none; a null doc_id stands before all others;
repeated rows (equal doc_id and text) are one document and get equal results; rows of one doc_id, or
of none, with different texts are documents of their own, in the order of their twins; very long
texts are read in overlapping pieces; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm._common import discard, released

GRAM = 32
LENGTH = 100
#: Bytes of one piece of a text; a batch has two at most, and positions in it take 23 bits.
PIECE = 1 << 18
_LOW = np.uint64((1 << 23) - 1)
#: Ranges of anchor offsets that a block's windows are dealt to.
RANGES = 8


@functools.lru_cache(2)
def _tables(n: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Two independent hashes: byte values, powers and inverse powers modulo 2**64."""
    rng = np.random.default_rng(20240229)
    out = []
    for odd in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        values = rng.integers(0, 1 << 64, 256, np.uint64)
        inverse = pow(odd, -1, 1 << 64)
        powers = []
        for base in (odd, inverse):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            powers.append(np.multiply.accumulate(p))
        out.append((values, *powers))
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


class Names:
    """Names of substrings of one byte array."""

    def __init__(self, data: np.ndarray):
        self.sums = []
        for values, power, inverse in _tables(1 << max(19, (len(data) - 1).bit_length())):
            s = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(values[data] * power[: len(data)], out=s[1:])
            self.sums.append((s, inverse))

    def dense(self, size: int, which: int = 0) -> np.ndarray:
        """Names of the prefixes of `size` bytes at all positions that have so many."""
        s, inverse = self.sums[which]
        n = len(s) - size
        return _mix((s[size:] - s[:n]) * inverse[:n]) if n > 0 else np.zeros(0, np.uint64)

    def at(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Names of data[a:b] by both hashes together."""
        (s, i), (t, j) = self.sums
        return _mix((s[b] - s[a]) * i[a]) ^ _mix((t[b] - t[a]) * j[a] + np.uint64(0x632BE59BD9B4E019))


def _window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values."""
    have, out = 1, x
    while have * 2 <= w:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(out) - (w - have)], out[w - have :]) if w > have else out


def _pieces(docs: list[tuple[int, bytes]], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """(doc_id, position, bytes) in batches; pieces of one text overlap so that each window lies in one."""
    batch, size = [], 0
    for doc, data in docs:
        for at in range(0, max(0, len(data) - length) + 1, PIECE):
            part = data[at : at + PIECE + length - 1]
            if len(part) < length:
                continue
            if batch and size + len(part) > PIECE * 2:
                yield batch
                batch, size = [], 0
            batch.append((doc, at, part))
            size += len(part)
    if batch:
        yield batch


def anchors(batch: list[tuple[int, int, bytes]], length: int = LENGTH) -> dict[str, np.ndarray]:
    """name, block, doc_id, lo, off, n: an anchor's name, its block's name, the windows [lo, lo + n) that it owns, and its offset in the first."""
    data = np.frombuffer(b"".join(p for _, _, p in batch), np.uint8)
    sizes = np.array([len(p) for _, _, p in batch])
    ends = np.cumsum(sizes)
    begin = ends - sizes
    names = Names(data)
    grams = names.dense(GRAM)
    order = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
    least = (_window_min(order, length - GRAM + 1) & _LOW).astype(np.int64)  # anchor of each window
    valid = np.ones(len(least), bool)
    for e in ends[:-1]:
        valid[max(0, e - length + 1) : e] = False
    cut = np.ones(len(least), bool)
    cut[1:] = (least[1:] != least[:-1]) | ~valid[:-1]
    lo = np.flatnonzero(cut & valid)
    stop = np.flatnonzero(valid & np.append(cut[1:] | ~valid[1:], True)) + 1
    piece = np.searchsorted(ends, lo, side="right")
    doc = np.array([d for d, _, _ in batch], np.int64)[piece]
    at = np.array([a for _, a, _ in batch], np.int64)[piece] - begin[piece]
    return {"name": grams[least[lo]].view(np.int64), "block": names.at(lo, stop + length - 1).view(np.int64), "doc_id": doc, "lo": lo + at, "off": least[lo] - lo, "n": stop - lo}


def windows(parts: list[bytes], counts: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Names, by two independent hashes, of the first counts[i] windows of each part, each doubled from pairs."""
    sizes = np.array([len(p) for p in parts])
    begin = np.cumsum(sizes) - sizes
    counts = counts.astype(np.int64)
    at = np.repeat(begin - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    names = Names(np.frombuffer(b"".join(parts), np.uint8))
    pair = lambda x, y: _mix(x * np.uint64(0x9FB21C651E98DF25) + y)
    out = []
    for which in (0, 1):
        f = names.dense(GRAM, which)
        double = lambda q: pair(f[q], f[q + GRAM])  # noqa: E731, B023
        out.append(pair(double(at), double(at + (length - 2 * GRAM))))
    return out[0], out[1]


def ranges(parts: list[bytes], off: np.ndarray, counts: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(part, first window, windows, core's name, content's name) of the ranges that the windows of each block are dealt to.

    The windows of range r have the anchor at the offsets edges[r] to edges[r + 1] - 1.
    """
    edges = [round((length - GRAM + 1) * r / RANGES) for r in range(RANGES + 1)]
    sizes = np.array([len(p) for p in parts])
    begin = np.cumsum(sizes) - sizes
    names = Names(np.frombuffer(b"".join(parts), np.uint8))
    out = []
    for r, (least, most) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        high, low = np.minimum(off, most - 1), np.maximum(off - counts + 1, least)
        part = np.flatnonzero(high >= low)
        first, n, anchor = (off - high)[part], (high - low + 1)[part], (begin + off)[part]
        core = _mix(names.at(anchor - least, anchor + length - (most - 1)) + np.uint64(r))
        at = begin[part] + first
        out.append((part, first, n, core, names.at(at, at + n - 1 + length)))
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def covered(docs: DataFrame, length: int = LENGTH) -> tuple[DataFrame, list[DataFrame]]:
    """(doc_id, twin, start, end: byte ranges whose union is what also starts earlier; the tables it draws on). docs: doc_id, twin (not null), data (binary)."""
    if length < 2 * GRAM or length > 4 * GRAM:
        raise ValueError(f"length must be {2 * GRAM} to {4 * GRAM}")

    def found(batches):
        for b in batches:
            doc, twin = b.column(0).to_numpy(), b.column(1).to_numpy()
            rows = enumerate(x.as_buffer() for x in b.column(2))
            for batch in _pieces([(i, x) for i, x in rows if x.size >= length], length):
                a = anchors(batch, length)
                yield a | {"doc_id": doc[a["doc_id"]], "twin": twin[a["doc_id"]]}

    def names(batches):
        for a in found(batches):
            name, times = np.unique(a["name"], return_counts=True)
            yield pa.RecordBatch.from_pydict({"name": name, "times": times})

    def places(batches):
        for a in found(batches):
            yield pa.RecordBatch.from_pydict({"name": a["name"], "block": a["block"], "doc_id": a["doc_id"], "twin": a["twin"], "run": a["lo"] << 14 | a["off"] << 7 | a["n"]})

    long = docs.filter(F.octet_length("data") >= length)
    # round 1: names alone travel first, so that places of unique names never do more than meet the repeated ones
    repeated = released(long.mapInArrow(names, "name long, times long").groupBy("name").agg(F.sum("times").alias("times")).filter("times > 1").select("name"), "repeat-names")
    kept = long.mapInArrow(places, "name long, block long, doc_id long, twin long, run long").join(repeated, "name", "left_semi")
    places_table = released(kept, "repeat-places")
    discard(repeated)
    bits = lambda shift: F.shiftright("run", shift).bitwiseAND(F.lit(127))
    kept = places_table.select("name", "block", "doc_id", "twin", F.shiftright("run", 14).alias("lo"), bits(7).alias("off"), bits(0).alias("n"))
    start = F.struct("doc_id", "twin", "lo")

    def first_places(rows, keys, more):
        """The first place of equals, with what goes with it, and how many there are."""
        return rows.groupBy(*keys).agg(F.min(F.struct("doc_id", "twin", "lo", *more)).alias("first"), F.count("*").alias("times")).select(*keys, F.struct("first.doc_id", "first.twin", "first.lo").alias("first"), "times", *[f"first.{c}" for c in more])

    def later(rows, firsts, keys):
        """Byte ranges of the rows whose equals start earlier."""
        again = firsts.filter("times > 1").select(*keys, "first")
        return rows.join(again, keys).filter(start > F.col("first")).select("doc_id", "twin", F.col("lo").alias("start"), (F.col("lo") + F.col("n") - 1 + length).alias("end"))

    def undecided(firsts, name):
        """First places of what shares a name with something different, and a table that they draw on."""
        many = released(firsts.groupBy(name).agg(F.count("*").alias("_n")).filter("_n > 1").select(name), "repeat-shared")
        return firsts.join(many, name, "left_semi"), many

    # round 2
    blocks = released(first_places(kept, ["name", "block", "n"], ["off"]), "repeat-blocks")
    whole = released(later(kept, blocks, ["name", "block", "n"]), "repeat-found")
    discard(places_table)
    left, many = undecided(blocks, "name")
    left = left.select("first.doc_id", "first.twin", "first.lo", "n", "off").groupBy("doc_id", "twin").agg(F.collect_list(F.struct("lo", "n", "off")).alias("runs"))

    def cut(batches):
        for b in batches:
            for doc, twin, data, runs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), strict=True):
                data = data.as_buffer()
                for i in range(0, len(runs), 4096):
                    part = runs[i : i + 4096]
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array([doc] * len(part), pa.int64()), "twin": pa.array([twin] * len(part), pa.int64()), "block": pa.array([r["lo"] for r in part], pa.int64()), "n": pa.array([r["n"] for r in part], pa.int64()), "off": pa.array([r["off"] for r in part], pa.int64()), "bytes": pa.array([data[r["lo"] : r["lo"] + r["n"] - 1 + length].to_pybytes() for r in part], pa.binary())})

    # a block's bytes travel once, not once for each of its windows or each repeated row
    once = long.dropDuplicates(["doc_id", "twin"])
    contents = released(once.join(left, ["doc_id", "twin"]).select("doc_id", "twin", "data", "runs").mapInArrow(cut, "doc_id long, twin long, block long, n long, off long, bytes binary"), "repeat-contents")
    discard(blocks, many)

    def deal(batches):
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                doc, twin, block, n, off = (c.to_numpy() for c in b.slice(i, 4096).columns[:5])
                part, first, windows_, core, content = ranges(b.column(5).slice(i, 4096).to_pylist(), off, n, length)
                yield pa.RecordBatch.from_pydict({"core": core.view(np.int64), "content": content.view(np.int64), "n": windows_, "doc_id": doc[part], "twin": twin[part], "lo": block[part] + first, "block": block[part]})

    # round 3
    parts = released(contents.mapInArrow(deal, "core long, content long, n long, doc_id long, twin long, lo long, block long"), "repeat-ranges")
    firsts = released(first_places(parts, ["core", "content", "n"], ["block"]), "repeat-cores")
    in_part = released(later(parts, firsts, ["core", "content", "n"]), "repeat-found")
    discard(parts)
    left, many = undecided(firsts, "core")
    runs = left.groupBy("first.doc_id", "first.twin", "block").agg(F.collect_list(F.struct("first.lo", "n")).alias("runs"))
    texts = contents.join(runs, ["doc_id", "twin", "block"]).select("doc_id", "twin", "block", "runs", "bytes")

    def spread(batches):
        for b in batches:
            for i in range(0, b.num_rows, 2048):
                c = b.slice(i, 2048)
                doc, twin, block = (c.column(k).to_numpy() for k in range(3))
                rows = [(k, r["lo"], r["n"]) for k, got in enumerate(c.column(3).to_pylist()) for r in got]
                of, lo, n = (np.array(x, np.int64) for x in zip(*rows, strict=True))
                data = c.column(4).to_pylist()
                at = lo - block[of]
                one, two = windows([data[k][a : a + m - 1 + length] for k, a, m in zip(of.tolist(), at.tolist(), n.tolist(), strict=True)], n, length)
                inside = np.arange(len(one)) - np.repeat(np.cumsum(n) - n, n)
                yield pa.RecordBatch.from_pydict({"one": one.view(np.int64), "two": two.view(np.int64), "doc_id": np.repeat(doc[of], n), "twin": np.repeat(twin[of], n), "lo": np.repeat(lo, n) + inside, "n": np.ones(len(one), np.int64)})

    # round 4
    single = released(texts.mapInArrow(spread, "one long, two long, doc_id long, twin long, lo long, n long"), "repeat-windows")
    discard(contents, firsts, many)
    alone = later(single, first_places(single, ["one", "two"], []), ["one", "two"])
    return whole.unionByName(in_part).unionByName(alone), [whole, in_part, single]


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of byte ranges, as maximal runs."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _key(docs: DataFrame) -> tuple[Column, Column, Column]:
    """doc_id, twin and data of each row."""
    data = F.coalesce(docs["text"], F.lit("")).cast("binary")
    return F.coalesce(docs["doc_id"], F.lit(-(1 << 63))), F.xxhash64(data), data


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(*[c.alias(n) for c, n in zip(_key(docs), ("doc_id", "twin", "data"), strict=True)])


def _spans(docs: DataFrame, length: int) -> DataFrame:
    """doc_id, twin, ranges: a document's covered byte ranges, as many at most as its bytes."""
    ranges, tables = covered(_keyed(docs), length)
    spans = released(ranges.groupBy("doc_id", "twin").agg(F.collect_set(F.struct("start", "end")).alias("ranges")), "repeat-spans")
    discard(*tables)
    return spans


def dedup_digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every document."""

    def cut(batches):
        for b in batches:
            out = []
            for doc, data, ranges in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                data = data.as_py()
                runs = merge([(r["start"], r["end"]) for r in ranges or ()])
                h, at = hashlib.sha256(), 0
                for s, e in [*runs, (len(data), len(data))]:
                    h.update(data[at:s])
                    at = e
                out.append((doc, len(data), sum(e - s for s, e in runs), len(runs), h.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]) if out else pa.RecordBatch.from_pydict({k: pa.array([], t) for k, t in (("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()))})

    rows = _keyed(docs).join(_spans(docs, length), ["doc_id", "twin"], "left").select("doc_id", "data", "ranges")
    out = rows.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != -(1 << 63), F.col("doc_id")))


def dedup_texts(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents with repeated passages cut out of their texts; n_chars follows where it is a column.

    A character is cut only if all its bytes are covered, so texts stay valid UTF-8. Rows are kept,
    a text that was wholly covered becomes empty, and a null text stays null.
    """

    def cut(text: str, runs: list) -> str:
        data, out, at = text.encode(), [], 0
        for s, e in merge([(r["start"], r["end"]) for r in runs]):
            while s < len(data) and data[s] & 0xC0 == 0x80:
                s += 1
            while e < len(data) and e > s and data[e] & 0xC0 == 0x80:
                e -= 1
            if e > s:
                out.append(data[at:s])
                at = e
        return b"".join([*out, data[at:]]).decode()

    @F.pandas_udf("string")
    def drop(text: pd.Series, runs: pd.Series) -> pd.Series:
        return pd.Series([None if t is None or r is None else cut(t, r) for t, r in zip(text, runs, strict=True)], dtype=object)

    own = {"doc_id": "_lamina_doc", "twin": "_lamina_twin", "ranges": "_lamina_ranges"}
    spans = _spans(docs, length).withColumnsRenamed(own)
    doc, twin, _ = _key(docs)
    rows = docs.join(spans, (doc == F.col("_lamina_doc")) & (twin == F.col("_lamina_twin")), "left")
    changed = F.col("_lamina_ranges").isNotNull()
    rows = rows.withColumn("text", F.when(changed, drop(F.when(changed, F.col("text")), F.col("_lamina_ranges"))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return rows.select(*docs.columns)
