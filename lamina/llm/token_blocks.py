"""Token ids as patched frame-of-reference blocks.

A file holds the ids of consecutive documents. Ids stand in blocks of 128: each block keeps its
minimum, packs the differences at the width that holds nine tenths of them, and lists the rest as
exceptions (position, whole difference). An index of block starts allows reading any range of ids
without the blocks before it.

File layout, little-endian: magic, format, block size, ids, documents, blocks, payload bytes; then
doc_id (i64), null flags (u8) and id counts (u32) of the documents; then minimum (u32), width (u8),
exceptions (u16) and start (u64, one more) of the blocks; then the blocks: packed words, exception
positions (u8), exception differences (u32).

Edge cases: null or empty text has only the end id; a null doc_id sorts first; rows that repeat a
doc_id stand side by side ordered by text, and rows that are equal in both are alike; a very long text is
encoded whole, and a document may fill a file of its own; an empty table gives no file; other columns
are ignored.
"""

from __future__ import annotations

import functools
import struct
import sys
import zlib
from array import array
from collections.abc import Iterator, Sequence
from unicodedata import is_normalized

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamina.llm import _blobs
from lamina.llm._common import by_size

MAGIC = b"LPFR"
BLOCK = 128
#: Share of a block's values that the packed width must hold.
SHARE = 0.9
#: Ids in one file, about: at 2 bytes each a file has some 4 MB.
FILE_IDS = 2_000_000
_HEAD = struct.Struct("<4sHHQQQQ")


def _bits(x: np.ndarray) -> np.ndarray:
    """Bit length of each unsigned 32-bit value."""
    return np.frexp(x.astype(np.float64))[1].astype(np.uint8)


def _pack(x: np.ndarray, w: int) -> np.ndarray:
    """Rows of 128 values below 2**w as rows of 16*w bytes."""
    cols = np.ascontiguousarray(x.T)
    out = np.zeros((4 * w, len(x)), np.uint32)
    for i in range(BLOCK):
        word, shift = divmod(i * w, 32)
        out[word] |= cols[i] << np.uint32(shift)
        if shift + w > 32:
            out[word + 1] |= cols[i] >> np.uint32(32 - shift)
    return np.ascontiguousarray(out.T).astype("<u4").view(np.uint8)


def _unpack(data: np.ndarray, w: int) -> np.ndarray:
    words = np.ascontiguousarray(np.ascontiguousarray(data).view("<u4").T).astype(np.uint32)
    out = np.empty((BLOCK, data.shape[0]), np.uint32)
    mask = np.uint32((1 << w) - 1)
    for i in range(BLOCK):
        word, shift = divmod(i * w, 32)
        x = words[word] >> np.uint32(shift)
        if shift + w > 32:
            x = x | (words[word + 1] << np.uint32(32 - shift))
        out[i] = x & mask
    return out.T


def encode_file(doc_ids: Sequence[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    """One file. counts: ids of each document; ids: all of them."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    x = np.empty(blocks * BLOCK, np.uint32)
    x[:n] = ids
    x[n:] = ids[-1] if n else 0
    x = x.reshape(blocks, BLOCK)
    least = x.min(axis=1) if blocks else np.zeros(0, np.uint32)
    x = x - least[:, None]
    bits = _bits(x)
    at = int(np.ceil(SHARE * BLOCK)) - 1
    width = np.partition(bits, at, axis=1)[:, at] if blocks else np.zeros(0, np.uint8)
    out_of = bits > width[:, None]
    extra = out_of.sum(axis=1).astype(np.uint16)
    start = np.zeros(blocks + 1, np.uint64)
    start[1:] = np.cumsum(width.astype(np.int64) * 16 + extra.astype(np.int64) * 5)
    body = np.zeros(int(start[-1]), np.uint8)
    for w in np.unique(width):
        if w:
            rows = np.flatnonzero(width == w)
            low = x[rows] & np.uint32((1 << int(w)) - 1) if w < 32 else x[rows]
            body[start[rows].astype(np.int64)[:, None] + np.arange(16 * int(w))] = _pack(low, int(w))
    row, col = np.nonzero(out_of)
    if len(row):
        first = np.concatenate(([0], np.cumsum(extra.astype(np.int64))))[row]
        nth = np.arange(len(row)) - first
        base = start[row].astype(np.int64) + width[row].astype(np.int64) * 16
        body[base + nth] = col
        values = x[row, col].astype("<u4").view(np.uint8).reshape(-1, 4)
        body[(base + extra[row] + 4 * nth)[:, None] + np.arange(4)] = values
    null = np.array([d is None for d in doc_ids], np.uint8)
    keys = np.array([d or 0 for d in doc_ids], "<i8")
    head = _HEAD.pack(MAGIC, 1, BLOCK, n, len(keys), blocks, len(body))
    parts = (keys, null, counts.astype("<u4"), least.astype("<u4"), width.astype(np.uint8), extra.astype("<u2"), start.astype("<u8"), body)
    return head + b"".join(p.tobytes() for p in parts)


class TokenFile:
    """Reads a file; `read(a, b)` touches only the blocks that hold ids a to b."""

    def __init__(self, data: bytes):
        magic, form, block, self.n, docs, self.blocks, body = _HEAD.unpack_from(data)
        if magic != MAGIC or form != 1 or block != BLOCK:
            raise ValueError("not a token block file")
        at = _HEAD.size

        def take(kind, count):
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        self.doc_ids, self.null, self.counts = take("<i8", docs), take(np.uint8, docs), take("<u4", docs)
        self.least, self.width, self.extra, self.start = take("<u4", self.blocks), take(np.uint8, self.blocks), take("<u2", self.blocks), take("<u8", self.blocks + 1)
        self.body = take(np.uint8, body)

    def read(self, a: int = 0, b: int | None = None) -> np.ndarray:
        b = self.n if b is None else min(b, self.n)
        if a >= b:
            return np.zeros(0, np.uint32)
        lo, hi = a // BLOCK, -(-b // BLOCK)
        width, start = self.width[lo:hi].astype(np.int64), self.start[lo:hi].astype(np.int64)
        x = np.zeros((hi - lo, BLOCK), np.uint32)
        for w in np.unique(width):
            if w:
                rows = np.flatnonzero(width == w)
                x[rows] = _unpack(self.body[start[rows][:, None] + np.arange(16 * w)], int(w))
        extra = self.extra[lo:hi].astype(np.int64)
        row = np.repeat(np.arange(hi - lo), extra)
        if len(row):
            nth = np.arange(len(row)) - np.repeat(np.cumsum(extra) - extra, extra)
            base = start[row] + width[row] * 16
            values = self.body[(base + extra[row] + 4 * nth)[:, None] + np.arange(4)]
            x[row, self.body[base + nth]] = np.ascontiguousarray(values).view("<u4")[:, 0]
        return (x + self.least[lo:hi, None]).ravel()[a - lo * BLOCK : b - lo * BLOCK]


#: Words that a worker's cache holds before it is set aside for a new one, which still draws on it.
CACHE_WORDS = 400_000


def _latin(text: str) -> bool:
    """Whether every character is below 256: these are composed already, and lower case changes none into several."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Words(dict):
    """word -> little-endian ids, each word encoded by the tokenizers library when it first appears.

    A word has no blank, tab or line end; the tokenizer neither joins nor changes anything across
    these, so a text's ids are its words' ids in order. A word of letters only (with a final mark)
    goes straight to the library's model; any other goes through the whole tokenizer.
    """

    def __init__(self, path: str, end: int, encode_special: bool = False):
        super().__init__()
        self.before: dict[str, bytes] = {}
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = encode_special
        self.model = self.tokenizer.model
        if sys.byteorder != "little" or array("I").itemsize != 4:
            raise RuntimeError("ids are kept as native 32-bit integers, which must be little-endian")
        self.end = np.array([end], "<u4").tobytes()
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = (b for b in range(256) if b not in set(shown))
        self.shown = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}

    def __missing__(self, word: str) -> bytes:
        base, mark = (word[:-1], word[-1]) if len(word) > 1 and word[-1] in ".,!?;:" else (word, "")
        low = base.lower()
        letters = len(base) <= 200 and base.isalpha() and (base.isascii() or max(base) < "ɐ" and low.isalpha() and is_normalized("NFC", low))
        if not letters:
            base, mark, low = word, "", word
        if seen := (ids := self.get(low)) is not None:
            pass
        elif (ids := self.before.get(low)) is None:
            if letters:
                text = low if low.isascii() else "".join(map(self.shown.__getitem__, low.encode()))
                ids = array("I", [t.id for t in self.model.tokenize(text)]).tobytes()
            else:
                ids = array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        if len(low) <= 64:
            self[low] = ids
        if mark:
            if mark not in self:
                self[mark] = array("I", self.tokenizer.encode(mark, add_special_tokens=False).ids).tobytes()
            ids += self[mark]
        if seen and len(word) <= 64:  # written otherwise for the second time
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of a text and the end id."""
        if len(self) > CACHE_WORDS:
            self.before = dict(self)
            self.clear()
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space to str.split alone
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes() + self.end
        if "<|" not in text and _latin(text):
            text = text.lower()  # one entry for a word, whatever its case
        return b"".join(map(self.__getitem__, text.split())) + self.end


@functools.cache
def words(path: str, end: int, encode_special: bool) -> Words:
    return Words(path, end, encode_special)


def write_token_files(docs: DataFrame, path: str | None = None, end: int = 2, encode_special: bool = False) -> str:
    """Encodes every document, in ascending doc_id order over all files; returns the folder.

    encode_special: text that reads like a special token is encoded as plain text; else it becomes
    that token, as the library does unless told otherwise.
    """
    path = path or public_tokenizers.path("word_bpe_49k.json")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, int, int]]:
        w = words(path, end, encode_special)
        keys, parts, size = [], [], 0

        def file():
            ids = np.frombuffer(b"".join(parts), "<u4")
            counts = np.array([len(p) // 4 for p in parts], np.uint32)
            return encode_file(keys, counts, ids), keys[0] or 0, len(ids)

        for b in batches:
            texts, at = b.column(1).to_pylist(), b.column(0).to_pylist()
            for lo, hi in by_size(texts):
                for key, text in zip(at[lo:hi], texts[lo:hi], strict=True):
                    ids = w.encode(text)
                    if parts and size + len(ids) // 4 > FILE_IDS:
                        yield file()
                        keys, parts, size = [], [], 0
                    keys.append(key)
                    parts.append(ids)
                    size += len(ids) // 4
        if parts:
            yield file()

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return _blobs.write_blobs(rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text"), make, "token-blocks", ".pfr")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, file from the files in a folder.

    Only (file, ids) pairs are summed for the starts, per task and then over tasks.
    """

    def run(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                f = TokenFile(data.as_py())
                ids = f.read().astype("<u4")
                ends = np.cumsum(f.counts, dtype=np.int64)
                begin = ends - f.counts
                raw = memoryview(ids.tobytes())
                crcs = [zlib.crc32(raw[4 * a : 4 * e]) for a, e in zip(begin.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(f.doc_ids, mask=f.null.astype(bool)), "inside": pa.array(begin), "n_tokens": pa.array(f.counts.astype(np.int64)), "ids_crc32": pa.array(crcs, pa.int64()), "file": pa.array([name] * len(begin), pa.string())})

    docs = _blobs.read_blobs(spark, path, ".pfr").mapInArrow(run, "doc_id long, inside long, n_tokens long, ids_crc32 long, file string")
    files = _blobs.manifest(spark, path).withColumn("part", F.substring("name", 1, 6))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("count").alias("n")).withColumn("part_start", F.coalesce(F.sum("n").over(before(Window.orderBy("part"))), F.lit(0))).drop("n")
    files = files.withColumn("file_start", F.coalesce(F.sum("count").over(before(Window.partitionBy("part").orderBy("name"))), F.lit(0))).join(parts, "part")
    starts = files.select(F.col("name").alias("file"), (F.col("part_start") + F.col("file_start")).alias("base"))
    return docs.join(starts, "file").select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", "file")
