"""Byte-level BPE encoding and decoding.

Texts become one array of code points with a mark between texts. Each code point has a symbol, each
symbol is a function on the states of a small automaton, and the functions are composed block by
block (composition is associative, so all blocks advance together). States at every position give
the token boundaries of the split pattern without a regular expression. The slices between
boundaries are looked up in a bounded cache in front of the pair merging.

Edge cases: null and empty texts give no ids; a null doc_id stays null; repeated rows give repeated
results; a single very long text is encoded whole; an empty table gives an empty result; columns
other than doc_id and text are ignored. Code points are classed by Python's Unicode tables.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import unicodedata
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm._common import by_size, small_batches

#: Pieces that a worker's cache holds before it starts anew.
CACHE_PIECES = 250_000
#: Code points that are white space (fixed values of Unicode's White_Space).
SPACES = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
MARK = 0x110000

# symbols
END, BLANK, SPACE, NUMBER, OTHER, QUOTE, LETTER, ONE, RV, LL, EE = range(11)
# states: what the last code point was, as far as a contraction needs to know it
S_START, S_BLANK, S_SPACE, S_NUMBER, S_OTHER, S_QUOTE, S_LETTER, S_DONE, S_RV, S_L, S_DONE2 = range(11)


@functools.cache
def symbol_table() -> np.ndarray:
    table = np.full(MARK + 1, OTHER, np.uint8)
    kinds = {"L": LETTER, "N": NUMBER}
    for cp in range(MARK):
        if k := kinds.get(unicodedata.category(chr(cp))[0]):
            table[cp] = k
    table[list(SPACES)] = SPACE
    for chars, s in ((" ", BLANK), ("'", QUOTE), ("stmd", ONE), ("rv", RV), ("l", LL), ("e", EE)):
        table[[ord(c) for c in chars]] = s
    table[MARK] = END
    return table


def _step(state: int, symbol: int) -> int:
    if symbol <= OTHER:
        return (S_START, S_BLANK, S_SPACE, S_NUMBER, S_OTHER)[symbol]
    if symbol == QUOTE:  # opens a contraction unless it goes on a run of others or follows a blank
        return S_OTHER if state in (S_OTHER, S_QUOTE, S_BLANK) else S_QUOTE
    if state == S_QUOTE:
        return {ONE: S_DONE, RV: S_RV, LL: S_L}.get(symbol, S_LETTER)
    if (state, symbol) in ((S_RV, EE), (S_L, LL)):
        return S_DONE2
    return S_LETTER


@functools.cache
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(function of each symbol, product of two functions, value of a function at a state)."""
    n = 11
    gens = [tuple(_step(s, a) for s in range(n)) for a in range(n)]
    known = {tuple(range(n)): 0}
    queue = [tuple(range(n))]
    for f in queue:
        for g in gens:
            h = tuple(g[x] for x in f)
            if h not in known:
                known[h] = len(known)
                queue.append(h)
    values = np.array(queue, np.uint8)
    product = np.array([[known[tuple(g[x] for x in f)] for g in queue] for f in queue], np.uint8 if len(queue) <= 256 else np.uint16)
    return np.array([known[g] for g in gens], product.dtype), product, values


def scan_states(symbols: np.ndarray, width: int = 256) -> np.ndarray:
    """State after each symbol, from S_START, by composing functions in rows of `width`."""
    of, product, values = monoid()

    def prefixes(f: np.ndarray) -> np.ndarray:
        """Products f[0], f[0]f[1], ... of functions."""
        n = len(f)
        rows = -(-n // width)
        if rows <= 1:
            out = f.copy()
            for i in range(1, n):
                out[i] = product[out[i - 1], f[i]]
            return out
        cols = np.zeros((rows, width), f.dtype)
        cols.ravel()[:n] = f
        cols = np.ascontiguousarray(cols.T)
        for j in range(1, width):
            cols[j] = product[cols[j - 1], cols[j]]
        before = np.zeros(rows, f.dtype)
        before[1:] = prefixes(cols[-1])[:-1]
        return product[before[None, :], cols].T.ravel()[:n]

    return values[prefixes(of[symbols]), S_START]


def starts(cps: np.ndarray) -> np.ndarray:
    """Positions at which a piece starts; marks start no piece but end the one before."""
    sym = symbol_table()[cps]
    state = scan_states(sym)
    kind = np.array([0, 1, 1, 2, 3, 3, 4, 4, 4, 4, 4], np.uint8)[sym]
    n = len(cps)
    prev_kind = np.empty(n, np.uint8)
    prev_kind[0], prev_kind[1:] = 0, kind[:-1]
    prev_state = np.empty(n, np.uint8)
    prev_state[0], prev_state[1:] = S_START, state[:-1]
    next_kind = np.empty(n, np.uint8)
    next_kind[-1], next_kind[:-1] = 0, kind[1:]
    space = kind == 1
    start = (kind != prev_kind) | (prev_state == S_DONE) | (prev_state == S_DONE2)
    start &= (prev_state != S_BLANK) | space  # a blank belongs to what follows it
    start |= space & (next_kind > 1)  # and so leaves a run of white space
    start[state == S_DONE] = False
    start[np.flatnonzero(state == S_DONE2) - 1] = False
    start[kind == 0] = True
    return np.flatnonzero(start)


def split(texts: Sequence[str]) -> list[list[str]]:
    """The pieces of each text."""
    mark = MARK.to_bytes(4, "little")
    cps = np.frombuffer(b"".join(x for t in texts for x in (t.encode("utf-32-le"), mark)), np.uint32)
    at = starts(cps)
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1  # the marks
    cut = np.searchsorted(at, ends)
    out, lo, base = [], 0, 0
    for t, hi, end in zip(texts, cut.tolist(), ends.tolist(), strict=True):
        a = (at[lo : hi + 1] - base).tolist()
        out.append([t[i:j] for i, j in zip(a, a[1:], strict=False)])
        lo, base = hi + 1, end + 1
    return out


class Vocabulary(dict):
    """piece -> ids, filled by pair merging as pieces appear."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for t, i in self.ranks.items():
            self.tokens[i] = t
        self.digits = [str(i) for i in range(len(self.tokens))]
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.merge(piece.encode())
        if len(piece) <= 64:
            self[piece] = ids
        return ids

    def merge(self, data: bytes) -> tuple[int, ...]:
        """Join the adjacent pair of lowest rank, leftmost first, until no pair has a rank."""
        ranks = self.ranks
        if (whole := ranks.get(data)) is not None:
            return (whole,)
        if len(data) > 400:
            return self._merge_long(data)
        parts = [data[i : i + 1] for i in range(len(data))]
        pairs = [ranks.get(data[i : i + 2], MARK) for i in range(len(data) - 1)]
        while pairs and (low := min(pairs)) < MARK:
            i = pairs.index(low)
            parts[i] += parts.pop(i + 1)
            pairs.pop(i)
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], MARK)
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], MARK)
        return tuple(ranks[p] for p in parts)

    def _merge_long(self, data: bytes) -> tuple[int, ...]:
        """The same with a heap and linked parts: n log n for pieces without a break."""
        import heapq

        ranks, n = self.ranks, len(data)
        end = list(range(1, n + 1))
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, mid, stop = heapq.heappop(heap)
            if not alive[i] or end[i] != mid or mid >= n or not alive[mid] or end[mid] != stop:
                continue
            alive[mid] = False
            end[i] = stop
            after[i] = stop
            if stop < n:
                before[stop] = i
                if (r := ranks.get(data[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, stop, end[stop]))
            if (p := before[i]) >= 0 and (r := ranks.get(data[p:stop])) is not None:
                heapq.heappush(heap, (r, p, i, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return tuple(out)

    def encode(self, texts: Sequence[str]) -> Iterator[list[int]]:
        """The ids of each text."""
        if len(self) > CACHE_PIECES:
            self.clear()
        for pieces in split(texts):
            yield list(chain.from_iterable(map(self.__getitem__, pieces)))

    def decode(self, ids: Sequence[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def decode_slices(self, ids: Sequence[int], ends: np.ndarray, step: int = 4096) -> bytes:
        """The bytes of the ids, each slice of them written at the offset where it starts."""
        out = bytearray(int(ends[-1]) if len(ends) else 0)
        for a in range(0, len(ids), step):
            b = min(len(ids), a + step)
            out[int(ends[a - 1]) if a else 0 : int(ends[b - 1])] = self.decode(ids[a:b])
        return bytes(out)

    def offsets(self, ids: Sequence[int]) -> np.ndarray:
        """Byte at which each token ends, so that any run of ids can be decoded in place."""
        return np.cumsum(self.lengths[np.asarray(ids, np.int64)]) if len(ids) else np.zeros(0, np.int64)


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[list, list[list[int]]]]:
    v = vocabulary(path)
    for b in batches:
        keys, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
        for lo, hi in by_size(texts):
            yield keys[lo:hi], list(v.encode(texts[lo:hi]))


def _rows(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def encode_documents(docs: DataFrame, path: str | None = None, with_offsets: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids, and if asked for the byte at which each token ends."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batches):
        v = vocabulary(path)
        for keys, rows in _encoded(batches, path):
            cols = {"doc_id": pa.array(keys, pa.int64()), "n_tokens": pa.array([len(x) for x in rows], pa.int64()), "ids": pa.array(rows, pa.list_(pa.int32()))}
            if with_offsets:
                cols["ends"] = pa.array([v.offsets(x) for x in rows], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_pydict(cols)

    return _rows(docs).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>" + ", ends array<long>" * with_offsets)


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the bytes of its ids."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batches):
        v = vocabulary(path)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "data": pa.array([v.decode(x or ()) for x in part.column(1).to_pylist()], pa.binary())})

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def round_trip_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes, decodes the ids at their offsets, and keeps digests of both."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batches):
        v = vocabulary(path)
        for keys, rows in _encoded(batches, path):
            ids = [hashlib.sha256(" ".join(map(v.digits.__getitem__, x)).encode()).hexdigest() for x in rows]
            data = [hashlib.sha256(v.decode_slices(x, v.offsets(x))).hexdigest() for x in rows]
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(keys, pa.int64()), "n_tokens": pa.array([len(x) for x in rows], pa.int64()), "ids_sha256": ids, "decoded_sha256": data})

    return _rows(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
