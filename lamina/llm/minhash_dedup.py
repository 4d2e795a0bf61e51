"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

1. Each document's set of word shingles is hashed. Two permutations generate all signature
   coordinates: the first gives a shingle its slot on a circle, the second, shifted by k places,
   is coordinate k. A shingle's values at all coordinates are thus one run of the second
   permutation, read in one piece. Equal sets are merged first; the smallest doc_id stands for them.
2. Signatures are cut in bands (40 of 5: a pair at similarity 0.8 is missed with probability 1.3e-7).
   Every document is compared exactly, on full sets, with the smallest of each band that it shares:
   as many comparisons at most as it has bands, so a group of n near copies costs n.
3. A band whose other documents are then of several components is settled by the rest of its pairs:
   those outside its largest component, in blocks, meet all others, in chunks, and links between
   different components are kept.
4. Components of the verified links.

Sets are compared as 64-bit hashes of shingles: two different shingles of a pair of texts of n words
are taken for one with odds of n**2 / 2**64, 5e-12 at 10,000 words.

Edge cases: null, empty and blank texts have an empty set and link with nothing; a text with fewer
words than a shingle is one shingle; rows that share a doc_id are documents of their own unless their
sets are equal; a null doc_id links with nothing, has no component and is kept, as is every row without words; of equals the smallest
doc_id stands for the group, so ties don't arise; an empty table gives an empty result; very long
texts are hashed whole; other columns are ignored (`keep_one` returns all of them, and of rows with
equal doc_id and set the one with the least hash of its text).
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm._common import by_size, discard, released, written
from lamina.llm._graph import components
from lamina.llm.suffix_dedup import Names, _mix

ROWS, BANDS = 5, 40
#: Size of the circle, as a power of two.
CIRCLE = 22
#: Documents and shingles in one block of the verification, about, and documents that it meets at once.
BLOCK_DOCS, BLOCK_SHINGLES, CHUNK_DOCS = 256, 500_000, 512

_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@functools.cache
def _circle(coordinates: int) -> np.ndarray:
    """The second permutation, with its beginning repeated at its end."""
    p = np.random.default_rng(7).permutation(1 << CIRCLE).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([p, p[:coordinates]]), coordinates)


def shingle_sets(texts: list[str], words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data = np.frombuffer(b"\n".join(t.encode() for t in texts) + b"\n", np.uint8)
    names = Names(_LOWER[data])
    blank = _BLANK[data]
    before = np.empty(len(blank), bool)
    before[0], before[1:] = True, blank[:-1]
    a, b = np.flatnonzero(~blank & before), np.flatnonzero(blank & ~before)
    w = names.at(a, b)
    ends = np.cumsum([len(t.encode()) + 1 for t in texts])
    cut = np.searchsorted(a, ends).tolist()
    grams = w[: max(0, len(w) - words + 1)]
    for k in range(1, words):
        grams = _mix(grams * np.uint64(0x9FB21C651E98DF25) + w[k : k + len(grams)])
    out, lo = [], 0
    for hi in cut:
        if hi - lo >= words:
            out.append(np.unique(grams[lo : hi - words + 1]))
        elif hi > lo:
            g = w[lo : lo + 1]
            for k in range(1, hi - lo):
                g = _mix(g * np.uint64(0x9FB21C651E98DF25) + w[lo + k : lo + k + 1])
            out.append(_mix(g + np.uint64(hi - lo)))
        else:
            out.append(np.zeros(0, np.uint64))
        lo = hi
    return out


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """A row of minima for each set that isn't empty."""
    circle = _circle(coordinates)
    sets = [s for s in sets if len(s)]
    out = np.full((len(sets), coordinates), np.uint32(0xFFFFFFFF))
    slots = [(_mix(s + np.uint64(0x51ED270B)) >> np.uint64(64 - CIRCLE)).astype(np.int64) for s in sets]
    lo = 0
    while lo < len(sets):
        hi, size = lo, 0
        while hi < len(sets) and (hi == lo or size + len(slots[hi]) <= 8192):
            size += len(slots[hi])
            hi += 1
        if hi == lo + 1:
            for i in range(0, size, 8192):
                np.minimum(out[lo], circle[slots[lo][i : i + 8192]].min(axis=0), out=out[lo])
        else:
            at = np.cumsum([0, *(len(s) for s in slots[lo : hi - 1])])
            out[lo:hi] = np.minimum.reduceat(circle[np.concatenate(slots[lo:hi])], at, axis=0)
        lo = hi
    return out


def band_keys(signature: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """A 64-bit key for each row and band; the band's number is part of it."""
    parts = signature[:, : rows * bands].reshape(len(signature), bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15), parts.shape[:2])
    for r in range(rows):
        key = _mix(key * np.uint64(0xD6E8FEB86659FD93) + parts[:, :, r])
    return key


def similar(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    """Whether two sets have a Jaccard similarity of at least percent/100."""
    both = len(np.intersect1d(one, two, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(one) + len(two) - both)


class Block:
    """Sets that others are compared with, as a list of their values in order."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets])
        values = np.concatenate(sets)
        order = np.argsort(values, kind="stable")
        self.values, self.row = values[order], np.repeat(np.arange(len(sets)), self.size)[order]

    def near(self, other: np.ndarray, percent: int) -> np.ndarray:
        """The rows of the block whose similarity with the other set is at least percent/100."""
        lo, hi = np.searchsorted(self.values, other), np.searchsorted(self.values, other, "right")
        n = hi - lo
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        both = np.bincount(self.row[at], minlength=len(self.size))
        return np.flatnonzero((both > 0) & (100 * both >= percent * (self.size + len(other) - both)))


def hashed(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, twin (a hash of the text), n, one, two (the set's fingerprint), bands."""

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            texts = b.column(2).to_pylist()
            for lo, hi in by_size(texts, 1 << 18):
                sets = shingle_sets(texts[lo:hi], words)
                n = np.array([len(s) for s in sets], np.int64)
                sums = [np.array([_mix(s ^ np.uint64(x)).sum(dtype=np.uint64) if len(s) else 0 for s in sets], np.uint64).view(np.int64) for x in (0, 0x5BD1E995A7C3F10D)]
                keyed = band_keys(signatures(sets, ROWS * BANDS), ROWS, BANDS).view(np.int64)
                at = np.concatenate([[0], np.cumsum((n > 0) * BANDS)]).astype(np.int32)
                yield pa.RecordBatch.from_pydict({"doc_id": b.column(0).slice(lo, hi - lo), "twin": b.column(1).slice(lo, hi - lo), "n": n, "one": sums[0], "two": sums[1], "bands": pa.ListArray.from_arrays(pa.array(at), pa.array(keyed.ravel()))})

    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("twin"), text.alias("text")).mapInArrow(run, "doc_id long, twin long, n long, one long, two long, bands array<long>")


NODE = "struct<doc_id: long, twin: long, n: long>"
_NODE = pa.struct([("doc_id", pa.int64()), ("twin", pa.int64()), ("n", pa.int64())])


def _links(rows: list[tuple[dict, dict]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in rows], _NODE), "b": pa.array([b for _, b in rows], _NODE)})


def _with_centres(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are near copies; rows of one b mostly come together, so its set is made once."""

    def run(batches):
        now, centre = None, None
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                a, b, left, right = (c.to_pylist() for c in part.columns)
                sets, out = shingle_sets(left, words), []
                for x, y, one, text in zip(a, b, sets, right, strict=True):
                    if y != now:
                        now, centre = y, shingle_sets([text], words)[0]
                    if similar(one, centre, percent):
                        out.append((x, y))
                yield _links(out)

    rows = pairs.join(texts.withColumnsRenamed({"node": "a", "text": "left"}), "a").join(texts.withColumnsRenamed({"node": "b", "text": "right"}), "b")
    return rows.select("a", "b", "left", "right").mapInArrow(run, f"a {NODE}, b {NODE}")


def _the_rest(members: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links between the components of each band. members: key, node, component, of bands that have several."""
    sizes = members.groupBy("key", "component").agg(F.count("*").alias("_n"), F.sum("node.n").alias("_shingles"))
    bands = sizes.groupBy("key").agg(F.max(F.struct("_n", "component", "_shingles")).alias("most"), F.sum("_n").alias("all"), F.sum("_shingles").alias("shingles"))
    blocks = F.greatest(F.ceil((F.col("all") - F.col("most._n")) / BLOCK_DOCS), F.ceil((F.col("shingles") - F.col("most._shingles")) / BLOCK_SHINGLES), F.lit(1)).cast("int")
    bands = released(bands.select("key", F.col("most.component").alias("most"), blocks.alias("blocks"), F.ceil(F.col("all") / CHUNK_DOCS).cast("int").alias("chunks")), "unsettled-bands")
    rows = members.join(bands, "key").withColumn("_h", F.xxhash64("node"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    block, chunk = F.pmod("_h", "blocks").cast("int"), F.pmod("_h", "chunks").cast("int")
    asking = rows.filter("component != most").select("key", block.alias("block"), each("chunks").alias("chunk"), F.lit(0).alias("side"), "node", "component")
    asked = rows.select("key", each("blocks").alias("block"), chunk.alias("chunk"), F.lit(1).alias("side"), "node", "component")
    units = asking.unionByName(asked).join(texts, "node").select("key", "block", "chunk", "side", "node", "component", "text")
    units = units.repartition("key", "block", "chunk").sortWithinPartitions("key", "block", "chunk", "side")

    def run(batches):
        now, held, block, root = None, [], None, {}

        def find(x):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        for b in batches:
            for i in range(0, b.num_rows, 64):
                *unit, side, node, component, text = (c.to_pylist() for c in b.slice(i, 64).columns)
                out = []
                for at, which, n, c, one in zip(zip(*unit, strict=True), side, node, component, shingle_sets(text, words), strict=True):
                    if at != now:
                        now, held, block, root = at, [], None, {}
                    c = tuple(c.values())
                    if which == 0:
                        held.append((n, c, one))
                        continue
                    if not held:
                        continue
                    block = block or Block([x for _, _, x in held])
                    for k in block.near(one, percent).tolist():
                        if find(held[k][1]) != find(c):
                            root[find(c)] = find(held[k][1])
                            out.append((held[k][0], n))
                yield _links(out)

    return units.mapInArrow(run, f"a {NODE}, b {NODE}")


def _labelled(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, twin, n, one, two, component_id of every row."""
    sets = written(hashed(docs, words), "shingle-sets")
    identity = ["one", "two", "n"]
    full = sets.filter("n > 0 and doc_id is not null")
    node = F.struct("doc_id", "twin", "n")
    reps = released(full.groupBy(*identity).agg(F.min(node).alias("rep")), "set-reps")
    # the smallest row of each distinct set, with its bands
    chosen = full.select("doc_id", "twin", node.alias("node"), "bands").join(reps.select("rep.doc_id", "rep.twin"), ["doc_id", "twin"], "left_semi")
    banded = released(chosen.select("node", F.explode("bands").alias("key")), "set-bands")
    # keys are counted alone; places of unique ones go no further
    shared = released(banded.groupBy("key").agg(F.count("*").alias("_n")).filter("_n > 1").select("key"), "shared-bands")
    places = released(banded.join(shared, "key", "left_semi").distinct(), "band-places")
    discard(banded, shared)
    centres = released(places.groupBy("key").agg(F.min("node").alias("centre")), "band-centres")
    members = released(places.join(centres, "key"), "band-members")
    discard(places, centres)
    alike = F.least("a.n", "b.n") * 100 >= F.greatest("a.n", "b.n") * percent
    pairs = released(members.filter("node != centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).filter(alike).distinct(), "centre-pairs")
    of_docs = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("twin"), "text")
    wanted = pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).unionByName(members.filter("node != centre").select(F.col("node").alias("a"))).distinct().select("a.doc_id", "a.twin", F.col("a").alias("node"))
    found = released(of_docs.join(wanted, ["doc_id", "twin"]).select("node", "text"), "node-texts")
    texts = released(found.dropDuplicates(["node"]), "node-texts")  # a row that is repeated has one text
    discard(found)
    links = released(_with_centres(pairs, texts, words, percent), "centre-links")
    # a band's pairs with its centre are settled
    labelled = members.filter("node != centre").join(components(links), "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    several = released(labelled.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).filter("least < most").select("key"), "several")
    rest = released(_the_rest(released(labelled.join(several, "key", "left_semi"), "unsettled"), texts, words, percent), "other-links")
    discard(members, pairs, texts)
    joined = components(links.unionByName(rest))
    labels = reps.join(joined, F.col("rep") == F.col("node"), "left").select(*identity, F.coalesce("component.doc_id", "rep.doc_id").alias("component_id"))
    out = sets.join(labels, identity, "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
    return out.select("doc_id", "twin", *identity, "component_id")


def _kept():
    return F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    return _labelled(docs, words, percent).select("doc_id", F.col("n").alias("n_shingles"), "component_id", _kept().alias("kept"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` of which no near copy has a smaller doc_id; of rows with equal doc_id and set one stays."""
    kept = released(_labelled(docs, words, percent).filter(F.col("doc_id").isNotNull() & _kept()), "labelled")
    # of equal sets the least text, which may still stand in several rows; empty sets equal none
    verdict = kept.filter("n > 0").groupBy("doc_id", "one", "two", "n").agg(F.min("twin").alias("_lamina_twin")).select(F.col("doc_id").alias("_lamina_doc"), "_lamina_twin").distinct()
    times = kept.filter("n > 0").groupBy(F.col("doc_id").alias("_lamina_doc"), F.col("twin").alias("_lamina_twin")).agg(F.count("*").alias("_lamina_times"))
    empty = kept.filter("n = 0").select(F.col("doc_id").alias("_lamina_doc"), F.col("twin").alias("_lamina_twin"), F.lit(1).cast("long").alias("_lamina_times")).distinct()
    verdict = released(verdict.join(times, ["_lamina_doc", "_lamina_twin"]).unionByName(empty), "kept-ids")
    rows = docs.join(verdict, (F.col("doc_id").cast("long") == F.col("_lamina_doc")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("_lamina_twin")))
    once, more = rows.filter("_lamina_times = 1"), rows.filter("_lamina_times > 1").dropDuplicates(["_lamina_doc", "_lamina_twin"])
    return once.select(*docs.columns).unionByName(more.select(*docs.columns)).unionByName(docs.filter("doc_id is null"))
