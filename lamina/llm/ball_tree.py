"""Exact top-k by inner product: ball-tree branch and bound in each shard.

Each shard's tree is built once and written. A node's upper bound is the query's product with its
centre plus the query's length times its radius. First every shard answers from its most promising leaf; the k-th best score over all shards
is a lower bound that all shards share in the second pass, where nodes are taken in the order of
their bounds until the bound falls below the current k-th score.

Vectors are scaled to integers, floor(256 * x), and scores are integers, so ties are real ties and
go to the smaller vec_id.

Edge cases: vectors that are null, empty or hold null, NaN or infinite components take no part, nor
those with a component that is no double once it is scaled; zero vectors do; products are exact, and
one that leaves 64 bits scores as the nearest 64-bit number;
rows with the query's own vec_id are no candidates for it; of query rows that share a vec_id the least
vector asks, once; every row is a candidate, also where rows share a vec_id; vectors of different
sizes do not meet; a null vec_id takes no part; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm._common import written
from lamina.llm.vectors import finite, indexed, matrix, one_each, ranked, searched, usable_rows

LEAF = 64
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


class BallTree:
    """Nodes over a permutation of the rows; node i has children 2i+1 and 2i+2 while it is split."""

    def __init__(self, x: np.ndarray):
        self.order = np.arange(len(x))
        lo, hi, kids = [], [], []
        stack = [(0, len(x), -1, 0)]
        while stack:
            a, b, parent, which = stack.pop()
            node = len(lo)
            lo.append(a)
            hi.append(b)
            kids.append([-1, -1])
            if parent >= 0:
                kids[parent][which] = node
            if b - a <= LEAF:
                continue
            rows = x[self.order[a:b]]
            far = ((rows - rows.mean(axis=0)) ** 2).sum(axis=1).argmax()
            other = ((rows - rows[far]) ** 2).sum(axis=1).argmax()
            along = rows @ (rows[other] - rows[far])
            mid = (b - a) // 2
            part = np.argpartition(along, mid)
            self.order[a:b] = self.order[a:b][part]
            stack += [(a, a + mid, node, 0), (a + mid, b, node, 1)]
        self.lo, self.hi, self.kids = np.array(lo), np.array(hi), np.array(kids)
        self.x = x[self.order]
        self.centre = np.stack([self.x[a:b].mean(axis=0) for a, b in zip(lo, hi, strict=True)])
        self.most = np.array([np.abs(self.x[a:b]).max() for a, b in zip(lo, hi, strict=True)])
        self.radius = np.array([np.sqrt(((self.x[a:b] - c) ** 2).sum(axis=1).max()) for a, b, c in zip(lo, hi, self.centre, strict=True)])

    @classmethod
    def of(cls, arrays: dict[str, np.ndarray]) -> BallTree:
        """The tree whose `vars` were written."""
        tree = cls.__new__(cls)
        tree.__dict__.update(arrays)
        return tree

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Upper bound of each query's product in each node, rounded up."""
        length = np.sqrt((q * q).sum(axis=1))
        far = length[:, None] * (self.radius + np.sqrt((self.centre**2).sum(axis=1)))[None, :]
        b = q @ self.centre.T + length[:, None] * self.radius[None, :]
        # what doubles can't hold is not ruled out
        return np.maximum(np.nan_to_num(b + 1e-6 * (1 + np.abs(b)) + 1e-9 * far, nan=np.inf, posinf=np.inf), float(_LOW))

    def search(self, q: np.ndarray, bound: np.ndarray, k: int, ids: np.ndarray, own: int, at_least: int, only_first: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(vec_ids, scores) of the k best rows, not under at_least; with only_first, of the best leaf alone."""
        heap = [(-bound[0], 0)]
        best_ids, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
        largest = float(np.abs(q).max())
        kth = at_least
        while heap:
            b, node = heapq.heappop(heap)
            if -b < kth:
                break
            if self.kids[node][0] >= 0:
                for c in self.kids[node]:
                    if bound[c] >= kth:
                        heapq.heappush(heap, (-bound[c], c))
                continue
            a, e = self.lo[node], self.hi[node]
            s = products(self.x[a:e], q, float(self.most[node]) * largest * len(q))
            i = ids[self.order[a:e]]
            ok = (s >= kth) & (i != own)
            if ok.any():
                best_ids, best = np.concatenate([best_ids, i[ok]]), np.concatenate([best, s[ok]])
                if len(best) > k:
                    keep = np.lexsort((best_ids, ~best))[:k]
                    best_ids, best = best_ids[keep], best[keep]
                if len(best) == k:
                    kth = max(kth, int(best.min()))
            if only_first and len(best) >= k:
                break
        return best_ids, best


def products(x: np.ndarray, q: np.ndarray, bound: float) -> np.ndarray:
    """Exact products of whole numbers, none of which passes the bound; those beyond 64 bits are the nearest 64-bit number."""
    if bound < 2**53:
        return np.rint(x @ q).astype(np.int64)
    if bound < 2**62:
        return x.astype(np.int64) @ q.astype(np.int64)
    whole = [int(v) for v in q]
    return np.array([min(max(sum(int(v) * w for v, w in zip(row, whole, strict=True)), _LOW), _HIGH) for row in x], np.int64)


def top_k(vectors: DataFrame, is_query, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k largest integer products. vectors: vec_id, embedding."""
    # doubles from 2**52 are whole already
    floor = lambda x: F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(x)
    whole = F.transform("embedding", lambda x: floor(F.lit(float(scale)) * x.cast("double")))
    rows = usable_rows(vectors.filter(F.col("vec_id").isNotNull() & finite(F.col("embedding"))).select("vec_id", whole.alias("v")).filter(finite(F.col("v"))), k, "ball-rows")
    queries = one_each(rows.filter(is_query))
    index = indexed(rows, lambda x, ids: vars(BallTree(x)) | {"ids": ids}, "ball-trees")

    def run(arrays: dict[str, np.ndarray], right: pa.Table, first: bool):
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        q, ids = matrix(right["v"]), arrays.pop("ids")
        tree = BallTree.of(arrays)
        floors = [_LOW] * len(q) if first else [_LOW if f is None else f for f in right["at_least"].to_pylist()]
        for at in range(0, len(q), 1024):
            for b, one, own, low in zip(tree.bounds(q[at : at + 1024]), q[at : at + 1024], right["vec_id"].to_pylist()[at : at + 1024], floors[at : at + 1024], strict=True):
                i, s = tree.search(one, b, k, ids, own, low, first)
                out["query_id"] += [own] * len(i)
                out["vec_id"] += i.tolist()
                out["score"] += s.tolist()
        return pa.table({n: pa.array(v, pa.int64()) for n, v in out.items()})

    schema = "query_id long, vec_id long, score long"
    opening = ranked(searched(index, queries, lambda a, b: run(a, b, True), schema), k)
    shared = written(opening.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("at_least")), "ball-floors")
    return ranked(searched(index, queries.join(shared, "vec_id", "left"), lambda a, b: run(a, b, False), schema), k)
