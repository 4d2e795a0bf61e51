"""Approximate nearest neighbours: a robust-pruned directed graph in each shard.

Vectors enter the graph in batches of doubling size. A greedy beam search from the medoid proposes
the newcomers' neighbours; relaxed pruning goes through these by distance and keeps one unless an
already kept one is nearer to it by the factor alpha, so edges stay diverse; back edges are added
and pruned likewise; a node that pruning leaves out of reach gets an edge from its nearest one.
Queries run a beam search in every shard, and the shards' best are merged.
All vectors of a batch advance together as arrays.

Largest inner products become smallest distances by one more coordinate, which gives all of a
shard's vectors the same length. Equal vectors of a shard are one node with many ids.

How wide a beam must be depends on the data, so each shard is asked for the neighbours of some of its
own vectors (ASKED of them, with exact answers by product), and its beam doubles until they are found
to RECALL; at its widest it holds every node. Only this width comes from a sample: every row is in a
graph. On 20,000 Gaussian vectors of 64 dimensions, the hardest case, that is a beam of 1,024.

Edge cases: vectors that are null, empty, zero or hold null, NaN or infinite components take no
part; rows with the query's own vec_id are no candidates for it; of query rows that share a vec_id the
least vector asks, once; every row is a candidate, also where rows share a vec_id; scores are summed in
a fixed order, so equal vectors score alike in all shards; vectors of different sizes do not meet; a
null vec_id takes no part; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.vectors import finite, indexed, matrix, one_each, ranked, searched, usable_rows

DEGREE, BEAM, ALPHA, BATCH = 48, 96, 1.05, 256
#: Nodes that a search expands at once.
WIDE = 4
#: Own vectors that a shard's beam is fitted on, and the share of their neighbours to be found.
ASKED, RECALL = 128, 0.95


class Graph:
    """A directed graph over the rows of x (float32); -1 pads the rows of `edges`."""

    def __init__(self, x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA):
        self.x, self.degree, self.beam, self.alpha = x, degree, beam, alpha
        self.norm = (x * x).sum(axis=1)
        n = len(x)
        self.edges = np.full((n, degree), -1, np.int32)
        self.start = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())
        order = np.random.default_rng(13).permutation(n)
        order = np.concatenate([[self.start], order[order != self.start]])
        done, size = 1, 1
        while done < n:
            self._insert(order[done : done + size])
            done += size
            size = min(size * 2, BATCH)
        self._connect()

    def search(self, q: np.ndarray, beam: int, visited: bool = False) -> np.ndarray:
        """Nearest nodes found, nearest first (-1 pads); or all nodes that were expanded."""
        b, width = len(q), min(WIDE, beam)
        seen = np.zeros((b, len(self.x)), bool)
        ids = np.full((b, beam), -1, np.int32)
        dist = np.full((b, beam), np.inf, np.float32)  # less the query's own square, which is the same for all nodes
        open_ = np.zeros((b, beam), bool)
        ids[:, 0], open_[:, 0], seen[:, self.start] = self.start, True, True
        dist[:, 0] = self.norm[self.start] - 2 * (q @ self.x[self.start])
        rows, taken = np.arange(b), []
        while len(rows := rows[open_[rows].any(axis=1)]):
            r = np.arange(len(rows))[:, None]
            waiting = np.where(open_[rows], dist[rows], np.inf)
            pick = np.argpartition(waiting, width - 1, axis=1)[:, :width]
            node = np.where(np.isfinite(waiting[r, pick]), ids[rows[:, None], pick], -1)
            open_[rows[:, None], pick] = False
            if visited:
                taken.append(np.full((b, width), -1, np.int32))
                taken[-1][rows] = node
            near = np.where(node[:, :, None] < 0, -1, self.edges[np.maximum(node, 0)]).reshape(len(rows), -1)
            near = np.sort(near, axis=1)
            known = (near < 0) | seen[rows[:, None], near]
            known[:, 1:] |= near[:, 1:] == near[:, :-1]
            of, at = np.nonzero(~known)
            new = near[of, at]
            seen[rows[of], new] = True
            d = np.full(near.shape, np.inf, np.float32)
            d[of, at] = self.norm[new] - 2 * np.einsum("nd,nd->n", q[rows[of]], self.x[new])
            all_ids, all_dist, all_open = np.concatenate([ids[rows], near], axis=1), np.concatenate([dist[rows], d], axis=1), np.concatenate([open_[rows], ~known], axis=1)
            keep = np.argpartition(all_dist, beam - 1, axis=1)[:, :beam]
            ids[rows], dist[rows], open_[rows] = all_ids[r, keep], all_dist[r, keep], all_open[r, keep]
        if visited:
            return np.concatenate(taken, axis=1)
        ids[~np.isfinite(dist)] = -1
        return np.take_along_axis(ids, np.argsort(dist, axis=1, kind="stable"), axis=1)

    def prune(self, nodes: np.ndarray, cand: np.ndarray) -> np.ndarray:
        """The kept neighbours of each node among its candidates (rows of ids; -1 pads)."""
        cand = np.where(cand == nodes[:, None], -1, cand)
        cand = np.sort(cand, axis=1)[:, ::-1]
        cand[:, 1:] = np.where(cand[:, 1:] == cand[:, :-1], -1, cand[:, 1:])
        safe = np.where(cand < 0, 0, cand)
        v = self.x[safe]
        d = self.norm[nodes][:, None] - 2 * np.einsum("bd,bcd->bc", self.x[nodes], v) + self.norm[safe]
        d[cand < 0] = np.inf
        width = min(cand.shape[1], 3 * self.degree)
        by = np.argsort(d, axis=1, kind="stable")[:, :width]
        r = np.arange(len(nodes))
        cand, d, v = cand[r[:, None], by], np.maximum(d[r[:, None], by], 0), v[r[:, None], by]
        norm = self.norm[np.where(cand < 0, 0, cand)]
        between = np.maximum(norm[:, :, None] + norm[:, None, :] - 2 * (v @ v.transpose(0, 2, 1)), 0)
        left = cand >= 0
        out = np.full((len(nodes), self.degree), -1, np.int32)
        factor = self.alpha**2  # distances are squared
        for slot in range(self.degree):
            some = left.any(axis=1)
            if not some.any():
                break
            pick = left.argmax(axis=1)
            out[some, slot] = cand[r, pick][some]
            left &= factor * between[r, pick] > d
            left[r, pick] = False
        return out

    def reached(self) -> np.ndarray:
        """Which nodes a walk from the start can reach."""
        seen = np.zeros(len(self.x), bool)
        seen[self.start] = True
        edge = np.array([self.start])
        while len(edge):
            near = np.unique(self.edges[edge])
            edge = near[(near >= 0) & ~seen[near]]
            seen[edge] = True
        return seen

    def _connect(self, most: int = 8) -> None:
        """Links every node that pruning has cut off from its nearest reachable node, beyond the degree."""
        while len(lost := np.flatnonzero(~self.reached())):
            host = np.concatenate([self.search(self.x[lost[i : i + BATCH]], self.beam)[:, 0] for i in range(0, len(lost), BATCH)])
            order = np.argsort(host, kind="stable")
            host, lost = host[order], lost[order]
            nth = np.arange(len(host)) - np.searchsorted(host, host)
            some = nth < most
            extra = np.full((len(self.x), int(nth[some].max()) + 1), -1, np.int32)
            extra[host[some], nth[some]] = lost[some]
            self.edges = np.concatenate([self.edges, extra], axis=1)

    def _insert(self, new: np.ndarray) -> None:
        cand = self.search(self.x[new], self.beam, visited=True)
        beside = np.broadcast_to(new, (len(new), len(new)))[:, : self.degree] if len(new) <= self.degree else None
        self.edges[new] = self.prune(new, cand if beside is None else np.concatenate([cand, beside], axis=1))
        src, at = np.nonzero(self.edges[new] >= 0)
        to, frm = self.edges[new][src, at], new[src]
        order = np.argsort(to, kind="stable")
        to, frm = to[order], frm[order]
        nodes, first, count = np.unique(to, return_index=True, return_counts=True)
        nth = np.arange(len(to)) - np.repeat(first, count)
        for lo in range(0, len(nodes), BATCH):
            some = nodes[lo : lo + BATCH]
            a, e = first[lo], first[lo] + count[lo : lo + BATCH].sum()
            extra = np.full((len(some), count[lo : lo + BATCH].max()), -1, np.int32)
            extra[np.searchsorted(some, to[a:e]), nth[a:e]] = frm[a:e]
            both = np.sort(np.concatenate([self.edges[some], extra], axis=1), axis=1)[:, ::-1]
            both[:, 1:] = np.where(both[:, 1:] == both[:, :-1], -1, both[:, 1:])  # newcomers may have chosen each other
            full = (both >= 0).sum(axis=1) > self.degree
            kept = np.sort(both, axis=1)[:, ::-1][:, : self.degree]
            if full.any():
                kept[full] = self.prune(some[full], both[full])
            self.edges[some] = kept


def build(x: np.ndarray, ids: np.ndarray, k: int, recall: float = RECALL) -> dict[str, np.ndarray]:
    """A shard's index: distinct vectors, the ids of each, their graph, and the beam that finds the k nearest."""
    sort = np.argsort(ids, kind="stable")
    x, ids = x[sort], ids[sort]
    distinct, node = np.unique(x, axis=0, return_inverse=True)
    by = np.argsort(node.ravel(), kind="stable")
    begin = np.searchsorted(node.ravel()[by], np.arange(len(distinct) + 1))
    length = (distinct**2).sum(axis=1)
    more = np.sqrt(np.maximum(length.max() - length, 0))
    graph = Graph(np.concatenate([distinct, more[:, None]], axis=1).astype(np.float32))
    asked = np.random.default_rng(17).permutation(len(distinct))[:ASKED]
    true = np.argpartition(-(distinct[asked] @ distinct.T), min(k, len(distinct) - 1), axis=1)[:, : k + 1]
    beam = min(max(64, 2 * k), len(distinct))
    while beam < len(distinct):
        found = graph.search(_asking(distinct[asked]), beam)[:, : k + 1]
        if np.mean([len(np.intersect1d(t, f)) / len(t) for t, f in zip(true, found, strict=True)]) >= recall:
            break
        beam = min(2 * beam, len(distinct))
    return {"x": distinct, "graph": graph.x, "edges": graph.edges, "start": np.array(graph.start), "beam": np.array(beam), "ids": ids[by], "begin": begin}


def _asking(q: np.ndarray) -> np.ndarray:
    return np.concatenate([q, np.zeros((len(q), 1))], axis=1).astype(np.float32)


def search_shard(index: dict[str, np.ndarray], q: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, vec_ids, exact products) of the k best found for each query."""
    graph, x, ids, begin = Graph.__new__(Graph), index["x"], index["ids"], index["begin"]
    graph.x, graph.edges, graph.start = index["graph"], index["edges"], int(index["start"])
    graph.norm = (graph.x * graph.x).sum(axis=1)
    out_q, out_id, out_s = [], [], []
    for at in range(0, len(q), BATCH):
        part = q[at : at + BATCH]
        for row, one, me in zip(graph.search(_asking(part), int(index["beam"])), part, own[at : at + BATCH], strict=True):
            nodes = row[row >= 0]
            score = (x[nodes] * one).sum(axis=1)
            # of equal vectors only the smallest ids can be among the k best
            got = [np.arange(begin[n], min(begin[n + 1], begin[n] + k + 1)) for n in nodes]
            i, s = ids[np.concatenate(got)], np.repeat(score, [len(g) for g in got])
            s, i = s[i != me], i[i != me]
            best = np.lexsort((i, -s))[:k]
            out_q.append(np.full(len(best), me))
            out_id.append(i[best])
            out_s.append(s[best])
    return np.concatenate(out_q), np.concatenate(out_id), np.concatenate(out_s)


def nearest(vectors: DataFrame, is_query, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest found by largest inner product. vectors: vec_id, embedding."""
    usable = F.col("vec_id").isNotNull() & finite(F.col("embedding")) & F.exists("embedding", lambda x: x != 0)
    rows = usable_rows(vectors.filter(usable).select("vec_id", F.col("embedding").cast("array<double>").alias("v")), k, "graph-rows")
    index = indexed(rows, lambda x, ids: build(x, ids, k), "graphs")

    def run(arrays: dict[str, np.ndarray], right: pa.Table):
        q, i, s = search_shard(arrays, matrix(right["v"]), right["vec_id"].to_numpy(), k)
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(i, pa.int64()), "score": pa.array(s, pa.float64())})

    return ranked(searched(index, one_each(rows.filter(is_query)), run, "query_id long, vec_id long, score double"), k)
