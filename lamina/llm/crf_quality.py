"""Document quality from a linear-chain conditional random field over lines.

Every line gets features of its own bytes and of the lines beside it; the field labels lines good or
bad, forward-backward gives each line's marginal, and the mean of the marginals weighted by line
length, calibrated on the training documents, is the document's score.

Training takes whole documents from a sample of labelled ones, in the order of a hash of their doc_id:
at most `most_docs` of them, and as many as have at most `most_lines` lines together (a bound of the fit
alone; every document is scored, on its whole text). A bad document's lines count as bad unless a line
classifier fitted first finds them good, since junk often stands among ordinary lines.

Edge cases: null, empty and blank texts have no line and get the score of one line without
features; blank lines have no weight; a very long text is scored whole, with its lines in one task;
repeated rows get equal scores; of rows that share a labelled doc_id the least text is fitted, and the
least of several labels; unlabelled documents, null labels and labels other than 0 and 1 are left out of
the fit; with labels of one kind only, the score is that label's share; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm._common import by_size, small_batches

#: Documents, and lines in all of them, that the fit takes at most.
MOST_DOCS, MOST_LINES = 3000, 200_000
THRESHOLD = 0.7

_KINDS = 6


def _kinds() -> np.ndarray:
    k = np.full(256, 5, np.uint8)  # other marks and controls
    k[ord("a") : ord("z") + 1] = 0
    k[ord("A") : ord("Z") + 1] = 1
    k[ord("0") : ord("9") + 1] = 2
    k[128:] = 3
    for c in ".,;:?'\"()-\u0000":
        k[ord(c)] = 4
    k[[32, *range(9, 14)]] = 6
    return k


_KIND = _kinds()
#: Own features of a line: shares of the kinds of bytes, of marks that repeat the byte before, of words that end in other marks, of blanks, of words equal to the word before, of words that stood earlier in the line; each also saturated; lengths; whether an equal line stands in the document.
WIDTH = 2 * (_KINDS + 5) + 4


@dataclass
class Lines:
    """Features of the lines of some documents: x (lines, features), weight (bytes), begin (first line of each document, and the end)."""

    x: np.ndarray
    weight: np.ndarray
    begin: np.ndarray


def line_features(texts: list[str]) -> Lines:
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(r + b"\n" for r in raw), np.uint8)
    doc_end = np.cumsum([len(r) + 1 for r in raw])
    kind = _KIND[data]
    end = np.flatnonzero(data == 10)
    start = np.concatenate([[0], end[:-1] + 1])
    blank = kind == 6
    word_end = np.zeros(len(data), bool)
    word_end[:-1] = ~blank[:-1] & blank[1:]
    same = np.zeros(len(data), bool)
    same[1:] = (data[1:] == data[:-1]) & (kind[1:] >= 4) & (kind[1:] < 6)

    def count(flags: np.ndarray) -> np.ndarray:
        c = np.zeros(len(flags) + 1, np.int32)
        np.cumsum(flags, out=c[1:])
        return (c[end] - c[start]).astype(np.float64)

    size = (end - start).astype(np.float64)
    counts = [count(kind == k) for k in range(_KINDS)]
    words, spaces = count(word_end), count(blank)
    marked, again = count(word_end & (kind == 5)), count(same)
    solid = np.maximum(size - spaces, 1)
    from lamina.llm.suffix_dedup import Names

    names = Names(data)
    last = np.flatnonzero(word_end) + 1
    first = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    word = names.at(first, last)
    line = np.searchsorted(end, first, side="right")
    twice = np.zeros(len(word), bool)
    twice[1:] = (word[1:] == word[:-1]) & (line[1:] == line[:-1])
    key = word ^ (line.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    seen = np.ones(len(word), bool)
    seen[np.unique(key, return_index=True)[1]] = False
    shares = np.stack([*(c / solid for c in counts), again / solid, marked / np.maximum(words, 1), spaces / np.maximum(size, 1), np.bincount(line, twice, len(end)) / np.maximum(words, 1), np.bincount(line, seen, len(end)) / np.maximum(words, 1)], 1)
    name = names.at(start, end)
    doc = np.searchsorted(doc_end, start, side="right")
    full = size > spaces
    key = name ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, inverse, times = np.unique(key, return_inverse=True, return_counts=True)
    repeated = (times[inverse] > 1) & (size > 20)
    own = np.concatenate([shares, np.minimum(1, 8 * shares), np.stack([np.log1p(size) / 5, np.log1p(words) / 4, np.minimum(solid / np.maximum(words, 1), 30) / 10, repeated], 1)], 1)
    own, weight, doc = own[full], size[full], doc[full]
    # a document without a line gets one without features
    none = np.setdiff1d(np.arange(len(texts)), doc)
    if len(none):
        at = np.searchsorted(doc, none)
        own, weight, doc = np.insert(own, at, 0, axis=0), np.insert(weight, at, 1.0), np.insert(doc, at, none)
    begin = np.searchsorted(doc, np.arange(len(texts) + 1))
    first, last = np.zeros(len(doc), bool), np.zeros(len(doc), bool)
    first[begin[:-1]], last[begin[1:] - 1] = True, True
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[first], after[last] = 0, 0
    return Lines(np.concatenate([own, before[:, 4:9], after[:, 4:9], first[:, None], last[:, None], np.ones((len(own), 1))], 1), weight, begin)


@dataclass
class Field:
    """w: weight of each feature for a good line (a bad line has 0); t: score of each pair of neighbours."""

    w: np.ndarray
    t: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    a: float = 1.0
    b: float = 0.0
    constant: float | None = None

    def unary(self, x: np.ndarray) -> np.ndarray:
        z = np.zeros((len(x), 2))
        z[:, 1] = np.clip(((x - self.mean) / self.scale) @ self.w, -30, 30)
        return z


def forward_backward(unary: np.ndarray, t: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals (lines, 2) and the sum of the pair marginals (2, 2); all documents advance together."""
    e, m = np.exp(unary - unary.max(axis=1, keepdims=True)), np.exp(t)
    length = np.diff(begin)
    order = np.argsort(-length, kind="stable")
    at, length = begin[:-1][order], length[order]
    active = np.searchsorted(-length, -np.arange(1, length[0] + 1 if len(length) else 1), side="right")
    alpha, beta = np.empty_like(e), np.ones_like(e)
    alpha[at] = e[at] / e[at].sum(axis=1, keepdims=True)
    for s in range(1, len(active)):
        i = at[: active[s]] + s
        x = (alpha[i - 1] @ m) * e[i]
        alpha[i] = x / x.sum(axis=1, keepdims=True)
    pairs = np.zeros((2, 2))
    for s in range(len(active) - 1, 0, -1):
        i = at[: active[s]] + s
        y = e[i] * beta[i]
        p = alpha[i - 1][:, :, None] * m[None] * y[:, None, :]
        pairs += (p / p.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        x = y @ m.T
        beta[i - 1] = x / x.sum(axis=1, keepdims=True)
    marginal = alpha * beta
    return marginal / marginal.sum(axis=1, keepdims=True), pairs


def _adam(grad, x: np.ndarray, steps: int, rate: float) -> np.ndarray:
    m, v = np.zeros_like(x), np.zeros_like(x)
    for k in range(1, steps + 1):
        g = grad(x)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return x


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(lines: Lines, labels: np.ndarray, ridge: float = 1e-3) -> Field:
    """A field from documents with labels 0 and 1."""
    n, width = lines.x.shape
    length = np.diff(lines.begin)
    mean, scale = lines.x.mean(axis=0), lines.x.std(axis=0)
    scale[scale < 1e-6] = 1.0
    mean[-1] = 0.0
    field = Field(np.zeros(width), np.zeros((2, 2)), mean, scale)
    if len(set(labels.tolist())) < 2:
        field.constant = float(labels.mean()) if len(labels) else 0.5
        return field
    x = (lines.x - mean) / scale
    doc = np.repeat(np.arange(len(labels)), length)
    y = labels[doc].astype(float)
    # each document counts once, and both kinds of documents count alike
    share = np.array([0.5 / max(1, (labels == k).sum()) for k in (0, 1)])[labels]
    weight = share[doc] / length[doc]
    w = _adam(lambda w: x.T @ (weight * (_sigmoid(x @ w) - y)) + ridge * w, np.zeros(width), 200, 0.08)
    p = _sigmoid(x @ w)
    worst = np.minimum.reduceat(p, lines.begin[:-1])
    y = np.where((y == 0) & (p > 0.5) & (p > worst[doc]), 1.0, y)
    bad = 1 - y.astype(int)
    inner = np.ones(n, bool)
    inner[lines.begin[:-1]] = False
    i = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (1 - bad[i - 1], 1 - bad[i]), 1.0)

    def grad(theta: np.ndarray) -> np.ndarray:
        t = theta[width:].reshape(2, 2)
        u = np.zeros((n, 2))
        u[:, 1] = np.clip(x @ theta[:width], -30, 30)
        marginal, pairs = forward_backward(u, t, lines.begin)
        return np.concatenate([x.T @ (marginal[:, 1] - y) / n + ridge * theta[:width], ((pairs - seen) / n + 0.01 * t).ravel()])

    theta = _adam(grad, np.concatenate([w, np.zeros(4)]), 80, 0.05)
    field.w, field.t = theta[:width], theta[width:].reshape(2, 2)
    q = document_quality(field, lines)
    z = np.stack([_spread(q), np.ones(len(q))], 1)
    a, b = _adam(lambda v: z.T @ (_sigmoid(z @ v) - labels) / len(labels) + 1e-4 * v, np.array([1.0, 0.0]), 400, 0.05)
    field.a, field.b = float(a), float(b)
    return field


def _spread(q: np.ndarray) -> np.ndarray:
    q = np.clip(q, 1e-4, 1 - 1e-4)
    return np.log(q / (1 - q))


def document_quality(field: Field, lines: Lines) -> np.ndarray:
    """Mean of the marginals of `good`, weighted by line length."""
    marginal, _ = forward_backward(field.unary(lines.x), field.t, lines.begin)
    return np.add.reduceat(marginal[:, 1] * lines.weight, lines.begin[:-1]) / np.add.reduceat(lines.weight, lines.begin[:-1])


def score(field: Field, texts: list[str]) -> np.ndarray:
    if field.constant is not None:
        return np.full(len(texts), field.constant)
    return _sigmoid(field.a * _spread(document_quality(field, line_features(texts))) + field.b)


def held_out(doc_id):
    """Whether a document's labels are kept from the fit."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most_docs: int = MOST_DOCS, most_lines: int = MOST_LINES) -> Field:
    """A field from a bounded sample of the labelled documents that are not held out."""
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = usable.orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(most_docs)

    def run(batches):
        for b in batches:
            keys, texts, kinds = (b.column(k).to_pylist() for k in range(3))
            for lo, hi in by_size(texts, 1 << 18):
                lines = line_features(texts[lo:hi])
                out = [(k, q, lines.x[s:e], lines.weight[s:e]) for k, q, s, e in zip(keys[lo:hi], kinds[lo:hi], lines.begin, lines.begin[1:], strict=False)]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([o[0] for o in out], pa.int64()), "quality": pa.array([o[1] for o in out], pa.int32()), "x": pa.array([o[2].astype("<f4").tobytes() for o in out], pa.binary()), "weight": pa.array([o[3].astype("<f4").tobytes() for o in out], pa.binary())})

    # the sample has most_docs rows at most, so it can be broadcast, and its running count can stand in one task
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    rows = rows.groupBy("doc_id", "quality").agg(F.min("text").alias("text")).select("doc_id", "text", F.col("quality").cast("int").alias("quality"), F.size(F.split("text", "\n", -1)).alias("lines"))
    upto = Window.orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id")
    fitted = rows.select("doc_id", F.sum("lines").over(upto).alias("upto")).filter(F.col("upto") <= most_lines).select("doc_id")
    rows = rows.join(F.broadcast(fitted), "doc_id").select("doc_id", "text", "quality")
    got = sorted(rows.mapInArrow(run, "doc_id long, quality int, x binary, weight binary").collect(), key=lambda r: (r["doc_id"], bytes(r["x"])))
    width = line_features([""]).x.shape[1]
    x = [np.frombuffer(r["x"], "<f4").reshape(-1, width).astype(np.float64) for r in got]
    lines = Lines(np.concatenate(x) if x else np.zeros((0, width)), np.concatenate([np.frombuffer(r["weight"], "<f4") for r in got]).astype(np.float64) if got else np.zeros(0), np.concatenate([[0], np.cumsum([len(a) for a in x])]).astype(np.int64))
    return fit(lines, np.array([r["quality"] for r in got], np.int64)) if got else Field(np.zeros(width), np.zeros((2, 2)), np.zeros(width), np.ones(width), constant=0.5)


def with_score(docs: DataFrame, field: Field, columns: list[str], out: str = "score") -> DataFrame:
    """The columns of each document, and its score; text goes no further than the scoring task."""

    @F.pandas_udf("double")
    def scores(text: pd.Series) -> pd.Series:
        texts = text.tolist()
        parts = [score(field, texts[lo:hi]) for lo, hi in by_size(texts, 1 << 18)]
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    small_batches(docs.sparkSession)
    return docs.select(*columns, scores(F.coalesce("text", F.lit(""))).alias(out))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    rows = with_score(docs, train(docs, labels), ["doc_id"])
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score reaches the threshold, with their own columns."""
    return with_score(docs, train(docs, labels), docs.columns, "_lamina_score").filter(F.col("_lamina_score") >= THRESHOLD).select(*docs.columns)
