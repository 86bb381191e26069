"""Quality classifier: histogram gradient-boosted trees over document statistics, flattened into arrays.

Labelled rows are joined with their documents, outside the held-out fold. The trees are fitted on a bounded sample of them
(SAMPLE rows at most, smallest hash of the id first); scoring covers every row in one pass without a shuffle, by walking all
rows of a batch down the flat arrays together.

Defined results: null or empty text has the statistics of an empty text and gets a score; rows without a label are scored
like others; null labels teach nothing; without any label every score is 1; with labels of one class the trees are empty and
the score is the smoothed share of label 1. Repeated rows give repeated rows. Extra columns are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches

#: Labelled rows to learn from, at most; trees, their depth, bins a statistic, step and penalty.
SAMPLE, TREES, DEPTH, BINS, STEP, PENALTY = 20_000, 40, 4, 64, 0.25, 1.0
THRESHOLD = 0.7
STATS = ["log_chars", "log_words", "word_chars", "distinct_words", "top_word", "distinct_lines", "line_words", "bars", "bangs", "marks", "upper", "digits", "stops", "non_ascii", "mark_ends"]
_UPPER, _DIGITS, _MARKS, _STOPS, _HIGH = (bytes(x) for x in (range(65, 91), range(48, 58), b"$%#&*@^~=+_<>{}\\", b".,;:?", range(128, 256)))


def statistics(text: str | None) -> list[float]:
    t = text or ""
    raw = t.encode()
    words, lines = t.split(), t.split("\n")
    n, nw = len(raw), len(words)
    have = lambda chars: (n - len(raw.translate(None, chars))) / max(n, 1)
    counts = Counter(words)
    top = max(counts.values(), default=0)
    return [
        np.log1p(n), np.log1p(nw), (len(t) - t.count(" ")) / max(nw, 1), len(counts) / max(nw, 1), top / max(nw, 1), len(set(lines)) / len(lines), nw / len(lines),
        t.count("|") / max(nw, 1), t.count("!") / max(nw, 1), have(_MARKS), have(_UPPER), have(_DIGITS), have(_STOPS), have(_HIGH), top * len(counts) / max(nw, 1),
    ]


def matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], np.float64).reshape(len(texts), len(STATS))


class Trees:
    """Complete binary trees in flat arrays: node i has children 2i+1 and 2i+2; a node that doesn't split sends all rows left."""

    def __init__(self, base: float, feature: np.ndarray, cut: np.ndarray, value: np.ndarray) -> None:
        self.base, self.feature, self.cut, self.value = base, feature, cut, value

    def score(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            f += value[node - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-f))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Second-order boosting of the logistic loss with gradient histograms, level by level."""
    d, inner, leaves = x.shape[1], 2**DEPTH - 1, 2**DEPTH
    none = Trees(30.0, np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, leaves)))
    if not len(y):
        return none
    share = (y.sum() + 1) / (len(y) + 2)
    none.base = float(np.log(share / (1 - share)))
    if y.min() == y.max():
        return none
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(d)]
    bins = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(d)], axis=1)
    offset = bins + np.arange(d) * BINS
    f, out = np.full(len(y), none.base), ([], [], [])
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-f))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        feature, cut, node = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            at = ((node - first)[:, None] * (d * BINS) + offset).ravel()
            G, H = (np.bincount(at, np.repeat(w, d), width * d * BINS).reshape(width, d, BINS) for w in (g, h))
            gl, hl = G.cumsum(axis=2), H.cumsum(axis=2)
            gt, ht = gl[:, :1, -1:], hl[:, :1, -1:]
            gain = gl**2 / (hl + PENALTY) + (gt - gl) ** 2 / (ht - hl + PENALTY) - gt**2 / (ht + PENALTY)
            gain[(hl < 1) | (ht - hl < 1)] = 0
            for k in range(width):
                j, b = divmod(int(gain[k].argmax()), BINS)
                if gain[k, j, b] > 1e-6 and b < len(cuts[j]):
                    feature[first + k], cut[first + k] = j, cuts[j][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
        leaf = node - inner
        value = -STEP * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + PENALTY)
        f += value[leaf]
        for o, v in zip(out, (feature, cut, value), strict=True):
            o.append(v)
    return Trees(none.base, *map(np.stack, out))


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Learn from the labelled documents outside the held-out fold; the sample's ids are at most `sample`, so broadcast."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("y")).dropna().filter(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample)

    def run(batches):
        for batch in batches:
            for b in slices(batch):
                yield pa.RecordBatch.from_arrays([b.column(1), pa.array(list(matrix(b.column(0).to_pylist())), pa.list_(pa.float64())), b.column(2)], ["y", "x", "h"])

    held = small_batches(docs).select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "y", F.xxhash64("doc_id", "text").alias("h"))
    # repeated ids may match more often than there are labels: the sample's bound holds, and the same rows are taken every time
    got = held.mapInArrow(run, "y int, x array<double>, h long").orderBy("h", "y").limit(2 * sample).toArrow()
    x = got.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATS))
    order = np.lexsort((*x.T, y := got.column("y").to_numpy()))  # the rows arrive in any order
    return fit(x[order], y[order].astype(float))


def with_score(docs: DataFrame, trees: Trees, keep: bool = False) -> DataFrame:
    """doc_id, held_out, score and predicted; with keep, instead all rows of docs that aren't rejected, as they are."""

    def run(batches):
        for batch in batches:
            for b in slices(batch):
                score = trees.score(matrix(b.column("text").to_pylist()))
                if keep:
                    yield b.filter(pa.array(score >= THRESHOLD))
                else:
                    yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    if keep:
        return small_batches(docs).mapInArrow(run, docs.schema)
    return small_batches(docs).select("doc_id", "text", held_out().alias("held_out")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
