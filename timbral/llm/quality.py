"""Document quality: histogram gradient-boosted trees over statistics of the text.

Trees are grown here, on at most SAMPLE labelled documents whose statistics (not
texts) come to the driver. They are flattened into arrays; workers traverse all trees for
a batch of documents at once, one numpy step per level.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timbral.llm.common import map_arrow
from timbral.llm.labelled import fold, sample

#: Labelled rows that the trees are fitted on at most, of whatever size the input is.
SAMPLE = 20_000
BINS, DEPTH, TREES, RATE, L2, LEAST = 32, 4, 60, 0.15, 2.0, 8
CUT = 0.3

STATISTICS = (
    "log words", "log bytes", "mean word", "longest word", "distinct words", "commonest word", "next to itself", "symbols", "pipes", "digits", "capitals", "marks", "high bytes",
    "lines per word", "repeated lines", "short lines", "ends in mark", "letterless words", "marked words", "repeated pairs",
)


def statistics(text: str | None) -> list[float]:
    """STATISTICS of the whole text; all zero where it has no words."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    size = len(raw)
    h = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lengths = np.fromiter(map(len, words), np.int64, n)
    counts = Counter(words)
    lines = [s for x in raw.split(b"\n") if (s := x.strip())]
    pairs = n - 1 - len(set(zip(words, words[1:], strict=False)))
    symbols = int(h[[35, 42, 36, 37, 38, 124, 60, 62]].sum())
    return [
        float(np.log1p(n)), float(np.log1p(size)), float(lengths.mean()), float(np.log1p(lengths.max())), len(counts) / n, max(counts.values()) / n,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, symbols / size, float(h[124]) / size, float(h[48:58].sum()) / size, float(h[65:91].sum()) / size,
        float(h[33:48].sum() + h[58:65].sum() + h[91:97].sum() + h[123:127].sum()) / size, float(h[128:].sum()) / size, len(lines) / n, 1 - len(set(lines)) / len(lines),
        sum(len(x) < 40 for x in lines) / len(lines), sum(w[-1:] in b".!?" for w in words) / n, sum(not w.isalpha() and not any(c > 64 for c in w) for w in counts) / len(counts),
        sum(w[-1:] in b"#*$%&|<>" for w in counts) / len(counts), pairs / n,
    ]


class Forest:
    """Flattened trees: node i of tree t splits feature[t, i] at cut[t, i] into nodes 2i + 1 and 2i + 2; leaves are at DEPTH."""

    def __init__(self, base: float, feature: np.ndarray, cut: np.ndarray, value: np.ndarray) -> None:
        self.base, self.feature, self.cut, self.value = base, feature, cut, value

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        if len(x) and len(self.feature):
            trees, rows = np.arange(len(self.feature)), np.arange(len(x))[:, None]
            node = np.zeros((len(x), len(trees)), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.cut[trees, node])
            total += self.value[trees, node - (2**DEPTH - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> Forest:
    """Logistic loss, second order, all splits by histogram. No rows, or one class alone, give a constant near the smoothed rate."""
    rate = (y.sum() + 1.0) / (len(y) + 2.0)
    base = float(np.log(rate / (1 - rate)))
    inner = 2**DEPTH - 1
    feature, cut, value = [], [], []
    if len(y) and 0 < y.sum() < len(y):
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
        total = np.full(len(y), base)
        columns = np.arange(x.shape[1])
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-total))
            g, h = p - y, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            feat, at = np.zeros(inner, np.int64), np.full(inner, np.inf)
            for level in range(DEPTH):
                for i in range(2**level - 1, 2 ** (level + 1) - 1):
                    rows = np.flatnonzero(node == i)
                    best = (1e-6, -1, -1)
                    if len(rows) >= 2 * LEAST:
                        flat = (binned[rows] + columns * BINS).ravel()
                        sums = [np.bincount(flat, np.repeat(v, x.shape[1]), x.shape[1] * BINS).reshape(-1, BINS).cumsum(axis=1) for v in (g[rows], h[rows], np.ones(len(rows)))]
                        (gl, hl, nl), (gt, ht) = sums, (g[rows].sum(), h[rows].sum())
                        gain = gl**2 / (hl + L2) + (gt - gl) ** 2 / (ht - hl + L2) - gt**2 / (ht + L2)
                        gain[(nl < LEAST) | (len(rows) - nl < LEAST)] = -1
                        f, b = np.unravel_index(int(gain.argmax()), gain.shape)
                        if gain[f, b] > best[0] and b < len(edges[f]):
                            best = (gain[f, b], int(f), int(b))
                    if best[1] >= 0:
                        feat[i], at[i] = best[1], edges[best[1]][best[2]]
                    right = x[rows, feat[i]] > at[i]
                    node[rows] = 2 * i + 1 + right
            leaf = node - inner
            v = -RATE * np.bincount(leaf, g, 2**DEPTH) / (np.bincount(leaf, h, 2**DEPTH) + L2)
            total += v[leaf]
            feature.append(feat), cut.append(at), value.append(v)
    return Forest(base, np.array(feature, np.int64).reshape(-1, inner), np.array(cut).reshape(-1, inner), np.array(value).reshape(-1, 2**DEPTH))


def _statistics_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([statistics(t) for t in b.column(2).to_pylist()], pa.list_(pa.float64()))], ["doc_id", "y", "x"])


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE) -> Forest:
    rows = map_arrow(sample(docs, labels, label, most), _statistics_batches, "doc_id long, y int, x array<double>").toArrow().sort_by("doc_id")
    x = np.array(rows.column("x").to_pylist(), float).reshape(-1, len(STATISTICS))
    return fit(x, rows.column("y").to_numpy().astype(float))


def score(docs: DataFrame, forest: Forest, cut: float = CUT) -> DataFrame:
    """docs: (doc_id, text, ...) -> (doc_id, held_out, score, predicted), one row per row.

    A null or empty text has all statistics 0 and is scored like any other. A null doc_id is not
    held out. Repeated rows stay; an empty table gives no rows; other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = forest.scores(np.array([statistics(t) for t in b.column(2).to_pylist()], float).reshape(-1, len(STATISTICS)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= cut).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return map_arrow(docs.select("doc_id", (fold() == 0).alias("held_out"), "text"), run, "doc_id long, held_out boolean, score double, predicted int")
