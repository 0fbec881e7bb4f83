"""Quality classifier: histogram gradient-boosted trees over statistics of a document, flattened for traversal by numpy."""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.llm._util import bounded_sample, prepare

#: At most about so many labelled rows fit the trees.
SAMPLE_ROWS = 20_000
TREES, DEPTH, BINS, RATE, LEAST, L2 = 60, 4, 64, 0.15, 10, 1.0
BLOCK = 1 << 20


def statistics(text: str | None) -> np.ndarray:
    """Lengths, shares of kinds of characters, repetition of words, pairs and lines, and evenness of the letters. An empty or null text has zeros."""
    text = text or ""
    hist = np.zeros(129)
    for i in range(0, len(text), BLOCK):
        hist += np.bincount(np.minimum(np.frombuffer(text[i : i + BLOCK].encode("utf-32-le", "replace"), "<u4"), 128).astype(np.int64), minlength=129)
    n = max(1.0, hist.sum())
    words = text.split()
    k = max(1, len(words))
    lines = [x for x in text.split("\n") if x]
    counts = Counter(words)
    p = hist[hist > 0] / n
    upper, lower, digit = hist[65:91].sum(), hist[97:123].sum(), hist[48:58].sum()
    blank = hist[32] + hist[9:14].sum()
    marks = hist[:128].sum() - upper - lower - digit - blank
    stops = hist[[33, 46, 63]].sum()
    usual = hist[[33, 44, 45, 46, 63, 39, 34, 58, 59]].sum()
    last = np.array([not w[-1].isalnum() for w in words], bool)
    return np.array([
        np.log1p(len(text)), np.log1p(len(words)), np.log1p(len(lines)), len(words) / max(1, len(lines)), (n - blank) / k, max(map(len, counts), default=0),
        upper / n, lower / n, digit / n, blank / n, marks / n, hist[128] / n, stops / k, usual / n, (marks - usual) / n, hist[124] / k, hist[33] / k,
        len(counts) / k, max(counts.values(), default=0) / k, len(set(zip(words, words[1:], strict=False))) / max(1, k - 1), len(set(lines)) / max(1, len(lines)), sum(v == 1 for v in counts.values()) / k,
        float(-(p * np.log2(p)).sum()), float(last.mean()) if len(last) else 0.0, sum(w.isupper() for w in counts) / max(1, len(counts)), hist[10] / n,
    ])


COUNT = len(statistics("a b"))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> dict:
    """Boosting of the logistic loss. A column's values go to at most BINS bins by its quantiles; each level sums gradients by node and bin for all columns at once."""
    rate = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    base = np.log(rate / (1 - rate))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1) if len(x) else np.zeros((0, x.shape[1]), int)
    score = np.full(len(y), base)
    size = (1 << (depth + 1)) - 1
    column, cut_at, value = np.full((trees, size), -1, np.int32), np.zeros((trees, size)), np.zeros((trees, size))
    for t in range(trees if len(y) and 0 < y.mean() < 1 else 0):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            live = node >= first
            best = np.full(width, 1e-6)
            where = np.full((width, 2), -1)
            for j in range(x.shape[1]):
                key = (node[live] - first) * BINS + binned[live, j]
                gs, hs, ns = (np.bincount(key, q, width * BINS).reshape(width, BINS).cumsum(1) for q in (g[live], h[live], np.ones(int(live.sum()))))
                gt, ht, nt = gs[:, -1:], hs[:, -1:], ns[:, -1:]
                gain = gs**2 / (hs + L2) + (gt - gs) ** 2 / (ht - hs + L2) - gt**2 / (ht + L2)
                gain[(ns < LEAST) | (nt - ns < LEAST)] = 0
                gain[:, len(edges[j]) :] = 0
                k = gain.argmax(1)
                better = gain[np.arange(width), k] > best
                best = np.where(better, gain[np.arange(width), k], best)
                where[better] = np.stack([np.full(width, j), k], 1)[better]
            for w in range(width):
                if where[w, 0] >= 0:
                    j, k = where[w]
                    column[t, first + w], cut_at[t, first + w] = j, edges[j][k]
                    mine = node == first + w
                    node[mine] = 2 * (first + w) + 1 + (binned[mine, j] > k)
        gs, hs = np.bincount(node, g, size), np.bincount(node, h, size)
        value[t] = -RATE * gs / (hs + L2)
        score += value[t][node]
    return {"base": base, "column": column, "cut": cut_at, "value": value, "depth": depth}


def score_trees(model: dict, x: np.ndarray) -> np.ndarray:
    """Probabilities: all rows go down one tree at a time, a level a step."""
    s = np.full(len(x), model["base"])
    row = np.arange(len(x))
    for column, cut_at, value in zip(model["column"], model["cut"], model["value"], strict=True):
        node = np.zeros(len(x), np.int64)
        for _ in range(model["depth"]):
            c = column[node]
            inner = c >= 0
            node = np.where(inner, 2 * node + 1 + (x[row, np.maximum(c, 0)] > cut_at[node]), node)
        s += value[node]
    return 1 / (1 + np.exp(-s))


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, learn: Column, sample_rows: int = SAMPLE_ROWS) -> dict:
    """Trees from documents that have a 0/1 label and satisfy `learn` (a condition on the column id_col); with none of them, or one kind only, all scores are the share of label 1 (0.5 without labels)."""
    import pyarrow as pa

    prepare(docs.sparkSession)
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).where(learn).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col)).cast("int").alias("label"))
    marked = bounded_sample(marked, F.col("id"), sample_rows)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(marked), "id")  # marked: at most 2 x sample_rows

    def run(batches):
        for b in batches:
            x = np.array([statistics(t) for t in b.column(1).to_pylist()], "<f8").reshape(-1, COUNT)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "label", "x"])

    got = sorted(rows.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, label int, x binary").collect(), key=lambda r: (r["id"], r["label"], bytes(r["x"])))
    x = np.array([np.frombuffer(bytes(r["x"]), "<f8") for r in got]).reshape(-1, COUNT)
    return fit_trees(x, np.array([r["label"] for r in got], float))




def score(df: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: <id_col> and score (0 to 1), from the whole text alone. Null and empty texts are scored as texts without words."""
    import pyarrow as pa

    prepare(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            x = np.array([statistics(t) for t in b.column(1).to_pylist()]).reshape(-1, COUNT)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score_trees(model, x), pa.float64())], names=["id", "score"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)
