"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

The weights are learned by follow-the-regularised-leader with elastic-net penalties, one coordinate at a time, and their
scores are calibrated by one temperature. Document frequencies are counted over all rows to learn from; the weights are
fitted on a sample of them that is bounded for each label (`sample_rows`); the classes are all labels that occur."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.llm._util import packed_counts, prepare, summed_counts

#: Hashed n-grams of 1 to ORDERS characters; the number of features is a power of two and bounds what is broadcast.
FEATURES, ORDERS = 1 << 15, 3
#: At most about so many rows fit the weights.
SAMPLE_ROWS = 3000
#: So many rows of a language are learned from, if it has them, however small its share is.
LABEL_ROWS = 64
#: Characters of which the n-grams are counted at once.
BLOCK = 1 << 20
_FACTORS = np.array([2654435761, 2246822519, 3266489917], np.uint64)


def grams(text: str) -> np.ndarray:
    """Counts of the hashed n-grams of the letters of a text; everything that is no letter is one blank. All zero if it has no letters."""
    out = np.zeros(FEATURES, np.int64)
    for i in range(0, len(text), BLOCK):
        part = text[max(0, i - ORDERS + 1) : i + BLOCK].lower()
        c = np.frombuffer(part.encode("utf-32-le", "replace"), "<u4")
        letter = _is_letter(c, part)
        if not letter.any():
            continue
        c = np.where(letter, c, 32).astype(np.uint64)
        keep = letter | np.concatenate([[True], letter[:-1]])
        c = c[keep]
        h = np.zeros(len(c), np.uint64)
        for n in range(ORDERS):
            h = (h[: len(c) - n] * np.uint64(31) + c[n:]) if n else c.copy()
            if not len(h):
                break
            x = h * _FACTORS[n]
            out += np.bincount(((x ^ (x >> np.uint64(17))) & np.uint64(FEATURES - 1)).astype(np.int64), minlength=FEATURES)
    return out


def _letter_table() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x3000)])


_TABLE = _letter_table()


def _is_letter(c: np.ndarray, part: str) -> np.ndarray:
    if part.isascii() or not len(c) or int(c.max()) < len(_TABLE):
        return _TABLE[c]
    return np.array([x.isalpha() for x in part], bool)


def weighted(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices and TF-IDF values of length 1; frequencies are damped by a logarithm."""
    at = np.flatnonzero(counts)
    v = (1 + np.log(counts[at])) * idf[at]
    return at, v / max(float(np.sqrt(v @ v)), 1e-12)


def fit_ftrl(rows: list, y: np.ndarray, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.002, l2: float = 0.01, epochs: int = 3, seed: int = 7) -> np.ndarray:
    """Weights (FEATURES, classes), most of them exactly zero. The regularised leader's closed form gives each weight from its sums z and n."""
    z, n = np.zeros((FEATURES, classes)), np.zeros((FEATURES, classes))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, v = rows[i]
            za, na = z[at], n[at]
            w = leader(za, na, alpha, beta, l1, l2)
            p = softmax(v @ w)
            p[y[i]] -= 1
            g = v[:, None] * p
            z[at] = za + g - (np.sqrt(na + g * g) - np.sqrt(na)) / alpha * w
            n[at] = na + g * g
    return leader(z, n, alpha, beta, l1, l2)


def leader(z, n, alpha, beta, l1, l2):
    return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit_temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """The divisor of scores that makes the held-back rows likeliest, by golden-section search on its logarithm."""
    if not len(y):
        return 1.0

    def loss(t):
        return -np.log(np.maximum(softmax(scores / np.exp(t))[np.arange(len(y)), y], 1e-12)).mean()

    a, b = np.log(0.02), np.log(20.0)
    for _ in range(40):
        c, d = b - 0.618 * (b - a), a + 0.618 * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def train(df: DataFrame, text_col: str, label_col: str, key: Column, sample_rows: int = SAMPLE_ROWS) -> dict:
    """Learns from rows with a text and a label. With no such rows there are no classes."""
    import pyarrow as pa

    prepare(df.sparkSession)
    rows = df.where(F.col(text_col).isNotNull() & F.col(label_col).isNotNull()).select(key.cast("string").alias("key"), F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("label"))

    def frequencies(batches):
        total = np.zeros(FEATURES, np.int64)
        for b in batches:
            for t in b.column(1).to_pylist():
                total += grams(t) > 0
        at, counts = packed_counts(total)
        if at:
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts, pa.binary())], names=["chunk", "counts"])

    def counted(batches):
        for b in batches:
            got = []
            for t in b.column(1).to_pylist():
                c = grams(t)
                at = np.flatnonzero(c)
                got.append(np.stack([at, c[at]]).astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(2), pa.array(got, pa.binary())], names=["label", "grams"])

    rows = rows.withColumn("hash", F.xxhash64("key"))
    found = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("hash").alias("least")).collect()
    n = sum(r["n"] for r in found)
    if not n:
        return {"classes": [], "idf": np.zeros(FEATURES), "w": np.zeros((FEATURES, 0)), "t": 1.0}
    df_ = summed_counts(rows.mapInArrow(frequencies, "chunk long, counts binary"), FEATURES)
    idf = np.log((1 + n) / (1 + df_)) + 1
    sample = sorted(label_sample(rows, found, sample_rows).select("key", "text", "label").mapInArrow(counted, "label string, grams binary").collect(), key=lambda r: (r["label"], bytes(r["grams"])))
    classes = sorted({r["label"] for r in found})
    y = np.array([classes.index(r["label"]) for r in sample], np.int64)
    vectors = [weighted(_dense(bytes(r["grams"])), idf) for r in sample]
    place = np.arange(len(sample)) - np.searchsorted(y, y)  # of each label, every fifth row is held back
    back = place % 5 == 4
    w = fit_ftrl([v for v, b in zip(vectors, back, strict=True) if not b], y[~back], len(classes))
    scores = np.array([vectors[i][1] @ w[vectors[i][0]] for i in np.flatnonzero(back)]).reshape(-1, len(classes))
    return {"classes": classes, "idf": idf, "w": w, "t": fit_temperature(scores, y[back])}


def label_sample(rows: DataFrame, found: list, sample_rows: int) -> DataFrame:
    """Of each label the rows with the smallest hashes: its share of about sample_rows, but LABEL_ROWS where it has as many, and one at least.

    rows: (hash, label ..); found: (label, n, least hash) of each label."""
    n = sum(r["n"] for r in found)
    wide, limits = 1 << 64, []
    for r in found:
        share = min(1.0, max(sample_rows / n, LABEL_ROWS / r["n"]))
        limits.append((r["label"], max(r["least"], min(int(share * wide), wide - 1) - (1 << 63)), max(1, 2 * int(np.ceil(share * r["n"])))))
    limits = rows.sparkSession.createDataFrame(limits, "label string, upto long, most long")
    near = rows.join(F.broadcast(limits), "label").where("hash <= upto")  # a row for each label
    return near.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy("hash"))).where("r <= most")


def _dense(packed: bytes) -> np.ndarray:
    at, c = np.frombuffer(packed, "<i4").reshape(2, -1)
    out = np.zeros(FEATURES, np.int64)
    out[at] = c
    return out


def predict(df: DataFrame, model: dict, text_col: str, lang_as: str = "lang_pred", score_as: str = "score") -> DataFrame:
    """df with two more columns: the likeliest language and its calibrated probability; `und` and 0 if a text is null or has no letters, or no language was learned.

    All columns and rows of df pass through, nulls and repeats included; columns of df with the two new names are replaced."""
    import pyarrow as pa
    from pyspark.sql import types as T

    prepare(df.sparkSession)
    df = df.drop(lang_as, score_as)
    schema = T.StructType([*df.schema.fields, T.StructField(lang_as, T.StringType()), T.StructField(score_as, T.DoubleType())])
    at_text = df.columns.index(text_col)
    classes, idf, w, t = (model[k] for k in ("classes", "idf", "w", "t"))
    w = w.astype(np.float32)

    def run(batches):
        for b in batches:
            lang, score = [], []
            for text in b.column(at_text).to_pylist():
                c = grams(text) if text and classes else None
                if c is None or not c.any():
                    lang.append("und")
                    score.append(0.0)
                    continue
                at, v = weighted(c, idf)
                p = softmax((v @ w[at]) / t)
                k = int(p.argmax())
                lang.append(classes[k])
                score.append(float(min(1.0, p[k])))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*b.schema.names, lang_as, score_as])

    return df.mapInArrow(run, schema)
