"""Personal data: base patterns, and a character-level bidirectional LSTM with CRF transitions that adds spans.

The network is trained here, in numpy, on spans that the base patterns label in a bounded sample of documents. It reads
overlapping windows of a text; each character takes its tag from the window in which it lies farthest from an edge, and
spans are read off the whole text's tags. By definition an added span holds a digit or an @, so a window without either
is computed only if a span may reach into it: if the tag next to it isn't `outside`, window by window as far as that
holds. The added spans are those that all windows would give. Added spans that touch a base span, or can't be of their kind, are dropped."""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm._util import bounded_sample, prepare

KINDS = ("email", "ip", "card", "phone")
# The base patterns.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

TRIGGER = re.compile(r"[0-9@]")
DIGITS = re.compile(r"[^0-9]")

WINDOW, STRIDE = 128, 96
#: Documents that are sampled to label windows, windows that are trained on, and steps.
SAMPLE_ROWS, SAMPLE_WINDOWS, STEPS, BATCH, TRAIN_LENGTH = 2000, 3000, 110, 48, 64
#: Windows of one sampled document that are learned from at most, chosen by hash from the whole document.
DOCUMENT_WINDOWS = 16
HIDDEN, TAGS, SYMBOLS = 16, 1 + 2 * len(KINDS), 130
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def emails(text: str):
    """Leftmost non-overlapping matches, found from each @ backwards, so that long words cost no more than their length."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL_CHARS:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            end = m.end()
            yield start, end
        else:
            end = max(end, at + 1)
        at = text.find("@", max(end, at + 1))


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind and start; positions are code points."""
    if not text or not TRIGGER.search(text):
        return []
    out = [(0, *x) for x in emails(text)]
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
    for kind, pattern, low, high in ((2, CARD, 13, 19), (3, PHONE, 9, 15)):
        for m in pattern.finditer(text):
            d = DIGITS.sub("", m[0])
            if low <= len(d) <= high and (kind == 3 or luhn(d)):
                out.append((kind, m.start(), m.end()))
    return out


def plausible(kind: int, s: str) -> bool:
    """What an added span must hold to be of its kind at all."""
    d = len(DIGITS.sub("", s))
    if kind == 0:
        return "@" in s[1:-1] and "." in s.rpartition("@")[2]
    return d >= 4 and s.count(".") >= 3 if kind == 1 else 13 <= d <= 19 if kind == 2 else 7 <= d <= 15


def symbols(text: str) -> np.ndarray:
    """One of SYMBOLS for each character: digits are alike, so are small and capital letters, and all that isn't ASCII."""
    c = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    return _CLASS[np.minimum(c, 128)]


_CLASS = np.arange(129)
_CLASS[48:58], _CLASS[97:123], _CLASS[65:91] = 48, 97, 65


class Tagger:
    """Parameters: per direction input table, recurrence and bias; output; CRF transitions and starts."""

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        n = lambda *s, by=0.1: (r.standard_normal(s) * by).astype(np.float32)
        self.p = {"xf": n(SYMBOLS, 4 * HIDDEN, by=0.3), "xb": n(SYMBOLS, 4 * HIDDEN, by=0.3), "hf": n(HIDDEN, 4 * HIDDEN, by=0.2), "hb": n(HIDDEN, 4 * HIDDEN, by=0.2), "w": n(2 * HIDDEN, TAGS), "b": np.zeros(TAGS, np.float32), "t": n(TAGS, TAGS, by=0.05), "s": np.zeros(TAGS, np.float32)}
        for k in ("xf", "xb"):
            self.p[k][:, HIDDEN : 2 * HIDDEN] += 1.0  # gates of memory start open

    def run(self, x: np.ndarray, side: str, keep: bool = False):
        """Hidden states (length, rows, HIDDEN) of one direction; x: (rows, length)."""
        table, u = self.p["x" + side], self.p["h" + side]
        n, length = x.shape
        h = c = np.zeros((n, HIDDEN), np.float32)
        out, kept = np.zeros((length, n, HIDDEN), np.float32), []
        for t in range(length) if side == "f" else range(length - 1, -1, -1):
            g = table[x[:, t]] + h @ u
            s = 1 / (1 + np.exp(-g[:, : 3 * HIDDEN]))
            i, f, o, z = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(g[:, 3 * HIDDEN :])
            before, old = h, c
            c = f * c + i * z
            th = np.tanh(c)
            h = o * th
            out[t] = h
            if keep:
                kept.append((t, i, f, o, z, th, before, old))
        return out, kept

    def back(self, x: np.ndarray, side: str, kept: list, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        u = self.p["h" + side]
        dx, du = np.zeros_like(self.p["x" + side]), np.zeros_like(u)
        dh = dc = np.zeros((len(x), HIDDEN), np.float32)
        for t, i, f, o, z, th, before, old in reversed(kept):
            dh = dh + grad[t]
            dc = dc + dh * o * (1 - th * th)
            g = np.concatenate([dc * z * i * (1 - i), dc * old * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - z * z)], 1)
            np.add.at(dx, x[:, t], g)
            du += before.T @ g
            dh, dc = g @ u.T, dc * f
        return dx, du

    def emissions(self, x: np.ndarray) -> np.ndarray:
        h = np.concatenate([self.run(x, "f")[0], self.run(x, "b")[0]], 2)
        return h @ self.p["w"] + self.p["b"]

    def step(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean negative log-likelihood of the tag sequences y, and its gradients."""
        p = self.p
        n, length = x.shape
        (hf, kf), (hb, kb) = self.run(x, "f", True), self.run(x, "b", True)
        h = np.concatenate([hf, hb], 2)
        e = h @ p["w"] + p["b"]
        a, z = np.zeros((length, n, TAGS)), np.zeros((length, n, TAGS))
        a[0] = p["s"] + e[0]
        for t in range(1, length):
            a[t] = _sum_exp(a[t - 1][:, :, None] + p["t"], 1) + e[t]
        for t in range(length - 2, -1, -1):
            z[t] = _sum_exp(p["t"] + (z[t + 1] + e[t + 1])[:, None, :], 2)
        log_z = _sum_exp(a[-1], 1)
        rows = np.arange(n)
        gold = p["s"][y[:, 0]] + sum(e[t][rows, y[:, t]] for t in range(length)) + p["t"][y[:, :-1], y[:, 1:]].sum(1)
        de = np.exp(a + z - log_z[:, None])
        dt = np.zeros((TAGS, TAGS))
        for t in range(1, length):
            dt += np.exp(a[t - 1][:, :, None] + p["t"] + (e[t] + z[t])[:, None, :] - log_z[:, None, None]).sum(0)
        np.add.at(dt, (y[:, :-1], y[:, 1:]), -1)
        ds = de[0].sum(0) - np.bincount(y[:, 0], minlength=TAGS)
        for t in range(length):
            de[t][rows, y[:, t]] -= 1
        de = (de / n).astype(np.float32)
        dh = de @ p["w"].T
        xf, uf = self.back(x, "f", kf, dh[:, :, :HIDDEN])
        xb, ub = self.back(x, "b", kb, dh[:, :, HIDDEN:])
        g = {"xf": xf, "hf": uf, "xb": xb, "hb": ub, "w": np.einsum("tnh,tnk->hk", h, de), "b": de.sum((0, 1)), "t": dt / n, "s": ds / n}
        return float((log_z - gold).mean()), g

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, rate: float = 0.03, seed: int = 3) -> list[float]:
        """Adam on batches drawn from the windows."""
        r = np.random.default_rng(seed)
        m, v, losses = ({k: np.zeros_like(q) for k, q in self.p.items()} for _ in range(2)), None, []
        m, v = m
        for k in range(1, steps + 1):
            i = r.integers(0, len(x), min(BATCH, len(x)))
            loss, g = self.step(x[i], y[i])
            losses.append(loss)
            size = np.sqrt(sum(float((q * q).sum()) for q in g.values()))
            for name, q in g.items():
                q = q * min(1.0, 5.0 / max(size, 1e-9))
                m[name] = 0.9 * m[name] + 0.1 * q
                v[name] = 0.99 * v[name] + 0.01 * q * q
                now = rate * min(1.0, 2 * (1 - k / (steps + 1)))
                self.p[name] = (self.p[name] - now * (m[name] / (1 - 0.9**k)) / (np.sqrt(v[name] / (1 - 0.99**k)) + 1e-8)).astype(np.float32)
        return losses

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The likeliest tags (rows, length)."""
        e, p = self.emissions(x), self.p
        length, n, _ = e.shape
        a, from_ = p["s"] + e[0], np.zeros((length, n, TAGS), np.int8)
        for t in range(1, length):
            s = a[:, :, None] + p["t"]
            from_[t] = s.argmax(1)
            a = s.max(1) + e[t]
        out = np.zeros((n, length), np.int64)
        out[:, -1] = a.argmax(1)
        for t in range(length - 1, 0, -1):
            out[:, t - 1] = from_[t][np.arange(n), out[:, t]]
        return out


def _sum_exp(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


def tags_of(length: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    out = np.zeros(length, np.int64)
    for kind, a, b in spans:
        if not out[a:b].any():
            out[a:b] = 2 + 2 * kind
            out[a] = 1 + 2 * kind
    return out


def training_windows(text: str, length: int = TRAIN_LENGTH) -> list[tuple[np.ndarray, np.ndarray]]:
    """Windows of one document that hold a digit or an @, with the tags of the base spans."""
    x, y, out, i = symbols(text), tags_of(len(text), base_spans(text)), [], 0
    for m in TRIGGER.finditer(text):
        if m.start() < i:
            continue
        a = max(0, m.start() - length // 2)
        i = a + length
        w, t = np.zeros(length, np.int64), np.zeros(length, np.int64)
        w[: len(x[a:i])], t[: len(x[a:i])] = x[a:i], y[a:i]
        out.append((w, t))
    return out


def chosen_windows(text: str, most: int = DOCUMENT_WINDOWS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of the training windows of a document those with the smallest hashes of number and symbols, in the text's order."""
    all_ = training_windows(text)
    hashed = sorted(range(len(all_)), key=lambda i: (zlib.crc32(all_[i][0].tobytes(), i), i))
    return [all_[i] for i in sorted(hashed[:most])]


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> Tagger | None:
    """A tagger from about sample_rows documents with a digit or an @; None if there are none."""
    import pyarrow as pa

    prepare(df.sparkSession)
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where(F.col("text").rlike("[0-9@]"))

    def run(batches):
        for b in batches:
            got = [w for t in b.column(0).to_pylist() for w in chosen_windows(t)]
            yield pa.RecordBatch.from_arrays([pa.array([np.stack(w).astype(np.uint8).tobytes() for w in got], pa.binary())], names=["w"])

    got = sorted(bytes(r["w"]) for r in bounded_sample(rows, F.coalesce("id", F.lit("")), sample_rows).select("text").mapInArrow(run, "w binary").collect())
    if not got:
        return None
    both = np.array([np.frombuffer(w, np.uint8).reshape(2, -1) for w in got[:: max(1, len(got) // SAMPLE_WINDOWS)]]).astype(np.int64)
    tagger = Tagger()
    tagger.fit(both[:, 0], both[:, 1])
    return tagger


def added_spans(texts: list[str | None], tagger: Tagger | None, base: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
    """What the tagger adds to the base spans of each text."""
    out: list[list] = [[] for _ in texts]
    if tagger is None:
        return out
    ends = [-(-max(0, len(t or "") - WINDOW) // STRIDE) * STRIDE for t in texts]  # the first window that holds the text's end is the last
    jobs = []
    for k, text in enumerate(texts):
        starts = set()
        for m in TRIGGER.finditer(text or ""):
            last = m.start() // STRIDE * STRIDE
            starts |= {last, *range(max(0, last - (WINDOW - 1) // STRIDE * STRIDE), last, STRIDE)}
        jobs += [(k, a) for a in sorted(starts) if a <= ends[k] and TRIGGER.search(text, a, a + WINDOW)]
    tags: dict[int, dict[int, int]] = {}
    edge, known = (WINDOW - STRIDE) // 2, set(jobs)
    while jobs:
        part, jobs = jobs[:256], jobs[256:]
        x = np.zeros((len(part), WINDOW), np.int64)
        for r, (k, a) in enumerate(part):
            s = symbols(texts[k][a : a + WINDOW])
            x[r, : len(s)] = s
        for (k, a), row in zip(part, tagger.decode(x), strict=True):
            low, high = 0 if a == 0 else edge, WINDOW if a == ends[k] else WINDOW - edge
            at = np.flatnonzero(row[low:high]) + low
            tags.setdefault(k, {}).update((a + j, t) for j, t in zip(at.tolist(), row[at].tolist(), strict=True) if a + j < len(texts[k]))
            before = a > 0 and row[low] > 0 and row[low] % 2 == 0
            after = a < ends[k] and row[high - 1] > 0
            for n in [(k, a - STRIDE)] * bool(before) + [(k, a + STRIDE)] * bool(after):
                if n not in known:
                    known.add(n)
                    jobs.append(n)
    for k, found in tags.items():
        spans, last = [], None
        for i in sorted(found):
            kind, begins = (found[i] - 1) // 2, found[i] % 2 == 1
            if last and i == last[2] and kind == last[0] and not begins:
                last[2] = i + 1
            else:
                last = [kind, i, i + 1]
                spans.append(last)
        taken = sorted((a, b) for _, a, b in base[k])
        begins, ends = [a for a, _ in taken], np.maximum.accumulate([b for _, b in taken]).tolist()
        for kind, a, b in spans:
            s, before = texts[k][a:b], bisect_left(begins, b)  # base spans that begin before this one ends
            if TRIGGER.search(s) and plausible(kind, s) and not (before and ends[before - 1] > a):
                out[k].append((kind, a, b))
    return out


def find(df: DataFrame, tagger: Tagger | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: <id_col> and base and spans, arrays of (kind, start, end) by kind as in KINDS, then start.

    Null texts count as empty and have no spans. Null and repeated ids pass through; other columns are not read."""
    out = with_spans(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), tagger, "text", "base", "spans")
    return out.select(F.col("id").alias(id_col), "base", "spans")


def with_spans(df: DataFrame, tagger: Tagger | None, text_col: str, base_as: str, spans_as: str) -> DataFrame:
    """df with two more columns, the base spans and all spans."""
    import pyarrow as pa
    from pyspark.sql import types as T

    prepare(df.sparkSession)
    one = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([*df.schema.fields, T.StructField(base_as, T.ArrayType(one)), T.StructField(spans_as, T.ArrayType(one))])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    at = df.columns.index(text_col)
    column = lambda spans: pa.array([[{"kind": KINDS[k], "start": a, "end": b} for k, a, b in sorted(x)] for x in spans], kind)

    def run(batches):
        for b in batches:
            texts = b.column(at).to_pylist()
            base = [base_spans(t) for t in texts]
            more = added_spans(texts, tagger, base)
            yield pa.RecordBatch.from_arrays([*b.columns, column(base), column([x + y for x, y in zip(base, more, strict=True)])], names=[*b.schema.names, base_as, spans_as])

    return df.mapInArrow(run, schema)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with its spans replaced by their kinds; overlapping spans become one, named by the earliest."""
    out, at = [], 0
    for a, b, k in sorted((a, b, KINDS[k]) for k, a, b in spans):
        if a >= at:
            out += [text[at:a], f"<{k}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask(df: DataFrame, tagger: Tagger | None, text_col: str = "text") -> DataFrame:
    """df with each span of its texts replaced by its kind in angle brackets; overlapping spans become one, named by the
    earliest. Rows pass with all their columns, whatever their names. Null texts stay null."""
    import pyarrow as pa

    prepare(df.sparkSession)
    at = df.columns.index(text_col)

    def run(batches):
        for b in batches:
            texts = b.column(at).to_pylist()
            base = [base_spans(t) for t in texts]
            more = added_spans(texts, tagger, base)
            new = [t if t is None else masked(t, x + y) for t, x, y in zip(texts, base, more, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(new, b.column(k).type) if k == at else b.column(k) for k in range(b.num_columns)], names=b.schema.names)

    return df.mapInArrow(run, df.schema)
