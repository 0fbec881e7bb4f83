"""The registered op queries against plain versions of their contracts, and the models against plain ones."""

import hashlib
import math
import zlib

import numpy as np
import pytest

from lakeloom.llm import langid, pii, quality, queries
from lakeloom.llm.queries import BYTE_FILE, WORD_FILE, tokenizer

AWKWARD = [None, "", " \n ", "naïve café — ßtraße", "word " * 3000, "a@b.example.com 10.0.0.1 +1 (555) 010-7788 4111 1111 1111 1111", "1234567", "same text", "same text", "x" * 9000]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = [(900_000 + i, t, "en" if i % 2 else None, "s", len(t or "")) for i, t in enumerate(AWKWARD)] + [(None, "no id", "en", "s", 5)]
    docs.unionByName(spark.createDataFrame(extra, docs.schema)).write.parquet(f"{at}/documents.parquet")
    for t in ("labels", "embeddings"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").write.parquet(f"{at}/{t}.parquet")
    return at


@pytest.fixture(scope="module")
def rows(spark, tables):
    return spark.read.parquet(f"{tables}/documents.parquet").collect()


def ids(name, text):
    from tokenizers import Tokenizer

    t = ids.known.setdefault(name, Tokenizer.from_file(tokenizer(name)))
    return t.encode(text or "", add_special_tokens=False).ids


ids.known = {}


def packed(x):
    return np.array(x, "<u4").tobytes()


def kinds(df):
    return dict(df.dtypes)


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, *map(repr, r[1:])))


def test_op1(spark, tables, rows):
    from tokenizers import Tokenizer

    got = queries.op1_bpe(spark, tables)
    assert kinds(got) == {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}
    t, want = Tokenizer.from_file(tokenizer(BYTE_FILE)), []
    for r in rows:
        x = ids(BYTE_FILE, r.text)
        want.append((r.doc_id, len(x), hashlib.sha256(packed(x)).hexdigest(), hashlib.sha256(t.decode(x, skip_special_tokens=False).encode()).hexdigest()))
    assert by_id(map(tuple, got.collect())) == by_id(want)


def test_op2(spark, tables, rows):
    got = queries.op2_exact_dedup(spark, tables)
    assert {k: kinds(got)[k] for k in ("doc_id", "keep_id", "group_size", "kept", "text_sha256")} == {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"}
    same: dict = {}
    for r in rows:
        same.setdefault(r.text or "", []).append(r.doc_id)
    keep = {t: max((i for i in v if i is not None), default=None) for t, v in same.items()}
    want = [(r.doc_id, keep[r.text or ""], len(same[r.text or ""]), r.doc_id == keep[r.text or ""], hashlib.sha256((r.text or "").encode()).hexdigest()) for r in rows]
    assert by_id((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got.collect()) == by_id(want)


def test_op3_and_op5(spark, tables, rows):
    for f, more in ((queries.op3_langid, {"lang_pred": "string"}), (queries.op5_quality, {"predicted": "int"})):
        got = f(spark, tables)
        assert kinds(got) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", **more}
        out = got.collect()
        assert sorted(map(repr, (r.doc_id for r in out))) == sorted(map(repr, (r.doc_id for r in rows)))
        for r in out:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode() if r.doc_id is not None else b"") % 5 == 0) and 0 <= r.score <= 1
            if "predicted" in more:
                assert r.predicted == (r.score >= 0.3)
        if "lang_pred" in more:
            text, lang = {r.doc_id: r.text for r in rows}, {r.doc_id: r.lang for r in rows}
            assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in text[r.doc_id] or "")) for r in out)
            known = [r for r in out if r.held_out and lang[r.doc_id] and r.lang_pred != "und"]
            assert np.mean([r.lang_pred == lang[r.doc_id] for r in known]) > 0.9
        else:
            label = {r.doc_id: r.quality for r in spark.read.parquet(f"{tables}/labels.parquet").collect()}
            held = [(r.score, label[r.doc_id]) for r in out if r.held_out and r.doc_id in label]
            good, bad = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
            assert np.mean([a > b for a in good for b in bad]) > 0.9


def test_op4(spark, tables):
    got = queries.op4_forest(spark, tables)
    assert kinds(got) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"}
    rows = spark.read.parquet(f"{tables}/embeddings.parquet").select("vec_id", "embedding").collect()
    x, at = np.array([r.embedding for r in rows], float), np.array([r.vec_id for r in rows])
    found: dict = {}
    for r in got.orderBy("query_id", "rank").collect():
        assert abs(r.score - float(x[at == r.query_id][0] @ x[at == r.vec_id][0])) < 1e-9 and r.vec_id != r.query_id
        found.setdefault(r.query_id, []).append((r["rank"], -r.score, r.vec_id))
    hits = []
    for q in at[at % 20 == 0]:
        mine = found[q]
        assert [m[0] for m in mine] == list(range(1, min(20, len(at) - 1) + 1)) and mine == sorted(mine, key=lambda m: m[1:])
        s = x @ x[at == q][0]
        s[at == q] = -np.inf
        hits.append(len({m[2] for m in mine} & set(at[np.lexsort((at, -s))[:20]].tolist())) / 20)
    assert set(found) == set(at[at % 20 == 0]) and np.mean(hits) >= 0.9


def test_op8_and_op10(spark, tables, rows):
    got = queries.op8_token_files(spark, tables)
    assert kinds(got) == {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"}
    at, want = 0, []
    for r in sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0)):
        x = [*ids(BYTE_FILE, r.text), 2]
        want.append((r.doc_id, at, len(x), zlib.crc32(packed(x))))
        at += len(x)
    assert by_id(map(tuple, got.collect())) == by_id(want)
    got = queries.op10_packing(spark, tables)
    assert kinds(got) == {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"}
    text, seen, seq = {r.doc_id: r.text for r in rows}, {}, {}
    for p in got.collect():
        x = [*ids(WORD_FILE, text[p.doc_id]), 2]
        assert p.doc_tokens == len(x) and p.ids_crc32 == zlib.crc32(packed(x[p.start : p.start + p.length]))
        seen.setdefault(p.doc_id, []).append((p.start, p.length))
        seq.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for v in [*seen.values(), *seq.values()]:
        v.sort()
        assert [a for a, _ in v] == np.cumsum([0, *(n for _, n in v)])[:-1].tolist()
    assert set(seen) == set(text) and all(sum(n for _, n in seen[i]) == len(ids(WORD_FILE, t)) + 1 for i, t in text.items())
    full = [sum(n for _, n in v) for v in seq.values()]
    assert max(full) <= 4096 and sum(n < 4096 for n in full) <= spark.read.parquet(f"{tables}/documents.parquet").rdd.getNumPartitions()


def test_op9(spark, tables, rows):
    from tests.llm.test_brute_force import plain_spans

    got = queries.op9_pii(spark, tables)
    assert kinds(got) == {"doc_id": "bigint", **{f"n_{k}": "bigint" for k in pii.KINDS}, "base_sha256": "string", "spans": "string"}
    text = {r.doc_id: r.text or "" for r in rows}
    for r in got.collect():
        base = plain_spans(text[r.doc_id])
        told = [f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(told).encode()).hexdigest() and set(told) <= set(r.spans.split(",")) | {""}
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == i for x in base) for i in range(4)]


def test_added_spans_are_those_of_all_windows():
    """A trained tagger on texts whose numbers the base patterns miss: computing only some windows gives what all windows give."""
    r = np.random.default_rng(3)
    texts = []
    for i in range(120):
        parts = [" ".join("abcdefghijklmnop"[j : j + 5] for j in r.integers(0, 11, r.integers(5, 60))) for _ in range(4)]
        texts.append(f"{parts[0]} mail u{i}@mail{i % 7}.example.com {parts[1]} call +1 (555) 010-{1000 + i} {parts[2]} from 10.0.{i % 256}.7 {parts[3]}")
    both = np.array([w for t in texts for w in pii.training_windows(t)])
    tagger = pii.Tagger()
    tagger.fit(both[:, 0], both[:, 1])
    hard = [t.replace("@", " @ü").replace("+1 (", "1 (").replace("10.0.", "910.0.") for t in texts] + [texts[3] * 20, "7" * 700, "@" * 300]
    some = pii.added_spans(hard, tagger, [pii.base_spans(t) for t in hard])
    trigger = pii.TRIGGER
    pii.TRIGGER = __import__("re").compile(r"(?s).")  # every window holds one
    try:
        every = pii.added_spans(hard, tagger, [[] for _ in hard])
    finally:
        pii.TRIGGER = trigger
    for t, a, b in zip(hard, some, every, strict=True):
        base = pii.base_spans(t)
        kept = [(k, x, y) for k, x, y in b if pii.TRIGGER.search(t[x:y]) and not any(x < q and p < y for _, p, q in base)]
        assert sorted(a) == sorted(kept)


def test_ftrl_against_a_plain_one():
    """One coordinate at a time, in dictionaries."""
    r = np.random.default_rng(2)
    data = []
    for i in range(60):
        at = np.sort(r.choice(40, 6, replace=False)) + 20 * (i % 2)
        v = r.random(6)
        data.append((at, v / np.sqrt(v @ v)))
    y = np.arange(60) % 2
    got = langid.fit_ftrl(data, y, 2, epochs=2, seed=9)
    alpha, beta, l1, l2 = 0.5, 1.0, 0.002, 0.01
    z, n = {}, {}

    def weight(k):
        a = z.get(k, 0.0)
        return 0.0 if abs(a) <= l1 else -(a - math.copysign(l1, a)) / ((beta + math.sqrt(n.get(k, 0.0))) / alpha + l2)

    rng = np.random.default_rng(9)
    for _ in range(2):
        for i in rng.permutation(60):
            at, v = data[i]
            w = {(j, c): weight((j, c)) for j in at.tolist() for c in (0, 1)}
            s = [sum(x * w[j, c] for j, x in zip(at.tolist(), v.tolist(), strict=True)) for c in (0, 1)]
            top = max(s)
            e = [math.exp(x - top) for x in s]
            for c in (0, 1):
                p = e[c] / sum(e) - (y[i] == c)
                for j, x in zip(at.tolist(), v.tolist(), strict=True):
                    g, old = x * p, n.get((j, c), 0.0)
                    z[j, c] = z.get((j, c), 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / alpha * w[j, c]
                    n[j, c] = old + g * g
    assert all(abs(got[j, c] - weight((j, c))) < 1e-9 for j in range(langid.FEATURES) if j < 60 for c in (0, 1)) and not got[60:].any()


def test_tf_idf_against_a_plain_one():
    counts, idf = np.array([3, 0, 1, 7]), np.array([1.5, 9.0, 2.0, 1.0])
    at, v = langid.weighted(counts, idf)
    plain = [(1 + math.log(c)) * w for c, w in zip(counts.tolist(), idf.tolist(), strict=True) if c]
    size = math.sqrt(sum(x * x for x in plain))
    assert at.tolist() == [0, 2, 3] and np.allclose(v, [x / size for x in plain])


def test_trees_against_a_plain_walk_and_a_plain_first_split():
    r = np.random.default_rng(4)
    x = r.random((400, 5)).round(2)
    y = ((x[:, 1] > 0.6) ^ (r.random(400) < 0.1)).astype(float)
    m = quality.fit_trees(x, y, trees=7, depth=3)
    got = quality.score_trees(m, x)
    for i in range(400):
        s = m["base"]
        for column, cut, value in zip(m["column"], m["cut"], m["value"], strict=True):
            node = 0
            while column[node] >= 0 and node < 7:
                node = 2 * node + 1 + int(x[i, column[node]] > cut[node])
            s += value[node]
        assert abs(got[i] - 1 / (1 + math.exp(-s))) < 1e-12
    p = y.mean()
    g, h = p - y, np.full(400, p * (1 - p))
    best = (0.0, None)
    for j in range(5):
        for e in np.unique(np.quantile(x[:, j], np.linspace(0, 1, quality.BINS + 1)[1:-1])):
            left = x[:, j] <= e
            if left.sum() >= quality.LEAST and (~left).sum() >= quality.LEAST:
                gain = sum(g[k].sum() ** 2 / (h[k].sum() + quality.L2) for k in (left, ~left)) - g.sum() ** 2 / (h.sum() + quality.L2)
                if gain > best[0] + 1e-9:
                    best = (gain, (j, e))
    assert (m["column"][0, 0], m["cut"][0, 0]) == best[1]
