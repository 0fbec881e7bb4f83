"""The training-data operators against brute-force versions and on awkward tables."""

import gc
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lakeloom.llm import bpe, dedup, forest, langid, linedup, packing, pii, quality, simhash, tok, tokenfile
from lakeloom.llm.queries import BYTE_FILE, WORD_FILE, tokenizer

AWKWARD = ["", None, " ", "\n\n", "a", "Hello, world! don't\n\n stop  ", "naïve café — ßtraße 東京タワー", "x" * 9000, "ab" * 20000, "1234567890" * 3000, "  \t\n    y  z", "<|endoftext|>a <|endoftext|> b<|startoftext|>", "é combining Σίσυφος ΣΑΣ", "😀" * 3000, "a" * 60000 + " b c. d " * 9000, "word's 'tis I'll we've 'S"]


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(4)
    words = ["the", "of", "Und", "straße", "x1", "foo,", "bar.", "don't", "42", "a@b.de"]
    texts = AWKWARD + [" ".join(r.choices(words, k=r.randrange(1, 60))) for _ in range(60)]
    texts += texts[20:30] + [None, ""]
    rows = [(i, t, "z", i % 3 == 0) for i, t in enumerate(texts)] + [(None, "the same", "z", None), (None, "the same", "z", None), (7, "x" * 9000, "z", True)]
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, ids boolean").repartition(3)


def ids_of(text, name=BYTE_FILE):
    from tokenizers import Tokenizer

    ids_of.t = getattr(ids_of, "t", {})
    t = ids_of.t.setdefault(name, Tokenizer.from_file(tokenizer(name)))
    return t.encode(text or "", add_special_tokens=False).ids


def test_encoders_match():
    for name in (BYTE_FILE, WORD_FILE):
        e = tok.Encoder(tokenizer(name), leaf=64)
        for t in AWKWARD:
            assert np.frombuffer(e.encode(t), "<u4").tolist() == ids_of(t, name), (name, t and t[:40])


def test_tree_concatenation():
    e = tok.Encoder(tokenizer(BYTE_FILE), leaf=1 << 30)
    r = random.Random(1)
    for n in (1, 5, 300, 5000):
        for letters in ("ab", "etaoinshrdlu", "0123456789", "é東😀x"):
            raw = "".join(r.choices(letters, k=n)).encode()
            for leaf in (2, 7, 64):
                assert bpe.tree_encode(e, raw, leaf).tolist() == e.bpe(raw)


def test_tree_of_texts(spark):
    """Long texts go through the tree: joins are made and give what the tokenizers library gives, wherever halves are cut."""
    e = tok.Encoder(tokenizer(BYTE_FILE))
    texts = [x.text or "" for x in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    long = sorted((t for t in texts if len(t) > bpe.LEAF), key=len)
    assert len(long) > 20
    for t in long[::5]:
        before = e.joins
        assert np.frombuffer(bpe.encode_text(e, t), "<u4").tolist() == ids_of(t) and e.joins - before >= len(bpe.leaves_of(t)) - 1
    r = random.Random(7)
    parts = ["don't", " it's", "  two", "\n", "\n\n", " \t ", "x1", "é", "..", "!? ", "word", " word", "'ll", "<|endoftext|>", "東京", "😀 "]
    for k in range(400):
        t = "".join(r.choices(parts, k=r.randrange(1, 60)))
        assert np.frombuffer(bpe.encode_text(e, t, r.choice([1, 3, 8, 30])), "<u4").tolist() == ids_of(t), t
        at = sorted(r.sample(range(len(t) + 1), min(3, len(t))))  # halves cut anywhere, in words and white space
        halves = [t[a:b] for a, b in zip([0, *at], [*at, len(t)], strict=True)]
        if "<|endoftext|>" not in t:
            got = bpe.join_all(e, [(p := e.pieces(x), [e.get(y) for y in p]) for x in halves if x])
            assert np.frombuffer(b"".join(got[1]), "<u4").tolist() == ids_of(t), (t, halves)


def test_bpe(spark, docs):
    got = bpe.encode_documents(docs, tokenizer(BYTE_FILE), long=2000, part=500).collect()
    want = sorted((r.doc_id is None, r.doc_id or 0, np.array(ids_of(r.text), "<u4").tobytes(), r.text or "") for r in docs.collect())
    assert sorted((r.doc_id is None, r.doc_id or 0, bytes(r.ids), r.decoded) for r in got) == want
    assert bpe.encode_documents(docs.limit(0), tokenizer(BYTE_FILE)).count() == 0


def test_exact_dedup(spark, docs):
    got = dedup.exact_dedup(docs).collect()
    by = {}
    for r in docs.collect():
        by.setdefault(r.text or "", []).append(r.doc_id)
    assert len(got) == docs.count()
    for r in got:
        same = next(v for k, v in by.items() if hashlib.sha256(k.encode()).hexdigest() == r.text_sha256)
        assert r.group_size == len(same) and r.keep_id == max((x for x in same if x is not None), default=None)
    assert sum(r.kept for r in got) == len(by)
    assert dedup.winners(docs).count() == len(by)
    assert dedup.exact_dedup(docs.limit(0)).count() == 0


def test_langid(spark):
    r = random.Random(2)
    make = lambda w: " ".join("".join(r.choices(w, k=3)) for _ in range(30))
    rows = [(i, make(["the", "ing", "and"] if i % 2 else ["und", "sch", "ein"]), "en" if i % 2 else "de") for i in range(200)] + [(900, None, "en"), (901, "123 !", "de"), (902, "", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = langid.train(d.where("doc_id % 5 <> 0"), "text", "lang", F.col("doc_id"))
    got = {x.doc_id: x for x in langid.predict(d, m, "text").collect()}
    assert all(got[i].lang_pred == ("en" if i % 2 else "de") for i in range(0, 200, 5))
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902))
    assert np.count_nonzero(m["w"]) < m["w"].size / 4  # sparse
    none = langid.train(d.limit(0), "text", "lang", F.col("doc_id"))
    assert {x.lang_pred for x in langid.predict(d, none, "text").collect()} == {"und"}


def brute_nearest(rows, k):
    good = {i: np.array(v, float) for i, v in rows if v is not None and i is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in good:
        if q % 20 == 0:
            s = sorted((-float(good[q] @ good[i]), i) for i in good if i != q)[:k]
            out[q] = s
    return out


def test_forest(spark):
    r = np.random.default_rng(0)
    x = r.standard_normal((600, 8)).astype(np.float32)
    rows = [(i, x[i].tolist()) for i in range(600)] + [(1000 + i, x[40].tolist()) for i in range(60)]
    rows += [(2000, None), (2020, [0.0] * 8), (2040, [float("nan")] + [1.0] * 7), (2060, [1.0, None] + [1.0] * 6), (2080, [1.0] * 3), (2100, [float("inf")] * 8)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    rows32 = [(i, None if v is None else [None if y is None else float(np.float32(y)) for y in v]) for i, v in rows]
    want = brute_nearest(rows32, 20)
    got = {}
    for x_ in forest.nearest(d, d.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(x_.query_id, []).append((-x_.score, x_.vec_id))
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    recall = np.mean([len({i for _, i in got[q]} & {i for _, i in want[q]}) / 20 for q in want])
    assert recall >= 0.9
    full = {}
    for x_ in forest.nearest(d, d.where("vec_id % 20 = 0"), share=16.0).orderBy("query_id", "rank").collect():
        full.setdefault(x_.query_id, []).append(x_.vec_id)
    assert all(full[q] == [i for _, i in sorted((round(s, 9), i) for s, i in want[q])] for q in want)  # all offered: exact
    assert forest.nearest(d.limit(0), d.limit(0)).count() == 0


def test_quality(spark):
    rows = [(i, ("good words in a row. " * (3 + i % 5)) if i % 4 else "BAD!! SPAM!! $$$ " * (3 + i % 7)) for i in range(300)] + [(900, None), (901, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 if i % 4 else 0) for i in range(300)] + [(900, None), (None, 1)], "doc_id long, quality int")
    m = quality.train(d, labels, "doc_id", "text", "quality", F.col("doc_id") % 5 != 0)
    got = {r.doc_id: r.score for r in quality.score(d, m).collect()}
    assert all((got[i] >= 0.3) == bool(i % 4) for i in range(0, 300, 5)) and 0 <= got[900] <= 1 and 0 <= got[901] <= 1
    assert quality.score(d, quality.train(d.limit(0), labels, "doc_id", "text", "quality", F.lit(True))).where("score <> 0.5").count() == 0


@pytest.mark.parametrize(("frequent", "enough", "sure"), [(1000, 2, 2.0), (1, 1, -99.0)])
def test_line_dedup(spark, monkeypatch, frequent, enough, sure):
    monkeypatch.setattr(linedup, "FREQUENT", frequent)
    monkeypatch.setattr(linedup, "MEANS", 0)
    r = random.Random(3)
    lines = [" ".join(r.choices([f"w{i}" for i in range(40)], k=r.randrange(1, 14))) for _ in range(120)]

    def vary(s):
        w = s.split()
        if r.random() < 0.7:
            w[r.randrange(len(w))] = f"w{r.randrange(40)}"
        return " ".join(w)

    rows = [(i, "\n".join(r.choice([vary(r.choice(lines)), r.choice(lines), "", "ONE two"]) for _ in range(r.randrange(1, 8)))) for i in range(120)] + [(500, None), (501, ""), (None, lines[0])]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("removed", F.lit(1)).repartition(3)
    seen, want = [], {}
    for i, text in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)):
        want[i] = []
        for no, line in enumerate((text or "").split("\n")):
            s = set(line.lower().split())
            if s:
                if any(5 * len(s & o) >= 4 * len(s | o) for o in seen):
                    want[i].append(no)
                seen.append(s)
    got = {x.doc_id: (x.n_lines, x.removed) for x in linedup.line_dedup(d, enough=enough, sure=sure).collect()}
    assert {k: v[1] for k, v in got.items()} == want
    assert got[500] == (1, []) and linedup.line_dedup(d.limit(0)).count() == 0


def test_words_of_lines():
    r = random.Random(5)
    lines = [bytes(r.choice(b"ab \t\r\x0b\x0cxyz\xc3\xa9") for _ in range(r.randrange(1, 60))) for _ in range(500)] + [b"", b"   ", b"x" * 3000]
    h, n = linedup.words_of(lines)
    assert n.tolist() == [len(set(x.split())) for x in lines]
    known: dict = {}
    for x, part in zip(lines, np.split(h, np.cumsum(n)[:-1]), strict=True):
        for w in set(x.split()):
            known.setdefault(w, set(part.tolist())).intersection_update(part.tolist())
    one = {w: linedup.words_of([w])[0][0] for w in known}
    assert all(int(one[w]) in known[w] for w in known) and len(set(one.values())) == len(known)


def test_words_of_lines_take_less_time_than_python_sets():
    """op6_line_dedup passes its budget of CPU seconds only if words are hashed faster than Python splits lines."""
    r = random.Random(6)
    words = ["".join(r.choices("abcdefghij", k=r.randrange(2, 10))) for _ in range(5000)]
    lines = [" ".join(r.choices(words, k=r.randrange(20, 80))).encode() for _ in range(6000)]
    took: dict = {"arrays": [], "sets": []}
    gc.disable()  # its time depends on what other tests hold
    for _ in range(5):
        for name, f in (("arrays", lambda: linedup.words_of(lines)), ("sets", lambda: [len(set(x.split())) for x in lines])):
            t = time.thread_time()
            f()
            took[name].append(time.thread_time() - t)
    gc.enable()
    assert min(took["arrays"]) < 0.9 * min(took["sets"])


@pytest.mark.parametrize("ids", [[7, 3, 3, 9, 2**62, -5, 3], [2, None, 2, 1, 0, None, 2], [0.5, None, float("nan"), 2.0, 0.5, -1.0, 0.5], ["b", "a", None, "é", "b", "ab", "b"]])
def test_blocks_of_line_keys(ids):
    """Rows move in blocks, one for each bucket of a task, and come out by key, id and line number."""
    r = np.random.default_rng(2)
    blocks, out, rows = linedup.Blocks(6), [], []
    for _ in range(3):
        k = r.integers(0, len(ids), 400)
        columns = {c: r.integers(0, 5, 400) if width < 8 else r.integers(-(2**63), 2**63 - 1, 400) for c, width in linedup.COLUMNS.items()}
        columns["key"] += (1 << linedup.KEY) - 5
        rows += [(ids[i], *v) for i, *v in zip(k, *(x.tolist() for x in columns.values()), strict=True)]
        out += blocks.add(pa.array([ids[i] for i in k]), *columns.values())
    out += blocks.out()
    assert sum(b.num_rows for b in out) <= 6 and not list(blocks.out())
    table = pa.concat_tables(pa.Table.from_batches([b]) for b in out).sort_by("bucket")
    got = []
    for x, columns, new in linedup.unpacked(table.to_batches()):
        part = list(zip(x.to_pylist(), *(v.tolist() for v in columns.values()), strict=True))
        order = [(v[1], v[0] is not None, v[0] != v[0], v[0] if v[0] is not None and v[0] == v[0] else ids[0], v[2]) for v in part]
        assert order == sorted(order)
        assert new.tolist() == [True] + [repr(a[:3]) != repr(b[:3]) or a[0] != a[0] for a, b in zip(part, part[1:], strict=False)]
        got += part
    assert sorted(map(repr, got)) == sorted(map(repr, rows))


def test_line_dedup_of_repeated_ids(spark):
    """Rows that share an id are rows of their own: lines at one place are none earlier than the other."""
    a, b, c = "one two three four five", "six seven eight nine ten", "one two three four five six"
    rows = [(7, f"{a}\n{b}"), (7, f"{a}\nother words are in this line"), (7, f"{a}\n{b}"), (None, "tiny"), (None, "tiny\nTINY"), (9, f"{c}\ntiny\nfour five one two three"), (3, "x\n\n x")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((str(r.doc_id), r.n_lines, r.removed) for r in linedup.line_dedup(d).collect())
    assert got == [("3", 3, [2]), ("7", 2, []), ("7", 2, []), ("7", 2, []), ("9", 3, [0, 1, 2]), ("None", 1, []), ("None", 2, [1])]


@pytest.mark.parametrize(("n", "enough", "sure"), [(20_000, linedup.ENOUGH, linedup.SURE), (3000, 1, -99.0)])
def test_line_dedup_of_a_large_group(spark, monkeypatch, n, enough, sure):
    """Near copies of one line, many of them similar to none but distant ones. With sure = -99 any candidate is trusted to
    be similar, so that the second round must find what they hide."""
    rounds = []
    second = linedup.second_round
    monkeypatch.setattr(linedup, "second_round", lambda *a: rounds.append(1) or second(*a))
    r = np.random.default_rng(8)
    base = np.zeros((n, 90), bool)
    base[:, :20] = True
    for _ in range(4):
        base[np.arange(n), r.integers(0, 20, n)] = False
        base[np.arange(n), r.integers(20, 90, n)] = True
    texts = [" ".join(f"w{i}" for i in r.permutation(np.flatnonzero(b))) for b in base]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    size, x, want = base.sum(1), base.astype(np.float32), []
    for i in range(0, n, 1000):
        both = x[i : i + 1000] @ x[: i + 1000].T
        near = 9 * both >= 4 * (size[i : i + 1000, None] + size[None, : i + 1000])
        want += np.tril(near, i - 1).any(1).tolist()
    got = linedup.line_dedup(d, enough=enough, sure=sure).select("doc_id", "n_removed").collect()
    assert {k: bool(v) for k, v in got} == dict(enumerate(want)) and 0 < sum(want) < n
    assert rounds or sure > 0


def plain_fingerprint(text):
    from xxhash import xxh64_intdigest

    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    sh = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_fingerprint_and_index():
    for t in AWKWARD:
        assert simhash.fingerprint(t) == plain_fingerprint(t)
    r = np.random.default_rng(5)
    centres = r.integers(0, 2**63, 40, dtype=np.uint64)
    x = np.unique(np.concatenate([c ^ np.bitwise_or.reduce(np.uint64(1) << r.integers(0, 64, (60, k)).astype(np.uint64), axis=1) for c in centres for k in (1, 3)]))
    near = np.bitwise_count(x[:, None] ^ x[None]) <= 4
    got = np.zeros_like(near)
    for q, p in simhash.GrayIndex(x).search(x, 4):
        got[q, p] = True
    assert (got == near).all()
    root = np.arange(len(x))
    for _ in range(len(x)):
        new = np.array([root[n].min() for n in near])
        if (new == root).all():
            break
        root = new
    assert (simhash.connect(x, 4) == root).all()


@pytest.mark.parametrize("n", [10, 5000, 10**6, 10**9, 10**12])
def test_choices_lose_nothing(n):
    r = random.Random(n)
    bits = sum(w for _, w in simhash.choices(n)[0])
    assert n / 2**bits <= 2 * simhash.GROUP and (n <= simhash.GROUP or n / 2**bits >= simhash.GROUP / 16)
    for _ in range(300):
        a = r.getrandbits(64)
        b = a
        for bit in r.sample(range(64), 4):
            b ^= 1 << bit
        assert any(all((a ^ b) >> low & ((1 << w) - 1) == 0 for low, w in blocks) for blocks in simhash.choices(n))


def test_index_prunes_groups_of_documents(spark):
    """Fingerprints of all documents of a table in one group: part of the pairs is dropped with a node above them, none is lost. The larger the group, the larger that part."""
    texts = [x.text for x in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    x = np.unique(np.array([simhash.fingerprint(t) for t in texts], np.uint64))
    index, got = simhash.GrayIndex(x), 0
    for q, p in index.search(x, 4):
        assert (np.bitwise_count(x[q] ^ x[p]) <= 4).all()
        got += len(q)
    assert got == int((np.bitwise_count(x[:, None] ^ x[None]) <= 4).sum()) > len(x)
    assert len(index.levels) > 2 and index.dropped > len(x) ** 2 / 8 and index.seen < len(x) ** 2


@pytest.mark.parametrize(("group", "large"), [(simhash.GROUP, simhash.LARGE), (8, simhash.LARGE), (8, 2)])
def test_simhash(spark, docs, group, large):
    r = random.Random(8)
    base = [" ".join(f"v{r.randrange(3000)}" for _ in range(400)) for _ in range(6)]
    rows = [(r_.doc_id, r_.text) for r_ in docs.collect()]
    for k, b in enumerate(base):
        for j in range(12):
            w = b.split()
            for _ in range(j % 4):
                w[r.randrange(400)] = "edit"
            rows.append((1000 + 20 * k + j, " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fingerprint", F.lit(0))
    got = simhash.near_duplicates(d, group=group, large=large).collect()
    fp = [(i, plain_fingerprint(t)) for i, t in rows]
    comp = list(range(len(fp)))
    find = lambda i: i if comp[i] == i else find(comp[i])
    for i in range(len(fp)):
        for j in range(i):
            if bin(fp[i][1] ^ fp[j][1]).count("1") <= 4:
                comp[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(fp):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    want = sorted((repr(k), f"{f:016x}", repr(least.get(find(i)))) for i, (k, f) in enumerate(fp))
    assert sorted((repr(x.doc_id), x.fingerprint, repr(x.component_id)) for x in got) == want
    assert simhash.near_duplicates(d.limit(0)).count() == 0


def test_token_files(spark, docs, tmp_path):
    files = tokenfile.write_token_files(docs, tokenizer(BYTE_FILE), f"file://{tmp_path}/t", sequence=64)
    got = sorted(tokenfile.read_documents(spark, f"file://{tmp_path}/t", files).collect(), key=lambda r: r.start)
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""))
    at = 0
    for g, r in zip(got, rows, strict=True):
        ids = np.array([*ids_of(r.text), 2], "<u4")
        assert (g.id, g.start, g.n_tokens) == (r.doc_id, at, len(ids)) and bytes(g.ids) == ids.tobytes()
        at += len(ids)
    f = tokenfile.TokenFile(f"{tmp_path}/t/part-{files[0]['part']:06d}.arrows")
    ids, mask = f[len(f) - 1]
    assert len(ids) == 64 and mask[0] and sum(f[i][1].sum() for i in range(len(f))) == files[0]["n_tokens"]
    assert tokenfile.write_token_files(docs.limit(0), tokenizer(BYTE_FILE), f"file://{tmp_path}/e") == []


def plain_spans(text):
    out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for k, p, low, high in ((2, r"[0-9]([\x20-]?[0-9])+", 13, 19), (3, r"\+[0-9][\x20().0-9-]+[0-9]", 9, 15)):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if low <= len(d) <= high and (k == 3 or sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d))) % 10 == 0):
                out.append((k, m.start(), m.end()))
    return out


def test_base_spans():
    r = random.Random(6)
    for _ in range(4000):
        t = "".join(r.choices(["a@b.cd", "@", ".", "x", "1", "255", "256", "+", "(", ") ", "-", " ", "4111111111111111", "%", "é", "1.2.3.4"], k=r.randrange(1, 14)))
        assert pii.base_spans(t) == plain_spans(t), t
    long = "1" * 200_000 + " " + "a" * 200_000 + "@" + "+1(" * 50_000
    assert pii.base_spans(long) == []


def test_pii(spark, docs):
    r = random.Random(9)
    rows = [(i, f"Some words here mail me at u{i}@mail{i % 7}.example.com or call +1 (555) 010-{1000 + i} from 10.0.{i % 256}.7 ok. " + "plain text " * r.randrange(60)) for i in range(150)]
    d = spark.createDataFrame(rows + [(900, None), (901, "")], "doc_id long, text string").unionByName(docs.select("doc_id", "text")).withColumn("spans", F.lit(1))
    tagger = pii.train(d)
    got = pii.find(d, tagger).collect()
    want = sorted((repr(x.doc_id), plain_spans(x.text or "")) for x in d.collect())
    assert sorted((repr(x.doc_id), [(pii.KINDS.index(s.kind), s.start, s.end) for s in x.base]) for x in got) == want
    assert all({tuple(s) for s in x.base} <= {tuple(s) for s in x.spans} for x in got)
    x, y = np.array([w for t in rows[:60] for w in pii.training_windows(t[1])]).transpose(1, 0, 2)
    assert (tagger.decode(x) == y).mean() > 0.97
    masked = {r.doc_id: r.text for r in pii.mask(spark.createDataFrame(rows[:3] + [(900, None)], "doc_id long, text string"), None).collect()}
    assert "<email> or call <phone> from <ip> ok" in masked[1] and masked[900] is None
    assert pii.train(d.limit(0)) is None and pii.find(d.limit(0), None).count() == 0


def test_gradients():
    t = pii.Tagger()
    r = np.random.default_rng(1)
    x, y = r.integers(0, 128, (3, 7)), r.integers(0, pii.TAGS, (3, 7))
    t.p = {k: v.astype(np.float64) for k, v in t.p.items()}
    _, g = t.step(x, y)
    for k in t.p:
        i = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        at, h = t.p[k][i], 1e-3
        t.p[k][i] = at + h
        up = t.step(x, y)[0]
        t.p[k][i] = at - h
        down = t.step(x, y)[0]
        t.p[k][i] = at
        assert abs((up - down) / (2 * h) - g[k][i]) < 2e-2 * max(1, abs(g[k][i])), k


def test_packing_by_classes():
    """Bins of class k hold k whole documents of lengths in (C/(k+1), C/k], and pieces of the one document that is cut at a time."""
    r = random.Random(12)
    sizes = [r.choice([r.randrange(1, 40), r.randrange(1, 700), r.randrange(1, 257)]) for _ in range(3000)]
    bins = packing.Bins(3, 256)
    done = [x for i, n in enumerate(sizes) for x in bins.put(i, np.full(n, i, "<u4").tobytes())]
    late = bins.close()
    seq, parts = {}, {}
    for (i, at, ids, n), s, o in done + late:
        seq.setdefault(s, []).append((o, i, len(ids) // 4))
        parts.setdefault(i, []).append((at, ids))
        assert n == sizes[i]
    assert all(b"".join(x for _, x in sorted(v)) == np.full(sizes[i], i, "<u4").tobytes() for i, v in parts.items()) and len(parts) == 3000
    assert min(seq) == 3 << 38 and sum(sum(n for _, _, n in v) != 256 for v in seq.values()) <= 1
    assert all([o for o, _, _ in sorted(v)] == np.cumsum([0] + [n for _, _, n in sorted(v)])[:-1].tolist() for v in seq.values())
    whole = {i for i, v in parts.items() if len(v) == 1 and sizes[i] <= 256}
    rest = {(s, i): sizes[i] % 256 for (i, at, ids, n), s, _ in done if n % 256 and at == n // 256 * 256 and len(ids) // 4 == n % 256}  # what isn't cut
    for s in {s for _, s, _ in done}:
        here = [rest[s, i] for _, i, _ in seq[s] if (s, i) in rest]
        k = {256 // n for n in here}
        if len(k) == 1:
            assert len(here) == k.pop()
    assert len(whole) > 0.8 * sum(n <= 256 for n in sizes)


def test_packing(spark, docs):
    got = packing.pack_documents(docs, tokenizer(WORD_FILE), capacity=256).collect()
    want = sorted((repr(r.doc_id), np.array([*ids_of(r.text, WORD_FILE), 2], "<u4").tobytes()) for r in docs.collect())
    by, seq = {}, {}
    for p in got:
        assert len(p.ids) == 4 * p.length
        by.setdefault((repr(p.doc_id), p.doc_tokens), []).append((p.start, bytes(p.ids)))
        seq.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for v in seq.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 256
    assert sum(sum(n for _, n in v) < 256 for v in seq.values()) <= docs.rdd.getNumPartitions()  # one padded sequence a task
    flat = [(k[0], b"".join(x for _, x in sorted(v))) for k, v in by.items() if len({s for s, _ in v}) == len(v)]
    assert set(flat) <= set(want) and sum(len(p.ids) for p in got) == sum(len(x) for _, x in want)
    assert packing.pack_documents(docs.limit(0), tokenizer(WORD_FILE)).count() == 0
