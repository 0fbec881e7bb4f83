"""Training-data operators: nothing that lies beyond a window, a sample or an id is lost."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lakeloom.llm import forest, langid, pii, simhash


class Letters:
    """Tags everything but blanks as e-mail; a span begins after a blank, so that no window has to guess."""

    def decode(self, x):
        word = (x != pii.symbols(" ")[0]) & (x != 0)
        begins = word & ~np.concatenate([np.zeros((len(x), 1), bool), word[:, :-1]], 1)
        begins[:, 0] = False
        return np.where(begins, 1, np.where(word, 2, 0))


@pytest.mark.parametrize("at", [0, 16, 17, 40, 95, 96, 111, 112, 127, 300])
@pytest.mark.parametrize("local, domain", [(3, 40), (60, 30), (5, 300), (400, 5), (250, 250)])
def test_added_spans_reach_beyond_windows(at, local, domain):
    mail = "l" * local + "@" + "ü" * domain + ".de"
    text = "ab " * 70 + " " * at + mail + " " + "cd " * 90
    start = text.index(mail)
    kept, pii_plausible = [], pii.plausible
    pii.plausible = lambda kind, s: True
    try:
        [kept] = pii.added_spans([text], Letters(), [[]])
    finally:
        pii.plausible = pii_plausible
    assert kept == [(0, start, start + len(mail))]


def test_training_windows_from_the_whole_document():
    text = "".join(f"{'a' * (i % 14 + 1)} {'b' * (i // 14 + 1)} {i} {'word ' * 30}" for i in range(200))
    every, some = pii.training_windows(text), pii.chosen_windows(text)
    place = [next(i for i, (x, _) in enumerate(every) if (x == w).all()) for w, _ in some]
    assert len(some) == pii.DOCUMENT_WINDOWS and max(place) > len(every) // 2
    assert len(pii.chosen_windows("call 1 or " + "a " * 200 + "2")) == 2


def test_rare_language_is_learned(spark):
    words = {"en": "the cat and dog with house", "fi": "yhdessä äiti isä hyvää päivää", "rare": "žluťoučký kůň příšerně úpěl ďábelské"}
    lang = lambda i: "rare" if i == 777 else "en" if i % 3 else "fi"
    d = spark.createDataFrame([(i, " ".join(sorted(words[lang(i)].split(), key=lambda w: hash((w, i)))), lang(i)) for i in range(2000)], "doc_id long, text string, lang string")
    for key in (F.col("doc_id"), F.lit(None).cast("long")):
        m = langid.train(d, "text", "lang", F.coalesce(key, F.lit(-1)), 100)
        assert m["classes"] == ["en", "fi", "rare"]
    m = langid.train(d, "text", "lang", F.col("doc_id"), 100)
    assert {r.lang_pred for r in langid.predict(d.where("doc_id = 777"), m, "text").collect()} == {"rare"}


def test_least_score_follows_the_number_of_languages():
    got = [corpus_pipeline.least_score(k) for k in (1, 2, 4, 10)]
    assert got[0] == 1 and got == sorted(got, reverse=True) and abs(got[2] - corpus_pipeline.LEAST_SCORE) < 1e-12
    assert all(x > 1 / k for x, k in zip(got[1:], (2, 4, 10), strict=True))


def test_near_dedup_by_rows(spark):
    r = random.Random(4)
    make = lambda: " ".join(f"v{r.randrange(5000)}" for _ in range(400))
    near = lambda t: " ".join(["edit", *t.split()[1:]])
    a, b, c, d, e = (make() for _ in range(5))
    rows = [(1, a), (5, near(a)), (5, b), (None, c), (None, near(c)), (None, near(a)[:-3]), (7, d), (7, near(d)), (8, e), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fingerprint", F.lit(1))
    got = corpus_pipeline.near_dedup(spark, docs, "")
    kept = [(x.doc_id, x.text) for x in got.collect()]
    fp = [simhash.fingerprint(t) for _, t in rows]
    alike = lambda i, j: bin(fp[i] ^ fp[j]).count("1") <= simhash.DIFFER
    assert alike(0, 1) and alike(0, 5) and alike(3, 4) and alike(6, 7) and not alike(2, 0)
    assert got.columns == docs.columns and len(kept) == 6
    assert {(1, a), (5, b), (8, e), (None, "")} <= set(kept) and sum(i == 7 for i, _ in kept) == 1 and len({c, near(c)} & {t for _, t in kept}) == 1


def test_simhash_links_over_null_ids(spark):
    r = random.Random(6)
    bits = r.sample(range(64), 8)
    base = r.getrandbits(64)
    far = lambda k: base ^ sum(1 << x for x in bits[:k])
    prints = {"one": far(0), "between": far(4), "two": far(8), "again": far(0) ^ 0xFFFF0000FFFF}
    d = spark.createDataFrame([(3, "one"), (None, "between"), (4, "two"), (4, "again")], "doc_id long, text string")
    plain, simhash.fingerprint = simhash.fingerprint, lambda t, words, seed: prints[t]
    try:
        with_prints = {x.fingerprint: x.component_id for x in simhash.near_duplicates(d).collect()}
    finally:
        simhash.fingerprint = plain
    assert [with_prints[f"{prints[k]:016x}"] for k in ("one", "between", "two", "again")] == [3, 3, 3, 4]


def test_forest_gives_k_of_few_close_vectors(spark):
    r = np.random.default_rng(1)
    close, apart = r.standard_normal(8), r.standard_normal((40, 8))
    rows = [(i, (close + 1e-6 * i * apart[i % 40]).tolist()) for i in range(1, 9)] + [(10 + i, v.tolist()) for i, v in enumerate(apart)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = forest.nearest(d, d).groupBy("query_id").count().collect()
    assert len(got) == 48 and {x["count"] for x in got} == {20}
