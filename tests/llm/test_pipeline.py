"""The pipeline against plain versions of its stages."""

from pyspark.sql import functions as F

import corpus_pipeline as c
from lakeloom.llm import pii, simhash


def test_stages(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    more = spark.createDataFrame([(9001, None, None, "s", 0), (9002, "", "en", "s", 0), (9003, "1234 !", "en", "s", 6)], docs.schema)
    docs = docs.unionByName(more).unionByName(docs.limit(3)).withColumn("_lang", F.lit("clash")).withColumn("fingerprint", F.lit(1))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = c.language(spark, at, str(tmp_path))
    assert kept.columns == at.columns and sorted(r.doc_id for r in at.join(kept.select("doc_id").distinct(), "doc_id", "left_anti").collect()) == [9001, 9002, 9003]
    one = c.exact_dedup(spark, kept, str(tmp_path))
    want = {}
    for r in kept.collect():
        want[r.text] = max(want.get(r.text, -1), r.doc_id)
    assert one.columns == at.columns and sorted((r.text, r.doc_id) for r in one.collect()) == sorted(want.items())
    near = c.near_dedup(spark, one, str(tmp_path))
    comp = {r.component_id for r in simhash.near_duplicates(one).collect()}
    assert {r.doc_id for r in near.collect()} == comp and near.count() == len(comp)
    clean = c.personal_data(spark, near, str(tmp_path))
    assert clean.count() == near.count() and clean.where("n_chars <> length(text)").count() == 0
    assert clean.where(r"text rlike '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+'").count() == 0
    out = c.packed(spark, clean, str(tmp_path))
    assert {r.doc_id for r in out.select("doc_id").collect()} == comp
    assert c.run(spark, str(tmp_path)).agg(F.sum("length")).first()[0] == out.agg(F.sum("length")).first()[0]


def test_rows_keep_their_columns(spark):
    """Names that the stages use, a map column, and ids that repeat with other texts."""
    names = ["_lang", "_score", "_base", "_spans", "_row", "c0", "maps", "ids"]
    texts = ["mail me at a@b.example.com or stay", "another text entirely, with words of its own", "mail me at a@b.example.com or stay", None, "third one: +1 (555) 010-7788 is a number"]
    rows = [(i % 3, t, "en", *(f"{n}{i}" for n in names), {"k": str(i)}) for i, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, " + ", ".join(f"{n} string" for n in names) + ", m map<string,string>")
    want = {r[3]: r for r in rows}
    for stage in (c.language, c.exact_dedup, c.near_dedup, c.personal_data):
        got = stage(spark, d, "")
        assert got.columns == d.columns
        for r in got.collect():
            assert r[0] == want[r["_lang"]][0] and tuple(r[3:]) == want[r["_lang"]][3:]
            assert r[1] == (want[r["_lang"]][1] if stage is not c.personal_data or r[1] is None else r[1])
    assert sorted(r["_lang"] for r in c.language(spark, d, "").collect()) == ["_lang0", "_lang1", "_lang2", "_lang4"]
    assert sorted(r["_lang"] for r in c.exact_dedup(spark, d, "").collect()) == ["_lang1", "_lang2", "_lang3", "_lang4"]
    assert sorted(r.text or "" for r in c.personal_data(spark, d, "").collect()) == ["", "another text entirely, with words of its own", *["mail me at <email> or stay"] * 2, "third one: <phone> is a number"]


def test_masks_of_long_texts_take_linear_time():
    text = "x a@b.de 10.0.0.1 " * 30_000
    spans = pii.base_spans(text)
    assert len(spans) == 60_000 and pii.masked(text, spans) == "x <email> <ip> " * 30_000
    assert pii.masked("abcdef", [(0, 1, 3), (1, 2, 4)]) == "a<email>ef"


def test_empty(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert c.run(spark, str(tmp_path)).count() == 0
