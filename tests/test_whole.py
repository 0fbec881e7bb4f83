"""Registered queries on small tables of their own: nothing is left out."""

import json
import unicodedata

import duckdb
import regex
from pyspark.sql import functions as F

from lakeloom.operators import rows, windows
from lakeloom.plans import registry

QUERIES = registry.queries()


def test_unicode_whole_texts(spark, tmp_path):
    texts = ["x" * 70 + "é" + "é" * 3 + " ñ", "plain", "", "ß" * 200 + "ȩ̈" + "\U0001f468‍\U0001f469"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.accents, r.nfc, r.graphemes) for r in QUERIES["fn_string_unicode"](spark, str(tmp_path)).collect()}
    bare = ["".join(c for c in unicodedata.normalize("NFD", x) if not unicodedata.combining(c)) for x in texts]
    assert got == {i: (bare[i], unicodedata.normalize("NFC", x), len(regex.findall(r"\X", x))) for i, x in enumerate(texts)}


def test_all_rows_and_levels(spark, tmp_path):
    spark.createDataFrame([(i, i % 7, "t") for i in range(0, 300, 3)], "event_id long, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(i, i / 4) for i in range(40)], "c_custkey long, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    got = lambda name: sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).collect()), key=repr)
    ids = range(0, 300, 3)
    assert got("unnest_zip") == sorted([(i, a, b) for i in ids for a, b in ((i, "x"), (i % 7, "t"), (3, None))], key=repr)
    assert got("unnest_recursive") == sorted([(i, x) for i in ids for x in (i, i % 7, i % 3, *range(i % 4), *[i % 7] * (i % 5 > 0))], key=repr)
    assert got("ddl_macros") == sorted([(i, i / 2) for i in range(40)], key=repr)


def test_json_structure_reads_all_rows(spark, tmp_path):
    props = ['{"k":69}', '{"k":-1,"a":[1,2.5,null]}', '{"o":{"p":[{"q":1},{"r":"z"}]},"OBJECT<":true}', None, '{"n":null,"b":[]}', "{}", '[1,"a"]', "[1,-2]", '{"a":1,"a":"x"}', "[{},{}]", "[[],[1]]", "18446744073709551616", '[{"a":1},null,{"a":null}]', "[1,9223372036854775808]", "1e400", "[[1],true]", '{"x":{"y":false}}']
    at = f"{tmp_path}/events.parquet"
    spark.createDataFrame(list(enumerate(props)), "event_id long, props string").coalesce(1).write.parquet(at)
    with duckdb.connect() as duck:
        want = dict(duck.sql(f"SELECT event_id, json_structure(props)::VARCHAR FROM '{at}/*.parquet'").fetchall())
    assert {r.event_id: r.structure for r in QUERIES["fn_json_structure_rows"](spark, str(tmp_path)).collect()} == want


def test_json_structure_of_all_rows(spark, tmp_path):
    props = ['{"k":69}'] * 50 + [None, '{"OBJECT<":true}', '{"a":{"b":[1.5,2.5]}}', '{"k":-3,"a":null}', '{"a":{"b":[],"c":{}}}']
    at = f"{tmp_path}/events.parquet"
    spark.createDataFrame(list(enumerate(props)), "event_id long, props string").repartition(4).write.parquet(at)
    with duckdb.connect() as duck:
        want = duck.sql(f"SELECT json_group_structure(props::JSON)::VARCHAR FROM (SELECT * FROM '{at}/*.parquet' ORDER BY event_id)").fetchall()[0][0]
    [row] = QUERIES["fn_json_structure"](spark, str(tmp_path)).collect()
    assert json.loads(row.structure) == json.loads(want)


def test_recursion_with_nulls_ends(spark):
    seed = spark.createDataFrame([(1, None)], "a int, b int")
    step = lambda new: new.select((F.least(F.col("a") + 1, F.lit(3))).alias("a"), "b")
    assert sorted(r.a for r in rows.recursive(seed, step).collect()) == [1, 2, 3]


def test_unbounded_frame_beyond_1000_rows(spark):
    d = spark.range(1500).select("id", F.floor(F.col("id") / 3).alias("k"))
    for exclude, own in (("group", 0), ("ties", 1)):
        got = {r.id: r.s for r in windows.sum_excluding(d, "id", [], ["k"], None, None, "s", exclude).collect()}
        assert got == {i: 1124250 - 3 * (i // 3 * 3 + 1) + own * i for i in range(1500)}
