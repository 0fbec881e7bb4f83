"""Operators on small fixtures: edges that the tables don't hold."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lakeloom.functions import lists, text
from lakeloom.operators import joins, rows, windows


def test_asof_edges(spark):
    a = spark.createDataFrame([(1, 5), (1, None), (None, 5), (2, 0)], "k int, x int")
    b = spark.createDataFrame([(1, 5, "same"), (1, 4, "before"), (1, None, "null"), (None, 1, "nullkey")], "k int, y int, z string")
    got = {(r.k, r.x): r.z for r in joins.asof_join(a, b, "x", "y", ["k"], ">=").collect()}
    assert got[(1, 5)] == "same" and got[(1, None)] is None and got[(2, 0)] is None
    strict = {(r.k, r.x): r.z for r in joins.asof_join(a, b, "x", "y", ["k"], ">").collect()}
    assert strict[(1, 5)] == "before"
    with pytest.raises(ValueError):
        joins.asof_join(a, b, "x", "y", ["k"], "=")


def test_asof_buckets_agree(spark):
    a = spark.range(200).select((F.col("id") % 3).alias("k"), (F.col("id") * 7 % 101).cast("double").alias("x"), F.col("id").alias("i"))
    b = spark.range(40).select((F.col("id") % 3).alias("k"), (F.col("id") * 13 % 97).cast("double").alias("y"), F.col("id").alias("j"))
    for op in (">=", ">", "<=", "<"):
        plain, dealt = (sorted((r.i, r.y) for r in joins.asof_join(a, b, "x", "y", ["k"], op, "left", w).collect()) for w in (None, 10.0))
        assert repr(plain) == repr(dealt)


def test_range_join_lengths(spark):
    p = spark.range(100).select(F.col("id").cast("double").alias("x"))
    r = spark.createDataFrame([(0.0, 90.0), (5.0, 5.0), (7.5, 9.0), (20.0, 10.0)], "a double, b double")
    got = sorted((x.x, x.a) for x in joins.range_join(p, r, "x", "a", "b", 2.0).collect())
    want = sorted((float(x), a) for x in range(100) for a, b in ((0.0, 90.0), (5.0, 5.0), (7.5, 9.0)) if a <= x <= b)
    assert got == want


def test_interval_join_once(spark):
    a = spark.createDataFrame([(0, 100), (50, 60), (7, 7)], "s int, e int")
    b = spark.createDataFrame([(10, 20), (100, 200), (60, 61)], "u int, v int")
    got = sorted((r.s, r.u) for r in joins.interval_join(a, b, ("s", "e"), ("u", "v"), 9.0).collect())
    assert got == [(0, 10), (0, 60), (0, 100), (50, 60)]


def test_lists_and_text(spark):
    d = spark.createDataFrame([([3, 1, None],)], "l array<int>")
    r = d.select(lists.extract(F.col("l"), 0).alias("z"), lists.total(F.col("l")).alias("t"), lists.median(F.col("l")).alias("m"), text.jaro_similarity(F.lit(""), F.lit("a")).alias("j")).first()
    assert (r.z, r.t, r.m, r.j) == (None, 4.0, 2.0, 0.0)


def test_upsert_and_recursion(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d"), (3, "e")], "k int, v string")
    assert sorted(map(tuple, rows.upsert(base, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "e")]
    got = rows.recursive(spark.createDataFrame([(0,)], "k int"), lambda n: n.select(((F.col("k") + 2) % 7).cast("int").alias("k")))
    assert sorted(r.k for r in got.collect()) == list(range(7))


def test_interval_join_of_any_lengths(spark):
    r = random.Random(2)
    make = lambda n: [(i, a := r.uniform(0, 1000), a + r.choice([0, 0.5, 3, 40, 900])) for i in range(n)]
    a, b = make(150), make(120) + [(999, 5.0, 1.0), (998, None, 3.0)]
    x, y = spark.createDataFrame(a, "i int, a double, b double"), spark.createDataFrame(b, "k int, c double, d double")
    got = sorted((q.i, q.k) for q in joins.interval_join(x, y, ("a", "b"), ("c", "d"), 2.0).collect())
    assert got == sorted((i, k) for i, p, q in a for k, s, e in b if s is not None and s <= e and p <= e and s <= q)


@pytest.mark.parametrize("exclude", ["group", "ties"])
@pytest.mark.parametrize(("before", "after"), [(2, 1), (None, 0), (0, None), (None, None)])
def test_sums_without_peers(spark, exclude, before, after):
    r = random.Random(4)
    data = [(i, i % 3, r.choice([None, *range(4)]), r.choice([None, *range(20)])) for i in range(90)]
    d = spark.createDataFrame(data, "i int, g int, k int, v int")
    got = windows.sum_excluding(d, "v", ["g"], ["k"], before, after, "s", exclude).withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy("k"))).collect()
    for g in range(3):
        part = sorted((x for x in got if x.g == g), key=lambda x: x.n)
        for p, x in enumerate(part):
            frame = part[0 if before is None else max(0, p - before) : len(part) if after is None else p + after + 1]
            kept = [y.v for y in frame if (y.k != x.k or exclude == "ties" and y.i == x.i) and y.v is not None]
            assert x.s == (sum(kept) if kept else None)
