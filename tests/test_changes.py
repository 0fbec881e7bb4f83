"""Statements that change rows, and the DB-API face."""

import pytest

from lakeloom import dbapi
from lakeloom.api import connect


@pytest.fixture(params=["view", "table"])
def con(request, spark):
    c = connect(spark)
    rows = spark.createDataFrame([(1, "a", 10.0), (2, "b", None), (3, None, 30.0)], "k int, s string, v double")
    spark.sql("DROP VIEW IF EXISTS changed") if request.param == "table" else spark.sql("DROP TABLE IF EXISTS changed")
    if request.param == "view":
        rows.createOrReplaceTempView("changed")
    else:
        rows.write.mode("overwrite").saveAsTable("changed")
    spark.createDataFrame([(1, 5.0), (3, 7.0), (3, 7.0)], "id int, w double").createOrReplaceTempView("other")
    yield c
    spark.sql("DROP VIEW IF EXISTS changed" if request.param == "view" else "DROP TABLE IF EXISTS changed")


def held(con):
    return sorted(con.sql("SELECT * FROM changed").fetchall(), key=repr)


def test_update(con):
    assert con.sql("UPDATE changed SET v = v + 1, s = 'x' WHERE v > 5").fetchall() == [(2,)]
    assert held(con) == [(1, "x", 11.0), (2, "b", None), (3, "x", 31.0)]
    assert sorted(con.sql("UPDATE changed SET v = w FROM other WHERE k = id RETURNING k, v * 2 AS d").fetchall()) == [(1, 10.0), (3, 14.0)]
    assert held(con) == [(1, "x", 5.0), (2, "b", None), (3, "x", 7.0)]


def test_delete_and_truncate(con):
    assert con.sql("DELETE FROM changed WHERE v > 20 RETURNING k").fetchall() == [(3,)]
    assert held(con) == [(1, "a", 10.0), (2, "b", None)]
    assert con.sql("DELETE FROM changed USING other WHERE k = id").fetchall() == [(1,)]
    assert held(con) == [(2, "b", None)]
    con.sql("TRUNCATE changed").fetchall()
    assert held(con) == []


def test_insert(con):
    assert con.sql("INSERT INTO changed (k, v) VALUES (4, 40) RETURNING k, s, v").fetchall() == [(4, None, 40.0)]
    con.sql("INSERT INTO changed SELECT k + 10, s, v FROM changed WHERE k = 1").fetchall()
    assert held(con) == [(1, "a", 10.0), (11, "a", 10.0), (2, "b", None), (3, None, 30.0), (4, None, 40.0)]


def test_cursor(spark):
    with dbapi.connect(spark) as c:
        cur = c.cursor()
        cur.execute("SELECT x, x * 2 AS y FROM generate_series(1, 5) t(x) WHERE x >= ? ORDER BY x", [2])
        assert [d[0] for d in cur.description] == ["x", "y"]
        assert cur.fetchone() == (2, 4) and cur.fetchmany(2) == [(3, 6), (4, 8)] and cur.fetchall() == [(5, 10)] and cur.fetchone() is None
        with pytest.raises(dbapi.DatabaseError):
            cur.execute("SELECT nothing FROM nowhere")
        with pytest.raises(dbapi.NotSupportedError):
            c.rollback()
