"""Registered queries on small tables of their own: what differs from the SQL, or grows, only on larger ones."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lakeloom.api import connect
from lakeloom.operators import windows
from lakeloom.plans import registry

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def compare(spark, tmp_path):
    """Writes tables, gives the rows of a query and those of its SQL."""

    def run(name, **tables):
        c = duckdb.connect()
        c.sql("SET timezone = 'UTC'")
        for t, table in tables.items():
            pq.write_table(table, tmp_path / f"{t}.parquet")
            c.sql(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
        got = QUERIES[name](spark, str(tmp_path))
        want = c.sql(ORACLES[name])
        assert got.columns == [n for n in want.columns]
        return sorted(map(tuple, got.collect()), key=repr), sorted(want.fetchall(), key=repr)

    return run


def test_lateral_limit_keeps_its_order(spark, compare):
    customers = pa.table({"c_custkey": pa.array([1, 2, 3, None], pa.int64())})
    orders = pa.table({"o_orderkey": pa.array([5, None, 4, 8, 7, 9], pa.int64()), "o_custkey": pa.array([1, 1, 1, 2, 2, None], pa.int64()), "o_totalprice": [3.0, 3.0, None, None, 1.0, 2.0]})
    got, want = compare("join_lateral", customer=customers, orders=orders)
    assert got == want == [(1, 5), (2, 7)]
    # on one machine an unordered number still follows the sort; over several executors it doesn't
    window = next(x for x in plan(QUERIES["join_lateral"](spark, "/root/testdata/sf0.001")).split("\n") if "row_number() windowspec" in x)
    assert "DESC NULLS LAST, o_orderkey" in window


def test_doubles_are_rounded_as_in_sql(spark, compare):
    # 5622.12 / 22400 is 0.2509875 in decimals, but the product with a million is just below a half
    customers = pa.table({"c_custkey": pa.array([22399, 5, 6, 7, 8], pa.int64()), "c_acctbal": [5622.12, 0.00000049999999999999996, 1e305, -2.5, None]})
    got, want = compare("fn_math_transcendental", customer=customers)
    assert got == want
    customers = customers.set_column(1, "c_acctbal", pa.array([5622.12, 4.35, -1234.56, -2.5, None]))
    got, want = compare("fn_math_basic", customer=customers)
    assert got == want
    assert [r[4] for r in got if r[0] == 22399] == [0.250987]


def test_rounding_bit_by_bit(spark, tmp_path):
    from lakeloom.functions.numbers import rounded

    values = [n / 1e7 * 5 for n in range(-3000, 3000)] + [k / 100 / (7 * k % 4096 + 1) for k in range(1, 3000)] + [0.0, -0.0, -1e-9, 1e305, -1e305, float("inf"), float("-inf"), float("nan"), 0.49999999999999994, 2.5, -2.5, None]
    pq.write_table(pa.table({"x": values}), tmp_path / "x.parquet")
    got = spark.read.parquet(str(tmp_path)).selectExpr("x", *[f"{rounded('x', n)} AS r{n}" for n in (0, 1, 6)]).toArrow()
    want = duckdb.connect().sql(f"SELECT x, round(x, 0) AS r0, round(x, 1) AS r1, round(x, 6) AS r6 FROM '{tmp_path}/x.parquet'").fetchall()
    assert sorted(map(repr, zip(*got.to_pydict().values(), strict=True))) == sorted(map(repr, want))


def test_no_frame_goes_through_the_rest_of_its_partition_for_each_row(spark, compare):
    customers = pa.table({"c_custkey": pa.array([1, 2, None, 4, 5, 6, 7], pa.int64()), "c_nationkey": pa.array([1, 1, 1, 1, None, None, 2], pa.int32()), "c_acctbal": [5.0, None, 5.0, 7.5, -1.0, 3.0, 0.0]})
    got, want = compare("win_nth_value", customer=customers)
    assert got == want
    p = plan(QUERIES["win_nth_value"](spark, "/root/testdata/sf0.001"))
    assert "currentrow$(), unboundedfollowing$()" not in p and p.count("Window [") == 1


@pytest.mark.parametrize("exclude", ["current row", "group", "ties"])
@pytest.mark.parametrize("before", [0, 2])
def test_sums_to_an_open_end_are_running_sums(spark, exclude, before):
    data = [(i, i // 3, None if i % 7 == 0 else i) for i in range(60)]
    got = windows.sum_excluding(spark.createDataFrame(data, "i int, k int, v int"), "v", [], ["k", "i"] if exclude == "current row" else ["k"], before, None, "s", exclude)
    assert "unboundedfollowing$()" not in plan(got)
    if exclude == "current row":
        want = {i: sum(v for j, _, v in data if j >= i - before and j != i and v is not None) for i, _, _ in data}
    elif before == 0:
        want = {i: sum(v for _, p, v in data if p > k and v is not None) + (v or 0) * (exclude == "ties") for i, k, v in data}
    else:
        return  # which peers are in the frame is left open
    assert {r.i: r.s or 0 for r in got.collect()} == want


def test_ranks_are_rounded_as_in_sql(spark, compare):
    n = 640  # 201 / 3200 and the like end in a 5 at the seventh place
    customers = pa.table({"c_custkey": pa.array(range(n), pa.int64()), "c_nationkey": pa.array([0] * n, pa.int32()), "c_acctbal": [float(i) for i in range(n)], "c_mktsegment": ["A"] * n})
    got, want = compare("win_rank_per_nation", customer=customers)
    assert got == want


def test_averages_of_groups_are_rounded_as_in_sql(spark, compare):
    lines = pa.table({"l_partkey": pa.array([1, 2, 3], pa.int64()), "l_quantity": [1.0, 2.0, None], "l_discount": [5622.12 / 22400, 0.05, None]})
    got, want = compare("groupby_3", lineitem=lines)
    assert got == want and got[0][2] == 0.250987


@pytest.mark.parametrize(
    "text",
    [
        "SELECT c_custkey, o.o_orderkey FROM customer, LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) o",
        "SELECT c_custkey, o.k FROM customer, LATERAL (SELECT o_orderkey + 1 AS k FROM orders WHERE o_custkey = c_custkey ORDER BY k DESC LIMIT 1) o",
        "SELECT c_custkey, o.* FROM customer, LATERAL (SELECT o_orderstatus AS s, count(*) AS n FROM orders WHERE o_custkey = c_custkey GROUP BY o_orderstatus ORDER BY max(o_totalprice) % 1000, 1 LIMIT 1) o",
        "SELECT c_custkey, (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice ** 2 DESC, orders.o_orderkey LIMIT 1) AS k FROM customer",
        "SELECT k, count(*) AS n FROM (FROM orders SELECT o_orderstatus AS k ORDER BY o_totalprice, o_orderkey LIMIT 50) t GROUP BY k",
        "SELECT count(*) AS n FROM (SELECT * FROM orders ORDER BY o_totalprice + 1, o_orderkey LIMIT 50) t WHERE o_orderkey IN (SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 700)",
    ],
)
def test_statements_with_a_limit_inside(spark, text):
    sf = "/root/testdata/sf0.001"
    con, duck = connect(spark), duckdb.connect()
    for t in ("customer", "orders"):
        con.read_parquet(f"{sf}/{t}.parquet").create_view(t)
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = con.sql(text)
    want = duck.sql(text)
    assert got.columns == list(want.columns) and sorted(got.fetchall(), key=repr) == sorted(want.fetchall(), key=repr)
    assert all(" ASC NULLS" in x or " DESC NULLS" in x for x in plan(got.spark()).split("\n") if "row_number() windowspec" in x)
