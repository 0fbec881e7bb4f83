"""Plans of the registered queries: what is pushed down, and what isn't in them."""

import pytest

from lakeloom.plans import registry

SF = "/root/testdata/sf0.001"
QUERIES = registry.queries()
HEADLINE = [n for n in QUERIES if n.startswith(("tpch_", "groupby_", "joinbench_", "join_range", "join_interval", "join_asof", "set_", "dialect_asof"))]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", HEADLINE)
def test_no_cartesian_product_and_no_python(spark, name):
    p = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in p and "EvalPython" not in p and "MapIn" not in p


def test_scans_read_what_is_needed(spark):
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    p = QUERIES["tpch_q6"](spark, SF)._jdf.queryExecution().explainString(mode)
    assert "GreaterThanOrEqual(l_shipdate" in p and "LessThan(l_quantity" in p and "l_orderkey" not in p
    p = plan(QUERIES["dialect_star_replace"](spark, SF).select("c_acctbal"))
    assert "ReadSchema: struct<c_acctbal:double>" in p


def test_runtime_filter_reaches_the_large_side(spark):
    confs = {"spark.sql.optimizer.runtime.bloomFilter.enabled": "true", "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "1", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in confs}
    try:
        for k, v in confs.items():
            spark.conf.set(k, v)
        lines, orders = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("lineitem", "orders"))
        df = lines.join(orders.where("o_orderstatus = 'P'"), lines.l_orderkey == orders.o_orderkey)
        assert "might_contain" in df._jdf.queryExecution().optimizedPlan().toString()
        assert df.count() == lines.join(orders.where("o_orderstatus = 'P'").select("o_orderkey"), lines.l_orderkey == orders.o_orderkey, "left_semi").count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
