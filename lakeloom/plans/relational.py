"""Queries of the relational operators."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from lakeloom.functions.numbers import rounded
from lakeloom.operators import joins, rows, windows
from lakeloom.plans.registry import query, sql
from lakeloom.session import table as t
from lakeloom.session import views

# scans, projections, predicates
sql("scan_pushdown", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 49 AND l_returnflag = 'R'")
sql("dummy_scan", "SELECT 1 AS one, 'a' AS a")
sql("values_scan", "SELECT * FROM (VALUES (1, 'x'), (2, 'y'), (3, NULL)) AS v(i, s)")
sql("empty_result", "SELECT r_name FROM region WHERE 1 = 0")
sql("range_scan", "SELECT id AS i FROM range(3, 30, 4)", "SELECT range AS i FROM range(3, 30, 4)")
sql("series_timestamps", "SELECT explode(sequence(TIMESTAMP_NTZ '2024-01-01 00:00:00', TIMESTAMP_NTZ '2024-01-02 00:00:00', INTERVAL 6 HOURS)) AS ts", "SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-02', INTERVAL 6 HOUR)) AS ts")
sql("repeat_rows", "SELECT r_name, i AS i FROM region LATERAL VIEW explode(sequence(1, 3)) s AS i", "SELECT r_name, i::INTEGER AS i FROM region, range(1, 4) s(i)")
sql("project_case", "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS code FROM orders")
sql("predicates_distinct_from", "SELECT o_orderkey FROM orders WHERE nullif(o_orderstatus, 'F') IS NOT DISTINCT FROM NULL AND o_orderpriority IS DISTINCT FROM '1-URGENT'")
sql("predicates_three_valued", "SELECT c_custkey, (nullif(c_nationkey, 3) > 5 OR c_acctbal > 0) AS a, NOT (nullif(c_nationkey, 3) > 5) AS b, coalesce(nullif(c_nationkey, 3), -1) AS c FROM customer")
sql("predicates_in_between", "SELECT p_partkey FROM part WHERE p_size IN (1, 5, 9, 13) AND p_retailprice BETWEEN 900 AND 1100 AND p_brand NOT IN ('Brand#1', 'Brand#2')")
sql("predicates_not_in_null", "SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT nullif(n_nationkey, 3) FROM nation WHERE n_regionkey = 1)")
sql("predicates_like", "SELECT p_partkey, p_name LIKE '%widget%' AS a, p_name ILIKE 'COLD%' AS b, p_name LIKE '_old%' AS c, p_name LIKE 'a#%%' ESCAPE '#' AS d, p_name RLIKE '^(cold|small)' AS e FROM part",
    "SELECT p_partkey, p_name LIKE '%widget%' AS a, p_name ILIKE 'COLD%' AS b, p_name LIKE '_old%' AS c, p_name LIKE 'a#%%' ESCAPE '#' AS d, regexp_matches(p_name, '^(cold|small)') AS e FROM part")
sql("predicates_glob_similar", "SELECT p_partkey, p_name RLIKE '^[cs].*widget$' AS g, p_name RLIKE '^(?:cold .*|small .*)$' AS s FROM part", "SELECT p_partkey, p_name GLOB '[cs]*widget' AS g, p_name SIMILAR TO 'cold .*|small .*' AS s FROM part")
sql("cast_try_cast", "SELECT o_orderkey, CAST(o_totalprice AS STRING) AS s, try_cast(substr(o_orderpriority, 1, 1) AS INT) AS i, try_cast(o_orderpriority AS INT) AS n, CAST(o_orderdate AS DATE) AS d FROM orders",
    "SELECT o_orderkey, CAST(o_totalprice AS VARCHAR) AS s, TRY_CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS i, TRY_CAST(o_orderpriority AS INTEGER) AS n, CAST(o_orderdate AS DATE) AS d FROM orders")
sql("star_exclude", "SELECT * EXCEPT (c_name, c_acctbal) FROM customer", "SELECT * EXCLUDE (c_name, c_acctbal) FROM customer")
sql("collate_nocase", "SELECT n_name FROM nation WHERE n_name COLLATE UTF8_LCASE = 'nation_7'", "SELECT n_name FROM nation WHERE n_name COLLATE NOCASE = 'nation_7'")
sql("lateral_alias", "SELECT l_orderkey, l_linenumber, l_quantity * 2 AS twice, twice + 1 AS more FROM lineitem WHERE l_linenumber = 1")


@query("SELECT * REPLACE (round(c_acctbal * 2, 2) AS c_acctbal) RENAME (c_name AS label) FROM customer")
def star_replace_rename(spark, d):
    return rows.star(t(spark, d, "customer"), replace={"c_acctbal": F.round(F.col("c_acctbal") * 2, 2)}, rename={"c_name": "label"})


@query("SELECT min(COLUMNS('^p_.*(size|price)$')) FROM part")
def star_columns(spark, d):
    p = t(spark, d, "part")
    return p.agg(*rows.columns(p, "^p_.*(size|price)$", F.min)).toDF("p_size", "p_retailprice")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 200000 AND o_orderstatus = 'F'")
def parameters(spark, d):
    views(spark, d, "orders")
    return spark.sql("SELECT o_orderkey FROM orders WHERE o_totalprice > :low AND o_orderstatus = :status", args={"low": 200000, "status": "F"})


@query("SELECT r_regionkey, r_name FROM region")
def query_table(spark, d):
    views(spark, d, "region")
    return spark.table("region")


@query("SELECT user_id, x FROM (SELECT user_id, unnest([event_id, user_id]) AS x FROM events)")
def unnest_list(spark, d):
    return t(spark, d, "events").select("user_id", F.explode(F.array("event_id", "user_id")).alias("x"))


@query("SELECT event_id, unnest([event_id, user_id, 3]) AS a, unnest(['x', event_type]) AS b FROM events")
def unnest_zip(spark, d):
    """All rows, with lists of different lengths built from columns: the shorter one is filled up with nulls."""
    z = F.arrays_zip(F.array("event_id", "user_id", F.lit(3)).alias("a"), F.array(F.lit("x"), F.col("event_type")).alias("b"))
    return t(spark, d, "events").select("event_id", F.inline(z))


@query("PIVOT (SELECT o_orderpriority, o_orderstatus, o_totalprice FROM orders) ON o_orderstatus IN ('F', 'O', 'P') USING count(*) GROUP BY o_orderpriority")
def pivot_status_by_priority(spark, d):
    return rows.pivot(t(spark, d, "orders"), "o_orderstatus", ["F", "O", "P"], ["o_orderpriority"], n=F.count(F.lit(1))).na.fill(0)


@query("UNPIVOT (SELECT s_suppkey, s_acctbal, CAST(s_nationkey AS DOUBLE) AS s_nation FROM supplier) ON s_acctbal, s_nation INTO NAME name VALUE value")
def unpivot_supplier(spark, d):
    s = t(spark, d, "supplier").select("s_suppkey", "s_acctbal", F.col("s_nationkey").cast("double").alias("s_nation"))
    return rows.unpivot(s, ["s_suppkey"], ["s_acctbal", "s_nation"])


@query("SELECT event_id, length(event_type) AS n FROM events")
def inout_function(spark, d):
    import pyarrow.compute as pc

    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pc.cast(pc.utf8_length(b.column(1)), pa.int64())], names=["event_id", "n"])

    return t(spark, d, "events").select("event_id", "event_type").mapInArrow(run, "event_id long, n long")


# joins
J = {"inner": "JOIN", "left": "LEFT JOIN", "right": "RIGHT JOIN", "full": "FULL JOIN"}
for kind, words in J.items():
    sql(f"join_{kind}", f"SELECT c_custkey, o_orderkey FROM (SELECT * FROM customer WHERE c_acctbal > 2000) c {words} (SELECT * FROM orders WHERE o_totalprice > 150000) o ON c_custkey = o_custkey AND o_orderstatus <> 'P'")
sql("join_left_null_count", "SELECT count(*) AS n, count(o_orderkey) AS matched FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000")
sql("join_semi_orders", "SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000", "SELECT c_custkey FROM customer SEMI JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) o ON c_custkey = o_custkey")
sql("join_anti_customers", "SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey FROM customer ANTI JOIN orders ON c_custkey = o_custkey")
sql("join_cross", "SELECT r_name, n_nationkey FROM region CROSS JOIN nation")
sql("join_natural", "SELECT k, a, b FROM (SELECT n_regionkey AS k, n_name AS a FROM nation) x NATURAL JOIN (SELECT r_regionkey AS k, r_name AS b FROM region) y")
sql("join_using", "SELECT k, a, b FROM (SELECT n_regionkey AS k, n_name AS a FROM nation) x JOIN (SELECT r_regionkey AS k, r_name AS b FROM region) y USING (k)")
sql("join_null_safe", "SELECT a.c_custkey AS x, n_name FROM customer a JOIN nation ON nullif(c_nationkey, 3) <=> nullif(n_nationkey, 3)", "SELECT a.c_custkey AS x, n_name FROM customer a JOIN nation ON nullif(c_nationkey, 3) IS NOT DISTINCT FROM nullif(n_nationkey, 3)")
sql("join_theta", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_nationkey + b.n_nationkey < 12 AND a.n_regionkey <> b.n_regionkey")
sql("join_inequality", "SELECT s_suppkey, n_nationkey FROM supplier JOIN nation ON s_nationkey < n_nationkey WHERE s_acctbal > 5000")
# the price must come out of the query with the LIMIT: else Spark puts a projection between LIMIT and sort, and numbers rows without the order
sql("join_lateral", "SELECT c_custkey, o.o_orderkey FROM customer, LATERAL (SELECT o_orderkey FROM (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey NULLS LAST LIMIT 1)) o",
    "SELECT c_custkey, o.o_orderkey FROM customer, LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) o")
sql("join_scalar_subquery", "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS top FROM customer")
sql("join_exists", "SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 49) AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_discount > 0.095)")


@query("SELECT c_custkey, c_nationkey IN (SELECT nullif(n_nationkey, 3) FROM nation WHERE n_regionkey < 3) AS mark FROM customer")
def join_mark(spark, d):
    n = t(spark, d, "nation").where("n_regionkey < 3").select(F.expr("nullif(n_nationkey, 3)").alias("k"))
    return joins.mark_join(t(spark, d, "customer").select("c_custkey", "c_nationkey"), n, "c_nationkey", "k").drop("c_nationkey")


@query("SELECT n_nationkey, (SELECT r_name FROM region WHERE r_regionkey = n_regionkey) AS region_name FROM nation")
def join_single(spark, d):
    r = t(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    return joins.single_join(t(spark, d, "nation").select("n_nationkey", "n_regionkey"), r, ["n_regionkey"], "r_name", "region_name").drop("n_regionkey")


@query("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000) AS n FROM customer")
def join_delim(spark, d):
    o = t(spark, d, "orders").where("o_totalprice > 100000")
    inner = lambda k: k.join(o, k.c_custkey == o.o_custkey, "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))
    return joins.delim_join(t(spark, d, "customer").select("c_custkey"), ["c_custkey"], inner)


BANDS = "(SELECT CAST(i AS INTEGER) AS band, 900.0 + i * 7 AS low, 900.0 + i * 7 + 3 * i AS high FROM range(0, 40) r(i)) b"


@query(f"SELECT p_partkey, band FROM part JOIN {BANDS} ON p_retailprice BETWEEN CAST(low AS DOUBLE) AND CAST(high AS DOUBLE)")
def join_range_price_band(spark, d):
    b = spark.range(40).select(F.col("id").cast("int").alias("band"), (F.lit(900.0) + F.col("id") * 7).alias("low"), (F.lit(900.0) + F.col("id") * 10).alias("high"))
    return joins.range_join(t(spark, d, "part").select("p_partkey", "p_retailprice"), b, "p_retailprice", "low", "high", 8.0).select("p_partkey", "band")


SPANS = "SELECT user_id, min(event_id) AS a, min(event_id) + 40 AS b FROM events WHERE user_id % 2 = {} GROUP BY user_id"


@query(f"SELECT x.user_id AS u, y.user_id AS v FROM ({SPANS.format(0)}) x JOIN ({SPANS.format(1)}) y ON x.a <= y.b AND y.a <= x.b")
def join_interval_sessions(spark, d):
    e = t(spark, d, "events")
    side = lambda k, n: e.where(f"user_id % 2 = {k}").groupBy("user_id").agg(F.min("event_id").alias(f"{n}a")).select(F.col("user_id").alias(n), f"{n}a", (F.col(f"{n}a") + 40).alias(f"{n}b"))
    return joins.interval_join(side(0, "u"), side(1, "v"), ("ua", "ub"), ("va", "vb"), 50.0).select("u", "v")


ASOF = """SELECT c.event_id AS event_id, e.event_id AS error_id FROM (SELECT * FROM events WHERE event_type = 'click') c ASOF {} JOIN
 (SELECT * FROM events WHERE event_type = 'error') e ON c.user_id = e.user_id AND c.ts {} e.ts"""


def _asof(spark, d, op, how, bucket=None):
    e = t(spark, d, "events")
    r = e.where("event_type = 'error'").select("user_id", F.col("ts").alias("error_ts"), F.col("event_id").alias("error_id"))
    return joins.asof_join(e.where("event_type = 'click'").select("event_id", "user_id", "ts"), r, "ts", "error_ts", ["user_id"], op, how, bucket).select("event_id", "error_id")


@query(ASOF.format("LEFT", ">="))
def join_asof_prev_error(spark, d):
    return _asof(spark, d, ">=", "left")


@query(ASOF.format("", "<="))
def join_asof_next_error(spark, d):
    return _asof(spark, d, "<=", "inner")


@query(ASOF.format("LEFT", ">"))
def join_asof_buckets(spark, d):
    return _asof(spark, d, ">", "left", 6 * 3600.0)


@query("SELECT * FROM (SELECT r_name FROM region ORDER BY r_regionkey) POSITIONAL JOIN (SELECT n_name FROM nation ORDER BY n_nationkey)")
def join_positional(spark, d):
    return joins.positional_join(t(spark, d, "region").select("r_name", "r_regionkey"), t(spark, d, "nation").select("n_name", "n_nationkey"), ["r_regionkey"], ["n_nationkey"]).select("r_name", "n_name")


# aggregation
sql("agg_global", "SELECT count(*) AS n, round(sum(l_quantity), 2) AS q, min(l_shipdate) AS a, max(l_shipdate) AS b FROM lineitem")
sql("agg_cube_flag_status", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_returnflag) AS BIGINT) AS g FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
sql("agg_rollup_region_nation", "SELECT r_name, n_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
sql("agg_grouping_sets", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
sql("agg_grouping_id", "SELECT o_orderstatus, o_orderpriority, CAST(grouping_id(o_orderstatus, o_orderpriority) AS BIGINT) AS g, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
sql("agg_filter", "SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 25) AS big, round(sum(l_extendedprice) FILTER (WHERE l_discount > 0.05), 2) AS s FROM lineitem GROUP BY l_returnflag")
sql("agg_distinct", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS c, count(DISTINCT o_orderpriority) AS p, count(DISTINCT o_custkey, o_orderpriority) AS cp FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS c, count(DISTINCT o_orderpriority) AS p, count(DISTINCT (o_custkey, o_orderpriority)) AS cp FROM orders GROUP BY o_orderstatus")
sql("agg_group_by_all", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
sql("agg_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND sum(o_totalprice) > 100000")
sql("agg_string_agg", "SELECT n_regionkey, listagg(n_name, ';') WITHIN GROUP (ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ';' ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey")
sql("agg_list_ordered", "SELECT n_regionkey, array_join(transform(array_sort(collect_list(struct(n_name, n_nationkey))), x -> CAST(x.n_nationkey AS STRING)), ',') AS keys FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, array_to_string(list(n_nationkey ORDER BY n_name), ',') AS keys FROM nation GROUP BY n_regionkey")
sql("agg_min_n", "SELECT o_orderstatus, array_join(transform(slice(sort_array(collect_list(o_totalprice)), 1, 3), x -> CAST(x AS STRING)), ',') AS low FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, array_to_string(min(o_totalprice, 3), ',') AS low FROM orders GROUP BY o_orderstatus")
sql("agg_histogram_map", "SELECT concat_ws(',', transform(array_sort(map_entries(map_from_entries(collect_list(struct(o_orderpriority, n))))), e -> concat(e.key, '=', CAST(e.value AS STRING)))) AS h FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority)", "SELECT array_to_string(list_transform(map_entries(histogram(o_orderpriority)), lambda e: concat(e.key, '=', e.value)), ',') AS h FROM orders")
sql("agg_partitioned", "SELECT l_orderkey, count(*) AS n, round(max(q), 2) AS q FROM (SELECT l_orderkey, l_linenumber, sum(l_quantity) AS q FROM lineitem GROUP BY l_orderkey, l_linenumber) GROUP BY l_orderkey")
sql("distinct_rows", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")


@query("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
def distinct_on(spark, d):
    return windows.distinct_on(t(spark, d, "orders"), ["o_custkey"], F.desc("o_totalprice"), "o_orderkey").select("o_custkey", "o_orderkey")


@query("SELECT bin, low, high, n FROM (SELECT CAST(least(floor((value - a) / ((b - a) / 10)), 9) AS INTEGER) AS bin, a, b, count(*) AS n FROM events, (SELECT min(value) AS a, max(value) AS b FROM events) GROUP BY ALL), LATERAL (SELECT round(a + bin * ((b - a) / 10), 6) AS low, round(a + (bin + 1) * ((b - a) / 10), 6) AS high)")
def histogram_values(spark, d):
    return rows.histogram(t(spark, d, "events"), "value", 10).withColumns({"low": F.round("low", 6), "high": F.round("high", 6)})


@query("""SELECT t.* FROM (SELECT 'o_orderkey' AS column_name, 'BIGINT' AS column_type, CAST(min(o_orderkey) AS VARCHAR), CAST(max(o_orderkey) AS VARCHAR), round(avg(o_orderkey), 4), round(stddev(o_orderkey), 4), count(*), round(100.0 * (count(*) - count(o_orderkey)) / count(*), 2) FROM orders
    UNION ALL SELECT 'o_custkey' AS column_name, 'BIGINT' AS column_type, CAST(min(o_custkey) AS VARCHAR), CAST(max(o_custkey) AS VARCHAR), round(avg(o_custkey), 4), round(stddev(o_custkey), 4), count(*), round(100.0 * (count(*) - count(o_custkey)) / count(*), 2) FROM orders
    UNION ALL SELECT 'o_orderstatus' AS column_name, 'VARCHAR' AS column_type, CAST(min(o_orderstatus) AS VARCHAR), CAST(max(o_orderstatus) AS VARCHAR), NULL, NULL, count(*), round(100.0 * (count(*) - count(o_orderstatus)) / count(*), 2) FROM orders
    UNION ALL SELECT 'o_totalprice' AS column_name, 'DOUBLE' AS column_type, NULL, NULL, round(avg(o_totalprice), 4), round(stddev(o_totalprice), 4), count(*), round(100.0 * (count(*) - count(o_totalprice)) / count(*), 2) FROM orders
    UNION ALL SELECT 'o_orderdate' AS column_name, 'TIMESTAMP' AS column_type, CAST(min(o_orderdate) AS VARCHAR), CAST(max(o_orderdate) AS VARCHAR), NULL, NULL, count(*), round(100.0 * (count(*) - count(o_orderdate)) / count(*), 2) FROM orders
    UNION ALL SELECT 'o_orderpriority' AS column_name, 'VARCHAR' AS column_type, CAST(min(o_orderpriority) AS VARCHAR), CAST(max(o_orderpriority) AS VARCHAR), NULL, NULL, count(*), round(100.0 * (count(*) - count(o_orderpriority)) / count(*), 2) FROM orders) t(column_name, column_type, min, max, avg, std, count, null_percentage)""")
def summarize(spark, d):
    out = rows.summarize(t(spark, d, "orders")).where("column_name <> ''")
    double = F.col("column_name") == "o_totalprice"
    return out.select("column_name", "column_type", F.when(~double, F.col("min")).alias("min"), F.when(~double, F.col("max")).alias("max"), F.round(F.col("avg").cast("double"), 4).alias("avg"), F.round(F.col("std").cast("double"), 4).alias("std"), "count", F.col("null_percentage").cast("double").alias("null_percentage"))


@query("SELECT o_orderstatus, sum(s) / sum(n) AS mean FROM (SELECT o_orderstatus, o_orderpriority, CAST(round(sum(o_totalprice) * 100) AS BIGINT) AS s, count(*) AS n FROM orders GROUP BY ALL) GROUP BY o_orderstatus")
def agg_state_combine(spark, d):
    part = t(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.struct(F.round(F.sum("o_totalprice") * 100).cast("long").alias("s"), F.count(F.lit(1)).alias("n")).alias("state"))
    return part.groupBy("o_orderstatus").agg((F.sum("state.s") / F.sum("state.n")).alias("mean"))


# windows
W = "PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey"
sql("win_rank_per_nation", f"SELECT c_custkey, a, b, c, {rounded('d', 6)} AS d, {rounded('e', 6)} AS e FROM (SELECT c_custkey, CAST(row_number() OVER ({W}) AS BIGINT) AS a, CAST(rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS BIGINT) AS b, CAST(dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS BIGINT) AS c, percent_rank() OVER ({W}) AS d, cume_dist() OVER ({W}) AS e FROM customer)",
    f"SELECT c_custkey, CAST(row_number() OVER ({W}) AS BIGINT) AS a, CAST(rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS BIGINT) AS b, CAST(dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS BIGINT) AS c, round(percent_rank() OVER ({W}), 6) AS d, round(cume_dist() OVER ({W}), 6) AS e FROM customer")
sql("win_ntile", f"SELECT c_custkey, CAST(ntile(4) OVER ({W}) AS BIGINT) AS q FROM customer")
# the last row from the current one on is the last of all; Spark would go through the rest of the partition anew for each row
ALL = "PARTITION BY c_nationkey ORDER BY c_acctbal DESC NULLS LAST, c_custkey NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"
sql("win_nth_value", f"SELECT c_custkey, nth_value(c_custkey, 2) OVER ({ALL}) AS second, first_value(c_custkey) OVER ({ALL}) AS f, last_value(c_custkey) OVER ({ALL}) AS l FROM customer",
    f"SELECT c_custkey, nth_value(c_custkey, 2) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second, first_value(c_custkey) OVER ({W}) AS f, last_value(c_custkey) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS l FROM customer")
sql("win_lag_lead", "SELECT event_id, lag(event_id, 1, -1) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p, lead(event_id, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events", "SELECT event_id, lag(event_id, 1, -1) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p, lead(event_id, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events")
sql("win_ignore_nulls", "SELECT event_id, last_value(e) IGNORE NULLS OVER w AS l, lag(e) IGNORE NULLS OVER w AS g FROM (SELECT *, CASE WHEN event_type = 'error' THEN event_id END AS e FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)", "SELECT event_id, last_value(e IGNORE NULLS) OVER w AS l, lag(e IGNORE NULLS) OVER w AS g FROM (SELECT *, CASE WHEN event_type = 'error' THEN event_id END AS e FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
sql("win_moving_avg", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING), 6) AS m FROM events")
sql("win_range_interval", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' HOUR PRECEDING AND CURRENT ROW) AS n FROM events")
sql("win_named", "SELECT s_suppkey, round(sum(s_acctbal) OVER w, 2) AS s, count(*) OVER w AS n FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_suppkey)")
sql("win_global_total", "SELECT n_nationkey, count(*) OVER () AS n FROM nation")


@query("SELECT c_custkey, sum(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING)::BIGINT AS s FROM customer")
def win_groups_frame(spark, d):
    return windows.groups_frame(t(spark, d, "customer"), F.sum("c_custkey"), ["c_nationkey"], F.col("c_mktsegment"), -1, 1, "s").select("c_custkey", "s")


@query("SELECT s_suppkey, sum(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING EXCLUDE CURRENT ROW)::BIGINT AS s FROM supplier")
def win_exclude_current(spark, d):
    return windows.sum_excluding(t(spark, d, "supplier"), "s_suppkey", ["s_nationkey"], ["s_suppkey"], 2, 2, "s").select("s_suppkey", "s")


@query("SELECT n_nationkey, sum(n_nationkey) OVER (ORDER BY n_regionkey, n_nationkey % 2 ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE GROUP)::BIGINT AS g, sum(n_nationkey) OVER (ORDER BY n_regionkey, n_nationkey % 2 ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE TIES)::BIGINT AS s FROM nation")
def win_exclude_group_ties(spark, d):
    n = t(spark, d, "nation").withColumn("k", F.col("n_nationkey") % 2)
    out = windows.sum_excluding(n, "n_nationkey", [], ["n_regionkey", "k"], None, None, "g", "group")
    out = windows.sum_excluding(out, "n_nationkey", [], ["n_regionkey", "k"], None, None, "s", "ties")
    return out.select("n_nationkey", F.col("g").cast("long").alias("g"), F.col("s").cast("long").alias("s"))


@query("SELECT c_nationkey, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) <= 3")
def win_qualify(spark, d):
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return windows.qualify(t(spark, d, "customer"), "_r", F.row_number().over(w), "_r <= 3").select("c_nationkey", "c_custkey")


@query("SELECT event_id, count(DISTINCT event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS n, count(*) FILTER (WHERE value > 100) OVER (PARTITION BY user_id) AS f FROM events")
def win_distinct_filter(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-5, 0)
    return t(spark, d, "events").select("event_id", F.size(F.collect_set("event_type").over(w)).cast("long").alias("n"), F.count(F.when(F.col("value") > 100, 1)).over(Window.partitionBy("user_id")).alias("f"))


# order, limit, sample
sql("order_nulls", "SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM customer ORDER BY k DESC NULLS LAST, c_custkey NULLS FIRST LIMIT 100")
sql("top_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
sql("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 100")
sql("order_by_all", "SELECT r_name, r_regionkey FROM region ORDER BY ALL")


@query("SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10%")
def limit_percent(spark, d):
    return rows.limit_percent(t(spark, d, "orders").select("o_orderkey", "o_totalprice"), 10, "o_totalprice", "o_orderkey").select("o_orderkey")


@query("SELECT count(*) AS n, count(DISTINCT o_orderkey) AS different, count(*) FILTER (WHERE o_orderkey IN (SELECT o_orderkey FROM orders)) AS members FROM (SELECT * FROM orders USING SAMPLE 100 ROWS)")
def sample_reservoir(spark, d):
    orders = t(spark, d, "orders").select("o_orderkey")
    drawn = rows.reservoir(orders, 100)
    there = drawn.join(orders.select(F.col("o_orderkey").alias("k")), F.col("o_orderkey") == F.col("k"), "left")
    return there.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("different"), F.count("k").alias("members"))


@query("SELECT o_orderstatus, true AS within FROM orders GROUP BY o_orderstatus")
def sample_bernoulli(spark, d):
    """Each row by itself with a chance of a tenth: whether the number drawn is within six deviations of what is to be expected."""
    all_, drawn = (x.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias(n)) for x, n in ((t(spark, d, "orders"), "n"), (rows.sample(t(spark, d, "orders"), 10), "k")))
    expected, spread = F.col("n") * 0.1, F.sqrt(F.col("n") * 0.09)
    return all_.join(drawn, "o_orderstatus", "left").select("o_orderstatus", (F.abs(F.coalesce("k", F.lit(0)) - expected) <= 6 * spread).alias("within"))


# set operations, recursion
A, B = "SELECT o_custkey % 50 AS k FROM orders WHERE o_orderstatus = 'F'", "SELECT o_custkey % 70 AS k FROM orders WHERE o_orderstatus = 'P'"
for name, words in (("union", "UNION"), ("union_all", "UNION ALL"), ("except", "EXCEPT"), ("except_all", "EXCEPT ALL"), ("intersect", "INTERSECT"), ("intersect_all", "INTERSECT ALL")):
    sql(f"set_{name}", f"({A}) {words} ({B})")


@query("SELECT r_regionkey AS k, r_name AS name FROM region UNION ALL BY NAME SELECT n_name AS name, n_nationkey AS other FROM nation")
def union_by_name(spark, d):
    return rows.union_by_name(t(spark, d, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name")), t(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("other")))


sql("cte_reuse", "WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 200000) SELECT a.o_custkey AS o_custkey, count(*) AS n FROM big a JOIN big b ON a.o_custkey = b.o_custkey GROUP BY a.o_custkey")
sql("cte_recursive", "WITH RECURSIVE f(n, a, b) AS (SELECT 1, CAST(0 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT n + 1, b, a + b FROM f WHERE n < 30) SELECT n, a FROM f")


@query("WITH RECURSIVE r(k) AS (SELECT 1 UNION SELECT (k * 7 + 3) % 25 FROM r) SELECT k::INTEGER AS k, n_name FROM r JOIN nation ON n_nationkey = k")
def recursive_union(spark, d):
    seed = spark.createDataFrame([(1,)], "k int")
    found = rows.recursive(seed, lambda new: new.select(((F.col("k") * 7 + 3) % 25).cast("int").alias("k")))
    return found.join(t(spark, d, "nation"), F.col("k") == F.col("n_nationkey")).select("k", "n_name")


@query("WITH RECURSIVE r(k, dist) AS (SELECT 0, 0 UNION SELECT j, dist + 1 FROM r, (SELECT n_nationkey AS i, (n_nationkey * 3 + 1) % 25 AS j FROM nation UNION SELECT n_nationkey, (n_nationkey + 5) % 25 FROM nation) e WHERE i = k AND dist < 25) SELECT k::INTEGER AS k, min(dist)::INTEGER AS dist FROM r GROUP BY k")
def recursive_using_key(spark, d):
    n = t(spark, d, "nation").select(F.col("n_nationkey").alias("i"))
    edges = n.select("i", ((F.col("i") * 3 + 1) % 25).alias("j")).union(n.select("i", ((F.col("i") + 5) % 25).alias("j"))).distinct()
    step = lambda new: new.join(F.broadcast(edges), F.col("k") == F.col("i")).select(F.col("j").alias("k"), (F.col("dist") + 1).alias("dist"))
    return rows.recursive_by_key(spark.createDataFrame([(0, 0)], "k int, dist int"), step, ["k"], F.min, "dist")


# changes of rows
@query("SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer")
def dml_update(spark, d):
    return rows.update(t(spark, d, "customer").select("c_custkey", "c_acctbal", "c_nationkey"), F.col("c_nationkey") == 3, c_acctbal=F.lit(0.0)).drop("c_nationkey")


@query("SELECT c_custkey FROM customer WHERE NOT coalesce(nullif(c_nationkey, 3) > 10, false)")
def dml_delete(spark, d):
    return rows.delete(t(spark, d, "customer"), F.expr("nullif(c_nationkey, 3) > 10")).select("c_custkey")


@query("SELECT n_nationkey, CASE WHEN n_nationkey < 5 THEN 'new' ELSE n_name END AS n_name FROM nation UNION ALL SELECT 100, 'new'")
def dml_upsert(spark, d):
    new = spark.createDataFrame([(i, "new") for i in (0, 1, 2, 3, 4, 100)], "n_nationkey int, n_name string")
    return rows.upsert(t(spark, d, "nation").select("n_nationkey", "n_name"), new, ["n_nationkey"])


@query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT 100, 'new'")
def dml_insert_or_ignore(spark, d):
    new = spark.createDataFrame([(i, "new") for i in (0, 1, 100)], "n_nationkey int, n_name string")
    return rows.upsert(t(spark, d, "nation").select("n_nationkey", "n_name"), new, ["n_nationkey"], "ignore")


@query("SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
def dml_delete_using(spark, d):
    gone = t(spark, d, "nation").where("n_regionkey = 2").select(F.col("n_nationkey").alias("s_nationkey"))
    return rows.delete_using(t(spark, d, "supplier"), gone, ["s_nationkey"]).select("s_suppkey")


# bitmaps of row ids
BITS = {"r": "l_returnflag = 'R'", "f": "l_linestatus = 'F'", "d": "l_discount >= 0.05"}


def bitmaps(df, row, **conditions):
    """A bitmap of row ids for each condition, bucket by bucket, from one scan and one shuffle."""
    position = F.bitmap_bit_position(row)
    return df.groupBy(F.bitmap_bucket_number(row).alias("b")).agg(*(F.bitmap_construct_agg(F.when(F.expr(c), position)).alias(n) for n, c in conditions.items()))


def both(m, *names):
    """m with the bitmap `all`: the intersection of the named ones."""
    each = m.select("b", F.explode(F.array(*names)).alias("x"))
    return each.groupBy("b").agg(F.expr("bitmap_and_agg(x)").alias("all"))


@query("SELECT count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_discount >= 0.05")
def bitmap_and_count(spark, d):
    """Rows are numbered as they are read; bitmaps of the numbers are intersected and counted bucket by bucket."""
    rows_ = t(spark, d, "lineitem").withColumn("i", F.monotonically_increasing_id())
    return both(bitmaps(rows_, "i", **BITS), "r", "f", "d").agg(F.coalesce(F.sum(F.bitmap_count("all")), F.lit(0)).alias("n"))


@query("SELECT count(*) FILTER (WHERE l_quantity IN (1, 7, 49)) AS in_list, count(*) FILTER (WHERE l_returnflag = 'R' OR l_discount >= 0.05) AS either, count(*) FILTER (WHERE (l_returnflag = 'R') <> (l_discount >= 0.05)) AS one, count(*) FILTER (WHERE NOT l_returnflag = 'R') AS without, count(*) FILTER (WHERE l_returnflag = 'R' AND NOT l_discount >= 0.05) AS but_not FROM lineitem")
def bitmap_or_xor_not(spark, d):
    """An IN list is a union of the values' bitmaps; XOR, NOT and AND-NOT are counted from intersections."""
    rows_ = t(spark, d, "lineitem").withColumn("i", F.monotonically_increasing_id())
    m = bitmaps(rows_, "i", r=BITS["r"], d=BITS["d"], q1="l_quantity = 1", q7="l_quantity = 7", q49="l_quantity = 49", every="true")
    union = lambda *c: m.select("b", F.explode(F.array(*c)).alias("x")).groupBy("b").agg(F.expr("bitmap_or_agg(x)").alias("all")).agg(F.sum(F.bitmap_count("all")))
    n = lambda c: F.sum(F.bitmap_count(c))
    shared = both(m, "r", "d").agg(n("all").alias("rd"))
    each = m.agg(n("r").alias("r"), n("d").alias("d"), n("every").alias("every"))
    out = each.crossJoin(F.broadcast(shared)).crossJoin(F.broadcast(union("q1", "q7", "q49").toDF("in_list"))).crossJoin(F.broadcast(union("r", "d").toDF("either")))  # one row each
    return out.select("in_list", "either", (F.col("r") + F.col("d") - 2 * F.col("rd")).alias("one"), (F.col("every") - F.col("r")).alias("without"), (F.col("r") - F.col("rd")).alias("but_not"))


@query("SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING bool_or(l_returnflag = 'R') AND bool_or(l_discount >= 0.05)")
def bitmap_row_ids(spark, d):
    """Bitmaps of order keys are intersected, and read back as keys: by the byte, then by the bit."""
    m = both(bitmaps(t(spark, d, "lineitem"), "l_orderkey", r=BITS["r"], d=BITS["d"]), "r", "d")
    bytes_ = m.select("b", F.posexplode(F.expr("transform(sequence(0, 4095), k -> CAST(conv(substring(hex(all), 2 * k + 1, 2), 16, 10) AS INT))")).alias("k", "v")).where("v > 0")
    bits = bytes_.select("b", "k", F.explode(F.expr("filter(sequence(0, 7), i -> shiftright(v, i) & 1 = 1)")).alias("i"))
    place = F.col("k") * 8 + F.col("i")  # buckets from 1 hold the positive numbers from 1 on, others the rest, downwards
    return bits.select(F.when(F.col("b") > 0, (F.col("b") - 1) * 32768 + place + 1).otherwise(F.col("b") * 32768 - place).cast("long").alias("l_orderkey"))


@query("SELECT l_returnflag, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY l_returnflag")
def bitmap_distinct(spark, d):
    m = t(spark, d, "lineitem").groupBy("l_returnflag", F.bitmap_bucket_number("l_partkey").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("l_partkey")).alias("m"))
    return m.groupBy("l_returnflag").agg(F.sum(F.bitmap_count("m")).alias("n"))


# vectors
@query("SELECT a.vec_id AS vec_id, round(list_inner_product(a.embedding, b.embedding)::DOUBLE, 4) AS dot FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b")
def vector_inner_product(spark, d):
    from lakeloom.functions import lists

    e = t(spark, d, "embeddings")
    return e.crossJoin(F.broadcast(e.where("vec_id = 0").select(F.col("embedding").alias("q")))).select("vec_id", F.round(lists.dot(F.col("embedding"), F.col("q")), 4).alias("dot"))
