"""Statements other than SELECT, and group-by and join benchmarks on the tables at hand."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from lakeloom.functions import lists
from lakeloom.functions.numbers import rounded
from lakeloom.operators import rows
from lakeloom.plans.registry import query, sql
from lakeloom.session import checkpoint_dir
from lakeloom.session import table as t
from lakeloom.session import views


@query("SELECT r_regionkey, r_name, CAST(NULL AS VARCHAR) AS note, r_regionkey * 2 AS twice FROM region")
def ddl_schema_table_alter_drop(spark, d):
    """CREATE SCHEMA, CREATE TABLE, ALTER (add columns, rename), COMMENT, INSERT BY NAME, DESCRIBE, DROP; then what the table held."""
    checkpoint_dir(spark)
    s = f"made_{uuid.uuid4().hex}"
    at = f"{spark.sparkContext.getCheckpointDir()}/{s}"
    spark.sql(f"CREATE SCHEMA {s} LOCATION '{at}'")
    try:
        spark.sql(f"CREATE TABLE {s}.region (r_regionkey INT, r_name STRING) USING parquet LOCATION '{at}-table'")
        spark.sql(f"ALTER TABLE {s}.region ADD COLUMNS (note STRING, twice INT)")
        spark.sql(f"COMMENT ON TABLE {s}.region IS 'a copy'")
        t(spark, d, "region").createOrReplaceTempView("region_source")
        spark.sql(f"INSERT INTO {s}.region BY NAME SELECT r_regionkey * 2 AS twice, r_name, r_regionkey, CAST(NULL AS STRING) AS note FROM region_source")
        spark.sql(f"ALTER TABLE {s}.region RENAME TO {s}.regions")
        columns = [r.col_name for r in spark.sql(f"DESCRIBE {s}.regions").collect()]
    finally:
        spark.sql(f"DROP SCHEMA {s} CASCADE")
    return spark.read.parquet(f"{at}-table").select(*columns)


@query("SELECT n_name FROM nation WHERE n_nationkey = 7")
def set_variable(spark, d):
    views(spark, d, "nation")
    spark.sql("DECLARE OR REPLACE VARIABLE wanted INT DEFAULT 3")
    spark.sql("SET VARIABLE wanted = 7")
    return spark.sql("SELECT n_name FROM nation WHERE n_nationkey = wanted")


@query("SELECT event_id, epoch_us(ts) - 7200000000 AS there, epoch_us(ts) AS here FROM events")
def set_reset(spark, d):
    """A time zone is set for one query and set back for the next."""
    key, e = "spark.sql.session.timeZone", t(spark, d, "events").select("event_id", "ts")
    before, made = spark.conf.get(key), []
    try:
        for zone, name in (("+02:00", "there"), ("UTC", "here")):
            spark.sql(f"SET TIME ZONE '{zone}'")
            made.append(e.select("event_id", F.expr("unix_micros(CAST(ts AS TIMESTAMP))").alias(name)))
    finally:
        spark.conf.set(key, before)
    return made[0].join(made[1], "event_id")


@query("SELECT n_name FROM nation WHERE n_regionkey = 2 UNION ALL SELECT n_name FROM nation WHERE n_regionkey = 3")
def prepare_execute(spark, d):
    views(spark, d, "nation")
    one = lambda k: spark.sql("SELECT n_name FROM nation WHERE n_regionkey = ?", args=[k])
    return one(2).union(one(3))


@query("SELECT 'Filter' AS operator, count(*) AS n FROM lineitem WHERE l_quantity > 49 AND l_discount < 0.03")
def explain_statement(spark, d):
    """EXPLAIN ANALYZE: the plan is run, and what its operators counted is told."""
    views(spark, d, "lineitem")
    plan = spark.sql("SELECT l_orderkey FROM lineitem WHERE l_quantity > 49 AND l_discount < 0.03")._jdf.queryExecution().executedPlan()
    plan.execute().count()
    found, todo = [], [plan]
    while todo:
        p = todo.pop()
        if p.nodeName() == "Filter":
            found.append((p.nodeName(), p.metrics().apply("numOutputRows").value()))
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return spark.createDataFrame(found, "operator string, n long")


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@query(f"SELECT table_name AS name FROM information_schema.tables WHERE table_name IN {TABLES}")
def system_tables(spark, d):
    views(spark, d, " ".join(TABLES))
    return spark.sql("SHOW TABLES").where(F.col("tableName").isin(*TABLES) & F.col("isTemporary")).select(F.col("tableName").alias("name"))


@query("SELECT column_name, data_type AS column_type FROM information_schema.columns WHERE table_name = 'orders'")
def describe_table(spark, d):
    views(spark, d, "orders")
    kinds = F.create_map(*(F.lit(x) for kv in rows.TYPE_NAMES.items() for x in kv))
    return spark.sql("DESCRIBE orders").select(F.col("col_name").alias("column_name"), kinds[F.col("data_type")].alias("column_type"))


@query("SELECT r_regionkey, n_name, n_nationkey + 1 AS k FROM region JOIN nation ON n_regionkey = r_regionkey WHERE n_nationkey >= 3")
def table_macro(spark, d):
    """A function that returns a table, called for each row of another; its second parameter has a default."""
    views(spark, d, "nation, region")
    name = f"of_region_{uuid.uuid4().hex[:8]}"
    spark.sql(f"CREATE TEMPORARY FUNCTION {name}(region INT, least INT DEFAULT 3) RETURNS TABLE (n_name STRING, k INT) RETURN SELECT n_name, n_nationkey + 1 FROM nation WHERE n_regionkey = region AND n_nationkey >= least")
    return spark.sql(f"SELECT r_regionkey, n.n_name, n.k FROM region, LATERAL {name}(r_regionkey) n")


@query("SELECT o_orderstatus, bit_count(bitstring_agg(o_custkey::INTEGER, 0, 10000000)) AS n, min(o_custkey) AS low FROM orders GROUP BY o_orderstatus")
def fn_bitstring_agg(spark, d):
    """A bitmap of the values that occur, whatever their range: in buckets of 32,768, one aggregation."""
    m = t(spark, d, "orders").groupBy("o_orderstatus", F.bitmap_bucket_number("o_custkey").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("o_custkey")).alias("m"), F.min("o_custkey").alias("low"))
    return m.groupBy("o_orderstatus").agg(F.sum(F.bitmap_count("m")).alias("n"), F.min("low").alias("low"))


@query("SELECT bin, count(*) AS n FROM (SELECT CASE WHEN l_quantity <= 10 THEN 10 WHEN l_quantity <= 20 THEN 20 WHEN l_quantity <= 30 THEN 30 ELSE 99 END AS bin FROM lineitem) GROUP BY bin")
def fn_histogram_bins(spark, d):
    """histogram(x, bins): upper bounds, and a bin for others."""
    bounds = F.array(*map(F.lit, (10, 20, 30)))
    b = F.coalesce(F.array_min(F.filter(bounds, lambda x: F.col("l_quantity") <= x)), F.lit(99))
    return t(spark, d, "lineitem").groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT round(min(value) + (max(value) - min(value)) * i / 4, 6) AS bound FROM events, (SELECT unnest([1, 2, 3, 4]) AS i) GROUP BY i")
def fn_equi_width_bins(spark, d):
    e = t(spark, d, "events").agg(F.min("value").alias("a"), F.max("value").alias("b"))
    return e.select(F.explode(F.array(*[F.round(F.col("a") + (F.col("b") - F.col("a")) * i / 4, 6) for i in (1, 2, 3, 4)])).alias("bound"))


@query("SELECT o_orderstatus, true AS near FROM orders GROUP BY o_orderstatus")
def fn_reservoir_quantile(spark, d):
    """The median of a reservoir of each group, held against the true one: the share of values below it is a half, give or take 0.1."""
    o = t(spark, d, "orders").select("o_orderstatus", "o_totalprice")
    place = F.row_number().over(Window.partitionBy("o_orderstatus").orderBy(F.rand(1)))
    drawn = o.withColumn("place", place).where("place <= 8192").groupBy("o_orderstatus").agg(F.percentile("o_totalprice", 0.5).alias("m"))
    return o.join(drawn, "o_orderstatus").groupBy("o_orderstatus").agg((F.abs(F.avg((F.col("o_totalprice") <= F.col("m")).cast("int")) - 0.5) < 0.1).alias("near"))


@query("SELECT json_group_structure(props::JSON)::VARCHAR AS structure FROM events")
def fn_json_structure(spark, d):
    return lists.json_group_structure(t(spark, d, "events"), "props")


@query("SELECT event_id, json_structure(props)::VARCHAR AS structure FROM events")
def fn_json_structure_rows(spark, d):
    return t(spark, d, "events").select("event_id", lists.json_structure(F.col("props")).alias("structure"))


@query("SELECT event_type, to_json(list_sort(list(DISTINCT user_id % 5))) AS a, to_json(map_from_entries(list_sort(list(DISTINCT (('u' || user_id % 3)::VARCHAR, (user_id % 3)::BIGINT))))) AS o FROM events GROUP BY event_type")
def fn_json_group(spark, d):
    e = t(spark, d, "events")
    pair = F.struct(F.concat(F.lit("u"), (F.col("user_id") % 3).cast("string")).alias("key"), (F.col("user_id") % 3).alias("value"))
    return e.groupBy("event_type").agg(F.to_json(F.array_sort(F.collect_set(F.col("user_id") % 5))).alias("a"), F.to_json(F.map_from_entries(F.array_sort(F.collect_set(pair)))).alias("o"))


@query("SELECT n_nationkey, n_name AS a, n_regionkey AS b FROM nation")
def fn_struct_concat_remap(spark, d):
    n = t(spark, d, "nation").select("n_nationkey", F.struct(F.col("n_name").alias("a")).alias("x"), F.struct(F.col("n_regionkey").alias("b")).alias("y"))
    return n.select("n_nationkey", lists.struct_concat(n, "x", "y").alias("s")).select("n_nationkey", "s.*")


@query("SELECT event_id, unnest([[[event_id, user_id], [event_id % 3]], [range(event_id % 4)], CASE WHEN event_id % 5 > 0 THEN [[user_id], NULL] END], recursive := true) AS x FROM events")
def unnest_recursive(spark, d):
    """All rows; lists of columns with empty and null lists among them, three levels deep."""
    i, u = F.col("event_id"), F.col("user_id")
    counted = F.when(i % 4 > 0, F.sequence(F.lit(0).cast("long"), i % 4 - 1)).otherwise(F.array().cast("array<bigint>"))
    some = F.when(i % 5 > 0, F.array(F.array(u), F.lit(None)))
    e = t(spark, d, "events").select("event_id", F.array(F.array(F.array(i, u), F.array(i % 3)), F.array(counted), some).alias("x"))
    return rows.unnest_recursive(e, "x")


# group-by benchmark: ten shapes of keys and aggregates
sql("groupby_1", "SELECT l_returnflag AS k, round(sum(l_quantity), 1) AS v FROM lineitem GROUP BY l_returnflag")
sql("groupby_2", "SELECT l_returnflag AS k1, l_linestatus AS k2, round(sum(l_quantity), 1) AS v FROM lineitem GROUP BY l_returnflag, l_linestatus")
sql("groupby_3", f"SELECT l_partkey AS k, round(sum(l_quantity), 1) AS v1, {rounded('avg(l_discount)', 6)} AS v3 FROM lineitem GROUP BY l_partkey",
    "SELECT l_partkey AS k, round(sum(l_quantity), 1) AS v1, round(avg(l_discount), 6) AS v3 FROM lineitem GROUP BY l_partkey")
sql("groupby_4", "SELECT l_linenumber AS k, round(avg(l_quantity), 6) AS v1, round(avg(l_tax), 6) AS v2, round(avg(l_discount), 6) AS v3 FROM lineitem GROUP BY l_linenumber")
sql("groupby_5", "SELECT l_suppkey AS k, round(sum(l_quantity), 1) AS v1, CAST(sum(l_linenumber) AS BIGINT) AS v2 FROM lineitem GROUP BY l_suppkey")
sql("groupby_6", "SELECT l_linenumber AS k1, l_returnflag AS k2, median(l_quantity) AS m, round(stddev(l_quantity), 6) AS s FROM lineitem GROUP BY l_linenumber, l_returnflag")
sql("groupby_7", "SELECT l_partkey AS k, max(l_quantity) - min(l_quantity) AS spread FROM lineitem GROUP BY l_partkey")
sql("groupby_9", "SELECT l_returnflag AS k1, l_linenumber AS k2, round(power(corr(l_quantity, l_linenumber + l_discount), 2), 6) AS r2 FROM lineitem GROUP BY l_returnflag, l_linenumber")
sql("groupby_10", "SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_suppkey, round(sum(l_quantity), 1) AS v, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_suppkey")


@query("SELECT l_partkey AS k, l_quantity AS v FROM (SELECT l_partkey, l_quantity, row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity DESC) AS r FROM lineitem) WHERE r <= 2")
def groupby_8(spark, d):
    w = Window.partitionBy("l_partkey").orderBy(F.desc("l_quantity"))
    return t(spark, d, "lineitem").select("l_partkey", "l_quantity", F.row_number().over(w).alias("r")).where("r <= 2").select(F.col("l_partkey").alias("k"), F.col("l_quantity").alias("v"))


# join benchmark: small, medium and large other sides, inner and outer
sql("joinbench_small", "SELECT count(*) AS n, round(sum(s_acctbal), 2) AS v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey")
sql("joinbench_medium", "SELECT count(*) AS n, round(sum(p_retailprice), 2) AS v FROM lineitem JOIN part ON l_partkey = p_partkey")
sql("joinbench_medium_outer", "SELECT count(*) AS n, count(p_partkey) AS m FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size < 20) p ON l_partkey = p_partkey")
sql("joinbench_medium_text", "SELECT count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey AND concat('Brand#', CAST(l_linenumber AS VARCHAR(3))) = p_brand")
sql("joinbench_large", "SELECT count(*) AS n, round(sum(o_totalprice), 0) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
