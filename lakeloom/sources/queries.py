"""Queries that go through files: each writes to a folder beside the checkpoints, which all executors share, and reads it back."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from lakeloom.plans.registry import query
from lakeloom.session import checkpoint_dir
from lakeloom.session import table as t
from lakeloom.sources import connectors as io


def folder(spark) -> str:
    checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/files-{uuid.uuid4().hex}"


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def source_csv_round_trip(spark, d):
    at = folder(spark)
    io.copy_to(t(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal"), at, "csv", header=True, sep="|")
    return io.read_csv(spark, at, "s_suppkey LONG, s_name STRING, s_acctbal DOUBLE", sep="|", header=True)


@query("SELECT s_suppkey::INTEGER AS s_suppkey, s_name FROM supplier")
def source_csv_sniffed(spark, d):
    at = folder(spark)
    io.copy_to(t(spark, d, "supplier").select("s_suppkey", "s_name").coalesce(1), at, "csv", header=True, sep=";")
    return io.read_csv(spark, at)


@query("SELECT count(*) FILTER (WHERE s_suppkey % 10 = 0) AS bad, count(*) FILTER (WHERE s_suppkey % 10 <> 0) AS good FROM supplier")
def source_csv_rejects(spark, d):
    at = folder(spark)
    s = t(spark, d, "supplier").select(F.when(F.col("s_suppkey") % 10 == 0, F.lit("?")).otherwise(F.col("s_suppkey").cast("string")).alias("k"), "s_name")
    io.copy_to(s, at, "csv", sep=",")
    r = io.read_csv(spark, at, "k LONG, s_name STRING", rejects=True, sep=",", header=False)
    return r.agg(F.count("_rejected").alias("bad"), F.count_if(F.col("_rejected").isNull() & F.col("k").isNotNull()).alias("good"))


@query("SELECT c_custkey, c_name, c_nationkey FROM customer")
def source_json_round_trip(spark, d):
    at = folder(spark)
    io.copy_to(t(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey"), at, "json")
    return io.read_json(spark, at, "c_custkey LONG, c_name STRING, c_nationkey INT")


@query("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def source_parquet_partitions(spark, d):
    at = folder(spark)
    io.copy_to(t(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), at, partition_by=["o_orderstatus"], compression="zstd")
    return io.read_parquet(spark, at).where("o_orderstatus = 'F'")


@query("SELECT k, a, b FROM (SELECT n_nationkey AS k, n_name AS a, NULL AS b FROM nation UNION ALL SELECT r_regionkey, NULL, r_name FROM region)")
def source_parquet_union_by_name(spark, d):
    at = folder(spark)
    io.copy_to(t(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("a")), f"{at}/x")
    io.copy_to(t(spark, d, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("b")), f"{at}/y")
    return io.read_parquet(spark, f"{at}/x", f"{at}/y", union_by_name=True).select("k", "a", "b")


@query("SELECT n_nationkey, n_nationkey::BIGINT AS file_row_number FROM nation")
def source_parquet_row_numbers(spark, d):
    return io.read_parquet(spark, f"{d}/nation.parquet", file_row_number=True).select("n_nationkey", "file_row_number")


@query("""SELECT column_name AS "column", CASE data_type WHEN 'VARCHAR' THEN 'BYTE_ARRAY' WHEN 'DOUBLE' THEN 'DOUBLE' WHEN 'INTEGER' THEN 'INT32' ELSE 'INT64' END AS physical_type,
    (SELECT count(*) FROM orders) AS n FROM information_schema.columns WHERE table_name = 'orders'""")
def source_parquet_metadata(spark, d):
    return io.parquet_metadata(spark, f"{d}/orders.parquet").groupBy("column", "physical_type").agg(F.sum("row_group_rows").alias("n"))


@query("SELECT concat('{\"r_name\":\"', r_name, '\"}') AS json FROM region")
def source_json_objects(spark, d):
    at = folder(spark)
    io.copy_to(t(spark, d, "region").select("r_name"), at, "json")
    return io.read_json_objects(spark, at)


@query("SELECT string_agg(r_name || chr(10), '' ORDER BY r_name) AS content, 5::BIGINT AS n FROM region")
def source_text_glob(spark, d):
    at = folder(spark)
    t(spark, d, "region").select("r_name").coalesce(1).orderBy("r_name").coalesce(1).write.text(at)
    n = io.glob(spark, f"{at}/part-*").count()
    return io.read_text(spark, f"{at}/part-*").select("content", F.lit(5 * n).cast("long").alias("n"))


@query("SELECT n_nationkey, n_name, r_name FROM region JOIN nation ON n_regionkey = r_regionkey")
def database_export_import(spark, d):
    at = folder(spark)
    io.export_database({n: t(spark, d, n) for n in ("region", "nation")}, at)
    back = io.import_database(spark, at)
    return back["nation"].join(back["region"], F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")


@query("SELECT r_regionkey, r_name FROM region")
def source_arrow_pandas(spark, d):
    return spark.createDataFrame(t(spark, d, "region").toArrow())


@query("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
def ddl_table_as_select(spark, d):
    name = f"made_{uuid.uuid4().hex}"
    t(spark, d, "nation").groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n")).write.option("path", folder(spark)).saveAsTable(name)
    return spark.table(name)


@query("SELECT c_custkey, c_acctbal * 2 AS twice FROM customer")
def ddl_macros(spark, d):
    """A macro as an SQL function."""
    from lakeloom.session import views

    views(spark, d, "customer")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION double_it(x DOUBLE) RETURNS DOUBLE RETURN x * 2")
    return spark.sql("SELECT c_custkey, double_it(c_acctbal) AS twice FROM customer")


@query("SELECT s_suppkey, s_suppkey * 3 + 1 AS x FROM supplier")
def udf_arrow(spark, d):
    @F.pandas_udf("long")
    def f(x: pd.Series) -> pd.Series:
        return x * 3 + 1

    return t(spark, d, "supplier").select("s_suppkey", f("s_suppkey").alias("x"))


@query("SELECT s_nationkey, round(sum(s_acctbal * s_acctbal), 2) AS x FROM supplier GROUP BY s_nationkey")
def udaf_arrow(spark, d):
    """A user's aggregate in two steps: each batch's part first, so that no group is gathered in one place."""
    def part(frames):
        for p in frames:
            yield p.assign(x=p.s_acctbal**2).groupby("s_nationkey", as_index=False).x.sum()

    return t(spark, d, "supplier").select("s_nationkey", "s_acctbal").mapInPandas(part, "s_nationkey int, x double").groupBy("s_nationkey").agg(F.round(F.sum("x"), 2).alias("x"))


@query("SELECT r_regionkey, i::INTEGER AS i FROM region, LATERAL (SELECT unnest(range(r_regionkey)) AS i)")
def udtf(spark, d):
    @F.udtf(returnType="i int")
    class Count:
        def eval(self, n: int):
            for i in range(n):
                yield (i,)

    spark.udtf.register("count_up_to", Count)
    t(spark, d, "region").createOrReplaceTempView("region")
    return spark.sql("SELECT r_regionkey, i FROM region, LATERAL count_up_to(r_regionkey)")


@query("SELECT n_nationkey, n_name FROM nation")
def copy_from_file(spark, d):
    at, name = folder(spark), f"loaded_{uuid.uuid4().hex}"
    io.copy_to(t(spark, d, "nation").select("n_nationkey", "n_name"), at, "csv", header=True)
    spark.sql(f"CREATE TABLE {name} (n_nationkey INT, n_name STRING) USING parquet LOCATION '{folder(spark)}'")
    io.copy_from(spark, name, at, "csv", header=True)
    return spark.table(name)


@query("SELECT 5 AS files, sum(strlen(r_name) + 1)::BIGINT AS bytes FROM region")
def source_blob(spark, d):
    at = folder(spark)
    t(spark, d, "region").select("r_regionkey", "r_name").write.partitionBy("r_regionkey").text(at)
    return io.read_blob(spark, f"{at}/*/part-*").agg(F.count(F.lit(1)).cast("int").alias("files"), F.sum(F.octet_length("content")).cast("long").alias("bytes"))
