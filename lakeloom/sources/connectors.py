"""Files in and out: CSV with rejects and a dialect sniffer, JSON, Parquet with metadata, text, blobs, listings, partitioned copies, whole databases."""

from __future__ import annotations

import csv
import json
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sniff_csv(spark: SparkSession, path: str, rows: int = 200) -> dict:
    """Delimiter, quote and header, from the first lines; read through Spark, so any store will do."""
    lines = [r[0] for r in spark.read.text(path).limit(rows).collect()]
    best, found = (0, 0), ","
    for d in (",", "|", ";", "\t"):
        widths = Counter(len(r) for r in csv.reader(lines, delimiter=d))
        width, n = max(widths.items(), key=lambda x: (x[1], x[0]), default=(0, 0))
        if width > 1 and (n, width) > best:
            best, found = (n, width), d
    parsed = list(csv.reader(lines, delimiter=found))

    def number(s):
        try:
            float(s)
        except ValueError:
            return False
        return True

    head = bool(parsed) and not any(map(number, parsed[0])) and any(number(x) for r in parsed[1:] for x in r)
    return {"delimiter": found, "quote": '"', "header": head or (len(parsed) > 1 and len(set(parsed[0])) == len(parsed[0]) and not any(map(number, parsed[0]))), "columns": len(parsed[0]) if parsed else 0}


def read_csv(spark: SparkSession, path: str, schema: str | None = None, rejects: bool = False, **options) -> DataFrame:
    """Sniffs what isn't given. With `rejects` (needs a schema) lines that don't fit come in the column _rejected."""
    if "sep" not in options:
        s = sniff_csv(spark, path)
        options = {"sep": s["delimiter"], "header": s["header"], **options}
    r = spark.read.options(**options)
    if schema and rejects:
        return r.schema(f"{schema}, _rejected STRING").option("columnNameOfCorruptRecord", "_rejected").csv(path)
    return r.schema(schema).csv(path) if schema else r.option("inferSchema", True).csv(path)


def read_json(spark: SparkSession, path: str, schema: str | None = None, array: bool = False) -> DataFrame:
    r = spark.read.option("multiLine", array)
    return (r.schema(schema) if schema else r).json(path)


def read_json_objects(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "json")


def read_parquet(spark: SparkSession, *paths: str, union_by_name: bool = False, filename: bool = False, file_row_number: bool = False) -> DataFrame:
    df = spark.read.option("mergeSchema", union_by_name).parquet(*paths)
    if filename:
        df = df.withColumn("filename", F.col("_metadata.file_name"))
    return df.withColumn("file_row_number", F.col("_metadata.row_index")) if file_row_number else df


def parquet_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One row for each row group and column of the files. Only footers are read, by Spark's own file systems, on the driver."""
    jvm, found = spark.sparkContext._jvm, []
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    for name in spark.read.parquet(path).inputFiles():
        at = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name))
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(at, conf))
        try:
            for g, block in enumerate(reader.getFooter().getBlocks()):
                for c in block.getColumns():
                    found.append((at.getName(), g, block.getRowCount(), c.getPath().toDotString(), c.getPrimitiveType().getPrimitiveTypeName().toString().replace("BINARY", "BYTE_ARRAY"), c.getCodec().toString(), c.getTotalSize()))
        finally:
            reader.close()
    return spark.createDataFrame(found, "file string, row_group int, row_group_rows long, column string, physical_type string, compression string, compressed_size long")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    d = spark.read.format("binaryFile").load(path)
    return d.select(F.col("path").alias("filename"), F.decode("content", "UTF-8").alias("content"), F.col("length").alias("size"), F.col("modificationTime").alias("last_modified"))


def read_blob(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("filename"), "content", F.col("length").alias("size"))


def glob(spark: SparkSession, pattern: str) -> DataFrame:
    """Names of files only: contents aren't read."""
    return spark.read.format("binaryFile").load(pattern).select(F.col("path").alias("file"))


def copy_to(df: DataFrame, path: str, format: str = "parquet", partition_by: list[str] = (), mode: str = "error", rows_per_file: int | None = None, **options) -> None:
    w = df.write.format(format).mode(mode).options(**options)
    if rows_per_file:
        w = w.option("maxRecordsPerFile", rows_per_file)
    (w.partitionBy(*partition_by) if partition_by else w).save(path)


def export_database(tables: dict[str, DataFrame], path: str, format: str = "parquet") -> None:
    """Each table to a folder of its name, and a folder with their schemas."""
    for name, df in tables.items():
        copy_to(df, f"{path}/{name}", format, mode="overwrite")
    any_ = next(iter(tables.values()))
    any_.sparkSession.createDataFrame([(n, format, json.dumps(d.schema.jsonValue())) for n, d in tables.items()], "name string, format string, schema string").coalesce(1).write.mode("overwrite").json(f"{path}/_schema.json")


def import_database(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    from pyspark.sql.types import StructType

    return {r["name"]: spark.read.format(r["format"]).schema(StructType.fromJson(json.loads(r["schema"]))).load(f"{path}/{r['name']}") for r in spark.read.json(f"{path}/_schema.json").collect()}


def copy_from(spark: SparkSession, table: str, path: str, format: str = "parquet", **options) -> None:
    """Bulk load into a table, by column name."""
    df = spark.read.format(format).options(**options)
    df = df.schema(spark.table(table).schema).load(path) if format in ("csv", "json") else df.load(path)
    df.select(*spark.table(table).columns).write.insertInto(table)


def read_delta(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """Needs the Delta package on the session's class path; Spark says so if it is absent."""
    r = spark.read.format("delta")
    return (r.option("versionAsOf", version) if version is not None else r).load(path)


def read_jdbc(spark: SparkSession, url: str, table: str, partition: tuple[str, int, int, int] | None = None, **options) -> DataFrame:
    """partition: (column, low, high, partitions) to read in parallel."""
    r = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if partition:
        r = r.options(partitionColumn=partition[0], lowerBound=partition[1], upperBound=partition[2], numPartitions=partition[3])
    return r.load()
