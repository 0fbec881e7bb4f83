"""The session that the engine's semantics assume, and tables as views."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def session(master: str | None = None, **conf) -> SparkSession:
    """UTC, ANSI, last key wins in maps, adaptive plans."""
    b = SparkSession.builder
    if master:
        b = b.master(master)
    fixed = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.mapKeyDedupPolicy": "LAST_WIN", "spark.sql.adaptive.enabled": "true", "spark.sql.optimizer.runtime.bloomFilter.enabled": "true"}
    return b.config(map=fixed | {k.replace("__", "."): str(v) for k, v in conf.items()}).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str, text: str) -> None:
    """Temporary views of the tables that an SQL text names."""
    for t in TABLES:
        if re.search(rf"\b{t}\b", text):
            table(spark, sf_dir, t).createOrReplaceTempView(t)


def checkpoint_dir(spark: SparkSession) -> None:
    """Keeps the folder in spark.checkpoint.dir; sets a local one only where none is set and the master is local, as in tests."""
    if not spark.sparkContext.getCheckpointDir():
        import tempfile

        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(at or tempfile.mkdtemp(prefix="lakeloom-"))
