"""Structured Streaming over the events table, checked against batch SQL.

Each query reads the folder as a stream, runs until all that is there is processed, and returns what the sink holds. The
sink is Parquet in the shared folder, so results are read back like any table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.plans.registry import query
from lakeloom.session import checkpoint_dir


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a stream with an event time; the static schema is read first, as file streams demand."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    s = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).parquet(_folder(spark, sf_dir))
    return s.withColumn("at", F.col("ts").cast("timestamp"))


def _folder(spark: SparkSession, sf_dir: str) -> str:
    """File streams read folders: where the table is one file, a copy in one."""
    at = _new(spark)
    spark.read.parquet(f"{sf_dir}/events.parquet").write.parquet(at)
    return at


def _new(spark: SparkSession) -> str:
    checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"


def run(df: DataFrame, mode: str = "append", at: str | None = None, state: str | None = None) -> DataFrame:
    """Processes all that is there, and returns the sink. With the sink and state of an earlier run, goes on from there."""
    spark = df.sparkSession
    at = at or _new(spark)
    w = df.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", state or _new(spark))
    if mode == "append":
        w = w.format("parquet").option("path", at)
    else:  # each batch gives the whole result anew; the last one stays
        w = w.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(at))
    w.start().awaitTermination()
    return spark.read.schema(df.schema).parquet(at)


HOUR = "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS v FROM events GROUP BY ALL"


@query(HOUR)
def stream_tumbling(spark, d):
    w = stream(spark, d).groupBy(F.window("at", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"))
    return run(w.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("s", 2).alias("v")), "complete")


@query("SELECT s::TIMESTAMP AS start, count(*) AS n FROM events, LATERAL (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS s) GROUP BY s")
def stream_sliding(spark, d):
    w = stream(spark, d).groupBy(F.window("at", "2 hours", "1 hour")).agg(F.count(F.lit(1)).alias("n"))
    return run(w.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n"), "complete")


@query("SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(g) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS g FROM events)) GROUP BY user_id, k")
def stream_session(spark, d):
    w = stream(spark, d).groupBy(F.session_window("at", "2 hours"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return run(w.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n"), "complete")


@query("SELECT event_id, user_id FROM events WHERE event_type = 'error' AND value > 50")
def stream_filter(spark, d):
    return run(stream(spark, d).where("event_type = 'error' and value > 50").select("event_id", "user_id"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, d):
    return run(stream(spark, d).withWatermark("at", "36500 days").dropDuplicatesWithinWatermark(["user_id", "event_type"]).select("user_id", "event_type"))


@query("SELECT event_id, n_name FROM events JOIN nation ON user_id % 25 = n_nationkey WHERE event_type = 'click'")
def stream_static_join(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet")
    return run(stream(spark, d).where("event_type = 'click'").join(F.broadcast(n), F.expr("user_id % 25 = n_nationkey")).select("event_id", "n_name"))  # nation has 25 rows


@query("SELECT a.event_id AS error_id, b.event_id AS click_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 10 MINUTE WHERE a.event_type = 'error' AND b.event_type = 'click'")
def stream_stream_join(spark, d):
    s = stream(spark, d)
    a = s.where("event_type = 'error'").select(F.col("event_id").alias("error_id"), F.col("user_id").alias("u"), F.col("at").alias("error_at")).withWatermark("error_at", "1 day")
    b = stream(spark, d).where("event_type = 'click'").select(F.col("event_id").alias("click_id"), "user_id", "at").withWatermark("at", "1 day")
    return run(a.join(b, F.expr("u = user_id AND at BETWEEN error_at AND error_at + INTERVAL 10 MINUTES")).select("error_id", "click_id"))


@query("SELECT user_id, count(*) AS n, max(event_id) AS last FROM events GROUP BY user_id")
def stream_custom_state(spark, d):
    """State of one's own for each user: counts and the newest id, updated batch by batch, emitted as updates; the last update of a user counts."""
    import pandas as pd

    def update(key, frames, state):
        n, last = state.get if state.exists else (0, -1)
        for p in frames:
            n, last = n + len(p), max(last, int(p.event_id.max()))
        state.update((n, last))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "last": [last]})

    s = stream(spark, d).select("user_id", "event_id").groupBy("user_id")
    out = run(s.applyInPandasWithState(update, "user_id long, n long, last long", "n long, last long", "append", "NoTimeout"))
    return out.groupBy("user_id").agg(F.max("n").alias("n"), F.max("last").alias("last"))


@query("SELECT start, n FROM (SELECT date_trunc('day', ts) AS start, count(*) AS n FROM events GROUP BY ALL) WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR")
def stream_watermark(spark, d):
    """Append mode: a day's window comes out when the watermark has passed its end. The first day's events come a second time,
    in a later run: they are late, and must not be counted."""
    at, sink, state = _new(spark), _new(spark), _new(spark)
    e = spark.read.parquet(f"{d}/events.parquet")
    e.write.parquet(at)
    s = spark.readStream.schema(e.schema).parquet(at).withColumn("at", F.col("ts").cast("timestamp"))
    w = s.withWatermark("at", "1 hour").groupBy(F.window("at", "1 day")).agg(F.count(F.lit(1)).alias("n"))
    w = w.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n")
    run(w, at=sink, state=state)
    day = F.date_trunc("day", "ts")
    first = e.agg(F.min(day).alias("first"))  # one row
    e.join(F.broadcast(first), day == F.col("first")).drop("first").write.mode("append").parquet(at)
    return run(w, at=sink, state=state)
