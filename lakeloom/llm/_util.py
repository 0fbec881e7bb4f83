"""What the operators share: shipping the code, the shared folder, cutting lineage, components, deterministic samples."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch that goes to Python: few long texts or many narrow rows.
BATCH_BYTES = 1 << 20

_shipped: dict[str, str] = {}


def prepare(spark: SparkSession) -> None:
    """Sends this package to the executors once per application, and bounds the bytes of Arrow batches, whatever the length of texts."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        top = os.path.dirname(root)
        path = os.path.join(tempfile.mkdtemp(prefix="lakeloom-"), f"{os.path.basename(root)}.zip")
        if root.endswith(".zip") or not os.path.isdir(root):
            _shipped[app] = ""
        else:
            with zipfile.ZipFile(path, "w") as z:
                for d, _, names in os.walk(root):
                    for n in names:
                        if n.endswith(".py"):
                            z.write(os.path.join(d, n), os.path.relpath(os.path.join(d, n), top))
            spark.sparkContext.addPyFile(path)
            _shipped[app] = path
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only where it is unset and the master is local (tests), a local one is set."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    now = spark.sparkContext.getCheckpointDir()
    if not now:
        if not at and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = at or "file://" + tempfile.mkdtemp(prefix="lakeloom-checkpoint-")
        spark.sparkContext.setCheckpointDir(at)
    return (at or now).rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder: survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def own_name(df: DataFrame, name: str) -> str:
    """`name`, with as many underscores behind it as make it a name that df has no column of, whatever the case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def held_out(doc_id: str | Column) -> Column:
    """crc32 of the id as text modulo 5 is 0. A null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def bounded_sample(df: DataFrame, key: Column, rows: int, total: int | None = None) -> DataFrame:
    """About `rows` rows, those whose hashed key is small: the same rows on every run; `limit` only bounds the rest."""
    total = df.count() if total is None else total
    share = 1.0 if total <= rows else rows / total
    return df.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).limit(2 * rows)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that can be reached, for every node of `edges` (a, b).

    Large-star and small-star steps; minima are aggregated before the join, so that a hub doesn't gather its neighbours."""
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, last = cut(e), None
    for _ in range(rounds):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        e = e.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct()
        e = cut(e)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def runs(batches, keys, least: int = 0):
    """Regroups sorted Arrow batches so that no run of equal values of the first column `keys` is cut, in tables of `least`
    rows or more, but for the last. One table is held at a time, besides a batch, and any run that goes on."""
    import pyarrow as pa
    import pyarrow.compute as pc

    held: list = []
    rows, begun = 0, 0  # held rows, and those of them before the run that goes on
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        first = pc.index(t[keys], t[keys][t.num_rows - 1]).as_py()
        if first > 0 or held and held[-1][keys][-1] != t[keys][0]:
            begun = rows + first
        held.append(t)
        rows += t.num_rows
        if begun > least:
            whole = pa.concat_tables(held)
            yield whole.slice(0, begun)
            held, rows, begun = [whole.slice(begun)], rows - begun, 0
    if held:
        yield pa.concat_tables(held)


#: Counters that tasks send in one row, so that sums are added up side by side.
CHUNK = 1 << 12


def packed_counts(counts) -> tuple[list[int], list[bytes]]:
    """A task's counters as (chunk, compressed 64-bit counts); chunks without any are left out."""
    parts = counts.astype("<i8").reshape(-1, min(CHUNK, len(counts)))
    at = [k for k, x in enumerate(parts) if x.any()]
    return at, [zlib.compress(parts[k].tobytes(), 1) for k in at]


def summed_counts(df: DataFrame, size: int):
    """The sum over all rows (chunk, counts), as one array of `size`: each chunk is added in a task of its own, and only the sums come to the driver."""
    import numpy as np
    import pyarrow as pa

    def add(batches):
        total: dict = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total[k] = total.get(k, 0) + np.frombuffer(zlib.decompress(x), "<i8")
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([zlib.compress(x.tobytes(), 1) for x in total.values()], pa.binary())], names=["chunk", "counts"])

    out = np.zeros(size, np.int64)
    width = min(CHUNK, size)
    for r in df.repartition(min(64, size // width), "chunk").mapInArrow(add, "chunk long, counts binary").collect():
        out[r["chunk"] * width : (r["chunk"] + 1) * width] = np.frombuffer(zlib.decompress(bytes(r["counts"])), "<i8")
    return out
