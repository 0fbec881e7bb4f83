"""Exact deduplication by skew-safe combining."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.llm._util import cut, prepare

#: A digest's rows are dealt over so many groups.
SALTS = 16


def salted(df: DataFrame, id_col: str, text_col: str, salts: int) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("digest", F.sha2(F.col("text").cast("binary"), 256)).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row for each row of df: <id_col>, keep_id, group_size, kept and text_sha256.

    Rows with equal texts form a group (null counts as empty); the largest id stays. Copies are combined three times: in
    each task before rows move, in each salted digest group, and over the salts; every time rows are one only if their
    whole texts are equal. A null id never wins against another. Of rows that repeat the winning id, one is kept. Other
    columns of df are not read. An empty table gives no rows."""
    prepare(df.sparkSession)
    rows = salted(df, id_col, text_col, salts)
    every = F.expr(f"filter(sequence(0, {salts - 1}), i -> shiftright(at, i) & 1 = 1)")  # the salts in which the text occurs
    local = rows.groupBy("digest", "salt", "text").agg(F.max("id").alias("id"), F.count("*").alias("n"))  # in tasks first, then in salted groups
    whole = local.groupBy("digest", "text").agg(F.max("id").alias("keep_id"), F.sum("n").alias("group_size"), F.bit_or(F.expr("shiftleft(1L, salt)")).alias("at"))
    whole = cut(whole.select("digest", "keep_id", "group_size", F.explode(every).alias("salt"), F.xxhash64("text").alias("other"), F.length("text").alias("chars")))
    clash = whole.groupBy("digest").agg(F.count_distinct("other", "chars").alias("k"), F.count("*").alias("m"), F.count_distinct("salt").alias("s")).where("k > 1 or m > s").limit(1).count()
    if clash:  # two texts of one digest: rows find their group by the text itself
        whole = local.groupBy("digest", "text").agg(F.max("id").alias("keep_id"), F.sum("n").alias("group_size"), F.bit_or(F.expr("shiftleft(1L, salt)")).alias("at")).withColumn("salt", F.explode(every))
    on = ["digest", "salt", *["text"] * bool(clash)]
    found = (rows if clash else rows.drop("text")).join(whole.drop("other", "chars", "at"), on)
    first = F.row_number().over(Window.partitionBy("digest", "salt", *["text"] * bool(clash), "id").orderBy("keep_id"))
    return found.withColumn("first", first).select(F.col("id").alias(id_col), "keep_id", "group_size", (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("first") == 1)).alias("kept"), F.col("digest").alias("text_sha256"))


def _has_map(kind) -> bool:
    """Whether values of a type hold a map or a variant, which have no order."""
    return kind.typeName() in ("map", "variant") or any(_has_map(k) for k in ([f.dataType for f in kind.fields] if kind.typeName() == "struct" else [kind.elementType] if kind.typeName() == "array" else []))


def winners(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One whole row of df, all columns, for each different text: the row with the largest id (ties: the largest of the other columns; maps are ordered by their JSON).

    Null and empty texts are equal. Copies are combined in tasks first, then in salted digest groups, then over the salts.
    Columns may have any names and types. An empty table gives no rows."""
    prepare(df.sparkSession)
    rest = [c for c in df.columns if c not in (id_col, text_col)]
    maps = {c for c in rest if _has_map(df.schema[c].dataType)}
    first = [F.to_json(F.struct(F.col(f"`{c}`").alias("v"))) if c in maps else F.col(f"`{c}`") for c in rest]
    order = F.struct(F.col(id_col).alias("id"), *(v.alias(f"c{i}") for i, v in enumerate(first)), F.col(text_col).isNotNull().alias("real"))
    rows = df.select(order.alias("row"), F.struct(F.lit(0).alias("none"), *(F.col(f"`{c}`").alias(f"c{rest.index(c)}") for c in rest if c in maps)).alias("maps"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("digest", F.sha2(F.col("text").cast("binary"), 256)).withColumn("salt", F.pmod(F.xxhash64("row.id"), F.lit(salts)).cast("int"))
    largest = [F.max("row").alias("row"), *([F.max_by("maps", "row").alias("maps")] if maps else [])]
    local = rows.groupBy("digest", "salt", "text").agg(*largest)
    whole = local.groupBy("digest", "text").agg(*largest)
    columns = {id_col: F.col("row.id"), text_col: F.when(F.col("row.real"), F.col("text")), **{c: F.col(f"{'maps' if c in maps else 'row'}.c{i}") for i, c in enumerate(rest)}}
    return whole.select(*(columns[c].alias(c) for c in df.columns))
