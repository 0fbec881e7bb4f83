"""Limits by percent, samples, set operations by name, recursion, pivots, star modifiers and changes of rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from lakeloom.session import checkpoint_dir


def limit_percent(df: DataFrame, percent: float, *order) -> DataFrame:
    return df.orderBy(*order).limit(int(df.count() * percent / 100))


def reservoir(df: DataFrame, rows: int, seed: int = 42) -> DataFrame:
    """`rows` rows drawn evenly, or all: those with the smallest random numbers. Each task keeps as many as are drawn, no more."""
    return df.orderBy(F.rand(seed)).limit(rows)


def sample(df: DataFrame, percent: float, seed: int = 42) -> DataFrame:
    return df.sample(fraction=percent / 100, seed=seed)


def union_by_name(*frames: DataFrame, distinct: bool = False) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.distinct() if distinct else out


def unnest_recursive(df: DataFrame, column: str) -> DataFrame:
    """A row for each value within nested lists, as many levels as the type has; null and empty lists give none."""
    while isinstance(df.schema[column].dataType, ArrayType):
        df = df.select(*[F.explode(c).alias(c) if c == column else F.col(c) for c in df.columns])
    return df


def recursive(seed: DataFrame, step: Callable[[DataFrame], DataFrame], distinct: bool = True, rounds: int = 1000) -> DataFrame:
    """A fixpoint: step maps the newest rows to further ones until none is new. Each round is a checkpoint in the shared folder."""
    checkpoint_dir(seed.sparkSession)
    new = (seed.distinct() if distinct else seed).checkpoint()
    out = new
    for _ in range(rounds):
        new = step(new)
        if distinct:  # nulls are equal, so that a row with one doesn't come again for ever
            known = out.toDF(*(f"_k{i}" for i in range(len(out.columns))))
            new = new.distinct().join(known, [F.col(f"`{c}`").eqNullSafe(F.col(k)) for c, k in zip(new.columns, known.columns, strict=True)], "left_anti")
        new = new.checkpoint()
        if new.isEmpty():
            return out
        out = out.union(new)  # checkpoints of the rounds, side by side; nothing is written again
    raise RuntimeError("the recursion did not end")


def recursive_by_key(seed: DataFrame, step: Callable[[DataFrame], DataFrame], keys: list[str], better: Callable[[str], Column], value: str, rounds: int = 1000) -> DataFrame:
    """USING KEY recursion: one row for each key, replaced while `better` (F.min or F.max) finds another value."""
    checkpoint_dir(seed.sparkSession)
    out = seed.groupBy(*keys).agg(better(value).alias(value)).checkpoint()
    new = out
    for _ in range(rounds):
        all_ = out.unionByName(step(new).select(*out.columns)).groupBy(*keys).agg(better(value).alias(value))
        all_ = all_.checkpoint()
        new = all_.join(out, [*keys, value], "left_anti").checkpoint()
        if new.isEmpty():
            return all_
        out = all_
    raise RuntimeError("the recursion did not end")


def pivot(df: DataFrame, on: str, values: list, keys: list[str], **aggs: Column) -> DataFrame:
    return df.groupBy(*keys).pivot(on, values).agg(*[c.alias(n) for n, c in aggs.items()])


def unpivot(df: DataFrame, ids: list[str], columns: list[str], name: str = "name", value: str = "value", include_nulls: bool = False) -> DataFrame:
    out = df.unpivot(ids, columns, name, value)
    return out if include_nulls else out.where(F.col(value).isNotNull())


def star(df: DataFrame, exclude: list[str] = (), replace: dict[str, Column] | None = None, rename: dict[str, str] | None = None) -> DataFrame:
    """* EXCLUDE / REPLACE / RENAME."""
    return df.withColumns(replace or {}).drop(*exclude).withColumnsRenamed(rename or {})


def columns(df: DataFrame, pattern: str, apply: Callable[[Column], Column] = lambda c: c) -> list[Column]:
    """COLUMNS('re'): every column whose name matches, through a function."""
    return [apply(F.col(c)).alias(c) for c in df.columns if re.search(pattern, c)]


def upsert(base: DataFrame, new: DataFrame, keys: list[str], on_conflict: str = "replace") -> DataFrame:
    """INSERT OR REPLACE / OR IGNORE as a new state of the table; rows of `new` are one for each key, the last wins by order of columns."""
    one = new.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in new.columns if c not in keys] or keys))).where("_r = 1").drop("_r")
    if on_conflict == "ignore":
        return base.unionByName(one.join(base.select(*keys), keys, "left_anti").select(*base.columns))
    return base.join(one.select(*keys), keys, "left_anti").select(*base.columns).unionByName(one.select(*base.columns))


def update(base: DataFrame, condition: Column, **values: Column) -> DataFrame:
    return base.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def delete(base: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is not true: null keeps a row."""
    return base.where(~F.coalesce(condition, F.lit(False)))


def delete_using(base: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    return base.join(other, keys, "left_anti")


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """(bin, low, high, n): equal widths between the column's smallest and largest values."""
    e = df.agg(F.min(column).alias("a"), F.max(column).alias("b"))
    width = (F.col("b") - F.col("a")) / bins
    b = F.least(F.floor((F.col(column) - F.col("a")) / F.when(width == 0, 1).otherwise(width)), F.lit(bins - 1))
    return df.where(F.col(column).isNotNull()).crossJoin(F.broadcast(e)).groupBy(b.cast("int").alias("bin"), "a", "b").agg(F.count(F.lit(1)).alias("n")).select("bin", (F.col("a") + F.col("bin") * width).alias("low"), (F.col("a") + (F.col("bin") + 1) * width).alias("high"), "n")


#: Names of types as the dialect tells them.
TYPE_NAMES = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "smallint": "SMALLINT", "tinyint": "TINYINT", "double": "DOUBLE", "float": "FLOAT", "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP WITH TIME ZONE", "timestamp_ntz": "TIMESTAMP", "binary": "BLOB"}


def type_name(kind: str) -> str:
    return f"{type_name(kind[6:-1])}[]" if kind.startswith("array<") else TYPE_NAMES.get(kind, kind.upper())


def summarize(df: DataFrame) -> DataFrame:
    """One row for each column: name, type, extremes, distinct values, mean, deviation and quartiles of numbers, rows and share of nulls, from one aggregation.

    Quartiles are estimates; extremes of text are by code points."""
    aggs, rows = [], []
    for i, (c, t) in enumerate(df.dtypes):
        v, number = F.col(f"`{c}`"), t in ("int", "bigint", "smallint", "tinyint", "double", "float") or t.startswith("decimal")
        none = F.lit(None).cast("string")
        comparable = not t.startswith(("map", "struct", "variant"))
        aggs += [(F.min(v).cast("string") if comparable else F.max(none)).alias(f"a{i}"), (F.max(v).cast("string") if comparable else F.max(none)).alias(f"b{i}"), F.count(v).alias(f"c{i}"), (F.approx_count_distinct(v) if comparable else F.count(v)).alias(f"d{i}")]
        if number:
            aggs += [F.avg(v).cast("double").cast("string").alias(f"m{i}"), F.stddev(v).cast("string").alias(f"s{i}"), F.percentile_approx(v, [0.25, 0.5, 0.75]).alias(f"q{i}")]
        told = [F.col(f"m{i}"), F.col(f"s{i}"), *(F.get(f"q{i}", F.lit(k)).cast("string") for k in range(3))] if number else [none] * 5
        rows.append(F.struct(F.lit(c).alias("column_name"), F.lit(type_name(t)).alias("column_type"), F.col(f"a{i}").alias("min"), F.col(f"b{i}").alias("max"), F.col(f"d{i}").alias("approx_unique"), *(x.alias(n) for x, n in zip(told, ("avg", "std", "q25", "q50", "q75"), strict=True)), F.col("n").alias("count"), F.when(F.col("n") > 0, (100 * (F.col("n") - F.col(f"c{i}")) / F.col("n")).cast("decimal(9,2)")).alias("null_percentage")))
    return df.agg(F.count(F.lit(1)).alias("n"), *aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")
