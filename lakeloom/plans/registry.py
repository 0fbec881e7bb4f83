"""All registered queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lakeloom.functions.numbers import rounded
from lakeloom.session import views

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_oracles: dict[str, str] = {}


def sql(name: str, text: str, oracle: str | None = None) -> None:
    """A query in Spark SQL; without another text the same one is the oracle."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir, text)
        return spark.sql(text)

    run.__name__ = name
    _queries[name], _oracles[name] = run, oracle or text


def query(oracle: str | None = None):
    """Registers a function of (spark, sf_dir) under its name."""

    def register(f):
        _queries[f.__name__] = f
        if oracle:
            _oracles[f.__name__] = oracle
        return f

    return register


#: How results of an expression are made comparable: Spark and oracle texts.
KINDS = {
    "i": ("CAST({} AS BIGINT)", "CAST({} AS BIGINT)"),
    "d": (rounded("{0}", 6), "round(CAST({} AS DOUBLE), 6)"),
    "s": ("CAST({} AS STRING)", "CAST({} AS VARCHAR)"),
    "b": ("CAST({} AS BOOLEAN)", "CAST({} AS BOOLEAN)"),
    "t": ("CAST({} AS TIMESTAMP_NTZ)", "CAST({} AS TIMESTAMP)"),
    "D": ("CAST({} AS DATE)", "CAST({} AS DATE)"),
    "l": ("array_join(transform({}, e -> CAST(e AS STRING)), ',')", "array_to_string({}, ',')"),
}


def family(name: str, source: str, key: str, rows: list[tuple], oracle_source: str | None = None, group: str = "") -> None:
    """One query with a column for each function: (alias, kind, expression[, oracle's expression]). An expression may be a
    function that gives a Column."""
    from pyspark.sql import functions as F

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir, source)
        base = spark.sql(f"SELECT * FROM {source}")
        made = base.select("*", *[r[2]().alias(f"x_{r[0]}") for r in rows if callable(r[2])])
        columns = [F.expr(KINDS[r[1]][0].format(f"x_{r[0]}" if callable(r[2]) else r[2])).alias(r[0]) for r in rows]
        keys = [F.expr(k) for k in key.split(",")] if key else []
        if group:
            texts = [KINDS[r[1]][0].format(r[2]) + f" AS {r[0]}" for r in rows]
            base.createOrReplaceTempView(f"base_{name}")
            return spark.sql(f"SELECT {', '.join([key, *texts])} FROM base_{name} GROUP BY {group}")
        return made.select(*keys, *columns)

    run.__name__ = name
    texts = [KINDS[r[1]][1].format(r[3] if len(r) > 3 else r[2]) + f" AS {r[0]}" for r in rows]
    _queries[name] = run
    _oracles[name] = f"SELECT {', '.join([*([key] if key else []), *texts])} FROM {oracle_source or source}" + (f" GROUP BY {group}" if group else "")


def _load() -> None:
    from lakeloom.plans import dialect_queries, functions_, relational, statements, tpch  # noqa: F401
    from lakeloom.sources import queries as sources  # noqa: F401
    from lakeloom.streaming import queries as streaming  # noqa: F401


def queries() -> dict:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_oracles)
