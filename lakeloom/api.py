"""A connection and lazy relations over Spark: what users of an embedded SQL engine's Python API call.

    con = connect(spark)
    con.read_parquet("orders.parquet").create_view("orders")
    con.sql("FROM orders SELECT * EXCLUDE (o_orderdate) QUALIFY row_number() OVER (...) = 1").df()

Texts go through the dialect translator (dialect.py); everything stays a lazy DataFrame until a result is fetched."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom import dialect
from lakeloom.operators import joins, rows
from lakeloom.session import session
from lakeloom.sources import connectors


class Relation:
    def __init__(self, df: DataFrame, con: Connection, alias: str = ""):
        self.frame, self.con, self.alias = df, con, alias

    def _new(self, df: DataFrame) -> Relation:
        return Relation(df, self.con)

    # shape
    @property
    def columns(self) -> list[str]:
        return self.frame.columns

    @property
    def types(self) -> list[str]:
        return [t for _, t in self.frame.dtypes]

    @property
    def shape(self) -> tuple[int, int]:
        return self.frame.count(), len(self.frame.columns)

    def __len__(self) -> int:
        return self.frame.count()

    # operators
    def project(self, *items: str | Column) -> Relation:
        if len(items) == 1 and isinstance(items[0], str):
            return self.query("_r", f"SELECT {items[0]} FROM _r")
        return self._new(self.frame.select(*items))

    select = project

    def filter(self, condition: str | Column) -> Relation:
        return self._new(self.frame.where(dialect.expression(condition) if isinstance(condition, str) else condition))

    def aggregate(self, items: str, group: str = "") -> Relation:
        return self.query("_r", f"SELECT {items} FROM _r" + (f" GROUP BY {group}" if group else " GROUP BY ALL" if dialect.mixes_columns(items) else ""))

    def order(self, items: str) -> Relation:
        return self.query("_r", f"SELECT * FROM _r ORDER BY {items}")

    def sort(self, *items: str | Column) -> Relation:
        return self._new(self.frame.orderBy(*items))

    def limit(self, n: int, offset: int = 0) -> Relation:
        return self._new(self.frame.offset(offset).limit(n))

    def distinct(self) -> Relation:
        return self._new(self.frame.distinct())

    def union(self, other: Relation) -> Relation:
        return self._new(self.frame.union(other.frame))

    def union_by_name(self, other: Relation) -> Relation:
        return self._new(rows.union_by_name(self.frame, other.frame))

    def except_(self, other: Relation) -> Relation:
        return self._new(self.frame.exceptAll(other.frame))

    def intersect(self, other: Relation) -> Relation:
        return self._new(self.frame.intersectAll(other.frame))

    def cross(self, other: Relation) -> Relation:
        return self._new(self.frame.crossJoin(other.frame))

    def set_alias(self, name: str) -> Relation:
        return Relation(self.frame.alias(name), self.con, name)

    def join(self, other: Relation, condition: str | Column, how: str = "inner") -> Relation:
        """A column name, comma-separated names, or a condition on aliases."""
        if isinstance(condition, str):
            names = [c.strip() for c in condition.split(",")]
            on: Any = names if all(n in self.columns and n in other.columns for n in names) else F.expr(dialect.translate_expression(condition))
        else:
            on = condition
        return self._new(self.frame.join(other.frame, on, {"semi": "left_semi", "anti": "left_anti", "outer": "full"}.get(how, how)))

    def asof_join(self, other: Relation, left_on: str, right_on: str, by: list[str] | None = None, op: str = ">=", how: str = "left") -> Relation:
        return self._new(joins.asof_join(self.frame, other.frame, left_on, right_on, by, op, how))

    def positional_join(self, other: Relation, left_order: list, right_order: list) -> Relation:
        return self._new(joins.positional_join(self.frame, other.frame, left_order, right_order))

    def query(self, name: str, text: str) -> Relation:
        self.frame.createOrReplaceTempView(name)
        return self.con.sql(text)

    def map(self, f: Callable, schema: str) -> Relation:
        """f maps one pandas frame to another, batch by batch."""
        return self._new(self.frame.mapInPandas(lambda it: (f(p) for p in it), schema))

    def map_arrow(self, f: Callable[[Iterator], Iterator], schema: str) -> Relation:
        return self._new(self.frame.mapInArrow(f, schema))

    def unnest(self, column: str) -> Relation:
        return self._new(self.frame.withColumn(column, F.explode(column)))

    def pivot(self, on: str, values: list, keys: list[str], **aggs: Column) -> Relation:
        return self._new(rows.pivot(self.frame, on, values, keys, **aggs))

    def unpivot(self, ids: list[str], columns: list[str], name: str = "name", value: str = "value") -> Relation:
        return self._new(rows.unpivot(self.frame, ids, columns, name, value))

    def sample(self, percent: float, seed: int = 42) -> Relation:
        return self._new(rows.sample(self.frame, percent, seed))

    def describe(self) -> Relation:
        return self._new(rows.summarize(self.frame))

    def _one(self, f: Callable[[str], Column], column: str, group: str = "") -> Relation:
        keys = [g.strip() for g in group.split(",") if g.strip()]
        return self._new((self.frame.groupBy(*keys) if keys else self.frame.groupBy()).agg(f(column)))

    # results
    def df(self):
        return self.frame.toPandas()

    def arrow(self):
        return self.frame.toArrow()

    def spark(self) -> DataFrame:
        return self.frame

    def fetchall(self) -> list[tuple]:
        return [tuple(r) for r in self.frame.collect()]

    def fetchmany(self, n: int = 1) -> list[tuple]:
        return [tuple(r) for r in self.frame.limit(n).collect()]

    def fetchone(self) -> tuple | None:
        r = self.frame.first()
        return None if r is None else tuple(r)

    def stream(self) -> Iterator[tuple]:
        """Rows one partition at a time."""
        return (tuple(r) for r in self.frame.toLocalIterator(prefetchPartitions=True))

    def show(self, n: int = 20) -> None:
        self.frame.show(n)

    def explain(self, mode: str = "formatted") -> str:
        return self.frame._jdf.queryExecution().explainString(self.frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))

    # sinks
    def create_view(self, name: str, replace: bool = True) -> Relation:
        (self.frame.createOrReplaceTempView if replace else self.frame.createTempView)(name)
        return self.set_alias(name)

    def create(self, name: str) -> None:
        self.frame.write.saveAsTable(name)

    to_table = create

    def insert_into(self, name: str) -> None:
        self.frame.select(*self.frame.sparkSession.table(name).columns).write.insertInto(name)

    def to_parquet(self, path: str, **options) -> None:
        connectors.copy_to(self.frame, path, "parquet", **options)

    def to_csv(self, path: str, **options) -> None:
        connectors.copy_to(self.frame, path, "csv", **{"header": True, **options})

    def to_json(self, path: str, **options) -> None:
        connectors.copy_to(self.frame, path, "json", **options)


for _name, _f in {"count": F.count, "sum": F.sum, "avg": F.avg, "mean": F.avg, "min": F.min, "max": F.max, "median": F.median, "mode": F.mode, "std": F.stddev, "stddev": F.stddev, "stddev_pop": F.stddev_pop, "var": F.variance, "variance": F.variance, "var_pop": F.var_pop, "product": F.product, "bit_and": F.bit_and, "bit_or": F.bit_or, "bit_xor": F.bit_xor, "bool_and": F.bool_and, "bool_or": F.bool_or, "any_value": F.any_value, "list": lambda c: F.transform(F.collect_list(F.struct(F.col(c).alias("x"))), lambda s: s["x"])}.items():
    setattr(Relation, _name, (lambda f: lambda self, column="*", group="": self._one(f, column, group))(_f))


class Connection:
    def __init__(self, spark: SparkSession):
        self.spark = spark

    def sql(self, text: str, params: dict | list | None = None) -> Relation:
        """One query or statement in the engine's dialect; `$name`, `$1` and `?` are parameters."""
        return Relation(dialect.run(self.spark, text, params), self)

    query = execute = sql

    def table(self, name: str) -> Relation:
        return Relation(self.spark.table(name), self, name)

    view = table

    def values(self, *tuples: tuple) -> Relation:
        return Relation(self.spark.createDataFrame([*tuples], [f"col{i}" for i in range(len(tuples[0]))]), self)

    def from_df(self, frame) -> Relation:
        return Relation(self.spark.createDataFrame(frame), self)

    from_arrow = from_df

    def register(self, name: str, data) -> Relation:
        return (data if isinstance(data, Relation) else self.from_df(data)).create_view(name)

    def unregister(self, name: str) -> None:
        self.spark.catalog.dropTempView(name)

    def read_parquet(self, *paths: str, **options) -> Relation:
        return Relation(connectors.read_parquet(self.spark, *paths, **options), self)

    def read_csv(self, path: str, schema: str | None = None, **options) -> Relation:
        return Relation(connectors.read_csv(self.spark, path, schema, **options), self)

    def read_json(self, path: str, schema: str | None = None, **options) -> Relation:
        return Relation(connectors.read_json(self.spark, path, schema, **options), self)

    def read_text(self, path: str) -> Relation:
        return Relation(connectors.read_text(self.spark, path), self)

    def create_function(self, name: str, f: Callable, returns: str, arrow: bool = True) -> None:
        """A scalar function; nulls give null without a call. With arrow it takes and gives pandas series."""

        def skip_null(*a):
            return None if any(x is None for x in a) else f(*a)

        self.spark.udf.register(name, F.pandas_udf(f, returns) if arrow else F.udf(skip_null, returns))

    def remove_function(self, name: str) -> None:
        self.spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {name}")

    def set(self, key: str, value) -> None:
        self.spark.conf.set(key, str(value))

    def tables(self) -> Relation:
        return Relation(self.spark.sql("SHOW TABLES"), self)

    def export_database(self, path: str, names: list[str], format: str = "parquet") -> None:
        connectors.export_database({n: self.spark.table(n) for n in names}, path, format)

    def import_database(self, path: str) -> list[str]:
        found = connectors.import_database(self.spark, path)
        for name, df in found.items():
            df.createOrReplaceTempView(name)
        return list(found)


def connect(spark: SparkSession | None = None) -> Connection:
    con = Connection(spark or session())
    dialect.install(con.spark)
    return con
