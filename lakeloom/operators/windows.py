"""Window frames that Spark's parser lacks: GROUPS, EXCLUDE, QUALIFY, DISTINCT aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def groups_frame(df: DataFrame, agg: Column, by: list, order, start: int, end: int, name: str) -> DataFrame:
    """An aggregate over peers' groups from `start` to `end` groups away: a dense rank is the range."""
    rank = F.dense_rank().over(Window.partitionBy(*by).orderBy(order))
    return df.withColumn("_g", rank).withColumn(name, agg.over(Window.partitionBy(*by).orderBy("_g").rangeBetween(start, end))).drop("_g")


def row_frame(by: list, row: str, low: int, high: int, kind: str = "rows"):
    """A ROWS or RANGE frame over numbered rows. One that only ends open is taken in reverse, where it only begins open: Spark
    keeps that as a running aggregate, but would go through the rest of the partition anew for each row of the other."""
    order = F.col(row)
    if high == Window.unboundedFollowing and low != Window.unboundedPreceding:
        order, low, high = order.desc(), Window.unboundedPreceding, -low
    w = Window.partitionBy(*by).orderBy(order)
    return w.rowsBetween(low, high) if kind == "rows" else w.rangeBetween(low, high)


def sum_excluding(df: DataFrame, value: str, by: list, order: list, preceding: int | None, following: int | None, name: str, exclude: str = "current row") -> DataFrame:
    """A sum over ROWS preceding..following without the current row, its group of peers, or its ties; None is UNBOUNDED."""
    w = Window.partitionBy(*by).orderBy(*order)
    low = Window.unboundedPreceding if preceding is None else -preceding
    high = Window.unboundedFollowing if following is None else following
    if exclude == "current row":
        d = df.withColumn("_row", F.row_number().over(w)) if following is None else df
        after = F.sum(value).over(w.rowsBetween(1, high) if following is not None else row_frame(by, "_row", 1, high))
        before = F.sum(value).over(w.rowsBetween(low, -1) if following is not None else row_frame(by, "_row", low, -1))
        total = F.when(before.isNull() & after.isNull(), None).otherwise(F.coalesce(before, F.lit(0)) + F.coalesce(after, F.lit(0)))
        return d.withColumn(name, total).drop("_row")
    # the frame's sum less that of the peers in it: both are running sums, whatever the width of the frame
    d = df.withColumn("_row", F.row_number().over(w))
    frame = row_frame(by, "_row", low, high)
    peers = row_frame([*by, *order], "_row", low, high, "range")
    v = F.col(value)
    left = F.count(v).over(frame) - F.count(v).over(peers)
    total = F.coalesce(F.sum(v).over(frame), F.lit(0)) - F.coalesce(F.sum(v).over(peers), F.lit(0))
    if exclude == "ties":
        own = (low <= 0 <= high) if preceding is not None and following is not None else True
        if own:
            left, total = left + v.isNotNull().cast("int"), total + F.coalesce(v, F.lit(0))
    return d.withColumn(name, F.when(left > 0, total.cast("double"))).drop("_row")


def qualify(df: DataFrame, name: str, value: Column, condition: Column | str) -> DataFrame:
    """Rows for which a condition on a window column holds; the column goes."""
    return df.withColumn(name, value).where(condition).drop(name)


def distinct_on(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key in an order."""
    return qualify(df, "_first", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)), "_first = 1")
