"""Numeric functions and aggregates whose meaning differs from Spark's, or that it lacks."""

from __future__ import annotations

import inspect
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def trunc(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")


def even(x: Column) -> Column:
    """The next even number away from zero."""
    return F.signum(x) * 2 * F.ceil(F.abs(x) / 2)


def fmod_floor(x: Column, y: Column) -> Column:
    return x - y * F.floor(x / y)


def rounded(x: str, digits: int) -> str:
    """SQL text that rounds a double as the dialect does: times a power of ten, halves away from zero, divided again. Spark's
    round takes the shortest decimal that stands for the double, so that it sees halves where the product is just below one."""
    v = f"CAST({x} AS DOUBLE)"
    r = f"round({v} * 1e{digits}D, 0) / 1e{digits}D"
    return f"CASE WHEN {r} = 0 THEN {v} * 0D WHEN abs({r}) < double('infinity') THEN {r} ELSE {v} END"


def is_finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) != float("inf"))


def _elements(f, kind: str):
    """An Arrow-batched function of one or two numbers, applied to whole arrays where no argument is null."""

    def make():
        @F.pandas_udf(kind)
        def run(*columns: pd.Series) -> pd.Series:
            out = pd.Series([None] * len(columns[0]), dtype=object)
            full = ~pd.concat(columns, axis=1).isna().any(axis=1).to_numpy()
            if full.any():
                out[full] = pd.Series(list(f(*(c[full].to_numpy() for c in columns))), index=out.index[full], dtype=object)
            return out

        if len(inspect.signature(f).parameters) == 1:

            @F.pandas_udf(kind)
            def one(a: pd.Series) -> pd.Series:
                return run.func(a)

            return one

        @F.pandas_udf(kind)
        def two(a: pd.Series, b: pd.Series) -> pd.Series:
            return run.func(a, b)

        return two

    return make


def _whole(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int64)


gamma_udf = _elements(lambda x: map(math.gamma, x), "double")
lgamma_udf = _elements(lambda x: map(math.lgamma, x), "double")
gcd_udf = _elements(lambda x, y: np.gcd(_whole(x), _whole(y)), "long")
lcm_udf = _elements(lambda x, y: np.lcm(_whole(x), _whole(y)), "long")
nextafter_udf = _elements(lambda x, y: np.nextafter(x.astype(float), y.astype(float)), "double")


def gamma(x: Column) -> Column:
    return gamma_udf()(x)


def lgamma(x: Column) -> Column:
    return lgamma_udf()(x)


def gcd(a: Column, b: Column) -> Column:
    return gcd_udf()(a, b)


def lcm(a: Column, b: Column) -> Column:
    return lcm_udf()(a, b)


def nextafter(a: Column, b: Column) -> Column:
    return nextafter_udf()(a, b)


def sem(x) -> Column:
    return F.stddev_pop(x) / F.sqrt(F.count(x))


def skewness(x) -> Column:
    """Corrected for bias."""
    n = F.count(x)
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def kurtosis(x) -> Column:
    """Of a sample: excess, corrected for bias."""
    n = F.count(x).cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6))


def geomean(x) -> Column:
    return F.exp(F.avg(F.ln(x)))


def weighted_avg(v: Column, w: Column) -> Column:
    return F.sum(v * w) / F.sum(F.when(v.isNotNull(), w))


def grouped(df: DataFrame, by: list[str], *aggs: Column) -> DataFrame:
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def entropy(df: DataFrame, by: list[str], value: str, name: str = "entropy") -> DataFrame:
    """Bits, from counts of each value: two aggregations, no lists."""
    c = grouped(df.where(F.col(value).isNotNull()), [*by, value], F.count(F.lit(1)).alias("_n"))
    n = F.sum("_n")
    return grouped(c, by, (F.log2(n) - F.sum(F.col("_n") * F.log2("_n")) / n).alias(name))


def mode(df: DataFrame, by: list[str], value: str, name: str = "mode") -> DataFrame:
    """The commonest value; of several the smallest."""
    c = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    least = c.groupBy(*by, "_n").agg(F.min(value).alias("_v"))
    return grouped(least, by, F.max_by("_v", "_n").alias(name))


def mad(df: DataFrame, by: list[str], value: str, name: str = "mad") -> DataFrame:
    """The median distance from the median."""
    m = grouped(df, by, F.median(value).alias("_m"))
    d = df.join(m, by) if by else df.crossJoin(F.broadcast(m))
    return grouped(d, by, F.median(F.abs(F.col(value) - F.col("_m"))).alias(name))


def top_k(df: DataFrame, by: list[str], value: str, k: int) -> DataFrame:
    """(by.., value, n, place): the k commonest values, ties to smaller ones; exact."""
    from pyspark.sql import Window

    c = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), value))).where(F.col("place") <= k)
