"""Joins that Spark has no operator for: as-of, range, interval, positional, mark, single and delimited joins.

All are compositions of DataFrame operations; none leaves the JVM, none falls back to a nested loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.session import checkpoint_dir


def asof_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, by: list[str] | None = None, op: str = ">=", how: str = "left", bucket: float | None = None) -> DataFrame:
    """Each left row with the one right row nearest to it for which `left_on op right_on` holds, and equal `by` columns.

    Columns of right but `by` are added; inner drops rows without a match. Both sides are sorted together once per key.
    With `bucket` (a width in the units of the ordering, seconds for timestamps) a key's rows are dealt out by bucket, and
    what an earlier bucket has last is carried over: no key is sorted in one task."""
    if op not in (">=", ">", "<=", "<"):
        raise ValueError("an as-of join takes exactly one of >=, >, <=, <")
    by = by or []
    added = [c for c in right.columns if c not in by]
    if clash := set(added) & set(left.columns):
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    lrow, rrow = F.struct(*[F.col(c) for c in left.columns if c not in by]), F.struct(*[F.col(c) for c in added])
    first_right = op in (">=", "<=")
    none = lambda df, cols: F.lit(None).cast(df.select(F.struct(*cols)).schema[0].dataType)
    ltype, rtype = none(left, [c for c in left.columns if c not in by]), none(right, added)
    keys = [F.col(c) for c in by]
    l = left.select(*keys, F.col(left_on).alias("_at"), F.lit(1 if first_right else 0).alias("_side"), lrow.alias("_l"), rtype.alias("_r"))  # noqa: E741
    r = right.where(F.col(right_on).isNotNull()).select(*keys, F.col(right_on).alias("_at"), F.lit(0 if first_right else 1).alias("_side"), ltype.alias("_l"), rrow.alias("_r"))
    both = l.unionByName(r)
    back = op in (">=", ">")
    order = [F.col("_at").asc() if back else F.col("_at").desc(), "_side", "_r"]
    part = [*by]
    if bucket is not None:
        seconds = F.col("_at").cast("timestamp").cast("double") if dict(left.dtypes)[left_on].startswith(("timestamp", "date")) else F.col("_at").cast("double")
        both = both.withColumn("_b", F.floor(seconds / bucket))
        part.append("_b")
    over = Window.partitionBy(*part or [F.lit(0)]).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = both.withColumn("_m", F.last("_r", ignorenulls=True).over(over))
    if bucket is not None:
        last = r.withColumn("_b", F.floor((F.col("_at").cast("timestamp").cast("double") if dict(left.dtypes)[left_on].startswith(("timestamp", "date")) else F.col("_at").cast("double")) / bucket))
        pick = F.max_by if back else F.min_by
        last = last.groupBy(*by, "_b").agg(pick("_r", F.struct("_at", "_r")).alias("_e"))
        slots = both.select(*by, "_b").distinct().join(last, [*by, "_b"], "left") if not by else both.select(*by, "_b").distinct().alias("s").join(last.alias("e"), [F.col(f"s.{c}").eqNullSafe(F.col(f"e.{c}")) for c in [*by, "_b"]], "left").select("s.*", "e._e")
        w = Window.partitionBy(*by or [F.lit(0)]).orderBy(F.col("_b").asc() if back else F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)
        slots = slots.withColumn("_c", F.last("_e", ignorenulls=True).over(w)).drop("_e")
        out = out.alias("o").join(slots.alias("s"), [F.col(f"o.{c}").eqNullSafe(F.col(f"s.{c}")) for c in [*by, "_b"]], "left").select("o.*", F.col("s._c")).withColumn("_m", F.coalesce("_m", "_c"))
    out = out.where(F.col("_l").isNotNull() & (F.col("_m").isNotNull() if how == "inner" else F.lit(True)))
    match = F.when(F.col("_at").isNotNull(), F.col("_m"))
    return out.withColumn("_m", match).where(F.col("_m").isNotNull() if how == "inner" else F.lit(True)).select(*[c if c in by else F.col(f"_l.{c}").alias(c) for c in left.columns], *[F.col(f"_m.{c}").alias(c) for c in added])


def range_join(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, width: float, how: str = "inner") -> DataFrame:
    """Points with the ranges in which they lie (low <= at <= high).

    A range goes to at most three buckets of a size near its own, a point to one bucket of each size that occurs; so an
    equality joins them, however the lengths of ranges differ."""
    span = F.greatest(F.col(high).cast("double") - F.col(low).cast("double"), F.lit(0.0))
    level = F.when(span <= width, 0).otherwise(F.ceil(F.log2(span / width))).cast("int")
    r = ranges.where(F.col(low) <= F.col(high)).withColumn("_level", level)
    levels = [x[0] for x in r.select("_level").distinct().orderBy("_level").collect()]  # at most about 60 sizes
    size = F.lit(float(width)) * F.pow(F.lit(2.0), F.col("_level"))
    r = r.withColumn("_b", F.explode(F.sequence(F.floor(F.col(low).cast("double") / size), F.floor(F.col(high).cast("double") / size))))
    p = points.withColumn("_row", F.monotonically_increasing_id()) if how == "left" else points
    q = p.withColumn("_level", F.explode(F.array(*[F.lit(x) for x in levels]) if levels else F.array().cast("array<int>"))).withColumn("_b", F.floor(F.col(at).cast("double") / size))
    out = q.join(r, ["_level", "_b"]).where(F.col(at).between(F.col(low), F.col(high))).drop("_level", "_b")
    if how == "inner":
        return out
    hit = out.select("_row", *[c for c in ranges.columns])
    return p.join(hit, "_row", "left").drop("_row")


def interval_join(left: DataFrame, right: DataFrame, l: tuple[str, str], r: tuple[str, str], width: float) -> DataFrame:  # noqa: E741
    """Pairs whose closed intervals overlap.

    An interval has a size, `width` times a power of two that is no shorter, and a pair meets at the larger of its two
    sizes. There each touches two or three buckets, however lengths differ; a pair is made only in the first bucket that
    both touch, so none comes twice."""
    level = lambda start, end: F.when((n := F.col(end).cast("double") - F.col(start).cast("double")) <= width, 0).otherwise(F.ceil(F.log2(n / width))).cast("int")
    sized = [d.where(F.col(a) <= F.col(b)).withColumn(name, level(a, b)) for d, (a, b), name in ((left, l, "_ll"), (right, r, "_rl"))]
    levels = sorted({x[0] for d, name in zip(sized, ("_ll", "_rl"), strict=True) for x in d.select(name).distinct().collect()})  # at most about 60 sizes
    all_ = F.array(*[F.lit(x) for x in levels]) if levels else F.array().cast("array<int>")
    size = F.lit(float(width)) * F.pow(F.lit(2.0), F.col("_level"))

    def dealt(df, start, end, own, name):
        d = df.withColumn("_level", F.explode(F.filter(all_, lambda x: x >= F.col(own))))
        a, b = (F.floor(F.col(c).cast("double") / size) for c in (start, end))
        return d.withColumn(name, a).withColumn("_b", F.explode(F.sequence(a, b)))

    both = dealt(sized[0], *l, "_ll", "_lb").join(dealt(sized[1], *r, "_rl", "_rb"), ["_level", "_b"])
    both = both.where((F.col("_level") == F.greatest("_ll", "_rl")) & (F.col("_b") == F.greatest("_lb", "_rb")))
    return both.where((F.col(l[0]) <= F.col(r[1])) & (F.col(r[0]) <= F.col(l[1]))).drop("_level", "_b", "_lb", "_rb", "_ll", "_rl")


def with_row_index(df: DataFrame, *order, name: str = "_i") -> DataFrame:
    """df with a dense index from 0 in the given order: sorted by ranges, then each partition adds what those before it hold. Only the partitions' sizes come to the driver."""
    checkpoint_dir(df.sparkSession)
    d = df.orderBy(*order).withColumn("_p", F.spark_partition_id()).withColumn("_n", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).checkpoint()
    sizes, base, before = sorted((r["_p"], r["count"]) for r in d.groupBy("_p").count().collect()), {}, 0
    for p, n in sizes:
        base[p], before = before, before + n
    offset = F.create_map(*[F.lit(x) for kv in base.items() for x in kv]) if base else F.create_map(F.lit(0), F.lit(0))
    return d.withColumn(name, (F.col("_n") + offset[F.col("_p")]).cast("long")).drop("_p", "_n")


def positional_join(left: DataFrame, right: DataFrame, left_order: list, right_order: list) -> DataFrame:
    """Row i beside row i; the shorter side is padded with nulls."""
    a, b = with_row_index(left, *left_order), with_row_index(right, *right_order)
    return a.join(b, "_i", "full").orderBy("_i").drop("_i")


def mark_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, mark: str = "mark") -> DataFrame:
    """left with a three-valued flag as of `left_on IN (SELECT right_on ..)`."""
    keys = right.select(F.col(right_on).alias("_k")).distinct()
    facts = keys.agg(F.count(F.lit(1)).alias("_n"), F.coalesce(F.bool_or(F.col("_k").isNull()), F.lit(False)).alias("_null"))  # one row
    out = left.join(keys.where("_k is not null"), F.col(left_on) == F.col("_k"), "left").crossJoin(F.broadcast(facts))
    flag = F.when(F.col("_n") == 0, F.lit(False)).when(F.col(left_on).isNull(), F.lit(None).cast("boolean")).when(F.col("_k").isNotNull(), F.lit(True)).when(F.col("_null"), F.lit(None).cast("boolean")).otherwise(F.lit(False))
    return out.withColumn(mark, flag).drop("_k", "_n", "_null")


def single_join(left: DataFrame, right: DataFrame, on: list[str], value: str, name: str) -> DataFrame:
    """left with the one value that right has for its key, null if none; more than one is an error."""
    one = right.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"), F.first(value).alias(name))
    one = one.withColumn(name, F.when(F.col("_n") > 1, F.raise_error(F.lit("more than one row for a scalar"))).otherwise(F.col(name))).drop("_n")
    return left.join(one, on, "left")


def delim_join(outer: DataFrame, keys: list[str], inner) -> DataFrame:
    """A correlated subquery by hand: `inner` maps the distinct keys to rows with these keys, which are joined back."""
    return outer.join(inner(outer.select(*keys).distinct()), keys, "left")


def theta_join(left: DataFrame, right: DataFrame, condition: Column, how: str = "inner") -> DataFrame:
    """Any condition; with an equality in it Spark hashes, without one it compares blocks."""
    return left.join(right, condition, how)
