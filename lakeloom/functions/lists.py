"""List, map, struct and JSON functions with the reference dialect's meaning, in higher-order functions of the JVM."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def extract(l: Column, i: int) -> Column:  # noqa: E741
    """1-based, negative from the end, null outside and at 0."""
    return F.lit(None) if i == 0 else F.try_element_at(l, F.lit(i))


def slice_(l: Column, a: int, b: int, step: int = 1) -> Column:  # noqa: E741
    """Inclusive bounds, 1-based; negative ones count from the end."""
    n = F.size(l)
    lo = F.greatest(F.lit(a) if a >= 0 else n + 1 + a, F.lit(1))
    hi = F.least(F.lit(b) if b >= 0 else n + 1 + b, n)
    out = F.slice(l, lo, F.greatest(hi - lo + 1, F.lit(0)))
    return out if step == 1 else F.filter(out, lambda x, i: i % step == 0)


def position(l: Column, x) -> Column:  # noqa: E741
    return F.nullif(F.array_position(l, x), F.lit(0).cast("long"))


def concat(a: Column, b: Column) -> Column:
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.concat(a, b))


def distinct(l: Column) -> Column:  # noqa: E741
    return F.array_distinct(F.array_compact(l))


def has_all(a: Column, b: Column) -> Column:
    return F.size(F.array_except(b, a)) == 0


def grade_up(l: Column) -> Column:  # noqa: E741
    """1-based places in sorted order."""
    pairs = F.transform(l, lambda x, i: F.struct(x.alias("x"), (i + 1).alias("i")))
    return F.transform(F.array_sort(pairs), lambda p: p["i"])


def resize(l: Column, n: int, value=None) -> Column:  # noqa: E741
    return F.concat(F.slice(l, 1, n), F.array_repeat(F.lit(value), F.greatest(F.lit(n) - F.size(l), F.lit(0))))


def select(l: Column, places: Column) -> Column:  # noqa: E741
    return F.transform(places, lambda i: F.try_element_at(l, i))


def where(l: Column, mask: Column) -> Column:  # noqa: E741
    return F.filter(l, lambda x, i: F.get(mask, i))


def reduce(l: Column, f) -> Column:  # noqa: E741
    """Starts with the first element."""
    return F.aggregate(F.slice(l, F.lit(2), F.greatest(F.size(l) - 1, F.lit(0))), F.get(l, F.lit(0)), f)


def doubles(l: Column) -> Column:  # noqa: E741
    return F.transform(F.array_compact(l), lambda x: x.cast("double"))


def total(l: Column) -> Column:  # noqa: E741
    return F.when(F.size(F.array_compact(l)) > 0, F.aggregate(doubles(l), F.lit(0.0), lambda a, x: a + x))


def let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def of_doubles(l: Column, body) -> Column:  # noqa: E741
    """body(the elements that aren't null as doubles, their number)."""
    return let(doubles(l), lambda d: let(F.size(d), lambda n: body(d, n)))


def added(d: Column) -> Column:
    return F.aggregate(d, F.lit(0.0), lambda a, x: a + x)


def mean(l: Column) -> Column:  # noqa: E741
    return of_doubles(l, lambda d, n: F.when(n > 0, added(d) / n))


def of_moments(l: Column, body) -> Column:  # noqa: E741
    """body(number, sums of the second, third and fourth powers of distances from the mean), in two passes over the elements."""
    zero = F.struct(*(F.lit(0.0).alias(k) for k in "bcd"))

    def with_mean(d, n):
        step = lambda m: lambda a, x: F.struct(*((a[k] + F.pow(x - m, F.lit(p))).alias(k) for k, p in zip("bcd", (2, 3, 4), strict=True)))
        sums = lambda m: let(F.aggregate(d, zero, step(m)), lambda q: body(n.cast("double"), q["b"], q["c"], q["d"]))
        return F.when(n > 0, let(added(d) / n, sums))

    return of_doubles(l, with_mean)


def var_pop(l: Column) -> Column:  # noqa: E741
    return of_moments(l, lambda n, b, c, d: b / n)


def var_samp(l: Column) -> Column:  # noqa: E741
    return of_moments(l, lambda n, b, c, d: F.when(n > 1, b / (n - 1)))


def sem(l: Column) -> Column:  # noqa: E741
    return of_moments(l, lambda n, b, c, d: F.sqrt(b / n) / F.sqrt(n))


def skewness(l: Column) -> Column:  # noqa: E741
    return of_moments(l, lambda n, b, c, d: F.when(n > 2, (c / n) / F.pow(b / n, F.lit(1.5)) * F.sqrt(n * (n - 1)) / (n - 2)))


def kurtosis(l: Column) -> Column:  # noqa: E741
    return of_moments(l, lambda n, b, c, d: F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * ((d / n) / F.pow(b / n, F.lit(2)) - 3) + 6)))


def median(l: Column) -> Column:  # noqa: E741
    middle = lambda s, n: (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2
    return of_doubles(l, lambda d, n: F.when(n > 0, let(F.array_sort(d), lambda s: middle(s, n))))


def mad(l: Column) -> Column:  # noqa: E741
    return let(median(l), lambda m: median(F.transform(doubles(l), lambda x: F.abs(x - m))))


def histogram(l: Column) -> Column:  # noqa: E741
    """value -> count, by rising value: the lengths of the runs of the sorted elements."""

    def of_sorted(s):
        begins = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (x != F.get(s, i - 1)), i)), lambda i: i.isNotNull())
        return let(begins, lambda b: F.map_from_arrays(F.transform(b, lambda i: F.get(s, i)), F.transform(b, lambda i, k: (F.coalesce(F.get(b, k + 1), F.size(s)) - i).cast("long"))))

    return let(F.array_sort(F.array_compact(l)), of_sorted)


def mode(l: Column) -> Column:  # noqa: E741
    """Commonest element; of several the smallest."""
    most = lambda h: F.get(F.map_keys(h), (F.array_position(F.map_values(h), F.array_max(F.map_values(h))) - 1).cast("int"))
    return let(histogram(l), most)


def entropy(l: Column) -> Column:  # noqa: E741
    n = F.size(F.array_compact(l))
    return F.aggregate(F.map_values(histogram(l)), F.lit(0.0), lambda a, c: a - c / n * F.log2(c / n))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2))), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def cross(a: Column, b: Column) -> Column:
    x, y = [F.get(a, F.lit(i)) for i in range(3)], [F.get(b, F.lit(i)) for i in range(3)]
    return F.array(x[1] * y[2] - x[2] * y[1], x[2] * y[0] - x[0] * y[2], x[0] * y[1] - x[1] * y[0])


def map_extract(m: Column, k) -> Column:
    """A list with the value, or an empty one."""
    return F.when(F.map_contains_key(m, k), F.array(m[k])).otherwise(F.slice(F.array(m[k]), 1, 0))


def union_value(tags: dict[str, str], tag: str, value: Column) -> Column:
    """A tagged union: struct of the tag and one nullable member for each type."""
    return F.struct(F.lit(tag).alias("tag"), *[(value if t == tag else F.lit(None)).cast(k).alias(t) for t, k in tags.items()])


class Enum:
    """Strings ordered by their place in the declaration."""

    def __init__(self, *values: str):
        self.values = values

    def code(self, c: Column) -> Column:
        return (F.array_position(self.range(), c) - 1).cast("long")

    def range(self, first: str | None = None, last: str | None = None) -> Column:
        a = self.values.index(first) if first else 0
        b = self.values.index(last) + 1 if last else len(self.values)
        return F.array(*[F.lit(v) for v in self.values[a:b]])


def _merge(a, b):
    if not isinstance(b, dict):
        return b
    a = dict(a) if isinstance(a, dict) else {}
    for k, v in b.items():
        if v is None:
            a.pop(k, None)
        else:
            a[k] = _merge(a.get(k), v)
    return a


def _contains(a, b) -> bool:
    if isinstance(a, dict) and isinstance(b, dict) and all(k in a and _same_or_in(a[k], v) for k, v in b.items()):
        return True
    if isinstance(a, list) and isinstance(b, list):
        return all(any(_contains(x, y) for x in a) for y in b)
    if a == b:
        return True
    return any(_contains(x, b) for x in (a.values() if isinstance(a, dict) else a if isinstance(a, list) else []))


def _same_or_in(a, b) -> bool:
    return _contains(a, b)


def _json_pair(f, kind):
    @F.pandas_udf(kind)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(json.loads(x), json.loads(y)) for x, y in zip(a, b, strict=True)])

    return run


def json_merge_patch(a: Column, b: Column) -> Column:
    return _json_pair(lambda x, y: json.dumps(_merge(x, y), separators=(",", ":"), ensure_ascii=False), "string")(a, b)


def json_contains(a: Column, b: Column) -> Column:
    return _json_pair(_contains, "boolean")(a, b)


def json_type(j: Column, path: str = "$") -> Column:
    """Names of the reference dialect, from the first letters of the value."""
    v = F.get_json_object(j, path) if path != "$" else F.trim(j)
    t = F.schema_of_variant(F.try_parse_json(j)) if path == "$" else F.schema_of_variant(F.try_variant_get(F.try_parse_json(j), path, "variant"))
    num = F.when(v.startswith("-"), "BIGINT").otherwise("UBIGINT")
    return F.when(t.startswith("OBJECT"), "OBJECT").when(t.startswith("ARRAY"), "ARRAY").when(t == "STRING", "VARCHAR").when(t == "BOOLEAN", "BOOLEAN").when(t == "VOID", "NULL").when(t == "BIGINT", num).otherwise("DOUBLE")


class _Object(list):
    """Keys and values of an object, repeated keys too."""


def _structure(x):
    """A type's name, [type of the items] or {key: type}."""
    if isinstance(x, _Object):
        out = {}
        for k, v in x:
            out[k] = _both(out.get(k, "NULL"), _structure(v))
        return out
    if isinstance(x, list):
        items = "NULL"
        for v in x:
            items = _both(items, _structure(v))
        return [items]
    if isinstance(x, int) and not isinstance(x, bool):
        return "UBIGINT" if 0 <= x < 1 << 64 else "BIGINT" if -(1 << 63) <= x < 0 else "DOUBLE"
    return {type(None): "NULL", bool: "BOOLEAN", float: "DOUBLE", str: "VARCHAR"}[type(x)]


def _both(a, b):
    """The type that values of two types share."""
    if a == b or b == "NULL":
        return a
    if a == "NULL":
        return b
    if isinstance(a, list) and isinstance(b, list):
        return [_both(a[0], b[0])]
    if isinstance(a, dict) and isinstance(b, dict):
        return a | {k: _both(a.get(k, "NULL"), v) for k, v in b.items()}
    if all(isinstance(x, str) and x in ("UBIGINT", "BIGINT", "HUGEINT", "DOUBLE") for x in (a, b)):
        return "DOUBLE" if "DOUBLE" in (a, b) else "HUGEINT"
    return "JSON"


def _named(x):
    """An object without keys has no structure of its own."""
    if isinstance(x, list):
        return [_named(x[0])]
    return ({k: _named(v) for k, v in x.items()} or "JSON") if isinstance(x, dict) else x


def json_structure(j: Column) -> Column:
    """Keys and types of each row's value, in the reference dialect's names."""

    @F.pandas_udf("string")
    def run(a: pd.Series) -> pd.Series:
        made = lambda x: _named(_structure(json.loads(x, object_pairs_hook=_Object)))
        return pd.Series([None if x is None else json.dumps(made(x), separators=(",", ":"), ensure_ascii=False) for x in a])

    return run(j)


def json_group_structure(df, column: str, name: str = "structure"):
    """One row: the structure that the values of all rows share. Each task joins the structures of its rows; those of the tasks are joined last."""

    def merged(frames, read):
        out = "NULL"
        for p in frames:
            for x in p.iloc[:, 0]:
                if x is not None:
                    out = _both(out, read(x))
        return out

    dumps = lambda x: json.dumps(x, separators=(",", ":"), ensure_ascii=False)

    def part(frames):
        yield pd.DataFrame({name: [dumps(merged(frames, lambda x: _structure(json.loads(x, object_pairs_hook=_Object))))]})

    def whole(frames):
        yield pd.DataFrame({name: [dumps(_named(merged(frames, json.loads)))]})

    return df.select(column).mapInPandas(part, f"{name} string").coalesce(1).mapInPandas(whole, f"{name} string")


def schema_of_json_agg(j: Column) -> Column:
    """One type that the JSON values of all rows share, in Spark's names; other texts are passed over."""
    t = F.schema_of_variant_agg(F.try_parse_json(j))
    return F.regexp_replace(t, "OBJECT<(?=(?:[^`]*`[^`]*`)*[^`]*$)", "STRUCT<")


def json_value(j: Column, path: str) -> Column:
    """Scalars only."""
    t = json_type(j, path)
    return F.when(~t.isin("OBJECT", "ARRAY"), F.get_json_object(j, path))


def json_pretty(j: Column) -> Column:
    @F.pandas_udf("string")
    def run(a: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else json.dumps(json.loads(x), indent=4, ensure_ascii=False) for x in a])

    return run(j)


def subscripts(l: Column) -> Column:  # noqa: E741
    return F.when(F.size(l) > 0, F.sequence(F.lit(1), F.size(l))).otherwise(F.array().cast("array<int>"))


def struct_concat(df, *columns: str) -> Column:
    """One struct with the fields of several."""
    return F.struct(*[F.col(f"{c}.{f.name}").alias(f.name) for c in columns for f in df.schema[c].dataType.fields])


def equi_width_bins(low: float, high: float, n: int) -> list[float]:
    """Upper bounds of n equal bins, without rounding to nice numbers."""
    return [low + (high - low) * (i + 1) / n for i in range(n)]
