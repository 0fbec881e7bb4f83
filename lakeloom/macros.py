"""Functions of the dialect that Spark has under another name, in another form, or not at all, as text to put in their place.

A form is Spark SQL with {0}, {1}, .. for the arguments, already translated, and {*} for all of them. `{over}` stands behind
each aggregate, for a FILTER or OVER clause that follows the call. A form is chosen by the number of arguments, where it
matters; a function may also compute it from the arguments' texts."""

from __future__ import annotations

import re
from collections.abc import Callable

from lakeloom.functions.text import date_pattern

Form = str | Callable[[list[str]], str]


def literal(text: str) -> str | None:
    """What a string literal of Spark SQL says, or None for another expression."""
    m = re.fullmatch(r"\s*'((?:[^'\\]|\\.|'')*)'\s*", text, re.S)
    return re.sub(r"\\(.)|''", lambda x: x[1] or "'", m[1]) if m else None


def quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(value: str, name: str, body: str) -> str:
    """`body` with `name` for a value that is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def told(text: str, what: str) -> str:
    if (x := literal(text)) is None:
        raise NotImplementedError(f"{what} must be a literal")
    return x


def unit(text: str) -> str:
    """The singular name of a part of a date."""
    x = told(text, "a part of a date").lower()
    return {"mon": "month", "min": "minute", "sec": "second", "hr": "hour", "h": "hour", "d": "day", "y": "year", "m": "month", "w": "week", "yr": "year"}.get(x, x.rstrip("s") if x != "s" else "second")


def slice_form(base: str, low: str, high: str) -> str:
    """Inclusive bounds from 1; negative ones count from the end."""
    at = lambda x: x if re.fullmatch(r"\s*\d+\s*", x) else f"CASE WHEN ({x}) < 0 THEN size({base}) + 1 + ({x}) ELSE ({x}) END"
    first = f"greatest({at(low)}, 1)"
    return f"slice({base}, {first}, greatest(least({at(high)}, size({base})) - {first} + 1, 0))"


def _slice(a: list[str]) -> str:
    whole = slice_form(a[0], a[1], a[2])
    return whole if len(a) == 3 else f"filter({whole}, (x_, i_) -> i_ % ({a[3]}) = 0)"


def _replace(a: list[str]) -> str:
    """The first match only, but for the option g."""
    options = told(a[3], "the options of regexp_replace") if len(a) > 3 else ""
    if set(options) - set("gicsnmlp"):
        raise NotImplementedError(f"options {options}")
    flags = "".join({"i": "i", "s": "s", "n": "", "m": "", "p": ""}.get(c, "") for c in options)
    flags = f"(?{''.join(sorted(set(flags)))})" if flags else ""
    pattern, by = a[1], a[2]
    shift = 0 if "g" in options else 1
    if (x := literal(by)) is not None:
        by = quote(re.sub(r"\\(\d)|(\$)|(\\\\)", lambda m: f"${int(m[1]) + shift}" if m[1] else "\\$" if m[2] else m[0], x))
    if not shift:
        return f"regexp_replace({a[0]}, {f'concat({quote(flags)}, {pattern})' if flags else pattern}, {by})"
    return f"regexp_replace({a[0]}, concat({quote(flags + '^((?s:.*?))(?:')}, {pattern}, ')'), concat('$1', {by}))"


def path(text: str) -> str:
    """A JSON path: $-paths stay, pointers and names become one."""
    if (x := literal(text)) is None:
        return f"CASE WHEN {text} LIKE '$%' THEN {text} ELSE concat('$.', {text}) END" if not re.fullmatch(r"\s*-?\d+\s*", text) else f"'$[{text.strip()}]'"
    if x.startswith("$"):
        return quote(x)
    if x.startswith("/"):
        return quote("$" + "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in x[1:].split("/")))
    return quote(f"$['{x}']")


def _json(a: list[str]) -> str:
    """JSON text: strings keep their quotes."""
    if len(a) == 1:
        return a[0]
    p = path(a[1])
    v = f"try_variant_get(try_parse_json({a[0]}), {p}, 'variant')"
    return f"CASE schema_of_variant({v}) WHEN 'STRING' THEN to_json({v}) WHEN 'VOID' THEN 'null' ELSE get_json_object({a[0]}, {p}) END"


def _sort(a: list[str], down: str = "ASC") -> str:
    how = [(literal(x) or "").upper() for x in a[1:]]
    if any(not x for x in how):
        raise NotImplementedError("the order of a list must be a literal")
    down, first = (how[0] if how else down) == "DESC", (how[1] if len(how) > 1 else "NULLS LAST") == "NULLS FIRST"
    if first:
        return f"concat(filter({a[0]}, x_ -> x_ IS NULL), sort_array(array_compact({a[0]}), false))" if down else f"sort_array({a[0]}, true)"
    return f"sort_array({a[0]}, false)" if down else f"array_sort({a[0]})"


def _diff(a: list[str]) -> str:
    """Boundaries of the unit between two times."""
    u, x, y = unit(a[0]), a[1], a[2]
    months = f"((year({y}) - year({x})) * 12 + month({y}) - month({x}))"
    whole = lambda n: f"(floor(unix_micros(CAST({y} AS TIMESTAMP)) / {n}D) - floor(unix_micros(CAST({x} AS TIMESTAMP)) / {n}D))"
    forms = {"year": f"(year({y}) - year({x}))", "month": months, "quarter": f"((year({y}) - year({x})) * 4 + quarter({y}) - quarter({x}))", "day": f"datediff({y}, {x})", "week": f"(datediff({y}, {x}) div 7)", "decade": f"(floor(year({y}) / 10) - floor(year({x}) / 10))", "hour": whole(3600000000), "minute": whole(60000000), "second": whole(1000000), "millisecond": whole(1000), "microsecond": whole(1)}
    return f"CAST({forms[u]} AS BIGINT)"


def _trunc(a: list[str]) -> str:
    return f"CAST(date_trunc({a[0]}, {a[1]}) AS TIMESTAMP_NTZ)"


def _format(a: list[str]) -> str:
    x = told(a[0], "a format")
    return f"format_string({', '.join([quote(re.sub(r'[{][0-9]*[}]', '%s', x.replace('%', '%%'))), *a[1:]])})"


def _strftime(a: list[str]) -> str:
    fmt, at = (a[1], a[0]) if literal(a[1]) is not None else (a[0], a[1])
    return f"date_format({at}, {quote(date_pattern(told(fmt, 'a format')))})"


def _strptime(name: str) -> Callable[[list[str]], str]:
    return lambda a: f"CAST({name}({a[0]}, {quote(date_pattern(told(a[1], 'a format')))}) AS TIMESTAMP_NTZ)"


def _string_agg(a: list[str]) -> str:
    return f"listagg({a[0]}, {a[1] if len(a) > 1 else quote(',')}){{over}}"


def _concat(a: list[str]) -> str:
    if any(re.match(r"\s*(array|transform|filter|sequence|slice|array_\w+|sort_array|split)\s*\(", x) for x in a):
        return "CASE WHEN coalesce(" + ", ".join(a) + ") IS NOT NULL THEN concat(" + ", ".join(f"coalesce({x}, array())" for x in a) + ") END"
    return "concat(" + ", ".join(f"coalesce({x} || '', '')" for x in a) + ")"


def _join(a: list[str]) -> str:
    """Two lists; a null one counts as empty."""
    if "NULL" in (x := [y.strip().upper() for y in a]):
        return a[1] if x[0] == "NULL" else a[0]
    return f"CASE WHEN {a[0]} IS NULL THEN {a[1]} WHEN {a[1]} IS NULL THEN {a[0]} ELSE concat({a[0]}, {a[1]}) END"


def _list_aggregate(a: list[str]) -> str:
    return apply("list_" + told(a[1], "the name of an aggregate").lower(), [a[0], *a[2:]])


def _clean(body: str) -> Form:
    """Of the elements that aren't null, as doubles: s_, their number n_."""
    return lambda a: let(f"transform(array_compact({a[0]}), x_ -> CAST(x_ AS DOUBLE))", "s_", let("size(s_)", "n_", body))


def _moments(body: str) -> Form:
    """Of the elements that aren't null: their number n_ and sums q_.b, .c, .d of powers of distances from the mean."""
    powers = "aggregate(s_, named_struct('b', 0D, 'c', 0D, 'd', 0D), (a_, x_) -> named_struct('b', a_.b + pow(x_ - m_, 2), 'c', a_.c + pow(x_ - m_, 3), 'd', a_.d + pow(x_ - m_, 4)))"
    return _clean(let("aggregate(s_, 0D, (a_, x_) -> a_ + x_) / nullif(n_, 0)", "m_", let(powers, "q_", body)))


_DOT = "aggregate(zip_with({0}, {1}, (x_, y_) -> CAST(x_ AS DOUBLE) * CAST(y_ AS DOUBLE)), 0D, (a_, x_) -> a_ + x_)"
_NORMS = "sqrt(aggregate({0}, 0D, (a_, x_) -> a_ + CAST(x_ AS DOUBLE) * CAST(x_ AS DOUBLE)) * aggregate({1}, 0D, (a_, x_) -> a_ + CAST(x_ AS DOUBLE) * CAST(x_ AS DOUBLE)))"
_DISTANCE = "sqrt(aggregate(zip_with({0}, {1}, (x_, y_) -> pow(CAST(x_ AS DOUBLE) - CAST(y_ AS DOUBLE), 2)), 0D, (a_, x_) -> a_ + x_))"
_ELEMENT = "try_element_at({0}, nullif({1}, 0))"
_MEDIAN = "CASE WHEN n_ > 0 THEN " + let("array_sort(s_)", "t_", "(t_[(n_ - 1) div 2] + t_[n_ div 2]) / 2") + " END"
_N = "CAST(count({0}){over} AS DOUBLE)"

#: name: form, or forms by the number of arguments.
MACROS: dict[str, Form | dict[int, Form]] = {
    # aggregates
    "count_star": "count(*){over}",
    "arbitrary": "first({0}){over}",
    "any_value": "any_value({0}, true){over}",
    "sum_no_overflow": "sum({0}){over}",
    "arg_min": "min_by({0}, CASE WHEN ({0}) IS NOT NULL THEN {1} END){over}",
    "arg_max": "max_by({0}, CASE WHEN ({0}) IS NOT NULL THEN {1} END){over}",
    "arg_min_null": "min_by({0}, {1}){over}",
    "arg_max_null": "max_by({0}, {1}){over}",
    "max": {1: "max({0}){over}", 2: "slice(sort_array(collect_list({0}){over}, false), 1, {1})"},
    "min": {1: "min({0}){over}", 2: "slice(sort_array(collect_list({0}){over}), 1, {1})"},
    "product": "CASE WHEN count_if({0} = 0){over} > 0 THEN 0D ELSE exp(sum(ln(abs(nullif({0}, 0)))){over}) * (1 - 2 * pmod(count_if({0} < 0){over}, 2)) END",
    "geomean": "exp(avg(ln({0})){over})",
    "geometric_mean": "exp(avg(ln({0})){over})",
    "weighted_avg": "sum(({0}) * ({1})){over} / sum(CASE WHEN ({0}) IS NOT NULL THEN {1} END){over}",
    "wavg": "sum(({0}) * ({1})){over} / sum(CASE WHEN ({0}) IS NOT NULL THEN {1} END){over}",
    "list": "transform(collect_list(struct({0} AS x_)){over}, s_ -> s_.x_)",
    "array_agg": "transform(collect_list(struct({0} AS x_)){over}, s_ -> s_.x_)",
    "string_agg": _string_agg,
    "group_concat": _string_agg,
    "listagg": _string_agg,
    "sem": "stddev_pop({0}){over} / sqrt(nullif(count({0}){over}, 0))",
    "skewness": f"CASE WHEN {_N} > 2 THEN skewness({{0}}){{over}} * sqrt({_N} * ({_N} - 1)) / nullif({_N} - 2, 0) END",
    "kurtosis": f"CASE WHEN {_N} > 3 THEN ({_N} - 1) / nullif(({_N} - 2) * ({_N} - 3), 0) * (({_N} + 1) * kurtosis({{0}}){{over}} + 6) END",
    "kurtosis_pop": "kurtosis({0}){over}",
    "mode": "mode({0}, true){over}",
    "quantile": "percentile_disc({1}) WITHIN GROUP (ORDER BY {0}){over}",
    "quantile_disc": "percentile_disc({1}) WITHIN GROUP (ORDER BY {0}){over}",
    "quantile_cont": "percentile({0}, {1}){over}",
    "json_group_array": "to_json(transform(collect_list(struct({0} AS x_)){over}, s_ -> s_.x_))",
    "json_group_object": "to_json(map_from_entries(collect_list(struct({0}, {1})){over}))",
    # numbers
    "add": "({0} + {1})",
    "subtract": "({0} - {1})",
    "multiply": "({0} * {1})",
    "divide": "({0} div {1})",
    "mod": "({0} % {1})",
    "signbit": "(({0}) < 0 OR CAST({0} AS STRING) = '-0.0')",
    "trunc": {1: "trunc_({0})"},
    "log": {1: "log10({0})", 2: "log({0}, {1})"},
    "to_binary": "bin({0})",
    "to_base": {2: "conv(CAST({0} AS STRING), 10, {1})", 3: "CASE WHEN length(conv(CAST({0} AS STRING), 10, {1})) >= {2} THEN conv(CAST({0} AS STRING), 10, {1}) ELSE lpad(conv(CAST({0} AS STRING), 10, {1}), {2}, '0') END"},
    # text
    "concat": _concat,
    "array_slice": _slice,
    "list_slice": _slice,
    "string_to_array": "split({0}, concat('\\\\Q', {1}, '\\\\E'))",
    "regexp_replace": _replace,
    "regexp_split_to_array": "split({0}, {1})",
    "regexp_split_to_table": "explode(split({0}, {1}))",
    "regexp_extract": {2: "regexp_extract({0}, {1}, 0)", 3: "regexp_extract({0}, {1}, {2})"},
    "regexp_extract_all": {2: "regexp_extract_all({0}, {1}, 0)", 3: "regexp_extract_all({0}, {1}, {2})"},
    "regexp_matches": "regexp_like({0}, {1})",
    "regexp_escape": "regexp_replace({0}, '([^A-Za-z0-9_])', '\\\\\\\\$1')",
    "format": _format,
    "printf": "format_string({*})",
    "editdist3": "levenshtein({0}, {1})",
    "mismatches": "hamming({0}, {1})",
    "like_escape": "({0} LIKE {1} ESCAPE {2})",
    "ilike_escape": "(lower({0}) LIKE lower({1}) ESCAPE {2})",
    "not_like_escape": "({0} NOT LIKE {1} ESCAPE {2})",
    "starts_with": "startswith({0}, {1})",
    "prefix": "startswith({0}, {1})",
    # dates
    "date_trunc": _trunc,
    "datetrunc": _trunc,
    "datepart": "date_part({0}, {1})",
    "date_diff": _diff,
    "datediff": _diff,
    "date_sub": lambda a: f"timestampdiff({unit(a[0])}, {a[1]}, {a[2]})",
    "datesub": lambda a: f"timestampdiff({unit(a[0])}, {a[1]}, {a[2]})",
    "date_add": "({0} + {1})",
    "dayofweek": "(dayofweek({0}) - 1)",
    "weekday": "(dayofweek({0}) - 1)",
    "week": "weekofyear({0})",
    "era": "CASE WHEN year({0}) > 0 THEN 1 ELSE 0 END",
    "millennium": "CAST(ceil(year({0}) / 1000) AS BIGINT)",
    "microsecond": "CAST(extract(SECOND FROM {0}) * 1000000 AS BIGINT)",
    "millisecond": "CAST(floor(extract(SECOND FROM {0}) * 1000) AS BIGINT)",
    "nanosecond": "CAST(extract(SECOND FROM {0}) * 1000000 AS BIGINT) * 1000",
    "epoch_ms": "unix_millis(CAST({0} AS TIMESTAMP))",
    "epoch_ns": "unix_micros(CAST({0} AS TIMESTAMP)) * 1000",
    "julian": "(unix_micros(CAST({0} AS TIMESTAMP)) / 86400000000D + 2440588)",
    "make_timestamp": "make_timestamp_ntz({*})",
    "to_years": "make_ym_interval(CAST({0} AS INT))",
    "to_months": "make_ym_interval(0, CAST({0} AS INT))",
    "to_weeks": "make_dt_interval(7 * CAST({0} AS INT))",
    "to_days": "make_dt_interval(CAST({0} AS INT))",
    "to_hours": "make_dt_interval(0, CAST({0} AS INT))",
    "to_minutes": "make_dt_interval(0, 0, CAST({0} AS INT))",
    "to_seconds": "make_dt_interval(0, 0, 0, {0})",
    "to_milliseconds": "make_dt_interval(0, 0, 0, ({0}) / 1000)",
    "to_microseconds": "make_dt_interval(0, 0, 0, ({0}) / 1000000)",
    "strftime": _strftime,
    "strptime": _strptime("to_timestamp"),
    "try_strptime": _strptime("try_to_timestamp"),
    "generate_series": "sequence({*})",
    "range": {1: "filter(sequence(0, greatest({0}, 1) - 1), x_ -> x_ < {0})", 2: "filter(sequence({0}, greatest({1} - 1, {0})), x_ -> x_ < {1})", 3: "filter(sequence({0}, {1}, {2}), x_ -> x_ <> {1})"},
    # lists
    "array_value": "array({*})",
    "list_extract": _ELEMENT,
    "list_element": _ELEMENT,
    "array_extract": _ELEMENT,
    "list_position": "CAST(nullif(array_position({0}, {1}), 0) AS INT)",
    "list_indexof": "CAST(nullif(array_position({0}, {1}), 0) AS INT)",
    "array_indexof": "CAST(nullif(array_position({0}, {1}), 0) AS INT)",
    "list_concat": _join,
    "list_cat": _join,
    "array_concat": _join,
    "array_cat": _join,
    "list_prepend": "array_prepend({1}, {0})",
    "array_push_front": "array_prepend({0}, {1})",
    "list_distinct": "array_distinct(array_compact({0}))",
    "list_unique": "CAST(size(array_distinct(array_compact({0}))) AS BIGINT)",
    "array_unique": "CAST(size(array_distinct(array_compact({0}))) AS BIGINT)",
    "list_has_all": "(size(array_except({1}, {0})) = 0)",
    "array_has_all": "(size(array_except({1}, {0})) = 0)",
    "list_sort": _sort,
    "array_sort": _sort,
    "list_reverse_sort": lambda a: _sort([a[0], "'DESC'", *a[1:2]]),
    "array_reverse_sort": lambda a: _sort([a[0], "'DESC'", *a[1:2]]),
    "list_grade_up": "transform(array_sort(transform({0}, (x_, i_) -> struct(x_ AS x, CAST(i_ + 1 AS BIGINT) AS i))), p_ -> p_.i)",
    "list_resize": {2: "concat(slice({0}, 1, {1}), array_repeat(NULL, greatest({1} - size({0}), 0)))", 3: "concat(slice({0}, 1, {1}), array_repeat({2}, greatest({1} - size({0}), 0)))"},
    "list_select": "transform({1}, i_ -> try_element_at({0}, CAST(nullif(i_, 0) AS INT)))",
    "list_where": "filter({0}, (x_, i_) -> get({1}, i_))",
    "list_reduce": {2: "aggregate(slice({0}, 2, greatest(size({0}) - 1, 0)), ({0})[0], {1})", 3: "aggregate({0}, {2}, {1})"},
    "list_aggregate": _list_aggregate,
    "list_aggr": _list_aggregate,
    "array_aggregate": _list_aggregate,
    "list_first": "try_element_at({0}, 1)",
    "list_last": "try_element_at({0}, -1)",
    "list_any_value": "try_element_at(array_compact({0}), 1)",
    "list_string_agg": {1: "array_join({0}, ',')", 2: "array_join({0}, {1})"},
    "list_bool_and": "forall(array_compact({0}), x_ -> x_)",
    "list_bool_or": "exists(array_compact({0}), x_ -> x_)",
    "list_bit_and": "aggregate(array_compact({0}), -1L, (a_, x_) -> a_ & CAST(x_ AS BIGINT))",
    "list_bit_or": "aggregate(array_compact({0}), 0L, (a_, x_) -> a_ | CAST(x_ AS BIGINT))",
    "list_bit_xor": "aggregate(array_compact({0}), 0L, (a_, x_) -> a_ ^ CAST(x_ AS BIGINT))",
    "list_count": "CAST(size(array_compact({0})) AS BIGINT)",
    "list_sum": _clean("CASE WHEN n_ > 0 THEN aggregate(s_, 0D, (a_, x_) -> a_ + x_) END"),
    "list_avg": _clean("aggregate(s_, 0D, (a_, x_) -> a_ + x_) / nullif(n_, 0)"),
    "list_product": _clean("CASE WHEN n_ > 0 THEN aggregate(s_, 1D, (a_, x_) -> a_ * x_) END"),
    "list_min": "array_min({0})",
    "list_max": "array_max({0})",
    "list_median": _clean(_MEDIAN),
    "list_mad": _clean(let(_MEDIAN, "m_", let("transform(s_, x_ -> abs(x_ - m_))", "s_", _MEDIAN))),
    "list_var_pop": _moments("q_.b / nullif(n_, 0)"),
    "list_var_samp": _moments("CASE WHEN n_ > 1 THEN q_.b / nullif(n_ - 1, 0) END"),
    "list_stddev_pop": _moments("sqrt(q_.b / nullif(n_, 0))"),
    "list_stddev_samp": _moments("CASE WHEN n_ > 1 THEN sqrt(q_.b / nullif(n_ - 1, 0)) END"),
    "list_sem": _moments("sqrt(q_.b / nullif(n_, 0)) / sqrt(n_)"),
    "list_skewness": _moments("CASE WHEN n_ > 2 THEN (q_.c / n_) / pow(nullif(q_.b, 0) / n_, 1.5D) * sqrt(n_ * (n_ - 1D)) / nullif(n_ - 2, 0) END"),
    "list_kurtosis": _moments("CASE WHEN n_ > 3 THEN (n_ - 1D) / nullif((n_ - 2D) * (n_ - 3D), 0) * ((n_ + 1) * ((q_.d / n_) / pow(nullif(q_.b, 0) / n_, 2) - 3) + 6) END"),
    "list_approx_count_distinct": "CAST(size(array_distinct(array_compact({0}))) AS BIGINT)",
    "array_length": {1: "CAST(size({0}) AS BIGINT)"},
    "array_to_string": {1: "array_join({0}, '')", 2: "array_join({0}, {1})"},
    "array_to_string_comma_default": {1: "array_join({0}, ',')", 2: "array_join({0}, {1})"},
    "generate_subscripts": "explode(sequence(1, size({0})))",
    "flatten": "flatten({0})",
    "list_inner_product": _DOT,
    "list_dot_product": _DOT,
    "array_inner_product": _DOT,
    "array_dot_product": _DOT,
    "list_negative_inner_product": f"(-{_DOT})",
    "array_negative_inner_product": f"(-{_DOT})",
    "list_cosine_similarity": f"({_DOT} / {_NORMS})",
    "array_cosine_similarity": f"({_DOT} / {_NORMS})",
    "list_cosine_distance": f"(1 - {_DOT} / {_NORMS})",
    "array_cosine_distance": f"(1 - {_DOT} / {_NORMS})",
    "list_distance": _DISTANCE,
    "array_distance": _DISTANCE,
    "array_cross_product": "array({0}[1] * {1}[2] - {0}[2] * {1}[1], {0}[2] * {1}[0] - {0}[0] * {1}[2], {0}[0] * {1}[1] - {0}[1] * {1}[0])",
    # maps and structs
    "map_extract": "CASE WHEN map_contains_key({0}, {1}) THEN array({0}[{1}]) ELSE slice(array({0}[{1}]), 1, 0) END",
    "element_at": "CASE WHEN map_contains_key({0}, {1}) THEN array({0}[{1}]) ELSE slice(array({0}[{1}]), 1, 0) END",
    "map_extract_value": "try_element_at({0}, {1})",
    "map_contains": "map_contains_key({0}, {1})",
    "map_contains_entry": "exists(map_entries({0}), e_ -> e_.key = {1} AND e_.value = {2})",
    "map_contains_value": "array_contains(map_values({0}), {1})",
    "struct_extract": lambda a: f"({a[0]}).`{told(a[1], 'the name of a field')}`",
    # JSON
    "json_extract": _json,
    "json_extract_path": _json,
    "json_extract_string": lambda a: f"get_json_object({a[0]}, {path(a[1])})",
    "json_extract_path_text": lambda a: f"get_json_object({a[0]}, {path(a[1])})",
    "json_keys": "json_object_keys({0})",
    "json_array_length": {1: "json_array_length({0})", 2: lambda a: f"json_array_length(get_json_object({a[0]}, {path(a[1])}))"},
    "json_exists": lambda a: f"(schema_of_variant(try_variant_get(try_parse_json({a[0]}), {path(a[1])}, 'variant')) IS NOT NULL)",
    "json_quote": "to_json(CAST({0} AS VARIANT))",
    "json_array": lambda a: "to_json(array(" + ", ".join(f"CAST({x} AS VARIANT)" for x in a) + "))",
    "json_object": lambda a: "to_json(map(" + ", ".join(f"{k}, CAST({v} AS VARIANT)" for k, v in zip(a[::2], a[1::2], strict=True)) + "))",
    "from_json_strict": "from_json({0}, {1}, map('mode', 'FAILFAST'))",
    "row_to_json": "to_json({0})",
    "array_to_json": "to_json({0})",
    # others
    "constant_or_null": "CASE WHEN ({1}) IS NOT NULL THEN {0} END",
    "error": "raise_error({0})",
    "uuid_extract_version": "CAST(conv(substring({0}, 15, 1), 16, 10) AS INT)",
    "uuidv4": "uuid()",
    "gen_random_uuid": "uuid()",
}


def form(name: str, n: int) -> Form | None:
    found = MACROS.get(name)
    return found.get(n) if isinstance(found, dict) else found


def apply(name: str, args: list[str], over: str = "") -> str:
    """The text in place of a call."""
    found = form(name, len(args))
    if found is None:
        return f"{name}({', '.join(args)}){over}"
    if callable(found):
        return found(args).replace("{over}", over)
    fill = {"*": ", ".join(args), "over": over, **{str(i): a for i, a in enumerate(args)}}
    if (need := max((int(x) for x in re.findall(r"\{(\d+)\}", found)), default=-1)) >= len(args):
        raise TypeError(f"{name} takes {need + 1} arguments")
    return re.sub(r"\{(\*|over|\d+)\}", lambda m: fill[m[1]], found)
