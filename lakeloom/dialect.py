"""The engine's SQL dialect on Spark SQL: what differs in form is rewritten token by token, and functions that Spark lacks
or names otherwise are installed as SQL functions.

Rewritten: FROM-first queries, QUALIFY, * EXCLUDE / REPLACE / RENAME-free stars, [list] and {'struct': ..} literals, MAP {..},
list comprehensions, // , ^@, ** , lambdas with `lambda x:`, SEMI / ANTI joins, UNION BY NAME between two queries, LIMIT n%,
USING SAMPLE, DISTINCT ON, parameters, and names of functions and types."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom import macros
from lakeloom.functions import numbers, text

TOKEN = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|--[^\n]*|/\*.*?\*/|\$\w+|\d+\.?\d*(?:[eE][+-]?\d+)?|\w+|::|:=|//|\*\*|\^@|->>|->|<=>|<>|!=|<=|>=|\|\||&&|@>|\s+|.", re.S)

# Names of the dialect and of Spark for the same function; macros.py has those that differ in more than the name.
NAMES = {
    "list_value": "array", "list_pack": "array", "list_contains": "array_contains", "list_has": "array_contains", "array_has": "array_contains", "list_append": "array_append", "array_push_back": "array_append", "list_transform": "transform", "list_apply": "transform",
    "apply": "transform", "array_apply": "transform", "array_transform": "transform", "list_filter": "filter", "array_filter": "filter", "list_reverse": "reverse", "array_reverse": "reverse", "list_intersect": "array_intersect", "list_has_any": "arrays_overlap", "array_has_any": "arrays_overlap",
    "list_zip": "arrays_zip", "array_zip": "arrays_zip", "unnest": "explode", "string_split_regex": "split", "str_split_regex": "split", "strlen": "octet_length", "unicode": "ascii", "ord": "ascii",
    "suffix": "endswith", "sha256": "sha256_", "to_hex": "hex", "from_hex": "unhex", "to_base64": "base64", "from_base64": "unbase64", "argmin": "arg_min", "argmax": "arg_max", "favg": "avg", "fsum": "sum", "mean": "avg", "approx_quantile": "approx_percentile",
    "round_even": "bround", "struct_pack": "struct", "row": "struct", "epoch_us": "unix_micros_", "strpos": "instr", "nfc_normalize": "nfc_normalize_",
}
TYPES = {"VARCHAR": "STRING", "TEXT": "STRING", "HUGEINT": "DECIMAL(38,0)", "UHUGEINT": "DECIMAL(38,0)", "UBIGINT": "DECIMAL(20,0)", "UINTEGER": "BIGINT", "USMALLINT": "INT", "UTINYINT": "SMALLINT", "BLOB": "BINARY", "INT8": "BIGINT", "INT4": "INT", "FLOAT8": "DOUBLE", "FLOAT4": "FLOAT", "BOOL": "BOOLEAN", "UUID": "STRING"}
#: Functions installed in the session: (name, parameters, result, body).
FUNCTIONS = [
    ("sha256_", "s STRING", "STRING", "sha2(s, 256)"),
    ("log10_", "x DOUBLE", "DOUBLE", "log10(x)"),
    ("trunc_", "x DOUBLE", "DOUBLE", "CASE WHEN x < 0 THEN ceil(x) ELSE floor(x) END"),
    ("even", "x DOUBLE", "DOUBLE", "signum(x) * 2 * ceil(abs(x) / 2)"),
    ("fdiv", "x DOUBLE, y DOUBLE", "DOUBLE", "floor(x / y)"),
    ("fmod", "x DOUBLE, y DOUBLE", "DOUBLE", "x - y * floor(x / y)"),
    ("isinf", "x DOUBLE", "BOOLEAN", "abs(x) = double('infinity')"),
    ("isfinite", "x DOUBLE", "BOOLEAN", "NOT isnan(x) AND abs(x) <> double('infinity')"),
    ("xor", "a BIGINT, b BIGINT", "BIGINT", "a ^ b"),
    ("string_split", "s STRING, sep STRING", "ARRAY<STRING>", "split(s, concat('\\\\Q', sep, '\\\\E'))"),
    ("str_split", "s STRING, sep STRING", "ARRAY<STRING>", "split(s, concat('\\\\Q', sep, '\\\\E'))"),
    ("regexp_full_match", "s STRING, p STRING", "BOOLEAN", "s RLIKE concat('^(?:', p, ')$')"),
    ("jaccard", "a STRING, b STRING", "DOUBLE", "size(array_intersect(split(a, ''), split(b, ''))) / size(array_union(split(a, ''), split(b, '')))"),
    ("hamming", "a STRING, b STRING", "BIGINT", "aggregate(zip_with(split(a, ''), split(b, ''), (x, y) -> CASE WHEN x = y THEN 0L ELSE 1L END), 0L, (s, x) -> s + x)"),
    ("isodow", "d TIMESTAMP_NTZ", "INT", "weekday(d) + 1"),
    ("yearweek", "d TIMESTAMP_NTZ", "INT", "extract(YEAROFWEEK FROM d) * 100 + weekofyear(d)"),
    ("isoyear", "d TIMESTAMP_NTZ", "INT", "extract(YEAROFWEEK FROM d)"),
    ("century", "d TIMESTAMP_NTZ", "BIGINT", "ceil(year(d) / 100)"),
    ("decade", "d TIMESTAMP_NTZ", "BIGINT", "floor(year(d) / 10)"),
    ("epoch", "d TIMESTAMP_NTZ", "DOUBLE", "unix_micros(CAST(d AS TIMESTAMP)) / 1e6"),
    ("unix_micros_", "d TIMESTAMP_NTZ", "BIGINT", "unix_micros(CAST(d AS TIMESTAMP))"),
    ("json_valid", "j STRING", "BOOLEAN", "try_parse_json(j) IS NOT NULL"),
]


#: Functions that no expression of Spark gives, in Arrow batches.
UDFS = {
    "gamma": numbers.gamma_udf, "lgamma": numbers.lgamma_udf, "gcd": numbers.gcd_udf, "lcm": numbers.lcm_udf, "nextafter": numbers.nextafter_udf, "jaro_similarity": text.jaro_udf, "jaro_winkler_similarity": text.winkler_udf,
    "damerau_levenshtein": text.damerau_udf, "strip_accents": text.strip_accents_udf, "nfc_normalize_": text.nfc_udf, "length_grapheme": text.length_grapheme_udf, "md5_number": text.md5_number_udf,
}


def install(spark: SparkSession) -> None:
    for name, f in UDFS.items():
        spark.udf.register(name, f())
    for name, parameters, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")


@dataclass
class Tokens:
    all: list[str]

    @staticmethod
    def of(text: str) -> Tokens:
        return Tokens([t for t in TOKEN.findall(text) if not t.startswith(("--", "/*"))])

    def __str__(self) -> str:
        return "".join(self.all)


def _word(t: str) -> str:
    return t.upper() if t[:1].isalpha() else t


def _close(t: list[str], i: int) -> int:
    """The place of the bracket that closes the one at i."""
    depth, pairs = 0, {"(": ")", "[": "]", "{": "}"}
    for j in range(i, len(t)):
        if t[j] in pairs:
            depth += 1
        elif t[j] in pairs.values():
            depth -= 1
            if not depth:
                return j
    raise ValueError("a bracket isn't closed")


def _split(t: list[str], at: str) -> list[list[str]]:
    out, depth, names = [[]], 0, False  # names: of a lambda's parameters, whose commas part nothing
    for x in t:
        depth += (x in "([{") - (x in ")]}") if len(x) == 1 else 0
        names = not depth and (_word(x) == "LAMBDA" or names and x != ":")
        if x == at and not depth and not names:
            out.append([])
        else:
            out[-1].append(x)
    return out


def _blank(t: list[str], i: int, step: int) -> int:
    """The next place that isn't white space."""
    i += step
    while 0 <= i < len(t) and t[i].isspace():
        i += step
    return i


def translate_expression(text: str) -> str:
    return "".join(_expressions(Tokens.of(text).all))


def expression(text: str) -> Column:
    return F.expr(translate_expression(text))


def mixes_columns(items: str) -> bool:
    """Whether a select list has items without an aggregate's brackets."""
    return any("(" not in p for p in map("".join, _split(Tokens.of(items).all, ",")))


#: Words before a bracket that don't call a function.
NO_CALL = frozenset("SELECT FROM WHERE AND OR NOT IN ON BY AS EXISTS ANY ALL SOME OVER FILTER USING VALUES WHEN THEN ELSE CASE BETWEEN LIKE ILIKE JOIN UNION EXCEPT INTERSECT WITH HAVING QUALIFY LATERAL DISTINCT EXCLUDE REPLACE RENAME CAST TRY_CAST EXTRACT SUBSTRING POSITION OVERLAY TRIM GROUP PARTITION ORDER SETS CUBE ROLLUP GROUPING INTERVAL ARRAY MAP STRUCT DECIMAL NUMERIC VARCHAR CHAR INTO TABLE LIMIT OFFSET IS NULLS RECURSIVE MATERIALIZED PIVOT UNPIVOT FOR".split())
CLAUSES = frozenset("WHERE GROUP ORDER LIMIT OFFSET QUALIFY HAVING UNION EXCEPT INTERSECT JOIN LEFT RIGHT FULL INNER CROSS SEMI ANTI NATURAL ASOF POSITIONAL ON USING SELECT WINDOW PIVOT UNPIVOT SAMPLE TABLESAMPLE".split())
TABLE_FUNCTIONS = frozenset(["range", "generate_series", "unnest"])
ORDERED = frozenset(["list", "array_agg", "string_agg", "group_concat", "listagg", "first", "last", "arbitrary", "any_value"])


def _primary(out: list[str], end: int) -> int:
    """Where the value begins that ends at `end`: a name, literal, call or bracket."""
    k = end
    if out[k][-1:] in ")]" and len(out[k]) == 1:
        depth = 1
        while depth:
            k -= 1
            depth += (out[k] in (")", "]")) - (out[k] in ("(", "["))
        if k > 0 and re.fullmatch(r"\w+", out[k - 1]) and _word(out[k - 1]) not in NO_CALL:
            k -= 1
    while k > 1 and out[k - 1] == ".":
        k -= 2
    return k


def _sorted_list(value: str, order: list[list[str]], over: str) -> str:
    """Values of a group in an order, nulls last unless said otherwise."""
    keys, steps = [], []
    for i, item in enumerate(order):
        words = [_word(x) for x in item if not x.isspace()]
        down, first = "DESC" in words, "FIRST" in words
        cut = next((k for k, x in enumerate(item) if _word(x) in ("ASC", "DESC", "NULLS")), len(item))
        keys.append(f"{''.join(_expressions(item[:cut])).strip()} AS k{i}")
        null, less = ("-1", "1") if first else ("1", "-1"), ("1", "-1") if down else ("-1", "1")
        steps.append(f"WHEN a_.k{i} IS NULL AND b_.k{i} IS NOT NULL THEN {null[0]} WHEN b_.k{i} IS NULL AND a_.k{i} IS NOT NULL THEN {null[1]} WHEN a_.k{i} < b_.k{i} THEN {less[0]} WHEN a_.k{i} > b_.k{i} THEN {less[1]}")
    return f"transform(array_sort(collect_list(struct({', '.join(keys)}, {value} AS x_)){over}, (a_, b_) -> CASE {' '.join(steps)} ELSE 0 END), s_ -> s_.x_)"


def _call(name: str, args: list, t: list[str], n: int, end: int, translated: int = 0) -> tuple[str, int]:
    """The text of a call whose bracket opens at n and closes at `end`, and the place behind it and what belongs to it."""
    inner = t[n + 1 : end]
    order: list[list[str]] = []
    if name in ORDERED and (o := _clause(inner, "ORDER")) >= 0:
        order = _split(inner[_blank(inner, o, 1) + 1 :], ",")
        inner = inner[:o]
    given = _split(inner, ",") if any(not x.isspace() for x in inner) else []
    texts = ["".join(a) for a in args[:translated]] + ["".join(_expressions(a)).strip() for a in [*args[translated:], *given]]
    name = NAMES.get(name, name)
    form = macros.form(name, len(texts))
    after, over = end + 1, ""
    follow, condition = after, ""
    while (k := _blank(t, follow - 1, 1)) < len(t) and _word(t[k]) in ("FILTER", "OVER"):
        b = _blank(t, k, 1)
        follow = _close(t, b) + 1 if t[b] == "(" else b + 1
        if _word(t[k]) == "FILTER":
            w = _clause(inside := t[b + 1 : follow - 1], "WHERE")
            condition = "".join(_expressions(inside[w + 1 :])).strip()
        elif condition:  # Spark filters no windows: values that aren't wanted become null
            if name in ORDERED - {"string_agg", "group_concat", "listagg"}:
                raise NotImplementedError(f"{name} with FILTER and OVER")
            texts[0] = f"CASE WHEN {condition} THEN {'1' if texts[:1] == ['*'] else texts[0]} END" if texts else "1"
            after, condition = k, ""
    form = macros.form(name, len(texts))
    if order or form is not None and (callable(form) and name in ORDERED or not callable(form) and "{over}" in form):
        while (k := _blank(t, after - 1, 1)) < len(t) and _word(t[k]) in ("FILTER", "OVER"):
            b = _blank(t, k, 1)
            after = _close(t, b) + 1 if t[b] == "(" else b + 1
            over += " " + "".join(_expressions(t[k:after]))
    distinct = bool(texts) and re.match(r"DISTINCT\s", texts[0], re.I)
    if order:
        if distinct:
            raise NotImplementedError(f"{name}(DISTINCT .. ORDER BY ..)")
        got = _sorted_list(texts[0], order, over)
        if name in ("string_agg", "group_concat", "listagg"):
            got = f"nullif(array_join(transform({got}, x_ -> CAST(x_ AS STRING)), {texts[1] if len(texts) > 1 else chr(39) + ',' + chr(39)}), '')"
        elif name in ("first", "arbitrary", "any_value", "last"):
            got = f"try_element_at({got if name != 'any_value' else f'array_compact({got})'}, {-1 if name == 'last' else 1})"
        return got, after
    if distinct and name in ("list", "array_agg"):
        return f"transform(collect_set(struct({texts[0][8:]} AS x_)){over}, s_ -> s_.x_)", after
    if name in ("len", "length") and len(texts) == 1 and re.match(r"\s*(array|transform|filter|sequence|slice|array_\w+|sort_array|split|string_split|str_split)\s*\(", texts[0]):
        name = "size"
    return macros.apply(name, texts, over), after


def _expressions(t: list[str]) -> list[str]:
    out: list[str] = []
    i = 0
    while i < len(t):
        x = t[i]
        before = _blank(out, len(out), -1)
        value_before = before >= 0 and (out[before][-1:] in ")]'\"" or (out[before][-1:].isalnum() or out[before][-1:] == "_") and _word(out[before]) not in ("SELECT", "WHERE", "AND", "OR", "NOT", "IN", "ON", "BY", "THEN", "ELSE", "WHEN", "RETURN", "CASE", "FROM", "BETWEEN", "LIKE", "VALUES", "HAVING", "QUALIFY", "AS", "ALL", "DISTINCT"))
        if x == "[":
            j = _close(t, i)
            inner = t[i + 1 : j]
            if value_before:
                parts = _split(inner, ":")
                base = out.pop()
                if base == ")":
                    k = len(out) - 1
                    depth = 1
                    while depth:
                        depth += (out[k] == ")") - (out[k] == "(")
                        k -= 1
                    k -= 1 if k >= 0 and re.fullmatch(r"\w+", out[k]) else 0
                    base = "".join(out[k + 1 :]) + ")"
                    del out[k + 1 :]
                if len(parts) == 1:
                    index = "".join(_expressions(inner))
                    out.append(f"(CASE WHEN ({index}) <> 0 THEN try_element_at({base}, {index}) END)" if not re.fullmatch(r"\s*'.*'\s*", index) else f"{base}[{index}]")
                else:
                    bounds = ["".join(_expressions(p)).strip() for p in parts]
                    out.append(macros.apply("list_slice", [base, bounds[0] or "1", bounds[1] or f"size({base})", *bounds[2:]]))
            else:
                words = [_word(y) for y in inner]
                if "FOR" in words and "IN" in words:
                    f, n = words.index("FOR"), words.index("IN")
                    where = words.index("IF") if "IF" in words[n:] else len(inner)
                    e, v, source = "".join(_expressions(inner[:f])).strip(), "".join(inner[f + 1 : n]).strip(), "".join(_expressions(inner[n + 1 : where])).strip()
                    if where < len(inner):
                        source = f"filter({source}, {v} -> {''.join(_expressions(inner[where + 1 :])).strip()})"
                    out.append(f"transform({source}, {v} -> {e})")
                else:
                    out.append(f"array({''.join(_expressions(inner))})")
            i = j + 1
        elif x == "{":
            j = _close(t, i)
            pairs = [["".join(_expressions(y)).strip() for y in (p[: p.index(":")], p[p.index(":") + 1 :])] for p in _split(t[i + 1 : j], ",") if p and ":" in p]
            if before >= 0 and _word(out[before]) == "MAP":
                del out[before:]
                out.append(f"map({', '.join(f'{k}, {v}' for k, v in pairs)})")
            else:
                out.append("named_struct(" + ", ".join(f"{k if k[:1] == chr(39) else chr(39) + k + chr(39)}, {v}" for k, v in pairs) + ")")
            i = j + 1
        elif _word(x) == "LAMBDA":
            j = next(k for k in range(i, len(t)) if t[k] == ":")
            names = "".join(t[i + 1 : j]).strip()
            out.append(f"({names}) ->" if "," in names else f"{names} ->")
            i = j + 1
        elif x == "//":
            out.append(" div ")
            i += 1
        elif x == '"' or x[:1] == '"':
            out.append("`" + x[1:-1].replace('""', '"') + "`")
            i += 1
        elif x in ("**", "^@", "&&", "@>") or x in ("->", "->>") and t[_blank(t, i, 1)][:1] == "'":  # binary operators on two primaries
            left = "".join(out[(k := _primary(out, before)) :]).strip()
            del out[k:]
            k = _blank(t, i, 1)
            end = _close(t, k + 1) + 1 if k + 1 < len(t) and t[k + 1] == "(" else _close(t, k) + 1 if t[k] in "([{" else k + 1
            right = "".join(_expressions(t[k:end]))
            out.append(macros.apply("json_extract" if x == "->" else "json_extract_string", [left, right]) if x[:2] == "->" else {"**": f"pow({left}, {right})", "^@": f"startswith({left}, {right})", "&&": f"arrays_overlap({left}, {right})", "@>": f"(size(array_except({right}, {left})) = 0)"}[x])
            i = end
        else:
            n = _blank(t, i, 1)
            w = x.lower()
            if n < len(t) and t[n] == "(" and x[0].isalpha() and (_word(x) not in NO_CALL or before >= 0 and out[before] == "."):
                end = _close(t, n)
                if before >= 0 and out[before] == ".":  # x.f(y) is f(x, y)
                    base = "".join(out[(k := _primary(out, _blank(out, before, -1))) :][: before - k]).strip()
                    del out[k:]
                    call, end = _call(w, [[base]], t, n, end, translated=1)
                else:
                    call, end = _call(w, [], t, n, end)
                    last = _word(out[before]) if before >= 0 else ""
                    if last in ("FROM", "JOIN") and w in TABLE_FUNCTIONS:
                        rows = call if w == "unnest" else f"explode({call})"
                        call = f"(SELECT col AS {w} FROM {rows})"
                        k = _blank(t, end - 1, 1)
                        if k >= len(t) or not (t[k][0].isalpha() or t[k][0] in '"_') or _word(t[k]) in CLAUSES:
                            call += f" AS {w}"
                out.append(call)
                i = end
                continue
            if x[:1] == "'":
                x = x.replace("\\", "\\\\")
            elif x.upper() in TYPES and before >= 0 and (out[before] == "::" or _word(out[before]) == "AS"):
                x = TYPES[x.upper()]
            out.append(x)
            i += 1
    return out


def _clause(t: list[str], *names: str) -> int:
    """The place of a clause at this level, or -1."""
    depth = 0
    for i, x in enumerate(t):
        depth += (x in "([{") - (x in ")]}") if len(x) == 1 else 0
        if not depth and _word(x) in names:
            return i
    return -1


def translate(text: str) -> str:
    """One statement, with its subqueries."""
    return _query(Tokens.of(text.strip().rstrip(";")).all)


def _limit_beside_order(t: list[str]) -> str:
    """A subquery with ORDER BY and LIMIT, or nothing if it can stay. Sort keys that it doesn't return become columns of the query
    with the LIMIT: else Spark puts a projection between the two, and a correlated LIMIT counts rows without the order."""
    s, f, o, n = (_clause(t, w) for w in ("SELECT", "FROM", "ORDER", "LIMIT"))
    if not 0 <= s < f < o < n or "%" in t[n:] or _word(t[_blank(t, s, 1)]) == "DISTINCT" or _clause(t, "WITH", "QUALIFY", "UNION", "INTERSECT", "EXCEPT") >= 0:
        return ""
    returned = {_word(x[-1]) for item in _split(t[s + 1 : f], ",") if (x := [y for y in item if not y.isspace()])}
    keys, added = [], []
    for item in _split(t[_blank(t, o, 1) + 1 : n], ","):
        cut = next((k for k, x in enumerate(item) if _word(x) in ("ASC", "DESC", "NULLS")), len(item))
        key = [x for x in item[:cut] if not x.isspace()]
        if len(key) > 1 or not key[0].isdigit() and _word(key[0]) not in returned | {"ALL"}:
            added.append("".join(_expressions(item[:cut])).strip() + f" AS _order_{len(added)}")
            item = [f" _order_{len(added) - 1} ", *item[cut:]]
        keys.append("".join(_expressions(item)).strip())
    if not added:
        return ""
    hidden = ", ".join(f"_order_{k}" for k in range(len(added)))
    body = "".join(_expressions(t[f:o]))
    return f"SELECT * EXCEPT ({hidden}) FROM (SELECT {''.join(_expressions(t[s + 1 : f])).strip()}, {', '.join(added)} {body} ORDER BY {', '.join(keys)} {''.join(_expressions(t[n:]))})".replace("\0", "")


def _query(t: list[str], inner: bool = False) -> str:
    i = 0
    out: list[str] = []
    while i < len(t):  # brackets that hold queries first
        if t[i] == "(":
            j = _close(t, i)
            first = _blank(t, i, 1)
            if _word(t[first]) in ("SELECT", "FROM", "WITH"):
                out += ["(", "\0" + _query(t[i + 1 : j], True), ")"]
                i = j + 1
                continue
        out.append(t[i])
        i += 1
    t = out
    first = next((k for k, x in enumerate(t) if not x.isspace()), 0)
    if t and _word(t[first]) == "FROM":
        s = _clause(t, "SELECT")
        if s < 0:
            t = ["SELECT", " ", "*", " ", *t[first:]]
        else:
            e = s + 1 + (k if (k := _clause(t[s + 1 :], "WHERE", "GROUP", "ORDER", "LIMIT", "QUALIFY", "HAVING", "UNION")) >= 0 else len(t) - s - 1)
            t = [*t[s:e], " ", *t[first:s], " ", *t[e:]]
    for k, x in enumerate(t):
        if _word(x) == "EXCLUDE":
            t[k] = "EXCEPT"
        elif _word(x) in ("SEMI", "ANTI") and _word(t[_blank(t, k, -1)]) != "LEFT":
            t[k] = "LEFT " + x
    if inner and (limited := _limit_beside_order(t)):
        return limited
    q = _clause(t, "QUALIFY")
    order = ""
    if q >= 0:
        e = q + 1 + (k if (k := _clause(t[q + 1 :], "ORDER", "LIMIT")) >= 0 else len(t) - q - 1)
        condition, order = "".join(_expressions(t[q + 1 : e])), "".join(_expressions(t[e:]))
        s, f = _clause(t, "SELECT"), _clause(t, "FROM")
        head = "".join(t[:s])
        return f"{head}SELECT * EXCEPT (_qualify) FROM (SELECT {''.join(_expressions(t[s + 1 : f])).strip()}, ({condition.strip()}) AS _qualify {''.join(_expressions(t[f:q]))}) WHERE _qualify {order}".replace("\0", "")
    s = _clause(t, "SELECT")
    if s >= 0 and _word(t[d := _blank(t, s, 1)]) == "DISTINCT" and _word(t[o := _blank(t, d, 1)]) == "ON":
        b = _blank(t, o, 1)
        keys = "".join(_expressions(t[b + 1 : _close(t, b)]))
        f, w = _clause(t, "FROM"), _clause(t, "ORDER")
        by = "".join(_expressions(t[_blank(t, _blank(t, w, 1), 1) :])) if w >= 0 else keys
        body = "".join(_expressions(t[f : w if w >= 0 else len(t)]))
        return f"SELECT * EXCEPT (_first) FROM (SELECT {''.join(_expressions(t[_close(t, b) + 1 : f])).strip()}, row_number() OVER (PARTITION BY {keys} ORDER BY {by}) AS _first {body}) WHERE _first = 1".replace("\0", "")
    return "".join(_expressions(t)).replace("\0", "")


def run(spark: SparkSession, text: str, params: dict | list | None = None) -> DataFrame:
    """Runs one statement. UNION BY NAME, LIMIT n% and USING SAMPLE become DataFrame operations; for the rest see statement_forms.py."""
    t = Tokens.of(text.strip().rstrip(";")).all
    from lakeloom import statement_forms

    got = statement_forms.run(spark, t, params)
    if isinstance(got, DataFrame):
        return got
    t = got
    for k in range(len(t)):
        if _word(t[k]) == "BY" and _word(t[n := _blank(t, k, 1)]) == "NAME" and _word(t[p := _blank(t, k, -1)]) in ("UNION", "ALL"):
            u = p if _word(t[p]) == "UNION" else _blank(t, p, -1)
            both = run(spark, "".join(t[:u]), params).unionByName(run(spark, "".join(t[n + 1 :]), params), allowMissingColumns=True)
            return both if _word(t[p]) == "ALL" else both.distinct()
    if (k := _clause(t, "USING")) >= 0 and _word(t[s := _blank(t, k, 1)]) == "SAMPLE":
        base, size = run(spark, "".join(t[:k]), params), "".join(t[s + 1 :]).strip()
        n = float(re.match(r"[\d.]+", size)[0])
        return base.sample(n / 100) if "%" in size or "PERCENT" in size.upper() else base.orderBy(F.rand()).limit(int(n))
    if (k := _clause(t, "LIMIT")) >= 0 and "%" in t[k:]:
        base = run(spark, "".join(t[:k]), params)
        return base.limit(int(base.count() * float(t[_blank(t, k, 1)]) / 100))
    q = "".join(t)
    if isinstance(params, dict):
        q = re.sub(r"\$(\w+)", r":\1", q)
    elif params is not None:
        q = re.sub(r"\$\d+", "?", q)
    return spark.sql(translate(q), args=params) if params is not None else spark.sql(translate(q))
