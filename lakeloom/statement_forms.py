"""Statements and clauses of the dialect that need the columns of their source: SUMMARIZE, PIVOT, UNPIVOT, stars with
REPLACE or RENAME, COLUMNS(), ASOF and POSITIONAL joins, and frames of GROUPS. Each is rewritten to plain Spark SQL over
temporary views of DataFrames that stay lazy. Statements that change rows write the table anew."""

from __future__ import annotations

import itertools
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom import dialect
from lakeloom.operators import joins, rows
from lakeloom.session import checkpoint_dir

_numbers = itertools.count()
_ENDS = ("WHERE", "GROUP", "ORDER", "LIMIT", "OFFSET", "QUALIFY", "HAVING", "UNION", "EXCEPT", "INTERSECT", "WINDOW", "USING_SAMPLE")
_AGGREGATE = re.compile(r"\b\w+\s*\(")


def word(t: list[str], i: int) -> str:
    return dialect._word(t[i]) if 0 <= i < len(t) else ""


def after(t: list[str], i: int) -> int:
    return dialect._blank(t, i, 1)


def text(t: list[str]) -> str:
    return "".join(t).strip()


def name_of(t: list[str]) -> str:
    x = text(t)
    return x[1:-1].replace('""', '"') if x[:1] == '"' else x


def view(df: DataFrame) -> str:
    name = f"dialect_view_{next(_numbers)}"
    df.createOrReplaceTempView(name)
    return name


def ends(t: list[str], i: int, *names: str) -> int:
    """Where the clause that begins at i ends: at the next of `names` on this level."""
    k = dialect._clause(t[i + 1 :], *names)
    return len(t) if k < 0 else i + 1 + k


def source(spark: SparkSession, t: list[str], params) -> DataFrame:
    """A table's name, or a query in brackets."""
    x = text(t)
    if x.startswith("(") and dialect._close(t, after(t, -1)) == max(k for k, y in enumerate(t) if not y.isspace()):
        inner = x[1:-1].strip()
        return dialect.run(spark, inner if re.match(r"(?i)(select|from|with|values|pivot|unpivot)\b", inner) else f"SELECT * FROM {inner}", params)
    return dialect.run(spark, f"SELECT * FROM {x}" if not re.match(r"(?i)(select|from|with)\b", x) else x, params)


def run(spark: SparkSession, t: list[str], params) -> DataFrame | list[str]:
    """The result of a statement of these, or the tokens that the translator goes on with."""
    first = after(t, -1)
    if first >= len(t):
        return t
    head = word(t, first)
    if head == "SUMMARIZE":
        return rows.summarize(source(spark, t[first + 1 :], params))
    if head in ("PIVOT", "UNPIVOT") and word(t, after(t, first)) != ".":
        return (pivot if head == "PIVOT" else unpivot)(spark, t, first, params)
    if head in ("UPDATE", "DELETE", "TRUNCATE") or head == "INSERT" and (dialect._clause(t, "RETURNING") >= 0 or is_view(spark, t, first)):
        return change(spark, t, first, params)
    t = special_joins(spark, t, params)
    t = groups_frames(t)
    return stars(spark, t, params)


def is_view(spark: SparkSession, t: list[str], first: int) -> bool:
    """Whether an INSERT goes into a temporary view."""
    k = after(t, first)
    k = after(t, k) if word(t, k) == "INTO" else k
    name = t[k].strip('"') if k < len(t) else ""
    return any(v.name.lower() == name.lower() and v.isTemporary for v in spark.catalog.listTables()) if name else False


def change(spark: SparkSession, t: list[str], first: int, params) -> DataFrame:
    """INSERT, UPDATE [.. FROM], DELETE [.. USING] and TRUNCATE change a table or temporary view: its new rows take the place
    of the old ones. The result is RETURNING's rows, or the number of rows that were changed."""
    checkpoint_dir(spark)
    head = word(t, first)
    at = {k: ends(t, first, k) for k in ("SET", "FROM", "USING", "WHERE", "RETURNING", "VALUES", "SELECT")}
    stop = at["RETURNING"]
    k = after(t, first)
    while word(t, k) in ("INTO", "FROM", "TABLE"):
        k = after(t, k)
    name = t[k].strip('"')
    if head == "DELETE":
        at["FROM"] = len(t)
    base = spark.table(name)
    columns = base.columns
    where = dialect.translate_expression(text(t[at["WHERE"] + 1 : stop])) if at["WHERE"] < stop else "true"
    other = at["USING"] if head == "DELETE" else at["FROM"] if head == "UPDATE" else len(t)
    o = None
    if other < stop:
        part = t[other + 1 : min(at["WHERE"], stop)]
        o = dialect.run(spark, "SELECT * FROM " + text(part), params).alias(alias_of(part))
    if head == "INSERT":
        k = after(t, k)
        names = columns
        if t[k] == "(":
            names = [name_of(c) for c in dialect._split(t[k + 1 : dialect._close(t, k)], ",")]
        body = min(at["VALUES"], at["SELECT"], ends(t, first, "WITH"))
        body = ends(t, first, "FROM") if body >= stop else body
        new = dialect.run(spark, text(t[body:stop]), params).toDF(*names)
        changed = new.select(*((F.col(c) if c in names else F.lit(None)).cast(base.schema[c].dataType).alias(c) for c in columns))
        rest = base
    elif head == "TRUNCATE":
        changed, rest = base, base.limit(0)
    else:
        row = base.withColumn("_row", F.monotonically_increasing_id()).alias(name) if o is not None else base.alias(name)
        hit = F.coalesce(F.expr(where), F.lit(False))
        if o is not None:  # a row that meets several is changed once
            row = row.join(o.withColumn("_met", F.lit(True)).alias(alias_of(part)), F.expr(where), "left").dropDuplicates(["_row"])
            hit = F.col("_met").isNotNull()
        values = {}
        for a in dialect._split(t[at["SET"] + 1 : min(at["FROM"], at["WHERE"], stop)], ",") if head == "UPDATE" else []:
            e = a.index("=")
            values[name_of(a[:e]).lower()] = F.expr(dialect.translate_expression(text(a[e + 1 :])))
        own = [F.col(f"{name}.{c}") for c in columns]
        new = [values[c.lower()].cast(base.schema[c].dataType).alias(c) if c.lower() in values else v for c, v in zip(columns, own, strict=True)]
        marked = row.select(F.struct(*own).alias("old"), F.struct(*new).alias("new"), hit.alias("hit")).checkpoint()
        changed = marked.where("hit").select("new.*" if head == "UPDATE" else "old.*")
        rest = marked.where("not hit").select("old.*")
    result = changed if head in ("UPDATE", "INSERT") else changed.limit(0)
    items = dialect.translate_expression(text(t[stop + 1 :])) if stop < len(t) else "count(*) AS Count"
    told = changed.checkpoint()
    told = told.selectExpr(*(text(dialect.Tokens.of(x).all) for x in map("".join, dialect._split(dialect.Tokens.of(items).all, ",")))).checkpoint()
    after_ = rest.unionByName(result)
    if any(v.name.lower() == name.lower() and v.isTemporary for v in spark.catalog.listTables()):
        after_.createOrReplaceTempView(name)
    else:
        made = f"{name}_{next(_numbers)}_new"
        after_.write.saveAsTable(made)
        spark.sql(f"DROP TABLE {name}")
        spark.sql(f"ALTER TABLE {made} RENAME TO {name}")
    return told


def pivot(spark: SparkSession, t: list[str], first: int, params) -> DataFrame:
    """PIVOT source ON columns [IN (values)] USING aggregates [GROUP BY columns]. Result columns in the order of the values."""
    on = ends(t, first, "ON")
    using = ends(t, on, "USING")
    group = ends(t, on, "GROUP")
    df = source(spark, t[first + 1 : on], params)
    item = t[on + 1 : min(using, group)]
    values = None
    if (k := dialect._clause(item, "IN")) >= 0:
        b = after(item, k)
        values = [dialect.expression(text(v)) for v in dialect._split(item[b + 1 : dialect._close(item, b)], ",")]
        values = [df.sparkSession.range(1).select(v).first()[0] for v in values]
        item = item[:k]
    columns = [text(c) for c in dialect._split(item, ",")]
    if len(columns) > 1:
        raise NotImplementedError("PIVOT over several columns")
    aggs = []
    for a in dialect._split(t[using + 1 : group], ",") if using < len(t) else [["count", "(", "*", ")"]]:
        k = dialect._clause(a, "AS")
        aggs.append((dialect.translate_expression(text(a[:k] if k >= 0 else a)), name_of(a[k + 1 :]) if k >= 0 else None))
    if group < len(t):
        keys = [text(c) for c in dialect._split(t[after(t, after(t, group)) :], ",")]
    else:
        used = {x.lower() for x in re.findall(r"\w+", columns[0] + " " + " ".join(a for a, _ in aggs))}
        keys = [c for c in df.columns if c.lower() not in used]
    named = [F.expr(a).alias(n or (a if len(aggs) > 1 else "value")) for a, n in aggs]
    key = F.expr(dialect.translate_expression(columns[0]))
    out = df.groupBy(*keys).pivot(key, values).agg(*named) if isinstance(key, str) else df.withColumn("_pivot", key.cast("string")).groupBy(*keys).pivot("_pivot", [str(v) for v in values] if values else None).agg(*named)
    if len(aggs) == 1 and aggs[0][1]:
        out = out.toDF(*[c if c in keys else f"{c}_{aggs[0][1]}" for c in out.columns])
    counted = [c for c in out.columns if c not in keys and any(re.match(r"count\b", a) for a, n in aggs if len(aggs) == 1 or c.endswith(f"_{n or a}"))]
    return out.fillna(0, counted)


def unpivot(spark: SparkSession, t: list[str], first: int, params) -> DataFrame:
    """UNPIVOT source ON columns INTO NAME n VALUE v. Rows without a value are left out, with INCLUDE NULLS they stay."""
    on = ends(t, first, "ON")
    into = ends(t, on, "INTO")
    head = t[first + 1 : on]
    keep = (k := dialect._clause(head, "INCLUDE")) >= 0
    df = source(spark, head[:k] if keep else head, params)
    columns = [c for x in dialect._split(t[on + 1 : into], ",") for c in (matching(x, df.columns) if "COLUMNS" in map(dialect._word, x) else [name_of(x)])]
    words = [x for x in t[into + 1 :] if not x.isspace()]
    name = words[words_upper.index("NAME") + 1] if "NAME" in (words_upper := [w.upper() for w in words]) else "name"
    value = words[words_upper.index("VALUE") + 1] if "VALUE" in words_upper else "value"
    return rows.unpivot(df, [c for c in df.columns if c not in columns], columns, name, value, keep)


def matching(item: list[str], columns: list[str]) -> list[str]:
    """Columns that COLUMNS(pattern | * [EXCLUDE ..] | lambda) names."""
    k = next(i for i, x in enumerate(item) if dialect._word(x) == "COLUMNS")
    b = after(item, k)
    inner = item[b + 1 : dialect._close(item, b)]
    x = text(inner)
    if x.startswith("'"):
        return [c for c in columns if re.search(x[1:-1].replace("''", "'"), c)]
    if x.startswith("*"):
        gone = {y.strip('"').lower() for y in re.findall(r'\w+|"[^"]+"', x)} - {"exclude"}
        return [c for c in columns if c.lower() not in gone]
    if x.startswith("["):
        return [y.strip("' ") for y in x[1:-1].split(",")]
    m = re.match(r"(?is)(?:lambda\s+(\w+)\s*:|(\w+)\s*->)\s*(.*)", x)
    if not m:
        raise NotImplementedError(f"COLUMNS({x})")
    spark = SparkSession.getActiveSession()
    test = dialect.translate_expression(m[3])
    names = spark.createDataFrame([(c,) for c in columns], f"{m[1] or m[2]} string")
    found = {r[0] for r in names.where(test).collect()}  # the columns of one table
    return [c for c in columns if c in found]


def stars(spark: SparkSession, t: list[str], params) -> list[str]:
    """`* REPLACE (..)`, `* RENAME (..)`, `* EXCLUDE name` and COLUMNS(..) in the select list of the outermost query."""
    s = dialect._clause(t, "SELECT")
    if s < 0:
        return t
    f = ends(t, s, "FROM")
    items = dialect._split(t[s + 1 : f], ",")
    special = lambda x: word(x, after(x, -1)) == "*" and word(x, after(x, after(x, -1))) in ("REPLACE", "RENAME", "EXCLUDE") or "COLUMNS" in map(dialect._word, x)
    if f == len(t) and word(t, after(t, -1)) == "FROM":  # FROM first
        return t
    if not any(special(x) for x in items):
        return t
    stop = ends(t, f, *_ENDS)
    columns = dialect.run(spark, text(t[:s] + ["SELECT", " ", "*", " "] + t[f:stop]), params).columns
    out = []
    for x in items:
        if not special(x):
            out.append(text(x))
        elif word(x, after(x, -1)) == "*" and "COLUMNS" not in map(dialect._word, x):
            out += star(x, columns)
        else:
            k = next(i for i, y in enumerate(x) if dialect._word(y) == "COLUMNS")
            e = dialect._close(x, after(x, k)) + 1
            for c in matching(x, columns):
                alone = not text(x[:k]) and not text(x[e:])
                item = text(x[:k]) + f'"{c}"' + text(x[e:])
                out.append(item if alone or dialect._clause(x, "AS") >= 0 else f'{item} AS "{re.sub(chr(34), "", item)}"')
    return [*t[: s + 1], " ", *dialect.Tokens.of(", ".join(out)).all, " ", *t[f:]]


def star(x: list[str], columns: list[str]) -> list[str]:
    """The columns of a star with its modifiers."""
    gone, instead, named = set(), {}, {}
    i = after(x, after(x, -1))
    while i < len(x):
        what, b = word(x, i), after(x, i)
        e = dialect._close(x, b) if x[b] == "(" else b
        for p in dialect._split(x[b + 1 : e] if x[b] == "(" else x[b : e + 1], ","):
            k = dialect._clause(p, "AS")
            if what == "EXCLUDE":
                gone.add(name_of(p).lower())
            elif what == "REPLACE":
                instead[name_of(p[k + 1 :]).lower()] = text(p[:k])
            else:
                named[name_of(p[:k]).lower()] = name_of(p[k + 1 :])
        i = after(x, e)
    if unknown := (gone | set(instead) | set(named)) - {c.lower() for c in columns}:
        raise ValueError(f"no columns {sorted(unknown)}")
    return [f'{instead.get(c.lower(), chr(34) + c + chr(34))} AS "{named.get(c.lower(), c)}"' for c in columns if c.lower() not in gone]


def factor(t: list[str], i: int, step: int) -> tuple[int, int]:
    """The span of one source of a FROM clause, with its alias, that begins (step 1) or ends (step -1) at i."""
    if step > 0:
        a = after(t, i - 1)
        e = dialect._close(t, a) + 1 if t[a] == "(" else a + 1
        k = after(t, e - 1)
        if word(t, k) == "AS":
            k = after(t, k)
        if k < len(t) and (t[k][0].isalpha() or t[k][0] in '"_') and word(t, k) not in dialect.CLAUSES:
            e = k + 1
        return a, e
    depth = 0
    for k in range(i, -1, -1):
        depth += (t[k] in ")]}") - (t[k] in "([{") if len(t[k]) == 1 else 0
        if not depth and word(t, k) == "FROM":
            return factor(t, k + 1, 1)
    raise ValueError("a join without FROM")


def alias_of(t: list[str]) -> str:
    names = [x for x in t if not x.isspace()]
    return names[-1].strip('"') if names[-1] != ")" else f"source_{next(_numbers)}"


def special_joins(spark: SparkSession, t: list[str], params) -> list[str]:
    """Puts a view in place of `a ASOF [LEFT] JOIN b ..` and `a POSITIONAL JOIN b`, and its columns' names in place of a.x and b.x."""
    depth = 0
    for i, x in enumerate(t):
        depth += (x in "([{") - (x in ")]}") if len(x) == 1 else 0
        if depth or dialect._word(x) not in ("ASOF", "POSITIONAL"):
            continue
        kind, j, how = dialect._word(x), after(t, i), "inner"
        while word(t, j) in ("LEFT", "INNER", "OUTER"):
            how = "left" if word(t, j) == "LEFT" else how
            j = after(t, j)
        if word(t, j) != "JOIN":
            continue
        la, le = factor(t, i, -1)
        if text(t[le:i]):
            raise NotImplementedError(f"{kind} JOIN behind another join; put that in a subquery")
        ra, re_ = factor(t, j + 1, 1)
        left, right = t[la:le], t[ra:re_]
        an, bn = alias_of(left), alias_of(right)
        a, b = (dialect.run(spark, "SELECT * FROM " + text(s), params) for s in (left, right))
        names = {c: c if c.lower() not in {y.lower() for y in a.columns} else f"{bn}__{c}" for c in b.columns}
        b = b.toDF(*(names[c] for c in b.columns))
        hidden: set[str] = set()
        stop = re_
        if kind == "POSITIONAL":
            joined = joins.positional_join(a, b, [F.monotonically_increasing_id()], [F.monotonically_increasing_id()])
        else:
            k = after(t, re_ - 1)
            by, op, on = [], ">=", None
            if word(t, k) == "USING":
                o = after(t, k)
                stop = dialect._close(t, o) + 1
                used = [name_of(c) for c in dialect._split(t[o + 1 : stop - 1], ",")]
                by, on = [(c, names[c]) for c in used[:-1]], (used[-1], names[used[-1]])
                hidden = {names[c] for c in used}
            elif word(t, k) == "ON":
                stop = ends(t, k, *_ENDS, "JOIN", "LEFT", "INNER", "CROSS", "FULL", "RIGHT", "SEMI", "ANTI", "ASOF", "POSITIONAL")
                by, on, op = conditions(t[k + 1 : stop], an, bn, a.columns, names)
            else:
                raise ValueError("an ASOF join needs ON or USING")
            shared = [f"{c}" for c, _ in by]
            r = b.select(*(F.col(d).alias(c) for c, d in by), *(F.col(c) for c in b.columns if c not in {d for _, d in by}))
            at = next(iter(x for x in r.columns if x == on[1]), None) or next(c for c, d in by if d == on[1])
            joined = joins.asof_join(a, r, on[0], at, shared, op, how)
            found = F.col(at).isNotNull()
            joined = joined.select("*", *(F.when(found, F.col(c)).alias(d) for c, d in by))
        name = view(joined.select(*a.columns, *b.columns))
        rest = []
        body = [*t[:la], name, " ", *t[stop:]]
        k = 0
        stars_of = {an.lower(): [f'"{c}"' for c in a.columns], bn.lower(): [f'"{d}" AS "{c}"' if d != c else f'"{c}"' for c, d in names.items() if d not in hidden]}
        sel = dialect._clause(body, "SELECT")
        while k < len(body):
            low = body[k].strip('"').lower()
            if low in stars_of and k + 2 < len(body) and body[k + 1] == ".":
                c = body[k + 2].strip('"')
                if c == "*":
                    rest += dialect.Tokens.of(", ".join(stars_of[low])).all
                elif low == bn.lower():
                    rest.append('"' + next((d for e, d in names.items() if e.lower() == c.lower()), c) + '"' + (f' AS "{c}"' if sel >= 0 and in_list(body, k, sel) else ""))
                else:
                    rest.append(f'"{c}"')
                k += 3
            elif body[k] == "*" and k == after(body, sel) and word(body, after(body, k)) in ("FROM", "EXCLUDE", "REPLACE", "RENAME") and an.lower() != bn.lower():
                plain = word(body, after(body, k)) == "FROM"
                rest += dialect.Tokens.of(", ".join(stars_of[an.lower()] + stars_of[bn.lower()])).all if plain else ["*"]
                k += 1
            else:
                rest.append(body[k])
                k += 1
        return special_joins(spark, rest, params)
    return t


def in_list(t: list[str], k: int, sel: int) -> bool:
    """Whether a column at k..k+2 is an item of the select list by itself, without a name of its own."""
    f = ends(t, sel, "FROM")
    before, behind = dialect._blank(t, k, -1), after(t, k + 2)
    return sel < k < f and (before == sel or t[before] == ",") and (behind >= f or t[behind] == ",")


def conditions(t: list[str], an: str, bn: str, left: list[str], names: dict[str, str]):
    """([(left column, right column)] of equalities, the pair of the inequality, its operator)."""
    parts, now = [], []
    for x in t:
        if dialect._word(x) == "AND":
            parts.append(now)
            now = []
        else:
            now.append(x)
    by, on, op = [], None, ">="
    turned = {">=": "<=", "<=": ">=", ">": "<", "<": ">", "=": "="}
    for p in [*parts, now]:
        k = next((i for i, x in enumerate(p) if x in turned), None)
        if k is None:
            raise NotImplementedError(f"ASOF condition {text(p)}")

        def side(q):
            """('a' or 'b', column)"""
            words = [x.strip('"') for x in q if not x.isspace()]
            if len(words) == 3 and words[1] == ".":
                if words[0].lower() in (an.lower(), bn.lower()):
                    return "a" if words[0].lower() == an.lower() else "b", words[2]
            elif len(words) == 1:
                return ("a" if words[0].lower() in {c.lower() for c in left} else "b"), words[0]
            raise NotImplementedError(f"ASOF condition on {text(q)}; put the expression in a subquery")

        (s1, x), (s2, y) = side(p[:k]), side(p[k + 1 :])
        o = p[k]
        if {s1, s2} != {"a", "b"}:
            raise ValueError(f"an ASOF condition must compare both sides: {text(p)}")
        if s1 == "b":
            x, y, o = y, x, turned[o]
        y = names[next(c for c in names if c.lower() == y.lower())]
        if o == "=":
            by.append((next(c for c in left if c.lower() == x.lower()), y))
        elif on:
            raise ValueError("an ASOF join takes one inequality")
        else:
            on, op = (next(c for c in left if c.lower() == x.lower()), y), o
    if not on:
        raise ValueError("an ASOF join takes one inequality")
    return by, on, op


def groups_frames(t: list[str]) -> list[str]:
    """OVER (.. GROUPS ..): the frame becomes a RANGE over the dense rank of the peers' groups, which a subquery adds."""
    spans = []
    for i, x in enumerate(t):
        if dialect._word(x) == "OVER" and (b := after(t, i)) < len(t) and t[b] == "(":
            e = dialect._close(t, b)
            words = [dialect._word(y) for y in t[b:e]]
            if "EXCLUDE" in words and "NO" not in words:
                raise NotImplementedError("EXCLUDE in a frame: see operators.windows.sum_excluding")
            if "GROUPS" in words:
                spans.append((b, e))
    if not spans:
        return t
    if dialect._clause(t, "GROUP") >= 0 or dialect._clause(t, "SELECT") < 0 or any(x == "*" for x in t[dialect._clause(t, "SELECT") : dialect._clause(t, "FROM")] if x == "*" and word(t, after(t, t.index(x))) in ("FROM", ",")):
        raise NotImplementedError("a frame of GROUPS with GROUP BY or a star")
    out, ranks = list(t), []
    for n, (b, e) in reversed(list(enumerate(spans))):
        inner = out[b + 1 : e]
        g, o = dialect._clause(inner, "GROUPS"), dialect._clause(inner, "ORDER")
        name = f"groups_rank_{n}"
        ranks.append(f"dense_rank() OVER ({text(inner[:g])}) AS {name}")
        out[b + 1 : e] = [text(inner[:o]), f" ORDER BY {name} RANGE ", text(inner[g + 1 :])]
    f = dialect._clause(out, "FROM")
    stop = ends(out, f, *_ENDS)
    body = out[f + 1 : stop]
    a, e = factor(body, 0, 1)
    if text(body[e:]):
        raise NotImplementedError("a frame of GROUPS behind a join; put the join in a subquery")
    sub = f"(SELECT *, {', '.join(ranks)} FROM {text(body[a:e])}) {alias_of(body[a:e])} "
    return [*out[: f + 1], " ", *dialect.Tokens.of(sub).all, *out[stop:]]
