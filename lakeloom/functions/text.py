"""String functions whose meaning differs from Spark's, or that it lacks. Built-ins stay in the JVM; the rest are Arrow-batched."""

from __future__ import annotations

import hashlib
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def concat_skip_null(*c) -> Column:
    return F.concat_ws("", *c)


def left(s: Column, n: int) -> Column:
    return F.substring(s, 1, n) if n >= 0 else F.substring(s, F.lit(1), F.greatest(F.length(s) + n, F.lit(0)))


def right(s: Column, n: int) -> Column:
    return F.right(s, F.lit(n)) if n >= 0 else F.substring(s, F.lit(1 - n), F.length(s))


def regexp_replace_first(s: Column, pattern: str, by: str) -> Column:
    """The first match only."""
    hit = F.regexp_extract(s, pattern, 0)
    at = F.locate(hit, s) if isinstance(hit, str) else F.instr(s, hit)
    return F.when(hit == "", s).otherwise(F.concat(F.substring(s, F.lit(1), at - 1), F.lit(by), F.substring(s, at + F.length(hit), F.length(s))))


def regexp_full_match(s: Column, pattern: str) -> Column:
    return s.rlike(f"^(?:{pattern})$")


def regexp_escape(s: Column) -> Column:
    return F.regexp_replace(s, r"([^A-Za-z0-9_])", r"\\$1")


def hamming(a: Column, b: Column) -> Column:
    """Different characters of equally long strings."""
    return F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x == y, 0).otherwise(1)), F.lit(0), lambda s, x: s + x).cast("long")


def jaccard(a: Column, b: Column) -> Column:
    """Of the sets of characters."""
    x, y = F.split(a, ""), F.split(b, "")
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def to_base(n: Column, radix: int, least: int = 1) -> Column:
    c = F.upper(F.conv(n.cast("string"), 10, radix))
    return F.when(F.length(c) >= least, c).otherwise(F.lpad(c, least, "0"))


def format_bytes(n: Column) -> Column:
    """Powers of 1024 with one decimal."""
    out = F.concat(n.cast("string"), F.when(F.abs(n) == 1, " byte").otherwise(" bytes"))
    for power, unit in enumerate(["KiB", "MiB", "GiB", "TiB", "PiB"], 1):
        size = 1024**power
        below = F.floor(F.abs(n) / (size // 1024))  # whole units of the power below; the tenth is cut off, not rounded
        tenth = F.floor((below % 1024) * 10 / 1024)
        out = F.when(F.abs(n) >= size, F.concat(F.when(n < 0, "-").otherwise(""), F.floor(below / 1024).cast("string"), F.lit("."), tenth.cast("string"), F.lit(" " + unit))).otherwise(out)
    return out


def parse_filename(p: Column, trim_extension: bool = False) -> Column:
    name = F.regexp_extract(p, r"([^/\\]*)$", 1)
    return F.regexp_replace(name, r"\.[^.]*$", "") if trim_extension else name


def parse_dirname(p: Column) -> Column:
    return F.regexp_extract(p, r"^([^/\\]*)[/\\]", 1)


def parse_dirpath(p: Column) -> Column:
    return F.regexp_extract(p, r"^(.*)[/\\][^/\\]*$", 1)


def _jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    used, hits = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                hits.append(c)
                break
    m = len(hits)
    if not m:
        return 0.0
    moved = sum(x != y for x, y in zip(hits, [c for c, u in zip(b, used, strict=True) if u], strict=True)) // 2
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3


def _winkler(a: str, b: str) -> float:
    j, same = _jaro(a, b), 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        same += 1
    return j + 0.1 * same * (1 - j) if j > 0.7 else j


def _damerau(a: str, b: str) -> int:
    """Adjacent swaps count once; a substring can be edited again."""
    last: dict[str, int] = {}
    top = len(a) + len(b)
    d = [[top] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    for i, x in enumerate(a, 1):
        seen = 0
        for j, y in enumerate(b, 1):
            k, m = last.get(y, 0), seen
            if x == y:
                seen = j
            d[i + 1][j + 1] = min(d[i][j] + (x != y), d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][m] + i - k - 1 + 1 + j - m - 1)
        last[x] = i
    return d[-1][-1]


def _pairs(f, kind):
    @F.pandas_udf(kind)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b, strict=True)])

    return run


def _single(f, kind):
    @F.pandas_udf(kind)
    def run(a: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else f(x) for x in a])

    return run


def jaro_udf():
    return _pairs(_jaro, "double")


def winkler_udf():
    return _pairs(_winkler, "double")


def damerau_udf():
    return _pairs(_damerau, "long")


def strip_accents_udf():
    return _single(lambda x: "".join(c for c in unicodedata.normalize("NFD", x) if not unicodedata.combining(c)), "string")


def nfc_udf():
    return _single(lambda x: unicodedata.normalize("NFC", x), "string")


def length_grapheme_udf():
    return _single(lambda x: len(_graphemes(x)), "long")


def md5_number_udf():
    return _single(lambda x: str(int.from_bytes(hashlib.md5(x.encode()).digest(), "little")), "string")


def jaro_similarity(a: Column, b: Column) -> Column:
    return jaro_udf()(a, b)


def jaro_winkler_similarity(a: Column, b: Column) -> Column:
    return winkler_udf()(a, b)


def damerau_levenshtein(a: Column, b: Column) -> Column:
    return damerau_udf()(a, b)


def strip_accents(s: Column) -> Column:
    return strip_accents_udf()(s)


def nfc_normalize(s: Column) -> Column:
    return nfc_udf()(s)


def length_grapheme(s: Column) -> Column:
    return length_grapheme_udf()(s)


def chr_point(n: Column) -> Column:
    return _single(lambda x: chr(int(x)), "string")(n)


# strftime's letters in date_format's pattern language.
STRFTIME = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%y": "yy", "%B": "MMMM", "%b": "MMM", "%A": "EEEE", "%a": "EEE", "%j": "DDD", "%p": "a", "%I": "hh", "%f": "SSSSSS", "%g": "SSS", "%%": "%"}


def date_pattern(strftime: str) -> str:
    """A strftime format as a date_format pattern; other letters are quoted."""
    out, i = "", 0
    while i < len(strftime):
        two = strftime[i : i + 2]
        if two in STRFTIME:
            out, i = out + STRFTIME[two], i + 2
        else:
            c = strftime[i]
            out, i = out + (f"'{c}'" if c.isalpha() else "''" if c == "'" else c), i + 1
    return out


def _graphemes(s: str) -> list[str]:
    import regex

    return regex.findall(r"\X", s)


def substring_grapheme(s: Column, start: int, length: int) -> Column:
    return _single(lambda x: "".join(_graphemes(x)[start - 1 : start - 1 + length]), "string")(s)


def left_grapheme(s: Column, n: int) -> Column:
    return _single(lambda x: "".join(_graphemes(x)[:n]), "string")(s)


def right_grapheme(s: Column, n: int) -> Column:
    return _single(lambda x: "".join(_graphemes(x)[-n:]) if n else "", "string")(s)


def bar(x: Column, low: float, high: float, width: int = 80) -> Column:
    """A bar of blocks, in eighths of a character."""
    eighths = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - low) / (high - low))) * width * 8)
    whole, part = F.floor(eighths / 8).cast("int"), (eighths % 8).cast("int")
    tail = F.element_at(F.array(*[F.lit(c) for c in ["", "▏", "▎", "▍", "▌", "▋", "▊", "▉"]]), part + 1)
    return F.rpad(F.concat(F.repeat(F.lit("█"), whole), tail), width, " ")


def md5_number(s: Column) -> Column:
    """The digest as an unsigned number; its bytes are little-endian. 39 digits don't fit a decimal, so it is text."""
    return md5_number_udf()(s)


def uuid_version(u: Column) -> Column:
    return F.conv(F.substring(u, 15, 1), 16, 10).cast("int")


def uuid_timestamp(u: Column) -> Column:
    """Of version 7: milliseconds since 1970 in the first 48 bits."""
    return F.timestamp_millis(F.conv(F.concat(F.substring(u, 1, 8), F.substring(u, 10, 4)), 16, 10).cast("long"))


def uuidv7(at: Column | None = None) -> Column:
    """Time-ordered ids; random but for the time and version."""
    ms = F.unix_millis(at if at is not None else F.current_timestamp())
    h, r = F.lpad(F.lower(F.hex(ms)), 12, "0"), F.uuid()
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-7"), F.substring(r, 16, 21))
