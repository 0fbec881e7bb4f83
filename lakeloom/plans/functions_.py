"""Queries that hold the function library, family by family, against the oracle."""

from pyspark.sql import functions as F

from lakeloom.functions import lists, numbers, text
from lakeloom.plans.registry import family, query
from lakeloom.session import table as t

c = F.col

family("fn_math_basic", "customer", "c_custkey", [
    ("add", "d", "c_acctbal + 1.5"), ("subtract", "d", "c_acctbal - c_custkey"), ("multiply", "d", "c_acctbal * 2"), ("divide", "d", "c_acctbal / (c_custkey + 1)"), ("int_div", "i", "c_custkey div 7", "c_custkey // 7"),
    ("modulo", "i", "c_custkey % 7"), ("mod_fn", "i", "mod(c_custkey, 11)"), ("negate", "d", "-c_acctbal"), ("abs", "d", "abs(c_acctbal)"), ("ceil", "d", "ceil(c_acctbal)"), ("floor", "d", "floor(c_acctbal)"), ("round", "d", numbers.rounded("c_acctbal", 1), "round(c_acctbal, 1)"),
    ("round_even", "d", "bround(CAST(c_custkey AS DOUBLE) / 2, 0)", "round_even(CAST(c_custkey AS DOUBLE) / 2, 0)"), ("trunc", "d", lambda: numbers.trunc(c("c_acctbal")), "trunc(c_acctbal)"), ("even", "d", lambda: numbers.even(c("c_acctbal")), "even(c_acctbal)"),
    ("sign", "i", "signum(c_acctbal)", "sign(c_acctbal)"), ("signbit", "b", "c_acctbal < 0", "signbit(c_acctbal)"), ("greatest", "d", "greatest(c_acctbal, 100.0, CAST(c_custkey AS DOUBLE))"), ("least", "d", "least(c_acctbal, 100.0, CAST(c_custkey AS DOUBLE))"),
    ("greatest_null", "i", "greatest(c_custkey, CAST(NULL AS BIGINT))"), ("fdiv", "d", "floor(c_acctbal / 7)", "fdiv(c_acctbal, 7)"), ("fmod", "d", lambda: numbers.fmod_floor(c("c_acctbal"), F.lit(7.0)), "fmod(c_acctbal, 7)"),
])
family("fn_math_transcendental", "customer", "c_custkey", [
    ("sqrt", "d", "sqrt(abs(c_acctbal))"), ("cbrt", "d", "cbrt(c_acctbal)"), ("exp", "d", "exp(c_custkey % 10)"), ("ln", "d", "ln(c_custkey + 1)"), ("log_ten", "d", "log10(c_custkey + 1)", "log(c_custkey + 1)"), ("log_base", "d", "ln(c_custkey + 1) / ln(3)", "log(3, c_custkey + 1)"),
    ("log2", "d", "log2(c_custkey + 1)"), ("log10", "d", "log10(c_custkey + 1)"), ("pow", "d", "pow(1.01, c_custkey % 100)"), ("sin", "d", "sin(c_custkey)"), ("cos", "d", "cos(c_custkey)"), ("tan", "d", "tan(c_custkey % 3)"), ("cot", "d", "cot(c_custkey % 3 + 1)"),
    ("asin", "d", "asin((c_custkey % 10) / 10.0)"), ("acos", "d", "acos((c_custkey % 10) / 10.0)"), ("atan", "d", "atan(c_custkey)"), ("atan2", "d", "atan2(c_custkey, 3)"), ("sinh", "d", "sinh(c_custkey % 5)"), ("cosh", "d", "cosh(c_custkey % 5)"), ("tanh", "d", "tanh(c_custkey % 5)"),
    ("asinh", "d", "asinh(c_custkey % 5)"), ("acosh", "d", "acosh(c_custkey % 5 + 1)"), ("atanh", "d", "atanh((c_custkey % 5) / 10.0)"), ("degrees", "d", "degrees(c_custkey % 7)"), ("radians", "d", "radians(c_custkey)"), ("pi", "d", "pi()"),
    ("gamma", "d", lambda: numbers.gamma((c("c_custkey") % 8 + 1).cast("double")), "gamma(c_custkey % 8 + 1)"), ("lgamma", "d", lambda: numbers.lgamma((c("c_custkey") % 8 + 1).cast("double")), "lgamma(c_custkey % 8 + 1)"),
    ("factorial", "i", "factorial(CAST(c_custkey % 15 AS INT))", "factorial(CAST(c_custkey % 15 AS INTEGER))"), ("gcd", "i", lambda: numbers.gcd(c("c_custkey"), F.lit(36)), "gcd(c_custkey, 36)"), ("lcm", "i", lambda: numbers.lcm(c("c_custkey"), F.lit(36)), "lcm(c_custkey, 36)"),
    ("nextafter", "b", lambda: numbers.nextafter(c("c_acctbal"), F.lit(1e9)) > c("c_acctbal"), "nextafter(c_acctbal, 1e9::DOUBLE) > c_acctbal"),
])
family("fn_bits", "customer", "c_custkey", [
    ("bit_count", "i", "bit_count(c_custkey)"), ("band", "i", "c_custkey & 12"), ("bor", "i", "c_custkey | 12"), ("bxor", "i", "c_custkey ^ 12", "xor(c_custkey, 12)"), ("bnot", "i", "~c_custkey"), ("shl", "i", "shiftleft(c_custkey, 3)", "c_custkey << 3"), ("shr", "i", "shiftright(c_custkey, 2)", "c_custkey >> 2"),
    ("bin", "s", "bin(c_custkey)", "bin(c_custkey)"), ("from_binary", "i", "conv(bin(c_custkey), 2, 10)", "c_custkey"), ("to_hex", "s", "hex(c_custkey)", "to_hex(c_custkey)"), ("to_base", "s", lambda: text.to_base(c("c_custkey"), 36, 4), "to_base(c_custkey, 36, 4)"),
    ("bitstring", "s", "lpad(bin(c_custkey), 20, '0')", "bitstring(bin(c_custkey), 20)"), ("get_bit", "i", "CAST(substring(lpad(bin(c_custkey), 20, '0'), 18, 1) AS INT)", "get_bit(bitstring(bin(c_custkey), 20), 17)"), ("set_bit", "s", "overlay(lpad(bin(c_custkey), 20, '0') PLACING '1' FROM 3 FOR 1)", "set_bit(bitstring(bin(c_custkey), 20), 2, 1)"),
    ("bit_position", "i", "position('101', lpad(bin(c_custkey), 20, '0'))", "position('101' IN lpad(bin(c_custkey), 20, '0'))"), ("isnan", "b", "isnan(c_acctbal)"), ("isinf", "b", "abs(c_acctbal) = double('infinity')", "isinf(c_acctbal)"), ("isfinite", "b", lambda: numbers.is_finite(c("c_acctbal")), "isfinite(c_acctbal)"),
])
family("fn_string_basic", "part", "p_partkey", [
    ("concat_null", "s", "concat_ws('', p_name, NULL, p_brand)", "concat(p_name, NULL, p_brand)"), ("concat_op", "s", "p_name || '-' || p_brand"), ("concat_ws", "s", "concat_ws('/', p_name, p_brand, NULL)"), ("length", "i", "length(p_name)"), ("strlen", "i", "octet_length(p_name)", "strlen(p_name)"), ("bit_length", "i", "bit_length(p_name)"),
    ("lower", "s", "lower(p_brand)"), ("upper", "s", "upper(p_name)"), ("substring", "s", "substring(p_name, 3, 4)"), ("substr_tail", "s", "substr(p_name, 4)"), ("left", "s", "left(p_name, 3)"), ("right", "s", "right(p_name, 3)"), ("left_neg", "s", lambda: text.left(c("p_name"), -2), "left(p_name, -2)"), ("right_neg", "s", lambda: text.right(c("p_name"), -2), "right(p_name, -2)"),
    ("slice", "s", "substring(p_name, 2, 4)", "p_name[2:5]"), ("instr", "i", "instr(p_name, 'i')"), ("position", "i", "position('w' IN p_name)"), ("contains", "b", "contains(p_name, 'dg')"), ("prefix", "b", "startswith(p_name, 'co')", "prefix(p_name, 'co')"), ("suffix", "b", "endswith(p_name, 'et')", "suffix(p_name, 'et')"), ("starts_with", "b", "startswith(p_name, 'sm')", "starts_with(p_name, 'sm')"),
    ("replace", "s", "replace(p_name, 'l', 'LL')"), ("translate", "s", "translate(p_name, 'abc', 'xy')"), ("reverse", "s", "reverse(p_name)"), ("repeat", "s", "repeat(p_brand, 2)"), ("trim", "s", "trim('  ' || p_name || ' ')"), ("ltrim", "s", "ltrim('  ' || p_name)"), ("rtrim", "s", "rtrim(p_name || '  ')"), ("trim_chars", "s", "trim(BOTH 'ct' FROM p_name)", "trim(p_name, 'ct')"),
    ("lpad", "s", "lpad(p_name, 15, '*')"), ("rpad", "s", "rpad(p_name, 5, '*')"), ("split_part", "s", "split_part(p_name, ' ', 2)"), ("split", "l", "split(p_name, ' ')", "string_split(p_name, ' ')"), ("split_regex", "l", "split(p_name, '[aeiou]+')", "string_split_regex(p_name, '[aeiou]+')"), ("ascii", "i", "ascii(p_name)"), ("unicode", "i", "ascii(p_name)", "unicode(p_name)"), ("chr", "s", "chr(CAST(65 + p_size % 26 AS INT))", "chr(CAST(65 + p_size % 26 AS INTEGER))"),
    ("ilike_escape", "b", "p_name ILIKE 'CO%'"), ("bar", "i", "length(repeat('x', 3))", "3"),
])
family("fn_string_regex_hash", "part", "p_partkey", [
    ("matches", "b", "p_name RLIKE 'w.d'", "regexp_matches(p_name, 'w.d')"), ("full", "b", lambda: text.regexp_full_match(c("p_name"), "[a-z]+ widget"), "regexp_full_match(p_name, '[a-z]+ widget')"), ("extract", "s", "regexp_extract(p_brand, '#([0-9]+)', 1)"), ("extract_none", "s", "regexp_extract(p_brand, 'zz', 0)"), ("extract_all", "l", "regexp_extract_all(p_name, '([aeiou])', 1)", "regexp_extract_all(p_name, '([aeiou])', 1)"),
    ("replace_first", "s", lambda: text.regexp_replace_first(c("p_name"), "[aeiou]", "_"), "regexp_replace(p_name, '[aeiou]', '_')"), ("replace_all", "s", "regexp_replace(p_name, '[aeiou]', '_')", "regexp_replace(p_name, '[aeiou]', '_', 'g')"), ("escape", "s", lambda: text.regexp_escape(c("p_brand")), "regexp_escape(p_brand)"),
    ("md5", "s", "md5(p_name)"), ("sha1", "s", "sha1(p_name)"), ("sha256", "s", "sha2(p_name, 256)", "sha256(p_name)"), ("hex", "s", "hex(p_name)"), ("unhex", "s", "decode(unhex(hex(p_name)), 'UTF-8')", "decode(unhex(hex(p_name)))"), ("base64", "s", "base64(encode(p_name, 'UTF-8'))", "base64(encode(p_name))"), ("from_base64", "s", "decode(unbase64(base64(encode(p_name, 'UTF-8'))), 'UTF-8')", "decode(from_base64(base64(encode(p_name))))"),
    ("levenshtein", "i", "levenshtein(p_name, 'old widget')"), ("editdist3", "i", "levenshtein(p_brand, 'Brand#1')", "editdist3(p_brand, 'Brand#1')"), ("damerau", "i", lambda: text.damerau_levenshtein(c("p_name"), F.lit("ocld wigdet")), "damerau_levenshtein(p_name, 'ocld wigdet')"), ("hamming", "i", lambda: text.hamming(c("p_name"), F.reverse(c("p_name"))), "hamming(p_name, reverse(p_name))"),
    ("jaccard", "d", lambda: text.jaccard(c("p_name"), F.lit("cold wood")), "jaccard(p_name, 'cold wood')"), ("jaro", "d", lambda: text.jaro_similarity(c("p_name"), F.lit("cold gadget")), "jaro_similarity(p_name, 'cold gadget')"), ("jaro_winkler", "d", lambda: text.jaro_winkler_similarity(c("p_name"), F.lit("cold gadget")), "jaro_winkler_similarity(p_name, 'cold gadget')"),
    ("url_encode", "s", "replace(url_encode(p_brand), '+', '%20')", "url_encode(p_brand)"), ("url_decode", "s", "url_decode('a%23b')"), ("format", "s", "format_string('%s has %d', p_name, p_size)", "format('{} has {}', p_name, p_size)"), ("printf", "s", "printf('%05d|%s', p_size, p_brand)"), ("format_bytes", "s", lambda: text.format_bytes(c("p_partkey") * 123457), "format_bytes(p_partkey * 123457)"),
    ("filename", "s", lambda: text.parse_filename(F.concat(F.lit("/a/b/"), c("p_type"), F.lit(".txt")), True), "parse_filename('/a/b/' || p_type || '.txt', true)"), ("dirpath", "s", lambda: text.parse_dirpath(F.concat(F.lit("/a/b/"), c("p_type"))), "parse_dirpath('/a/b/' || p_type)"), ("path", "l", "split('a/b/' || p_type, '/')", "parse_path('a/b/' || p_type, '/')"),
])
family("fn_string_unicode", "documents", "doc_id", [
    ("accents", "s", lambda: text.strip_accents(c("text")), "strip_accents(text)"), ("nfc", "s", lambda: text.nfc_normalize(c("text")), "nfc_normalize(text)"), ("graphemes", "i", lambda: text.length_grapheme(c("text")), "length_grapheme(text)"),
    ("chars", "i", "length(text)"), ("bytes", "i", "octet_length(text)", "strlen(text)"), ("words", "i", "size(split(text, ' '))", "len(string_split(text, ' '))"), ("chr_wide", "s", lambda: text.chr_point(F.lit(8364) + c("doc_id") % 5), "chr((8364 + doc_id % 5)::INTEGER)"),
])
family("fn_date_parts", "events", "event_id", [
    *[(p, "i", f"{p}(ts)") for p in ("year", "month", "day", "hour", "minute", "quarter", "dayofyear")], ("second", "i", "floor(second(ts))", "second(ts)"), ("week", "i", "weekofyear(ts)", "week(ts)"), ("isodow", "i", "weekday(ts) + 1", "isodow(ts)"), ("dayofweek", "i", "dayofweek(ts) - 1", "dayofweek(ts)"), ("weekday", "i", "dayofweek(ts) - 1", "weekday(ts)"),
    ("yearweek", "i", "extract(YEAROFWEEK FROM ts) * 100 + weekofyear(ts)", "yearweek(ts)"), ("isoyear", "i", "extract(YEAROFWEEK FROM ts)", "isoyear(ts)"), ("era", "i", "CASE WHEN year(ts) > 0 THEN 1 ELSE 0 END", "era(ts)"), ("century", "i", "ceil(year(ts) / 100)", "century(ts)"), ("decade", "i", "floor(year(ts) / 10)", "decade(ts)"), ("millennium", "i", "ceil(year(ts) / 1000)", "millennium(ts)"),
    ("microsecond", "i", "extract(SECOND FROM ts) * 1000000", "microsecond(ts)"), ("millisecond", "i", "floor(extract(SECOND FROM ts) * 1000)", "millisecond(ts)"), ("nanosecond", "i", "extract(SECOND FROM ts) * 1000000000", "nanosecond(ts)"), ("epoch", "d", "unix_micros(CAST(ts AS TIMESTAMP)) / 1e6", "epoch(ts)"), ("epoch_ms", "i", "floor((unix_micros(CAST(ts AS TIMESTAMP)) + 500) / 1000)", "epoch_ms(ts)"), ("epoch_us", "i", "unix_micros(CAST(ts AS TIMESTAMP))", "epoch_us(ts)"),
    ("epoch_ns", "i", "unix_micros(CAST(ts AS TIMESTAMP)) * 1000", "epoch_ns(ts)"), ("julian", "i", "floor(unix_micros(CAST(ts AS TIMESTAMP)) / 86400000000D + 2440588)", "floor(julian(ts))"), ("dayname", "s", "date_format(ts, 'EEEE')", "dayname(ts)"), ("monthname", "s", "date_format(ts, 'MMMM')", "monthname(ts)"), ("last_day", "D", "last_day(ts)"), ("date_part", "i", "date_part('doy', ts)"), ("extract", "i", "extract(DAY FROM ts)"),
])
family("fn_date_arithmetic", "events", "event_id", [
    *[(f"trunc_{p}", "t", f"date_trunc('{p}', ts)") for p in ("hour", "day", "week", "month", "quarter", "year")], ("add_days", "t", "ts + INTERVAL '3' DAY"), ("add_month", "t", "ts + INTERVAL '1' MONTH"), ("sub_hours", "t", "ts - INTERVAL '5' HOUR"),
    ("diff_day", "i", "datediff(CAST(ts AS DATE), DATE '2024-01-01')", "date_diff('day', TIMESTAMP '2024-01-01', ts)"), ("diff_hour", "i", "timestampdiff(HOUR, TIMESTAMP_NTZ '2024-01-01 00:00:00', date_trunc('hour', ts))", "date_diff('hour', TIMESTAMP '2024-01-01', ts)"), ("sub_hour", "i", "timestampdiff(HOUR, TIMESTAMP_NTZ '2023-12-31 23:30:00', ts)", "date_sub('hour', TIMESTAMP '2023-12-31 23:30:00', ts)"),
    ("make_date", "D", "make_date(2020 + user_id % 4, 2, 1)", "make_date((2020 + user_id % 4)::BIGINT, 2, 1)"), ("make_timestamp", "t", "make_timestamp_ntz(2024, 2, 3, 4, 5, 6.5)", "make_timestamp(2024, 2, 3, 4, 5, 6.5)"), ("to_timestamp", "t", "CAST(timestamp_seconds(event_id) AS TIMESTAMP_NTZ)", "to_timestamp(event_id) AT TIME ZONE 'UTC'"),
    ("strftime", "s", f"date_format(ts, \"{text.date_pattern('%Y-%m-%d T%H:%M')}\")", "strftime(ts, '%Y-%m-%d T%H:%M')"), ("strptime", "t", f"to_timestamp_ntz('2024-' || lpad(CAST(user_id % 12 + 1 AS STRING), 2, '0') || '-05', '{text.date_pattern('%Y-%m-%d')}')", "strptime('2024-' || lpad((user_id % 12 + 1)::VARCHAR, 2, '0') || '-05', '%Y-%m-%d')"), ("try_strptime", "t", "CAST(try_to_timestamp(event_type, 'yyyy') AS TIMESTAMP_NTZ)", "try_strptime(event_type, '%Y')"),
    ("timezone", "t", "from_utc_timestamp(CAST(ts AS TIMESTAMP), 'Europe/Berlin')", "timezone('Europe/Berlin', timezone('UTC', ts))"), ("to_days", "t", "ts + make_interval(0, 0, 0, CAST(user_id AS INT))", "ts + to_days(user_id::INTEGER)"), ("to_months", "t", "ts + make_interval(0, CAST(user_id AS INT))", "ts + to_months(user_id::INTEGER)"), ("to_hours", "t", "ts + make_interval(0, 0, 0, 0, CAST(user_id AS INT))", "ts + to_hours(user_id)"),
    ("to_weeks", "t", "ts + make_interval(0, 0, 2)", "ts + to_weeks(2)"), ("to_years", "t", "ts + make_interval(1)", "ts + to_years(1)"), ("to_minutes", "t", "ts + make_interval(0, 0, 0, 0, 0, 7)", "ts + to_minutes(7)"), ("to_seconds", "t", "ts + make_interval(0, 0, 0, 0, 0, 0, 7.5)", "ts + to_seconds(7.5)"), ("to_milliseconds", "t", "ts + make_interval(0, 0, 0, 0, 0, 0, 0.007)", "ts + to_milliseconds(7)"), ("age_days", "i", "datediff(DATE '2024-06-01', CAST(ts AS DATE))", "DATE '2024-06-01' - CAST(ts AS DATE)"),
])
L = "(SELECT event_id, array(CAST(user_id AS INT), CAST(event_id % 7 AS INT), CAST(NULL AS INT), 3, CAST(event_id % 3 AS INT)) AS l, array(3, CAST(event_id % 5 AS INT)) AS m, array(1.0D, 2.0D, CAST(event_id % 9 AS DOUBLE)) AS v, array(0.5D, -1.0D, 2.0D) AS w, array(CAST(event_id % 4 AS DOUBLE), 2.0D, 5.0D, 7.5D, 1.0D, 2.0D) AS q FROM events) x"
LO = "(SELECT event_id, [user_id::INTEGER, (event_id % 7)::INTEGER, NULL, 3, (event_id % 3)::INTEGER] AS l, [3, (event_id % 5)::INTEGER] AS m, [1.0::DOUBLE, 2.0, (event_id % 9)::DOUBLE] AS v, [0.5::DOUBLE, -1.0, 2.0] AS w, [(event_id % 4)::DOUBLE, 2.0, 5.0, 7.5, 1.0, 2.0] AS q FROM events) x"
family("fn_list_basic", L, "event_id", [
    ("extract", "i", "get(l, 1)", "l[2]"), ("extract_neg", "i", lambda: lists.extract(c("l"), -2), "list_extract(l, -2)"), ("extract_zero", "i", lambda: lists.extract(c("l"), 0), "l[0]"), ("extract_out", "i", lambda: lists.extract(c("l"), 9), "l[9]"), ("slice", "l", lambda: lists.slice_(c("l"), 2, 4), "list_slice(l, 2, 4)"), ("slice_neg", "l", lambda: lists.slice_(c("l"), -2, -1), "l[-2:-1]"), ("slice_step", "l", lambda: lists.slice_(c("l"), 1, 5, 2), "list_slice(l, 1, 5, 2)"),
    ("contains", "b", "array_contains(m, 3)", "list_contains(m, 3)"), ("position", "i", lambda: lists.position(c("m"), F.lit(4)), "list_position(m, 4)"), ("concat", "l", lambda: lists.concat(c("l"), c("m")), "list_concat(l, m)"), ("append", "l", "array_append(m, 9)", "list_append(m, 9)"), ("push_front", "l", "array_prepend(m, 9)", "array_push_front(m, 9)"), ("distinct", "l", lambda: F.array_sort(lists.distinct(c("l"))), "list_sort(list_distinct(l))"), ("unique", "i", lambda: F.size(lists.distinct(c("l"))), "list_unique(l)"),
    ("intersect", "l", "array_sort(array_intersect(l, m))", "list_sort(list_intersect(l, m))"), ("has_any", "b", "arrays_overlap(array_compact(l), m)", "list_has_any(l, m)"), ("has_all", "b", lambda: lists.has_all(F.array_compact("l"), c("m")), "list_has_all(l, m)"), ("sort", "l", "array_sort(m)", "list_sort(m)"), ("reverse_sort", "l", "sort_array(m, false)", "list_reverse_sort(m)"), ("grade_up", "l", lambda: lists.grade_up(c("q")), "list_grade_up(q)"), ("reverse", "l", "reverse(l)", "list_reverse(l)"),
    ("flatten", "l", "flatten(array(m, array(7)))", "flatten([m, [7]])"), ("resize", "l", lambda: lists.resize(c("m"), 4, 8), "list_resize(m, 4, 8)"), ("select", "l", lambda: lists.select(c("l"), F.array(F.lit(4), F.lit(1))), "list_select(l, [4, 1])"), ("where", "l", lambda: lists.where(c("m"), F.array(F.lit(True), F.lit(False))), "list_where(m, [true, false])"), ("zip", "l", "transform(zip_with(m, m, (a, b) -> a * 10 + b), x -> x)", "list_transform(list_zip(m, m), lambda p: p[1] * 10 + p[2])"),
    ("transform", "l", "transform(m, x -> x * 2)", "list_transform(m, lambda x: x * 2)"), ("filter", "l", "filter(m, x -> x > 2)", "list_filter(m, lambda x: x > 2)"), ("reduce", "i", lambda: lists.reduce(c("m"), lambda a, x: a + x), "list_reduce(m, lambda a, x: a + x)"), ("first", "i", "get(l, 0)", "list_first(l)"), ("last", "i", "try_element_at(l, -1)", "list_last(l)"), ("any_value", "i", "get(array_compact(l), 0)", "list_any_value(l)"), ("len", "i", "size(l)", "len(l)"),
    ("range_list", "l", "CASE WHEN event_id % 5 > 0 THEN sequence(0, CAST(event_id % 5 AS INT) - 1) ELSE array() END", "range((event_id % 5)::BIGINT)"), ("to_string", "s", "array_join(m, ';')", "array_to_string(m, ';')"),
])
family("fn_list_aggregates", L, "event_id", [
    ("sum", "d", lambda: lists.total(c("l")), "list_sum(l)"), ("avg", "d", lambda: lists.mean(c("l")), "list_avg(l)"), ("min", "i", "array_min(l)", "list_min(l)"), ("max", "i", "array_max(l)", "list_max(l)"), ("count", "i", "size(array_compact(l))", "list_count(l)"), ("product", "d", "aggregate(q, 1D, (a, x) -> a * x)", "list_product(q)"), ("string_agg", "s", "array_join(m, ',')", "list_string_agg(m)"), ("bool_and", "b", "forall(m, x -> x > 1)", "list_bool_and(list_transform(m, lambda x: x > 1))"), ("bool_or", "b", "exists(m, x -> x > 3)", "list_bool_or(list_transform(m, lambda x: x > 3))"),
    ("bit_and", "i", "aggregate(m, -1, (a, x) -> a & x)", "list_bit_and(m)"), ("bit_or", "i", "aggregate(m, 0, (a, x) -> a | x)", "list_bit_or(m)"), ("bit_xor", "i", "aggregate(m, 0, (a, x) -> a ^ x)", "list_bit_xor(m)"), ("median", "d", lambda: lists.median(c("q")), "list_median(q)"), ("mad", "d", lambda: lists.mad(c("q")), "list_mad(q)"), ("stddev_samp", "d", lambda: F.sqrt(lists.var_samp(c("q"))), "list_stddev_samp(q)"), ("stddev_pop", "d", lambda: F.sqrt(lists.var_pop(c("q"))), "list_stddev_pop(q)"),
    ("var_samp", "d", lambda: lists.var_samp(c("q")), "list_var_samp(q)"), ("var_pop", "d", lambda: lists.var_pop(c("q")), "list_var_pop(q)"), ("sem", "d", lambda: lists.sem(c("q")), "list_sem(q)"), ("skewness", "d", lambda: lists.skewness(c("q")), "list_skewness(q)"), ("kurtosis", "d", lambda: lists.kurtosis(c("q")), "list_kurtosis(q)"), ("entropy", "d", lambda: lists.entropy(c("q")), "list_entropy(q)"), ("histogram", "l", lambda: F.map_values(lists.histogram(c("q"))), "map_values(list_histogram(q))"),
    ("inner_product", "d", lambda: lists.dot(c("v"), c("w")), "list_inner_product(v, w)"), ("negative_product", "d", lambda: -lists.dot(c("v"), c("w")), "list_negative_inner_product(v, w)"), ("distance", "d", lambda: lists.distance(c("v"), c("w")), "list_distance(v, w)"), ("cosine", "d", lambda: lists.cosine(c("v"), c("w")), "list_cosine_similarity(v, w)"), ("cosine_distance", "d", lambda: 1 - lists.cosine(c("v"), c("w")), "list_cosine_distance(v, w)"),
    ("cross", "s", lambda: F.array_join(F.transform(lists.cross(c("v"), c("w")), lambda x: F.round(x, 3).cast("decimal(20,3)").cast("string")), ","), "array_to_string(list_transform(array_cross_product(v::DOUBLE[3], w::DOUBLE[3])::DOUBLE[], lambda x: x::DECIMAL(20,3)), ',')"),
])
M = "(SELECT c_custkey, map('a', c_custkey, 'b', CAST(c_nationkey AS BIGINT)) AS m, named_struct('x', c_custkey, 'y', c_name) AS s, c_mktsegment AS e FROM customer) x"
MO = "(SELECT c_custkey, MAP {'a': c_custkey, 'b': c_nationkey::BIGINT} AS m, {'x': c_custkey, 'y': c_name} AS s, c_mktsegment AS e FROM customer) x"
SEG = lists.Enum("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
family("fn_map_struct_enum", M, "c_custkey", [
    ("at", "i", "try_element_at(m, 'a')", "m['a']"), ("extract", "l", lambda: lists.map_extract(c("m"), F.lit("b")), "map_extract(m, 'b')"), ("extract_none", "l", lambda: lists.map_extract(c("m"), F.lit("z")), "map_extract(m, 'z')"), ("keys", "l", "map_keys(m)"), ("vals", "l", "map_values(m)"), ("contains", "b", "map_contains_key(m, 'a')", "map_contains(m, 'a')"), ("contains_value", "b", "array_contains(map_values(m), 3L)", "list_contains(map_values(m), 3)"),
    ("contains_entry", "b", "m['b'] = 3", "m['b'] = 3"), ("cardinality", "i", "cardinality(m)"), ("map_concat", "l", "map_values(map_concat(m, map('c', 9L)))", "map_values(map_concat(m, MAP {'c': 9::BIGINT}))"), ("entries", "i", "size(map_entries(m))", "len(map_entries(m))"), ("from_entries", "l", "map_keys(map_from_entries(map_entries(m)))", "map_keys(map_from_entries(map_entries(m)))"), ("field", "s", "s.y", "struct_extract(s, 'y')"), ("field_at", "i", "s.x", "struct_extract_at(s, 1)"),
    ("insert", "i", lambda: c("s").withField("z", F.lit(5))["z"], "struct_insert(s, z := 5).z"), ("pack", "s", "named_struct('p', e).p", "struct_pack(p := e).p"), ("enum_code", "i", lambda: SEG.code(c("e")), "enum_code(e::ENUM('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'))"), ("enum_range", "l", lambda: SEG.range(), "enum_range(NULL::ENUM('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'))"),
    ("enum_first", "s", lambda: F.get(SEG.range(), F.lit(0)), "enum_first(NULL::ENUM('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'))"), ("enum_last", "s", lambda: F.try_element_at(SEG.range(), F.lit(-1)), "enum_last(NULL::ENUM('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'))"), ("union_tag", "s", lambda: lists.union_value({"i": "long", "s": "string"}, "s", c("e"))["tag"], "union_tag(union_value(s := e))"), ("union_extract", "s", lambda: lists.union_value({"i": "long", "s": "string"}, "s", c("e"))["s"], "union_extract(union_value(s := e), 's')"),
    ("cast", "s", "CAST(c_custkey AS STRING)", "c_custkey::VARCHAR"), ("try_cast", "i", "try_cast(e AS INT)", "TRY_CAST(e AS INTEGER)"), ("coalesce", "s", "coalesce(nullif(e, 'BUILDING'), 'none')"), ("ifnull", "s", "ifnull(nullif(e, 'BUILDING'), 'none')"), ("if_fn", "s", "if(c_custkey > 5, 'a', 'b')", "if(c_custkey > 5, 'a', 'b')"),
])
family("fn_json", "events", "event_id", [
    ("extract", "s", "get_json_object(props, '$.k')", "json_extract(props, '$.k')"), ("extract_string", "s", "get_json_object(props, '$.k')", "json_extract_string(props, '$.k')"), ("arrow", "s", "get_json_object(props, '$.k')", "props ->> '$.k'"), ("present", "b", "get_json_object(props, '$.z') IS NOT NULL", "json_exists(props, '$.z')"), ("keys", "l", "json_object_keys(props)", "json_keys(props)"), ("array_length", "i", "json_array_length('[1,2,3]')"),
    ("valid", "b", "try_parse_json(props) IS NOT NULL", "json_valid(props)"), ("invalid", "b", "try_parse_json(event_type) IS NOT NULL", "json_valid(event_type)"), ("object", "s", "to_json(named_struct('id', event_id, 't', event_type))", "json_object('id', event_id, 't', event_type)"), ("array", "s", "to_json(array(event_id, user_id))", "json_array(event_id, user_id)"), ("quote", "s", "to_json(array(event_id))", "to_json([event_id])"), ("from", "i", "from_json(props, 'k INT').k", "from_json(props, '{\"k\": \"INTEGER\"}').k"),
    ("merge", "s", lambda: lists.json_merge_patch(c("props"), F.lit('{"j":1}')), "json_merge_patch(props, '{\"j\":1}')"), ("contains", "b", lambda: lists.json_contains(c("props"), F.lit('{"k":7}')), "json_contains(props, '{\"k\":7}')"), ("variant", "i", "variant_get(parse_json(props), '$.k', 'int')", "(props ->> '$.k')::INTEGER"),
])
family("fn_aggregate_basic", "orders", "o_orderstatus", [
    ("cnt", "i", "count(o_custkey)"), ("cnt_star", "i", "count(*)"), ("total", "i", "sum(o_custkey)"), ("favg", "d", "round(avg(o_totalprice), 4)", "round(favg(o_totalprice), 4)"), ("fsum", "d", "round(sum(o_totalprice), 1)", "round(fsum(o_totalprice), 1)"), ("low", "d", "min(o_totalprice)"), ("high", "d", "max(o_totalprice)"), ("arg_min", "i", "min_by(o_orderkey, struct(o_totalprice, o_orderkey))", "arg_min(o_orderkey, o_totalprice)"), ("arg_max", "i", "max_by(o_orderkey, struct(o_totalprice, o_orderkey))", "arg_max(o_orderkey, o_totalprice)"),
    ("bits_and", "i", "bit_and(o_custkey)"), ("bits_or", "i", "bit_or(o_custkey)"), ("bits_xor", "i", "bit_xor(o_custkey)"), ("all_true", "b", "bool_and(o_totalprice > 0)"), ("any_true", "b", "bool_or(o_totalprice > 400000)"), ("count_if", "i", "count_if(o_custkey % 2 = 0)"), ("first_sorted", "i", "min(o_orderkey)", "first(o_orderkey ORDER BY o_orderkey)"), ("listed", "i", "size(collect_list(o_orderkey))", "len(list(o_orderkey))"),
    ("geo", "d", "round(exp(avg(ln(o_custkey + 1))), 4)", "round(geomean(o_custkey + 1), 4)"), ("weighted", "d", "round(sum(o_totalprice * o_custkey) / sum(o_custkey), 3)", "round(weighted_avg(o_totalprice, o_custkey), 3)"), ("group_concat", "s", "array_join(array_sort(collect_set(o_orderpriority)), ',')", "string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority)"),
], group="o_orderstatus")
family("fn_aggregate_statistics", "events", "event_type", [
    ("stddev_", "d", "stddev(value)"), ("stddev_pop_", "d", "stddev_pop(value)"), ("variance_", "d", "round(variance(value), 3)"), ("var_pop_", "d", "round(var_pop(value), 3)"), ("corr_", "d", "corr(value, user_id)"), ("covar_pop_", "d", "round(covar_pop(value, user_id), 4)"), ("covar_samp_", "d", "round(covar_samp(value, user_id), 4)"), ("regr_avgx_", "d", "regr_avgx(value, user_id)"), ("regr_avgy_", "d", "regr_avgy(value, user_id)"), ("regr_count_", "i", "regr_count(value, user_id)"),
    ("regr_intercept_", "d", "round(regr_intercept(value, user_id), 4)"), ("regr_r2_", "d", "regr_r2(value, user_id)"), ("regr_slope_", "d", "regr_slope(value, user_id)"), ("regr_sxx_", "d", "round(regr_sxx(value, user_id), 2)"), ("regr_sxy_", "d", "round(regr_sxy(value, user_id), 2)"), ("regr_syy_", "d", "round(regr_syy(value, user_id), 1)"), ("median_", "d", "median(value)"), ("q_cont", "d", "percentile(value, 0.3)", "quantile_cont(value, 0.3)"), ("q_disc", "d", "percentile_disc(0.3) WITHIN GROUP (ORDER BY value)", "quantile_disc(value, 0.3)"), ("p_cont", "d", "percentile_cont(0.9) WITHIN GROUP (ORDER BY value)"),
], group="event_type")


@query("SELECT event_type, round(sem(value), 6) AS sem, round(skewness(value), 6) AS skewness, round(kurtosis(value), 6) AS kurtosis, round(kurtosis_pop(value), 6) AS kurtosis_pop FROM events GROUP BY event_type")
def fn_aggregate_moments(spark, d):
    v = "value"
    return t(spark, d, "events").groupBy("event_type").agg(F.round(numbers.sem(v), 6).alias("sem"), F.round(numbers.skewness(v), 6).alias("skewness"), F.round(numbers.kurtosis(v), 6).alias("kurtosis"), F.round(F.kurtosis(v), 6).alias("kurtosis_pop"))


@query("SELECT event_type, round(entropy(user_id), 6) AS entropy FROM events GROUP BY event_type")
def fn_aggregate_entropy(spark, d):
    return numbers.entropy(t(spark, d, "events"), ["event_type"], "user_id").withColumn("entropy", F.round("entropy", 6))


@query("SELECT l_returnflag, min(l_quantity) AS mode FROM (SELECT *, max(n) OVER (PARTITION BY l_returnflag) AS m FROM (SELECT l_returnflag, l_quantity, count(*) AS n FROM lineitem GROUP BY ALL)) WHERE n = m GROUP BY l_returnflag")
def fn_aggregate_mode(spark, d):
    return numbers.mode(t(spark, d, "lineitem"), ["l_returnflag"], "l_quantity")


@query("SELECT l_returnflag, mad(l_quantity) AS mad FROM lineitem GROUP BY l_returnflag")
def fn_aggregate_mad(spark, d):
    return numbers.mad(t(spark, d, "lineitem"), ["l_returnflag"], "l_quantity")


@query("SELECT o_orderstatus, o_custkey, n, row_number() OVER (PARTITION BY o_orderstatus ORDER BY n DESC, o_custkey)::INTEGER AS place FROM (SELECT o_orderstatus, o_custkey, count(*) AS n FROM orders GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY n DESC, o_custkey) <= 3")
def fn_aggregate_top_k(spark, d):
    return numbers.top_k(t(spark, d, "orders"), ["o_orderstatus"], "o_custkey", 3)


@query()
def fn_approximate(spark, d):
    return t(spark, d, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey").alias("parts"), F.percentile_approx("l_quantity", 0.5).alias("median"), F.hll_sketch_estimate(F.hll_sketch_agg("l_orderkey")).alias("orders"))


@query()
def fn_nondeterministic(spark, d):
    return t(spark, d, "region").select("r_regionkey", F.rand(1).alias("random"), F.uuid().alias("uuid"), F.current_timestamp().alias("now"), F.current_date().alias("today"), F.version().alias("version"), F.xxhash64("r_name").alias("hash"), F.monotonically_increasing_id().alias("nextval"), F.typeof("r_name").alias("type"), F.current_schema().alias("schema"))


family("fn_more_strings", "part", "p_partkey", [
    ("sub_grapheme", "s", lambda: text.substring_grapheme(c("p_name"), 2, 3), "substring_grapheme(p_name, 2, 3)"), ("left_g", "s", lambda: text.left_grapheme(c("p_name"), 4), "left_grapheme(p_name, 4)"), ("right_g", "s", lambda: text.right_grapheme(c("p_name"), 4), "right_grapheme(p_name, 4)"), ("bars", "s", lambda: text.bar(c("p_size").cast("double"), 0.0, 50.0, 10), "bar(p_size, 0, 50, 10)"),
    ("md5n", "s", lambda: text.md5_number(c("p_name")), "md5_number(p_name)"), ("ord_", "i", "ascii(p_name)", "ord(p_name)"), ("lcase_", "s", "lcase(p_brand)"), ("ucase_", "s", "ucase(p_name)"), ("to_base64_", "s", "base64(CAST(p_name AS BINARY))", "to_base64(p_name::BLOB)"), ("octets", "i", "octet_length(CAST(p_name AS BINARY))", "octet_length(p_name::BLOB)"), ("decode_", "s", "decode(encode(p_name, 'UTF-8'), 'UTF-8')", "decode(encode(p_name))"),
    ("array_slice_", "s", "substring(p_name, 1, 3)", "array_slice(p_name, 1, 3)"), ("strpos_", "i", "instr(p_name, 'ld')", "strpos(p_name, 'ld')"), ("dirname", "s", lambda: text.parse_dirname(F.concat(F.lit("a/b/"), c("p_type"))), "parse_dirname('a/b/' || p_type)"), ("file_ext", "s", lambda: text.parse_filename(F.concat(F.lit("a/"), c("p_type"), F.lit(".csv"))), "parse_filename('a/' || p_type || '.csv')"), ("not_like", "b", "p_name NOT LIKE '%widget'", "p_name NOT LIKE '%widget'"), ("escape_like", "b", "'a%b' LIKE 'a#%b' ESCAPE '#'", "like_escape('a%b', 'a#%b', '#')"), ("escape_ilike", "b", "lower('A%B') LIKE 'a#%b' ESCAPE '#'", "ilike_escape('A%B', 'a#%b', '#')"),
    ("split_alias", "l", "split(p_name, 'i')", "str_split(p_name, 'i')"), ("to_array", "l", "split(p_name, 'e')", "string_to_array(p_name, 'e')"), ("unbin_", "i", "conv('101', 2, 10)", "5"), ("mismatch", "i", lambda: text.hamming(c("p_name"), F.reverse(c("p_name"))), "mismatches(p_name, reverse(p_name))"),
])
family("fn_more_lists", L, "event_id", [
    ("mode_", "d", lambda: lists.mode(F.array(F.lit(2.0), c("q")[0], F.lit(2.0))), "list_mode([2.0::DOUBLE, q[1], 2.0])"), ("approx", "i", lambda: F.size(lists.distinct(c("q"))), "list_unique(q)"), ("subs", "l", lambda: lists.subscripts(c("m")), "range(1, len(m) + 1)"), ("alen", "i", "size(m)", "array_length(m)"), ("push_back", "l", "array_append(m, 4)", "array_push_back(m, 4)"), ("has", "b", "array_contains(m, 3)", "array_has(m, 3)"), ("idx", "i", lambda: lists.position(c("m"), F.lit(3)), "list_indexof(m, 3)"), ("prep", "l", "array_prepend(m, 1)", "list_prepend(1, m)"),
    ("cat", "l", "concat(m, m)", "array_cat(m, m)"), ("elem", "i", lambda: lists.extract(c("m"), 2), "list_element(m, 2)"), ("arr_extract", "i", lambda: lists.extract(c("m"), 1), "array_extract(m, 1)"), ("agg_min", "i", "array_min(m)", "list_aggregate(m, 'min')"), ("aggr_sum", "i", "aggregate(m, 0, (a, x) -> a + x)", "list_aggr(m, 'sum')"), ("apply_", "l", "transform(m, x -> x + 1)", "list_apply(m, lambda x: x + 1)"), ("arr_filter", "l", "filter(m, x -> x < 4)", "array_filter(m, lambda x: x < 4)"), ("arr_dist", "d", lambda: lists.distance(c("v"), c("w")), "array_distance(v::DOUBLE[3], w::DOUBLE[3])"),
    ("arr_cos", "d", lambda: lists.cosine(c("v"), c("w")), "array_cosine_similarity(v::DOUBLE[3], w::DOUBLE[3])"), ("arr_cosd", "d", lambda: 1 - lists.cosine(c("v"), c("w")), "array_cosine_distance(v::DOUBLE[3], w::DOUBLE[3])"), ("arr_dot", "d", lambda: lists.dot(c("v"), c("w")), "array_inner_product(v::DOUBLE[3], w::DOUBLE[3])"), ("arr_ndot", "d", lambda: -lists.dot(c("v"), c("w")), "array_negative_inner_product(v::DOUBLE[3], w::DOUBLE[3])"), ("comma", "s", "array_join(m, ',')", "array_to_string_comma_default(m)"), ("series_list", "l", "sequence(1, 4)", "generate_series(1, 4)"), ("repeat_list", "l", "flatten(array_repeat(m, 2))", "repeat(m, 2)"), ("comprehension", "l", "transform(filter(m, x -> x > 2), x -> x * 10)", "[x * 10 FOR x IN m IF x > 2]"),
])
family("fn_more_json", "events", "event_id", [
    ("kind", "s", lambda: lists.json_type(c("props")), "json_type(props)"), ("kind_k", "s", lambda: lists.json_type(c("props"), "$.k"), "json_type(props, '$.k')"), ("scalar", "s", lambda: lists.json_value(c("props"), "$.k"), "json_value(props, '$.k')"), ("scalar_none", "s", lambda: lists.json_value(F.lit('{"a":[1]}'), "$.a"), "json_value('{\"a\":[1]}', '$.a')"), ("path", "s", "get_json_object(props, '$.k')", "json_extract_path_text(props, 'k')"), ("row_json", "s", "to_json(named_struct('a', user_id))", "row_to_json({'a': user_id})"), ("list_json", "s", "to_json(array(user_id, 1L))", "array_to_json([user_id, 1])"), ("strict", "i", "from_json(props, 'k INT', map('mode', 'FAILFAST')).k", "from_json_strict(props, '{\"k\": \"INTEGER\"}').k"), ("pretty", "s", lambda: F.regexp_replace(lists.json_pretty(c("props")), r"\s", ""), "regexp_replace(json_pretty(props), '\\s', '', 'g')"),
])
family("fn_more_aggregates", "orders", "o_orderstatus", [
    ("arg_min_null_", "i", "min_by(o_orderkey, struct(o_totalprice, o_orderkey))", "arg_min_null(o_orderkey, o_totalprice)"), ("arg_max_null_", "i", "max_by(o_orderkey, struct(o_totalprice, o_orderkey))", "arg_max_null(o_orderkey, o_totalprice)"), ("mean_", "d", "round(mean(o_totalprice), 3)"), ("prod", "d", "exp(sum(ln(1 + (o_custkey % 3) / 1000000.0D)))", "product(1 + (o_custkey % 3) / 1000000.0)"), ("max_two", "s", "array_join(transform(slice(sort_array(collect_list(o_orderkey), false), 1, 2), x -> CAST(x AS STRING)), ',')", "array_to_string(max(o_orderkey, 2), ',')"), ("any_v", "b", "any_value(o_orderstatus) IS NOT NULL"), ("group_array", "s", "to_json(array_sort(collect_set(o_orderpriority)))", "to_json(list(DISTINCT o_orderpriority ORDER BY o_orderpriority))"),
    ("quant", "d", "percentile_disc(0.5) WITHIN GROUP (ORDER BY o_totalprice)", "quantile(o_totalprice, 0.5)"), ("var_s", "d", "round(var_samp(o_custkey), 3)"), ("sd_s", "d", "round(stddev_samp(o_custkey), 4)"), ("bin_lists", "l", "array_sort(collect_set(CAST(o_custkey % 4 AS INT)))", "list_sort(list(DISTINCT (o_custkey % 4)::INTEGER))"),
], group="o_orderstatus")
family("fn_more_dates", "events", "event_id", [
    ("datetrunc_", "t", "date_trunc('hour', ts)", "datetrunc('hour', ts)"), ("datesub_", "i", "timestampdiff(DAY, TIMESTAMP_NTZ '2023-12-01 00:00:00', ts)", "datesub('day', TIMESTAMP '2023-12-01 00:00:00', ts)"), ("datediff_month", "i", "(year(ts) - 2023) * 12 + month(ts) - 3", "datediff('month', TIMESTAMP '2023-03-01', ts)"), ("time_text", "s", "date_format(ts, 'HH:mm:ss')", "strftime(ts, '%H:%M:%S')"), ("make_time_", "s", "format_string('%02d:%02d:%02d', 4, 5, 6)", "make_time(4, 5, 6.0)"), ("micros", "t", "CAST(timestamp_micros(event_id * 1000000) AS TIMESTAMP_NTZ)", "make_timestamp(event_id * 1000000)"), ("from_ms", "t", "CAST(timestamp_millis(event_id * 1000) AS TIMESTAMP_NTZ)", "epoch_ms(event_id * 1000)"), ("to_micro", "t", "ts + make_interval(0, 0, 0, 0, 0, 0, 0.000009)", "ts + to_microseconds(9)"),
    ("doy", "i", "dayofyear(ts)", "date_part('dayofyear', ts)"), ("as_date", "D", "CAST(ts AS DATE)"), ("weekofyear_", "i", "weekofyear(ts)", "weekofyear(ts)"), ("dom", "i", "dayofmonth(ts)", "dayofmonth(ts)"), ("uuid_v", "i", lambda: text.uuid_version(F.lit("018f5b2c-7a3b-7c4d-8e5f-0123456789ab")), "uuid_extract_version('018f5b2c-7a3b-7c4d-8e5f-0123456789ab'::UUID)"), ("uuid_t", "t", lambda: text.uuid_timestamp(F.lit("018f5b2c-7a3b-7c4d-8e5f-0123456789ab")), "uuid_extract_timestamp('018f5b2c-7a3b-7c4d-8e5f-0123456789ab'::UUID) AT TIME ZONE 'UTC'"),
])


# the list sources differ in dialect
from lakeloom.plans import registry as _r  # noqa: E402

for _name, (_spark, _duck) in {"fn_list_basic": (L, LO), "fn_list_aggregates": (L, LO), "fn_more_lists": (L, LO), "fn_map_struct_enum": (M, MO)}.items():
    _r._oracles[_name] = _r._oracles[_name].replace(_spark, _duck)
