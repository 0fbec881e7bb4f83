"""Texts in the dialect that run unchanged: the oracle gets the same text."""

from __future__ import annotations

from lakeloom import dialect
from lakeloom.plans import registry
from lakeloom.session import views

TEXTS = {
    "from_first": "FROM nation SELECT n_name, n_regionkey WHERE n_nationkey < 10",
    "exclude": "SELECT * EXCLUDE (o_orderdate, o_totalprice) FROM orders WHERE o_orderstatus = 'P'",
    "qualify": "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2",
    "distinct_on": "SELECT DISTINCT ON (user_id) user_id, event_id FROM events ORDER BY user_id, event_id DESC",
    "int_division": "SELECT c_custkey // 7 AS a, c_custkey % 7 AS b, log(c_custkey + 1)::DECIMAL(10,4) AS c FROM customer",
    "list_literals": "SELECT event_id, [user_id, event_id][2] AS a, [user_id, event_id][-2] AS b, [event_id][0] AS c FROM events",
    "list_comprehension": "SELECT event_id, array_to_string([x * 2 FOR x IN [user_id, event_id, 3] IF x > 2], ',') AS s FROM events",
    "lambda_functions": "SELECT event_id, array_to_string(list_filter(list_transform([user_id, 5], lambda x: x + 1), lambda x: x > 3), ';') AS s FROM events",
    "struct_literals": "SELECT n_nationkey, {'a': n_name, 'b': n_regionkey}.b AS b FROM nation",
    "semi_join": "SELECT c_custkey FROM customer SEMI JOIN orders ON c_custkey = o_custkey",
    "anti_join": "SELECT c_custkey FROM customer ANTI JOIN orders ON c_custkey = o_custkey",
    "union_by_name": "SELECT r_name AS name FROM region UNION ALL BY NAME SELECT n_name AS name, n_nationkey AS k FROM nation",
    "subquery_from_first": "SELECT count(*) AS n FROM (FROM orders SELECT o_orderkey WHERE o_totalprice > 100000) t",
    "concat_nulls": "SELECT c_custkey, concat(c_name, NULL, '!') AS a, starts_with(c_name, 'Cust') AS b, c_name ^@ 'X' AS c FROM customer",
    "types": "SELECT p_partkey::VARCHAR AS a, CAST(p_size AS HUGEINT)::BIGINT AS b, TRY_CAST(p_name AS INTEGER) AS c FROM part",
    "regexp_global": "SELECT p_partkey, regexp_replace(p_name, '[aeiou]', '_', 'g') AS r, string_split(p_name, ' ')[1] AS s FROM part",
    "installed_functions": "SELECT c_custkey, even(c_acctbal) AS e, hamming('abc', 'abd') AS h, sha256(c_name) AS s, list_sum([1.0::DOUBLE, 2.5::DOUBLE]) AS t FROM customer",
    "arg_max": "SELECT o_orderstatus, arg_max(o_orderkey, o_totalprice * 1000000 + o_orderkey) AS k, count(*) FILTER (WHERE o_totalprice > 1000) AS n FROM orders GROUP BY ALL",
    "regexp_first": "SELECT p_partkey, regexp_replace(p_name, '[aeiou]', '_') AS a, regexp_replace(p_name, '([a-z])([0-9])', '\\2\\1') AS b FROM part",
    "json_text": "SELECT event_id, json_extract(props, '$.k') AS a, json_extract('{\"a\":\"' || event_type || '\"}', '/a') AS b, props->>'k' AS c, json_extract_string('{\"a\":\"' || event_type || '\"}', '$.a') AS d FROM events",
    "slices": "SELECT event_id, array_to_string([user_id, event_id, 3, 4][:-2], ',') AS a, array_to_string([user_id, event_id, 3][-2:], ',') AS b, array_to_string(list_slice([user_id, event_id, 3, 4], 1, 4, 2), ',') AS c FROM events",
    "list_nulls": "SELECT n_regionkey, len(list(CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey END)) AS a, array_to_string(list_concat([n_regionkey], NULL), ',') AS b, array_to_string(concat([n_regionkey], [7]), ',') AS c FROM nation GROUP BY n_regionkey",
    "ordered_aggregates": "SELECT n_regionkey, string_agg(n_name, ';' ORDER BY n_nationkey DESC) AS a, array_to_string(list(n_nationkey ORDER BY n_name DESC), ',') AS b, first(n_name ORDER BY n_nationkey DESC) AS c FROM nation GROUP BY ALL",
    "statistics": "SELECT o_orderstatus, round(kurtosis(o_totalprice), 4) AS a, round(kurtosis_pop(o_totalprice), 4) AS b, round(skewness(o_totalprice), 4) AS c, round(sem(o_totalprice), 4) AS d, round(geomean(o_totalprice), 4) AS e, round(weighted_avg(o_totalprice, o_custkey), 4) AS f FROM orders GROUP BY ALL",
    "quantiles": "SELECT n_regionkey, quantile_disc(n_nationkey, 0.3) AS a, quantile(n_nationkey, 0.5) AS b, quantile_cont(n_nationkey, 0.25) AS c, median(n_nationkey) AS d FROM nation GROUP BY ALL",
    "date_formats": "SELECT o_orderkey, strftime(o_orderdate, '%Y/%m/%d') AS a, strptime('2024-03-05', '%Y-%m-%d') AS b, date_trunc('month', o_orderdate) AS c, date_part('year', o_orderdate) AS d, week(o_orderdate) AS e, epoch_ms(o_orderdate) AS f FROM orders",
    "date_differences": "SELECT o_orderkey, date_diff('day', o_orderdate, TIMESTAMP '1999-01-01 00:00:00') AS a, date_diff('month', o_orderdate, TIMESTAMP '1999-01-01 00:00:00') AS b, date_diff('year', o_orderdate, TIMESTAMP '1999-01-01 00:00:00') AS c, o_orderdate + to_days(3) AS d FROM orders",
    "list_functions": "SELECT event_id, list_position([user_id, event_id], event_id) AS a, list_extract([user_id, event_id], -1) AS b, list_unique([user_id, event_id, user_id]) AS c, list_has_all([user_id, event_id], [event_id]) AS d, array_to_string(list_reverse_sort([user_id, event_id]), ',') AS e, array_to_string(list_sort([user_id, event_id], 'DESC'), ',') AS f, array_to_string(list_grade_up([user_id, event_id]), ',') AS g, array_to_string(list_resize([user_id], 3, 0), ',') AS h FROM events",
    "list_aggregates": "SELECT event_id, list_aggregate([user_id, event_id], 'sum')::DOUBLE AS a, list_reduce([user_id, event_id, 4], lambda x, y: x + y) AS b, list_median([user_id, event_id, 3]) AS c, round(list_stddev_samp([user_id, event_id, 3]), 4) AS d, round(list_skewness([user_id, event_id, 3, 9]), 4) AS e, list_bit_xor([user_id, event_id]) AS f, list_any_value([NULL, event_id]) AS g FROM events",
    "vectors": "SELECT event_id, round(list_cosine_similarity([user_id + 1.0, 2.0], [event_id + 1.0, 1.0]), 6) AS a, round(list_distance([user_id + 1.0, 2.0], [event_id + 1.0, 1.0]), 6) AS b, round(list_negative_inner_product([user_id + 1.0, 2.0], [event_id + 1.0, 1.0]), 6) AS c FROM events",
    "text_functions": "SELECT c_custkey, format('{} of {}', c_name, c_mktsegment) AS a, printf('%d-%s', c_custkey, c_name) AS b, damerau_levenshtein(c_name, c_mktsegment) AS c, round(jaro_winkler_similarity(c_name, c_mktsegment), 6) AS d, regexp_extract(c_name, '([A-Za-z]+)', 1) AS e, to_base(c_custkey, 16) AS f, like_escape(c_name, 'C%', '$') AS g FROM customer",
    "maps": "SELECT n_nationkey, map_contains_value(MAP {'a': n_regionkey}, 1) AS a, map_contains_entry(MAP {'a': n_regionkey}, 'a', 2) AS b, struct_extract({'x': n_name}, 'x') AS c, array_to_string(map_extract(MAP {'a': n_regionkey}, 'a'), ',') AS d FROM nation",
    "method_calls": "SELECT n_nationkey, n_name.lower().replace('nation', 'x') AS a, [n_nationkey, 2].list_sum()::DOUBLE AS b FROM nation",
    "series": "SELECT x, x * 2 AS y FROM generate_series(1, 100, 3) t(x)",
    "filtered_window": "SELECT n_nationkey, sum(n_nationkey) FILTER (WHERE n_nationkey > 3) OVER (PARTITION BY n_regionkey) AS s, count(*) FILTER (WHERE n_nationkey > 9) OVER (PARTITION BY n_regionkey) AS k FROM nation",
    "groups_frame": "SELECT o_orderkey, sum(o_orderkey) OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS s FROM orders",
    "star_replace": "SELECT * REPLACE (c_acctbal * 2 AS c_acctbal) RENAME (c_name AS name) FROM customer",
    "columns": "SELECT COLUMNS('n_.*key') FROM nation",
    "pivot": "PIVOT (SELECT o_orderstatus, o_orderpriority, o_orderkey FROM orders) ON o_orderstatus USING max(o_orderkey) GROUP BY o_orderpriority",
    "pivot_in": "PIVOT (SELECT o_orderstatus, o_orderpriority, o_orderkey FROM orders) ON o_orderstatus IN ('F', 'O') USING max(o_orderkey) AS m, count(*) AS n GROUP BY o_orderpriority",
    "unpivot": "UNPIVOT (SELECT n_name, n_nationkey, n_regionkey FROM nation) ON n_nationkey, n_regionkey INTO NAME k VALUE v",
    "asof_join": "SELECT e.event_id, p.event_id AS before FROM events e ASOF JOIN (SELECT * FROM events WHERE event_type = 'error') p ON e.user_id = p.user_id AND e.ts >= p.ts",
    "asof_left_using": "SELECT e.event_id, p.v FROM events e ASOF LEFT JOIN (SELECT user_id, ts, value AS v FROM events WHERE event_type = 'error') p USING (user_id, ts)",
    "positional_join": "SELECT r_name, n_name FROM (SELECT r_name FROM region ORDER BY r_regionkey) r POSITIONAL JOIN (SELECT n_name FROM nation ORDER BY n_nationkey) n",
}

for _name, _text in TEXTS.items():

    def run(spark, sf_dir, text=_text):
        dialect.install(spark)
        views(spark, sf_dir, text)
        return dialect.run(spark, text)

    registry._queries[f"dialect_{_name}"], registry._oracles[f"dialect_{_name}"] = run, _text
