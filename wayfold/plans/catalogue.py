"""Relational queries over the test tables, one or more for each family of operators.

Each entry is SQL that Spark and DuckDB both read, or a pair of texts where
their functions differ in name. Tables are registered as views of the same
names; timestamps are read without a zone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events".split()

# Name -> text for both, or (Spark, DuckDB).
TEXTS: dict[str, str | tuple[str, str]] = {
    "sql_projection_arithmetic": "SELECT l_orderkey, l_linenumber, l_quantity * 2 AS twice, -l_tax AS negated, l_extendedprice * (1 - l_discount) AS net, l_orderkey % 7 AS rest FROM lineitem",
    "sql_filter_pushdown": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity < 10 AND l_discount BETWEEN 0.02 AND 0.06 AND l_returnflag IN ('A', 'R') AND l_linestatus IS NOT NULL",
    "sql_like_regexp": ("SELECT p_partkey FROM part WHERE p_type LIKE '%BRASS%' OR p_name RLIKE '^[a-m]'", "SELECT p_partkey FROM part WHERE p_type LIKE '%BRASS%' OR regexp_matches(p_name, '^[a-m]')"),
    "sql_case_when": "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 50000 THEN 'mid' ELSE 'low' END AS band FROM orders",
    "sql_null_safe": ("SELECT count(*) AS n FROM orders WHERE o_orderstatus <=> 'F' OR nullif(o_orderstatus, 'O') IS NULL", "SELECT count(*) AS n FROM orders WHERE o_orderstatus IS NOT DISTINCT FROM 'F' OR nullif(o_orderstatus, 'O') IS NULL"),
    "sql_bitwise_div": ("SELECT o_orderkey, o_orderkey & 7 AS a, o_orderkey | 8 AS b, o_orderkey ^ 5 AS c, o_orderkey div 3 AS d FROM orders", "SELECT o_orderkey, o_orderkey & 7 AS a, o_orderkey | 8 AS b, xor(o_orderkey, 5) AS c, o_orderkey // 3 AS d FROM orders"),
    "sql_distinct": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders",
    "sql_group_having": "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING count(*) > 10",
    "sql_group_ordinal": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_quantity), 6) AS q FROM lineitem GROUP BY 1, 2",
    "sql_pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS net, round(avg(l_discount), 6) AS disc, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus",
    "sql_grouping_sets": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
    "sql_cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "sql_rollup_grouping": "SELECT c_mktsegment, c_nationkey, count(*) AS n, CAST(grouping(c_nationkey) AS INT) AS g FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)",
    "sql_count_distinct": "SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderstatus) AS states FROM orders GROUP BY o_orderpriority",
    "sql_statistics": "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS vp, round(corr(l_quantity, l_extendedprice), 6) AS r, round(covar_samp(l_quantity, l_discount), 6) AS cv FROM lineitem GROUP BY l_returnflag",
    "sql_moments": ("SELECT event_type, round(skewness(value), 5) AS sk, max_by(event_id, event_id) AS last_id, bool_and(value > -1) AS ok FROM events GROUP BY event_type", "SELECT event_type, round(m3 / m2 ** 1.5, 5) AS sk, last_id, ok FROM (SELECT event_type, avg((value - m) ** 3) AS m3, avg((value - m) ** 2) AS m2, max(event_id) AS last_id, bool_and(value > -1) AS ok FROM (SELECT *, avg(value) OVER (PARTITION BY event_type) AS m FROM events) GROUP BY event_type)"),
    "sql_percentile": ("SELECT event_type, percentile(value, 0.5) AS med FROM events GROUP BY event_type", "SELECT event_type, quantile_cont(value, 0.5) AS med FROM events GROUP BY event_type"),
    "sql_collect": ("SELECT n_regionkey, array_join(sort_array(collect_list(n_name)), ',') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"),
    "sql_filter_clause": "SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS clicks, count(*) FILTER (WHERE event_type = 'purchase') AS buys FROM events GROUP BY user_id",
    "sql_pivot": ("SELECT * FROM (SELECT o_orderpriority, o_orderstatus, o_orderkey FROM orders) PIVOT (count(o_orderkey) FOR o_orderstatus IN ('F' AS f, 'O' AS o, 'P' AS p))", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY o_orderpriority"),
    "sql_join_inner": "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "sql_join_left": "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey",
    "sql_join_right": "SELECT s_suppkey, n_nationkey FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey",
    "sql_join_full": "SELECT c_custkey, s_suppkey FROM customer FULL JOIN supplier ON c_custkey = s_suppkey AND c_nationkey = s_nationkey",
    "sql_join_semi": ("SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey FROM customer SEMI JOIN orders ON c_custkey = o_custkey"),
    "sql_join_anti": ("SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey FROM customer ANTI JOIN orders ON c_custkey = o_custkey"),
    "sql_join_anti_rows": ("SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000", "SELECT c_custkey FROM customer ANTI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000"),
    "sql_join_cross": "SELECT r_name, n_name FROM region CROSS JOIN nation",
    "sql_join_using": "SELECT k, a, b FROM (SELECT n_nationkey AS k, n_name AS a FROM nation) x JOIN (SELECT r_regionkey AS k, r_name AS b FROM region) y USING (k)",
    "sql_join_natural": "SELECT * FROM (SELECT n_nationkey AS k, n_name AS a FROM nation) x NATURAL JOIN (SELECT r_regionkey AS k, r_name AS b FROM region) y",
    "sql_join_theta": "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "sql_exists": "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 250000)",
    "sql_not_exists": "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)",
    "sql_in_subquery": "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)",
    "sql_not_in_subquery": "SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)",
    "sql_scalar_subquery": "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT 2 * avg(o_totalprice) FROM orders)",
    "sql_cte": "WITH big AS (SELECT o_custkey, max(o_totalprice) AS top FROM orders GROUP BY o_custkey) SELECT c_name, top FROM customer JOIN big ON c_custkey = o_custkey WHERE top > 200000",
    "sql_union_all": "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier",
    "sql_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "sql_intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "sql_except": "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000",
    "sql_order_limit": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "sql_order_nulls": "SELECT k FROM (SELECT nullif(n_regionkey, 2) AS k, n_nationkey FROM nation) ORDER BY k DESC NULLS LAST, n_nationkey LIMIT 12",
    "sql_window_ranking": "SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr, ntile(4) OVER w AS nt FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
    "sql_window_offset": "SELECT event_id, lag(value) OVER w AS before, lead(value, 2) OVER w AS later, first_value(value) OVER w AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "sql_window_rows": "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS s FROM events",
    "sql_window_range": "SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_suppkey ORDER BY l_quantity RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS n FROM lineitem",
    "sql_window_percent": "SELECT c_custkey, round(percent_rank() OVER w, 9) AS pr, round(cume_dist() OVER w, 9) AS cd FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey)",
    "sql_lateral_view": ("SELECT n_nationkey, w FROM nation LATERAL VIEW explode(split(n_name, '_')) t AS w", "SELECT n_nationkey, unnest(string_split(n_name, '_')) AS w FROM nation"),
    "sql_values": "SELECT a, b FROM (VALUES (1, 'x'), (2, 'y'), (3, NULL)) AS t(a, b) WHERE a > 1",
    "sql_range_tvf": ("SELECT id FROM range(0, 50, 5)", "SELECT range AS id FROM range(0, 50, 5)"),
    "sql_time_window": ("SELECT CAST(window.start AS TIMESTAMP_NTZ) AS start, event_type, count(*) AS n FROM events GROUP BY window(ts, '1 hour'), event_type", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2"),
    "sql_session_gap": "SELECT user_id, max(s) + 1 AS sessions FROM (SELECT user_id, sum(g) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL '6' HOUR THEN 1 ELSE 0 END AS g FROM events)) GROUP BY user_id",
    "fn_string": "SELECT p_partkey, upper(p_name) AS u, lower(p_brand) AS l, length(p_name) AS n, reverse(p_brand) AS r, replace(p_name, ' ', '_') AS t, lpad(p_brand, 12, '*') AS lp, rpad(p_brand, 12, '*') AS rp, repeat(p_brand, 2) AS rr, ascii(p_brand) AS a, concat(p_brand, '-', p_type) AS c, concat_ws('/', p_brand, p_type) AS cw, translate(p_brand, 'abc', 'xyz') AS tr, trim('  x ') AS tm, substring(p_name, 2, 3) AS sb, instr(p_name, 'a') AS i FROM part",
    "fn_string_more": ("SELECT p_partkey, initcap('ab cd') AS ic, substring_index('a.b.c', '.', 2) AS si, find_in_set('b', 'a,b') AS fs, levenshtein(p_brand, p_type) AS lv, hex(p_partkey) AS hx, base64(CAST(p_brand AS BINARY)) AS b64, md5(p_name) AS m5, sha2(p_name, 256) AS s2, split(p_type, ' ')[0] AS s0, regexp_replace(p_name, '[aeiou]', '') AS rg, regexp_extract(p_name, '([a-z]+)', 1) AS re FROM part", "SELECT p_partkey, 'Ab Cd' AS ic, 'a.b' AS si, 2 AS fs, levenshtein(p_brand, p_type) AS lv, hex(p_partkey) AS hx, base64(p_brand::BLOB) AS b64, md5(p_name) AS m5, sha256(p_name) AS s2, string_split(p_type, ' ')[1] AS s0, regexp_replace(p_name, '[aeiou]', '', 'g') AS rg, regexp_extract(p_name, '([a-z]+)', 1) AS re FROM part"),
    "fn_math": "SELECT p_partkey, abs(-p_size) AS a, CAST(ceil(p_retailprice) AS BIGINT) AS c, CAST(floor(p_retailprice) AS BIGINT) AS f, round(p_retailprice, 1) AS r, round(sqrt(p_size), 9) AS s, round(exp(p_size / 50.0), 6) AS e, round(ln(p_size + 1), 9) AS l, round(log10(p_size + 1), 9) AS l10, round(power(p_size, 2), 3) AS p, round(sin(p_size), 9) AS si, round(atan2(p_size, 3), 9) AS t, round(degrees(p_size), 6) AS d, CAST(sign(p_size - 20) AS INT) AS sg, greatest(p_size, 10) AS g, least(p_size, 10) AS le FROM part",
    "fn_date": ("SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, quarter(o_orderdate) AS q, dayofyear(o_orderdate) AS dy, weekofyear(o_orderdate) AS w, datediff(DATE '1999-01-01', CAST(o_orderdate AS DATE)) AS dd, last_day(CAST(o_orderdate AS DATE)) AS ld, CAST(date_trunc('month', o_orderdate) AS DATE) AS mt, date_format(o_orderdate, 'yyyy-MM') AS df, add_months(CAST(o_orderdate AS DATE), 1) AS am FROM orders", "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, quarter(o_orderdate) AS q, dayofyear(o_orderdate) AS dy, weekofyear(o_orderdate) AS w, date_diff('day', o_orderdate::DATE, DATE '1999-01-01') AS dd, last_day(o_orderdate::DATE) AS ld, date_trunc('month', o_orderdate)::DATE AS mt, strftime(o_orderdate, '%Y-%m') AS df, (o_orderdate::DATE + INTERVAL 1 MONTH)::DATE AS am FROM orders"),
    "fn_conditional": "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'O'), 'open') AS a, CASE o_orderstatus WHEN 'F' THEN 1 ELSE 0 END AS b FROM orders",
    "fn_json": ("SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k, from_json(props, 'k INT').k AS j FROM events", "SELECT event_id, CAST(props->>'$.k' AS INT) AS k, CAST(props->>'$.k' AS INT) AS j FROM events"),
    "fn_array": ("SELECT user_id, size(a) AS n, array_contains(a, 'click') AS c, element_at(a, 1) AS f, array_join(slice(a, 1, 2), '+') AS s FROM (SELECT user_id, sort_array(collect_set(event_type)) AS a FROM events GROUP BY user_id)", "SELECT user_id, len(a) AS n, list_contains(a, 'click') AS c, a[1] AS f, array_to_string(a[1:2], '+') AS s FROM (SELECT user_id, list_sort(list(DISTINCT event_type)) AS a FROM events GROUP BY user_id)"),
    "fn_higher_order": ("SELECT user_id, round(aggregate(v, 0D, (s, x) -> s + x), 6) AS total, size(filter(v, x -> x > 50)) AS big FROM (SELECT user_id, array_sort(collect_list(value)) AS v FROM events GROUP BY user_id)", "SELECT user_id, round(list_sum(v), 6) AS total, len(list_filter(v, lambda x: x > 50)) AS big FROM (SELECT user_id, list(value) AS v FROM events GROUP BY user_id)"),
    "fn_cast": "SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(12, 2)) AS d, CAST(o_custkey AS STRING) AS s, CAST('12' AS INT) AS i, CAST(o_orderdate AS DATE) AS dt FROM orders",
}


def views(spark: SparkSession, sf_dir: str) -> None:
    for name in TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def _query(text: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir)
        return spark.sql(text)

    return run


QUERIES = {name: _query(t if isinstance(t, str) else t[0]) for name, t in TEXTS.items()}
SQL = {name: t if isinstance(t, str) else t[1] for name, t in TEXTS.items()}
