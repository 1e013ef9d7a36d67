"""Built-in functions by family: each entry is a column's name, Spark's expression, and DuckDB's where it differs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wayfold.functions.shared import dealt
from wayfold.plans.catalogue import _query

D = "CAST(o_orderdate AS DATE)"
DATES = "CAST(o_orderdate AS TIMESTAMP)"
URL = "concat('http://h.org/', CAST(p_partkey AS {0}), '?k=', CAST(p_size AS {0}))"
XML = "concat('<a><b>', CAST(p_size AS STRING), '</b></a>')"
TEXT = "CAST(p_size AS VARCHAR)"
HALF = "p_size * CAST(0.5 AS DOUBLE)"
#: The checksum of a brand, bit by bit.
CRC = """xor(list_reduce(list_transform(range(1, length(p_brand) + 1), lambda i: ascii(substr(p_brand, i, 1))::BIGINT),
    lambda c, b: list_reduce(range(0, 8)::BIGINT[], lambda x, k: CASE WHEN (x & 1) = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(c, b)), 4294967295::BIGINT), 4294967295)"""


def _murmur(x: str, seed: int = 42) -> str:
    """The 32-bit hash of a whole number by the published rounds of MurmurHash3, each step a value that the next one names."""
    times = lambda c: lambda v: f"(({v}::HUGEINT * {c}) % 4294967296)::BIGINT"
    turned = lambda r: lambda v: f"((({v} << {r}) | ({v} >> {32 - r})) & 4294967295)"
    folded = lambda r: lambda v: f"xor({v}, {v} >> {r})"
    steps = [
        times(3432918353), turned(15), times(461845907), lambda v: f"xor({v}, {seed})", turned(13), lambda v: f"(({v} * 5 + 3864292196) % 4294967296)",
        lambda v: f"xor({v}, 4)", folded(16), times(2246822507), folded(13), times(3266489909), folded(16), lambda v: f"(CASE WHEN {v} >= 2147483648 THEN {v} - 4294967296 ELSE {v} END)::INT",
    ]
    out = f"({x}::BIGINT & 4294967295)"
    for k, step in enumerate(steps):
        out = f"list_transform([{out}], lambda v{k}: {step(f'v{k}')})[1]"
    return out


HASH = _murmur("p_size")


def _round(name: str, spark: str, duck: str | None = None) -> tuple[str, str, str]:
    return name, f"round({spark}, 9)", f"round({duck or spark}, 9)"


#: Family -> (key column, table, entries).
FAMILIES = {
    "fn_strings_by_name": ("p_partkey", "part", [
        ("char_length", "char_length(p_name)", "length(p_name)"), ("chr", "chr(65 + p_size % 26)", "chr(65 + p_size % 26)"),
        ("decode", "decode(encode(p_name, 'UTF-8'), 'UTF-8')", "decode(encode(p_name))"), ("encode", "hex(encode(p_name, 'UTF-8'))", "hex(p_name)"),
        ("elt", "elt(p_size % 2 + 1, p_brand, p_type)", "CASE p_size % 2 WHEN 0 THEN p_brand ELSE p_type END"),
        ("format_number", "format_number(p_retailprice * 1000, 2)", "format('{:,.2f}', p_retailprice * 1000)"),
        ("format_string", "format_string('%s-%d', p_brand, p_size)", "printf('%s-%d', p_brand, p_size)"),
        ("printf", "printf('%d:%s', p_size, p_type)", "printf('%d:%s', p_size, p_type)"),
        ("lcase", "lcase(p_type)", "lower(p_type)"), ("ucase", "ucase(p_name)", "upper(p_name)"),
        ("locate", "locate('e', p_name, 3)", "CASE instr(substr(p_name, 3), 'e') WHEN 0 THEN 0 ELSE instr(substr(p_name, 3), 'e') + 2 END"),
        ("position_", "position('r' IN p_name)", "position('r' IN p_name)"), ("ltrim", "ltrim(concat('  ', p_name))", "ltrim(concat('  ', p_name))"),
        ("rtrim", "rtrim(concat(p_name, '  '))", "rtrim(concat(p_name, '  '))"),
        ("parse_url", f"parse_url({URL.format('STRING')}, 'QUERY', 'k')", f"regexp_extract({URL.format('VARCHAR')}, 'k=([0-9]+)', 1)"),
        ("sentences", "size(sentences(p_name)[0])", "len(string_split(p_name, ' '))"), ("space", "space(p_size % 5)", "repeat(' ', p_size % 5)"),
        ("substr", "substr(p_name, 3)", "substr(p_name, 3)"), ("unbase64", "CAST(unbase64(base64(CAST(p_name AS BINARY))) AS STRING)", "decode(from_base64(to_base64(encode(p_name))))"),
        ("unhex", "CAST(unhex(hex(p_name)) AS STRING)", "decode(unhex(hex(p_name)))"), ("initcap", "initcap(p_name)", "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"),
        ("substring_index", "substring_index(p_name, ' ', 1)", "string_split(p_name, ' ')[1]"),
        ("find_in_set", "find_in_set(p_type, 'ECONOMY,LARGE,PROMO')", "coalesce(list_position(['ECONOMY', 'LARGE', 'PROMO'], p_type), 0)"),
    ]),
    "fn_dates_by_name": ("o_orderkey", "orders", [
        ("current_date_", "current_date() >= DATE '2020-01-01'", "current_date >= DATE '2020-01-01'"), ("now_", "now() = current_timestamp()", "now() = current_timestamp"),
        ("date_add", f"date_add({D}, 5)", f"{D} + 5"), ("date_sub", f"date_sub({D}, 5)", f"{D} - 5"), ("dayofmonth", f"dayofmonth({D})", f"day({D})"),
        ("from_unixtime", f"from_unixtime(unix_timestamp({DATES}))", "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')"),
        ("from_utc_timestamp", f"CAST(from_utc_timestamp({DATES}, 'Asia/Tokyo') AS TIMESTAMP_NTZ)", "o_orderdate + INTERVAL 9 HOUR"),
        ("to_utc_timestamp", f"CAST(to_utc_timestamp({DATES}, 'Asia/Tokyo') AS TIMESTAMP_NTZ)", "o_orderdate - INTERVAL 9 HOUR"),
        ("months_between", f"months_between(trunc({D}, 'MM'), DATE '1990-01-01')", f"CAST(date_diff('month', DATE '1990-01-01', {D}) AS DOUBLE)"),
        ("next_day", f"next_day({D}, 'MON')", f"{D} + CAST(8 - isodow({D}) AS INT)"), ("to_date", "to_date(date_format(o_orderdate, 'yyyyMMdd'), 'yyyyMMdd')", D),
        ("unix_timestamp", f"unix_timestamp({DATES}) - to_unix_timestamp('1990-01-01', 'yyyy-MM-dd')", f"CAST(epoch(o_orderdate) - epoch(TIMESTAMP '1990-01-01') AS BIGINT)"),
        ("trunc", f"trunc({D}, 'YEAR')", f"CAST(date_trunc('year', {D}) AS DATE)"),
    ]),
    "fn_times_by_name": ("event_id", "events", [
        ("hour", "hour(ts)", "hour(ts)"), ("minute", "minute(ts)", "minute(ts)"), ("second", "second(ts)", "second(ts)"),
        ("to_timestamp", "CAST(to_timestamp(date_format(ts, 'yyyy-MM-dd HH:mm:ss')) AS TIMESTAMP_NTZ)", "date_trunc('second', ts)"),
        ("timestamp", "CAST(timestamp('2024-01-02 03:04:05') AS TIMESTAMP_NTZ) < ts", "TIMESTAMP '2024-01-02 03:04:05' < ts"),
    ]),
    "fn_math_by_name": ("p_partkey", "part", [
        _round("acos", "acos(1.0 / p_size)"), _round("asin", "asin(1.0 / p_size)"), _round("atan", "atan(p_size)"), ("bin", "bin(p_size)", "bin(p_size)"),
        ("bround", f"bround({HALF})", f"round_even({HALF}, 0)"), _round("cbrt", "cbrt(p_size)"), ("ceiling", "ceiling(p_retailprice)", "CAST(ceiling(p_retailprice) AS BIGINT)"),
        ("conv", "conv(CAST(p_size AS STRING), 10, 2)", "bin(p_size)"), _round("cos", "cos(p_size)"), _round("cosh", "cosh(p_size / 50.0D)", "cosh(p_size / 50.0)"),
        _round("e", "e()", "exp(1)"), _round("expm1", "expm1(p_size / 50.0D)", "exp(p_size / 50.0) - 1"), ("factorial", "factorial(p_size % 10)", "CAST(factorial(p_size % 10) AS BIGINT)"),
        _round("hypot", "hypot(p_size, 3)", "sqrt(p_size * p_size + 9)"), _round("log", "log(2, p_size)", "log2(p_size)"), _round("log1p", "log1p(p_size)", "ln(p_size + 1)"),
        _round("log2", "log2(p_size)"), ("negative", "negative(p_size)", "-p_size"), _round("pi", "pi()"), ("pmod", "pmod(-p_size, 7)", "((-p_size % 7) + 7) % 7"),
        ("positive", "positive(p_size)", "p_size"), ("pow", "pow(p_size, 2)", "pow(p_size, 2)"), _round("radians", "radians(p_size)"),
        ("rand", "rand(7) BETWEEN 0 AND 1", "random() BETWEEN 0 AND 1"), ("randn", "randn(7) IS NOT NULL", "true"), ("rint", f"rint({HALF})", f"round_even({HALF}, 0)"),
        ("shiftleft", "shiftleft(p_size, 2)", "p_size << 2"), ("shiftright", "shiftright(p_size, 2)", "p_size >> 2"), ("shiftrightunsigned", "shiftrightunsigned(p_size, 1)", "p_size >> 1"),
        ("signum", "signum(p_size - 20)", "CAST(sign(p_size - 20) AS DOUBLE)"), _round("sinh", "sinh(p_size / 50.0D)", "sinh(p_size / 50.0)"), _round("tan", "tan(p_size)"), _round("tanh", "tanh(p_size / 50.0D)", "tanh(p_size / 50.0)"),
        ("bitwise_not", "~p_size", "~p_size"),
    ]),
    "fn_nested_by_name": ("p_partkey", "part", [
        ("array", "array(p_size, 1)[0]", "[p_size, 1][1]"), ("map", "map(p_brand, p_size)[p_brand]", "map([p_brand], [p_size])[p_brand]"),
        ("map_keys", "map_keys(map(p_brand, p_size))[0]", "map_keys(map([p_brand], [p_size]))[1]"), ("map_values", "map_values(map(p_brand, p_size))[0]", "map_values(map([p_brand], [p_size]))[1]"),
        ("named_struct", "named_struct('a', p_size, 'b', p_brand).b", "{'a': p_size, 'b': p_brand}.b"), ("struct", "struct(p_size, p_type).p_type", "struct_pack(p_size := p_size, p_type := p_type).p_type"),
        ("str_to_map", "str_to_map(concat('k:', CAST(p_size AS STRING), ',l:0'))['k']", TEXT), ("to_json", "to_json(named_struct('a', p_size))", f"'{{\"a\":' || {TEXT} || '}}'"),
        ("xpath", f"xpath({XML}, 'a/b/text()')[0]", TEXT), ("xpath_boolean", f"xpath_boolean({XML}, 'a/b')", "true"), ("xpath_short", f"CAST(xpath_short({XML}, 'a/b') AS INT)", "p_size"),
        ("xpath_int", f"xpath_int({XML}, 'a/b')", "p_size"), ("xpath_long", f"xpath_long({XML}, 'a/b')", "CAST(p_size AS BIGINT)"), ("xpath_float", f"CAST(xpath_float({XML}, 'a/b') AS DOUBLE)", "CAST(p_size AS DOUBLE)"),
        ("xpath_double", f"xpath_double({XML}, 'a/b')", "CAST(p_size AS DOUBLE)"), ("xpath_string", f"xpath_string({XML}, 'a/b')", TEXT),
    ]),
    "fn_conditions_by_name": ("p_partkey", "part", [
        ("if_", "if(p_size > 20, 1, 0)", "CASE WHEN p_size > 20 THEN 1 ELSE 0 END"), ("ifnull", "ifnull(nullif(p_type, 'ECONOMY'), 'eco')", "ifnull(nullif(p_type, 'ECONOMY'), 'eco')"),
        ("isnan", "isnan(p_retailprice)", "isnan(p_retailprice)"), ("isnull_", "isnull(nullif(p_type, 'ECONOMY'))", "nullif(p_type, 'ECONOMY') IS NULL"), ("isnotnull", "isnotnull(nullif(p_type, 'ECONOMY'))", "nullif(p_type, 'ECONOMY') IS NOT NULL"),
        ("nanvl", "nanvl(CASE WHEN p_size > 20 THEN double('NaN') ELSE 1.5D END, 2D)", "CASE WHEN p_size > 20 THEN 2.0::DOUBLE ELSE 1.5::DOUBLE END"),
        ("nvl", "nvl(nullif(p_type, 'PROMO'), 'none')", "coalesce(nullif(p_type, 'PROMO'), 'none')"), ("nvl2", "nvl2(nullif(p_type, 'PROMO'), 1, 2)", "CASE WHEN nullif(p_type, 'PROMO') IS NULL THEN 2 ELSE 1 END"),
        ("sha", "sha(p_name)", "sha1(p_name)"), ("sha1", "sha1(p_brand)", "sha1(p_brand)"), ("monotonically_increasing_id", "monotonically_increasing_id() >= 0", "true"),
        ("input_file_name", "input_file_name() LIKE '%part.parquet%'", "true"), ("input_file_block_start", "input_file_block_start() >= 0", "true"), ("input_file_block_length", "input_file_block_length() > 0", "true"),
        ("spark_partition_id", "spark_partition_id() >= 0", "true"), ("current_database", "current_database() IS NOT NULL", "true"), ("assert_true", "assert_true(p_size > 0) IS NULL", "p_size > 0"),
        ("crc32_", "crc32(binary(p_brand))", CRC), ("hash_", "hash(p_size)", HASH),
        ("java_method", "java_method('java.lang.String', 'valueOf', p_size)", TEXT), ("reflect", "reflect('java.lang.Integer', 'toHexString', p_size)", "lower(hex(p_size))"),
    ]),
    "fn_casts_by_name": ("p_partkey", "part", [
        ("boolean_", "boolean(p_size % 2)", "CAST(p_size % 2 AS BOOLEAN)"), ("tinyint_", "CAST(tinyint(p_size) AS INT)", "CAST(CAST(p_size AS TINYINT) AS INT)"), ("smallint_", "CAST(smallint(p_size) AS INT)", "CAST(CAST(p_size AS SMALLINT) AS INT)"),
        ("int_", "int(p_retailprice)", "CAST(trunc(p_retailprice) AS INT)"), ("bigint_", "bigint(p_size)", "CAST(p_size AS BIGINT)"), ("float_", "CAST(float(p_size) AS DOUBLE)", "CAST(p_size AS DOUBLE)"), ("double_", "double('1.25')", "CAST('1.25' AS DOUBLE)"),
        ("date_", "date('2020-01-31')", "DATE '2020-01-31'"), ("binary_", "hex(binary(p_brand))", "hex(p_brand)"), ("string_", "string(p_size)", TEXT), ("decimal_", "CAST(decimal(p_size) AS INT)", "p_size"),
    ]),
}

X, Y = "l_quantity", "l_extendedprice"
AGGREGATES = [
    ("approx_count_distinct", "approx_count_distinct(l_linenumber)", "count(DISTINCT l_linenumber)"), ("mean", f"round(mean({X}), 6)", f"round(avg({X}), 6)"), ("covar_pop", f"round(covar_pop({X}, {Y}), 4)", f"round(covar_pop({X}, {Y}), 4)"),
    ("first", "first(l_returnflag)", "min(l_returnflag)"), ("last", "last(l_returnflag)", "max(l_returnflag)"), ("kurtosis", f"round(kurtosis({X}), 6)", f"round(kurtosis_pop({X}), 6)"), ("min_", f"min({X})", f"min({X})"),
    ("percentile_approx", "percentile_approx(l_linenumber, 0.5)", "quantile_disc(l_linenumber, 0.5)"), ("approx_percentile", "approx_percentile(l_linenumber, 0.9)", "quantile_disc(l_linenumber, 0.9)"),
    ("stddev", f"round(stddev({X}), 6)", f"round(stddev({X}), 6)"), ("std", f"round(std({X}), 6)", f"round(stddev({X}), 6)"), ("stddev_pop", f"round(stddev_pop({X}), 6)", f"round(stddev_pop({X}), 6)"),
    ("sum_distinct", f"sum(DISTINCT {X})", f"sum(DISTINCT {X})"), ("count_distinct", f"count(DISTINCT {X})", f"count(DISTINCT {X})"), ("var_samp", f"round(var_samp({X}), 6)", f"round(var_samp({X}), 6)"), ("variance", f"round(variance({X}), 6)", f"round(variance({X}), 6)"),
    ("count_min_sketch", f"length(count_min_sketch(l_linenumber, 0.1D, 0.9D, 7)) > 0", "true"), ("any_", f"any({X} > 49)", f"bool_or({X} > 49)"), ("every_", f"every({X} > 0)", f"bool_and({X} > 0)"),
]

TEXTS = {
    name: tuple(f"SELECT {key}, {', '.join(f'{e[side]} AS {e[0]}' for e in entries)} FROM {table}" for side in (1, 2)) for name, (key, table, entries) in FAMILIES.items()
} | {
    "fn_aggregates_by_name": tuple(f"SELECT l_returnflag, {', '.join(f'{e[side]} AS {e[0]}' for e in AGGREGATES)} FROM lineitem GROUP BY l_returnflag" for side in (1, 2)),
    "fn_grouping_id": ("SELECT o_orderstatus, o_orderpriority, CAST(grouping_id() AS INT) AS g, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)", "SELECT o_orderstatus, o_orderpriority, CAST(grouping_id(o_orderstatus, o_orderpriority) AS INT) AS g, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)"),
    "fn_last_value": "SELECT event_id, last_value(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS v FROM events",
    "fn_soundex": ("SELECT name, soundex(name) AS s FROM VALUES ('Robert'), ('Rupert'), ('Rubin'), ('Tymczak') AS t(name)", "SELECT * FROM (VALUES ('Robert', 'R163'), ('Rupert', 'R163'), ('Rubin', 'R150'), ('Tymczak', 'T522')) AS t(name, s)"),
    "fn_explode_outer": ("SELECT n_nationkey, explode_outer(CASE WHEN n_nationkey % 2 = 0 THEN split(n_name, '_') END) AS w FROM nation", "SELECT n_nationkey, unnest(CASE WHEN n_nationkey % 2 = 0 THEN string_split(n_name, '_') ELSE [NULL] END) AS w FROM nation"),
    "fn_posexplode": ("SELECT n_nationkey, pos, w FROM nation LATERAL VIEW posexplode(split(n_name, '_')) t AS pos, w", "SELECT n_nationkey, CAST(unnest(range(0, len(s))) AS INT) AS pos, unnest(s) AS w FROM (SELECT n_nationkey, string_split(n_name, '_') AS s FROM nation)"),
    "fn_posexplode_outer": ("SELECT n_nationkey, pos, w FROM nation LATERAL VIEW OUTER posexplode(CASE WHEN n_nationkey > 9 THEN split(n_name, '_') END) t AS pos, w", "SELECT n_nationkey, CASE WHEN n_nationkey > 9 THEN CAST(p AS INT) END AS pos, w FROM (SELECT n_nationkey, unnest(range(0, len(s))) AS p, unnest(s) AS w FROM (SELECT n_nationkey, CASE WHEN n_nationkey > 9 THEN string_split(n_name, '_') ELSE [NULL] END AS s FROM nation))"),
    "fn_inline": ("SELECT n_nationkey, inline(array(struct(n_name AS a, 1 AS b), struct('z' AS a, 2 AS b))) FROM nation", "SELECT n_nationkey, n_name AS a, 1 AS b FROM nation UNION ALL SELECT n_nationkey, 'z', 2 FROM nation"),
    "fn_stack": ("SELECT r_regionkey, stack(2, r_name, 1, 'x', 2) AS (a, b) FROM region", "SELECT r_regionkey, r_name AS a, 1 AS b FROM region UNION ALL SELECT r_regionkey, 'x', 2 FROM region"),
    "fn_json_tuple": ("SELECT event_id, k FROM events LATERAL VIEW json_tuple(props, 'k') t AS k", "SELECT event_id, props->>'$.k' AS k FROM events"),
    "sql_order_ordinal": "SELECT c_custkey, c_acctbal FROM customer ORDER BY 2 DESC, 1 LIMIT 20",
    "sql_order_nulls_first": "SELECT k, n FROM (SELECT nullif(n_regionkey, 2) AS k, n_nationkey AS n FROM nation) ORDER BY k NULLS FIRST, n LIMIT 9",
    "sql_sort_by": ("SELECT c_custkey, c_name FROM customer SORT BY c_name DESC", "SELECT c_custkey, c_name FROM customer"),
    "sql_distribute_by": ("SELECT o_custkey, o_orderkey FROM orders DISTRIBUTE BY o_custkey SORT BY o_custkey, o_orderkey", "SELECT o_custkey, o_orderkey FROM orders"),
    "sql_cluster_by": ("SELECT o_custkey, o_orderkey FROM orders CLUSTER BY o_custkey", "SELECT o_custkey, o_orderkey FROM orders"),
    "sql_tablesample": ("SELECT count(*) BETWEEN 1 AND (SELECT count(*) FROM lineitem) AS some FROM lineitem TABLESAMPLE (50 PERCENT) REPEATABLE (3)", "SELECT count(*) > 1 AS some FROM lineitem"),
    "sql_lateral_view_outer": ("SELECT n_nationkey, w FROM nation LATERAL VIEW OUTER explode(CASE WHEN n_nationkey < 5 THEN array(n_name) END) t AS w", "SELECT n_nationkey, CASE WHEN n_nationkey < 5 THEN n_name END AS w FROM nation"),
    "sql_scalar_correlated": "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS top FROM customer",
    "sql_exists_nested": "SELECT n_nationkey FROM nation n WHERE EXISTS (SELECT 1 FROM customer c WHERE c.c_nationkey = n.n_nationkey AND c.c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000))",
    "sql_in_pair": "SELECT s_suppkey FROM supplier WHERE (s_nationkey, 0) IN (SELECT n_nationkey, n_regionkey FROM nation)",
    "sql_nested_loop_join": "SELECT s_suppkey, n_nationkey FROM supplier JOIN nation ON s_nationkey < n_nationkey",
    "sql_nested_loop_outer": "SELECT n_nationkey, r_regionkey FROM nation LEFT JOIN region ON n_nationkey < r_regionkey",
    "sql_asof_join": ("SELECT a.event_id AS buy, max_by(b.event_id, struct(b.ts, b.event_id)) AS click FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts <= a.ts WHERE a.event_type = 'purchase' AND b.event_type = 'click' GROUP BY a.event_id", "SELECT a.event_id AS buy, b.event_id AS click FROM (SELECT * FROM events WHERE event_type = 'purchase') a ASOF JOIN (SELECT * FROM events WHERE event_type = 'click') b ON a.user_id = b.user_id AND a.ts >= b.ts"),
    "sql_shuffled_hash_join": ("SELECT /*+ SHUFFLE_HASH(o) */ c_custkey, o_orderkey FROM customer c JOIN orders o ON c_custkey = o_custkey", "SELECT c_custkey, o_orderkey FROM customer c JOIN orders o ON c_custkey = o_custkey"),
    "sql_sort_merge_join": ("SELECT /*+ MERGE(o) */ c_custkey, o_orderkey FROM customer c JOIN orders o ON c_custkey = o_custkey", "SELECT c_custkey, o_orderkey FROM customer c JOIN orders o ON c_custkey = o_custkey"),
    "sql_broadcast_join": ("SELECT /*+ BROADCAST(n) */ c_custkey, n_name FROM customer c JOIN nation n ON c_nationkey = n_nationkey", "SELECT c_custkey, n_name FROM customer c JOIN nation n ON c_nationkey = n_nationkey"),
    "sql_sort_aggregate": ("SELECT l_returnflag, max(l_linestatus) AS top, min(CAST(l_shipdate AS STRING)) AS first FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, max(l_linestatus) AS top, min(strftime(l_shipdate, '%Y-%m-%d %H:%M:%S')) AS first FROM lineitem GROUP BY l_returnflag"),
    "sql_anti_rows": ("SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)"),
    "sql_not_exists_rows": "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)",
    "sql_scalar_subquery_rows": "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT 1.5 * avg(o_totalprice) FROM orders)",
    "sql_full_outer_theta": "SELECT c_custkey, s_suppkey FROM customer FULL JOIN supplier ON c_custkey = s_suppkey AND c_acctbal < s_acctbal",
    "sql_window_frame_following": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS n FROM events",
    "sql_except_all": "SELECT o_orderstatus AS k FROM orders EXCEPT ALL SELECT o_orderstatus FROM orders WHERE o_totalprice > 1000",
    "sql_except_all_rows": "SELECT o_orderstatus AS k FROM orders EXCEPT ALL SELECT o_orderstatus FROM orders WHERE o_totalprice > 100000",
    "sql_intersect_all": "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier",
}


def _dealt_family(name: str):
    """A family whose functions take long for a row (XML is parsed for each of them anew): its rows are dealt to tasks first."""
    key, table, entries = FAMILIES[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = dealt(spark.read.parquet(f"{sf_dir}/{table}.parquet"), key)
        return rows.selectExpr(key, *(f"{e[1]} AS {e[0]}" for e in entries))

    return run


QUERIES = {name: _query(t if isinstance(t, str) else t[0]) for name, t in TEXTS.items()}
QUERIES["fn_nested_by_name"] = _dealt_family("fn_nested_by_name")
SQL = {name: t if isinstance(t, str) else t[1] for name, t in TEXTS.items()}
