"""The engine's queries over the driver's tables, and the same in DuckDB's SQL.

Each entry is dialect SQL that the engine runs, and the SQL that DuckDB runs on
the same tables; one text where both agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: name: (dialect SQL, DuckDB SQL or None where it is the same)
SUITE: dict[str, tuple[str, str | None]] = {}


def case(name: str, sql: str, oracle: str | None = None) -> None:
    SUITE[name] = (sql, oracle)


# -- analytic queries -------------------------------------------------------------
case("pricing_summary", """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base,
  round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
  round(avg(l_quantity), 4) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus ORDER BY 1, 2""")
case("shipping_priority", """
SELECT o_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'MACHINERY' AND o_orderdate < TIMESTAMP '1998-06-15 00:00:00'
GROUP BY o_orderkey, o_orderdate ORDER BY revenue DESC, o_orderkey LIMIT 10""")
case("local_supplier_volume", """
SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM customer, orders, lineitem, supplier, nation, region
WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey
  AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey GROUP BY n_name""")
case("forecast_revenue", """
SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem
WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24 AND year(l_shipdate) = 1997""")
case("large_orders", """
SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 200) ORDER BY o_totalprice DESC, o_orderkey""")
case("promo_share", """
SELECT round(100.0 * sum(CASE WHEN p_type LIKE 'P%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS share
FROM lineitem JOIN part ON l_partkey = p_partkey""")

# -- pruning: selective predicates that reach the Parquet statistics ----------------------------------------
case("point_lookup", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey = 77")
case("narrow_range", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey BETWEEN 1000 AND 1020 AND l_shipdate >= TIMESTAMP '1992-01-01 00:00:00'")
case("in_values", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (1, 7, 500, 1200)")

# -- joins ----------------------------------------------------------------------------
case("join_inner", "SELECT c_custkey, o_orderkey FROM customer c INNER JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 200000")
case("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F'")
case("join_right", "SELECT o_orderkey, c_name FROM customer RIGHT OUTER JOIN orders ON c_custkey = o_custkey AND c_acctbal > 5000")
case("join_full", "SELECT s_suppkey, c_custkey FROM (SELECT * FROM supplier WHERE s_suppkey < 50) s FULL OUTER JOIN (SELECT * FROM customer WHERE c_custkey BETWEEN 25 AND 90) c ON s_suppkey = c_custkey")
case("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
case("join_comma", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey")
case("join_theta", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey >= b.n_regionkey")
case("join_residual", "SELECT o_orderkey, l_linenumber FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_quantity > o_totalprice / 10000")
case("join_null_keys", "SELECT a.k AS ak, b.k AS bk FROM (SELECT nullif(n_regionkey, 1) AS k FROM nation) a LEFT JOIN (SELECT nullif(r_regionkey, 2) AS k FROM region) b ON a.k = b.k")

# -- subqueries --------------------------------------------------------------------------
case("exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
case("not_exists", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
case("in_subquery", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)")
case("not_in_subquery", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)")
case("not_in_null", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT nullif(s_nationkey, 3) FROM supplier)")
case("scalar_subquery", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)")
case("scalar_correlated", "SELECT p_partkey, (SELECT max(l_quantity) FROM lineitem WHERE l_partkey = p_partkey) AS most FROM part")
case("correlated_count", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer")
case("any_equal", "SELECT s_suppkey FROM supplier WHERE s_nationkey = ANY (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
case("any_greater", "SELECT c_custkey FROM customer WHERE c_acctbal > ANY (SELECT s_acctbal FROM supplier WHERE s_nationkey = 7)")
case("all_greater", "SELECT c_custkey FROM customer WHERE c_acctbal > ALL (SELECT s_acctbal FROM supplier WHERE s_nationkey = 7)")
case("all_less_nulls", "SELECT c_custkey, c_acctbal < ALL (SELECT nullif(s_acctbal, 0) FROM supplier WHERE s_nationkey < 3) AS less FROM customer")
case("all_unequal", "SELECT n_nationkey FROM nation WHERE n_nationkey <> ALL (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900)")

# -- aggregates -----------------------------------------------------------------------------
case("agg_counts", "SELECT event_type, count(*) AS n, count(nullif(user_id % 3, 0)) AS c, count(DISTINCT user_id) AS d, approx_count_distinct(user_id) AS a, count_if(value > 50) AS i FROM events GROUP BY event_type",
     "SELECT event_type, count(*) AS n, count(nullif(user_id % 3, 0)) AS c, count(DISTINCT user_id) AS d, count(DISTINCT user_id) AS a, CAST(count_if(value > 50) AS BIGINT) AS i FROM events GROUP BY event_type")
case("agg_sums", "SELECT CAST(sum(o_custkey) AS BIGINT) AS s, CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DECIMAL(20,2)) AS d, round(sum(o_totalprice), 2) AS f, round(avg(o_custkey), 6) AS a FROM orders")
case("agg_spread", "SELECT l_returnflag, round(stddev(l_quantity), 8) AS sd, round(stddev_pop(l_quantity), 8) AS sp, round(variance(l_tax), 10) AS v, round(var_pop(l_tax), 10) AS vp FROM lineitem GROUP BY l_returnflag")
case("agg_quantiles", "SELECT event_type, round(median(value), 8) AS m, round(quantile_cont(value, 0.9), 8) AS q, round(percentile_cont(value, 0.25), 8) AS p FROM events GROUP BY event_type",
     "SELECT event_type, round(median(value), 8) AS m, round(quantile_cont(value, 0.9), 8) AS q, round(quantile_cont(value, 0.25), 8) AS p FROM events GROUP BY event_type")
case("agg_min_max", "SELECT o_orderstatus, min(o_orderdate) AS a, max(o_orderdate) AS b, min(o_orderpriority) AS c, max(o_totalprice) AS d FROM orders GROUP BY ALL")
case("agg_mode", "SELECT mode(CASE WHEN o_orderkey % 3 = 0 THEN 'a' ELSE 'b' END) AS m FROM orders")
case("agg_strings", "SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name) AS names, string_agg(CAST(n_nationkey AS VARCHAR), ',' ORDER BY n_nationkey DESC) AS keys FROM nation GROUP BY n_regionkey")
case("agg_arrays", "SELECT n_regionkey, array_agg(nullif(n_nationkey, 4) ORDER BY n_nationkey) AS keys FROM nation GROUP BY n_regionkey",
     "SELECT n_regionkey, CAST(to_json(list(nullif(n_nationkey, 4) ORDER BY n_nationkey)) AS VARCHAR) AS keys FROM nation GROUP BY n_regionkey")
case("agg_booleans", "SELECT o_orderstatus, bool_and(o_totalprice > 1000) AS a, bool_or(o_totalprice > 450000) AS o FROM orders GROUP BY o_orderstatus")
case("agg_arg", "SELECT c_nationkey, arg_max(c_name, c_acctbal) AS rich, min_by(c_name, c_acctbal) AS poor FROM customer GROUP BY c_nationkey")
case("agg_any", "SELECT n_regionkey, any_value(n_regionkey) AS a, first(nullif(n_regionkey, 2)) AS f, last(n_regionkey) AS l FROM nation GROUP BY n_regionkey",
     "SELECT n_regionkey, any_value(n_regionkey) AS a, nullif(n_regionkey, 2) AS f, last(n_regionkey) AS l FROM nation GROUP BY n_regionkey")
case("agg_product", "SELECT round(product(1 + r_regionkey * 0.5), 6) AS p, product(r_regionkey) AS z, round(product(r_regionkey - 2.5), 6) AS s FROM region")
case("agg_filter", "SELECT count(*) FILTER (WHERE l_returnflag = 'R') AS r, round(sum(l_quantity) FILTER (WHERE l_tax > 0.04), 2) AS q, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS d FROM lineitem")
case("agg_having", "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey HAVING count(*) > 60 AND max(c_acctbal) > 9000")
case("agg_alias_ordinal", "SELECT year(o_orderdate) AS y, o_orderstatus, count(*) AS n FROM orders GROUP BY y, 2 ORDER BY y, 2")
case("agg_empty", "SELECT count(*) AS n, sum(c_acctbal) AS s, min(c_name) AS m FROM customer WHERE c_custkey < 0")
case("grouping_sets", "SELECT o_orderpriority, o_orderstatus, count(*) AS n, grouping(o_orderpriority, o_orderstatus) AS g FROM orders GROUP BY GROUPING SETS ((o_orderpriority, o_orderstatus), (o_orderstatus), ())")
case("rollup", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
case("cube", "SELECT c_mktsegment, c_nationkey % 3 AS k, count(*) AS n FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey % 3)")
case("grouping_sets_empty_input", "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_custkey < 0 GROUP BY ROLLUP (c_mktsegment)")

# -- windows, order, limits --------------------------------------------------------------------
case("window_ranks", "SELECT c_custkey, row_number() OVER w AS rn, rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS r, dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS d FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey)")
case("window_distribution", "SELECT s_suppkey, percent_rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal) AS p, cume_dist() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal) AS c, ntile(4) OVER (ORDER BY s_acctbal, s_suppkey) AS t FROM supplier")
case("window_offsets", "SELECT event_id, lag(value) OVER w AS a, lead(value, 2) OVER w AS b, lag(user_id, 1, -1) OVER w AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
case("window_values", "SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER w AS l, nth_value(o_orderkey, 2) OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
case("window_aggregates", "SELECT o_orderkey, count(*) OVER w AS n, max(o_totalprice) OVER w AS m, round(sum(o_totalprice) OVER w, 2) AS s, bool_or(o_orderstatus = 'F') OVER (PARTITION BY o_custkey) AS f FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
case("window_peers", "SELECT c_custkey, CAST(sum(c_nationkey) OVER (ORDER BY c_mktsegment) AS BIGINT) AS running FROM customer")
case("window_frame", "SELECT event_id, round(sum(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS s FROM events")
case("qualify", "SELECT c_nationkey, c_custkey, c_acctbal FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) <= 3")
case("qualify_alias", "SELECT o_custkey, o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders QUALIFY place = 2")
case("window_over_groups", "SELECT c_mktsegment, count(*) AS n, rank() OVER (ORDER BY count(*) DESC) AS place FROM customer GROUP BY c_mktsegment")
case("distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
case("distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
case("top_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25 OFFSET 5")
case("order_nulls", "SELECT n_nationkey, nullif(n_regionkey, 2) AS k FROM nation ORDER BY k DESC, n_nationkey LIMIT 22", "SELECT n_nationkey, nullif(n_regionkey, 2) AS k FROM nation ORDER BY k DESC NULLS LAST, n_nationkey LIMIT 22")
case("order_all", "SELECT r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey ORDER BY ALL LIMIT 7")
case("order_hidden", "SELECT c_name FROM customer ORDER BY c_acctbal * 2 DESC, c_custkey LIMIT 9")

# -- set operations, CTEs, reshaping ---------------------------------------------------------------
case("union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
case("union_distinct", "SELECT c_nationkey AS k, 1.5 AS v FROM customer UNION SELECT s_nationkey, 2 FROM supplier", "SELECT c_nationkey AS k, CAST(1.5 AS DECIMAL(12,1)) AS v FROM customer UNION SELECT s_nationkey, 2 FROM supplier")
case("intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
case("except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
case("set_precedence", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal < 0 ORDER BY k")
case("cte", "WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 300000), per(k, n) AS (SELECT o_custkey, count(*) FROM big GROUP BY 1) SELECT n, count(*) AS c FROM per GROUP BY n")
case("recursive_all", "WITH RECURSIVE t(n, f) AS (SELECT 1, 1 UNION ALL SELECT n + 1, f * 2 FROM t WHERE n < 20) SELECT n, f FROM t")
case("recursive_union", "WITH RECURSIVE reach(k) AS (SELECT r_regionkey FROM region WHERE r_regionkey = 1 UNION SELECT (k * 3 + 2) % 25 FROM reach) SELECT n_name FROM nation WHERE n_nationkey IN (SELECT k FROM reach)")
case("pivot", "PIVOT orders ON o_orderstatus IN ('F' AS done, 'O' AS open, 'X' AS none) USING count(*) GROUP BY o_orderpriority",
     "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, count(*) FILTER (WHERE o_orderstatus = 'O') AS open, count(*) FILTER (WHERE o_orderstatus = 'X') AS none FROM orders GROUP BY o_orderpriority")
case("unpivot", "SELECT * FROM (UNPIVOT supplier ON s_suppkey, s_acctbal INTO NAME field VALUE amount)",
     "SELECT s_name, s_nationkey, 's_suppkey' AS field, CAST(s_suppkey AS DOUBLE) AS amount FROM supplier UNION ALL SELECT s_name, s_nationkey, 's_acctbal', s_acctbal FROM supplier")
case("range_series", "SELECT a.range AS x, b.g AS y FROM range(2, 20, 3) a CROSS JOIN generate_series(5, 1, -2) AS b(g)")
case("sample_rows", "SELECT count(*) AS n FROM lineitem USING SAMPLE 100 ROWS", "SELECT least(100, count(*)) AS n FROM lineitem")
case("sample_percent", "SELECT (SELECT count(*) FROM lineitem TABLESAMPLE BERNOULLI (10%)) BETWEEN 0.07 * (SELECT count(*) FROM lineitem) AND 0.13 * (SELECT count(*) FROM lineitem) AS near FROM region",
     "SELECT (SELECT count(*) FROM lineitem USING SAMPLE 10 PERCENT (bernoulli)) BETWEEN 0.07 * (SELECT count(*) FROM lineitem) AND 0.13 * (SELECT count(*) FROM lineitem) AS near FROM region")
case("star_exclude", "SELECT * EXCLUDE (c_acctbal) REPLACE (upper(c_name) AS c_name) RENAME (c_custkey AS id) FROM customer", "SELECT c_custkey AS id, upper(c_name) AS c_name, c_nationkey, c_mktsegment FROM customer")
case("columns_regex", "SELECT COLUMNS('^c_(.*)key$') AS '\\1' FROM customer", "SELECT c_custkey AS cust, c_nationkey AS nation FROM customer")
case("columns_list", "SELECT COLUMNS(['n_name', 'n_regionkey']) FROM nation", "SELECT n_name, n_regionkey FROM nation")

# -- expressions ---------------------------------------------------------------------------------------
case("arithmetic", "SELECT l_orderkey / 7 AS q, l_orderkey % 7 AS m, -l_linenumber AS neg, l_quantity / 0 AS inf, l_linenumber // nullif(l_linenumber - 1, 0) AS d, 2 ** 3 AS p, l_linenumber & 3 AS a, l_linenumber | 8 AS o, 1 << l_linenumber AS s FROM lineitem",
     "SELECT l_orderkey // 7 AS q, l_orderkey % 7 AS m, -l_linenumber AS neg, CASE WHEN l_quantity = 0 THEN 'nan'::DOUBLE ELSE 'inf'::DOUBLE END AS inf, l_linenumber // nullif(l_linenumber - 1, 0) AS d, 8.0::DOUBLE AS p, (l_linenumber & 3)::BIGINT AS a, (l_linenumber | 8)::BIGINT AS o, (1::BIGINT << l_linenumber)::BIGINT AS s FROM lineitem")
case("decimals", "SELECT CAST(l_quantity AS DECIMAL(10,2)) + CAST(l_tax AS DECIMAL(6,4)) AS a, CAST(l_quantity AS DECIMAL(10,2)) * CAST(l_tax AS DECIMAL(6,4)) AS m, CAST(1.235 AS DECIMAL(5,2)) AS r FROM lineitem",
     "SELECT CAST(CAST(l_quantity AS DECIMAL(10,2)) + CAST(l_tax AS DECIMAL(6,4)) AS DECIMAL(13,4)) AS a, CAST(l_quantity AS DECIMAL(10,2)) * CAST(l_tax AS DECIMAL(6,4)) AS m, CAST(1.235 AS DECIMAL(5,2)) AS r FROM lineitem")
case("casts", "SELECT CAST(l_extendedprice AS INTEGER) AS i, CAST('12.5' AS INTEGER) AS s, TRY_CAST('x' AS BIGINT) AS n, l_linenumber::VARCHAR AS t, CAST('yes' AS BOOLEAN) AS b, CAST(300 AS TINYINT) AS big, CAST('2024-02-30' AS DATE) AS bad FROM lineitem",
     "SELECT CAST(l_extendedprice AS INTEGER) AS i, 13 AS s, CAST(NULL AS BIGINT) AS n, l_linenumber::VARCHAR AS t, true AS b, CAST(NULL AS TINYINT) AS big, CAST(NULL AS DATE) AS bad FROM lineitem")
case("predicates", "SELECT c_custkey FROM customer WHERE (c_acctbal BETWEEN 100 AND 900 OR c_mktsegment IN ('FURNITURE', 'MACHINERY')) AND NOT c_nationkey = 3 AND c_name IS NOT NULL AND (nullif(c_nationkey, 5) > 2) IS NOT FALSE")
case("distinct_from", "SELECT n_nationkey, nullif(n_regionkey, 1) IS DISTINCT FROM nullif(n_nationkey, 6) AS d, (nullif(n_regionkey, 1) = 2) IS TRUE AS t, n_name ISNULL AS i FROM nation", "SELECT n_nationkey, nullif(n_regionkey, 1) IS DISTINCT FROM nullif(n_nationkey, 6) AS d, coalesce(nullif(n_regionkey, 1) = 2, false) AS t, n_name IS NULL AS i FROM nation")
case("like", "SELECT p_partkey, p_name LIKE '%a_e%' AS l, p_type ILIKE 'p%' AS i, p_brand NOT LIKE 'Brand#1%' AS n, p_name LIKE 'x!%%' ESCAPE '!' AS e, p_name ~~ '%o%' AS op FROM part")
case("glob_regex", "SELECT p_partkey, p_brand GLOB 'Brand#[1-3]*' AS g, p_name ~ '.*a.*' AS f, p_brand SIMILAR TO 'Brand#\\d+' AS s, regexp_matches(p_name, 'e[a-m]') AS m, p_brand ^@ 'Brand' AS w FROM part",
     "SELECT p_partkey, p_brand GLOB 'Brand#[1-3]*' AS g, regexp_full_match(p_name, '.*a.*') AS f, regexp_full_match(p_brand, 'Brand#\\d+') AS s, regexp_matches(p_name, 'e[a-m]') AS m, starts_with(p_brand, 'Brand') AS w FROM part")
case("case_if", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS c, IF(o_totalprice > 100000, 'hi', 'lo') AS i, coalesce(nullif(o_orderstatus, 'F'), '-') AS z, greatest(o_custkey, 500) AS g, least(NULL, o_custkey, 700) AS l FROM orders",
     "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS c, CASE WHEN o_totalprice > 100000 THEN 'hi' ELSE 'lo' END AS i, coalesce(nullif(o_orderstatus, 'F'), '-') AS z, greatest(o_custkey, 500) AS g, least(NULL, o_custkey, 700) AS l FROM orders")
case("strings", "SELECT p_partkey, upper(p_name) AS u, lower(p_type) AS lo, substr(p_name, 2, 3) AS s, substring(p_name, -4) AS t, left(p_brand, 3) AS l, left(p_brand, -2) AS ln, right(p_brand, 2) AS r, reverse(p_brand) AS v, length(p_name) AS n, strpos(p_name, 'a') AS p, replace(p_name, 'a', '*') AS x, repeat('ab', 3) AS y, p_brand || '/' || p_type AS c FROM part")
case("strings_more", "SELECT s_suppkey, lpad(s_name, 20, '*') AS lp, rpad(s_name, 5, '*') AS rp, trim('  x ') AS t, ltrim('xxay', 'x') AS lt, rtrim('ayx', 'x') AS rt, split_part(s_name, '#', 2) AS sp, split_part(s_name, '#', -1) AS sn, concat(s_name, NULL, '!') AS c, concat_ws('-', 'a', NULL, 'b') AS w, ascii(s_name) AS a, chr(9731) AS ch, hex('ab') AS h, starts_with(s_name, 'Supp') AS b, ends_with(s_name, '1') AS e, contains(s_name, '00') AS k FROM supplier",
     "SELECT s_suppkey, lpad(s_name, 20, '*') AS lp, rpad(s_name, 5, '*') AS rp, 'x' AS t, 'ay' AS lt, 'ay' AS rt, split_part(s_name, '#', 2) AS sp, split_part(s_name, '#', -1) AS sn, concat(s_name, NULL, '!') AS c, 'a-b' AS w, ascii(s_name)::BIGINT AS a, chr(9731) AS ch, hex('ab') AS h, starts_with(s_name, 'Supp') AS b, ends_with(s_name, '1') AS e, contains(s_name, '00') AS k FROM supplier")
case("regex_functions", "SELECT p_partkey, regexp_extract(p_brand, '#(\\d)(\\d)', 2) AS e, regexp_extract(p_brand, 'zzz') AS z, regexp_replace(p_name, '[aeiou]', '<\\0>') AS f, regexp_replace(p_name, '[aeiou]', '', 'g') AS g, printf('%05d|%s', p_size, p_brand) AS p, format('{} of {}', p_name, p_brand) AS m FROM part",
     "SELECT p_partkey, regexp_extract(p_brand, '#(\\d)(\\d)', 2) AS e, '' AS z, regexp_replace(p_name, '[aeiou]', '<\\0>') AS f, regexp_replace(p_name, '[aeiou]', '', 'g') AS g, printf('%05d|%s', p_size, p_brand) AS p, format('{} of {}', p_name, p_brand) AS m FROM part")
case("numbers", "SELECT c_custkey, abs(c_acctbal) AS a, ceil(c_acctbal) AS c, floor(c_acctbal) AS f, trunc(c_acctbal) AS t, round(c_acctbal, 1) AS r, sign(c_acctbal) AS s, round(sqrt(abs(c_acctbal)), 8) AS q, round(ln(c_custkey + 1), 8) AS l, round(log(100), 8) AS lg, round(exp(1), 8) AS e, gcd(c_custkey, 36) AS g, lcm(c_nationkey, 6) AS m, bit_count(c_custkey) AS b, factorial(5) AS fa, mod(c_custkey, 7) AS mo, round(pi(), 8) AS pi FROM customer",
     "SELECT c_custkey, abs(c_acctbal) AS a, ceil(c_acctbal) AS c, floor(c_acctbal) AS f, trunc(c_acctbal) AS t, round(c_acctbal, 1) AS r, sign(c_acctbal)::DOUBLE AS s, round(sqrt(abs(c_acctbal)), 8) AS q, round(ln(c_custkey + 1), 8) AS l, 2.0::DOUBLE AS lg, round(exp(1), 8) AS e, gcd(c_custkey, 36)::BIGINT AS g, lcm(c_nationkey, 6)::BIGINT AS m, bit_count(c_custkey)::BIGINT AS b, CAST(120 AS DECIMAL(38,0)) AS fa, (c_custkey % 7)::BIGINT AS mo, round(pi(), 8) AS pi FROM customer")
case("math", "SELECT event_id, round(cbrt(value), 8) AS c, round(log2(value + 1), 8) AS l2, round(log10(value + 1), 8) AS l, round(pow(value, 0.5), 8) AS p, round(radians(value), 8) AS r, round(degrees(value), 6) AS d, isnan(value) AS n, isfinite(value) AS f, xor(user_id, 5) AS x, 7! AS fa, @(-3) AS ab FROM events",
     "SELECT event_id, round(cbrt(value), 8) AS c, round(log2(value + 1), 8) AS l2, round(log10(value + 1), 8) AS l, round(pow(value, 0.5), 8) AS p, round(radians(value), 8) AS r, round(degrees(value), 6) AS d, isnan(value) AS n, isfinite(value) AS f, xor(user_id, 5)::BIGINT AS x, CAST(5040 AS DECIMAL(38,0)) AS fa, 3::BIGINT AS ab FROM events")
case("date_parts", "SELECT event_id, year(ts) AS y, quarter(ts) AS q, month(ts) AS m, week(ts) AS w, day(ts) AS d, hour(ts) AS h, minute(ts) AS mi, second(ts) AS s, dayofweek(ts) AS dw, isodow(ts) AS iw, dayofyear(ts) AS dy, extract('epoch' FROM ts) AS ep, date_part('millisecond', ts) AS ms, century(ts) AS c, decade(ts) AS de FROM events",
     "SELECT event_id, year(ts) AS y, quarter(ts) AS q, month(ts) AS m, week(ts) AS w, day(ts) AS d, hour(ts) AS h, minute(ts) AS mi, second(ts) AS s, dayofweek(ts) AS dw, isodow(ts) AS iw, dayofyear(ts) AS dy, CAST(floor(epoch(ts)) AS BIGINT) AS ep, date_part('millisecond', ts) AS ms, century(ts) AS c, decade(ts) AS de FROM events")
case("date_functions", "SELECT o_orderkey, date_trunc('month', o_orderdate) AS t, date_diff('day', o_orderdate, TIMESTAMP '1998-01-01 00:00:00') AS d, date_diff('month', o_orderdate, TIMESTAMP '1998-01-01 00:00:00') AS m, o_orderdate + INTERVAL 1 MONTH AS a, o_orderdate - INTERVAL '3 days' AS b, last_day(o_orderdate) AS l, strftime(o_orderdate, '%Y/%m/%d') AS f, dayname(o_orderdate) AS dn, monthname(o_orderdate) AS mn, epoch_ms(o_orderdate) AS em, make_date(2024, 2, 29) AS md FROM orders")
case("date_arithmetic", "SELECT CAST(l_shipdate AS DATE) + 5 AS a, CAST(l_shipdate AS DATE) - DATE '1995-01-01' AS d, DATE '2024-01-31' + INTERVAL 1 MONTH AS m, date_add('week', 2, l_shipdate) AS w FROM lineitem",
     "SELECT CAST(l_shipdate AS DATE) + 5 AS a, CAST(l_shipdate AS DATE) - DATE '1995-01-01' AS d, TIMESTAMP '2024-02-29 00:00:00' AS m, l_shipdate + INTERVAL 14 DAY AS w FROM lineitem")

# -- JSON, lists, lambdas ------------------------------------------------------------------------------
case("json_extract", "SELECT event_id, props->'$.k' AS j, props->>'$.k' AS s, json_extract_string(props, '$.zz') AS z, json_type(props) AS t, json_type(props, '$.k') AS tk, CAST(props->>'k' AS BIGINT) AS n FROM events",
     "SELECT event_id, CAST(props->'$.k' AS VARCHAR) AS j, props->>'$.k' AS s, json_extract_string(props, '$.zz') AS z, 'OBJECT' AS t, 'BIGINT' AS tk, CAST(props->>'k' AS BIGINT) AS n FROM events")
case("json_build", "SELECT n_nationkey, json_object('k', n_nationkey, 'n', n_name, 'z', NULL) AS o, json_array(n_nationkey, n_name, true) AS a, json_array_length(json_array(1, 2, n_nationkey)) AS l, to_json(n_name) AS t FROM nation",
     "SELECT n_nationkey, CAST(json_object('k', n_nationkey, 'n', n_name, 'z', NULL) AS VARCHAR) AS o, CAST(json_array(n_nationkey, n_name, true) AS VARCHAR) AS a, 3::BIGINT AS l, CAST(to_json(n_name) AS VARCHAR) AS t FROM nation")
case("lists", "SELECT n_nationkey, [3, 1, n_nationkey][3] AS e, [1, 2, 3, 4][2:3] AS s, [1, 2, 3][-1] AS last, list_contains([1, 2, n_nationkey], 7) AS c, list_position([5, 6, 7], n_nationkey) AS p, list_sort([3, 1, n_nationkey]) AS o, list_distinct([1, 1, n_nationkey]) AS d, list_reverse([1, 2, n_nationkey]) AS r, list_concat([1], [n_nationkey], [3]) AS cc FROM nation",
     "SELECT n_nationkey, CAST(n_nationkey AS VARCHAR) AS e, '[2,3]' AS s, '3' AS last, n_nationkey = 7 AS c, CASE WHEN n_nationkey BETWEEN 5 AND 7 THEN (n_nationkey - 4)::BIGINT END AS p, CAST(to_json(list_sort([3, 1, n_nationkey])) AS VARCHAR) AS o, CASE WHEN n_nationkey = 1 THEN '[1]' ELSE '[1,' || n_nationkey || ']' END AS d, '[' || n_nationkey || ',2,1]' AS r, '[1,' || n_nationkey || ',3]' AS cc FROM nation")
case("lambdas", "SELECT n_nationkey, list_transform([1, 2, n_nationkey], x -> x * 2) AS t, list_filter([1, 5, n_nationkey], x -> x > 4) AS f, list_reduce([1, 2, n_nationkey], (a, x) -> a + x) AS r FROM nation",
     "SELECT n_nationkey, CAST(to_json([2, 4, n_nationkey * 2]) AS VARCHAR) AS t, CAST(to_json(list_filter([1, 5, n_nationkey], lambda x: x > 4)) AS VARCHAR) AS f, CAST(3 + n_nationkey AS VARCHAR) AS r FROM nation")
case("split_unnest", "SELECT p_partkey, w FROM part, UNNEST(string_split(p_name, ' ')) AS u(w)", "SELECT p_partkey, CAST(to_json(unnest(string_split(p_name, ' '))) AS VARCHAR) AS w FROM part")
case("unnest_embeddings", "SELECT vec_id, count(*) AS n, round(sum(CAST(x AS DOUBLE)), 4) AS s FROM (SELECT vec_id, CAST(x AS VARCHAR) AS x FROM embeddings, UNNEST(embedding) AS u(x)) t GROUP BY vec_id",
     "SELECT vec_id, count(*) AS n, round(sum(CAST(x AS DOUBLE)), 4) AS s FROM (SELECT vec_id, CAST(unnest(embedding) AS VARCHAR) AS x FROM embeddings) t GROUP BY vec_id")
case("unnest_select", "SELECT r_regionkey, unnest([10, 20, r_regionkey]) AS v FROM region WHERE r_regionkey < 3", "SELECT r_regionkey, CAST(unnest([10, 20, r_regionkey]) AS BIGINT) AS v FROM region WHERE r_regionkey < 3")
case("typeof", "SELECT typeof(c_custkey) AS a, typeof(c_acctbal) AS b, typeof(c_name) AS c, typeof(1.50) AS d, typeof(DATE '2024-01-01') AS e, typeof(sum(c_nationkey)) AS f FROM customer GROUP BY ALL", "SELECT 'BIGINT' AS a, 'DOUBLE' AS b, 'VARCHAR' AS c, 'DECIMAL(3,2)' AS d, 'DATE' AS e, 'HUGEINT' AS f")


# -- more corners of the dialect ------------------------------------------------------------------------
case("nested_queries", "SELECT t.k, t.n FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > (SELECT avg(n) FROM (SELECT count(*) AS n FROM customer GROUP BY c_nationkey) x)) t ORDER BY n DESC, k LIMIT 5")
case("exists_residual", "SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 49) AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')")
case("not_in_list", "SELECT n_nationkey FROM nation WHERE n_regionkey NOT IN (1, 2) AND n_name NOT BETWEEN 'B' AND 'K'")
case("set_alias_order", "SELECT n_nationkey AS a FROM nation WHERE n_regionkey = 1 UNION ALL SELECT r_regionkey AS b FROM region ORDER BY b DESC LIMIT 6", "SELECT n_nationkey AS a FROM nation WHERE n_regionkey = 1 UNION ALL SELECT r_regionkey FROM region ORDER BY a DESC LIMIT 6")
case("union_types", "SELECT l_linenumber AS v FROM lineitem WHERE l_orderkey < 5 UNION ALL SELECT o_totalprice FROM orders WHERE o_orderkey < 5")
case("distinct_aggregates", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS c, round(avg(DISTINCT o_custkey), 6) AS a, CAST(sum(DISTINCT o_custkey % 10) AS BIGINT) AS s FROM orders GROUP BY o_orderstatus")
case("filtered_arg", "SELECT c_mktsegment, arg_min(c_name, c_acctbal) FILTER (WHERE c_nationkey = 3) AS a, max_by(c_custkey, c_acctbal) AS b FROM customer GROUP BY c_mktsegment")
case("group_expression", "SELECT c_nationkey % 4 AS k, CASE WHEN c_acctbal > 0 THEN 'pos' ELSE 'neg' END AS s, count(*) AS n FROM customer GROUP BY c_nationkey % 4, CASE WHEN c_acctbal > 0 THEN 'pos' ELSE 'neg' END")
case("lag_negative", "SELECT o_orderkey, lag(o_orderkey, -1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders", "SELECT o_orderkey, lead(o_orderkey, 1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders")
case("ntile_column", "SELECT s_suppkey, ntile(s_nationkey - s_nationkey + 3) OVER (ORDER BY s_suppkey) AS t FROM supplier", "SELECT s_suppkey, ntile(3) OVER (ORDER BY s_suppkey) AS t FROM supplier")
case("having_window", "SELECT c_nationkey, count(*) AS n, CAST(sum(count(*)) OVER (ORDER BY c_nationkey) AS BIGINT) AS running FROM customer GROUP BY c_nationkey HAVING count(*) > 10")
case("distinct_on_expression", "SELECT DISTINCT ON (o_orderkey % 10) o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey % 10, o_totalprice DESC, o_orderkey")
case("pivot_default", "PIVOT (SELECT c_mktsegment, c_nationkey % 3 AS k FROM customer) ON k IN (0, 1, 2)", "SELECT c_mktsegment, count(*) FILTER (WHERE c_nationkey % 3 = 0) AS \"0\", count(*) FILTER (WHERE c_nationkey % 3 = 1) AS \"1\", count(*) FILTER (WHERE c_nationkey % 3 = 2) AS \"2\" FROM customer GROUP BY c_mktsegment")
case("unsigned_casts", "SELECT CAST(l_linenumber AS UTINYINT) AS a, CAST(-l_linenumber AS UINTEGER) AS b, CAST(300 AS UTINYINT) AS c, CAST(l_orderkey AS HUGEINT) AS d FROM lineitem",
     "SELECT CAST(l_linenumber AS SMALLINT) AS a, CAST(NULL AS BIGINT) AS b, CAST(NULL AS SMALLINT) AS c, CAST(l_orderkey AS DECIMAL(38,0)) AS d FROM lineitem")
case("uuid_time", "SELECT n_nationkey, CAST('A0EEBC99-9C0B-4EF8-BB6D-6BB9BD380A11' AS UUID)::VARCHAR AS u, CAST('zz' AS UUID)::VARCHAR AS z, CAST(TIME '10:20:30' AS VARCHAR) AS t FROM nation",
     "SELECT n_nationkey, 'a0eebc99-9c0b-4ef8-bb6d-6bb9bd380a11' AS u, CAST(NULL AS VARCHAR) AS z, '10:20:30' AS t FROM nation")
case("intervals", "SELECT event_id, ts + INTERVAL '2 hours' - INTERVAL 90 SECOND AS a, ts + INTERVAL (user_id % 5) DAY AS b, DATE '2024-03-31' - INTERVAL 1 MONTH AS c FROM events")
case("regex_null", "SELECT p_partkey, regexp_extract(nullif(p_name, p_name), 'a') AS n, p_name !~ '.*q.*' AS x, p_type !~~ '%A%' AS y, p_type ~~* '%a%' AS z FROM part",
     "SELECT p_partkey, CAST(NULL AS VARCHAR) AS n, NOT regexp_full_match(p_name, '.*q.*') AS x, p_type NOT LIKE '%A%' AS y, p_type ILIKE '%a%' AS z FROM part")
case("date_diff_parts", "SELECT o_orderkey, date_diff('hour', TIMESTAMP '1995-01-01 23:30:00', o_orderdate) AS h, date_diff('year', TIMESTAMP '1995-12-31 00:00:00', o_orderdate) AS y, date_diff('quarter', TIMESTAMP '1995-12-31 00:00:00', o_orderdate) AS q, date_trunc('decade', o_orderdate) AS d, date_trunc('week', o_orderdate) AS w FROM orders")
case("text_dates", "SELECT event_id, to_date(strftime(ts, '%Y-%m-%d')) AS d, to_timestamp('2024-01-02 03:04:05') AS t, to_date('2024-13-01') AS bad, epoch_us(ts) AS us FROM events",
     "SELECT event_id, CAST(ts AS DATE) AS d, TIMESTAMP '2024-01-02 03:04:05' AS t, CAST(NULL AS DATE) AS bad, epoch_us(ts) AS us FROM events")
case("json_paths", "SELECT event_id, json_extract('{\"a\": {\"b\": [1, {\"c\": \"x\"}]}}', '$.a.b[1].c') AS q, '{\"a\": {\"b\": [1, 2]}}'->'a'->'b'->>1 AS one, json_array_length('[1, [2], 3]') AS n, json_type('[1.5]', '$[0]') AS t, props->>'$.k' IS NULL AS m FROM events",
     "SELECT event_id, '\"x\"' AS q, '2' AS one, 3::BIGINT AS n, 'DOUBLE' AS t, props->>'$.k' IS NULL AS m FROM events")
case("list_strings", "SELECT s_suppkey, string_split(s_name, '#')[2] AS b, list_contains(string_split(s_name, '#'), 'Supplier') AS h, list_transform(string_split('a b', ' '), x -> json_extract_string(json_array(x), '$[0]')) AS t, list_extract([1, 2], 5) AS z FROM supplier",
     "SELECT s_suppkey, CAST(to_json(string_split(s_name, '#')[2]) AS VARCHAR) AS b, list_contains(string_split(s_name, '#'), 'Supplier') AS h, '[\"a\",\"b\"]' AS t, CAST(NULL AS VARCHAR) AS z FROM supplier")
case("star_tables", "SELECT n.*, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
case("any_null_logic", "SELECT n_nationkey, nullif(n_regionkey, 0) > ANY (SELECT nullif(r_regionkey, 3) FROM region) AS a, n_regionkey >= ALL (SELECT r_regionkey FROM region WHERE r_regionkey > 90) AS e FROM nation")
case("join_using", "SELECT l_orderkey, o_custkey FROM (SELECT l_orderkey, l_quantity FROM lineitem) l JOIN (SELECT o_orderkey AS l_orderkey, o_custkey FROM orders) o USING (l_orderkey) WHERE l_quantity = 1")


# -- aliases, literals and rarer forms -------------------------------------------------------------------
case("no_from", "SELECT 6 * 7 AS a, 'x' || 'y' AS b, NULL AS c WHERE 1 < 2", "SELECT CAST(6 * 7 AS BIGINT) AS a, 'x' || 'y' AS b, NULL AS c WHERE 1 < 2")
case("sample_methods", "SELECT (SELECT count(*) FROM orders USING SAMPLE reservoir(50 ROWS) REPEATABLE (7)) AS r, (SELECT count(*) FROM orders TABLESAMPLE SYSTEM (100%)) AS s, (SELECT count(*) FROM orders USING SAMPLE 100% (bernoulli, 3)) AS b FROM region",
     "SELECT (SELECT least(50, count(*)) FROM orders) AS r, (SELECT count(*) FROM orders) AS s, (SELECT count(*) FROM orders) AS b FROM region")
case("sample_repeats", "SELECT (SELECT sum(o_orderkey) FROM orders TABLESAMPLE BERNOULLI (20%) REPEATABLE (5)) = (SELECT sum(o_orderkey) FROM orders TABLESAMPLE BERNOULLI (20%) REPEATABLE (5)) AS same FROM region", "SELECT count(*) >= 0 AS same FROM orders GROUP BY o_orderkey % 5 ORDER BY 1 LIMIT 5")
case("now_constants", "SELECT current_date = today() AS d, now() >= TIMESTAMP '2024-01-01 00:00:00' AS n, current_timestamp = get_current_timestamp() AS t, current_time IS NOT NULL AS c FROM region",
     "SELECT current_date = today() AS d, now() >= TIMESTAMP '2024-01-01 00:00:00' AS n, current_timestamp = get_current_timestamp() AS t, current_time IS NOT NULL AS c FROM region")
case("timestamps_with_zone", "SELECT n_nationkey, epoch_us(CAST('2024-03-31 01:30:00+02' AS TIMESTAMPTZ)) AS a, epoch_us(CAST('2024-03-31T01:30:00.25Z' AS TIMESTAMP WITH TIME ZONE)) AS b, epoch_us(TIMESTAMPTZ '2024-01-01 00:00:00-05:30') AS c FROM nation")
case("map_extract", "SELECT n_nationkey, map_extract(json_object('k', n_nationkey, 'n', n_name), 'k') AS k, map_extract(json_object('n', n_name), 'zz') AS z FROM nation",
     "SELECT n_nationkey, CAST(json_extract(json_object('k', n_nationkey, 'n', n_name), '$.k') AS VARCHAR) AS k, CAST(json_extract(json_object('n', n_name), '$.zz') AS VARCHAR) AS z FROM nation")
case("json_lengths", "SELECT n_nationkey, json_array_length('{}') AS o, json_array_length(CAST(n_nationkey AS VARCHAR)) AS s, json_array_length('[1, [2, 3], {}]') AS a, json_array_length(nullif('[]', '[]')) AS z, json_array_length(json_array(n_name, n_regionkey)) AS l FROM nation",
     "SELECT n_nationkey, json_array_length('{}')::BIGINT AS o, json_array_length(CAST(n_nationkey AS VARCHAR))::BIGINT AS s, json_array_length('[1, [2, 3], {}]')::BIGINT AS a, json_array_length(nullif('[]', '[]'))::BIGINT AS z, json_array_length(json_array(n_name, n_regionkey))::BIGINT AS l FROM nation")
case("json_raw_spans", "SELECT event_id, '{\"a\": {\"b\" : 1.50}, \"c\": [1,  2]}'->>'$.a.b' AS n, '{\"a\": {\"b\" : 1.50}}'->>'a' AS o, '{\"c\": [1,  \"x\"]}'->'c'->>1 AS x FROM events WHERE event_id % 50 = 0",
     "SELECT event_id, '1.50' AS n, '{\"b\" : 1.50}' AS o, 'x' AS x FROM events WHERE event_id % 50 = 0")
case("strftime_literals", "SELECT event_id, strftime(ts, '%Y-%q %H%% it''s %M') AS a, strftime(ts, '%d%m%%%S') AS b FROM events", "SELECT event_id, strftime(ts, '%Y') || '-%q ' || strftime(ts, '%H%% it''s %M') AS a, strftime(ts, '%d%m%%%S') AS b FROM events")
case("mode_ties", "SELECT n_regionkey, mode(n_name) AS m, mode(n_nationkey % 3) AS k FROM nation GROUP BY n_regionkey",
     "WITH c AS (SELECT n_regionkey, n_name AS v, count(*) AS n FROM nation GROUP BY 1, 2), d AS (SELECT n_regionkey, n_nationkey % 3 AS v, count(*) AS n FROM nation GROUP BY 1, 2) SELECT x.n_regionkey, x.m, y.k FROM (SELECT n_regionkey, min(v) AS m FROM c WHERE (n_regionkey, n) IN (SELECT n_regionkey, max(n) FROM c GROUP BY 1) GROUP BY 1) x JOIN (SELECT n_regionkey, min(v) AS k FROM d WHERE (n_regionkey, n) IN (SELECT n_regionkey, max(n) FROM d GROUP BY 1) GROUP BY 1) y USING (n_regionkey)")
case("double_text", "SELECT event_id, CAST(value AS VARCHAR) AS v, CAST(value * 1e18 AS VARCHAR) AS big, CAST(value / 1e7 AS VARCHAR) AS small, CAST(CAST(event_id AS DOUBLE) * 1e8 AS VARCHAR) AS plain, CAST(CAST('inf' AS DOUBLE) AS VARCHAR) AS i FROM events",
     "SELECT event_id, CAST(value AS VARCHAR) AS v, CAST(value * 1e18 AS VARCHAR) AS big, CAST(value / 1e7 AS VARCHAR) AS small, CAST(CAST(event_id AS DOUBLE) * 1e8 AS VARCHAR) AS plain, CAST(CAST('inf' AS DOUBLE) AS VARCHAR) AS i FROM events")
case("bit_functions", "SELECT user_id, bit_and(user_id, 12) AS a, bit_or(user_id, 3) AS o, bit_not(user_id) AS n, bit_shift_left(user_id, 2) AS l, bit_shift_right(user_id, 1) AS r FROM events",
     "SELECT user_id, (user_id & 12)::BIGINT AS a, (user_id | 3)::BIGINT AS o, (~user_id)::BIGINT AS n, (user_id::BIGINT << 2)::BIGINT AS l, (user_id >> 1)::BIGINT AS r FROM events")
case("alias_functions", "SELECT n_nationkey, to_hex('ab') AS h, unhex('6162') AS u, isinf(n_nationkey / 1.0) AS f, ifnull(nullif(n_name, 'NATION_3'), '-') AS i, position('A' IN n_name) AS p, instr(n_name, 'T') AS s, make_timestamp(2024, 2, 29, n_regionkey, 5, 6.25) AS t, epoch_ns(TIMESTAMP '2024-01-01 00:00:00') AS ns FROM nation",
     "SELECT n_nationkey, to_hex('ab') AS h, unhex('6162') AS u, isinf(n_nationkey::DOUBLE) AS f, ifnull(nullif(n_name, 'NATION_3'), '-') AS i, position('A' IN n_name)::BIGINT AS p, instr(n_name, 'T')::BIGINT AS s, make_timestamp(2024, 2, 29, n_regionkey, 5, 6.25) AS t, epoch_ns(TIMESTAMP '2024-01-01 00:00:00') AS ns FROM nation")
case("alias_lists", "SELECT n_nationkey, array_extract([4, 5, 6], 2) AS e, array_slice([1, 2, 3, 4], 2, 3) AS s, list_has([1, n_regionkey], 3) AS h, array_indexof([7, 8, n_regionkey], 8) AS p, array_sort([3, 1, 2]) AS o, array_reverse([1, 2]) AS r, array_concat([1], [2]) AS c, array_length([1, 2, 3]) AS l FROM nation",
     "SELECT n_nationkey, '5' AS e, CAST(to_json(array_slice([1, 2, 3, 4], 2, 3)) AS VARCHAR) AS s, list_has([1, n_regionkey], 3) AS h, list_indexof([7, 8, n_regionkey], 8)::BIGINT AS p, CAST(to_json(array_sort([3, 1, 2])) AS VARCHAR) AS o, CAST(to_json(array_reverse([1, 2])) AS VARCHAR) AS r, CAST(to_json(array_concat([1], [2])) AS VARCHAR) AS c, array_length([1, 2, 3])::BIGINT AS l FROM nation")
case("unknown_truths", "SELECT n_nationkey, (nullif(n_regionkey, 1) > 2) IS UNKNOWN AS u, (nullif(n_regionkey, 1) > 2) IS NOT UNKNOWN AS k, nullif(n_regionkey, 1) NOTNULL AS nn FROM nation",
     "SELECT n_nationkey, (nullif(n_regionkey, 1) > 2) IS NULL AS u, (nullif(n_regionkey, 1) > 2) IS NOT NULL AS k, nullif(n_regionkey, 1) NOTNULL AS nn FROM nation")
case("grouping_id", "SELECT l_returnflag, l_linestatus, grouping_id(l_returnflag, l_linestatus) AS g, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
case("columns_star", "SELECT COLUMNS(* EXCLUDE (n_regionkey)) FROM nation", "SELECT n_nationkey, n_name FROM nation")
case("not_in_nested", "SELECT c_custkey FROM customer WHERE c_nationkey > 20 OR NOT (c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2))")
case("all_equal", "SELECT n_nationkey, n_regionkey = ALL (SELECT r_regionkey FROM region WHERE r_regionkey = 2) AS a, nullif(n_regionkey, 1) = ALL (SELECT nullif(r_regionkey, 3) FROM region WHERE r_regionkey > 1) AS b, n_regionkey = ALL (SELECT r_regionkey FROM region WHERE r_regionkey > 90) AS c FROM nation")
case("any_unequal", "SELECT n_nationkey, n_regionkey <> ANY (SELECT r_regionkey FROM region WHERE r_regionkey = 2) AS a, nullif(n_regionkey, 1) <> ANY (SELECT nullif(r_regionkey, 3) FROM region WHERE r_regionkey IN (3, 4)) AS b, n_regionkey <> ANY (SELECT r_regionkey FROM region WHERE r_regionkey > 90) AS c FROM nation")
case("date_part_names", "SELECT event_id, millisecond(ts) AS ms, microsecond(ts) AS us, date_part('microsecond', ts) AS u FROM events")


# -- statements and files: functions of (spark, sf_dir) ---------------------------------------------------
PROGRAMS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}


def program(oracle: str):
    def add(f):
        PROGRAMS[f.__name__] = (f, oracle)
        return f

    return add


def _own(spark: SparkSession, sf_dir: str, *tables: str):
    """An engine of its own, so that statements leave nothing behind."""
    from .session import Engine

    e = Engine(spark)
    for t in tables:
        e.register(t, f"{sf_dir}/{t}.parquet")
    return e


def _path(spark: SparkSession, name: str) -> str:
    import uuid

    from .operators.storage import shared_folder

    return f"{shared_folder(spark)}/{uuid.uuid4().hex[:12]}-{name}"


@program("SELECT c_custkey + 0 AS k, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS bal, 'new' AS tag FROM customer WHERE c_nationkey < 5 AND c_custkey % 7 <> 0 UNION ALL SELECT -1, 5.5, NULL")
def statements_dml(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _own(spark, sf_dir, "customer")
    for s in (
        "CREATE TABLE c AS SELECT c_custkey AS k, c_acctbal AS bal FROM customer WHERE c_nationkey < 5",
        "UPDATE c SET bal = bal + 1 WHERE k % 2 = 0",
        "DELETE FROM c WHERE k % 7 = 0",
        "ALTER TABLE c ADD COLUMN tag VARCHAR DEFAULT 'new'",
        "INSERT INTO c (k, bal) VALUES (-1, 5.5)",
        "ALTER TABLE c RENAME TO d",
    ):
        e.sql(s)
    return e.sql("SELECT * FROM d")


@program("SELECT n_regionkey AS r, count(*) AS n FROM nation WHERE n_nationkey > 3 GROUP BY 1")
def statements_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _own(spark, sf_dir, "nation")
    e.sql("CREATE VIEW v AS SELECT n_regionkey AS r, n_nationkey AS k FROM nation WHERE n_nationkey > 3")
    return e.sql("SELECT r, count(k) AS n FROM v GROUP BY r")


def _through(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    e = _own(spark, sf_dir, "orders")
    path = _path(spark, f"orders.{kind}")
    e.sql(f"COPY (SELECT o_orderkey, o_custkey, o_orderpriority, o_totalprice, nullif(o_orderstatus, 'F') AS st, CAST(o_orderdate AS DATE) AS d FROM orders) TO '{path}'")
    return e.sql(f"SELECT o_orderkey, o_custkey, o_orderpriority, o_totalprice, st, CAST(d AS DATE) AS d FROM '{path}'")


_COPIED = "SELECT o_orderkey, o_custkey, o_orderpriority, o_totalprice, nullif(o_orderstatus, 'F') AS st, CAST(o_orderdate AS DATE) AS d FROM orders"


@program(_COPIED)
def copy_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _through(spark, sf_dir, "csv")


@program(_COPIED)
def copy_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _through(spark, sf_dir, "tsv")


@program(_COPIED)
def copy_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _through(spark, sf_dir, "jsonl")


@program(_COPIED)
def copy_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _through(spark, sf_dir, "parquet")


@program("SELECT n_regionkey AS region, n_name, n_nationkey FROM nation WHERE n_regionkey IN (1, 3)")
def hive_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, path = _own(spark, sf_dir), _path(spark, "hive")
    spark.read.parquet(f"{sf_dir}/nation.parquet").withColumnRenamed("n_regionkey", "region").write.partitionBy("region").parquet(path)
    e.register("t", path)
    return e.sql("SELECT region, n_name, n_nationkey FROM t WHERE region IN (1, 3)")


@program("SELECT count(*) AS n, CAST(sum(k) AS BIGINT) AS s FROM (SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region)")
def many_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, a, b = _own(spark, sf_dir, "nation", "region"), _path(spark, "a.csv"), _path(spark, "b.jsonl")
    e.sql(f"COPY (SELECT n_nationkey AS k FROM nation) TO '{a}'")
    e.sql(f"COPY (SELECT r_regionkey AS k FROM region) TO '{b}'")
    e.register("t", a, b)
    return e.sql("SELECT count(*) AS n, CAST(sum(k) AS BIGINT) AS s FROM t")


@program("SELECT column_name, column_type, \"null\" FROM (DESCRIBE customer)")
def describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _own(spark, sf_dir, "customer").sql("DESCRIBE customer")


@program("SELECT table_name AS name FROM information_schema.tables WHERE table_name IN ('nation', 'region')")
def show_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _own(spark, sf_dir, "region", "nation").sql("SHOW TABLES")


@program("SELECT 'c_custkey' AS column_name, CAST(min(c_custkey) AS VARCHAR) AS lo, CAST(max(c_custkey) AS VARCHAR) AS hi, round(avg(c_custkey), 6) AS mean, median(c_custkey) AS q50, count(*) AS n FROM customer")
def summarize(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _own(spark, sf_dir, "customer").sql("SUMMARIZE SELECT c_custkey FROM customer")
    return s.selectExpr("column_name", "`min` as lo", "`max` as hi", "round(avg, 6) as mean", "q50", "`count` as n")


@program("SELECT o_orderkey FROM orders WHERE o_totalprice > 100000.5 AND o_orderstatus = 'F'")
def parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _own(spark, sf_dir, "orders").sql("SELECT o_orderkey FROM orders WHERE o_totalprice > ? AND o_orderstatus = ?", [100000.5, "F"])


@program("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def table_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _own(spark, sf_dir).sql(f"SELECT n_nationkey, n_name, r_name FROM read_parquet('{sf_dir}/nation.parquet') n JOIN parquet('{sf_dir}/region.parquet') r ON n_regionkey = r_regionkey")


@program("SELECT a.n_nationkey, a.n_name, b.n_regionkey, c.n_name AS other FROM nation a JOIN nation b USING (n_nationkey) JOIN nation c USING (n_nationkey)")
def read_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, path, tabs = _own(spark, sf_dir, "nation"), _path(spark, "n.csv"), _path(spark, "n.tsv")
    e.sql(f"COPY nation TO '{path}'")
    e.sql(f"COPY nation TO '{tabs}'")
    return e.sql(f"SELECT a.n_nationkey, a.n_name, b.n_regionkey, c.n_name AS other FROM read_csv('{path}') a JOIN read_csv_auto('{path}') b ON a.n_nationkey = b.n_nationkey JOIN '{tabs}' c ON c.n_nationkey = a.n_nationkey")


@program("SELECT a.n_nationkey, a.n_name, b.n_regionkey FROM nation a JOIN nation b USING (n_nationkey)")
def read_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, path = _own(spark, sf_dir, "nation"), _path(spark, "n.jsonl")
    e.sql(f"COPY nation TO '{path}'")
    return e.sql(f"SELECT a.n_nationkey, a.n_name, b.n_regionkey FROM read_json('{path}') a JOIN read_json_auto('{path}') b ON a.n_nationkey = b.n_nationkey")


@program("SELECT n_nationkey AS id, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey END AS even FROM nation")
def json_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, path = _own(spark, sf_dir, "nation"), _path(spark, "d.json")
    one = "SELECT '[' || string_agg('{\"id\": ' || n_nationkey || ', \"name\": \"' || n_name || '\"' || CASE WHEN n_nationkey % 2 = 0 THEN ', \"even\": ' || n_regionkey ELSE '' END || '}', ', ') || ']' AS value FROM nation"
    e.sql(one).write.text(path)
    return e.sql(f"SELECT id, name, even FROM '{path}'")


@program("SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS s, count(DISTINCT o_custkey) AS c FROM orders")
def globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, path = _own(spark, sf_dir), _path(spark, "g")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    for k in range(3):
        orders.where(f"o_orderkey % 3 = {k}").write.parquet(f"{path}/d{k}/part.parquet")
    return e.sql(f"SELECT a.n, b.s, c.c FROM (SELECT count(*) AS n FROM '{path}/*/part.parquet') a, (SELECT CAST(sum(o_orderkey) AS BIGINT) AS s FROM '{path}/**/*.parquet') b, (SELECT count(DISTINCT o_custkey) AS c FROM '{path}/d[0-2]/part.parquet') c")


@program("SELECT n_nationkey AS id, n_name AS city, n_regionkey AS zip, '[{\"key\":\"r\",\"value\":' || n_regionkey || '}]' AS m, '[{\"x\":' || n_nationkey || ',\"y\":\"' || n_name || '\"}]' AS xs FROM nation")
def nested_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, path = _own(spark, sf_dir), _path(spark, "nested.parquet")
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet")
    rows.selectExpr("n_nationkey as id", "named_struct('city', n_name, 'zip', n_regionkey) as address", "map('r', n_regionkey) as m", "array(named_struct('x', n_nationkey, 'y', n_name)) as xs").write.parquet(path)
    e.register("t", path)
    return e.sql("SELECT id, address.city AS city, address.zip AS zip, m, xs FROM t")


@program("SELECT o_orderkey, o_totalprice, 'OLD' AS state FROM orders WHERE o_orderkey < 500 UNION ALL SELECT o_orderkey, o_totalprice, 'NEW' FROM orders WHERE o_orderkey BETWEEN 500 AND 600 UNION ALL SELECT o_orderkey, o_totalprice, 'NEW' FROM orders WHERE o_orderkey BETWEEN 601 AND 700")
def statements_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _own(spark, sf_dir, "orders")
    for s in (
        "CREATE TABLE o AS SELECT o_orderkey, o_totalprice, o_custkey AS gone FROM orders WHERE o_orderkey < 500",
        "ALTER TABLE o DROP COLUMN gone",
        "ALTER TABLE o ADD COLUMN st VARCHAR DEFAULT 'OLD'",
        "ALTER TABLE o RENAME COLUMN st TO state",
        "INSERT INTO o SELECT o_orderkey, o_totalprice, 'NEW' FROM orders WHERE o_orderkey BETWEEN 500 AND 600",
        "INSERT INTO o SELECT o_orderkey, o_totalprice, 'NEW' FROM orders WHERE o_orderkey BETWEEN 601 AND 700",
    ):
        e.sql(s)
    return e.sql("SELECT * FROM o")


def _code(e, sql: str) -> str:
    from .errors import LoomError

    try:
        e.sql(sql)
    except LoomError as error:
        return error.code
    return "none"


@program("SELECT * FROM (VALUES ('drop', 'TableNotFound'), ('again', 'none'), ('insert', 'ReadOnlyTable'), ('update', 'ReadOnlyTable'), ('delete', 'ReadOnlyTable'), ('alter', 'ReadOnlyTable'), ('drop file', 'ReadOnlyTable'), ('asof', 'SyntaxError')) t(what, code)")
def statements_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dropped names are gone, and files are read-only."""
    e = _own(spark, sf_dir, "nation", "region")
    e.sql("CREATE TABLE t AS SELECT n_nationkey AS k FROM nation")
    e.sql("DROP TABLE t")
    tried = {
        "drop": "SELECT * FROM t", "again": "DROP TABLE IF EXISTS t", "insert": "INSERT INTO nation SELECT * FROM nation", "update": "UPDATE nation SET n_name = 'x'", "delete": "DELETE FROM nation",
        "alter": "ALTER TABLE nation DROP COLUMN n_name", "drop file": "DROP TABLE nation", "asof": "SELECT n_name FROM nation ASOF JOIN region ON n_regionkey >= r_regionkey",
    }
    return spark.createDataFrame([(what, _code(e, sql)) for what, sql in tried.items()], "what string, code string")


@program("SELECT count(*) > 0 AS scans, count(*) FILTER (WHERE n_regionkey > 2) > 0 AS pushed FROM nation")
def explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = _own(spark, sf_dir, "nation").sql("EXPLAIN SELECT n_name FROM nation WHERE n_regionkey > 2")
    return plan.selectExpr("max(plan like '%nation.parquet%') as scans", "max(plan like '%PushedFilters%GreaterThan(n_regionkey,2)%') as pushed")


@program("SELECT (row_number() OVER (ORDER BY o_orderkey) - 1) // 700 AS batch, o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F'")
def streamed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _own(spark, sf_dir, "orders")
    batches = e.stream("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = ? ORDER BY o_orderkey", ["F"], size=700)
    rows = [(k, r["o_orderkey"], r["o_custkey"]) for k, batch in enumerate(batches) for r in batch]
    return spark.createDataFrame(rows, "batch long, o_orderkey long, o_custkey long")


@program("""SELECT 'csv' AS form, 'r_regionkey,r_name' || chr(10) || string_agg(r_regionkey || ',' || r_name, chr(10) ORDER BY r_regionkey) || chr(10) AS text FROM region
  UNION ALL SELECT 'tsv', 'r_regionkey' || chr(9) || 'r_name' || chr(10) || string_agg(r_regionkey || chr(9) || r_name, chr(10) ORDER BY r_regionkey) || chr(10) FROM region
  UNION ALL SELECT 'list', 'r_regionkey|r_name' || chr(10) || string_agg(r_regionkey || '|' || r_name, chr(10) ORDER BY r_regionkey) || chr(10) FROM region
  UNION ALL SELECT 'jsonlines', string_agg('{"r_regionkey": ' || r_regionkey || ', "r_name": "' || r_name || '"}', chr(10) ORDER BY r_regionkey) || chr(10) FROM region
  UNION ALL SELECT 'json', '[' || string_agg('{"r_regionkey": ' || r_regionkey || ', "r_name": "' || r_name || '"}', ',' || chr(10) ORDER BY r_regionkey) || ']' || chr(10) FROM region
  UNION ALL SELECT 'insert', string_agg('INSERT INTO "table" VALUES(' || r_regionkey || ',' || chr(39) || r_name || chr(39) || ');', chr(10) ORDER BY r_regionkey) || chr(10) FROM region
  UNION ALL SELECT 'line', string_agg('r_regionkey = ' || r_regionkey || chr(10) || '     r_name = ' || r_name || chr(10), chr(10) ORDER BY r_regionkey) FROM region
  UNION ALL SELECT 'markdown', '| r_regionkey | ' || rpad('r_name', max(length(r_name))::INT, ' ') || ' |' || chr(10) || '|-------------|' || repeat('-', (max(length(r_name)) + 2)::INT) || '|' || chr(10) || (SELECT string_agg('| ' || rpad(r_regionkey::VARCHAR, 11, ' ') || ' | ' || rpad(r_name, (SELECT max(length(r_name)) FROM region)::INT, ' ') || ' |', chr(10) ORDER BY r_regionkey) FROM region) || chr(10) FROM region
  UNION ALL SELECT 'trash', '' FROM region WHERE r_regionkey = 0""")
def output_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .cli import render

    df = _own(spark, sf_dir, "region").sql("SELECT r_regionkey, r_name FROM region ORDER BY r_regionkey")
    rows = [tuple(r) for r in df.collect()]
    forms = ("csv", "tsv", "list", "jsonlines", "json", "insert", "line", "markdown", "trash")
    return spark.createDataFrame([(f, render(df.columns, rows, f)) for f in forms], "form string, text string")


@program("SELECT column_name, column_type, \"min\" AS lo, \"max\" AS hi, round(CAST(avg AS DOUBLE), 6) AS mean, round(CAST(std AS DOUBLE), 6) AS dev, \"count\" AS n, CAST(null_percentage AS DOUBLE) AS nulls FROM (SUMMARIZE SELECT o_orderkey, o_custkey, o_orderstatus, nullif(o_orderpriority, '1-URGENT') AS p FROM orders)")
def summarize_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _own(spark, sf_dir, "orders").sql("SUMMARIZE SELECT o_orderkey, o_custkey, o_orderstatus, nullif(o_orderpriority, '1-URGENT') AS p FROM orders")
    return s.selectExpr("column_name", "column_type", "`min` as lo", "`max` as hi", "round(avg, 6) as mean", "round(std, 6) as dev", "`count` as n", "round(null_percentage, 2) as nulls")


_ENGINES: dict = {}


def engine(spark: SparkSession, sf_dir: str):
    """An engine with the driver's tables of ``sf_dir``."""
    from .session import Engine

    key = (id(spark), spark.sparkContext.applicationId, sf_dir)
    if key not in _ENGINES:
        e = Engine(spark)
        for t in TABLES:
            e.register(t, f"{sf_dir}/{t}.parquet")
        _ENGINES[key] = e
    return _ENGINES[key]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query by name: SQL on a shared engine, and programs."""
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: lambda spark, sf_dir, q=sql: engine(spark, sf_dir).sql(q) for name, (sql, _) in SUITE.items()}
    return out | {name: f for name, (f, _) in PROGRAMS.items()}


def oracle_sql() -> dict[str, str]:
    """DuckDB's SQL for each of ``queries()``."""
    return {name: oracle or sql for name, (sql, oracle) in SUITE.items()} | {name: sql for name, (_, sql) in PROGRAMS.items()}
