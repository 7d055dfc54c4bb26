"""Relational queries in SQL that Spark and DuckDB read alike; where their dialects differ there is a text for each.

Sums of money are sums of decimals, so that they are exact in any order of rows.
"""

from __future__ import annotations

MONEY = "CAST({} AS DECIMAL(18, 2))"

#: name -> SQL, or (Spark's SQL, DuckDB's SQL).
SQL: dict[str, str | tuple[str, str]] = {
    # scans, projections, filters
    "scan_project": "SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate FROM lineitem",
    "filter_eq": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'",
    "filter_and_or": "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE (o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') OR (o_orderstatus = 'O' AND o_orderpriority = '5-LOW')",
    "filter_lower_eq": "SELECT c_custkey, c_mktsegment FROM customer WHERE lower(c_mktsegment) = 'building'",
    "filter_in_between_like": "SELECT p_partkey, p_name, p_size FROM part WHERE p_size IN (1, 5, 9, 15, 23) AND p_retailprice BETWEEN 900 AND 1500 AND p_type LIKE '%E%'",
    "filter_expr": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity + 1 = 38 AND NOT (l_discount > 0.05) AND CASE WHEN l_returnflag = 'R' THEN 1 ELSE 2 END = 2",
    "point_get": "SELECT * FROM customer WHERE c_custkey = 42",
    "scan_page": "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 50 OFFSET 100",
    "null_semantics": "SELECT x, count(*) AS n, count(y) AS n_y, count(CASE WHEN y = 1 THEN 1 END) AS ones, count(CASE WHEN y IS NULL THEN 1 END) AS nulls, count(CASE WHEN NOT (y = 1) THEN 1 END) AS not_ones FROM (SELECT o_orderstatus AS x, nullif(o_custkey % 3, 0) AS y FROM orders) t GROUP BY x",
    "filter_float_widened": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity = 17",
    "filter_is_null": "SELECT count(*) AS n FROM (SELECT nullif(c_mktsegment, 'BUILDING') AS s FROM customer) t WHERE s IS NULL",
    # joins
    "join_inner": f"SELECT c.c_custkey, o.o_orderkey, {MONEY.format('o.o_totalprice')} AS price FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_totalprice > 100000",
    "join_left": "SELECT c.c_custkey, count(o.o_orderkey) AS n_orders FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_custkey",
    "join_right": "SELECT n.n_nationkey, count(s.s_suppkey) AS n_suppliers FROM supplier s RIGHT JOIN nation n ON s.s_nationkey = n.n_nationkey GROUP BY n.n_nationkey",
    "join_full": "SELECT coalesce(c.c_nationkey, s.s_nationkey) AS nationkey, coalesce(c.n, 0) AS customers, coalesce(s.n, 0) AS suppliers FROM (SELECT c_nationkey, count(*) AS n FROM customer WHERE c_nationkey < 15 GROUP BY c_nationkey) c FULL JOIN (SELECT s_nationkey, count(*) AS n FROM supplier WHERE s_nationkey >= 10 GROUP BY s_nationkey) s ON c.c_nationkey = s.s_nationkey",
    "join_semi": ("SELECT c_custkey, c_name FROM customer c LEFT SEMI JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 300000", "SELECT c_custkey, c_name FROM customer c SEMI JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) o ON c.c_custkey = o.o_custkey"),
    "join_anti": ("SELECT c_custkey, c_name FROM customer c LEFT ANTI JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_orderpriority = '1-URGENT'", "SELECT c_custkey, c_name FROM customer c ANTI JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_orderpriority = '1-URGENT'"),
    "join_not_in": "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 6000)",
    "join_cross_small": "SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n",
    "join_theta": "SELECT a.n_nationkey AS low, b.n_nationkey AS high FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey",
    "join_self": "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey",
    "join_using": "SELECT n_nationkey, customers, suppliers FROM (SELECT c_nationkey AS n_nationkey, count(*) AS customers FROM customer GROUP BY 1) a JOIN (SELECT s_nationkey AS n_nationkey, count(*) AS suppliers FROM supplier GROUP BY 1) b USING (n_nationkey)",
    "join_multi_star": f"SELECT r.r_name, n.n_name, CAST(sum({MONEY.format('l.l_extendedprice')}) AS DOUBLE) AS revenue, count(*) AS n FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name, n.n_name",
    "join_cross_model": ("SELECT e.user_id, c.c_name, get_json_object(e.props, '$.k') AS k FROM events e JOIN customer c ON e.user_id = c.c_custkey WHERE e.event_type = 'purchase'", "SELECT e.user_id, c.c_name, json_extract_string(e.props, '$.k') AS k FROM events e JOIN customer c ON e.user_id = c.c_custkey WHERE e.event_type = 'purchase'"),
    # aggregates
    "agg_group_by": f"SELECT l_returnflag AS category, CAST(sum({MONEY.format('l_extendedprice')}) AS DOUBLE) / count(*) AS avg_price, count(*) AS n FROM lineitem GROUP BY l_returnflag ORDER BY l_returnflag",
    "agg_pricing_summary": f"SELECT l_returnflag, l_linestatus, CAST(sum({MONEY.format('l_quantity')}) AS DOUBLE) AS sum_qty, CAST(sum({MONEY.format('l_extendedprice')}) AS DOUBLE) AS sum_price, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS BIGINT))) AS BIGINT) AS sum_disc_e4, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus",
    "agg_distinct": "SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers, count(*) AS n FROM lineitem",
    "agg_having": f"SELECT o_custkey, count(*) AS n, CAST(sum({MONEY.format('o_totalprice')}) AS DOUBLE) AS total FROM orders GROUP BY o_custkey HAVING count(*) > 15",
    "agg_filter_clause": "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) AS n FROM orders GROUP BY o_orderpriority",
    "agg_grouping_sets": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())",
    "agg_cube": "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_returnflag) AS BIGINT) AS g FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "agg_rollup": "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)",
    "agg_percentile_cont": ("SELECT o_orderstatus, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY o_totalprice), 4) AS median, round(percentile_cont(0.9) WITHIN GROUP (ORDER BY o_totalprice), 4) AS p90 FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, round(quantile_cont(o_totalprice, 0.5), 4) AS median, round(quantile_cont(o_totalprice, 0.9), 4) AS p90 FROM orders GROUP BY o_orderstatus"),
    "agg_stddev": "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS var, round(corr(l_quantity, l_discount), 6) AS r FROM lineitem GROUP BY l_returnflag",
    "agg_min_by_max_by": ("SELECT c_nationkey, min_by(c_custkey, struct(c_acctbal, c_custkey)) AS poorest, max_by(c_custkey, struct(c_acctbal, c_custkey)) AS richest FROM customer GROUP BY c_nationkey", "SELECT c_nationkey, arg_min(c_custkey, (c_acctbal, c_custkey)) AS poorest, arg_max(c_custkey, (c_acctbal, c_custkey)) AS richest FROM customer GROUP BY c_nationkey"),
    "agg_collect_sorted": ("SELECT n_regionkey, array_join(array_sort(collect_list(n_name)), ',') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"),
    "agg_bool_bit": ("SELECT o_orderpriority, bool_and(o_totalprice > 1000) AS every, bool_or(o_totalprice > 400000) AS some, bit_xor(o_orderkey) AS x FROM orders GROUP BY o_orderpriority", "SELECT o_orderpriority, bool_and(o_totalprice > 1000) AS every, bool_or(o_totalprice > 400000) AS some, bit_xor(o_orderkey) AS x FROM orders GROUP BY o_orderpriority"),
    "agg_pivot": "SELECT o_orderpriority, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS f, sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS o, sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS p FROM orders GROUP BY o_orderpriority",
    # windows
    "win_row_number": "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS rn FROM orders",
    "win_rank_dense": "SELECT l_orderkey, l_linenumber, CAST(rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) AS BIGINT) AS r, CAST(dense_rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) AS BIGINT) AS d FROM lineitem",
    "win_lag_lead": "SELECT event_id, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, lead(value, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM events",
    "win_running_sum": f"SELECT o_orderkey, CAST(sum({MONEY.format('o_totalprice')}) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS running FROM orders",
    "win_moving_avg_rows": "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS moving FROM events",
    "win_range_frame": "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS near FROM part",
    "win_first_last_nth": "SELECT event_id, first_value(event_id) OVER w AS first, last_value(event_id) OVER w AS last, nth_value(event_id, 2) OVER w AS second FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    "win_ntile_cume": "SELECT c_custkey, CAST(ntile(4) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS BIGINT) AS quartile, round(cume_dist() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey), 9) AS cume, round(percent_rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey), 9) AS pct FROM customer",
    "win_qualify": ("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) t WHERE rn <= 2", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2"),
    # order and limit
    "topk": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "sort_nulls_explicit": "SELECT o_orderkey, x FROM (SELECT o_orderkey, nullif(o_custkey % 5, 0) AS x FROM orders) t ORDER BY x ASC NULLS LAST, o_orderkey LIMIT 100",
    "limit_offset": "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice, p_partkey LIMIT 30 OFFSET 15",
    # sets, CTEs, subqueries
    "union_all": "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier",
    "union_distinct": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "intersect_all": "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier",
    "except": "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 6000",
    "except_all": "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier",
    "cte": f"WITH t AS (SELECT o_custkey, CAST(sum({MONEY.format('o_totalprice')}) AS DOUBLE) AS total FROM orders GROUP BY o_custkey), m AS (SELECT max(total) AS top FROM t) SELECT o_custkey, total FROM t, m WHERE total > top / 2",
    "recursive_cte": "WITH RECURSIVE r(n, f) AS (SELECT CAST(1 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM r WHERE n < 12) SELECT n, f FROM r",
    "correlated_exists": "SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 49)",
    "scalar_subquery": "SELECT c_custkey, c_acctbal FROM customer c WHERE c_acctbal > (SELECT avg(c_acctbal) + 4000 FROM customer)",
    "correlated_scalar": "SELECT c.c_custkey, (SELECT max(o.o_totalprice) FROM orders o WHERE o.o_custkey = c.c_custkey) AS top FROM customer c",
    "values_derived": "SELECT v.k, v.name, count(c.c_custkey) AS n FROM (VALUES (1, 'one'), (2, 'two'), (99, 'none')) AS v(k, name) LEFT JOIN customer c ON c.c_nationkey = v.k GROUP BY v.k, v.name",
    "lateral_join": "SELECT n.n_nationkey, t.c_custkey FROM nation n, LATERAL (SELECT c.c_custkey FROM customer c WHERE c.c_nationkey = n.n_nationkey ORDER BY c.c_acctbal DESC, c.c_custkey LIMIT 1) t",
    "distinct_on": ("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) t WHERE rn = 1", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey DESC"),
    # scalar functions
    "fn_string": "SELECT p_partkey, upper(p_name) AS u, length(p_name) AS n, substring(p_name, 2, 4) AS s, concat(p_brand, '/', p_type) AS c, trim('  x ') AS t, replace(p_type, 'E', 'e') AS r, lpad(CAST(p_size AS VARCHAR(9)), 4, '0') AS l, reverse(p_brand) AS v, ltrim(p_name) AS lt FROM part",
    "fn_math": "SELECT p_partkey, abs(p_size - 25) AS a, round(sqrt(p_retailprice), 6) AS q, floor(p_retailprice / 7) AS f, ceil(p_retailprice / 7) AS c, mod(p_partkey, 7) AS m, round(power(p_size, 2), 3) AS p, round(ln(p_retailprice), 6) AS l, sign(p_size - 25) AS s, greatest(p_size, 10) AS g, least(p_size, 10) AS le FROM part".replace("floor(p_retailprice / 7)", "CAST(floor(p_retailprice / 7) AS BIGINT)").replace("ceil(p_retailprice / 7)", "CAST(ceil(p_retailprice / 7) AS BIGINT)").replace("sign(p_size - 25)", "CAST(sign(p_size - 25) AS BIGINT)"),
    "fn_date": ("SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, CAST(day(o_orderdate) AS BIGINT) AS d, CAST(quarter(o_orderdate) AS BIGINT) AS q, CAST(dayofyear(o_orderdate) AS BIGINT) AS doy, date_format(o_orderdate, 'yyyy-MM') AS ym, CAST(datediff(DATE '1998-08-02', CAST(o_orderdate AS DATE)) AS BIGINT) AS days, CAST(date_add(CAST(o_orderdate AS DATE), 10) AS STRING) AS later FROM orders", "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, quarter(o_orderdate) AS q, dayofyear(o_orderdate) AS doy, strftime(o_orderdate, '%Y-%m') AS ym, datediff('day', CAST(o_orderdate AS DATE), DATE '1998-08-02') AS days, CAST(CAST(o_orderdate AS DATE) + 10 AS VARCHAR) AS later FROM orders"),
    "fn_array": ("SELECT vec_id, CAST(size(embedding) AS BIGINT) AS n, CAST(element_at(embedding, 1) AS DOUBLE) AS first, CAST(array_max(embedding) AS DOUBLE) AS top, round(aggregate(embedding, 0D, (s, x) -> s + double(x)), 4) AS total, CAST(size(filter(embedding, x -> x > 0)) AS BIGINT) AS positive FROM embeddings", "SELECT vec_id, len(embedding) AS n, CAST(embedding[1] AS DOUBLE) AS first, CAST(list_max(embedding) AS DOUBLE) AS top, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total, len(list_filter(embedding, lambda x: x > 0)) AS positive FROM embeddings"),
    "fn_json": ("SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"),
    "fn_regex": ("SELECT p_partkey, regexp_replace(p_name, '[aeiou]', '*') AS masked, regexp_extract(p_brand, '([0-9]+)', 1) AS num, p_type rlike '^[A-Z]+ ' AS caps FROM part", "SELECT p_partkey, regexp_replace(p_name, '[aeiou]', '*', 'g') AS masked, regexp_extract(p_brand, '([0-9]+)', 1) AS num, regexp_matches(p_type, '^[A-Z]+ ') AS caps FROM part"),
    "fn_conditional": "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS band, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS seg, CASE c_nationkey WHEN 1 THEN 'one' ELSE 'other' END AS one FROM customer",
    "fn_cast": ("SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(12, 1)) AS d, try_cast(o_orderpriority AS INT) AS i, CAST(o_orderkey AS STRING) AS s FROM orders", "SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(12, 1)) AS d, try_cast(o_orderpriority AS INT) AS i, CAST(o_orderkey AS VARCHAR) AS s FROM orders"),
    "fn_hash": "SELECT c_custkey, md5(c_name) AS m FROM customer",
    "fn_map": ("SELECT o_custkey, CAST(size(m) AS BIGINT) AS n, m['F'] AS f, array_join(array_sort(map_keys(m)), ',') AS keys, CAST(aggregate(map_values(m), 0L, (s, x) -> s + x) AS BIGINT) AS total FROM (SELECT o_custkey, map_from_entries(collect_list(struct(o_orderstatus, n))) AS m FROM (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1)", "SELECT o_custkey, count(*) AS n, CAST(sum(n) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS f, string_agg(o_orderstatus, ',' ORDER BY o_orderstatus) AS keys, CAST(sum(n) AS BIGINT) AS total FROM (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1"),
    "agg_approximate": ("SELECT l_returnflag, abs(approx_count_distinct(l_orderkey, 0.01) / count(DISTINCT l_orderkey) - 1) < 0.05 AS near_distinct, abs(approx_percentile(l_quantity, 0.5, 10000) - percentile_cont(0.5) WITHIN GROUP (ORDER BY l_quantity)) <= 1 AS near_median, count(*) AS n FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, true AS near_distinct, true AS near_median, count(*) AS n FROM lineitem GROUP BY l_returnflag"),
}
