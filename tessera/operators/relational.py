"""Relational operators as single statements: projections, predicates, joins, aggregation shapes, sorts, set operations, subqueries.

Broadcasts are left to Catalyst's size threshold and adaptive execution; hints appear only
in the queries that show the physical strategy of that name.
"""

from tessera.functions.spec import whole

Q = {
    "filter": ("SELECT l_orderkey, l_linenumber FROM {lineitem} WHERE l_discount > 0.05 AND l_quantity < 10 AND l_returnflag <> 'N'", None),
    "project": ("SELECT o_orderkey, o_orderkey * 2 AS twice, upper(o_orderstatus) AS s FROM {orders}", None),
    "expand": ("SELECT l_returnflag, l_linestatus, count(*) AS n, grouping_id(l_returnflag, l_linestatus) AS g FROM {lineitem} GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())", "SELECT l_returnflag, l_linestatus, count(*) AS n, grouping_id(l_returnflag, l_linestatus)::BIGINT AS g FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())"),
    "cube": ("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY CUBE (o_orderstatus, o_orderpriority)", None),
    "rollup": ("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY ROLLUP (o_orderstatus, o_orderpriority)", None),
    "grouping": ("SELECT o_orderstatus, grouping(o_orderstatus) AS g, count(*) AS n FROM {orders} GROUP BY ROLLUP (o_orderstatus)", "SELECT o_orderstatus, grouping(o_orderstatus)::TINYINT AS g, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus)"),
    "inner_join": ("SELECT o_orderkey, c_name FROM {orders} JOIN {customer} ON o_custkey = c_custkey", None),
    "left_join": ("SELECT c_custkey, o_orderkey FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey AND o_totalprice > 200000", None),
    "right_join": ("SELECT c_custkey, o_orderkey FROM {orders} RIGHT JOIN {customer} ON c_custkey = o_custkey AND o_totalprice > 200000", None),
    "full_join": ("SELECT s_suppkey, c_custkey FROM {supplier} FULL JOIN {customer} ON s_suppkey = c_custkey", None),
    "semi_join": ("SELECT c_custkey FROM {customer} LEFT SEMI JOIN {orders} ON c_custkey = o_custkey", "SELECT c_custkey FROM customer SEMI JOIN orders ON c_custkey = o_custkey"),
    "anti_join": ("SELECT c_custkey FROM {customer} LEFT ANTI JOIN {orders} ON c_custkey = o_custkey", "SELECT c_custkey FROM customer ANTI JOIN orders ON c_custkey = o_custkey"),
    "existence_join": ("SELECT c_custkey, c_acctbal > 5000 OR EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey) AS e FROM {customer}", None),
    "null_aware_anti_join": ("SELECT c_custkey FROM {customer} WHERE c_custkey NOT IN (SELECT o_custkey FROM {orders})", None),
    "null_safe_join": ("SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM (SELECT n_nationkey, nullif(n_regionkey, 0) AS k FROM {nation}) a JOIN (SELECT n_nationkey, nullif(n_regionkey, 0) AS k FROM {nation}) b ON a.k <=> b.k", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM (SELECT n_nationkey, nullif(n_regionkey, 0) AS k FROM nation) a JOIN (SELECT n_nationkey, nullif(n_regionkey, 0) AS k FROM nation) b ON a.k IS NOT DISTINCT FROM b.k"),
    "broadcast_hash_join": ("SELECT /*+ BROADCAST(n) */ s_suppkey, n_name FROM {supplier} JOIN {nation} n ON s_nationkey = n_nationkey", "SELECT s_suppkey, n_name FROM supplier JOIN nation n ON s_nationkey = n_nationkey"),
    "shuffled_hash_join": ("SELECT /*+ SHUFFLE_HASH(c) */ o_orderkey, c_nationkey FROM {orders} JOIN {customer} c ON o_custkey = c_custkey", "SELECT o_orderkey, c_nationkey FROM orders JOIN customer c ON o_custkey = c_custkey"),
    "sort_merge_join": ("SELECT /*+ MERGE(l) */ o_orderkey, l_linenumber FROM {orders} JOIN {lineitem} l ON o_orderkey = l_orderkey WHERE o_orderpriority LIKE '1%'", "SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem l ON o_orderkey = l_orderkey WHERE o_orderpriority LIKE '1%'"),
    "nested_loop_join": ("SELECT s_suppkey, r_name FROM {supplier} JOIN {region} ON s_nationkey > r_regionkey * 5", None),
    "nested_loop_left": ("SELECT s_suppkey, r_name FROM {supplier} LEFT JOIN {region} ON s_nationkey < r_regionkey", None),
    "cartesian": ("SELECT a.r_name AS x, b.n_name AS y FROM {region} a CROSS JOIN {nation} b", None),
    "residual_join": ("SELECT o_orderkey, l_linenumber FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey AND l_extendedprice > o_totalprice / 2", None),
    "self_join": ("SELECT a.n_name AS x, b.n_name AS y FROM {nation} a JOIN {nation} b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", None),
    # The subquery also returns the price: Spark drops the order of a correlated LIMIT whose columns are not all returned, and takes any order of the customer.
    "lateral_join": ("SELECT c_custkey, t.o_orderkey FROM {customer}, LATERAL (SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey NULLS LAST LIMIT 1) t", "SELECT c_custkey, t.o_orderkey FROM customer, LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) t"),
    "using_join": ("SELECT n_nationkey, r_regionkey FROM {nation} JOIN (SELECT r_regionkey, r_regionkey AS n_regionkey FROM {region}) USING (n_regionkey)", None),
    "natural_join": ("SELECT n_nationkey, r_name FROM {nation} NATURAL JOIN (SELECT r_name, r_regionkey AS n_regionkey FROM {region})", "SELECT n_nationkey, r_name FROM nation NATURAL JOIN (SELECT r_name, r_regionkey AS n_regionkey FROM region) t"),
    "scalar_subquery": ("SELECT o_orderkey FROM {orders} o WHERE o_totalprice > (SELECT avg(o_totalprice) FROM {orders} i WHERE i.o_custkey = o.o_custkey)", None),
    "in_subquery": ("SELECT s_suppkey FROM {supplier} WHERE s_nationkey IN (SELECT n_nationkey FROM {nation} WHERE n_regionkey = 1)", None),
    "exists_subquery": ("SELECT c_custkey FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 250000)", None),
    "not_exists_subquery": ("SELECT c_custkey FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 250000)", None),
    "pivot": ("SELECT * FROM (SELECT o_orderstatus, o_orderpriority, 1 AS one FROM {orders}) PIVOT (sum(one) FOR o_orderstatus IN ('O' AS open, 'F' AS done))", "SELECT o_orderpriority, sum(CASE WHEN o_orderstatus = 'O' THEN 1 END)::BIGINT AS open, sum(CASE WHEN o_orderstatus = 'F' THEN 1 END)::BIGINT AS done FROM orders GROUP BY 1"),
    "unpivot": ("SELECT n_nationkey, k, v FROM {nation} UNPIVOT (v FOR k IN (n_regionkey AS r))", "SELECT n_nationkey, 'r' AS k, n_regionkey AS v FROM nation"),
    "cte": ("WITH a AS (SELECT n_regionkey AS k, count(*) AS n FROM {nation} GROUP BY 1), b AS (SELECT max(n) AS m FROM a) SELECT k, n FROM a JOIN b ON n = m", None),
    "recursive_cte": ("WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 10) SELECT n FROM t", None),
    "inline_table": ("SELECT a, b FROM VALUES (1, 'x'), (2, 'y'), (3, NULL) AS t(a, b)", "SELECT * FROM (VALUES (1, 'x'), (2, 'y'), (3, NULL)) AS t(a, b)"),
    "union_all": ("SELECT n_nationkey AS k FROM {nation} UNION ALL SELECT r_regionkey FROM {region}", None), "union": ("SELECT n_regionkey AS k FROM {nation} UNION SELECT r_regionkey FROM {region}", None),
    "intersect": ("SELECT c_nationkey AS k FROM {customer} INTERSECT SELECT s_nationkey FROM {supplier}", None), "intersect_all": ("SELECT c_nationkey AS k FROM {customer} INTERSECT ALL SELECT s_nationkey FROM {supplier}", None),
    "except": ("SELECT c_nationkey AS k FROM {customer} EXCEPT SELECT s_nationkey FROM {supplier}", None), "except_all": ("SELECT c_nationkey AS k FROM {customer} EXCEPT ALL SELECT s_nationkey FROM {supplier}", None),
    "distinct": ("SELECT DISTINCT o_orderstatus, o_orderpriority FROM {orders}", None), "having": ("SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey HAVING count(*) > 12", None),
    "hash_aggregate": ("SELECT l_suppkey, count(*) AS n, min(l_quantity) AS lo FROM {lineitem} GROUP BY l_suppkey", None), "sort_aggregate": ("SELECT l_returnflag, max(l_shipdate) AS d, min(l_linestatus) AS s FROM {lineitem} GROUP BY l_returnflag", None),
    "multi_distinct": ("SELECT l_returnflag, count(DISTINCT l_suppkey) AS a, count(DISTINCT l_partkey) AS b, count(*) AS c FROM {lineitem} GROUP BY l_returnflag", None), "global_aggregate": ("SELECT count(*) AS n, round(sum(l_quantity), 2) AS q FROM {lineitem}", None),
    "empty_aggregate": ("SELECT count(*) AS n, max(o_orderkey) AS m FROM {orders} WHERE o_orderkey < 0", None), "group_by_expression": ("SELECT year(o_orderdate) AS y, count(*) AS n FROM {orders} GROUP BY year(o_orderdate)", "SELECT year(o_orderdate)::INTEGER AS y, count(*) AS n FROM orders GROUP BY 1"),
    "group_by_struct": ("SELECT k.a AS a, k.b AS b, n FROM (SELECT struct(o_orderstatus AS a, o_orderpriority AS b) AS k, count(*) AS n FROM {orders} GROUP BY 1)", "SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY 1, 2"),
    "sort": ("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS r FROM {orders} ORDER BY r", "SELECT o_orderkey, (row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey))::INTEGER AS r FROM orders"),
    "top_k": ("SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 10", None), "limit_offset": ("SELECT o_orderkey FROM {orders} ORDER BY o_orderkey LIMIT 10 OFFSET 5", None), "nulls_order": ("SELECT k FROM (SELECT nullif(n_nationkey, 3) AS k FROM {nation}) ORDER BY k DESC NULLS LAST LIMIT 24", None),
    "window_group_limit": ("SELECT o_custkey, o_orderkey FROM (SELECT *, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS r FROM {orders}) WHERE r <= 3", None),
    "case_pivot": ("SELECT l_returnflag, sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS o FROM {lineitem} GROUP BY 1", "SELECT l_returnflag, sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END)::BIGINT AS o FROM lineitem GROUP BY 1"),
    "group_by_all": ("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY ALL", None), "group_by_ordinal": ("SELECT o_orderstatus, count(*) AS n FROM {orders} GROUP BY 1", None), "group_by_alias": ("SELECT o_custkey % 10 AS k, count(*) AS n FROM {orders} GROUP BY k", None),
    "empty_project": ("SELECT count(1) AS n FROM {lineitem}", None), "group_limit": ("SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey ORDER BY o_custkey LIMIT 5", None), "aggregate_over_window": ("SELECT o_orderstatus, sum(count(*)) OVER (ORDER BY o_orderstatus) AS n FROM {orders} GROUP BY o_orderstatus", "SELECT o_orderstatus, (sum(count(*)) OVER (ORDER BY o_orderstatus))::BIGINT AS n FROM orders GROUP BY o_orderstatus"),
    "groups_frame": ("SELECT o_orderkey, count(*) OVER (PARTITION BY o_orderstatus ORDER BY g RANGE BETWEEN 1 PRECEDING AND CURRENT ROW) AS n FROM (SELECT *, dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_custkey) AS g FROM {orders})", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_orderstatus ORDER BY o_custkey GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS n FROM orders"),
    "lag_negative": ("SELECT o_orderkey, lag(o_orderkey, -1, -7) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS v FROM {orders}", "SELECT o_orderkey, lead(o_orderkey, 1, -7) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS v FROM orders"),
    "map_key_partition": ("SELECT k['a'] AS a, count(*) AS n FROM (SELECT map('a', o_custkey % 5) AS k FROM {orders}) GROUP BY k['a']", "SELECT o_custkey % 5 AS a, count(*) AS n FROM orders GROUP BY 1"),
    "table_valued_function": ("SELECT a.id AS x, b.col AS y FROM range(5) a, LATERAL explode(sequence(1L, a.id + 1)) b", "SELECT a.i AS x, b.j AS y FROM range(5) a(i), LATERAL (SELECT unnest(range(1, a.i + 2)) AS j) b"),
}

whole("rel", [(n, s, d) for n, (s, d) in Q.items()])
