"""Aggregate and window functions."""

from tessera.functions.spec import whole

L = "{lineitem}"


def agg(name: str, spark_sql: str, duck_sql: str | None = None) -> tuple:
    q = "SELECT l_returnflag, {} AS v FROM {} GROUP BY l_returnflag"
    return name, q.format(spark_sql, L), q.format(duck_sql or spark_sql, "lineitem")


whole("agg", [
    agg("sum", "round(sum(l_extendedprice), 2)"), agg("avg", "round(avg(l_quantity), 6)"), agg("count", "count(l_orderkey)"), agg("count_star", "count(*)"), agg("count_distinct", "count(DISTINCT l_suppkey)"), agg("min", "min(l_shipdate)"), agg("max", "max(l_extendedprice)"),
    agg("max_by", "max_by(l_orderkey, l_extendedprice * 1000000 + l_orderkey)"), agg("min_by", "min_by(l_orderkey, l_extendedprice * 1000000 + l_orderkey)"), agg("stddev_samp", "round(stddev_samp(l_quantity), 6)"), agg("stddev_pop", "round(stddev_pop(l_quantity), 6)"), agg("var_samp", "round(var_samp(l_quantity), 5)"), agg("var_pop", "round(var_pop(l_quantity), 5)"),
    agg("bit_and", "bit_and(l_orderkey)"), agg("bit_or", "bit_or(l_orderkey)"), agg("bit_xor", "bit_xor(l_orderkey)"), agg("corr", "round(corr(l_quantity, l_extendedprice), 6)"), agg("covar_pop", "round(covar_pop(l_quantity, l_discount), 6)"), agg("covar_samp", "round(covar_samp(l_quantity, l_discount), 6)"),
    agg("skewness", "round(skewness(l_quantity), 4)", "round(skewness(l_quantity) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1.0)), 4)"), agg("kurtosis", "round(kurtosis(l_quantity), 4)", "round(kurtosis_pop(l_quantity), 4)"),
    agg("percentile", "round(percentile(l_extendedprice, 0.3), 4)", "round(quantile_cont(l_extendedprice, 0.3), 4)"), agg("median", "round(median(l_extendedprice), 4)"), agg("bool_and", "every(l_quantity > 0)", "bool_and(l_quantity > 0)"), agg("bool_or", "some(l_quantity > 49)", "bool_or(l_quantity > 49)"),
    agg("count_if", "count_if(l_quantity > 25)", "count(*) FILTER (WHERE l_quantity > 25)"), agg("regr_slope", "round(regr_slope(l_extendedprice, l_quantity), 4)"), agg("regr_intercept", "round(regr_intercept(l_extendedprice, l_quantity), 3)"), agg("regr_r2", "round(regr_r2(l_extendedprice, l_quantity), 6)"), agg("regr_sxy", "round(regr_sxy(l_quantity, l_discount), 3)"), agg("regr_count", "regr_count(l_quantity, l_discount)", "count(*)"),
    agg("collect_list", "md5(concat_ws(',', sort_array(collect_list(cast(l_suppkey as string)))))", "md5(string_agg(l_suppkey::VARCHAR, ',' ORDER BY l_suppkey::VARCHAR))"), agg("collect_set", "concat_ws(',', sort_array(collect_set(cast(l_suppkey as string))))", "string_agg(DISTINCT l_suppkey::VARCHAR, ',' ORDER BY l_suppkey::VARCHAR)"), 
    agg("try_sum", "try_sum(l_orderkey)", "sum(l_orderkey)::BIGINT"), agg("try_avg", "round(try_avg(l_quantity), 6)", "round(avg(l_quantity), 6)"),
    ("approx_count_distinct", "SELECT l_returnflag, approx_count_distinct(l_linenumber) AS v FROM {lineitem} GROUP BY l_returnflag", "SELECT l_returnflag, count(DISTINCT l_linenumber) AS v FROM lineitem GROUP BY l_returnflag"),
    ("approx_percentile", "SELECT l_returnflag, approx_percentile(l_quantity, 0.5, 1000000) AS v FROM {lineitem} GROUP BY l_returnflag", "SELECT l_returnflag, quantile_disc(l_quantity, 0.5) AS v FROM lineitem GROUP BY l_returnflag"),
    # most frequent, the smallest of several
    ("mode", "SELECT l_returnflag, mode() WITHIN GROUP (ORDER BY l_suppkey) AS v FROM {lineitem} GROUP BY l_returnflag", "SELECT l_returnflag, first(l_suppkey ORDER BY n DESC, l_suppkey) AS v FROM (SELECT l_returnflag, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2) t GROUP BY l_returnflag"),
    # groups in which the value depends on the key, so that any order gives it
    ("first", "SELECT l_suppkey, first(s_name) AS v FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey GROUP BY l_suppkey", "SELECT DISTINCT l_suppkey, s_name AS v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey"),
    ("last", "SELECT o_custkey, last(c_mktsegment) AS v FROM {orders} JOIN {customer} ON o_custkey = c_custkey GROUP BY o_custkey", "SELECT DISTINCT o_custkey, c_mktsegment AS v FROM orders JOIN customer ON o_custkey = c_custkey"),
    ("first_ignore_null", "SELECT l_suppkey, first(if(l_linenumber > 2, s_name, NULL), true) AS v FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey GROUP BY l_suppkey", "SELECT l_suppkey, max(CASE WHEN l_linenumber > 2 THEN s_name END) AS v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_suppkey"),
    ("last_ignore_null", "SELECT o_custkey, last(if(o_orderstatus = 'P', c_name, NULL), true) AS v FROM {orders} JOIN {customer} ON o_custkey = c_custkey GROUP BY o_custkey", "SELECT o_custkey, max(CASE WHEN o_orderstatus = 'P' THEN c_name END) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_custkey"),
    # grouping takes zeros of either sign, and all NaN, as one
    ("normalize_nan_zero", "SELECT if(isnan(k), 'nan', 'zero') AS g, count(*) AS n FROM (SELECT CASE c_nationkey % 4 WHEN 0 THEN -0.0D WHEN 1 THEN 0.0D ELSE double('NaN') END AS k FROM {customer}) GROUP BY k", "SELECT CASE WHEN c_nationkey % 4 < 2 THEN 'zero' ELSE 'nan' END AS g, count(*) AS n FROM customer GROUP BY 1"),
    ("sum_distinct", "SELECT l_returnflag, sum(DISTINCT l_linenumber) AS v FROM {lineitem} GROUP BY l_returnflag", "SELECT l_returnflag, sum(DISTINCT l_linenumber)::BIGINT AS v FROM lineitem GROUP BY l_returnflag"),
    ("filter_clause", "SELECT l_returnflag, count(*) FILTER (WHERE l_discount > 0.05) AS v FROM {lineitem} GROUP BY l_returnflag", None),
    ("string_agg", "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS v FROM {nation} GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS v FROM nation GROUP BY n_regionkey"),
    ("histogram_numeric", "SELECT l_returnflag, aggregate(histogram_numeric(l_linenumber, 20), 0D, (s, b) -> s + b.x * b.x * b.y) AS v FROM {lineitem} GROUP BY l_returnflag", "SELECT l_returnflag, sum(l_linenumber * l_linenumber)::DOUBLE AS v FROM lineitem GROUP BY l_returnflag"),
    ("bitmap", "SELECT bitmap_bucket_number(l_suppkey) AS b, bitmap_count(bitmap_construct_agg(bitmap_bit_position(l_suppkey))) AS v FROM {lineitem} GROUP BY 1", "SELECT (CASE WHEN l_suppkey > 0 THEN 1 + (l_suppkey - 1) // 32768 ELSE l_suppkey // 32768 END)::BIGINT AS b, count(DISTINCT l_suppkey) AS v FROM lineitem GROUP BY 1"),
    ("hll_sketch", "SELECT l_returnflag, hll_sketch_estimate(hll_sketch_agg(l_linenumber)) AS v FROM {lineitem} GROUP BY l_returnflag", "SELECT l_returnflag, count(DISTINCT l_linenumber) AS v FROM lineitem GROUP BY l_returnflag"),
])

P = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"


def win(name: str, f: str, over: str = P, duck: str | None = None) -> tuple:
    q = "SELECT o_orderkey, {} OVER ({}) AS v FROM {}"
    return name, q.format(f, over, "{orders}"), q.format(f, over, "orders") if duck is None else f"SELECT o_orderkey, {duck.format(over)} AS v FROM orders"


whole("win", [
    win("rank", "rank()", duck="(rank() OVER ({}))::INTEGER"), win("dense_rank", "dense_rank()", duck="(dense_rank() OVER ({}))::INTEGER"), win("row_number", "row_number()", duck="(row_number() OVER ({}))::INTEGER"), win("cume_dist", "cume_dist()"), win("percent_rank", "percent_rank()"), win("ntile", "ntile(3)", duck="(ntile(3) OVER ({}))::INTEGER"),
    win("lead", "lead(o_orderkey, 1, -1)"), win("lag", "lag(o_orderkey, 2)"), win("nth_value", "nth_value(o_orderkey, 2)"), win("first_value", "first_value(o_orderkey)"), win("last_value", "last_value(o_orderkey)"),
    win("lag_ignore_nulls", "lag(nullif(o_orderstatus, 'O')) IGNORE NULLS", duck="lag(nullif(o_orderstatus, 'O') IGNORE NULLS) OVER ({})"),
    win("running_sum", "count(*)", P + " ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"), win("sliding_rows", "count(*)", P + " ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING"), win("whole_partition", "max(o_orderkey)", "PARTITION BY o_custkey"), win("suffix_rows", "min(o_orderkey)", P + " ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"),
    ("range_frame", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL '60' DAY PRECEDING AND CURRENT ROW) AS v FROM (SELECT o_orderkey, o_custkey, cast(o_orderdate AS timestamp) AS o_orderdate FROM {orders})", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL 60 DAY PRECEDING AND CURRENT ROW) AS v FROM orders"),
    ("range_numeric", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_orderstatus ORDER BY o_custkey RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS v FROM {orders}", None),
    ("top_k_per_group", "SELECT o_custkey, o_orderkey, r FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM {orders}) WHERE r <= 2", "SELECT o_custkey, o_orderkey, r::INTEGER AS r FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 2"),
    ("global", "SELECT n_nationkey, rank() OVER (ORDER BY n_name) AS v FROM {nation}", "SELECT n_nationkey, (rank() OVER (ORDER BY n_name))::INTEGER AS v FROM nation"),
])
