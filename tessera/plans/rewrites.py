"""Rewrites at DataFrame level that Catalyst does not make by itself, each with a query that shows it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.catalog import query, table


def grouping_sets_lazily(df: DataFrame, sets: Sequence[Sequence[str]], sums: dict[str, Column], counts: str | None = None) -> DataFrame:
    """Grouping sets over a table aggregated once by all keys: what is expanded is groups, not rows. ``sums`` must be additive."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    once = df.groupBy(*keys).agg(*(F.sum(c).alias(n) for n, c in sums.items()), *([F.count("*").alias(counts)] if counts else []))
    rows = [F.struct(F.lit(i).alias("set_"), *(F.col(k) if k in s else F.lit(None).cast(once.schema[k].dataType).alias(k) for k in keys)) for i, s in enumerate(sets)]
    wide = once.select(F.explode(F.array(*(r.cast(f"struct<set_:int,{','.join(f'{k}:{once.schema[k].dataType.simpleString()}' for k in keys)}>") for r in rows))).alias("g_"), *(n for n in once.columns if n not in keys))
    names = [*sums, *([counts] if counts else [])]
    return wide.groupBy("g_").agg(*(F.sum(n).alias(n) for n in names)).select("g_.*", *names).drop("set_")


def unbounded_window(df: DataFrame, keys: Sequence[str], aggregates: dict[str, Column]) -> DataFrame:
    """``agg OVER (PARTITION BY keys)`` as aggregate and null-safe join: no sort of whole partitions, and hot keys are pre-aggregated before the shuffle."""
    once = df.groupBy(*(F.col(k).alias(f"{k}_w") for k in keys)).agg(*(a.alias(n) for n, a in aggregates.items()))
    on = [F.col(k).eqNullSafe(F.col(f"{k}_w")) for k in keys]
    return df.join(once, on).drop(*(f"{k}_w" for k in keys))


def top_k_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each group; Spark turns the filter into a group limit below the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank_", F.row_number().over(w)).where(F.col("rank_") <= k).drop("rank_")


def first_per_group(df: DataFrame, keys: Sequence[str], order: Column, columns: Sequence[str]) -> DataFrame:
    """Row 1 of each group as an aggregate (``min_by``): no sort at all."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(*columns), order).alias("f_")).select(*keys, "f_.*")


def one_scan(df: DataFrame, branches: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Several filtered aggregates of one table in one scan: (condition, aggregate input) by name."""
    return df.agg(*(F.sum(F.when(cond, value)).alias(n) for n, (cond, value) in branches.items()))


def count_distinct_two_phase(df: DataFrame, keys: Sequence[str], column: str, name: str) -> DataFrame:
    """Distinct pairs first, then a plain count: both phases combine map-side."""
    return df.select(*keys, column).distinct().groupBy(*keys).agg(F.count(column).alias(name))


def salted_sum(df: DataFrame, key: str, value: Column, name: str, salts: int = 16) -> DataFrame:
    """A sum by a hot key in two stages."""
    salted = df.withColumn("salt_", F.pmod(F.monotonically_increasing_id(), F.lit(salts)))
    return salted.groupBy(key, "salt_").agg(F.sum(value).alias("part_")).groupBy(key).agg(F.sum("part_").alias(name))


def sum_of_scaled(df: DataFrame, keys: Sequence[str], column: str, factor: float, name: str) -> DataFrame:
    """``sum(x * c)`` as ``c * sum(x)``: one multiplication a group."""
    return df.groupBy(*keys).agg((F.sum(column) * F.lit(factor)).alias(name))


def range_join(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, width: int) -> DataFrame:
    """``low <= at < high`` as an equi-join on buckets of ``width``: each range is copied to the buckets that it touches."""
    p = points.withColumn("b_", F.floor(F.col(at) / width))
    r = ranges.where(F.col(high) > F.col(low)).withColumn("b_", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor((F.col(high) - 1) / width))))
    return p.join(r, "b_").where((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("b_")


def as_of_join(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """For each left row the last right ``value`` of its key at or before it: one union and one window, one shuffle."""
    both = left.select("*", F.lit(None).cast(right.schema[value].dataType).alias(value), F.lit(1).alias("side_")).unionByName(right.select(key, at, value, F.lit(0).alias("side_")), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(at, "side_").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(w)).where("side_ = 1").drop("side_")


@query("rewrite_lazy_grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())")
def lazy_sets(spark, sf_dir):
    return grouping_sets_lazily(table(spark, sf_dir, "orders"), [("o_orderstatus", "o_orderpriority"), ("o_orderstatus",), ()], {}, "n")


@query("rewrite_unbounded_window", "SELECT o_orderkey, o_custkey, count(*) OVER (PARTITION BY o_custkey) AS n, max(o_orderkey) OVER (PARTITION BY o_custkey) AS top FROM orders")
def unbounded(spark, sf_dir):
    return unbounded_window(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ["o_custkey"], {"n": F.count("*"), "top": F.max("o_orderkey")})


@query("rewrite_top_k", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) r FROM orders) t WHERE r <= 3")
def top_k(spark, sf_dir):
    return top_k_per_group(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3).select("o_custkey", "o_orderkey")


@query("rewrite_window_to_aggregate", "SELECT o_custkey, arg_min(o_orderkey, o_orderkey) AS o_orderkey, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY 1")
def window_to_aggregate(spark, sf_dir):
    return first_per_group(table(spark, sf_dir, "orders"), ["o_custkey"], F.col("o_orderkey"), ["o_orderkey", "o_orderstatus"])


@query("rewrite_one_scan", "SELECT sum(CASE WHEN o_orderstatus = 'O' THEN o_orderkey END)::BIGINT AS open, sum(CASE WHEN o_custkey < 50 THEN o_orderkey END)::BIGINT AS low FROM orders")
def scans(spark, sf_dir):
    k = F.col("o_orderkey")
    return one_scan(table(spark, sf_dir, "orders"), {"open": (F.col("o_orderstatus") == "O", k), "low": (F.col("o_custkey") < 50, k)})


@query("rewrite_count_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1")
def distinct_count(spark, sf_dir):
    return count_distinct_two_phase(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_partkey", "n")


@query("rewrite_salted_sum", "SELECT l_returnflag, sum(l_orderkey)::BIGINT AS s FROM lineitem GROUP BY 1")
def hot_sum(spark, sf_dir):
    return salted_sum(table(spark, sf_dir, "lineitem"), "l_returnflag", F.col("l_orderkey"), "s")


@query("rewrite_scaled_sum", "SELECT l_returnflag, round(sum(l_quantity * 3), 2) AS s FROM lineitem GROUP BY 1")
def scaled(spark, sf_dir):
    return sum_of_scaled(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", 3.0, "s").withColumn("s", F.round("s", 2))


@query("rewrite_range_join", "SELECT c_custkey, n_nationkey FROM customer JOIN nation ON c_custkey >= n_nationkey * 10 AND c_custkey < n_nationkey * 10 + 15")
def ranges(spark, sf_dir):
    r = table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") * 10).alias("lo"), (F.col("n_nationkey") * 10 + 15).alias("hi"))
    return range_join(table(spark, sf_dir, "customer").select("c_custkey"), r, "c_custkey", "lo", "hi", 32).select("c_custkey", "n_nationkey")


@query("rewrite_as_of_join", "SELECT a.event_id, b.value FROM (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase') a ASOF LEFT JOIN (SELECT user_id, ts, value FROM events WHERE event_type = 'click') b ON a.user_id = b.user_id AND a.ts >= b.ts")
def as_of(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    left, right = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), e.where("event_type = 'click'").select("user_id", "ts", "value")
    return as_of_join(left, right, "user_id", "ts", "value").select("event_id", "value")


@query("rewrite_date_range", "SELECT count(*) AS n FROM orders WHERE o_orderdate::DATE = DATE '1995-01-05'")
def date_range(spark, sf_dir):
    """A comparison of a date cast as a range on the raw column, which reaches the scan."""
    return table(spark, sf_dir, "orders").where("o_orderdate >= timestamp_ntz'1995-01-05' and o_orderdate < timestamp_ntz'1995-01-06'").agg(F.count("*").alias("n"))
