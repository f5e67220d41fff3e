"""Physical strategies and rewrites beyond the plain operators: every join type by hash and by merge, joins on alternatives, runtime pruning, group limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.catalog import query, table
from tessera.functions.spec import whole
from tessera.sources.shared import folder

_RICH = "(SELECT o_orderkey, o_custkey FROM {orders} WHERE o_totalprice > 200000)"
_JOINS = {
    "left": ("SELECT /*+ {hint}(o) */ c_custkey, o_orderkey FROM {customer} LEFT JOIN {rich} o ON c_custkey = o_custkey", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN {rich} o ON c_custkey = o_custkey"),
    "right": ("SELECT /*+ {hint}(c) */ c_custkey, o_orderkey FROM {customer} c RIGHT JOIN {rich} o ON c_custkey = o_custkey AND c_acctbal > 0", "SELECT c_custkey, o_orderkey FROM customer RIGHT JOIN {rich} o ON c_custkey = o_custkey AND c_acctbal > 0"),
    "full": ("SELECT /*+ {hint}(s) */ c_custkey, s_suppkey FROM {customer} FULL JOIN {supplier} s ON c_custkey = s_suppkey * 20", "SELECT c_custkey, s_suppkey FROM customer FULL JOIN supplier ON c_custkey = s_suppkey * 20"),
    "semi": ("SELECT /*+ {hint}(o) */ c_custkey FROM {customer} LEFT SEMI JOIN {rich} o ON c_custkey = o_custkey", "SELECT c_custkey FROM customer SEMI JOIN {rich} o ON c_custkey = o_custkey"),
    "anti": ("SELECT /*+ {hint}(o) */ c_custkey FROM {customer} LEFT ANTI JOIN {rich} o ON c_custkey = o_custkey", "SELECT c_custkey FROM customer ANTI JOIN {rich} o ON c_custkey = o_custkey"),
}
_PLAIN = _RICH.replace("{", "").replace("}", "")
for _name, _hint in (("shuffled_hash", "SHUFFLE_HASH"), ("sort_merge", "MERGE")):
    whole("rel", [(f"{_name}_{kind}", a.replace("{hint}", _hint).replace("{rich}", _RICH), b.replace("{rich}", _PLAIN)) for kind, (a, b) in _JOINS.items()])

whole("rel", [
    ("nested_cte", "WITH a AS (WITH b AS (SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY 1) SELECT n, count(*) AS m FROM b GROUP BY n) SELECT n, m FROM a WHERE m > 1", "WITH a AS (WITH b AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT n, count(*) AS m FROM b GROUP BY n) SELECT n, m FROM a WHERE m > 1"),
    ("window_collect", "SELECT o_orderkey, concat_ws(',', collect_list(cast(o_orderkey as string)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) AS v FROM {orders}", "SELECT o_orderkey, string_agg(o_orderkey::VARCHAR, ',') OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS v FROM orders"),
    ("window_collect_set", "SELECT n_nationkey, concat_ws(',', sort_array(collect_set(cast(n_regionkey as string)) OVER (ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))) AS v FROM {nation}", "SELECT a.n_nationkey, string_agg(DISTINCT b.n_regionkey::VARCHAR, ',' ORDER BY b.n_regionkey::VARCHAR) AS v FROM nation a JOIN nation b ON b.n_nationkey <= a.n_nationkey GROUP BY 1"),
    # groups that stay below a limit of an ordering by the grouping key: the limit goes below the final aggregate
    ("aggregate_group_limit", "SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top FROM {orders} GROUP BY o_custkey ORDER BY o_custkey LIMIT 25", None),
    ("script_transform", "SELECT TRANSFORM (n_nationkey, n_name) USING 'cat' AS (n_nationkey INT, n_name STRING) FROM {nation}", "SELECT n_nationkey, n_name FROM nation"),
])


def any_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, value: str) -> DataFrame:
    """One match of each left row, the least ``value``: the right side is cut to one row a key before the join, so no match is made to be dropped."""
    one = right.groupBy(F.col(right_key).alias("k_")).agg(F.min(value).alias(value))
    return left.join(one, F.col(left_key) == F.col("k_"), "left").drop("k_")


def either_join(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], keep: list[str]) -> DataFrame:
    """Pairs that agree in any of the key ``pairs``: one equi-join for each, without the pairs that an earlier one has made; no nested loop.

    A null key agrees with nothing. ``keep`` names the columns of the result.
    """
    out = None
    for n, (a, b) in enumerate(pairs):
        on = F.col(a) == F.col(b)
        for x, y in pairs[:n]:
            on = on & ~F.coalesce(F.col(x) == F.col(y), F.lit(False))
        part = left.join(right, on).select(*keep)
        out = part if out is None else out.unionAll(part)
    return out


@query("rel_any_join", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1) o ON c_custkey = o_custkey")
def any_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    return any_join(table(spark, sf_dir, "customer").select("c_custkey"), orders, "c_custkey", "o_custkey", "o_orderkey")


@query("rel_either_join", "SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON s_suppkey = c_custkey OR floor(s_acctbal) = floor(c_acctbal)")
def either_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.floor("s_acctbal").alias("s"))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.floor("c_acctbal").alias("c"))
    return either_join(s, c, [("s_suppkey", "c_custkey"), ("s", "c")], ["s_suppkey", "c_custkey"])


def bloom_filtered(big: DataFrame, small: DataFrame, big_key: str, small_key: str, bits: int = 1 << 20) -> DataFrame:
    """``big`` without most rows whose key ``small`` lacks, before a shuffle: a bitmap of ``bits`` hashed keys, aggregated on the way and bounded whatever the input.

    Keeps every row that has a partner; past about ``bits`` keys it merely filters less.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    lines = small.select((place(small_key) / 32768).cast("long").alias("bucket_"), (place(small_key) % 32768).alias("bit_")).groupBy("bucket_").agg(F.bitmap_construct_agg("bit_").alias("bits_"))
    tested = big.withColumn("at_", place(big_key)).join(F.broadcast(lines), F.expr("at_ div 32768") == F.col("bucket_"))  # at most bits / 8 bytes
    byte = "cast(conv(hex(substring(bits_, cast((at_ % 32768) div 8 as int) + 1, 1)), 16, 10) as int)"
    return tested.where(f"shiftright({byte}, cast(at_ % 8 as int)) & 1 = 1").drop("at_", "bucket_", "bits_")


@query("rel_bloom_filtered_join", "SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_totalprice > 400000")
def filtered_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    few = table(spark, sf_dir, "orders").where("o_totalprice > 400000").select("o_orderkey")
    lines = bloom_filtered(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), few, "l_orderkey", "o_orderkey")
    return lines.join(few, F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")


@query("rel_dynamic_partition_pruning", "SELECT e.event_id, e.event_type FROM events e WHERE e.event_type IN ('click', 'error')")
def pruned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fact table partitioned by type, joined with a filtered dimension: its scan reads only the partitions that the dimension's rows name."""
    path = folder(spark)
    table(spark, sf_dir, "events").select("event_id", "event_type").write.partitionBy("event_type").parquet(f"{path}/facts")
    kinds = [("click", 1), ("error", 1), ("view", 0), ("purchase", 0), ("signup", 0)]
    spark.createDataFrame(kinds, "kind string, wanted int").write.parquet(f"{path}/kinds")
    facts = spark.read.schema("event_id long, event_type string").parquet(f"{path}/facts")
    wanted = spark.read.parquet(f"{path}/kinds").where("wanted = 1")
    return facts.join(wanted, F.col("event_type") == F.col("kind")).select("event_id", "event_type")


@query("rel_session_variable", "SELECT o_orderkey FROM orders WHERE o_totalprice > 300000")
def session_variable(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.sql("DECLARE OR REPLACE VARIABLE tessera_floor DOUBLE DEFAULT 0")
    spark.sql("SET VARIABLE tessera_floor = 300000")
    return table(spark, sf_dir, "orders").where("o_totalprice > session.tessera_floor").select("o_orderkey")


@query("rel_collect_tail", "SELECT n_nationkey FROM nation ORDER BY n_nationkey DESC LIMIT 5")
def tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last rows of an ordering, as a bounded driver collection."""
    return spark.createDataFrame(table(spark, sf_dir, "nation").select("n_nationkey").orderBy("n_nationkey").tail(5), "n_nationkey int")


@query("rel_range_sort", "SELECT o_orderkey, o_totalprice FROM orders")
def range_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A total order by range exchange: no task holds all rows."""
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey")


@query("win_first_ignore_nulls", "SELECT o_orderkey, first_value(CASE WHEN o_orderstatus = 'P' THEN o_orderkey END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS v FROM orders")
def first_ignore_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.first(F.when(F.col("o_orderstatus") == "P", F.col("o_orderkey")), ignorenulls=True).over(w).alias("v"))
