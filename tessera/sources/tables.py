"""Sources and sinks: formats, partitioned and dynamic writes, layouts, caching, metadata columns, table commands."""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import functions as F

from tessera.catalog import query, table
from tessera.sources.shared import compact, folder, round_trip, sorted_layout

NATION = "SELECT n_nationkey, n_name, n_regionkey FROM nation"


def _format(name: str, form: str, options: dict | None = None, text_schema: bool = False) -> None:
    query(f"io_{name}", NATION)(lambda spark, sf_dir: round_trip(spark, table(spark, sf_dir, "nation"), form, options=options, text_schema=text_schema))


_format("parquet", "parquet")
_format("parquet_zstd", "parquet", {"compression": "zstd"})
_format("orc", "orc")
_format("csv", "csv", {"header": "true"}, True)
_format("text_delimited", "csv", {"sep": "\u0001", "header": "false"}, True)
_format("json", "json", None, True)
_format("parquet_small_row_groups", "parquet", {"parquet.block.size": str(1 << 20)})


@query("io_text", "SELECT n_name AS value FROM nation")
def text(spark, sf_dir):
    return round_trip(spark, table(spark, sf_dir, "nation").select(F.col("n_name").alias("value")), "text")


@query("io_partitioned_write", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def partitioned_write(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return round_trip(spark, rows, "parquet", partition_by=("o_orderstatus",)).where("o_orderstatus = 'F'")


@query("io_dynamic_overwrite", "SELECT n_nationkey, n_regionkey FROM nation WHERE n_regionkey <> 1 UNION ALL SELECT n_nationkey + 100, n_regionkey FROM nation WHERE n_regionkey = 1")
def dynamic_overwrite(spark, sf_dir):
    path, rows = folder(spark), table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    rows.write.partitionBy("n_regionkey").parquet(path)
    one = rows.where("n_regionkey = 1").withColumn("n_nationkey", F.col("n_nationkey") + 100)
    one.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("n_regionkey").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


@query("io_append", "SELECT r_regionkey FROM region UNION ALL SELECT r_regionkey FROM region")
def append(spark, sf_dir):
    path, rows = folder(spark), table(spark, sf_dir, "region").select("r_regionkey")
    rows.write.parquet(path)
    rows.write.mode("append").parquet(path)
    return spark.read.parquet(path)


@query("io_compaction", "SELECT o_orderkey FROM orders")
def compaction(spark, sf_dir):
    path = folder(spark)
    table(spark, sf_dir, "orders").select("o_orderkey").repartition(16).write.parquet(path)
    return spark.read.parquet(compact(spark, path))


@query("io_sorted_layout", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey BETWEEN 10 AND 20")
def sorted_tables(spark, sf_dir):
    path = folder(spark)
    sorted_layout(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ["o_custkey"], 4).write.parquet(path)
    return spark.read.parquet(path).where("o_custkey between 10 and 20")


@query("io_ctas_insert", "SELECT n_nationkey FROM nation UNION ALL SELECT r_regionkey FROM region")
def ctas_insert(spark, sf_dir):
    name = f"t_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} USING parquet LOCATION '{folder(spark)}' AS SELECT n_nationkey FROM {{n}}", n=table(spark, sf_dir, "nation"))
    spark.sql(f"INSERT INTO {name} SELECT r_regionkey FROM {{r}}", r=table(spark, sf_dir, "region"))
    return spark.table(name)


@query("io_bucketed_join", "SELECT c_custkey, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def bucketed_join(spark, sf_dir):
    """Both tables bucketed on the join key: the join and the aggregate need no shuffle."""
    names = {}
    for t, key in (("customer", "c_custkey"), ("orders", "o_custkey")):
        names[t] = f"{t}_{uuid.uuid4().hex}"
        table(spark, sf_dir, t).select(key).write.bucketBy(8, key).sortBy(key).option("path", folder(spark)).saveAsTable(names[t])
    both = spark.table(names["customer"]).join(spark.table(names["orders"]), F.col("c_custkey") == F.col("o_custkey"))
    return both.groupBy("c_custkey").agg(F.count("*").alias("n"))


@query("io_cached_table", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def cached(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderstatus").persist(StorageLevel.DISK_ONLY)
    return rows.groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("io_metadata_columns", "SELECT n_nationkey, 'nation.parquet' AS f FROM nation")
def metadata_columns(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", F.col("_metadata.file_name").alias("f"))


@query("io_input_file_name", "SELECT r_regionkey, TRUE AS v FROM region")
def input_file_name(spark, sf_dir):
    return table(spark, sf_dir, "region").select("r_regionkey", F.input_file_name().endswith("region.parquet").alias("v"))


@query("io_schema_evolution", "SELECT n_nationkey, NULL::BIGINT AS added FROM nation")
def schema_evolution(spark, sf_dir):
    return spark.read.schema("n_nationkey int, added long").parquet(f"{sf_dir}/nation.parquet")


@query("io_merge_schema", "SELECT n_nationkey AS k, n_name AS s FROM nation UNION ALL SELECT r_regionkey, NULL FROM region")
def merge_schema(spark, sf_dir):
    path = folder(spark)
    table(spark, sf_dir, "nation").selectExpr("n_nationkey as k", "n_name as s").write.parquet(f"{path}/a")
    table(spark, sf_dir, "region").selectExpr("r_regionkey as k").write.parquet(f"{path}/b")
    return spark.read.option("mergeSchema", "true").parquet(f"{path}/a", f"{path}/b")


@query("io_local_rows", "SELECT * FROM (VALUES (1, 'a'), (2, 'b')) t(k, s)")
def local_rows(spark, sf_dir):
    return spark.createDataFrame([(1, "a"), (2, "b")], "k int, s string")


@query("io_lenient_numbers", "SELECT try_cast(replace(v, ',', '') AS DOUBLE) AS n FROM (VALUES ('1,234.5'), ('x'), ('7')) t(v)")
def lenient_numbers(spark, sf_dir):
    return spark.createDataFrame([("1,234.5",), ("x",), ("7",)], "v string").select(F.expr("try_cast(replace(v, ',', '') as double)").alias("n"))


@query("io_noop_sink", "SELECT count(*) AS n FROM orders")
def noop_sink(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    rows.write.format("noop").mode("overwrite").save()
    return rows.agg(F.count("*").alias("n"))


@query("io_merge_upsert", "SELECT n_nationkey, CASE WHEN n_regionkey = 2 THEN upper(n_name) ELSE n_name END AS n_name FROM nation UNION ALL SELECT 900, 'NEW'")
def merge_upsert(spark, sf_dir):
    """Upsert without a lake format: changed keys leave by an anti join, and the changes come in."""
    base = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    changes = table(spark, sf_dir, "nation").where("n_regionkey = 2").select("n_nationkey", F.upper("n_name").alias("n_name"))
    changes = changes.union(spark.createDataFrame([(900, "NEW")], changes.schema))
    return base.join(changes, "n_nationkey", "left_anti").unionByName(changes)


@query("io_delete_vector", "SELECT o_orderkey FROM orders WHERE o_orderkey % 7 <> 0")
def delete_vector(spark, sf_dir):
    """Position deletes: rows named by file and row index are filtered on read."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("i"))
    gone = rows.where("o_orderkey % 7 = 0").select("f", "i")
    return rows.join(gone, ["f", "i"], "left_anti").select("o_orderkey")


@query("op_coalesce_partitions", "SELECT n_nationkey FROM nation")
def coalesce_partitions(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey").repartition(8).coalesce(2)


@query("op_repartition_hash", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1")
def repartition_hash(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_custkey").repartition("o_custkey").groupBy("o_custkey").agg(F.count("*").alias("n"))


@query("op_rebalance", "SELECT o_orderkey FROM orders")
def rebalance(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey").hint("rebalance")


@query("op_sample")
def sample(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey").sample(0.2, seed=7)
