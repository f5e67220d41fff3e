"""User-defined functions: scalar, aggregate, table, grouped and co-grouped, all in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf, udtf

from tessera.catalog import query, table


@query("udf_scalar", "SELECT c_custkey, c_custkey + c_nationkey AS v FROM customer")
def scalar(spark, sf_dir):
    @pandas_udf("long")
    def my_add(a: pd.Series, b: pd.Series) -> pd.Series:
        return a + b

    return table(spark, sf_dir, "customer").select("c_custkey", my_add("c_custkey", "c_nationkey").alias("v"))


@query("udf_iterator", "SELECT c_custkey, md5(c_name) AS v FROM customer")
def iterator(spark, sf_dir):
    @pandas_udf("string")
    def my_md5(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import hashlib

        for s in batches:
            yield s.map(lambda x: hashlib.md5(x.encode()).hexdigest())

    return table(spark, sf_dir, "customer").select("c_custkey", my_md5("c_name").alias("v"))


@query("udf_aggregate", "SELECT c_nationkey, round(sum(c_acctbal), 2) AS v FROM customer GROUP BY 1")
def aggregate(spark, sf_dir):
    @pandas_udf("double")
    def my_sum(v: pd.Series) -> float:
        return float(v.sum())

    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.round(my_sum("c_acctbal"), 2).alias("v"))


@query("udf_table_function", "SELECT i AS n, i * i AS square FROM range(1, 6) t(i)")
def table_function(spark, sf_dir):
    @udtf(returnType="n long, square long")
    class Squares:
        def eval(self, upto: int):
            for i in range(1, upto + 1):
                yield i, i * i

    return Squares(F.lit(5))


@query("udf_grouped_map", "SELECT c_custkey, round(c_acctbal - avg(c_acctbal) OVER (PARTITION BY c_nationkey), 4) AS v FROM customer")
def grouped_map(spark, sf_dir):
    def centre(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"c_custkey": pdf["c_custkey"], "v": (pdf["c_acctbal"] - pdf["c_acctbal"].mean()).round(4)})

    return table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal").groupBy("c_nationkey").applyInPandas(centre, "c_custkey long, v double")


@query("udf_cogrouped_map", "SELECT n_nationkey, count(s_suppkey)::BIGINT AS n FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY 1")
def cogrouped_map(spark, sf_dir):
    def count(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"n_nationkey": a["n_nationkey"], "n": len(b)})

    left, right = table(spark, sf_dir, "nation").select("n_nationkey"), table(spark, sf_dir, "supplier").select("s_nationkey")
    return left.groupBy("n_nationkey").cogroup(right.groupBy("s_nationkey")).applyInPandas(count, "n_nationkey int, n long")


@query("udf_map_batches", "SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0")
def map_batches(spark, sf_dir):
    def even(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[b["o_orderkey"] % 2 == 0]

    return table(spark, sf_dir, "orders").select("o_orderkey").mapInPandas(even, "o_orderkey long")


@query("udf_nested_types", "SELECT n_nationkey, n_nationkey * 2 + 1 AS v FROM nation")
def nested_types(spark, sf_dir):
    @pandas_udf("array<long>")
    def pair(a: pd.Series) -> pd.Series:
        return a.map(lambda x: [x, x + 1])

    return table(spark, sf_dir, "nation").select("n_nationkey", F.aggregate(pair("n_nationkey"), F.lit(0).cast("long"), lambda s, x: s + x).alias("v"))


@query("udf_sql_function", "SELECT n_nationkey, n_nationkey * 3 + 1 AS v FROM nation")
def sql_function(spark, sf_dir):
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION tessera_triple(x INT) RETURNS INT RETURN x * 3 + 1")
    return table(spark, sf_dir, "nation").select("n_nationkey", F.expr("tessera_triple(n_nationkey)").alias("v"))


@query("udf_script_like", "SELECT n_nationkey, upper(n_name) AS v FROM nation")
def script_like(spark, sf_dir):
    """What a script transform does to a stream of lines, in Arrow batches and without a process a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"n_nationkey": b["n_nationkey"], "v": b["n_name"].str.upper()})

    return table(spark, sf_dir, "nation").select("n_nationkey", "n_name").mapInPandas(run, "n_nationkey int, v string")
