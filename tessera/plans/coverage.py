"""Plan reports: which physical operators run inside the JVM, and which leave it for Python."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession

from tessera.catalog import query, table

_NODE = re.compile(r"^[\s:+*|\-]*(?:\*?\s*\(\d+\)\s+)?([A-Z]\w+)", re.M)


def operators(df: DataFrame) -> Counter:
    """How often each physical operator stands in the plan."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return Counter(m for m in _NODE.findall(text) if m not in ("Batched", "DataFilters", "Format", "Location"))


def summary(spark: SparkSession, df: DataFrame) -> DataFrame:
    """(operator, n, runs_in): one row an operator."""
    rows = [(o, n, "python" if re.search("Python|Pandas|Arrow", o) else "jvm") for o, n in sorted(operators(df).items())]
    return spark.createDataFrame(rows, "operator string, n long, runs_in string")


@query("plan_coverage")
def coverage(spark, sf_dir):
    return summary(spark, table(spark, sf_dir, "orders").groupBy("o_orderstatus").count())
