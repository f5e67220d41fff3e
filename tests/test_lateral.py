"""The lateral join takes each customer's dearest order however rows arrive at its tasks."""

import re

import duckdb
import pytest

from tessera import catalog
from tests.compare import connect, differences

NAME = "rel_lateral_join"
RUN, SQL = catalog.queries()[NAME], catalog.oracle_sql()[NAME]
SPILL = "spark.shuffle.spill.numElementsForceSpillThreshold"


@pytest.fixture
def spilling(spark):
    """Sorts spill every 20 rows, so that rows of equal keys come back out of the order they arrived in."""
    conf = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().conf()
    conf.set(SPILL, "20")
    yield
    conf.remove(SPILL)


def save(folder, **tables) -> str:
    con = duckdb.connect()
    for name, sql in tables.items():
        con.execute(f"COPY ({sql}) TO '{folder}/{name}.parquet'")
    return str(folder)


def test_sorts_that_spill_change_no_row(spark, sf_dir, spilling):
    assert differences(spark, sf_dir, RUN, SQL, connect(sf_dir)) is None


def test_the_limit_is_ordered_in_the_plan(spark, sf_dir):
    plan = RUN(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"row_number\(\) windowspecdefinition\(o_custkey#\w+, o_totalprice#\w+ DESC NULLS LAST, o_orderkey#\w+ ASC NULLS LAST", plan)


def test_ties_nulls_and_odd_prices(spark, tmp_path):
    at = save(
        tmp_path,
        customer="SELECT * FROM (VALUES (0), (1), (1), (2), (3), (4), (5), (6), (7), (NULL)) t(c_custkey)",
        orders="""
            SELECT k::BIGINT AS o_orderkey, c AS o_custkey, p::DOUBLE AS o_totalprice FROM (VALUES
                (9, 0, '5'), (8, 0, '5'), (NULL, 0, '5'), (7, 0, '4'),
                (3, 1, NULL), (6, 1, '-1'), (5, 2, NULL), (4, 2, NULL), (NULL, 2, NULL), (NULL, 3, '1'),
                (2, 4, 'inf'), (1, 4, 'nan'), (11, 4, 'nan'), (13, 5, '0.0'), (12, 5, '-0.0'), (15, 6, '-0.0'), (16, 6, '0.0'),
                (20, NULL, '9'), (21, 99, '9')) t(k, c, p)""",
    )
    assert differences(spark, at, RUN, SQL, connect(at)) is None


def test_empty_tables(spark, sf_dir, tmp_path):
    at = save(tmp_path, customer=f"FROM '{sf_dir}/customer.parquet'", orders=f"FROM '{sf_dir}/orders.parquet' LIMIT 0")
    assert RUN(spark, at).collect() == []
