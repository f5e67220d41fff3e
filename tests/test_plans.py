"""Plans and errors that results alone do not show."""

import pytest

from tessera import catalog

QUERIES = catalog.queries()


def ran(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("kind", ["left", "right", "full", "semi", "anti"])
def test_join_strategies(spark, sf_dir, kind):
    planned = lambda name: QUERIES[name](spark, sf_dir)._jdf.queryExecution().sparkPlan().toString()
    assert "ShuffledHashJoin" in planned(f"rel_shuffled_hash_{kind}")
    assert "SortMergeJoin" in planned(f"rel_sort_merge_{kind}")


def test_joins_on_alternatives_need_no_nested_loop(spark, sf_dir):
    plan = ran(QUERIES["rel_either_join"](spark, sf_dir))
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_partitions_are_pruned_while_the_query_runs(spark, sf_dir):
    assert "dynamicpruning" in ran(QUERIES["rel_dynamic_partition_pruning"](spark, sf_dir)).lower()


def test_a_total_order_is_a_range_exchange(spark, sf_dir):
    plan = ran(QUERIES["rel_range_sort"](spark, sf_dir))
    assert "rangepartitioning" in plan and "Window" not in plan
    got = [(r.o_totalprice, r.o_orderkey) for r in QUERIES["rel_range_sort"](spark, sf_dir).collect()]
    assert got == sorted(got, key=lambda r: (-r[0], r[1]))


def test_a_bloom_filter_drops_most_rows_and_none_that_join(spark, sf_dir):
    from tessera.operators.strategies import bloom_filtered

    big, small = spark.range(100_000).withColumnRenamed("id", "a"), spark.range(0, 100_000, 500).withColumnRenamed("id", "b")
    left = [r.a for r in bloom_filtered(big, small, "a", "b").collect()]
    assert set(range(0, 100_000, 500)) <= set(left) and len(left) < 1000


@pytest.mark.parametrize("sql", ["SELECT 9223372036854775807L + id", "SELECT 9223372036854775807L * (id + 1)", "SELECT -9223372036854775807L - 1 - id", "SELECT 1 div (id - 1)", "SELECT cast('x' as int) + id", "SELECT raise_error('stop')", "SELECT assert_true(id > 1)"])
def test_overflow_and_failed_checks_are_errors(spark, sql):
    with pytest.raises(Exception) as caught:  # noqa: B017, PT011
        spark.range(1, 3).selectExpr(sql.removeprefix("SELECT ") + " as v").collect()
    assert any(w in str(caught.value) for w in ("OVERFLOW", "DIVIDE_BY_ZERO", "CAST_INVALID_INPUT", "USER_RAISED_EXCEPTION", "stop", "is not true"))


def test_bounded_state_keeps_k_rows_a_key(spark, sf_dir):
    got = QUERIES["stream_bounded_top_n"](spark, sf_dir).groupBy("event_type").count().collect()
    assert got and all(r["count"] <= 10 for r in got)
