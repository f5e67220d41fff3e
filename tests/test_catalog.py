"""Every catalogued query against its oracle; functions of one table share a statement."""

import pytest

from tessera import catalog
from tessera.functions import spec
from tests.compare import connect, differences, plain

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()
WHOLE = sorted(n for n in QUERIES if not n.startswith("fn_"))


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", WHOLE)
def test_query(spark, sf_dir, con, name):
    if name in ORACLES:
        assert differences(spark, sf_dir, QUERIES[name], ORACLES[name], con) is None
    else:
        assert QUERIES[name](spark, sf_dir).columns


@pytest.mark.parametrize("table", sorted(spec.SCALARS))
def test_functions(spark, sf_dir, con, table):
    rows = [(n, s, d) for n, s, d in spec.SCALARS[table] if d is not None]
    frame = {table: spark.read.parquet(f"{sf_dir}/{table}.parquet")}
    key = spec.KEYS[table]
    for at in range(0, len(rows), 25):
        part = rows[at : at + 25]
        got = spark.sql(f"SELECT {key}, {', '.join(f'{s} AS v{i}' for i, (_, s, _) in enumerate(part))} FROM {{{table}}} ORDER BY {key}", **frame).collect()
        want = con.execute(f"SELECT {key}, {', '.join(f'{d} AS v{i}' for i, (_, _, d) in enumerate(part))} FROM {table} ORDER BY {key}").fetchall()
        bad = {part[i - 1][0]: (g[i], w[i]) for g, w in zip(got, want, strict=True) for i in range(1, len(part) + 1) if plain(g[i]) != plain(w[i])}
        assert not bad


def test_oracles_have_queries():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) > 400


def test_plans_stay_narrow(spark, sf_dir):
    plan = QUERIES["tpch_q6"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull" in plan and "l_comment" not in plan and "l_orderkey" not in plan
