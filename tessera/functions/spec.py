"""Function queries from tables of (name, Spark SQL, DuckDB SQL): one query for each function.

Each query computes one expression over one table, keyed by that table's key, so that its
plan is a single scan of the two or three columns it needs, inside whole-stage codegen.
``None`` as DuckDB SQL says that both dialects agree on the text; ``...`` that SQL has no
counterpart, so the query stands without an oracle.
"""

from __future__ import annotations

from tessera.catalog import query

KEYS = {"customer": "c_custkey", "orders": "o_orderkey", "part": "p_partkey", "events": "event_id", "supplier": "s_suppkey", "nation": "n_nationkey", "lineitem": "l_orderkey, l_linenumber"}


#: (name, Spark SQL, DuckDB SQL or None) by table, for tests that compare many functions in one statement
SCALARS: dict[str, list[tuple[str, str, str | None]]] = {}


def scalar(table: str, rows: list[tuple]) -> None:
    """Registers ``fn_<name>`` for each row of the table of functions."""
    for name, spark_sql, duck_sql in rows:
        SCALARS.setdefault(table, []).append((name, spark_sql, None if duck_sql is ... else duck_sql or spark_sql))
        _register(f"fn_{name}", f"SELECT {KEYS[table]}, {spark_sql} AS v FROM {{{table}}}", None if duck_sql is ... else f"SELECT {KEYS[table]}, {duck_sql or spark_sql} AS v FROM {table}")


def whole(prefix: str, rows: list[tuple]) -> None:
    """Registers whole statements; tables stand in braces for Spark, bare for DuckDB."""
    for name, spark_sql, duck_sql in rows:
        plain = duck_sql if isinstance(duck_sql, str) else spark_sql.replace("{", "").replace("}", "")
        _register(f"{prefix}_{name}", spark_sql, None if duck_sql is ... else plain)


def _register(name: str, spark_sql: str, oracle: str | None) -> None:
    import re

    used = sorted(set(re.findall(r"\{(\w+)\}", spark_sql)))

    def run(spark, sf_dir, sql=spark_sql, used=used):
        return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})

    query(name, oracle)(run)
