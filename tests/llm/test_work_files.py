"""Work tables of few rows in many partitions: few files, all rows."""

import pytest

from tessera.llm import neardup, store
from tessera.llm.components import connected


@pytest.fixture
def many_partitions(spark):
    keys = {"spark.sql.shuffle.partitions": "211", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield max(2 * spark.sparkContext.defaultParallelism, 16) + 1  # two a core, or 16 parts and the file of an empty first partition
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.fixture
def tables(monkeypatch):
    """(name, files) of each work table written."""
    seen, write = [], store.materialise

    def watched(spark, df, name, *a, **b):
        out = write(spark, df, name, *a, **b)
        seen.append((name, len(out.inputFiles())))
        return out

    monkeypatch.setattr(neardup, "materialise", watched)
    monkeypatch.setattr("tessera.llm.components.materialise", watched)
    return seen


def test_components_of_a_long_chain_and_a_hub(spark, many_partitions, tables):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 300)]
    got = {r.node: r.root for r in connected(spark, spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{1000 + i: 1000 for i in range(300)}}
    assert tables
    assert max(n for _, n in tables) <= many_partitions


def test_near_duplicates_write_few_files(spark, many_partitions, tables):
    text = lambda k: " ".join(f"{k}w{i}" for i in range(60))
    docs = spark.createDataFrame([(1000 * j + k, text(k) + " end" * j) for k in range(100) for j in range(3)], "doc_id long, text string")
    out = neardup.near_duplicates(spark, docs)
    assert {r.doc_id: (r.class_id, r.class_size) for r in out.collect()} == {1000 * j + k: (k, 3) for k in range(100) for j in range(3)}
    assert {name for name, _ in tables} >= {"nodes", "buckets", "edges", "compared", "roots", "placed"}
    assert max(n for _, n in tables) <= many_partitions
    assert out.rdd.getNumPartitions() <= many_partitions
