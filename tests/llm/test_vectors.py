"""Vector searches against brute force."""

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import ann, registry, topk
from tests.compare import connect, differences


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("part", F.lit("x"))


def clustered(n=600, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(12, 16))[rng.integers(0, 12, n)] + 0.1 * rng.normal(size=(n, 16))
    x[100:160] = x[100]  # one frequent vector
    return [(i, [float(v) for v in row]) for i, row in enumerate(x)]


def valid(rows, zero_ok):
    out = {}
    for i, v in rows:
        if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v) and (zero_ok or any(v)):
            v = [float(np.float32(c)) for c in v]
            out[i] = min(out.get(i, v), v)
    return out


ODD = [(None, [1.0] * 16), (9000, None), (9001, [float("nan")] * 16), (9002, [1.0, None] * 8), (9003, [float("inf")] * 16), (9020, [0.0] * 16), (9040, [1.0, 2.0]), (9041, [2.0, 1.0]), (9060, [1e9] * 16), (0, [0.5] * 16)]


def test_top_k_matches_sql(spark, small):
    assert differences(spark, small, topk.op1_exact_top_k, topk.OP1_SQL, connect(small)) is None


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "PER_CELL", 100)
    monkeypatch.setattr(topk, "SHARD", 64)
    monkeypatch.setattr(topk, "LEAF", 8)
    rows = clustered() + ODD
    v = {i: [int(np.floor(64 * c)) for c in x] for i, x in valid(rows, True).items()}
    want = []
    for q in (i for i in v if i % 20 == 0):
        score = sorted((-sum(a * b for a, b in zip(v[q], x, strict=True)), i) for i, x in v.items() if i != q and len(x) == len(v[q]))
        want += [(q, r + 1, i, min(-s, (1 << 63) - 1)) for r, (s, i) in enumerate(score[:20])]
    assert sorted(map(tuple, topk.exact_top_k(spark, frame(spark, rows)).collect())) == sorted(want)
    assert topk.exact_top_k(spark, frame(spark, rows).limit(0)).collect() == []


def test_cover_tree_covers_and_prunes():
    rng = np.random.default_rng(2)
    x = np.floor(64 * (rng.normal(size=(30, 8))[rng.integers(0, 30, 3000)] * 3 + 0.05 * rng.normal(size=(3000, 8))))
    tree = topk.CoverTree(x, 16)
    for n, (first, count) in enumerate(tree.points):
        own = x[tree.order[first : first + count]]
        assert np.linalg.norm(own - x[tree.centre[n]], axis=1).max() <= tree.radius[n] + 1e-9
    assert sorted(tree.order.tolist()) == list(range(3000))
    s = topk.Searcher(x[:200], np.arange(200), topk.CoverTree(x[:200], 16), 5, np.full(200, -np.inf))
    s.search(x, np.arange(3000), tree)
    assert s.visited < 200 * 3000 / 2


def exact_neighbours(v, every, k):
    out = {}
    for q in (i for i in v if i % every == 0):
        d = sorted((float(np.sqrt(((np.array(v[q]) - np.array(x)) ** 2).sum())), i) for i, x in v.items() if i != q and len(x) == len(v[q]))
        out[q] = d[:k]
    return out


def test_neighbours(spark):
    rows = clustered(3000) + ODD
    v = valid(rows, False)
    got = {}
    for r in ann.approximate_nearest(spark, frame(spark, rows), every=20, k=10).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = exact_neighbours(v, 20, 10)
    assert set(got) <= set(want) and 9020 not in got
    hits = sum(len({i for _, i, _ in got.get(q, [])} & {i for _, i in d}) for q, d in want.items())
    assert hits >= 0.9 * sum(map(len, want.values()))
    for q, own in got.items():
        own.sort()
        assert [r for r, _, _ in own] == list(range(1, len(own) + 1)) and [(s, i) for _, i, s in own] == sorted((s, i) for _, i, s in own)
        for _, i, s in own:
            assert abs(s - np.sqrt(((np.array(v[q]) - np.array(v[i])) ** 2).sum())) < 1e-9
    assert ann.approximate_nearest(spark, frame(spark, rows).limit(0)).collect() == []


def recall(spark, sf_dir):
    """(recall, results) of the registered query against brute force."""
    table = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    v = valid(table.items(), False)
    ids = np.array(sorted(v))
    x = np.array([v[i] for i in ids])
    got = {}
    for r in registry.queries()["op7_learned_partitions_ann"](spark, sf_dir).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    hits = want = 0
    for q in ids[ids % 100 == 0].tolist():
        d = np.sqrt(((x - np.array(v[q])) ** 2).sum(1))
        d[ids == q] = np.inf
        near = ids[np.lexsort((ids, d))[:10]]
        assert [r for r, _ in sorted(got[q])] == list(range(1, 11))
        hits += len({i for _, i in got[q]} & set(near.tolist()))
        want += 10
    return hits / want


def test_recall_of_the_query(spark):
    for sf_dir in ("/root/testdata/sf0.01", "/root/testdata/sf0.1"):
        assert recall(spark, sf_dir) >= 0.9


def test_recall_and_rows_read():
    """Vectors without structure need about 3 in 5 rows, clustered ones a few in a hundred."""
    rng = np.random.default_rng(5)
    loose = rng.normal(size=(6000, 64))
    tight = rng.normal(size=(150, 64))[rng.integers(0, 150, 6000)] + 0.25 * rng.normal(size=(6000, 64))
    for x, most in ((loose, 0.75), (tight, 0.06)):
        router = ann.fit_router(x[:4096], 256)
        part = router.scores(x).argmax(1)
        sizes = np.bincount(part, minlength=256)
        asked = np.arange(0, 6000, 20)
        probed = router.most_probable(x[asked], ann.MASS, sizes, 11)
        graph = ann.neighbour_graph(x, 10)
        assert np.mean([np.isin(part[graph[i]], p).mean() for i, p in zip(asked, probed)]) >= 0.9
        assert np.mean([sizes[p].sum() for p in probed]) <= most * len(x)
        assert min(sizes[p].sum() for p in probed) >= 11


def test_all_candidates_come_back_if_there_are_few(spark):
    rows = [(i, [float(i), 1.0]) for i in range(5)]
    got = ann.approximate_nearest(spark, frame(spark, rows), every=2, k=10).collect()
    assert sorted((r.query_id, r.vec_id) for r in got) == [(q, i) for q in (0, 2, 4) for i in range(5) if i != q]
