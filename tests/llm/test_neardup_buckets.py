"""Which pairs of a bucket are settled: components of the links against all pairs of all buckets."""

import numpy as np

from tessera.llm import neardup


def span(start, end, *more):
    """A text as the set of its shingles, all of weight 1."""
    return sorted({*range(start, end), *more})


def lost(spark, texts, buckets):
    """Pairs of similar texts that share a bucket, but no component. ``texts``: node -> shingles; ``buckets``: key -> nodes."""
    rows = [(k, [k], n, len(b), min(b)) for k, b in buckets.items() for n in b]
    bands = {n: [k for k, b in buckets.items() if n in b] for n in texts}
    bands = [(n, (b + [-100 * n - i - 1 for i in range(neardup.BANDS)])[: neardup.BANDS]) for n, b in bands.items()]
    raw = [(n, bytearray(np.array(h, dtype=np.uint64).tobytes()), bytearray(np.ones(len(h), dtype=np.float32).tobytes())) for n, h in texts.items()]
    frame = spark.createDataFrame
    found = neardup._settle(spark, frame(rows, "key long, used array<long>, node long, n long, lead long"), frame(bands, "node long, bands array<long>"), frame(raw, "node long, h binary, w binary"), neardup.THRESHOLD)
    root = {n: n for n in texts}
    for r in found.collect():
        if "sim" not in found.columns or r.sim >= neardup.THRESHOLD - 1e-9:
            a, b = root[r.u], root[r.v]
            root = {n: a if x == b else x for n, x in root.items()}
    like = lambda a, b: len({*texts[a]} & {*texts[b]}) / len({*texts[a]} | {*texts[b]})
    assert all(like(r.u, r.v) >= neardup.THRESHOLD for r in found.collect() if "sim" not in found.columns)
    return sorted({(a, b) for k in buckets.values() for a in k for b in k if a < b and like(a, b) >= neardup.THRESHOLD and root[a] != root[b]})


def test_crowded_bucket_of_many_small_classes(spark):
    pairs = {2 * i + j: span(0, 100, *range(1000 * (i + 1), 1000 * (i + 1) + 25), *range(1000 * (i + 1) + 100 * (j + 1), 1000 * (i + 1) + 100 * (j + 1) + 5)) for i in range(200) for j in (0, 1)}
    assert lost(spark, pairs, {7: list(pairs)}) == []


def test_crowded_bucket_of_a_chain_and_others(spark):
    chain = {i: span(5 * (i * 37 % 300), 5 * (i * 37 % 300) + 100) for i in range(300)}
    assert lost(spark, chain, {7: list(chain), 8: list(range(0, 300, 2)), 9: list(range(0, 300, 30))}) == []


def test_small_bucket_meets_all_members_of_the_leaders_component(spark):
    texts, buckets = {}, {}
    for k in range(12):
        at, n = 10_000 * (k + 1), 10 * k
        texts |= {n + i: span(at + shift, at + shift + 100) for i, shift in enumerate((0, -5, -6, 7, 14))}
        buckets[k + 1] = list(range(n, n + 5))
    assert lost(spark, texts, buckets) == []


def test_small_bucket_with_a_member_linked_to_the_leader_elsewhere(spark):
    texts = {i: span(11 * i, 11 * i + 100) for i in range(4)}
    assert lost(spark, texts, {1: [0, 1], 2: [1, 2], 3: [0, 2, 3]}) == []
