"""Approximate nearest neighbours: learned partitions of a neighbour graph.

A sample of at most ``SAMPLE`` rows (those with the least id hashes; the bound is fixed)
gives an exact nearest-neighbour graph. The graph is cut into one part for ``PER_PART``
sampled rows, up to ``MOST_PARTS``, of almost equal size with few edges between them:
capacity-bounded label propagation from a balanced start. A small network (one hidden layer)
then learns, for each vector, how its neighbours spread over the parts. All rows are indexed
under their most probable part. A query goes to its most probable parts, as many as it takes
for their probabilities to sum up to ``MASS``, and is reranked there by exact distances: the
sum is the network's own estimate of the recall. So queries on clustered vectors read a few
parts, and those on vectors without structure read many, as they must. A part is stored in
shards of about ``SHARD`` rows and searched in lots of queries, so a part or a vector of any
frequency stays spread.

Defined cases: rows with a null id, a null, zero or empty vector, or null or non-finite
components take no part; rows with the same id count once (least vector); vectors of
another length than the sample's most common one are searched among their own, exactly.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import materialise
from .vectors import best, bounded_sample, dealt, first_ids, matrix, valid_vectors

SAMPLE, NEIGHBOURS = 8192, 50
MOST_PARTS, PER_PART, MASS = 256, 8, 0.95
HIDDEN, EPOCHS, BATCH, RATE = 256, 60, 256, 2e-3
SHARD, LOT = 16384, 1024


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest rows of each row, exactly, in blocks."""
    n, sq = len(x), (x * x).sum(1)
    k = min(k, n - 1)
    out = np.empty((n, max(k, 0)), dtype=np.int64)
    for at in range(0, n, 1024):
        d = sq - 2 * (x[at : at + 1024] @ x.T)
        d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
        if k:
            out[at : at + 1024] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rng: np.random.Generator, rounds: int = 20, slack: float = 1.05) -> np.ndarray:
    """A part for each row: few graph edges between parts, and no part above ``slack`` times the mean."""
    n = len(x)
    most = int(np.ceil(slack * n / parts))
    part = np.zeros(n, dtype=np.int64)
    blocks = [(np.arange(n), parts)]
    while blocks:  # balanced start: halve along the direction of most variance
        rows, m = blocks.pop()
        if m == 1:
            continue
        c = x[rows] - x[rows].mean(0)
        v = rng.standard_normal(x.shape[1])
        for _ in range(8):
            v = c.T @ (c @ v)
            v /= np.linalg.norm(v) + 1e-30
        left = m // 2
        order = rows[np.argsort(c @ v, kind="stable")]
        cut = len(rows) * left // m
        part[order[cut:]] += left
        blocks += [(order[:cut], left), (order[cut:], m - left)]
    heads, tails = np.repeat(np.arange(n), graph.shape[1]), graph.ravel()
    a, b = np.concatenate([heads, tails]), np.concatenate([tails, heads])
    for _ in range(rounds):
        votes = np.bincount(a * parts + part[b], minlength=n * parts).reshape(n, parts)
        wish = votes.argmax(1)
        gain = votes[np.arange(n), wish] - votes[np.arange(n), part]
        size, moved = np.bincount(part, minlength=parts), 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if size[wish[i]] < most:
                size[wish[i]] += 1
                size[part[i]] -= 1
                part[i] = wish[i]
                moved += 1
        if not moved:
            break
    return part


class Router:
    """Probabilities of the parts, from a network with one hidden layer."""

    def __init__(self, dim: int, parts: int, rng: np.random.Generator):
        self.p = [rng.standard_normal((dim, HIDDEN)) * np.sqrt(2 / dim), np.zeros(HIDDEN), rng.standard_normal((HIDDEN, parts)) * np.sqrt(1 / HIDDEN), np.zeros(parts)]
        self.mean, self.scale = np.zeros(dim), 1.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(((x - self.mean) / self.scale) @ self.p[0] + self.p[1], 0) @ self.p[2] + self.p[3]

    def most_probable(self, x: np.ndarray, mass: float, sizes: np.ndarray, least: int) -> list[list[int]]:
        """For each row its most probable parts, best first, up to a sum of ``mass`` and to ``least`` rows (or all there are)."""
        s = self.scores(x)
        order = np.argsort(-s, axis=1, kind="stable")
        p = np.exp(np.take_along_axis(s, order, 1) - s.max(1, keepdims=True))
        short = (np.cumsum(p, axis=1) < mass * p.sum(1, keepdims=True)) | (np.cumsum(sizes[order], axis=1) < least)
        return [o[:n].tolist() for o, n in zip(order, short.sum(1) + 1, strict=True)]

    def fit(self, x: np.ndarray, target: np.ndarray, rng: np.random.Generator) -> None:
        self.mean = x.mean(0)
        self.scale = float(np.sqrt(((x - self.mean) ** 2).mean())) or 1.0
        z = (x - self.mean) / self.scale
        m, v, t = [np.zeros_like(w) for w in self.p], [np.zeros_like(w) for w in self.p], 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(z))
            for at in range(0, len(z), BATCH):
                own = order[at : at + BATCH]
                h = np.maximum(z[own] @ self.p[0] + self.p[1], 0)
                s = h @ self.p[2] + self.p[3]
                s -= s.max(1, keepdims=True)
                e = np.exp(s)
                d = (e / e.sum(1, keepdims=True) - target[own]) / len(own)
                back = (d @ self.p[2].T) * (h > 0)
                t += 1
                for i, g in enumerate((z[own].T @ back, back.sum(0), h.T @ d, d.sum(0))):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    self.p[i] = self.p[i] - RATE * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)


def fit_router(x: np.ndarray, parts: int, seed: int = 7) -> Router:
    rng = np.random.default_rng(seed)
    graph = neighbour_graph(x, min(NEIGHBOURS, max(1, len(x) // 20)))
    part = balanced_parts(x, graph, parts, rng)
    spread = np.zeros((len(x), parts))
    for j in range(graph.shape[1]):
        spread[np.arange(len(x)), part[graph[:, j]]] += 1
    spread[np.arange(len(x)), part] += 1
    router = Router(x.shape[1], parts, rng)
    router.fit(x, spread / spread.sum(1, keepdims=True), rng)
    return router


def _route_task(router: Router | None, dim: int):
    """The rows with their most probable part; part -1 for other lengths."""
    out = pa.schema([("id", pa.int64()), ("dim", pa.int32()), ("vec", pa.list_(pa.float64())), ("part", pa.int32())])

    def run(batches):
        for batch in batches:
            part = np.full(batch.num_rows, -1, dtype=np.int32)
            rows = np.flatnonzero(batch.column(1).to_numpy() == dim) if router is not None else np.zeros(0, dtype=np.int64)
            for at in range(0, len(rows), 4096):
                own = rows[at : at + 4096]
                part[own] = router.scores(matrix(batch.column(2).take(pa.array(own)), len(own))).argmax(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2).cast(pa.list_(pa.float64())), pa.array(part)], schema=out)

    return run


def _probe_task(router: Router | None, mass: float, sizes: np.ndarray, least: int):
    """Queries, once for each part that they probe."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                probed = [[p] for p in some.column(3).to_pylist()]
                rows = np.flatnonzero(some.column(3).to_numpy() >= 0)
                if len(rows):
                    found = router.most_probable(matrix(some.column(2).take(pa.array(rows)), len(rows)), mass, sizes, least)
                    for i, parts in zip(rows, found, strict=True):
                        probed[i] = parts
                again = some.take(pa.array(np.repeat(np.arange(some.num_rows), [len(p) for p in probed])))
                yield again.set_column(3, "part", pa.array([p for parts in probed for p in parts], pa.int32()))

    return run


def _body(ids: np.ndarray, x: np.ndarray) -> bytes:
    out = io.BytesIO()
    narrow = x.astype(np.float32)
    np.savez(out, ids=ids, x=narrow if (narrow == x).all() else x)
    return out.getvalue()


def _shard_task(keep: int | None):
    out = pa.schema([("dim", pa.int32()), ("part", pa.int32()), ("shard", pa.int64()), ("body", pa.binary())])

    def run(t: pa.Table) -> pa.Table:
        ids, x = t["id"].to_numpy(), matrix(t["vec"], t.num_rows)
        rows = first_ids(x, ids, keep) if keep else np.arange(len(ids))
        return pa.table([t["dim"][:1], t["part"][:1], t["shard"][:1], [_body(ids[rows], x[rows])]], schema=out)

    return run


def nearest(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance) of the k nearest rows of each query other than its own, ties to the smaller id, by exact distances."""
    found = []
    sq, worst = (x * x).sum(1), np.abs(x).max(initial=0.0)
    for at in range(0, len(q), 64):
        own = q[at : at + 64]
        d = sq - 2 * (own @ x.T) + (own * own).sum(1)[:, None]
        d[q_ids[at : at + 64][:, None] == ids[None, :]] = np.inf
        kth = np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] > k else np.full(len(own), np.inf)
        slack = 1e-12 * own.shape[1] * (worst + np.abs(own).max(initial=0.0)) ** 2
        i, j = np.nonzero((d <= (kth + slack)[:, None]) & (d < np.inf))
        exact = np.sqrt(((own[i] - x[j]) ** 2).sum(1))
        order = np.lexsort((ids[j], exact, i))
        i, j, exact = i[order], j[order], exact[order]
        start = np.maximum.accumulate(np.where(np.diff(i, prepend=-1) != 0, np.arange(len(i)), 0))
        top = np.arange(len(i)) - start < k
        found.append((i[top] + at, j[top], exact[top]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def _rerank_task(k: int):
    out = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(shard: pa.Table, lots: pa.Table) -> pa.Table:
        done = [out.empty_table()]
        if shard.num_rows:
            with np.load(io.BytesIO(shard["body"][0].as_py())) as body:
                x, ids = body["x"].astype(np.float64), body["ids"]
            for blob in lots["q_body"].to_pylist():
                with np.load(io.BytesIO(blob)) as body:
                    q, q_ids = body["x"].astype(np.float64), body["ids"]
                i, j, d = nearest(q, q_ids, x, ids, k)
                done.append(pa.table([q_ids[i], ids[j], d], schema=out))
        return pa.concat_tables(done)

    return run


def approximate_nearest(spark: SparkSession, vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", *, every: int = 100, k: int = 10, most_parts: int = MOST_PARTS, mass: float = MASS, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for the rows whose id is divisible by ``every``, among all others."""
    rows = valid_vectors(vectors, id_col, vec_col, zero_ok=False)
    picked: dict[int, list] = {}
    for r in bounded_sample(rows, sample).collect():
        picked.setdefault(r.dim, []).append(r.vec)
    dim = max(picked, key=lambda d: len(picked[d]), default=0)
    parts = min(most_parts, max(1, len(picked.get(dim, ())) // PER_PART))
    router = fit_router(np.array(picked[dim], dtype=np.float64), parts) if dim else None
    routed = materialise(spark, rows.mapInArrow(_route_task(router, dim), "id long, dim int, vec array<double>, part int"), "routed")
    sizes = np.zeros(parts, dtype=np.int64)
    for r in routed.where("part >= 0").groupBy("part").count().collect():  # at most most_parts rows
        sizes[r.part] = r["count"]
    shard = "dim int, part int, shard long, body binary"
    shards = materialise(spark, dealt(routed, ["dim", "part"], SHARD, "shard").groupBy("dim", "part", "shard").applyInArrow(_shard_task(k + 1), shard), "shards")
    asked = routed.where(F.pmod("id", F.lit(every)) == 0).mapInArrow(_probe_task(router, mass, sizes, k + 1), routed.schema)
    lots = dealt(asked, ["dim", "part"], LOT, "shard").groupBy("dim", "part", "shard").applyInArrow(_shard_task(None), shard)
    lots = materialise(spark, lots, "lots").select(F.col("dim").alias("dim"), F.col("part").alias("part"), F.col("shard").alias("lot"), F.col("body").alias("q_body"))
    lots = lots.join(shards.select("dim", "part", "shard"), ["dim", "part"])
    left = shards.join(lots.select(F.col("dim").alias("dim"), F.col("part").alias("part"), F.col("lot").alias("lot")).distinct(), ["dim", "part"])
    left = left.select(F.col("dim").alias("dim"), F.col("part").alias("part"), F.col("shard").alias("shard"), F.col("lot").alias("lot"), "body")
    keys = ["dim", "part", "shard", "lot"]
    found = left.groupBy(*keys).cogroup(lots.groupBy(*keys)).applyInArrow(_rerank_task(k), "query_id long, vec_id long, score double")
    return best(found, k, largest=False)


def op7_learned_partitions_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest found of every query."""
    return approximate_nearest(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
