"""Exact top-k by inner product: dual-tree search over cover trees.

Queries and data are indexed together: both are dealt to cells around the same pivots
(the top level), and every group of a cell becomes a cover tree: a node covers its points
within its radius, its children cover half of that and stand further apart than it, and a
node's own centre is one of its children. For a query node (centre q, radius s) and a data
node (centre p, radius r) no inner product exceeds <q, p> + |q| r + |p| s + r s. A pair of
nodes is pruned where that is below the worst kth score of the query node's queries.

The same bound prunes whole cells first: a query group meets the cells nearest to it, which
gives its queries kth scores, and then every other cell whose bound reaches the least of
them. Only cell summaries (at most ``MAX_CELLS``, ``CELL_BYTES``) reach the driver. Cells of
any size are dealt to shards of about ``SHARD`` rows, so a vector that a third of all rows
share stays spread; of equal vectors in a shard only the k + 1 with the smallest ids can
be in a result, so only those are searched.

Defined cases: rows with a null id, a null vector or null or non-finite components take no
part; rows with the same id count once (least vector); vectors of different lengths are
not compared; scores outside the range of long are clipped to it.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import materialise
from .vectors import best, bounded_sample, dealt, first_ids, matrix, valid_vectors

SCALE = 64
SHARD, GROUP, LEAF = 16384, 1024, 128
PER_CELL, MAX_CELLS, CELL_BYTES = 8192, 4096, 8 << 20
TOGETHER = 8
EXACT = float(1 << 53)


class CoverTree:
    """Arrays by node: centre (a row of x), radius, children (first, count), points (first, count) in ``order``."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        n = len(x)
        self.order = np.arange(n)
        self.centre, self.radius, self.kids, self.points = [0], [0.0], [(0, 0)], [(0, n)]
        d = np.linalg.norm(x - x[0], axis=1) if n else np.zeros(0)
        self.radius[0] = float(d.max(initial=0.0))
        todo = [(0, d)]
        while todo:
            node, d = todo.pop()
            first, count = self.points[node]
            if count <= leaf or self.radius[node] == 0:
                continue
            rows = self.order[first : first + count]
            reach, most = self.radius[node] / 2, max(4, 4 * count // leaf)
            parts, left, left_d, centre, dist = [], rows, d, self.centre[node], d
            while len(left) and len(parts) < most:
                near = dist <= reach
                parts.append((centre, left[near], dist[near]))
                left, left_d = left[~near], left_d[~near]
                if len(left):
                    centre = int(left[0])
                    dist = np.linalg.norm(x[left] - x[centre], axis=1)
            if len(left):  # too scattered for this level: one child, around the node's own centre, keeps the rest
                parts.append((self.centre[node], left, left_d))
            if len(parts) == 1 and len(parts[0][1]) == count and float(parts[0][2].max()) >= self.radius[node]:
                continue
            if len(left) == count:
                continue
            self.kids[node] = (len(self.centre), len(parts))
            at = first
            for k, (c, own, dd) in enumerate(parts):
                self.order[at : at + len(own)] = own
                self.centre.append(c)
                self.radius.append(float(dd.max(initial=0.0)))
                self.kids.append((0, 0))
                self.points.append((at, len(own)))
                if not (len(left) and k == len(parts) - 1):
                    todo.append((len(self.centre) - 1, dd))
                at += len(own)
        self.centre, self.radius = np.array(self.centre), np.array(self.radius)
        self.kids, self.points = np.array(self.kids).reshape(-1, 2), np.array(self.points).reshape(-1, 2)


class Searcher:
    """Top k of the queries over one or more data trees. ``floor``: kth scores that are known already."""

    def __init__(self, q: np.ndarray, q_ids: np.ndarray, tree: CoverTree, k: int, floor: np.ndarray):
        self.q, self.q_ids, self.tree, self.k, self.floor = q, q_ids, tree, k, floor.copy()
        self.norms = np.linalg.norm(q, axis=1)
        self.who, self.ids, self.scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=object)
        self.visited = 0  # pairs of vectors compared

    def search(self, x: np.ndarray, ids: np.ndarray, tree: CoverTree) -> None:
        self.x, self.ids_x, self.data, self.x_norms = x, ids, tree, np.linalg.norm(x, axis=1)
        if len(x) and len(self.q):
            self._visit(0, np.array([0]))

    def _bounds(self, a: int, nodes: np.ndarray) -> np.ndarray:
        c, p = self.tree.centre[a], self.data.centre[nodes]
        s, r = self.tree.radius[a], self.data.radius[nodes]
        b = self.x[p] @ self.q[c] + self.norms[c] * r + self.x_norms[p] * s + r * s
        return b + 1e-9 * (np.abs(b) + 1)

    def _worst(self, a: int) -> float:
        first, count = self.tree.points[a]
        return float(self.floor[self.tree.order[first : first + count]].min())

    def _visit(self, a: int, nodes: np.ndarray) -> None:
        bounds = self._bounds(a, nodes)
        keep = bounds >= self._worst(a)
        nodes, bounds = nodes[keep], bounds[keep]
        if not len(nodes):
            return
        first, n_kids = self.tree.kids[a]
        inner = self.data.kids[nodes][:, 1] > 0
        if not n_kids and not inner.any():
            for i in np.argsort(-bounds, kind="stable"):
                if bounds[i] < self._worst(a):
                    break
                self._base(a, nodes[i])
            return
        below = [nodes[~inner]] + [np.arange(f, f + c) for f, c in self.data.kids[nodes[inner]]]
        nodes = np.concatenate(below)
        nodes = nodes[np.argsort(-self._bounds(a, nodes), kind="stable")]
        if not n_kids:
            self._visit(a, nodes)
            return
        for child in range(first, first + n_kids):
            self._visit(child, nodes)

    def _base(self, a: int, node: int) -> None:
        first, count = self.tree.points[a]
        rows = self.tree.order[first : first + count]
        at, n = self.data.points[node]
        for b in range(at, at + n, 8192):
            cols = self.data.order[b : min(b + 8192, at + n)]
            self._merge(rows, cols, inner(self.q[rows], self.x[cols]))

    def _merge(self, rows: np.ndarray, cols: np.ndarray, m: np.ndarray) -> None:
        """Takes those of the scores ``m`` that can be among the k best, and lifts the floors."""
        self.visited += m.size
        ok = self.ids_x[cols][None, :] != self.q_ids[rows][:, None]
        near = np.where(ok, m.astype(np.float64), -np.inf)
        floor = self.floor[rows]
        if near.shape[1] > self.k:
            floor = np.maximum(floor, np.partition(near, -self.k, axis=1)[:, -self.k])
        slack = 1e-9 * np.where(np.isfinite(floor), np.abs(floor), 0) if m.dtype == object else 0.0
        i, j = np.nonzero(ok & (near >= (floor - slack)[:, None]))
        if not len(i):
            return
        touched = np.zeros(len(self.q), dtype=bool)
        touched[rows] = True
        mine = touched[self.who]
        who = np.concatenate([self.who[mine], rows[i]])
        ids = np.concatenate([self.ids[mine], self.ids_x[cols][j]])
        scores = np.concatenate([self.scores[mine], m[i, j].astype(object) if m.dtype == object else np.array(m[i, j].astype(np.int64), dtype=object)])
        order = order_of(who, scores, ids)
        who, ids, scores = who[order], ids[order], scores[order]
        start = np.maximum.accumulate(np.where(np.diff(who, prepend=-1) != 0, np.arange(len(who)), 0))
        rank = np.arange(len(who)) - start
        last = rank == self.k - 1
        self.floor[who[last]] = np.maximum(self.floor[who[last]], scores[last].astype(np.float64))
        top = rank < self.k
        self.who, self.ids, self.scores = np.concatenate([self.who[~mine], who[top]]), np.concatenate([self.ids[~mine], ids[top]]), np.concatenate([self.scores[~mine], scores[top]])


def order_of(who: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
    if len(scores) and max(abs(int(scores.max())), abs(int(scores.min()))) < 1 << 62:
        return np.lexsort((ids, -scores.astype(np.int64), who))
    return np.array(sorted(range(len(who)), key=lambda t: (who[t], -scores[t], ids[t])), dtype=np.int64)


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-numbered rows: in doubles where none can exceed 2**53, else in Python's integers."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)))
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < EXACT:
        return a @ b.T
    whole = np.vectorize(int, otypes=[object])
    return whole(a).dot(whole(b).T)


def _blob(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _small(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the smallest type that holds them."""
    top = float(np.abs(x).max(initial=0.0))
    for kind, most in ((np.int8, 127), (np.int16, 32767), (np.int32, 2147483647)):
        if top <= most:
            return x.astype(kind)
    return x


def _quantised(vec: np.ndarray, scale: float) -> np.ndarray:
    return np.floor(vec * scale)


def _assign_task(pivots: dict[int, np.ndarray], scale: float):
    out = pa.schema([("id", pa.int64()), ("dim", pa.int32()), ("cell", pa.int32()), ("dist", pa.float64()), ("vec", pa.list_(pa.float64()))])

    def run(batches):
        for batch in batches:
            dims = batch.column(1).to_numpy()
            cell, dist = np.full(len(dims), -1, dtype=np.int32), np.full(len(dims), np.inf)
            for d, p in pivots.items():
                rows = np.flatnonzero(dims == d)
                for at in range(0, len(rows), 4096):
                    own = rows[at : at + 4096]
                    x = _quantised(matrix(batch.column(2).take(pa.array(own)), len(own)), scale)
                    if d:
                        near = np.argmin((p * p).sum(1) - 2 * (x @ p.T), axis=1)
                        cell[own], dist[own] = near, np.linalg.norm(x - p[near], axis=1)
                    else:
                        cell[own], dist[own] = 0, 0.0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dims), pa.array(cell), pa.array(dist), batch.column(2).cast(pa.list_(pa.float64()))], schema=out)

    return run


def _pack_task(scale: float, keep: int | None):
    """One row for a group: ids and quantised vectors; of equal vectors the ``keep`` with the smallest ids."""
    out = pa.schema([("dim", pa.int32()), ("cell", pa.int32()), ("part", pa.int64()), ("radius", pa.float64()), ("n", pa.int64()), ("body", pa.binary())])

    def run(t: pa.Table) -> pa.Table:
        ids, x = t["id"].to_numpy(), _quantised(matrix(t["vec"], t.num_rows), scale)
        rows = np.argsort(ids) if keep is None else first_ids(x, ids, keep)
        return pa.table([t["dim"][:1], t["cell"][:1], t["part"][:1], [float(t["dist"].to_numpy().max())], [len(ids)], [_blob(ids=ids[rows], x=_small(x[rows]))]], schema=out)

    return run


def _search_task(k: int):
    out = pa.schema([("dim", pa.int32()), ("cell", pa.int32()), ("part", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("floor", pa.float64())])

    def run(shard: pa.Table, groups: pa.Table) -> pa.Table:
        if not shard.num_rows or not groups.num_rows:
            return out.empty_table()
        done = []
        with np.load(io.BytesIO(shard["body"][0].as_py())) as body:
            x, ids = body["x"].astype(np.float64), body["ids"]
        tree = CoverTree(x)
        for g in groups.to_pylist():
            with np.load(io.BytesIO(g["q_body"])) as body:
                q, q_ids = body["x"].astype(np.float64), body["ids"]
            floor = np.frombuffer(g["floors"], dtype=np.float64) if g["floors"] else np.full(len(q), -np.inf)
            s = Searcher(q, q_ids, CoverTree(q), k, floor)
            s.search(x, ids, tree)
            n = len(s.who)
            clipped = [min(max(int(v), -(1 << 63)), (1 << 63) - 1) for v in s.scores]
            done.append(pa.table([[g["q_dim"]] * n, [g["q_cell"]] * n, [g["q_part"]] * n, q_ids[s.who], s.ids, pa.array(clipped, pa.int64()), s.floor[s.who]], schema=out))
        return pa.concat_tables(done) if done else out.empty_table()

    return run


def _bound_task(cells: dict[int, tuple], k: int, seed: bool):
    """For each query group the cells to search. ``seed``: the cells nearest by centre that hold over k rows; else those not among the seeds whose bound reaches the group's worst kth score."""
    out = pa.schema([("q_dim", pa.int32()), ("q_cell", pa.int32()), ("q_part", pa.int64()), ("floors", pa.binary()), ("q_body", pa.binary()), ("dim", pa.int32()), ("cell", pa.int32())])

    def run(batches):
        for batch in batches:
            for g in batch.to_pylist():
                names, centres, radii, counts = cells[g["dim"]]
                with np.load(io.BytesIO(g["body"])) as body:
                    q = body["x"].astype(np.float64)
                c = q.mean(0)
                s = float(np.linalg.norm(q - c, axis=1).max(initial=0.0))
                dots = centres @ c
                seeds = np.argsort(-np.where(np.isfinite(radii), dots, np.inf), kind="stable")
                seeds = seeds[: int(np.searchsorted(np.cumsum(counts[seeds]), k, "right")) + 1]
                if seed:
                    take, floors = seeds, None
                else:
                    floors = g["floors"]
                    worst = np.frombuffer(floors, dtype=np.float64).min() if floors else -np.inf
                    with np.errstate(invalid="ignore"):
                        b = dots + np.linalg.norm(c) * radii + np.linalg.norm(centres, axis=1) * s + radii * s
                    b = np.where(np.isnan(b), np.inf, b)
                    take = np.setdiff1d(np.flatnonzero(b + 1e-9 * (np.abs(b) + 1) >= worst), seeds)
                n = len(take)
                yield pa.RecordBatch.from_pydict({"q_dim": [g["dim"]] * n, "q_cell": [g["cell"]] * n, "q_part": [g["part"]] * n, "floors": [floors] * n, "q_body": [g["body"]] * n, "dim": [g["dim"]] * n, "cell": names[take].tolist()}, schema=out)

    return run


_PAIR = "q_dim int, q_cell int, q_part long, floors binary, q_body binary, dim int, cell int"
_FOUND = "dim int, cell int, part long, query_id long, vec_id long, score long, floor double"


def _search(pairs: DataFrame, shards: DataFrame, k: int) -> DataFrame:
    """Searches every shard of each pair's cell; ``TOGETHER`` query groups meet a shard in one group."""
    load = pairs.groupBy("dim", "cell").agg(F.ceil(F.count("*") / TOGETHER).alias("lots"))
    pairs = pairs.withColumn("lot_", F.xxhash64("q_cell", "q_part")).join(load, ["dim", "cell"]).withColumn("lot", F.pmod("lot_", "lots")).drop("lots", "lot_")
    where = shards.select("dim", "cell", "part")
    pairs = pairs.join(where, ["dim", "cell"])
    left = shards.join(load.select(F.col("dim").alias("dim"), F.col("cell").alias("cell"), "lots"), ["dim", "cell"])
    left = left.select(F.col("dim").alias("dim"), F.col("cell").alias("cell"), F.col("part").alias("part"), "body", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lots") - 1)).alias("lot"))
    keys = ["dim", "cell", "part", "lot"]
    return left.groupBy(*keys).cogroup(pairs.groupBy(*keys)).applyInArrow(_search_task(k), _FOUND)


def exact_top_k(spark: SparkSession, vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", *, every: int = 20, k: int = 20, scale: float = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of floor(scale * vector) for the rows whose id is divisible by ``every``, against all other rows; ties to the smaller id."""
    rows = valid_vectors(vectors, id_col, vec_col, zero_ok=True)
    n, widest = rows.agg(F.count("*"), F.coalesce(F.max("dim"), F.lit(1))).first()
    n_cells = int(min(max(1, n // PER_CELL), MAX_CELLS, max(1, CELL_BYTES // (8 * max(widest, 1)))))
    pivots: dict[int, list] = {}
    for r in bounded_sample(rows, n_cells).collect():
        pivots.setdefault(r.dim, []).append(r.vec)
    centres = {d: _quantised(np.array(v, dtype=np.float64).reshape(len(v), d), scale) for d, v in pivots.items()}
    placed = materialise(spark, rows.mapInArrow(_assign_task(centres, scale), "id long, dim int, cell int, dist double, vec array<double>"), "placed")
    summary: dict[int, list] = {}
    for r in placed.groupBy("dim", "cell").agg(F.max("dist").alias("radius"), F.count("*").alias("n")).collect():  # at most n_cells, and one for each length without a pivot
        summary.setdefault(r.dim, []).append(r)
    cells = {}
    for d, own in summary.items():
        own.sort(key=lambda r: r.cell)
        c = np.array([centres[d][r.cell] if r.cell >= 0 and d else np.zeros(d) for r in own], dtype=np.float64).reshape(len(own), d)
        cells[d] = (np.array([r.cell for r in own]), c, np.array([r.radius for r in own]), np.array([r.n for r in own]))
    pack = "dim int, cell int, part long, radius double, n long, body binary"
    keys = ["dim", "cell"]
    shards = dealt(placed, keys, SHARD, "part").groupBy("dim", "cell", "part").applyInArrow(_pack_task(scale, k + 1), pack)
    shards = materialise(spark, shards, "shards")
    queries = dealt(placed.where(F.pmod("id", F.lit(every)) == 0), keys, GROUP, "part")
    groups = materialise(spark, queries.groupBy("dim", "cell", "part").applyInArrow(_pack_task(scale, None), pack), "groups")
    seeds = groups.mapInArrow(_bound_task(cells, k, True), _PAIR)
    near = materialise(spark, _search(seeds, shards, k), "near")
    kth = best(near, k, largest=True).where(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("floor"))
    known = queries.select("dim", "cell", "part", F.col("id").alias("query_id")).join(kth, "query_id", "left")
    floors = known.groupBy("dim", "cell", "part").applyInArrow(_floor_task, "dim int, cell int, part long, floors binary")
    rest = groups.join(floors.select(F.col("dim").alias("dim"), F.col("cell").alias("cell"), F.col("part").alias("part"), "floors"), ["dim", "cell", "part"])
    more = _search(rest.mapInArrow(_bound_task(cells, k, False), _PAIR), shards, k)
    return best(near.union(more).select("query_id", "vec_id", "score"), k, largest=True)


def _floor_task(t: pa.Table) -> pa.Table:
    """The known kth scores of a group's queries, in order of their ids."""
    order = np.argsort(t["query_id"].to_numpy())
    floor = t["floor"].fill_null(-np.inf).to_numpy()[order]
    return pa.table([t["dim"][:1], t["cell"][:1], t["part"][:1], pa.array([np.ascontiguousarray(floor).tobytes()])], names=["dim", "cell", "part", "floors"])


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest scores of every query."""
    return exact_top_k(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP1_SQL = """
WITH e AS (SELECT vec_id, min([floor(64 * x::DOUBLE)::BIGINT FOR x IN embedding]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 GROUP BY vec_id),
s AS (SELECT q.vec_id AS query_id, p.vec_id AS vec_id, list_dot_product(q.v::DOUBLE[], p.v::DOUBLE[])::BIGINT AS score
  FROM e q, e p WHERE q.vec_id % 20 = 0 AND p.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
