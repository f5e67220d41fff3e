"""What the vector searches share: valid rows, and dealing rows and queries to bounded groups."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def valid_vectors(df: DataFrame, id_col: str, vec_col: str, *, zero_ok: bool) -> DataFrame:
    """(id long, dim int, vec array<double>): rows with an id and a vector of finite components, once for each id.

    If an id has several rows, its least vector (in array order) counts. Vectors without
    components count as zero vectors.
    """
    v = F.col(vec_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.where(F.col(id_col).isNotNull() & v.isNotNull() & finite)
    if not zero_ok:
        rows = rows.where(F.exists(v, lambda x: x != 0))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("vec"))
    return rows.groupBy("id").agg(F.min("vec").alias("vec")).select("id", F.size("vec").alias("dim"), "vec")


def matrix(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    """A list column whose lists all have one length, as rows."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = lists.flatten().to_numpy(zero_copy_only=False) if rows else np.zeros(0)
    return flat.astype(np.float64, copy=False).reshape(rows, -1)


def bounded_sample(rows: DataFrame, n: int) -> DataFrame:
    """``n`` rows that any rerun picks again: those with the least hashes of their ids."""
    return rows.orderBy(F.xxhash64("id"), "id").limit(n)


def dealt(rows: DataFrame, keys: list[str], size: int, name: str) -> DataFrame:
    """Deals the rows of each key to groups of about ``size`` by a hash of the id, so that no key makes a large group."""
    load = rows.groupBy(*keys).agg(F.ceil(F.count("*") / size).alias("groups_"))
    return rows.join(load, keys).withColumn(name, F.pmod(F.xxhash64("id"), "groups_")).drop("groups_")


def best(candidates: DataFrame, k: int, *, largest: bool) -> DataFrame:
    """The k best rows of each query with their rank: by score, ties to the smaller id."""
    from pyspark.sql import Window

    order = F.desc("score") if largest else F.asc("score")
    w = Window.partitionBy("query_id").orderBy(order, "vec_id")
    ranked = candidates.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def first_ids(vectors: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Rows left if of equal vectors only the k with the smallest ids stay, ordered by id."""
    order = np.argsort(ids, kind="stable")
    _, group = np.unique(vectors[order], axis=0, return_inverse=True)
    by = np.argsort(group.ravel(), kind="stable")
    g = group.ravel()[by]
    start = np.maximum.accumulate(np.where(np.diff(g, prepend=-1) != 0, np.arange(len(g)), 0))
    return order[np.sort(by[np.arange(len(g)) - start < k])]
