"""Near-duplicates: consistent weighted sampling of TF-IDF shingles, banded, then verified.

A shingle is five consecutive words (the whole text, if it has one to four words); its
weight in a text is tf * idf, with tf its count there and idf = 1 + ln((1 + N) / (1 + df))
/ ln(1 + N), between 1 and 2: rare shingles count up to twice as much as common ones. df is
the exact number of texts with the shingle (by 48-bit hash), N that of texts with words.
Texts whose weighted Jaccard similarity (sum of minima over sum of maxima) is ``THRESHOLD``
or more are linked; classes are the connected components.

1. Texts are dealt to parts; each part gets the corpus-wide df of its own shingles and draws
   ``BANDS * ROWS`` samples a text by improved consistent weighted sampling: two texts agree
   in a sample with the probability of their similarity. At 0.8 twelve bands of four miss 1
   pair in 550.
2. Texts with the same word sequence are one node: 64 bits of a cryptographic digest. 64 further
   bits are compared within each node, and a node whose texts differ in them is split.
3. In each bucket all members are compared with one leader: n - 1 pairs, not n squared. Where
   that leaves several components, all pairs across them are settled, the leader's among them,
   but for those that the members' own distances from the leader rule out (1 - similarity is
   a metric). In buckets of up to ``SMALL`` + 1 texts these pairs are listed, once for all
   buckets that they share; larger ones are dealt to pairs of blocks, and a text is sent once
   a pair of blocks. So no pair of texts that share a bucket is capped or dropped; the work
   in a bucket grows with the number of texts outside its largest component, times its size.
4. Verification brings shingle weights together by leader, in salted groups.

Defined cases: texts without words (null, empty, blank) are singletons; the class id is
the smallest ``doc_id`` of the class, with null ids ordered first and given back as null;
rows with the same id are classed by their own texts, whatever their number.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected
from .hashing import MOST_TEXTS, PIECE, Words, mix
from .store import drop_since, materialise, most_files, written
from .tally import NULL_ID, distinct, looked_up, opened, packed, part_count, shut, totals, unpacked

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 12, 4
TEXTS = 1 << 48  # beyond all shingles: the value under which texts with words are counted
SMALL, GROUP, BLOCK = 16, 256, 128
_U = np.uint64
_LOW48 = _U((1 << 48) - 1)


def shingles(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, count), by text and shingle; shingles are 48-bit hashes."""
    at = words.valid(SHINGLE)
    doc = np.searchsorted(words.first, at, "right") - 1
    h = words.windows(SHINGLE)[at] if len(at) else np.zeros(0, dtype=_U)
    n = np.diff(words.first)
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(short):
        doc, h = np.concatenate([doc, short]), np.concatenate([h, words.digests(short)[:, 0]])
    keys = np.sort((doc.astype(_U) << _U(48)) | (h >> _U(16)))
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    edges = np.flatnonzero(new)
    keys, counts = keys[edges], np.diff(np.append(edges, len(keys)))
    return (keys >> _U(48)).astype(np.int64), keys & _LOW48, counts


def _slices(data: np.ndarray, offsets: np.ndarray):
    """(from, to, words) of runs of whole texts: few enough for ``shingles``, and of about ``PIECE`` bytes."""
    a = 0
    while a < len(offsets) - 1:
        b = min(a + MOST_TEXTS, max(a + 1, int(np.searchsorted(offsets, offsets[a] + PIECE, "right")) - 1))
        yield a, b, Words(data, offsets[a : b + 1])
        a = b


def _frequencies(texts: tuple) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of a part and in how many of its texts each is; its number of texts with words comes last."""
    _, _, data, offsets = texts
    found, n = [np.zeros(0, dtype=_U)], 0
    for _, _, words in _slices(data, offsets):
        found.append(shingles(words)[1])
        n += int((np.diff(words.first) > 0).sum())
    own, counts = distinct(np.concatenate(found))
    return (np.append(own, _U(TEXTS)), np.append(counts, n)) if n else (own, counts)


def weights(counts: np.ndarray, df: np.ndarray, n: int) -> np.ndarray:
    return (counts * (1 + np.log((1 + n) / (1 + df)) / np.log(1 + n))).astype(np.float32)


class Sampler:
    """Improved consistent weighted sampling: r, c ~ Gamma(2, 1) and beta ~ U(0, 1) for each shingle and sample come from 16 bits of a hash each, through tables of quantiles."""

    def __init__(self, samples: int = BANDS * ROWS):
        n = 1 << 16
        p = (np.arange(n) + 0.5) / n
        x = np.full(n, 2.0)
        for _ in range(60):  # Newton on the distribution function 1 - (1 + x) exp(-x)
            x = np.clip(x - (1 - (1 + x) * np.exp(-x) - p) / (x * np.exp(-x)), x / 4, x * 4)
        self.r, self.inverse, self.log_c = x.astype(np.float32), (1 / x).astype(np.float32), np.log(x).astype(np.float32)
        self.beta = p.astype(np.float32)
        self.keys = mix(np.arange(1, samples + 1, dtype=_U) * _U(0xD1342543DE82EF95))

    def sample(self, h: np.ndarray, w: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Samples (uint32) of the texts that begin at ``starts``, one row a sample."""
        out, packed, log_w = np.empty((len(self.keys), len(starts)), dtype=np.uint32), np.empty(len(h), dtype=_U), np.log(w)
        for k, key in enumerate(self.keys):
            for at in range(0, len(h), 1 << 15):
                s = slice(at, at + (1 << 15))
                z = (h[s] ^ key) * _U(0xBF58476D1CE4E5B9)
                z ^= z >> _U(32)
                z *= _U(0x94D049BB133111EB)
                r = (z >> _U(48)).astype(np.intp)
                beta = self.beta[((z >> _U(32)) & _U(0xFFFF)).astype(np.intp)]
                t = np.floor(log_w[s] * self.inverse[r] + beta)
                a = self.log_c[((z >> _U(16)) & _U(0xFFFF)).astype(np.intp)] - self.r[r] * (t - beta + np.float32(1))
                bits = a.view(np.int32)
                order = (bits ^ ((bits >> 31) & np.int32(0x7FFFFFFF))).astype(np.int64) + (1 << 31)
                mark = h[s].astype(np.uint32) + t.astype(np.int32).view(np.uint32) * np.uint32(2654435761)
                packed[s] = (order.view(_U) << _U(32)) | mark
            out[k] = np.minimum.reduceat(packed, starts).astype(np.uint32)
        return out


_sampler = lru_cache(maxsize=1)(Sampler)


def band_keys(samples: np.ndarray) -> np.ndarray:
    """One key (int64) for each band and text, as rows of texts."""
    s = samples.astype(_U).reshape(BANDS, ROWS, -1)
    key = np.arange(1, BANDS + 1, dtype=_U)[:, None] * _U(0x9E3779B97F4A7C15)
    for r in range(ROWS):
        key = mix(key ^ (s[:, r] + _U((r + 1) * 0xC2B2AE3D27D4EB4F & ((1 << 64) - 1))))
    return key.view(np.int64).T


_SIG = pa.schema([("part", pa.int64()), ("id", pa.int64()), ("row", pa.int64()), ("mark", pa.int64()), ("node", pa.int64()), ("check", pa.int64()), ("bands", pa.list_(pa.int64())), ("n", pa.int64()), ("dfs", pa.binary())])
_SIG_SQL = "part long, id long, row long, mark long, node long, check long, bands array<long>, n long, dfs binary"


def _sign_task(table: pa.Table, merged: pa.Table) -> pa.Table:
    """Node, bands and document frequencies (by shingle, in ascending order) of each text."""
    if not table.num_rows:
        return _SIG.empty_table()
    ids, rows, data, offsets = unpacked(table)
    mark = np.concatenate([pa.ipc.open_stream(m).read_all().column(0).to_numpy() for m in table["more"].to_pylist()])
    part, sampler, squeeze, found, out = table["part"][0].as_py(), _sampler(), zstandard.ZstdCompressor(level=1), looked_up(merged), []
    n = int(found[-1]) if len(found) else 0
    own = distinct(np.concatenate([shingles(words)[1] for *_, words in _slices(data, offsets)]))[0]
    for a, b, words in _slices(data, offsets):  # again: cheaper than to keep them all
        doc, h, counts = shingles(words)
        filled, size = np.diff(words.first) > 0, b - a
        node, check = words.digests().view(np.int64).T
        bands, dfs = np.zeros((size, BANDS), dtype=np.int64), [None] * size
        if len(h):
            df = found[np.searchsorted(own, h)]
            few = df.astype(np.uint32)
            starts = np.flatnonzero(np.diff(doc, prepend=-1))
            bands[doc[starts]] = band_keys(sampler.sample(h, weights(counts, df, n), starts))
            for t, x, y in zip(doc[starts], starts, np.append(starts[1:], len(h)), strict=True):
                dfs[t] = shut(few[x:y], squeeze)
        lists = pa.ListArray.from_arrays(np.arange(0, size * BANDS + 1, BANDS, dtype=np.int32), bands.ravel())
        columns = [np.full(size, part), ids[a:b], rows[a:b].view(np.int64), mark[a:b], pa.array(node, mask=~filled), check, lists, np.full(size, n), pa.array(dfs, pa.binary())]
        out.append(pa.Table.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], schema=_SIG))
    return pa.concat_tables(out)


_SET = pa.schema([("node", pa.int64()), ("h", pa.binary()), ("w", pa.binary())])


def _set_task(table: pa.Table, needed: pa.Table) -> pa.Table:
    """Shingles and weights of the rows that ``needed`` names."""
    ids, rows, data, offsets = unpacked(table)
    want = {(r["id"], r["row"]): r for r in needed.to_pylist()}
    at = [(t, r) for t, key in enumerate(zip(ids.tolist(), rows.view(np.int64).tolist(), strict=True)) if (r := want.pop(key, None))]
    out = {"node": [], "h": [], "w": []}
    for t, r in at:
        _, h, counts = shingles(Words(data, offsets[t : t + 2]))
        out["node"].append(r["node"])
        out["h"].append(h.tobytes())
        out["w"].append(weights(counts, opened([r["dfs"]], np.uint32), r["n"]).tobytes())
    return pa.table(out, schema=_SET)


def weighted_jaccard(h1, w1, h2, w2) -> float:
    at = np.minimum(np.searchsorted(h1, h2), len(h1) - 1)
    same = h1[at] == h2
    both = float(np.minimum(w1[at[same]], w2[same]).sum(dtype=np.float64))
    return both / (float(w1.sum(dtype=np.float64)) + float(w2.sum(dtype=np.float64)) - both)


def _verify_task(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    read = lambda r: (np.frombuffer(r.h, dtype=_U), np.frombuffer(r.w, dtype=np.float32))
    out = []
    if len(left):
        lead = next(left.itertuples(index=False))
        a = read(lead)
        out = [(lead.u, r.v, weighted_jaccard(*a, *read(r))) for r in right.itertuples(index=False)]
    return pd.DataFrame(out, columns=["u", "v", "sim"]).astype({"u": "int64", "v": "int64", "sim": "float64"})


def compared(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v, sim) for all ``edges`` (u, v). A node u with many edges is dealt to groups of about GROUP."""
    load = edges.groupBy("u").agg(F.ceil(F.count("*") / GROUP).alias("groups"))
    dealt = edges.join(load, "u").select("u", "v", F.pmod(F.xxhash64("v"), "groups").alias("salt"))
    fresh = lambda name: sets.select(F.col("node").alias(name), F.col("h").alias("h"), F.col("w").alias("w"))
    leads = load.select(F.col("u").alias("u"), "groups").join(fresh("u"), "u").select("u", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("salt"), "h", "w")
    members = dealt.join(fresh("v"), "v").select(F.col("u").alias("u"), F.col("salt").cast("long").alias("salt"), "v", "h", "w")
    return leads.groupBy("u", "salt").cogroup(members.groupBy("u", "salt")).applyInPandas(_verify_task, "u long, v long, sim double")


def _links(tried: DataFrame, threshold: float) -> DataFrame:
    return tried.where(F.col("sim") >= threshold - 1e-9).select("u", "v")


def _pairs(left: str, right: str) -> list:
    return [F.least(left, right).alias("u"), F.greatest(left, right).alias("v")]


def _crowded(rows: DataFrame) -> DataFrame:
    """The rows of keys with more than one node, with their number and the least node."""
    counts = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("lead")).where("n > 1")
    return rows.join(counts, "key")


def _blocks_task(threshold: float):
    reach = 1 - threshold + 1e-6

    def run(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """Links between the blocks ``left`` and ``right`` of a bucket, one for each two components that they join."""
        bucket, left, right = group
        side, node, far, bands = rows.block.to_numpy(), rows.node.to_numpy(), rows.far.to_numpy(), np.array(rows.bands.tolist(), dtype=np.int64).reshape(len(rows), -1)
        mine, theirs, out = np.flatnonzero(side == left), np.flatnonzero(side == right), []
        part = np.unique(rows.root.to_numpy(), return_inverse=True)[1]
        ends = np.cumsum([len(x) // 8 for x in rows.h])
        starts = ends - [len(x) // 8 for x in rows.h]
        w = np.frombuffer(b"".join(rows.w), dtype=np.float32)
        seen, at = np.unique(np.frombuffer(b"".join(rows.h), dtype=_U), return_inverse=True)
        mass, dense = np.add.reduceat(w, starts, dtype=np.float64), np.zeros(len(seen), dtype=np.float32)
        for i in mine:
            to = theirs[theirs > i] if left == right else theirs
            first = (bands[to] == bands[i]).argmax(axis=1)  # a pair belongs to the first bucket that it shares
            maybe = (part[to] != part[i]) & (bands[i][first] == bucket) & (np.abs(far[to] - far[i]) <= reach)
            to = to[maybe & (np.minimum(mass[to], mass[i]) >= (threshold - 1e-6) * np.maximum(mass[to], mass[i]))]
            if not len(to):
                continue
            own = slice(starts[i], ends[i])
            dense[at[own]] = w[own]
            lengths = ends[to] - starts[to]
            cells = np.concatenate([np.arange(starts[k], ends[k]) for k in to])
            both = np.add.reduceat(np.minimum(dense[at[cells]], w[cells]), np.cumsum(lengths) - lengths, dtype=np.float64)
            dense[at[own]] = 0
            for k in to[both / (mass[i] + mass[to] - both) >= threshold - 1e-9]:
                if part[k] != part[i]:
                    out.append((min(node[i], node[k]), max(node[i], node[k])))
                    part[part == part[k]] = part[i]
        return pd.DataFrame(out, columns=["u", "v"]).astype({"u": "int64", "v": "int64"})

    return run


def _block_links(spark: SparkSession, large: DataFrame, nodes: DataFrame, sets: DataFrame, threshold: float, files: int) -> DataFrame:
    """Links across components in the buckets ``large`` (key, node, root, far), whatever their size.

    A bucket's largest component and its other members are dealt to blocks of about BLOCK;
    all pairs of blocks meet, but for two of the largest component. A task holds two blocks.
    """
    parts = large.groupBy("key", "root").agg(F.count("*").alias("own"))
    split = lambda c: F.ceil(F.col(c) / BLOCK)
    keys = parts.groupBy("key").agg(F.max(F.struct("own", "root")).alias("top_"), F.sum("own").alias("all_"))
    keys = keys.select("key", F.col("top_.root").alias("main"), F.col("top_.own").alias("own"), (F.col("all_") - F.col("top_.own")).alias("other"))
    keys = keys.select("key", "main", split("own").alias("mains"), split("other").alias("others"))
    hashed, main = F.xxhash64("node", "key"), F.col("root") == F.col("main")
    block = F.when(main, F.pmod(hashed, "mains")).otherwise(F.col("mains") + F.pmod(hashed, "others"))
    dealt = large.join(keys, "key").withColumn("block", block)
    with_ = F.explode(F.sequence(F.when(main, F.col("mains")).otherwise(F.lit(0).cast("long")), F.col("mains") + F.col("others") - 1))
    dealt = dealt.select("key", "node", "root", "far", "block", with_.alias("with_"))
    dealt = dealt.select("key", "node", "root", "far", "block", F.least("block", "with_").alias("left"), F.greatest("block", "with_").alias("right"))
    full = dealt.join(nodes.select("node", "bands"), "node").join(sets, "node")
    full = full.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "key", "left", "right")  # few bytes, much work: not to be coalesced by size
    return materialise(spark, full.groupBy("key", "left", "right").applyInPandas(_blocks_task(threshold), "u long, v long"), "links", files)


def _settle(spark: SparkSession, rows: DataFrame, nodes: DataFrame, sets: DataFrame, threshold: float, files: int | None = None) -> DataFrame:
    """Links (u < v) that join all texts of similarity ``threshold`` or more that share a bucket of ``rows`` (key, node, n, lead)."""
    files = files or most_files(spark)
    edges = materialise(spark, rows.where("node <> lead").select(*_pairs("lead", "node")).distinct(), "edges", files)
    tried = materialise(spark, compared(edges, sets), "compared", files)
    roots = materialise(spark, connected(spark, _links(tried, threshold), files), "roots", files)
    rooted = rows.where("n > 2").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    far = tried.select(F.col("u").alias("lead"), F.col("v").alias("node"), (1 - F.col("sim")).alias("far"))
    placed = rooted.join(mixed, "key").join(far, ["lead", "node"], "left").select("key", "node", "root", "n", F.coalesce("far", F.lit(0.0)).alias("far"))
    placed = materialise(spark, placed, "placed", files)
    few = placed.where(F.col("n") <= SMALL + 1)
    near = F.abs(F.col("a.far") - F.col("b.far")) <= 1 - threshold + 1e-6
    across = few.alias("a").join(few.alias("b"), "key").where("a.node < b.node and a.root <> b.root").where(near)
    across = across.select(F.col("a.node").alias("u"), F.col("b.node").alias("v")).distinct().join(tried.select("u", "v"), ["u", "v"], "left_anti")
    more = materialise(spark, compared(materialise(spark, across, "edges", files), sets), "compared", files)
    large = _block_links(spark, placed.where(F.col("n") > SMALL + 1), nodes, sets, threshold, files)
    return _links(tried, threshold).union(_links(more, threshold)).union(large)


def _keyed(id_col: str, text_col: str) -> list:
    """What tells rows apart: the id, and a hash of the text."""
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64(F.col(text_col)).alias("mark")]


def _nodes(signed: DataFrame) -> DataFrame:
    """One row a node: where one of its texts is, and whether all agree in the further bits."""
    top = F.min(F.struct("check", "part", "row", "id", "bands", "n", "dfs")).alias("top")
    return signed.where("node is not null").groupBy("node").agg(top, F.max("check").alias("last")).select("node", "top.*", "last")


def _split(spark: SparkSession, signed: DataFrame, nodes: DataFrame, files: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Splits nodes whose texts differ; there are none but by chance, so most runs only look."""
    mixed = nodes.where("check <> last").select("node", F.col("check").alias("first"))
    if not mixed.take(1):
        return signed, nodes
    other = F.when(F.col("check") != F.col("first"), F.xxhash64("node", "check")).otherwise(F.col("node"))
    signed = materialise(spark, signed.join(mixed, "node", "left").withColumn("node", other).drop("first"), "signatures", files)
    return signed, materialise(spark, _nodes(signed), "nodes", files)


def _classed(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str, threshold: float) -> tuple[DataFrame, int]:
    """(id, mark, root), one row for each row of ``docs``, and how many files of such rows will do; root is null for texts without words."""
    id_, mark_ = _keyed(id_col, text_col)
    src = docs.select(F.col(text_col).alias("text"), id_, mark_)
    mark = written()
    parts, _ = part_count(src)
    files = most_files(spark, parts)
    dealt = packed(src, parts)
    merged = totals(dealt, parts, _frequencies, TEXTS + 1)
    signed = materialise(spark, dealt.groupBy("part").cogroup(merged.groupBy("part")).applyInArrow(_sign_task, _SIG_SQL), "signatures")
    nodes = materialise(spark, _nodes(signed), "nodes", files)
    signed, nodes = _split(spark, signed, nodes, files)
    rows = nodes.select("node", F.explode("bands").alias("key"))
    rows = materialise(spark, _crowded(rows), "buckets", files)
    needed = rows.select("node").distinct().join(nodes, "node").select("part", "id", "row", "node", "n", "dfs")
    sets = dealt.groupBy("part").cogroup(needed.groupBy("part")).applyInArrow(_set_task, "node long, h binary, w binary")
    sets = materialise(spark, sets, "sets")
    roots = materialise(spark, connected(spark, _settle(spark, rows, nodes, sets, threshold, files), files), "roots", files)
    drop_since(spark, mark, (signed, roots))
    return signed.select("id", "mark", "node").join(roots, "node", "left").select("id", "mark", F.coalesce("root", "node").alias("root")), files


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, threshold: float = THRESHOLD) -> DataFrame:
    """``id_col``, ``class_id`` (smallest id of the class) and ``class_size``, one row for each row of ``docs``."""
    own, files = _classed(spark, docs, id_col, text_col, threshold)
    own = own.select("id", "root")
    classes = own.where("root is not null").groupBy("root").agg(F.min("id").alias("class"), F.count("*").alias("size")).where("size > 1")
    back = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    out = own.join(classes, "root", "left").withColumn("class", F.coalesce("class", "id"))
    return out.select(back("id").alias(id_col), back("class").alias("class_id"), F.coalesce("size", F.lit(1)).cast("long").alias("class_size")).coalesce(files)


def first_of_classes(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` without those that have a near copy before them, by id and a hash of the text; texts without words all stay."""
    own, files = _classed(spark, docs, id_col, text_col, threshold)
    own = own.where("root is not null")
    first = own.groupBy("root").agg(F.min(F.struct("id", "mark")).alias("first"), F.count("*").alias("rows")).where("rows > 1")
    own = own.join(first, "root").groupBy("id", "mark").agg(F.count("*").alias("times"), F.first(F.struct("id", "mark") == F.col("first")).alias("stays"))
    own = materialise(spark, own.where("not stays or times > 1").select(F.col("id").alias("id_"), F.col("mark").alias("mark_"), "stays"), "copies", files)
    id_, mark_ = _keyed(id_col, text_col)
    same = lambda t: (id_ == t["id_"]) & (mark_ == t["mark_"])
    alone = docs.join(own, same(own), "left_anti")
    repeated = own.where("stays")
    if not repeated.take(1):
        return alone
    again = docs.join(repeated, same(repeated)).groupBy("id_", "mark_").agg(F.min(F.struct(*docs.columns)).alias("row_"))
    return alone.unionByName(again.select("row_.*"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of each document."""
    return near_duplicates(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
