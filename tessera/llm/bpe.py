"""Byte-level BPE: overlapping chunk encoding, and decoding by concatenation of raw bytes.

A text of up to ``CHUNK`` characters is pre-tokenised in one go. A longer one is cut into
chunks that overlap by ``OVERLAP`` characters; the chunks are dealt over the cluster and
pre-tokenised in parallel, each from its own start. Matching from a given start depends
only on what follows, so two neighbours agree from the first boundary on that both have in
their overlap; there they are stitched. Where they share none (one match longer than the
overlap), matching goes on from the last sure boundary into the next chunk. A chunk's last
matches may change once more text follows, so the last ``TAIL`` characters of a chunk
decide nothing. Then the pieces are encoded by the ranks of the vocabulary.

Defined cases: a null text is empty and gives no ids; rows that repeat are encoded each.
"""

from __future__ import annotations

import base64
import heapq
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import bound_batches

CHUNK, OVERLAP, TAIL = 1 << 15, 1 << 10, 64
REMEMBER, SHORT = 150_000, 256


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: lines of base64 and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Encoder(dict):
    """Ids of a pre-token as little-endian uint32 bytes. Two generations of ``REMEMBER`` pre-tokens are remembered; what is used again stays.

    Workers outlive tasks, so a task forgets all at its end.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.pieces, self.older = {v: k for k, v in ranks.items()}, {}

    def __missing__(self, token: str) -> bytes:
        if len(self) >= REMEMBER:
            self.older = dict(self)
            self.clear()
        ids = self.older.get(token) or self.packed(token.encode())
        if len(token) <= 64:
            self[token] = ids
        return ids

    def forget(self) -> None:
        self.clear()
        self.older = {}

    def packed(self, piece: bytes) -> bytes:
        ids = [self.ranks[piece]] if piece in self.ranks else self.merge(piece) if len(piece) <= SHORT else self.merge_long(piece)
        return struct.pack(f"<{len(ids)}I", *ids)

    def merge(self, piece: bytes) -> list[int]:
        """Merges the pair of lowest rank, leftmost first, until none is left."""
        ranks, none = self.ranks.get, 1 << 32
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [ranks(piece[i : i + 2], none) for i in range(len(piece) - 1)]
        while pairs and (least := min(pairs)) < none:
            i = pairs.index(least)
            parts[i] += parts.pop(i + 1)
            del pairs[i]
            if i < len(pairs):
                pairs[i] = ranks(parts[i] + parts[i + 1], none)
            if i:
                pairs[i - 1] = ranks(parts[i - 1] + parts[i], none)
        return [self.ranks[p] for p in parts]

    def merge_long(self, piece: bytes) -> list[int]:
        """The same with a heap, for pieces in which a search for each pair would be quadratic."""
        ranks, n = self.ranks, len(piece)
        stop, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(ranks[p], i, i + 2) for i in range(n - 1) if (p := piece[i : i + 2]) in ranks]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, end = heapq.heappop(heap)
            if not alive[i] or stop[i] == n or stop[stop[i]] != end:
                continue
            j = stop[i]
            alive[j] = False
            stop[i] = end
            if end < n:
                before[end] = i
                if (p := piece[i : stop[end]]) in ranks:
                    heapq.heappush(heap, (ranks[p], i, stop[end]))
            if (b := before[i]) >= 0 and (p := piece[b:end]) in ranks:
                heapq.heappush(heap, (ranks[p], b, end))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : stop[i]]])
            i = stop[i]
        return out

    def encode(self, text: str) -> bytes:
        return b"".join([self[t] for t in self.pattern.findall(text)])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@lru_cache(maxsize=4)
def _encoder(path: str, pattern: str) -> Encoder:
    return Encoder(load_ranks(path), pattern)


def bounds(pattern: regex.Pattern, text: str) -> np.ndarray:
    """Where the matches in ``text`` end."""
    return np.fromiter((m.end() for m in pattern.finditer(text)), dtype=np.int64)


def stitch(pattern: regex.Pattern, chunks: list[tuple[str, np.ndarray]], size: int) -> list[str]:
    """Pre-tokens of the whole text. Chunk k holds its characters from k * size on, with the ends of its matches."""
    out: list[str] = []
    text, ends, base = chunks[0][0], chunks[0][1], 0
    start = 0  # in ``text``: the first character that is not yet in ``out``
    for k in range(1, len(chunks)):
        following, theirs = chunks[k]
        offset = k * size - base
        sure = ends[(ends > start) & (ends <= len(text) - TAIL)]
        common = sure[np.isin(sure, theirs + offset)]
        common = common[common >= offset]
        if len(common):
            cut = int(common[0])
            out += _pieces(text, start, sure[sure <= cut])
            text, ends, base, start = following, theirs, k * size, cut - offset
            continue
        at = int(sure[-1]) if len(sure) else start
        out += _pieces(text, start, sure)
        text = text[at:offset] + following
        base, start = base + at, 0
        ends = bounds(pattern, text)
    return out + _pieces(text, start, ends[ends > start])


def _pieces(text: str, start: int, ends: np.ndarray) -> list[str]:
    edges = [start, *ends.tolist()]
    return [text[a:b] for a, b in zip(edges, edges[1:])]


_OUT = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])
_CHUNK = pa.schema([("id", pa.int64()), ("mark", pa.int64()), ("seq", pa.int64()), ("text", pa.string()), ("ends", pa.binary())])


def _encoded(encoder: Encoder, rows: list[tuple[int | None, bytes]]) -> pa.RecordBatch:
    ids = [b for _, b in rows]
    return pa.RecordBatch.from_pydict({"id": [i for i, _ in rows], "n_tokens": [len(b) // 4 for b in ids], "ids": ids, "decoded": [encoder.decode(b) for b in ids]}, schema=_OUT)


def _short_task(path: str, pattern: str):
    def run(batches):
        encoder = _encoder(path, pattern)
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    yield _encoded(encoder, [(i, encoder.encode(t or "")) for i, t in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), strict=True)])
        finally:
            encoder.forget()

    return run


def _cut_task(chunk: int, overlap: int):
    def run(batches):
        for batch in batches:
            for i, mark, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for seq, at in enumerate(range(0, len(text), chunk)):
                    yield pa.RecordBatch.from_pydict({"id": [i], "mark": [mark], "seq": [seq], "text": [text[at : at + chunk + overlap]], "ends": [None]}, schema=_CHUNK)

    return run


def _bounds_task(pattern: str):
    def run(batches):
        p = regex.compile(pattern)
        for batch in batches:
            texts = batch.column(3).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([bounds(p, t).tobytes() for t in texts], pa.binary())], schema=_CHUNK)

    return run


def _stitch_task(path: str, pattern: str, chunk: int):
    def run(t: pa.Table) -> pa.Table:
        encoder = _encoder(path, pattern)
        t = t.sort_by("seq")
        seqs = t["seq"].to_numpy()
        copies = int((seqs == 0).sum())  # rows that repeat
        rows = np.flatnonzero(np.diff(seqs, prepend=-1))
        t = t.take(pa.array(rows))
        ends = [np.frombuffer(b, dtype=np.int64) for b in t["ends"].to_pylist()]
        pieces = stitch(encoder.pattern, list(zip(t["text"].to_pylist(), ends, strict=True)), chunk)
        ids = b"".join([encoder[p] for p in pieces])
        if len(encoder) > REMEMBER // 8:
            encoder.forget()
        return pa.Table.from_batches([_encoded(encoder, [(t["id"][0].as_py(), ids)] * copies)])

    return run


def encode_documents(spark: SparkSession, docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", *, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``id_col``, ``n_tokens``, ``ids`` (little-endian uint32) and ``decoded`` (bytes), one row for each row of ``docs``. ``path`` must be readable on every executor."""
    if overlap <= TAIL:
        raise ValueError(f"chunks must overlap by more than {TAIL} characters")
    bound_batches(spark)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    out = "id long, n_tokens long, ids binary, decoded binary"
    is_long = F.coalesce(F.length("text") > chunk, F.lit(False))
    short = src.where(~is_long).mapInArrow(_short_task(path, pattern), out)
    rows = "id long, mark long, seq long, text string, ends binary"
    chunks = src.where(is_long).mapInArrow(_cut_task(chunk, overlap), rows).repartition("id", "mark", "seq")
    stitched = chunks.mapInArrow(_bounds_task(pattern), rows).groupBy("id", "mark").applyInArrow(_stitch_task(path, pattern, chunk), out)
    return short.unionByName(stitched).withColumnRenamed("id", id_col)


def op8_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded bytes of each document."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    done = encode_documents(spark, docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
