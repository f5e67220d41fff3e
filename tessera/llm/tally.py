"""Counts over the whole corpus that neither pass through the driver nor are broadcast.

Texts are dealt to parts once, compressed (one exchange, which Spark reuses wherever the
same frame is read again in a plan). Each part sends its distinct values, sorted, with its
own counts, cut by value range; a task merges a range over all parts and sends every part
back the totals of just the values that it holds, in the same order. So a part can look up
corpus-wide counts of all it needs, and what moves is in proportion to the input.

Parts hold about ``PART`` bytes of text, or ``SPREAD`` times the root of the corpus size if
that is more, so that the messages between parts and ranges stay worth sending; there are as
many ranges as parts, so a task that merges holds as many values as one that sends.

Rows are told apart by id and text: ``marks`` holds 64 bits of a digest of the text. Rows
that agree in both are interchangeable; past the first ``SAME`` of them in a task they go to
other parts, so that no row repeated at any rate makes a large part.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import digest, mix, text_slices
from .store import bound_batches

PART, SPREAD, SAME = 4 << 20, 6.4, 64
NULL_ID = -(1 << 63)
_U = np.uint64


def planes(x: np.ndarray) -> bytes:
    """The values byte by byte, all lowest bytes first: bytes that are the same in all values then cost nothing once compressed."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def values(blobs: list[bytes], kind) -> np.ndarray:
    """What ``planes`` made, in one array."""
    size = np.dtype(kind).itemsize
    parts = [np.ascontiguousarray(np.frombuffer(b, dtype=np.uint8).reshape(size, -1).T).view(kind).ravel() for b in blobs]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=kind)


def shut(x: np.ndarray, squeeze: zstandard.ZstdCompressor | None = None) -> bytes:
    return (squeeze or zstandard.ZstdCompressor(level=1)).compress(planes(x))


def opened(blobs: list[bytes], kind) -> np.ndarray:
    expand = zstandard.ZstdDecompressor()
    return values([expand.decompress(b) for b in blobs], kind)


def part_count(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """(parts, bytes of all texts)."""
    bound_batches(docs.sparkSession)
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    return max(16, int(size // max(PART, SPREAD * size**0.5))), size


def _ipc(batch: pa.RecordBatch) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema) as w:
        w.write_batch(batch)
    return out.getvalue().to_pybytes()


_PACKED = pa.schema([("part", pa.int64()), ("ids", pa.binary()), ("marks", pa.binary()), ("sizes", pa.binary()), ("texts", pa.binary()), ("more", pa.binary())])


def _pack_task(parts: int):
    def run(batches):
        squeeze, seen = zstandard.ZstdCompressor(level=1), {}
        for batch in batches:
            own = batch.column(1).fill_null(NULL_ID).to_numpy(zero_copy_only=False)
            more = batch.num_columns > 2
            carried = batch.select(list(range(2, batch.num_columns)))
            for a, b, data, offsets in text_slices(batch.column(0), 32 << 20):
                ids = own[a:b]
                marks = np.array([digest(data[x:y].tobytes()) for x, y in zip(offsets, offsets[1:])], dtype=_U)
                rows = mix(ids.view(_U) ^ mix(marks))
                for k, row in enumerate(rows.tolist()):
                    n = seen[row] = seen.get(row, 0) + 1
                    if n > SAME:
                        rows[k] = (row + 0x9E3779B97F4A7C15 * ((n - 1) // SAME)) % (1 << 64)
                if len(seen) > 1 << 20:
                    seen.clear()
                key = (mix(rows) % _U(parts)).astype(np.int64)
                order = np.argsort(key, kind="stable")
                edges = np.flatnonzero(np.diff(key[order], prepend=-1))
                for x, y in zip(edges, np.append(edges[1:], len(key)), strict=True):
                    of = order[x:y]
                    texts = b"".join(data[offsets[t] : offsets[t + 1]].tobytes() for t in of)
                    rest = _ipc(carried.take(pa.array(of + a))) if more else None
                    columns = [[int(key[of[0]])], [ids[of].tobytes()], [marks[of].tobytes()], [(offsets[of + 1] - offsets[of]).tobytes()], [squeeze.compress(texts)], [rest]]
                    yield pa.RecordBatch.from_pydict(dict(zip(_PACKED.names, columns, strict=True)), schema=_PACKED)

    return run


def packed(docs: DataFrame, parts: int) -> DataFrame:
    """``docs`` (text string, id long, columns to carry) by part: many rows a line, texts compressed together."""
    return docs.mapInArrow(_pack_task(parts), "part long, ids binary, marks binary, sizes binary, texts binary, more binary")


def unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, marks, bytes, offsets) of all texts in lines of ``packed``."""
    expand = zstandard.ZstdDecompressor()
    read = lambda name, kind: np.concatenate([np.frombuffer(b, dtype=kind) for b in table[name].to_pylist()] or [np.zeros(0, dtype=kind)])
    data = np.frombuffer(b"".join(expand.decompress(b) for b in table["texts"].to_pylist()), dtype=np.uint8)
    return read("ids", np.int64), read("marks", _U), data, np.concatenate([[0], np.cumsum(read("sizes", np.int64))])


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and how often each occurs."""
    x = np.sort(x)
    edges = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, dtype=np.int64)
    return x[edges], np.diff(np.append(edges, len(x)))


_SENT = pa.schema([("range", pa.int64()), ("part", pa.int64()), ("gaps", pa.binary()), ("counts", pa.binary())])


def _kind(space: int, ranges: int) -> str:
    """The type of a value less the start of its range."""
    return "<u4" if space // ranges < (1 << 32) - 1 else "<u8"


def _send_task(make: Callable, space: int, ranges: int):
    kind = _kind(space, ranges)
    bounds = np.array([space * k // ranges for k in range(ranges)] + [space], dtype=_U)

    def run(table: pa.Table) -> pa.Table:
        own, counts = make(unpacked(table))
        edges, part, out = np.searchsorted(own, bounds), table["part"][0].as_py(), []
        for k in np.flatnonzero(np.diff(edges)).tolist():
            a, b = edges[k], edges[k + 1]
            out.append((k, part, shut(np.diff(own[a:b], prepend=bounds[k]).astype(kind)), shut(counts[a:b].astype(np.uint32) - np.uint32(1))))
        return pa.table([list(c) for c in zip(*out, strict=True)] if out else [[]] * 4, schema=_SENT)

    return run


_TOTALS = pa.schema([("part", pa.int64()), ("range", pa.int64()), ("totals", pa.binary())])


def _merge_task(most: int, kind: str):
    def run(table: pa.Table) -> pa.Table:
        one = [np.cumsum(opened([g], kind), dtype=kind) for g in table["gaps"].to_pylist()]  # gaps from the start of the range
        cuts, held = np.cumsum([len(x) for x in one])[:-1], np.concatenate(one)
        del one
        order = np.argsort(held)
        held = held[order]
        new = np.append(True, held[1:] != held[:-1])
        del held
        edges = np.flatnonzero(new)
        times = opened(table["counts"].to_pylist(), np.uint32)[order]
        sums = np.minimum(np.add.reduceat(times, edges, dtype=np.int64) + np.diff(np.append(edges, len(times))), most)
        totals = np.empty(len(order), dtype=np.uint32)
        totals[order] = np.repeat((sums - 1).astype(np.uint32), np.diff(np.append(edges, len(order))))
        return pa.table([table["part"], table["range"], [shut(x) for x in np.split(totals, cuts)]], schema=_TOTALS)

    return run


def totals(dealt: DataFrame, parts: int, make: Callable, space: int, most: int = (1 << 32) - 2) -> DataFrame:
    """(part, range, totals): corpus-wide counts, up to ``most``, of the values that each part of ``dealt`` holds.

    ``make`` gives a part's sorted distinct values below ``space``, and their counts. ``looked_up`` reads a part's totals.
    """
    sent = dealt.groupBy("part").applyInArrow(_send_task(make, space, parts), "range long, part long, gaps binary, counts binary")
    return sent.groupBy("range").applyInArrow(_merge_task(most, _kind(space, parts)), "part long, range long, totals binary")


def looked_up(table: pa.Table) -> np.ndarray:
    """The totals of a part's sorted distinct values, in their order."""
    found = opened(table.sort_by("range")["totals"].to_pylist(), np.uint32)
    found += np.uint32(1)
    return found
