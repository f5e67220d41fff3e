"""Substring dedup: word windows that start earlier elsewhere are cut out.

A window is ``window`` consecutive words of one document. A word goes when some window
that covers it has the same word sequence as a window that starts earlier (smaller id,
or the same id and text and an earlier start). Texts are dealt to parts; four steps in one
plan, which shuffles the texts once:

1. A count-min sketch of all window hashes: ``ROWS`` rows of ``LOAD`` cells a window, so it
   grows with the input. Each part sends the cells that its windows hit; they are merged by
   cell range, and a part gets back the merged counts of its own cells. Cells never
   undercount, so a window that occurs twice always passes: the filter loses none. Of the
   others about (1 - exp(-1 / LOAD)) ** ROWS pass, 1.4 %, at any size.
2. Windows whose cells all count two or more are grouped exactly by a 96-bit fingerprint of
   their words. A part sends only its first occurrence of a fingerprint (its later ones go in
   any case), so a passage held by a third of all rows costs one window a part.
3. The starts to cut go back to the parts.
4. Each part cuts its texts.

Defined cases: null or wordless text gives no words; a null id sorts first; rows that share
an id are told apart by their texts, and the one with the smaller digest of its text is the
earlier; rows that share id and text count as one document (none is earlier than another).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .hashing import Words, mix
from .tally import NULL_ID, distinct, looked_up, opened, packed, part_count, shut, totals, unpacked

WINDOW = 20
ROWS, LOAD = 2, 8
_U = np.uint64


def _cells(hashes: np.ndarray, width: int, row: int) -> np.ndarray:
    """The cells of the hashes in a row of the sketch; rows lie one after the other."""
    cells = mix(hashes + _U(row * 0x5851F42D4C957F2D & ((1 << 64) - 1)))
    cells %= _U(width)
    cells += _U(row * width)
    return cells


def _sketch(window: int, width: int):
    def make(texts):
        _, _, data, offsets = texts
        words = Words(data, offsets)
        hashes = words.windows(window)[words.valid(window)]
        del words
        return tuple(np.concatenate(x) for x in zip(*(distinct(_cells(hashes, width, j)) for j in range(ROWS)), strict=True))

    return make


def _repeated(hashes: np.ndarray, width: int, merged: np.ndarray) -> np.ndarray:
    """Whether the count-min estimate of each hash is over one, from the merged counts of the distinct cells, row by row."""
    passed, many, base = np.ones(len(hashes), dtype=bool), merged > 1, 0
    for j in range(ROWS):
        cells = _cells(hashes, width, j)
        order = np.argsort(cells)
        cells = cells[order]
        new = np.append(True, cells[1:] != cells[:-1])[: len(cells)]
        del cells
        edges = np.flatnonzero(new)
        passed[order] &= np.repeat(many[base : base + len(edges)], np.diff(np.append(edges, len(order))))
        base += len(edges)
    return passed


_FOUND = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("part", pa.int64()), ("ids", pa.binary()), ("marks", pa.binary()), ("rows", pa.binary()), ("starts", pa.binary()), ("h1", pa.binary()), ("h2", pa.binary())])
_FOUND_SQL = "kind int, key long, part long, ids binary, marks binary, rows binary, starts binary, h1 binary, h2 binary"
Places = tuple[np.ndarray, np.ndarray, np.ndarray]  # ids, marks, starts


def _line(kind: int, key: int, part: int, places: Places, h1: np.ndarray | None = None, h2: np.ndarray | None = None) -> tuple:
    """Windows as one line: each row is named once, and the windows point to it."""
    ids, marks, starts = places
    order = np.lexsort((starts, marks, ids))
    ids, marks, starts = ids[order], marks[order], starts[order]
    new = np.append(True, (ids[1:] != ids[:-1]) | (marks[1:] != marks[:-1]))
    hashes = [shut(h[order]) if h is not None else None for h in (h1, h2)]
    return (kind, key, part, shut(ids[new]), shut(marks[new]), shut((np.cumsum(new) - 1).astype(np.uint32)), shut(starts.astype(np.uint32)), *hashes)


def _table(lines: list[tuple]) -> pa.Table:
    return pa.table([list(c) for c in zip(*lines, strict=True)] if lines else [[]] * len(_FOUND), schema=_FOUND)


def _places(lines: list[dict]) -> Places:
    out = []
    for r in lines:
        of = opened([r["rows"]], np.uint32)
        out.append((opened([r["ids"]], np.int64)[of], opened([r["marks"]], _U)[of], opened([r["starts"]], np.uint32).astype(np.int64)))
    none = np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(none, *out, strict=True))


def _later(h1: np.ndarray, h2: np.ndarray, places: Places) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by fingerprint, then place; for each place in it whether the same fingerprint stands earlier, at another place; and whether it is the first of its fingerprint."""
    ids, marks, starts = places
    order = np.lexsort((starts, marks, ids, h2, h1))
    a, b, i, m, s = (x[order] for x in (h1, h2, ids, marks, starts))
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)]
    head = np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))
    return order, (i != i[head]) | (m != m[head]) | (s != s[head]), new


def _candidate_task(window: int, width: int, buckets: int):
    def run(table: pa.Table, merged: pa.Table) -> pa.Table:
        if not merged.num_rows:
            return _table([])
        part = table["part"][0].as_py()
        ids, marks, data, offsets = unpacked(table)
        words = Words(data, offsets)
        at = words.valid(window)
        h1 = words.windows(window)[at]
        passed = _repeated(h1, width, looked_up(merged))
        at, h1 = at[passed], h1[passed]
        del words, passed
        words = Words(data, offsets, (1,))
        h2 = (words.windows(window, 1)[at] >> _U(32)).astype(np.uint32)
        first = words.first
        doc = np.searchsorted(first, at, "right") - 1
        del words
        places = ids[doc], marks[doc], at - first[doc]
        order, later, new = _later(h1, h2, places)
        some = lambda rows: tuple(x[rows] for x in places)
        lines = [_line(1, -1, part, some(order[later]))] if later.any() else []
        keep = order[new]
        bucket = h1[keep] % _U(buckets)
        for k in np.unique(bucket).tolist():
            own = keep[bucket == k]
            lines.append(_line(0, k, part, some(own), h1[own], h2[own]))
        return _table(lines)

    return run


def _exact_task(table: pa.Table) -> pa.Table:
    lines = table.to_pylist()
    places = _places(lines)
    h1, h2 = opened([r["h1"] for r in lines], _U), opened([r["h2"] for r in lines], np.uint32)
    part = np.repeat([r["part"] for r in lines], [len(opened([r["rows"]], np.uint32)) for r in lines])
    order, later, _ = _later(h1, h2, places)
    go = order[later]
    return _table([_line(1, -1, p, tuple(x[own] for x in places)) for p in np.unique(part[go]).tolist() if len(own := go[part[go] == p])])


def _cut_task(window: int, carry: pa.Schema, untouched: bool):
    out = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), *carry])

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        to_cut: dict[tuple, list] = {}
        ids, marks, starts = _places(found.select(["ids", "marks", "rows", "starts"]).to_pylist())
        order = np.lexsort((marks, ids))
        ids, marks, starts = ids[order], marks[order], starts[order]
        edges = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (marks[1:] != marks[:-1])))[: len(ids)]
        edges = np.append(edges, len(ids))
        for a, b in zip(edges, edges[1:]):
            to_cut[int(ids[a]), int(marks[a])] = starts[a:b]
        done = []
        for k in range(docs.num_rows):
            line = docs.slice(k, 1)
            own, mark, data, offsets = unpacked(line)
            words = Words(data, offsets, ())
            n_words, n_removed, kept = np.diff(words.first), np.zeros(len(own), dtype=np.int64), []
            for t, n in enumerate(n_words):
                s = to_cut.get((int(own[t]), int(mark[t])))
                if s is None:
                    whole = data[offsets[t] : offsets[t + 1]].tobytes()
                    kept.append((whole if untouched else b" ".join(whole.split())).decode())
                    continue
                depth = np.zeros(n + 1, dtype=np.int32)
                np.add.at(depth, s, 1)
                np.add.at(depth, s + window, -1)
                gone = np.cumsum(depth[:-1]) > 0
                n_removed[t] = gone.sum()
                f = words.first[t]
                kept.append(b" ".join(data[words.start[f + i] : words.stop[f + i]].tobytes() for i in np.flatnonzero(~gone)).decode())
            rest = pa.ipc.open_stream(line["more"][0].as_py()).read_all().columns if len(carry) else []
            done.append(pa.table([pa.array(own, mask=own == NULL_ID), n_words, n_removed, kept, *rest], schema=out))
        return pa.concat_tables(done) if done else out.empty_table()

    return run


def cut_repeats(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, window: int = WINDOW, load: float = LOAD, carry: tuple[str, ...] = (), untouched: bool = False) -> DataFrame:
    """``id_col``, ``n_words``, ``n_removed`` and ``kept`` (kept words joined by one space), one row for each row of ``docs``.

    ``carry`` names columns to carry along, as ``carry_<name>``. ``untouched``: a text that loses nothing keeps its own white space.
    """
    rows = docs.select(F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("id"), *(F.col(c).alias(f"carry_{c}") for c in carry))
    parts, size = part_count(rows)
    windows = size // 6 + 1
    width = max(1 << 10, int(load * windows))
    dealt = packed(rows, parts)
    merged = totals(dealt, parts, _sketch(window, width), ROWS * width, most=2)
    found = dealt.groupBy("part").cogroup(merged.groupBy("part")).applyInArrow(_candidate_task(window, width, max(16, windows // 1_000_000)), _FOUND_SQL)
    # marks that a part found by itself pass through the exact step's exchange, each part's under a key of its own: so the candidates are made once
    keyed = found.withColumn("key", F.when(F.col("kind") == 1, -1 - F.col("part")).otherwise(F.col("key")))
    marks = keyed.groupBy("key").applyInArrow(_settle_task, _FOUND_SQL)
    fields = rows.schema.fields[2:]
    out = StructType([*StructType.fromDDL("id long, n_words long, n_removed long, kept string").fields, *fields])
    cut = dealt.groupBy("part").cogroup(marks.groupBy("part")).applyInArrow(_cut_task(window, to_arrow_schema(StructType(fields)), untouched), out)
    return cut.withColumnRenamed("id", id_col)


def _settle_task(table: pa.Table) -> pa.Table:
    """Marks pass; candidates are grouped exactly. A key holds either."""
    return table if table["kind"][0].as_py() == 1 else _exact_task(table)


def cut_documents(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", **options) -> DataFrame:
    """The columns of ``docs`` with what is left of each text (and its length in ``chars_col``, if that is there), and ``n_removed`` and ``n_words_left``."""
    rest = tuple(c for c in docs.columns if c not in (id_col, text_col, chars_col))
    cut = cut_repeats(spark, docs, id_col, text_col, carry=rest, untouched=True, **options)
    made = {id_col: F.col(id_col), text_col: F.col("kept"), chars_col: F.length("kept").cast("long")}
    return cut.select(*((made[c] if c in made else F.col(f"carry_{c}")).alias(c) for c in docs.columns), "n_removed", (F.col("n_words") - F.col("n_removed")).alias("n_words_left"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of what is kept of each document."""
    cut = cut_repeats(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
