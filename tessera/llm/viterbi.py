"""Token counts by a count-only Viterbi pass.

A text is split at spaces (those only); every word gets the mark U+2581 in front, and is segmented into
pieces of a unigram vocabulary with the largest sum of scores. An Aho-Corasick automaton
lists the pieces that end at each character; dynamic programming carries only the best
score and its number of pieces. Tie rules are those of the usual unigram tokenizers: for
one end the candidate with the earliest start holds against later ones of equal score, and
a character without a piece of its own costs the least score less 10. With byte fallback
such a character counts one piece a byte where all its bytes have pieces; otherwise a run
of unknown characters is one unknown piece.

Counts are remembered by word (bounded); words are independent, so this is exact.

Defined cases: null and empty texts have no tokens; repeated rows are counted each; a text
without spaces is one word, whatever its length.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import bound_batches

MARK, PENALTY, REMEMBER = "▁", 10.0, 1_000_000
NORMAL, BYTE = (1, 4), 6


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        shift += 7
        if b < 128:
            return value, at


def _fields(data: bytes):
    """(number, value) of a protocol buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        number, kind = key >> 3, key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind in (1, 5):
            value, at = data[at : at + (8 if kind == 1 else 4)], at + (8 if kind == 1 else 4)
        else:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        yield number, value


def load_pieces(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, kind) of a sentencepiece model file."""
    with open(path, "rb") as f:
        data = f.read()
    out = []
    for number, value in _fields(data):
        if number == 1:
            own = dict(_fields(value))
            out.append((own[1].decode(), float(np.frombuffer(own[2], dtype="<f4")[0]) if 2 in own else 0.0, own.get(3, 1)))
    return out


class Counts(dict):
    """Number of pieces by word."""

    def __init__(self, pieces: list[tuple[str, float, int]]):
        super().__init__()
        self.automaton = ahocorasick.Automaton()
        self.scores = {}
        for piece, score, kind in pieces:
            if kind in NORMAL and piece and piece not in self.scores:
                self.scores[piece] = score
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.bytes = {int(p[3:5], 16) for p, _, kind in pieces if kind == BYTE}
        self.unknown = min(self.scores.values(), default=0.0) - PENALTY

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBER:
            self.clear()
        n = self.count(MARK + word)
        if len(word) <= 64:
            self[word] = n
        return n

    def count(self, text: str) -> int:
        n = len(text)
        best, pieces, run = [None] * (n + 1), [0] * (n + 1), [False] * (n + 1)  # run: the last piece is unknown
        best[0] = 0.0
        ends: list[list] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(text):
            ends[end].append(match)
        for e in range(1, n + 1):
            top = None
            for size, score in sorted(ends[e - 1], reverse=True):  # earliest start first
                s = best[e - size] + score
                if top is None or s > top:
                    top, best[e], pieces[e], run[e] = s, s, pieces[e - size] + 1, False
            if text[e - 1] not in self.scores:
                s = best[e - 1] + self.unknown
                if top is None or s > top:
                    best[e], pieces[e], run[e] = s, pieces[e - 1] + self._fallback(text[e - 1], run[e - 1]), True
        return pieces[n]

    def _fallback(self, char: str, follows: bool) -> int:
        own = char.encode()
        if self.bytes.issuperset(own):
            return len(own)
        return 0 if follows and not self.bytes else 1


def words_of(text: str | None) -> list[str]:
    """What stands behind each mark: a mark that the text has itself is a space, and a leading space is the first word's own."""
    if not text:
        return []
    text = text.replace(MARK, " ")
    return (text[1:] if text[0] == " " else text).split(" ")


@lru_cache(maxsize=2)
def _counts(path: str) -> Counts:
    return Counts(load_pieces(path))


def _task(path: str):
    out = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("n_words", pa.int64())])

    def run(batches):
        counts = _counts(path)
        for batch in batches:
            tokens, words = [], []
            for text in batch.column(1).to_pylist():
                own = words_of(text)
                words.append(len(own))
                tokens.append(sum(counts[w] * n for w, n in Counter(own).items()) if len(own) > 64 else sum([counts[w] for w in own]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.int64()), pa.array(words, pa.int64())], schema=out)

    return run


def count_tokens(spark: SparkSession, docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_tokens`` and ``n_words`` (space-separated), one row for each row of ``docs``. ``path`` must be readable on every executor."""
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    bound_batches(spark)
    return src.mapInArrow(_task(path), "id long, n_tokens long, n_words long").withColumnRenamed("id", id_col)


def op4_unigram_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document."""
    import public_tokenizers

    return count_tokens(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
