"""NumPy kernels for words and word windows, straight on UTF-8 bytes.

A word is a maximal run of bytes outside ``{0x20, 0x09..0x0D}``, which for valid
UTF-8 is exactly the pattern ``[^\\x20\\x09-\\x0D]+``. Hashes take eight bytes, or two
parts of a window, at a time through a bijective mixer: they are no polynomials, so no
family of texts (periodic, alternating) cancels out in them. Whole texts are told apart
by a cryptographic digest. Byte-level work runs over pieces of about ``PIECE`` bytes, so
memory is bounded by the piece (or by one word, if that is longer) and not by a text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

PIECE = 1 << 20
LONG = 128
SLICE = 4 << 20
MOST_TEXTS = 1 << 15
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_U = np.uint64
_M1, _M2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (the one of splitmix64)."""
    x = x ^ (x >> _U(30))
    x = x * _M1
    x ^= x >> _U(27)
    x *= _M2
    x ^= x >> _U(31)
    return x


_SEEDS = (_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F))
_TURN = (_U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F))
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=_U)


def word_hashes(piece: np.ndarray, start: np.ndarray, stop: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hashes of the bytes ``start:stop`` of a piece, eight bytes a step; words over ``LONG`` bytes go one by one."""
    padded = np.zeros(len(piece) + 8, dtype=np.uint8)
    padded[: len(piece)] = piece
    lanes = np.ndarray((len(piece) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    size = stop - start
    h = mix(size.astype(_U) * _TURN[seed] + _SEEDS[seed])
    h = mix(h ^ (lanes[start] & _MASK[np.minimum(size, 8)]))
    rest = np.flatnonzero((size > 8) & (size <= LONG))
    for at in range(8, LONG, 8):
        rest = rest[size[rest] > at]
        if not len(rest):
            break
        h[rest] = mix((h[rest] * _TURN[seed]) ^ (lanes[start[rest] + at] & _MASK[np.minimum(size[rest] - at, 8)]))
    for i in np.flatnonzero(size > LONG):
        h[i] = xxhash.xxh3_64_intdigest(padded[start[i] : stop[i]].tobytes(), seed)
    return h


def _runs(words: np.ndarray, size: int, which: int) -> np.ndarray:
    """Hashes of runs of ``size`` entries, from those of runs of half as many."""
    if size == 1:
        return words
    left = 1 << (size - 1).bit_length() - 1  # the largest power of two below size
    half = _runs(words, left, which)
    n = len(words) - size + 1
    right = half if size == 2 * left else _runs(words, size - left, which)
    return mix((half[:n] * _TURN[which]) ^ right[left : left + n])


def window_hashes(words: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """Hashes of all runs of ``size`` consecutive entries (across texts, too: the caller masks those)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=_U)
    out, step = np.empty(n, dtype=_U), 1 << 15
    for at in range(0, n, step):
        m = min(step, n - at)
        out[at : at + m] = _runs(words[at : at + m + size - 1], size, which)
    return out


def digest(text: bytes) -> int:
    """64 bits that tell texts apart, byte by byte."""
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little")


class Words:
    """The words of some texts: ``hashes[i]``, byte span ``start[i]:stop[i]`` in ``data``; text t has words ``first[t]:first[t + 1]``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, seeds: tuple[int, ...] = (0,)):
        self.data, self.offsets = data, offsets
        starts, stops, hashes = [], [], {s: [] for s in seeds}
        bounds = offsets[1:-1]
        at, end = int(offsets[0]), int(offsets[-1])
        while at < end:
            to = self._cut(at, end, bounds)
            piece = data[at:to]
            inside = ~_SPACE[piece]
            opens = inside.copy()
            opens[1:] &= ~inside[:-1]
            cuts = bounds[np.searchsorted(bounds, at, "right") : np.searchsorted(bounds, to, "left")] - at
            opens[cuts] = inside[cuts]
            closes = inside.copy()
            closes[:-1] &= ~inside[1:] | opens[1:]
            s, e = np.flatnonzero(opens), np.flatnonzero(closes) + 1
            starts.append(s + at)
            stops.append(e + at)
            for seed in seeds:
                hashes[seed].append(word_hashes(piece, s, e, seed))
            at = to
        self.start = np.concatenate(starts) if starts else np.zeros(0, dtype=np.int64)
        self.stop = np.concatenate(stops) if stops else np.zeros(0, dtype=np.int64)
        self._hashes = {s: np.concatenate(h) if h else np.zeros(0, dtype=_U) for s, h in hashes.items()}
        self.first = np.searchsorted(self.start, offsets, "left")

    def _cut(self, at: int, end: int, bounds: np.ndarray) -> int:
        """Where the piece that begins at ``at`` ends: never inside a word."""
        if end - at <= PIECE:
            return end
        k = np.searchsorted(bounds, at + PIECE, "right") - 1
        best = int(bounds[k]) if k >= 0 else 0
        gaps = np.flatnonzero(_SPACE[self.data[max(at, best) + 1 : at + PIECE]])
        if len(gaps):
            return max(at, best) + 1 + int(gaps[-1])
        if best > at:
            return best
        size = PIECE  # one word longer than a piece
        while True:
            stop = min(end, at + 2 * size)
            gaps = np.flatnonzero(_SPACE[self.data[at + 1 : stop]])
            k = np.searchsorted(bounds, at, "right")
            bound = int(bounds[k]) if k < len(bounds) else end
            if len(gaps):
                return min(bound, at + 1 + int(gaps[0]))
            if bound <= stop or stop == end:
                return min(bound, stop)
            size *= 2

    def hashes(self, seed: int = 0) -> np.ndarray:
        return self._hashes[seed]

    def windows(self, size: int, which: int = 0) -> np.ndarray:
        return window_hashes(self._hashes[which], size, which)

    def digests(self, texts: np.ndarray | None = None) -> np.ndarray:
        """Two 64-bit halves of a cryptographic digest of the word sequence of each text (or some), as rows of texts."""
        of = self.offsets[:-1], self.offsets[1:]
        spans = zip(*(of if texts is None else (x[texts] for x in of)), strict=True)
        joined = (b" ".join(self.data[a:b].tobytes().split()) for a, b in spans)  # bytes.split() cuts at just those six bytes
        raw = b"".join(hashlib.blake2b(x, digest_size=16).digest() for x in joined)
        return np.frombuffer(raw, dtype="<u8").reshape(-1, 2)

    def valid(self, size: int) -> np.ndarray:
        """The first words of all windows of ``size`` words that lie in one text."""
        n = np.maximum(np.diff(self.first) - size + 1, 0)
        if not n.sum():
            return np.zeros(0, dtype=np.int64)
        base = np.repeat(self.first[:-1] - (np.cumsum(n) - n), n)
        return base + np.arange(n.sum())


def text_slices(texts: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, bytes, offsets) of runs of whole texts of about ``limit`` bytes; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        at = 0
        for chunk in texts.chunks:
            for a, b, data, offsets in text_slices(chunk, limit):
                yield at + a, at + b, data, offsets
            at += len(chunk)
        return
    if not len(texts):
        return
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64, count=len(texts) + 1 + texts.offset)[texts.offset :]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < len(texts):
        to = min(at + MOST_TEXTS, max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1))
        yield at, to, data, offsets[at : to + 1]
        at = to
