"""Words, windows and sketches on bytes, against plain Python."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import hashing, substring, tally

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab é中\n\t 　\x1c", max_size=60)), max_size=12)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_words_and_windows(texts):
    old, hashing.PIECE = hashing.PIECE, 16
    try:
        seen = {}
        for a, b, data, offsets in hashing.text_slices(pa.array(texts, pa.string()), 50):
            words = hashing.Words(data, offsets, (0, 1))
            windows, valid = words.windows(3), set(words.valid(3).tolist())
            for t in range(a, b):
                f, n = words.first[t - a], words.first[t - a + 1] - words.first[t - a]
                own = [bytes(data[words.start[i] : words.stop[i]]).decode() for i in range(f, f + n)]
                assert own == WORD.findall(texts[t] or "")
                for i in range(n):
                    assert (f + i in valid) == (i + 3 <= n)
                    if i + 3 <= n:
                        assert seen.setdefault(tuple(own[i : i + 3]), windows[f + i]) == windows[f + i]
        assert len(set(seen.values())) == len(seen)
    finally:
        hashing.PIECE = old


@given(st.lists(st.integers(-(1 << 63), (1 << 63) - 1), max_size=50))
def test_byte_planes(values):
    x = np.array(values, dtype=np.int64)
    assert tally.values([tally.planes(x[:7]), tally.planes(x[7:])], np.int64).tolist() == values
    assert tally.opened([tally.shut(x[:7]), tally.shut(x[7:])], np.int64).tolist() == values


def test_a_word_longer_than_a_piece():
    old, hashing.PIECE = hashing.PIECE, 16
    try:
        data = np.frombuffer(b"a " + b"x" * 500 + b" b", dtype=np.uint8)
        words = hashing.Words(data, np.array([0, len(data)]))
        assert (words.stop - words.start).tolist() == [1, 500, 1]
    finally:
        hashing.PIECE = old


def alternating(n, a, b):
    """Two runs of ``n`` letters that polynomials modulo a power of two can't tell apart."""
    ones = [bin(i).count("1") % 2 for i in range(n)]
    return [a if x else b for x in ones], [b if x else a for x in ones]


def hashed(text, seeds=(0, 1)):
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    return hashing.Words(data, np.array([0, len(data)]), seeds)


def test_alternating_runs_are_told_apart():
    one, two = ("".join(x) for x in alternating(1024, "a", "b"))
    for n in (1024, 96, 64, 24):
        for seed in (0, 1):
            assert hashed(one[:n])._hashes[seed] != hashed(two[:n])._hashes[seed]
    x, y = (hashed(" ".join(w)) for w in alternating(1024, "yes", "no"))
    for size in (16, 32, 1024):
        assert x.windows(size)[0] != y.windows(size)[0]
    assert (x.digests() != y.digests()).any()
    assert (hashed("a b").digests() == hashed(" a \n b").digests()).all()


def test_the_share_of_single_windows_that_pass_does_not_grow_with_the_input():
    rng = np.random.default_rng(2)
    for windows in (50_000, 500_000):
        hashes = rng.integers(0, 1 << 63, windows).astype(np.uint64)
        width = substring.LOAD * windows
        for more in (0, 1000):
            held = np.append(hashes, hashes[:more])
            cells = np.concatenate([substring._cells(held, width, j) for j in range(substring.ROWS)])
            passed = substring._repeated(held, width, tally.distinct(cells)[1])
            assert passed[more:windows].mean() < 0.03 and passed[:more].all()
