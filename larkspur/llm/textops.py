"""Word hashes of whole Arrow batches, without a Python object per word.

A word's hash is a polynomial over its bytes taken from running sums, so the
cost is a few vector operations per byte.  A-Z count as a-z.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once.
CHUNK = 1 << 20
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_tables: dict = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Value of each byte, powers of the base and their inverses, for n positions."""
    if _tables.get("n", 0) < n:
        n = max(n, CHUNK + 1024)

        def powers(b: int) -> np.ndarray:
            out = np.full(n, b, np.uint64)
            out[0] = 1
            return np.multiply.accumulate(out)

        value = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
        value[65:91] = value[97:123]
        _tables.update(n=n, value=value, power=powers(_BASE), inverse=powers(pow(_BASE, -1, 1 << 64)))
    return _tables["value"], _tables["power"], _tables["inverse"]


def _cut(data: np.ndarray, offsets: np.ndarray):
    """Ranges (first, last, begin, end): rows [first, last) lie in data[begin:end], or part of one row does."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK, "right")) - 1)
        begin, end = int(offsets[first]), int(offsets[last])
        while end - begin > 2 * CHUNK:  # one long text: cut it at a blank
            stop, span = begin + CHUNK, CHUNK
            while stop < end and not (hits := np.flatnonzero(_BLANK[data[stop : stop + span]])).size:
                stop, span = stop + span, span * 2
            stop = min(end, stop + int(hits[0])) if stop < end else end
            yield first, last, begin, stop
            begin = stop
        yield first, last, begin, end
        first = last


class Lookup:
    """Values of 64-bit keys by open addressing; unknown keys give -1.  Its size is that of the keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        size = 1 << max(4, int(len(keys) * 2).bit_length())
        self.mask = np.uint64(size - 1)
        self.keys, self.values = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        at, left = mix(keys) & self.mask, np.arange(len(keys))
        while len(left):
            spot = at[left]
            free = self.values[spot] < 0
            won = np.zeros(len(left), bool)
            won[np.unique(spot, return_index=True)[1]] = True
            put = left[free & won]
            self.keys[at[put]], self.values[at[put]] = keys[put], values[put]
            left = left[~(free & won)]
            at[left] = (at[left] + np.uint64(1)) & self.mask

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = mix(keys) & self.mask
        out = self.values[at]
        off = np.flatnonzero((self.keys[at] != keys) & (out >= 0))
        while len(off):
            at[off] = (at[off] + np.uint64(1)) & self.mask
            out[off] = self.values[at[off]]
            off = off[(self.keys[at[off]] != keys[off]) & (out[off] >= 0)]
        return out


def word_hashes(texts: pa.Array, endings: bool = False):
    """Yields (first, counts, hashes): a run of rows from ``first``, words in each, all their hashes in order.

    A text of more than ``CHUNK`` bytes may be shared by several runs that
    begin with the same row.  With ``endings`` the low eight bits of a hash
    depend on the word's last two bytes alone.
    """
    texts = texts.cast(pa.large_string()).fill_null("")
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    for first, last, begin, end in _cut(data, offsets):
        buf = data[begin:end]
        bounds = np.clip(offsets[first : last + 1], begin, end) - begin
        if not len(buf):
            yield first, np.zeros(last - first, np.int64), np.zeros(0, np.uint64)
            continue
        ink = ~_BLANK[buf]
        edge = np.zeros(len(buf) + 1, bool)
        edge[bounds] = True
        start = ink.copy()
        start[1:] &= ~ink[:-1] | edge[1:-1]
        stop = ink.copy()
        stop[:-1] &= ~ink[1:] | edge[1:-1]
        starts, stops = np.flatnonzero(start), np.flatnonzero(stop) + 1
        value, power, inverse = _powers(len(buf))
        run = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(value[buf] * power[: len(buf)], out=run[1:])
        hashes = mix((run[stops] - run[starts]) * inverse[starts] + (stops - starts).astype(np.uint64))
        if endings:
            last, one = value[buf[stops - 1]], stops - starts > 1
            two = np.where(one, value[buf[np.maximum(stops - 2, 0)]], np.uint64(0))
            hashes = (hashes & ~np.uint64(255)) | (mix(last * np.uint64(3) + two) & np.uint64(255))
        yield first, np.diff(np.searchsorted(starts, bounds)), hashes


def rows_of_words(texts: pa.Array, endings: bool = False):
    """As ``word_hashes``, with the runs of one long text joined: every row comes once, whole."""
    held = None
    for first, counts, hashes in word_hashes(texts, endings):
        if held and held[0] == first:
            held = (first, held[1] + counts, np.concatenate([held[2], hashes]))
            continue
        if held:
            yield held
        held = (first, counts, hashes)
    if held:
        yield held
