"""Words, lines, hashes and token pieces of a block of texts, without a Python loop over characters.

A block is a run of whole texts with about BLOCK_BYTES bytes (a longer text is a block of its own), so
memory in a task follows the longest text and not the partition. Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 2 << 20
SMALL_BLOCK = 1 << 18  # where a byte of text takes some 60 bytes of hashes, and a worker keeps what it once took
# White space of the word rule, and multipliers of the 64-bit finaliser.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
MIX_1, MIX_2, GOLDEN = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15
BASE = 0x5851F42D4C957F2D  # odd, so that it has an inverse modulo 2**64

_WORD_BYTE = np.ones(256, bool)
_WORD_BYTE[list(SPACES)] = False


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser on unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_2)
    return x ^ (x >> np.uint64(31))


def blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows; offsets has one entry more than the run has rows."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    whole = column.buffers()[2]
    data = np.frombuffer(whole, np.uint8) if whole is not None and whole.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + size, "right")) - 1)
        yield first, data[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first]
        first = last


def per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values[offsets[i]:offsets[i+1]] for every i; empty runs give 0."""
    total = np.zeros(len(values) + 1, np.int64 if values.dtype != np.float64 else np.float64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts, and the index of each text's first word (one entry more)."""
    is_word = _WORD_BYTE[data]
    before = np.zeros(len(data), bool)
    before[1:] = is_word[:-1]
    after = np.zeros(len(data), bool)
    after[:-1] = is_word[1:]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    ends = offsets[1:]
    after[ends[ends > 0] - 1] = False
    starts = np.flatnonzero(is_word & ~before)
    return starts, np.flatnonzero(is_word & ~after) + 1, np.searchsorted(starts, offsets)


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the \\n-split lines of all texts (an empty text has one), and each text's first line."""
    breaks = np.flatnonzero(data == 10)
    text = np.searchsorted(offsets, breaks, "right") - 1
    first = np.searchsorted(breaks, offsets) + np.arange(len(offsets))
    starts = np.empty(first[-1], np.int64)
    ends = np.empty(first[-1], np.int64)
    own = np.arange(len(breaks)) + text
    starts[first[:-1]] = offsets[:-1]
    starts[own + 1] = breaks + 1
    ends[own] = breaks
    ends[first[1:] - 1] = offsets[1:]
    return starts, ends, first


def code_points(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return per_text((data & 0xC0) != 0x80, offsets)


@cache
def byte_codes(seed: int, lower: bool = False) -> np.ndarray:
    """A random odd 64-bit number per byte; with `lower`, A-Z share those of a-z."""
    codes = np.random.default_rng(seed).integers(0, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
    if lower:
        codes[65:91] = codes[97:123]
    return codes


def place_keys(seed: int, most: int) -> np.ndarray:
    """Random numbers for the places 0 .. most - 1 of a span (and some more): of the seed and the place alone."""
    return _keys(seed, 1 << max(most - 1, 255).bit_length())


@cache
def _keys(seed: int, n: int) -> np.ndarray:
    return mix64(mix64(np.arange(n, dtype=np.uint64) * np.uint64(GOLDEN) + np.uint64(seed * MIX_1 & (1 << 64) - 1)))


@cache
def _byte_values(lower: bool) -> np.ndarray:
    values = np.arange(1, 257, dtype=np.uint64)
    if lower:
        values[65:91] = values[97:123]
    return values


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1, lower: bool = False) -> np.ndarray:
    """64-bit hashes of data[start:end]; equal bytes give equal hashes wherever they stand.

    The spans ascend and do not overlap. The hash is multilinear: every place of a span has its own random
    factor, so two unequal spans collide with a chance below 2**-56 whatever their content.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    keys = place_keys(seed, int((ends - starts).max()))
    first, last = int(starts[0]), int(ends[-1])
    place = np.arange(first, last) - np.repeat(starts, np.diff(np.append(starts, last)))
    np.minimum(place, len(keys) - 1, out=place)  # what lies between spans
    total = np.zeros(last - first + 1, np.uint64)
    np.cumsum(_byte_values(lower)[data[first:last]] * keys[place], out=total[1:])
    return mix64(total[ends - first] - total[starts - first] + (ends - starts).astype(np.uint64) * np.uint64(GOLDEN))


def run_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of `length` neighbouring hashes (may cross texts; see run_valid)."""
    n = max(0, len(hashes) - length + 1)
    out = np.zeros(n, np.uint64)
    for k in range(length):
        out = out * np.uint64(BASE) + hashes[k : k + n]
    return mix64(out + np.uint64(length))


def run_valid(first: np.ndarray, length: int) -> np.ndarray:
    """Positions whose run of `length` words stays inside its text."""
    keep = np.ones(max(0, int(first[-1]) - length + 1), bool)
    for k in range(1, length):
        at = first[1:-1] - k
        keep[at[(at >= 0) & (at < len(keep))]] = False
    return keep


def owner(first: np.ndarray) -> np.ndarray:
    """Index of the text of every item, from the index of each text's first item."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of all texts (A-Z lower-cased) and each text's first one.

    A text with 1 to width-1 words has one shingle, the whole sequence; without words it has none.
    """
    starts, ends, first = word_spans(data, offsets)
    words = span_hashes(data, starts, ends, 1, True)
    runs, valid = run_hashes(words, width), run_valid(first, width)
    counts = np.diff(first)
    many = np.maximum(counts - width + 1, 0)
    short = np.flatnonzero((counts > 0) & (counts < width))
    out_first = np.concatenate([[0], np.cumsum(np.where(counts > 0, np.maximum(many, 1), 0))])
    out = np.empty(out_first[-1], np.uint64)
    is_short = np.zeros(len(counts), bool)
    is_short[short] = True
    place = ~is_short[owner(out_first)]
    out[place] = runs[valid]
    for t in short:
        seq = words[first[t] : first[t + 1]]
        out[out_first[t]] = run_hashes(seq, len(seq))[0]
    return out, out_first


class Places:
    """Open-addressing table from 64-bit hashes to whole numbers, looked up for whole arrays."""

    def __init__(self, bits: int = 22):
        self.bits, self.count = bits, 0
        self.keys = np.zeros(1 << bits, np.uint64)
        self.values = np.full(1 << bits, -1, np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The value of every hash, -1 where it has none."""
        out = np.full(len(hashes), -1, np.int32)
        todo = np.arange(len(hashes))
        slot = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(todo):
            value, same = self.values[slot], self.keys[slot] == hashes[todo]
            hit = same & (value >= 0)
            out[todo[hit]] = value[hit]
            on = ~same & (value >= 0)
            todo, slot = todo[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out

    def add(self, hashes: np.ndarray, values: np.ndarray) -> None:
        """Add distinct hashes that have no value yet; the table must stay under three quarters full."""
        self.count += len(hashes)
        slot = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        values = values.astype(np.int32)
        while len(hashes):
            free = self.values[slot] < 0
            self.values[slot[free]] = values[free]
            won = free & (self.values[slot] == values)
            self.keys[slot[won]] = hashes[won]
            hashes, values, slot = hashes[~won], values[~won], (slot[~won] + ~free[~won]) & ((1 << self.bits) - 1)


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions starts[0] .. starts[0]+sizes[0]-1, starts[1] .. and so on."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)
