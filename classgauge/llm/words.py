"""Words, n-grams and their hashes straight from Arrow text buffers, with NumPy.

A word is a run of bytes other than 0x20 and 0x09-0x0D. UTF-8 never uses those bytes
inside a character, so no text is decoded. A null text counts as an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 4 << 20
PIECE_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_CODES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


class Texts:
    """Some texts in one buffer: ``data`` has their bytes, ``offsets`` where each starts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first = data, offsets, first

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def edges(self, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of words, and each text's first word; ``space`` says which bytes part words."""
        n = len(self.data)
        solid = ~space[self.data]
        opens, closes = np.ones(n + 1, bool), np.ones(n + 1, bool)
        opens[1:n] = ~solid[:-1] if n else False
        closes[: max(n - 1, 0)] = ~solid[1:]
        opens[self.offsets] = True
        closes[self.offsets[self.offsets > 0] - 1] = True
        starts = np.flatnonzero(solid & opens[:n])
        ends = np.flatnonzero(solid & closes[:n]) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES, most: int = 1 << 16) -> Iterator[Texts]:
    """The texts of a column in pieces of about ``limit`` bytes and at most ``most`` texts; a text is never divided."""
    column = pc.fill_null(pc.cast(column, pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        to = min(to, at + most, len(column))
        part = offsets[at : to + 1]
        yield Texts(data[part[0] : part[-1]], part - part[0], at)
        at = to


_POWERS: dict[int, np.ndarray] = {}


def _powers(n: int, base: int) -> np.ndarray:
    if len(_POWERS.get(base, ())) < n:
        _POWERS[base] = np.full((n >> 18) + 1 << 18, base, np.uint64)
        _POWERS[base][0] = 1
        np.multiply.accumulate(_POWERS[base], out=_POWERS[base])
    return _POWERS[base][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans, which are in order: differences of a running polynomial sum.

    Works in pieces of about a megabyte, so that the sums stay small whatever the texts' size.
    """
    out = np.zeros(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + PIECE_BYTES, "right")))
        low, high = int(starts[at]), int(ends[to - 1])
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_BYTE_CODES[data[low:high]] * _powers(high - low, _BASE), out=total[1:])
        first, last = starts[at:to] - low, ends[at:to] - low
        out[at:to] = mix((total[last] - total[first]) * _powers(high - low + 1, _INVERSE)[first] + (last - first).astype(np.uint64))
        at = to
    return out


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each window of ``width`` word hashes, by its first word's place."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for j in range(1, width):
        out *= np.uint64(_BASE)
        out += words[j : j + n]
    return mix(out)


def owners(firsts: np.ndarray) -> np.ndarray:
    """For each item, the index of its text, from the places where texts start."""
    return np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array and how often each occurs."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[at], np.diff(np.append(at, len(keys)))


def per_text(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Sums of the values of each text."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[firsts[1:]] - total[firsts[:-1]]


def distinct_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct byte strings of the spans, and for each span the number of its string; then a span of each.

    Spans are told apart by 64-bit hashes, so two strings of one chunk are taken for one
    with a chance of about the square of their number over 2^65 (1e-8 for a million).
    """
    hashes = span_hashes(data, starts, ends)
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    new = np.ones(len(ranked), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    number = np.empty(len(ranked), np.int64)
    number[order] = np.cumsum(new) - 1
    first = order[new]
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)], number, first
