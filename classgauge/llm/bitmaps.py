"""Document bitmaps of many keys in one block, with planes for how often a key is in a document.

Plane p of a key is the bitmap of the documents whose count of the key has bit p set. In each plane a key with few
documents is kept as a list of 16-bit places, one with many as bits, whichever is shorter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

MOST_DOCS = 1 << 16


def _spots(lengths: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(lengths)), lengths)


@dataclass
class _Plane:
    """One plane: listed places of each key, and the bits of the keys in ``dense``."""

    lengths: np.ndarray
    places: np.ndarray
    dense: np.ndarray
    bits: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, docs: np.ndarray, n_keys: int, width: int) -> _Plane:
        """From (key, document) in order, each once; ``width`` bytes hold one bit for each document."""
        lengths = np.bincount(keys, minlength=n_keys)
        many = 2 * lengths > width
        dense = np.flatnonzero(many)
        own = many[keys]
        bits = np.zeros((len(dense), width), np.uint8)
        spots = np.searchsorted(dense, keys[own])
        np.bitwise_or.at(bits, (spots, docs[own] >> 3), np.left_shift(1, docs[own] & 7).astype(np.uint8))
        return cls(np.where(many, 0, lengths), docs[~own].astype(np.uint16), dense, bits)

    def popcounts(self) -> np.ndarray:
        out = self.lengths.astype(np.int64)
        out[self.dense] += np.bitwise_count(self.bits).sum(1, dtype=np.int64)
        return out

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """The (key, document) pairs, listed ones first."""
        row, doc = np.nonzero(np.unpackbits(self.bits, axis=1, bitorder="little"))
        return np.concatenate((_spots(self.lengths), self.dense[row])), np.concatenate((self.places.astype(np.int64), doc))

    def merged(self, other: _Plane, width: int) -> _Plane:
        """The bitwise OR of two planes of the same keys and documents."""
        both = np.sort(np.concatenate([k * MOST_DOCS + d for k, d in (self.entries(), other.entries())]), kind="stable")
        both = both[np.diff(both, prepend=-1) > 0]
        return _Plane.of(both // MOST_DOCS, both % MOST_DOCS, len(self.lengths), width)

    def packed(self) -> bytes:
        head = np.array([len(self.places), len(self.dense)], np.int32)
        return head.tobytes() + self.lengths.astype(np.uint16).tobytes() + self.places.tobytes() + self.dense.astype(np.int32).tobytes() + self.bits.tobytes()


class Planes:
    """The planes of ``n_keys`` keys over ``n_docs`` documents, at most 65,536."""

    def __init__(self, n_keys: int, n_docs: int, planes: list[_Plane]):
        self.n_keys, self.n_docs, self.planes = n_keys, n_docs, planes

    @classmethod
    def of(cls, keys: np.ndarray, docs: np.ndarray, counts: np.ndarray, n_keys: int, n_docs: int) -> Planes:
        """From (key, document, count from 1), in order of key and document, each pair once."""
        if n_docs > MOST_DOCS:
            raise ValueError(f"{n_docs} documents; a block has at most {MOST_DOCS}")
        planes, width = [], (n_docs + 7) // 8
        for p in range(int(counts.max(initial=0)).bit_length()):
            own = (counts >> p & 1).astype(bool)
            planes.append(_Plane.of(keys[own], docs[own], n_keys, width))
        return cls(n_keys, n_docs, planes)

    def link_counts(self) -> np.ndarray:
        """Of each key the sum of its counts: popcounts of the planes, each twice as heavy as the last."""
        out = np.zeros(self.n_keys, np.int64)
        for p, plane in enumerate(self.planes):
            out += plane.popcounts() << p
        return out

    def doc_counts(self) -> np.ndarray:
        """Of each key the documents that have it: the popcount of its planes' OR."""
        if not self.planes:
            return np.zeros(self.n_keys, np.int64)
        any_ = self.planes[0]
        for plane in self.planes[1:]:
            any_ = any_.merged(plane, (self.n_docs + 7) // 8)
        return any_.popcounts()

    def totals(self, scores: np.ndarray) -> np.ndarray:
        """Of each document the sum of count times score over its keys: scores go back along the postings."""
        out = np.zeros(self.n_docs, np.int64)
        for p, plane in enumerate(self.planes):
            keys, docs = plane.entries()
            np.add.at(out, docs, scores[keys] << p)
        return out

    def packed(self) -> bytes:
        parts = [plane.packed() for plane in self.planes]
        head = np.array([self.n_keys, self.n_docs, len(parts), *map(len, parts)], np.int64)
        return head.tobytes() + b"".join(parts)

    @classmethod
    def unpacked(cls, blob: bytes) -> Planes:
        n_keys, n_docs, n = np.frombuffer(blob, np.int64, 3).tolist()
        sizes = np.frombuffer(blob, np.int64, n, 24).tolist()
        at, planes, width = 8 * (3 + n), [], (n_docs + 7) // 8
        for size in sizes:
            n_places, n_dense = np.frombuffer(blob, np.int32, 2, at).tolist()
            spots = np.cumsum([at + 8, 2 * n_keys, 2 * n_places, 4 * n_dense]).tolist()
            planes.append(_Plane(
                np.frombuffer(blob, np.uint16, n_keys, spots[0]).astype(np.int64),
                np.frombuffer(blob, np.uint16, n_places, spots[1]),
                np.frombuffer(blob, np.int32, n_dense, spots[2]).astype(np.int64),
                np.frombuffer(blob, np.uint8, n_dense * width, spots[3]).reshape(n_dense, width),
            ))
            at += size
        return cls(n_keys, n_docs, planes)
