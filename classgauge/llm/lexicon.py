"""A minimal acyclic automaton over byte strings whose paths number its words in order.

States with the same continuations are one state, so suffixes are shared. An edge carries
how many words lie before those it leads to; the sum along a path is the word's number, and
the word's ids stand under that number. All tables are flat arrays in one file image.
"""

from __future__ import annotations

import mmap
import os
import tempfile

import numpy as np


def compile_lexicon(entries: dict[bytes, bytes]) -> bytes:
    """The file image of an automaton that gives each word its ids (int32, as bytes)."""
    states: dict[tuple, int] = {}
    table: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

    def settle(final: bool, edges: list) -> int:
        key = (final, tuple(edges))
        if key not in states:
            states[key] = len(table)
            table.append(key)
        return states[key]

    words = sorted(entries)
    path: list[list] = [[False, []]]  # of the last word: states that may still grow
    last = b""

    def close(depth: int) -> None:
        while len(path) - 1 > depth:
            final, edges = path.pop()
            path[-1][1].append((last[len(path) - 1], settle(final, edges)))

    for word in words:
        same = len(os.path.commonprefix((last, word)))
        close(same)
        last = word
        path.extend([False, []] for _ in word[same:])
        path[-1][0] = True
    close(0)
    root = settle(*path[0])

    held = np.zeros(len(table), np.int64)  # words below a state; its targets were settled before it
    opens, labels, targets, skips = [0], [], [], []
    for s, (final, edges) in enumerate(table):
        below = int(final)
        for label, target in edges:
            labels.append(label)
            targets.append(target)
            skips.append(below)
            below += int(held[target])
        held[s] = below
        opens.append(len(labels))
    ids = [entries[w] for w in words]
    parts = [
        np.array([root, len(table), len(labels), len(words)], np.int32), np.array(opens, np.int32), np.array(targets, np.int32),
        np.array(skips, np.int32), np.cumsum([0, *(len(i) // 4 for i in ids)]).astype(np.int32), np.frombuffer(b"".join(ids), np.int32),
        np.array(labels, np.uint8), np.array([f for f, _ in table], np.uint8),
    ]
    return b"".join(x.tobytes() for x in parts)


class Lexicon:
    """Looks words up in a file image that is mapped into memory, many at a time."""

    def __init__(self, image: bytes):
        with tempfile.TemporaryFile() as f:  # has no name, so nothing is left behind
            f.write(image)
            f.flush()
            data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        self.root, states, edges, words = np.frombuffer(data, np.int32, 4).tolist()
        at = 16

        def take(kind, n):
            nonlocal at
            view = np.frombuffer(data, kind, n, at)
            at += view.nbytes
            return view

        opens, self.targets, self.skips = take(np.int32, states + 1), take(np.int32, edges), take(np.int32, edges)
        self.spans = take(np.int32, words + 1)
        self.ids = take(np.int32, int(self.spans[words]))
        labels, self.finals = take(np.uint8, edges), take(np.uint8, states)
        self.keys = np.repeat(np.arange(states, dtype=np.int64), np.diff(opens)) << 8 | labels  # ascending

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word in the lexicon; -1 where it isn't in it."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        data, firsts = np.frombuffer(b"".join(words), np.uint8), np.concatenate(([0], np.cumsum(sizes)[:-1]))
        state, number = np.full(len(words), self.root, np.int64), np.zeros(len(words), np.int64)
        live, step = np.arange(len(words)), 0
        if not len(self.keys):
            return np.full(len(words), -1)
        while len(live := live[sizes[live] > step]):
            key = state[live] << 8 | data[firsts[live] + step]
            edge = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            there = self.keys[edge] == key
            number[live[~there]] = -1
            live, edge = live[there], edge[there]
            number[live] += self.skips[edge]
            state[live] = self.targets[edge]
            step += 1
        number[(number >= 0) & (self.finals[state] == 0)] = -1
        return number
