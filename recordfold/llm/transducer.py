"""Minimal acyclic transducer: sorted byte strings to their rank in the set.

Built word by word with shared prefixes and suffixes (equal right languages
are one state).  Every arc carries how many words are passed by taking it, so
the outputs along a word's path add up to its index, and any per-word data (the
token ids here) lies in arrays in that order.  The automaton is flat arrays in
one byte string, which readers memory-map; look-ups walk all words of a batch
one byte at a time.
"""
from __future__ import annotations

import mmap
import struct
import tempfile
from collections.abc import Sequence

import numpy as np


def compile_lexicon(entries: Sequence[tuple[bytes, Sequence[int]]]) -> bytes:
    """Automaton and ids of (word, ids) entries as one byte string.  Repeated
    words keep their first entry; empty words are left out."""
    table: dict[bytes, Sequence[int]] = {}
    for w, ids in entries:
        if w:
            table.setdefault(w, ids)
    words = sorted(table)
    register: dict[tuple, int] = {}
    states: list[tuple] = []  # (final, ((byte, state), ...))

    def freeze(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(states)
            states.append(key)
        return register[key]

    path: list[list] = [[False, []]]  # open states along the current word
    last = b""

    def close(depth: int) -> None:
        while len(path) - 1 > depth:
            done = freeze(path.pop())
            path[-1][1].append((last[len(path) - 1], done))
    for w in words:
        shared = 0
        while shared < min(len(last), len(w)) and last[shared] == w[shared]:
            shared += 1
        close(shared)
        path.extend([False, []] for _ in range(len(w) - shared))
        path[-1][0] = True
        last = w
    close(0)
    root = freeze(path[0])
    below = np.zeros(len(states), np.int64)
    keys, targets, outputs = [], [], []
    for s, (final, arcs) in enumerate(states):  # targets come before their sources
        passed = int(final)
        for byte, t in arcs:
            keys.append(s * 256 + byte)
            targets.append(t)
            outputs.append(passed)
            passed += below[t]
        below[s] = passed
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    sizes = [len(table[w]) for w in words]
    arrays = [np.array(keys, np.int64)[order], np.array(targets, np.int64)[order], np.array(outputs, np.int64)[order],
              np.array([f for f, _ in states], np.int64), np.append(0, np.cumsum(sizes)).astype(np.int64),
              np.array([i for w in words for i in table[w]], np.int64)]
    head = struct.pack("<qq6q", root, max(map(len, words), default=0), *map(len, arrays))
    return head + b"".join(a.tobytes() for a in arrays)


class Lexicon:
    """A compiled lexicon in a memory map (an unlinked file of this process)."""

    def __init__(self, blob: bytes):
        with tempfile.TemporaryFile() as f:
            f.write(blob)
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        self.root, self.longest, *sizes = struct.unpack_from("<qq6q", self.map)
        at, arrays = 64, []
        for n in sizes:
            arrays.append(np.frombuffer(self.map, np.int64, n, at))
            at += 8 * n
        self.keys, self.targets, self.outputs, self.final, self.offsets, self.ids = arrays

    def find(self, words: Sequence[bytes]) -> np.ndarray:
        """Index of each word, -1 if it isn't there."""
        out = np.full(len(words), -1, np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        live = np.flatnonzero((lengths > 0) & (lengths <= self.longest))
        if not len(live) or not len(self.keys):
            return out
        flat = np.frombuffer(b"".join(words[i] for i in live.tolist()), np.uint8)
        size = lengths[live]
        start = np.cumsum(size) - size
        state, total, depth = np.full(len(live), self.root), np.zeros(len(live), np.int64), 0
        while len(live):
            key = state * 256 + flat[start + depth]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[arc] == key
            live, size, start, arc, total = live[ok], size[ok], start[ok], arc[ok], total[ok]
            state, total, depth = self.targets[arc], total + self.outputs[arc], depth + 1
            ended = size == depth
            won = ended & (self.final[state] == 1)
            out[live[won]] = total[won]
            live, size, start, state, total = live[~ended], size[~ended], start[~ended], state[~ended], total[~ended]
        return out

    def ids_of(self, index: int) -> list[int]:
        return self.ids[self.offsets[index]:self.offsets[index + 1]].tolist()
