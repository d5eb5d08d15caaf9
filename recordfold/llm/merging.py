"""Rank-synchronous byte-pair merging of many sequences at once.

A batch of pre-tokens is one flat array of symbols with the sequences behind
one another (ragged).  Each round finds every sequence's lowest-rank
neighbouring pair and merges its occurrences in all sequences at the same
time; sequences without a mergeable pair leave the arrays.

Merging every occurrence at once equals merging the leftmost first: a new pair
contains the new symbol, and if all its pairs rank after it, the other
occurrences stay the lowest.  Symbols for which a table breaks this are merged
leftmost only, one per round.  Of overlapping occurrences (a a a) every second
one, from the left, is merged.
"""
from __future__ import annotations

import numpy as np

NONE = np.iinfo(np.int64).max


class PairTable:
    """Mergeable pairs: ``pairs`` maps (left, right) to (rank, merged)."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]):
        self.base = 1 + max((max(a, b, c) for (a, b), (_, c) in pairs.items()), default=0)
        items = sorted((a * self.base + b, r, c) for (a, b), (r, c) in pairs.items())
        self.keys = np.array([k for k, _, _ in items] or [-1], np.int64)
        self.ranks = np.array([r for _, r, _ in items] or [NONE], np.int64)
        self.merged = np.array([c for _, _, c in items] or [-1], np.int64)
        made: dict[int, int] = {}
        for r, c in pairs.values():
            made[c] = max(r, made.get(c, r))
        self.single = np.zeros(self.base + 1, bool)
        for (a, b), (r, _) in pairs.items():
            for x in (a, b):
                if made.get(x, -1) >= r:
                    self.single[x] = True

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Table row of each pair, -1 if it can't be merged."""
        key = np.where((left >= 0) & (right >= 0) & (left < self.base) & (right < self.base), left * self.base + right, -2)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, -1)


def merge_all(table: PairTable, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge every sequence to its end.  ``lengths`` are positive.  Returns the
    surviving symbols (sequences in order) and their number per sequence."""
    n = len(lengths)
    sym, seq = symbols.astype(np.int64), np.repeat(np.arange(n), lengths)
    done_sym, done_seq = [], []
    ranks = np.append(table.ranks, NONE)  # row -1: no pair

    def rows_at(i: np.ndarray) -> np.ndarray:
        j = np.minimum(i + 1, len(sym) - 1)
        row = table.find(sym[i], sym[j])
        row[(j == i) | (seq[i] != seq[j])] = -1
        return row

    row = rows_at(np.arange(len(sym)))
    while len(sym):
        rank = ranks[row]
        first = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
        low = np.minimum.reduceat(rank, first)
        size = np.diff(np.append(first, len(sym)))
        open_ = low != NONE
        if not open_.all():
            live = np.repeat(open_, size)
            done_sym.append(sym[~live])
            done_seq.append(seq[~live])
            sym, seq, row, rank = sym[live], seq[live], row[live], rank[live]
            low, size = low[open_], size[open_]
            if not len(sym):
                break
        hit = rank == np.repeat(low, size)
        at = np.flatnonzero(hit)
        # every second of a run of neighbouring hits (they can only overlap as a a a)
        new_run = np.append(True, at[1:] != at[:-1] + 1)
        start = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - start) % 2 == 0]
        alone = table.single[table.merged[row[at]]]
        if alone.any():
            leftmost = np.append(True, seq[at][1:] != seq[at][:-1])
            at = at[~alone | leftmost]
        sym[at] = table.merged[row[at]]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        place = np.cumsum(keep) - 1
        at = place[at]
        sym, seq, row = sym[keep], seq[keep], row[keep]
        fresh = np.unique(np.concatenate([at, np.maximum(at - 1, 0)]))
        row[fresh] = rows_at(fresh)
    if not done_sym:
        return np.zeros(0, np.int64), np.zeros(n, np.int64)
    sym, seq = np.concatenate(done_sym), np.concatenate(done_seq)
    order = np.argsort(seq, kind="stable")
    return sym[order], np.bincount(seq, minlength=n)
