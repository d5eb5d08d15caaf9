"""License scan by an exact set-similarity join of text blocks and templates.

Words are lower-cased (A-Z) runs of letters, digits and non-ASCII characters.
A template of L words is compared with windows of 2L words: one matches if it
holds at least ``threshold`` of the template's distinct words (containment).
``Templates.windows`` looks from every start, as the registered query does.
``Templates.blocks`` only takes the windows that start every L words: any L
consecutive words lie in one, which is all that phrases need, but a notice with
inserted words may straddle two.

All template words are ordered by their document frequency in the whole
corpus, rarest first.  A block can only reach the threshold if it has one of
the template's rarest ``|T| - need + 1`` words (prefix filter), ``need`` words at
all (length filter), and if the template words from its first one present on
still suffice (positional filter); the rest is counted exactly.  Phrases are
templates with containment 1 whose words must also stand consecutively.

Scale: the templates are a parameter (a small, fixed side), so the join is
map-only; a first pass counts template words only.  No text is shuffled.
"""
from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordfold.llm import common

# Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Wordings of common license notices by label.
NOTICES = {
    "apache-2.0": ["licensed under the apache license version 2 0"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that "
            "the following conditions are met"],
    "cc-by-nc": ["licensed under cc by nc 4 0"],
    "cc-by-sa": ["licensed under cc by sa 4 0"],
    "gpl": ["this work is licensed under the gnu general public license version 3",
            "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
            "license as published by the free software foundation"],
    "mit": ["released under the mit license",
            "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files to deal in the software without restriction"],
    "mpl-2.0": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
}
THRESHOLD = 0.9

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


class Templates:
    """Templates with their ordered words and prefixes."""

    def __init__(self, phrases: Mapping[str, str], notices: Mapping[str, Sequence[str]], threshold: float, order: Mapping[bytes, int]):
        """``order``: document frequency of the template words."""
        self.items = []  # (label, words, is phrase, words in global order, need, prefix)
        for label, text, exact in [*((v, k, True) for k, v in phrases.items()), *((k, t, False) for k, v in notices.items() for t in v)]:
            ws = words(text)
            if not ws:
                raise ValueError(f"template {text!r} has no word")
            rank = sorted(set(ws), key=lambda w: (order.get(w, 0), w))
            need = len(rank) if exact else math.ceil(threshold * len(rank) - 1e-9)
            self.items.append((label, ws, exact, rank, need, rank[:len(rank) - need + 1]))
        self.prefixed: dict[bytes, list[int]] = {}
        for k, item in enumerate(self.items):
            for w in item[5]:
                self.prefixed.setdefault(w, []).append(k)
        self.rare = frozenset(self.prefixed)
        self.vocabulary = frozenset(w for item in self.items for w in item[3])

    def places_of(self, ws: list[bytes]) -> dict[bytes, list[int]]:
        """Where the template words stand; nothing without a word of any prefix."""
        at: dict[bytes, list[int]] = {}
        if not self.rare.isdisjoint(ws):
            for i, w in enumerate(ws):
                if w in self.vocabulary:
                    at.setdefault(w, []).append(i)
        return at

    def windows(self, at: Mapping[bytes, list[int]]) -> Iterator[tuple[int, int, float]]:
        """(template, start, containment) of the best window of every notice that
        meets its threshold, the first of equals.  ``at``: places_of a text.

        Any window's template words lie in the window that starts at its first
        one, so only those are swept, with the words in them counted as they come and go."""
        for k in sorted({k for w in at for k in self.prefixed.get(w, ())}):
            _, template, exact, rank, need, _ = self.items[k]
            if exact or sum(w in at for w in rank) < need:
                continue
            spots = sorted((i, r) for r, w in enumerate(rank) for i in at.get(w, ()))
            held, size, end, best = [0] * len(rank), 0, 0, (need - 1, 0)
            for start, first in spots:
                while end < len(spots) and spots[end][0] < start + 2 * len(template):
                    size += not held[spots[end][1]]
                    held[spots[end][1]] += 1
                    end += 1
                if size > best[0]:
                    best = size, start
                held[first] -= 1
                size -= not held[first]
            if best[0] >= need:
                yield k, best[1], best[0] / len(rank)

    def blocks(self, ws: list[bytes], at: Mapping[bytes, list[int]] | None = None, phrases: bool = False) -> Iterator[tuple[int, int, float]]:
        """(template, first word of the block, containment) of every block that
        meets its threshold; ``phrases``: of phrases alone."""
        at = self.places_of(ws) if at is None else at
        for k in sorted({k for w in at for k in self.prefixed.get(w, ())}):
            _, template, exact, rank, need, prefix = self.items[k]
            if phrases and not exact:
                continue
            step = len(template)
            found: dict[int, set[int]] = {}
            for r, w in enumerate(rank):
                for i in at.get(w, ()):
                    for b in (i // step, i // step - 1):
                        if b < 0:
                            continue
                        if r < len(prefix):  # prefix filter: only its words open a block
                            # positional filter: the words from this one on must suffice (they do in the prefix)
                            found.setdefault(b, set()).add(r)
                        elif b in found:
                            found[b].add(r)
            for b, ranks in sorted(found.items()):
                size = min(len(ws), (b + 2) * step) - b * step
                if size >= need and len(rank) - min(ranks) >= need and len(ranks) >= need:
                    yield k, b * step, len(ranks) / len(rank)

    def places(self, ws: list[bytes], k: int, start: int) -> list[int]:
        """Where the words of phrase k stand consecutively in its block at ``start``."""
        p = self.items[k][1]
        return [i for i in range(start, min(len(ws), start + 2 * len(p)) - len(p) + 1) if ws[i:i + len(p)] == p]


def word_order(docs: DataFrame, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """Document frequency of the template words over all documents."""
    def count(batches):
        total: Counter = Counter()
        for b in batches:
            for t in b.column("text").to_pylist():
                total.update(vocabulary.intersection(words(t)))
        if total:
            yield pa.RecordBatch.from_pydict({"word": pa.array(list(total), pa.binary()), "n": pa.array(list(total.values()), pa.int64())})
    sums = docs.select("text").mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r["word"]): r["n"] for r in sums.collect()}  # at most the templates' words


def templates(docs: DataFrame, phrases=PHRASES, notices=NOTICES, threshold: float = THRESHOLD) -> Templates:
    common.bounded_batches(docs.sparkSession)
    return Templates(phrases, notices, threshold, word_order(docs, Templates(phrases, notices, threshold, {}).vocabulary))


def matching_blocks(docs: DataFrame, index: Templates) -> DataFrame:
    """Every (document, block, template) at the threshold, blocks starting every
    template length: doc_id, label, template (its words), block_word (first word of the block), containment."""
    def run(batches):
        def rows():
            for b in batches:
                for doc_id, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                    for k, start, share in index.blocks(words(t)):
                        label, template = index.items[k][:2]
                        yield doc_id, label, b" ".join(template).decode(), start, share
        return common.rows_to_batches(rows(), schema)
    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.string()), ("template", pa.string()),
                        ("block_word", pa.int64()), ("containment", pa.float64())])
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        run, "doc_id bigint, label string, template string, block_word bigint, containment double")


def scan(docs: DataFrame, phrases=PHRASES, notices=NOTICES, threshold: float = THRESHOLD, any_start: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base (places of phrases),
    first_word, last_word (smallest and largest start, else null), base_labels,
    labels (notices too), score (highest containment of a matching window, 0
    without one).  ``any_start``: notices are looked for from every word, else
    in blocks that start every template length.  Null texts have no word; repeated rows are scanned each;
    extra columns are ignored; an empty table gives an empty result."""
    index = templates(docs, phrases, notices, threshold)

    def run(batches):
        def rows():
            for b in batches:
                for doc_id, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                    ws = words(t)
                    base: set[tuple[int, int]] = set()  # (start, phrase)
                    labels, score = set(), 0.0
                    at = index.places_of(ws)
                    if any_start:
                        for k, _, share in index.windows(at):
                            labels.add(index.items[k][0])
                            score = max(score, share)
                    for k, start, share in index.blocks(ws, at, phrases=any_start):
                        if not index.items[k][2]:
                            labels.add(index.items[k][0])
                            score = max(score, share)
                            continue
                        for i in index.places(ws, k, start):
                            base.add((i, k))
                            score = 1.0
                    named = {index.items[k][0] for _, k in base}
                    yield (doc_id, len(ws), len(base), min(base)[0] if base else None, max(base)[0] if base else None,
                           ",".join(sorted(named)), ",".join(sorted(named | labels)), score)
        return common.rows_to_batches(rows(), schema)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()),
                        ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        run, "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, "
             "base_labels string, labels string, score double")
