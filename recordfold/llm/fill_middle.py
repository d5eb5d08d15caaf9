"""Fill-in-the-middle rewriting, cut at exact unit ranks by an indexable skip list.

A text is a sequence of units: runs of ASCII letters, and every other code
point by itself.  Two ranks drawn from the document's id cut it into prefix,
middle and suffix.  The cuts are found in an indexable skip list over the
units: an express lane joins the nodes that reach its height, and each of its
links carries two widths, the units and the code points it skips.  Walking
right while the rank allows it and down otherwise adds up both widths, so the
walk for a rank ends at the exact code point.

Forms: ``plain`` (the text), ``psm`` <P>prefix<S>suffix<M>middle, ``spm``
<S>suffix<P>prefix<M>middle.  A text that is empty or holds a sentinel stays
plain, so every output can be taken apart again (``restored``).

Defined results: a null text counts as empty (0 units, plain, empty output).
A null id draws as the digits of no number, ``1:``.  Repeated rows get equal
results; an empty table gives none.  Extra columns are not looked at, whatever
their names.  A very long text takes memory in proportion to its length, a
few numbers per unit; texts are handled one at a time.

Scale: one pass, no shuffle; each row depends on itself only, so a lost task
is done again with the same result.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from recordfold.llm import common

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts so many are rewritten, and of 100 rewritten ones so many as spm.
REWRITTEN, SPM = 90, 20
#: A node of the skip list reaches each further lane with a chance of one in 2**LANE_BITS.
LANE_BITS = 3


class Rewritten(NamedTuple):
    n: int
    form: str
    prefix_chars: int | None
    middle_chars: int | None
    output: str


def unit_starts(text: str) -> np.ndarray:
    """The code point at which each unit starts."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = points | 32
    letter = (low >= 97) & (low <= 122)
    inside = letter.copy()
    inside[1:] &= letter[:-1]
    inside[:1] = False
    return np.flatnonzero(~inside)


def _heights(n: int) -> np.ndarray:
    """Lanes above the lowest that nodes 1..n reach: geometric, from a mixed
    counter (the same list for the same n, whatever the text)."""
    x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    lowest = x & (~x + np.uint64(1))
    zeros = np.where(lowest > 0, np.log2(np.maximum(lowest, np.uint64(1)).astype(np.float64)), 63).astype(np.int64)
    return zeros // LANE_BITS


class SkipList:
    """Units by rank.  ``lanes[h]`` has the nodes of height h and more: for each
    link the units and the code points it skips, and the place of its target in
    the lane below.  Place 0 is the head, which stands before all units."""

    def __init__(self, starts: np.ndarray, chars: int):
        ends = np.append(starts[1:], chars) if len(starts) else starts
        at, after = np.arange(len(starts) + 1), np.concatenate([[0], ends])  # units and code points up to each node
        height = _heights(len(starts))
        self.lanes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        below, h = np.arange(len(starts) + 1), 0
        while True:
            self.lanes.append((np.diff(at), np.diff(after), below))
            h += 1
            up = np.concatenate([[True], height[at[1:] - 1] >= h])
            if up.sum() <= 1:
                break
            at, after, below = at[up], after[up], np.flatnonzero(up)

    def chars_before(self, rank: int) -> int:
        """Code points of the first ``rank`` units."""
        place = units = chars = 0
        for unit_width, char_width, below in reversed(self.lanes):
            while place < len(unit_width) and units + unit_width[place] <= rank:
                units += unit_width[place]
                chars += char_width[place]
                place += 1
            place = below[place]
        assert units == rank
        return int(chars)


def draws(doc_id: int | None) -> tuple[int, ...]:
    """h1 to h4 of a document."""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(h[i:i + 8], 16) for i in range(0, 32, 8))


def rewrite(doc_id: int | None, text: str) -> Rewritten:
    """The text of one document in its form."""
    starts = unit_starts(text)
    n = len(starts)
    h1, h2, h3, h4 = draws(doc_id)
    if not text or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= REWRITTEN:
        return Rewritten(n, "plain", None, None, text)
    units = SkipList(starts, len(text))
    a, b = (units.chars_before(r) for r in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < SPM:
        return Rewritten(n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}")
    return Rewritten(n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}")


def restored(output: str, form: str) -> str:
    """The text that ``output`` was made from."""
    if form == "plain":
        return output
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    one, _, rest = output[len(first):].partition(second)
    two, _, middle = rest.partition(MIDDLE)
    return two + middle + one if form == "spm" else one + middle + two


_OUT = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
                  ("middle_chars", pa.int64()), ("output", pa.string())])
_OUT_DDL = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
_DIGEST = pa.schema([*list(_OUT)[:-1], ("output_sha256", pa.string()), ("restored_sha256", pa.string())])
_DIGEST_DDL = _OUT_DDL.replace("output string", "output_sha256 string, restored_sha256 string")


def _each(docs: DataFrame, row, schema: pa.Schema, ddl: str) -> DataFrame:
    common.bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = ("" if t is None else t.as_py() or "" for t in b.column(1))
            yield from common.rows_to_batches((row(i, t) for i, t in zip(b.column(0).to_pylist(), texts)), schema, 200)
    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, ddl)


def rewritten(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the rewritten text of every document."""
    return _each(docs, lambda i, t: (i, *rewrite(i, t)), _OUT, _OUT_DDL)


def digests(docs: DataFrame) -> DataFrame:
    """``rewritten`` with the digests of the output and of the text restored from it."""
    def sha(t: str) -> str:
        return hashlib.sha256(t.encode()).hexdigest()

    def row(i: int | None, t: str) -> tuple:
        r = rewrite(i, t)
        return i, r.n, r.form, r.prefix_chars, r.middle_chars, sha(r.output), sha(restored(r.output, r.form))
    return _each(docs, row, _DIGEST, _DIGEST_DDL)
