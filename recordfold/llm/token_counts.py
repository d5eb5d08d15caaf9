"""Token counts of a sentence-piece BPE model by rank-synchronous merging.

A text gets one leading space mark, spaces become space marks, and it is cut
where no piece of the vocabulary can span: before a run of space marks and
around line breaks (checked against the vocabulary).  Distinct pre-tokens of a
batch are merged together as ragged arrays (``merging``); a symbol that is no
piece counts its UTF-8 bytes (byte fallback).

Scale: map-only, no shuffle; a task holds one Arrow batch, the vocabulary and
a memo of pre-token counts of bounded size (``MEMO``; it is emptied when full,
which never changes a result).
"""
from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from recordfold.llm import common
from recordfold.llm.merging import PairTable, merge_all

SPACE = "▁"
MEMO = 400_000
#: Pre-tokens merged at once.
GROUP = 50_000


class PieceCounter:
    """Counts tokens as the model's own library does."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb
        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kinds = pb.ModelProto.SentencePiece
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != pb.TrainerSpec.BPE or spec.precompiled_charsmap or spec.remove_extra_whitespaces:
            raise ValueError("a BPE model without text normalisation is needed")
        self.prefix = SPACE if spec.add_dummy_prefix else ""
        self.fallback = model.trainer_spec.byte_fallback
        pieces = {p.piece: (i, p.score) for i, p in enumerate(model.pieces) if p.type in (kinds.NORMAL, kinds.USER_DEFINED)}
        self.n_pieces = len(model.pieces)
        self.symbols = {s: i for s, (i, _) in pieces.items()}
        for c in sorted({c for s in pieces for c in s}):  # characters that are no piece themselves
            self.symbols.setdefault(c, self.n_pieces + len(self.symbols))
        rank = {s: k for k, s in enumerate(sorted(pieces, key=lambda s: -pieces[s][1]))}
        pairs = {}
        for s in pieces:
            for k in range(1, len(s)):
                if s[:k] in self.symbols and s[k:] in self.symbols:
                    pairs[self.symbols[s[:k]], self.symbols[s[k:]]] = (rank[s], self.symbols[s])
        self.table = PairTable(pairs)
        if any(SPACE in s.lstrip(SPACE) for s in pieces):
            raise ValueError("a piece has a space mark after other characters")
        lines = not any("\n" in s for s in pieces)
        self.cut = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n" if lines else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.memo: dict[str, int] = {}

    def count_pretokens(self, tokens: list[str]) -> list[int]:
        out = []
        for i in range(0, len(tokens), GROUP):
            part = tokens[i:i + GROUP]
            joined = "".join(part)
            lengths = np.fromiter(map(len, part), np.int64, len(part))
            get = self.symbols.get
            sym = np.fromiter((get(c, -1) for c in joined), np.int64, len(joined))
            # a character that is in no piece: one token, or its bytes (negative symbol)
            unknown = np.flatnonzero(sym < 0)
            sym[unknown] = [-len(joined[j].encode("utf-8", "surrogatepass")) for j in unknown.tolist()]
            left, kept = merge_all(self.table, sym, lengths)
            size = np.where(left < 0, -left if self.fallback else 1, 1)
            loose = left >= self.n_pieces
            if loose.any() and self.fallback:
                width = {v: len(k.encode()) for k, v in self.symbols.items() if v >= self.n_pieces}
                size[loose] = [width[x] for x in left[loose].tolist()]
            ends = np.cumsum(kept)
            total = np.append(0, np.cumsum(size))
            out += (total[ends] - total[ends - kept]).tolist()
        return out

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text, without begin or end."""
        cut = [self.cut.findall(self.prefix + t.replace(" ", SPACE)) if t else [] for t in texts]
        if len(self.memo) > MEMO:
            self.memo.clear()
        memo, new = self.memo, set()
        for c in cut:
            new.update(c)
        new = [t for t in new if t not in memo]
        memo.update(zip(new, self.count_pretokens(new)))
        return [sum(map(memo.__getitem__, c)) for c in cut]


@functools.lru_cache(maxsize=2)
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def token_counts(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """One row per input row: doc_id, n_bytes (UTF-8), n_tokens, over_limit
    (more than ``limit`` tokens).  Null texts count as empty: no byte, no
    token.  Repeated rows are counted each; extra columns are ignored; an empty
    table gives an empty result."""
    common.bounded_batches(docs.sparkSession)

    def run(batches):
        c = counter(model)
        for b in batches:
            t = common.texts(b.column("text"))
            n = c.count(t)
            yield pa.RecordBatch.from_pydict({
                "doc_id": b.column("doc_id"),
                "n_bytes": pa.array([len(x.encode("utf-8", "surrogatepass")) for x in t], pa.int64()),
                "n_tokens": pa.array(n, pa.int64()), "over_limit": pa.array([x > limit for x in n], pa.bool_())})
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
