"""BPE encoding and decoding with a word lexicon and exact merges.

The vocabulary file's steps are applied in Spark tasks: special strings become
their ids, the text between is normalised (NFC, runs of white space to one
space, lower case), cut into pre-tokens and byte-mapped.  A pre-token found in
the lexicon, a minimal acyclic transducer compiled from the frequent words of
the corpus and memory-mapped by every task, gets its ids from there; all others
are merged exactly (``merging``).  Decoding joins the id's token strings with
spaces, as the library does for a file without a decoder.

Frequent words: letter runs with at least ``FREQUENT`` of all letter runs.
There are at most 1 / FREQUENT of them, so the compiled lexicon has a proven
bound and may be broadcast.  It only saves work: results do not depend on it.

Scale: one counting pass (map-side combined, shuffling distinct words only)
and one map-only pass; a task's memos are of bounded size.
"""
from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordfold.llm import common
from recordfold.llm.merging import PairTable, merge_all
from recordfold.llm.transducer import Lexicon, compile_lexicon

FREQUENT = 1 / 200_000
MEMO, GROUP = 250_000, 50_000
END = "</w>"
_WHITE = r"\t-\r \x85\xa0  -     　"
#: Texts of these characters only need no normalisation but lower case, and the
#: pattern below cuts them as the general one does.
_PLAIN = re.compile(r"[^\t-\r -~\xc0-\xd6\xd8-\xf6\xf8-įı-ɏ]")
_LETTER = r"A-Za-z\xc0-\xd6\xd8-\xf6\xf8-ɏ"
_PLAIN_CUT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^\t-\r {_LETTER}0-9]+")
_CUT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{_WHITE}\p{{L}}\p{{N}}]+")
_SPACES = regex.compile(f"[{_WHITE}]+")


def byte_letters() -> list[str]:
    """The printable stand-in of each byte value, as byte-level vocabularies use it."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {}, 256
    for b in range(256):
        if b in keep:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return [out[b] for b in range(256)]


def lower(text: str) -> str:
    """Lower case of each character by itself (no final-sigma rule)."""
    return text.replace("Σ", "σ").lower()


def pretokens(text: str) -> list[str]:
    """Normalised pre-tokens of a text without special strings."""
    if not _PLAIN.search(text):
        return _PLAIN_CUT.findall(text.lower())
    return _CUT.findall(lower(_SPACES.sub(" ", unicodedata.normalize("NFC", text))))


class Vocabulary:
    """Tables of a word-end BPE vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        steps = [n["type"] for n in (file["normalizer"] or {}).get("normalizers", [])]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != END or steps != ["NFC", "Replace", "Lowercase"] or file["decoder"]:
            raise ValueError("a lower-casing BPE vocabulary with word ends and no decoder is needed")
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.tokens = {i: t for t, i in [*vocab.items(), *self.special.items()]}
        self.find_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") \
            if self.special else None
        letters = byte_letters()
        self.inner = np.array([vocab.get(c, -1) for c in letters], np.int64)
        self.final = np.array([vocab.get(c + END, -1) for c in letters], np.int64)
        pairs = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            if a in vocab and b in vocab and a + b in vocab:
                pairs.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.table = PairTable(pairs)

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """Ids of pre-tokens (UTF-8) by exact merging."""
        out: list[list[int]] = []
        for i in range(0, len(words), GROUP):
            part = words[i:i + GROUP]
            raw = np.frombuffer(b"".join(part), np.uint8)
            lengths = np.fromiter(map(len, part), np.int64, len(part))
            sym = self.inner[raw]
            ends = np.cumsum(lengths) - 1
            sym[ends] = self.final[raw[ends]]
            ids, kept = merge_all(self.table, sym, lengths)
            ids, stop = ids.tolist(), np.cumsum(kept).tolist()
            out += [[x for x in ids[b - n:b] if x >= 0] for b, n in zip(stop, kept.tolist())]
        return out


class Codec:
    """Encodes and decodes texts in one task."""

    def __init__(self, path: str, lexicon: bytes):
        self.vocab, self.lexicon = Vocabulary(path), Lexicon(lexicon)
        self.memo: dict[str, tuple[int, str, str]] = {}

    def _entry(self, ids: list[int]) -> tuple[int, str, str]:
        return len(ids), " ".join(map(str, ids)), " ".join(map(self.vocab.tokens.__getitem__, ids))

    def learn(self, words: set[str]) -> None:
        if len(self.memo) > MEMO:
            self.memo.clear()
        new = [w for w in words if w not in self.memo]
        raw = [w.encode("utf-8", "surrogatepass") for w in new]
        at = self.lexicon.find(raw).tolist()
        rest = [k for k, i in enumerate(at) if i < 0]
        merged = dict(zip(rest, self.vocab.merge([raw[k] for k in rest])))
        for k, w in enumerate(new):
            self.memo[w] = self._entry(merged[k] if at[k] < 0 else self.lexicon.ids_of(at[k]))

    def encode(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """(number of ids, ids as decimal text, decoded text) of each text."""
        find = self.vocab.find_special
        cut: list[list] = []
        for t in texts:
            parts: list = []
            for k, p in enumerate(find.split(t) if find and "<" in t else [t]):
                if k % 2:
                    parts.append((1, str(self.vocab.special[p]), p))
                else:
                    parts += pretokens(p)
            cut.append(parts)
        self.learn({w for c in cut for w in c if isinstance(w, str)})
        memo, out = self.memo, []
        for c in cut:
            e = [memo[w] if isinstance(w, str) else w for w in c]
            e = [x for x in e if x[0]]
            out.append((sum(x[0] for x in e), " ".join([x[1] for x in e]), " ".join([x[2] for x in e])))
        return out


# ---------------------------------------------------------------- on Spark

def frequent_words(docs: DataFrame, share: float = FREQUENT) -> list[str]:
    """Letter runs that make up at least ``share`` of all letter runs: at most
    1 / share words."""
    runs = docs.select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+", -1)).alias("w")).where("w <> ''")
    counts = common.written(runs.groupBy("w").agg(F.count("w").alias("n")), "words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    return [r["w"] for r in counts.where(F.col("n") >= max(2.0, total * share)).select("w").collect()]


def corpus_lexicon(docs: DataFrame, path: str, share: float = FREQUENT) -> bytes:
    """Compiled lexicon of the frequent words of ``docs``."""
    words = sorted({p.encode() for w in frequent_words(docs, share) for p in pretokens(w)})
    return compile_lexicon(list(zip(words, Vocabulary(path).merge(words))))


_codecs: dict = {}


def _codec(path: str, shared) -> Codec:
    if shared.id not in _codecs:
        _codecs.clear()
        _codecs[shared.id] = Codec(path, shared.value)
    return _codecs[shared.id]


class _Shared:
    """A broadcast lexicon with a name tasks can keep their codec by."""

    def __init__(self, sc, blob: bytes):
        self.broadcast = sc.broadcast(blob)
        self.id = hashlib.sha256(blob).hexdigest()

    @property
    def value(self) -> bytes:
        return self.broadcast.value


def encoder(docs: DataFrame, path: str) -> Callable[[list[str]], list[tuple[int, str, str]]]:
    """Function for tasks: texts to (n, ids text, decoded text), with the lexicon of ``docs``."""
    shared = _Shared(docs.sparkSession.sparkContext, corpus_lexicon(docs, path))
    return lambda texts: _codec(path, shared).encode(texts)


def encoded(docs: DataFrame, path: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids (decimal, space-joined) and
    decoded text, and the columns ``keep`` as they are.  Null texts count as empty: no id, empty decoded text.
    Repeated rows are encoded each; extra columns are ignored."""
    return _map(docs, path, "ids string, decoded string", lambda e: (e[1], e[2]), keep)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """As ``encoded``, with SHA-256 of the id text and of the decoded text."""
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
    return _map(docs, path, "ids_sha256 string, decoded_sha256 string", lambda e: (sha(e[1]), sha(e[2])))


def _map(docs: DataFrame, path: str, columns: str, row, keep: tuple[str, ...] = ()) -> DataFrame:
    common.bounded_batches(docs.sparkSession)
    encode = encoder(docs, path)
    names = [c.split()[0] for c in columns.split(",")]

    def run(batches):
        for b in batches:
            out = encode(common.texts(b.column("text")))
            cols = list(zip(*map(row, out))) or [(), ()]
            yield pa.RecordBatch.from_pydict({
                "doc_id": b.column("doc_id"), "n_tokens": pa.array([e[0] for e in out], pa.int64()),
                **{c: pa.array(v, pa.string()) for c, v in zip(names, cols)}, **{c: b.column(c) for c in keep}})
    kind = lambda c: f"{c} {docs.schema[c].dataType.simpleString()}"
    return docs.select("doc_id", "text", *keep).mapInArrow(run, ", ".join([kind("doc_id"), "n_tokens bigint", columns, *map(kind, keep)]))
