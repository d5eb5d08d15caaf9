"""MinHash document fingerprints, banded joins and Jaccard verification.

Words are cut at ASCII white space after lowering A-Z; every run of ``SHINGLE``
words is one 64-bit hash (fewer words: one shingle of all; none: the empty
signature of all ones).  ``PERMS`` universal hash functions (multiply, add,
take the high half, modulo 2**64) permute the hashes, all at once in numpy; the
signature keeps each function's minimum.  The fingerprint is the low 16 bits
of each minimum; the share of equal entries estimates Jaccard likeness.

``near_duplicates`` joins bands of signature rows in Spark and verifies exact
Jaccard likeness; ``with_next`` fingerprints every document and the same
document with its end exchanged for the beginning of the next one;
``fingerprints`` does both, as the registered query.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordfold.llm import common
from recordfold.llm.simhash import LOWER, components

SHINGLE, PERMS, SEED = 5, 128, 20_240_229
BANDS = 32  # of PERMS / BANDS rows: a pair of likeness 0.8 is missed with probability 5e-8
LIKENESS = 0.8
#: Members of a band bucket compared in one task at a time; larger buckets are cut into pairs of blocks.
CELL = 256
#: Bands whose links are followed first.
FIRST = 4
#: Jobs that fetch the texts of sets that met, and jobs that compare the sets, one after
#: another: the shuffled texts or hashes of one are on disk at a time.
SLICES = 3
_rng = np.random.default_rng(SEED)
_A = _rng.integers(0, 2**63, PERMS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, PERMS, dtype=np.uint64)


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct 64-bit hashes of the word shingles, sorted."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    k = min(shingle, len(h))
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i:i + len(out)]
    out = out + np.uint64(k)
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(out ^ (out >> np.uint64(32)))


def signature(hashes: np.ndarray) -> np.ndarray:
    """Minimum of each permutation as u32; all ones without a shingle."""
    low = np.full(PERMS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 1024):
        x = _A[:, None] * hashes[i:i + 1024][None, :]
        x += _B[:, None]
        np.minimum(low, x.min(axis=1), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def fingerprint_bytes(sig: np.ndarray) -> bytes:
    return (sig & 0xFFFF).astype("<u2").tobytes()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard likeness: share of equal fingerprint entries, 0 to 1."""
    return float(((a ^ b) & 0xFFFF == 0).mean())


def exchanged(text: str, other: str) -> str:
    """``text`` with its last third (code points, rounded down) replaced by as
    many from the beginning of ``other``."""
    k = len(text) // 3
    return text[:len(text) - k] + other[:k]


# ------------------------------------------------------------- with_next

_ROW = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("doc_id", pa.int64()), ("tie", pa.int64()), ("n_chars", pa.int64()),
                  ("edited_sha256", pa.binary()), ("fp", pa.binary()), ("edited_fp", pa.binary()),
                  ("near_edited", pa.float64()), ("near_next", pa.float64()), ("text", pa.string())])
_DDL = ("kind int, part int, doc_id bigint, tie bigint, n_chars bigint, edited_sha256 binary, fp binary, edited_fp binary, "
        "near_edited double, near_next double, text string")
_DONE, _HEAD, _TAIL = 0, 1, 2


def _result(doc_id, tie, text: str, sig: np.ndarray, other: str, other_sig: np.ndarray) -> tuple:
    edited = exchanged(text, other)
    sig2 = signature(shingle_hashes(edited))
    return (_DONE, None, doc_id, tie, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).digest(),
            fingerprint_bytes(sig), fingerprint_bytes(sig2), likeness(sig, sig2), likeness(sig, other_sig), None)


def _along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of all rows of a sorted partition that have their next row in it;
    its first and last row go on with their texts."""
    part = TaskContext.get().partitionId()

    def rows():
        last = None
        for b in batches:
            for doc_id, tie, text in zip(b.column("doc_id").to_pylist(), b.column("tie").to_pylist(), common.texts(b.column("text"))):
                sig = signature(shingle_hashes(text))
                if last is None:
                    yield (_HEAD, part, doc_id, tie, *[None] * 6, text)
                else:
                    yield _result(*last, text, sig)
                last = (doc_id, tie, text, sig)
        if last is not None:
            yield (_TAIL, part, *last[:2], *[None] * 6, last[2])
    return common.rows_to_batches(rows(), _ROW, 500)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for b in batches:
            for doc_id, tie, text, other in zip(b.column("doc_id").to_pylist(), b.column("tie").to_pylist(), common.texts(b.column("text")), common.texts(b.column("other"))):
                yield _result(doc_id, tie, text, signature(shingle_hashes(text)), other, signature(shingle_hashes(other)))
    return common.rows_to_batches(rows(), _ROW, 500)


def with_next(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint (hex), near_edited, near_next.

    Documents are in descending doc_id order (equal ids by a hash of the text,
    null ids last); the last one's next is the first; a single document is its
    own next.  Null texts count as empty.  An empty table gives an empty
    result; extra columns are ignored.

    Texts move once, to range partitions in that order; only the first and last
    row of each partition meet their neighbours by a join."""
    return _with_next(docs).drop("tie")


def _with_next(docs: DataFrame) -> DataFrame:
    """``with_next`` with ``tie``, the hash of the text."""
    common.bounded_batches(docs.sparkSession)
    order = [F.desc_nulls_last("doc_id"), F.desc("tie")]
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("tie")) \
        .repartitionByRange(common.wide_partitions(docs), *order).sortWithinPartitions(*order)
    out = common.written(rows.mapInArrow(_along, _DDL), "minhash")
    heads, tails = out.where(F.col("kind") == _HEAD), out.where(F.col("kind") == _TAIL)
    around = Window.orderBy("part")  # one row a partition
    follow = heads.select(F.col("part").alias("own"), F.coalesce(
        F.lead("part").over(around), F.first("part").over(around)).alias("follow"))
    ends = tails.select("part", "doc_id", "tie", "text").join(follow, F.col("part") == F.col("own")).drop("part", "own") \
        .join(heads.select("part", F.col("text").alias("other")), F.col("follow") == F.col("part")).select("doc_id", "tie", "text", "other")
    done = out.where(F.col("kind") == _DONE).union(ends.mapInArrow(_across, _DDL))
    text = lambda c: F.lower(F.hex(c))
    return done.select("doc_id", "tie", "n_chars", text("edited_sha256").alias("edited_sha256"), text("fp").alias("fingerprint"),
                       text("edited_fp").alias("edited_fingerprint"), "near_edited", "near_next")


# -------------------------------------------------------- near-duplicates

def _verified(threshold: float):
    """Edges of a spanning forest of the verified links of each cell of a sorted partition."""
    def close(members: dict[int, tuple[bool, np.ndarray]], cell: tuple | None) -> list[tuple[int, int]]:
        names = sorted(members)
        inside = cell is not None and cell[1] == cell[2]
        root = {m: m for m in names}

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x
        edges = []
        for i, a in enumerate(names):
            own, x = members[a]
            for b in names[i + 1:]:
                other, y = members[b]
                ra, rb = find(a), find(b)
                if ra == rb or (own == other and not inside) or min(len(x), len(y)) < threshold * max(len(x), len(y)):
                    continue
                common_ = len(np.intersect1d(x, y, assume_unique=True))
                if common_ >= threshold * (len(x) + len(y) - common_):
                    root[max(ra, rb)] = min(ra, rb)
                    edges.append((a, b))
        return edges

    def run(batches):
        def rows():
            cell, members = None, {}
            for b in batches:
                d = b.to_pydict()
                for key, x, y, name, hashes, home in zip(d["key"], d["x"], d["y"], d["name"], d["hashes"], d["home"]):
                    if (key, x, y) != cell:
                        yield from close(members, cell)
                        cell, members = (key, x, y), {}
                    members[name] = (home, np.frombuffer(hashes, "<u8"))
            yield from close(members, cell)
        return common.rows_to_batches(rows(), pa.schema([("a", pa.int64()), ("b", pa.int64())]))
    return run


def near_duplicates(docs: DataFrame, threshold: float = LIKENESS) -> DataFrame:
    """One row per input row: doc_id, class_id (smallest doc_id of its class).

    Classes are the components of all verified links (exact Jaccard likeness of
    the shingle sets at or above ``threshold``) among documents that share a
    band of their signatures; equal shingle sets are one node, texts without a
    word link among themselves.  Null ids never name a class that has another.
    Only names of sets are banded and written.  Bands whose buckets have the same
    members count as one, and buckets within one class found by the first
    ``FIRST`` bands need not be compared again, so a set's hashes (made again
    from its text, only where it met another) go to few buckets.  A bucket's
    sets meet in blocks of ``CELL``; a block pair emits a forest, never all pairs."""
    return _classes(docs, threshold).drop("tie")


def fingerprints(docs: DataFrame, threshold: float = LIKENESS) -> DataFrame:
    """``with_next`` of every row and its ``class_id`` of ``near_duplicates``.
    Rows that agree in id and text are in one class.  The texts move while
    nothing else is on disk yet."""
    chained = _with_next(docs)
    classes = _classes(docs, threshold).groupBy(F.col("doc_id").alias("id"), F.col("tie").alias("t")).agg(F.min("class_id").alias("class_id"))
    return chained.join(classes, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("tie") == F.col("t")), "left").drop("tie", "id", "t")


def _classes(docs: DataFrame, threshold: float) -> DataFrame:
    """``near_duplicates`` with ``tie``, the hash of the text."""
    common.bounded_batches(docs.sparkSession)
    width = PERMS // BANDS

    def sets(batches):
        for b in batches:
            h = [shingle_hashes(t) for t in common.texts(b.column("text"))]
            raw = [x.astype("<u8").tobytes() for x in h]
            sig = [signature(x) for x in h]
            yield pa.RecordBatch.from_pydict({
                "doc_id": b.column("doc_id"), "tie": b.column("tie"), "name": pa.array([xxhash.xxh3_64_intdigest(r) - 2**63 for r in raw], pa.int64()),
                "bands": pa.array([[xxhash.xxh64_intdigest(s[i * width:(i + 1) * width].tobytes(), i) - 2**63 for i in range(BANDS)]
                                   for s in sig], pa.list_(pa.int64()))})
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    marked = common.written(keyed.mapInArrow(sets, "doc_id bigint, tie bigint, name bigint, bands array<bigint>"), "shingle-sets")
    nodes = marked.groupBy("name").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "tie")).alias("rep"), F.first("bands").alias("bands"))
    band = nodes.select("name", F.posexplode("bands").alias("band", "key"))
    crowd = band.groupBy("band", "key").agg(F.count("name").alias("n"), F.bit_xor(F.xxhash64("name")).alias("mixed"),
                                            F.sum(F.shiftright(F.xxhash64("name"), 20)).alias("total")).where("n > 1")
    # one of the buckets with the same members, the earliest band's
    crowd = crowd.groupBy("n", "mixed", "total").agg(F.min(F.struct("band", "key")).alias("b")).select("n", "b.band", "b.key")
    band = common.written(band.join(crowd, ["band", "key"]), "bands")
    reps = nodes.join(band.select("name").distinct(), "name", "leftsemi").select("name", "rep.doc_id", "rep.tie")
    reps = common.written(reps, "minhash-reps")

    def named(i: int) -> DataFrame:
        """The slice's names with a text: a name comes with the id and the hash of a text that has it."""
        own = lambda c: F.pmod(F.xxhash64(c), F.lit(SLICES)) == i  # noqa: E731  (texts are equal where their hashes are joined)
        sought = reps.where(own("tie")).select(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie"), "name")
        return keyed.where(own("tie")).join(sought, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("tie").eqNullSafe(F.col("_tie"))) \
            .dropDuplicates(["name"]).select("name", "text")

    def arrays(batches):
        for b in batches:
            yield from common.rows_to_batches(((n, shingle_hashes(t).astype("<u8").tobytes()) for n, t in zip(
                b["name"].to_pylist(), common.texts(b["text"]))), pa.schema([("name", pa.int64()), ("hashes", pa.binary())]), 200)
    full = reduce(DataFrame.unionByName, [common.written(named(i).mapInArrow(arrays, "name bigint, hashes binary"), "minhash-met")
                                          for i in range(SLICES)])

    def links(members: DataFrame) -> DataFrame:
        """Verified links of the buckets' members, (name, band, key, n)."""
        blocks = members.withColumn("blocks", F.ceil(F.col("n") / CELL).cast("int")) \
            .withColumn("own", F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int"))
        # block i meets block j <= i in cell (i, j); pairs inside a block are compared in cell (i, i) only
        cells = blocks.select("band", "key", "name", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
            F.xxhash64("band", "key").alias("key"), "name", F.greatest("own", "other").alias("x"), F.least("own", "other").alias("y"),
            (F.col("own") == F.greatest("own", "other")).alias("home"))
        cells = common.written(cells, "minhash-cells")  # made once, for all slices

        def compared(i: int) -> DataFrame:
            placed = cells.where(F.pmod(F.xxhash64("key", "x", "y"), F.lit(SLICES)) == i).join(full, "name") \
                .repartition(common.wide_partitions(docs), "key", "x", "y").sortWithinPartitions("key", "x", "y", "name")
            return placed.select("key", "x", "y", "name", "hashes", "home").mapInArrow(_verified(threshold), "a bigint, b bigint")
        return reduce(DataFrame.unionByName, [common.written(compared(i), "minhash-links") for i in range(SLICES)])

    early = links(band.where(F.col("band") < FIRST))
    known = common.written(components(early), "minhash-known")
    placed = band.where(F.col("band") >= FIRST).join(known, F.col("name") == F.col("node"), "left") \
        .withColumn("root", F.coalesce("root", "name"))
    open_ = placed.groupBy("band", "key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("band", "key")
    late = links(placed.select("name", "band", "key", "n").join(open_, ["band", "key"]))
    edges = early.unionByName(late)
    roots = nodes.select("name", F.col("least").alias("doc_id")).join(components(edges), F.col("name") == F.col("node"), "left") \
        .select("name", "doc_id", F.coalesce("root", "name").alias("root"))
    roots = common.written(roots, "minhash-roots")
    first = roots.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    return marked.select("doc_id", "tie", "name").join(roots.join(first, "root").select("name", "class_id"), "name") \
        .select("doc_id", "tie", "class_id")
