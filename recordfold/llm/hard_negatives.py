"""Hard negatives of anchor vectors: exact integer scores by Strassen's
multiplication of tiles, and mergeable heaps.

Components become integers, floor(scale * x).  Anchors and candidates are
packed into tiles (one row each: ids, labels and an integer matrix).  Every
anchor tile meets every candidate tile, a stated set of queries against all
rows, in blocks.  A pair of tiles is multiplied by Strassen's recursion on
int64 with zero padding; all additions wrap at 2**64, so a score that fits 64
bits is exact whatever the terms in between were.

Two rounds over the tile pairs:
  1. each anchor's heap of its ``positives`` best rows of its own label
     (multiplied label by label), merged over all tiles;
  2. for each anchor and positive the heap of the ``negatives`` best rows of
     other labels in the window  low*ps <= 100*ns <= high*ps.
Heaps hold the best so far; two heaps merge into one, so a task merges what it
sees, and Spark merges the tasks' heaps by a limited window per key.

Defined results: rows with a null id, label or vector or a null or non-finite
component take no part, nor do vectors whose sum of squares is 2**56 or more
(100 times a score must fit 64 bits).  Vectors of unequal length count as
padded with zeros.  Rows with the id of an anchor are never its positives.
Rows that repeat an id are rows of their own: a repeated anchor returns its
rows again, and equal (score, id) share the ranks in turn.  An empty table, or
one without anchors, gives no rows.  Extra columns are ignored.

Scale: each tile moves once per round for every group of tiles that it meets;
both tables of tiles are written, so a lost executor costs its own tiles only.
A task holds one pair of tiles, the candidates of one cell and a bounded number
of heaps.  Nothing that grows is broadcast or sent to the driver.  No key
gathers more than a cell, so hot labels and common vectors spread like any
others.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordfold.llm import common

#: Rows of a tile of anchors and of a tile of candidates.
ANCHOR_TILE, CANDIDATE_TILE = 512, 2048
#: Strassen's recursion ends where a side is this short.
LEAF = 8
#: Tiles of a side in one cell of pairs, at most.
GROUP = 8
#: Anchors whose heaps a task holds before it hands them on.
HELD_ANCHORS = 32 * ANCHOR_TILE
NOTHING = np.iinfo(np.int64).min
LARGEST = float(2 ** 56)

_TILE = pa.schema([("part", pa.int64()), ("tile", pa.int64()), ("ids", pa.binary()), ("labels", pa.binary()),
                   ("values", pa.binary()), ("width", pa.int32())])
_TILE_DDL = "part bigint, tile bigint, ids binary, labels binary, values binary, width int"


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """``a @ b`` of int64 matrices, modulo 2**64, by Strassen's recursion; odd
    sides are padded with zeros and cut off again."""
    m, k, n = a.shape[0], a.shape[1], b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    a = np.pad(a, ((0, m % 2), (0, k % 2)))
    b = np.pad(b, ((0, k % 2), (0, n % 2)))
    i, j, l = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :l], b[:j, l:], b[j:, :l], b[j:, l:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    c = np.empty((2 * i, 2 * l), np.int64)
    c[:i, :l] = p1 + p4 - p5 + p7
    c[:i, l:] = p3 + p5
    c[i:, :l] = p2 + p4
    c[i:, l:] = p1 - p2 + p3 + p6
    return c[:m, :n]


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` highest scores of each row and their ids, smaller ids first
    among equals; ``ids`` ascend, ``NOTHING`` is no score.  Uses up ``scores``."""
    rows = np.arange(len(scores))
    top, who = np.full((len(scores), k), NOTHING), np.zeros((len(scores), k), np.int64)
    for r in range(min(k, scores.shape[1])):
        at = scores.argmax(axis=1)
        top[:, r], who[:, r] = scores[rows, at], ids[at]
        scores[rows, at] = NOTHING
    return top, who


def merge(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two heaps of the same keys as one; ``NOTHING`` stands last."""
    k = one[0].shape[-1]
    top, who = np.concatenate([one[0], two[0]], axis=-1), np.concatenate([one[1], two[1]], axis=-1)
    order = np.lexsort((who, ~top), axis=-1)[..., :k]
    return np.take_along_axis(top, order, -1), np.take_along_axis(who, order, -1)


def usable(vectors: DataFrame, scale: int) -> DataFrame:
    """Rows (id, label, v) that take part, with integer components."""
    v = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("bigint"))
    squares = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + F.pow(F.lit(float(scale)) * x.cast("double"), 2.0))
    return vectors.select(F.col("vec_id").cast("bigint").alias("id"), F.col("label").cast("bigint").alias("label"), "embedding") \
        .where(F.col("id").isNotNull() & F.col("label").isNotNull()) \
        .where(squares < LARGEST).select("id", "label", v.alias("v"))  # not so if any component is null, NaN or infinite


def tiles(rows: DataFrame, size: int) -> DataFrame:
    """Rows (id, label, v) as tiles of at most ``size`` rows in id order.
    ``part`` is the partition a tile came from, ``tile`` its number over all."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count, held, n = TaskContext.get().partitionId(), 0, [], 0

        def one(table: pa.Table) -> pa.RecordBatch:
            nonlocal count
            ids, labels = table["id"].to_numpy(), table["label"].to_numpy()
            vectors = table["v"].combine_chunks()
            lengths = np.diff(vectors.offsets.to_numpy())
            width = int(lengths.max(initial=0))
            matrix = np.zeros((len(ids), width), np.int64)
            matrix[np.arange(width) < lengths[:, None]] = vectors.flatten().to_numpy()
            order = np.argsort(ids, kind="stable")
            out = [part, (part << 32) | count, ids[order].tobytes(), labels[order].tobytes(), _narrow(matrix[order]).tobytes(), width]
            count += 1
            return pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip(out, _TILE)], schema=_TILE)
        for b in batches:
            held.append(b)
            n += b.num_rows
            while n >= size:
                table = pa.Table.from_batches(held)
                yield one(table.slice(0, size))
                rest = table.slice(size)
                held, n = rest.to_batches(), rest.num_rows
        if n:
            yield one(pa.Table.from_batches(held))
    return rows.mapInArrow(pack, _TILE_DDL)


def _narrow(m: np.ndarray) -> np.ndarray:
    """The matrix in the fewest bytes per component that hold it."""
    high = int(max(m.max(initial=0), -m.min(initial=0)))
    return m.astype(np.int16 if high < 2 ** 15 else np.int32 if high < 2 ** 31 else np.int64)


def _tile(row: dict, side: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, labels and int64 matrix of the tile in the columns ``<side>_*``."""
    ids, labels = (np.frombuffer(row[f"{side}_{c}"], np.int64) for c in ("ids", "labels"))
    width, raw = row[f"{side}_width"], row[f"{side}_values"]
    if not width:
        return ids, labels, np.zeros((len(ids), 0), np.int64)
    kind = {2: np.int16, 4: np.int32, 8: np.int64}[len(raw) // (len(ids) * width)]
    return ids, labels, np.frombuffer(raw, kind).reshape(len(ids), width).astype(np.int64)


def _scores(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    width = max(a.shape[1], c.shape[1])
    a, c = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, c))
    return strassen(a, np.ascontiguousarray(c.T)) if width else np.zeros((len(a), len(c)), np.int64)


def _positive_heaps(row: dict, k: int) -> tuple[np.ndarray, np.ndarray]:
    a_ids, a_labels, a = _tile(row, "a")
    c_ids, c_labels, c = _tile(row, "c")
    top, who = np.full((len(a_ids), k), NOTHING), np.zeros((len(a_ids), k), np.int64)
    for label in np.intersect1d(a_labels, c_labels):
        i, j = np.flatnonzero(a_labels == label), np.flatnonzero(c_labels == label)
        s = _scores(a[i], c[j])
        s[a_ids[i][:, None] == c_ids[j]] = NOTHING
        top[i], who[i] = best_of(s, c_ids[j], k)
    return top, who


def _window_heaps(row: dict, k: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    a_ids, a_labels, a = _tile(row, "a")
    c_ids, c_labels, c = _tile(row, "c")
    windows = np.frombuffer(row["a_windows"], np.int64).reshape(len(a_ids), -1)
    top = np.full((*windows.shape, k), NOTHING)
    who = np.zeros((*windows.shape, k), np.int64)
    s = _scores(a, c)
    s[a_labels[:, None] == c_labels] = NOTHING
    other = s != NOTHING
    s100 = np.where(other, s, 0) * 100
    for p in range(windows.shape[1]):
        ps = windows[:, p]
        some = np.flatnonzero((ps != NOTHING) & (ps >= 0))  # a negative score's window is empty
        if len(some):
            bound = ps[some][:, None]
            inside = other[some] & (s100[some] >= low * bound) & (s100[some] <= high * bound)
            top[some, p], who[some, p] = best_of(np.where(inside, s[some], NOTHING), c_ids, k)
    return top, who


def _pairs(anchors: DataFrame, candidates: DataFrame, parts: int, shards: int) -> DataFrame:
    """Each anchor tile with each candidate tile: both are dealt to groups of
    tiles, and every pair of groups is a cell that its tiles move to.  Groups
    grow with the number of pairs, up to ``GROUP``, while there are several
    cells a task.  The cells meet by a merge join: what is repeated for them is
    never broadcast, however small its table is before."""
    tasks = common.wide_partitions(anchors)
    group = max(1, min(GROUP, math.isqrt(parts * shards // (4 * tasks))))
    rows, cols = math.ceil(parts / group), math.ceil(shards / group)
    a = anchors.select(*[F.col(c).alias(f"a_{c}") for c in anchors.columns]) \
        .withColumn("row", F.pmod("a_part", F.lit(rows).cast("bigint"))) \
        .withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))))
    c = candidates.select(*[F.col(c).alias(f"c_{c}") for c in candidates.columns]) \
        .withColumn("col", F.pmod(F.xxhash64("c_tile"), F.lit(cols)).cast("int")) \
        .withColumn("row", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(rows - 1).cast("bigint"))))
    return a.repartition(tasks, "row", "col").hint("merge").join(c.repartition(tasks, "row", "col"), ["row", "col"])


_HEAP = pa.schema([("a_tile", pa.int64()), ("place", pa.int32()), ("slot", pa.int32()), ("anchor_id", pa.int64()),
                   ("score", pa.int64()), ("id", pa.int64())])
_HEAP_DDL = "a_tile bigint, place int, slot int, anchor_id bigint, score bigint, id bigint"


def _heaps(pairs: DataFrame, of) -> DataFrame:
    """``of(row)`` gives the heaps (anchors [x slots] x k) of a pair of tiles;
    one task merges what it gets of an anchor tile, and hands heaps on as rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}

        def handed() -> Iterator[pa.RecordBatch]:
            for tile, (ids, (top, who)) in held.items():
                top, who = (x.reshape(len(ids), -1, x.shape[-1]) for x in (top, who))
                place, slot, rank = np.nonzero(top != NOTHING)
                got = [np.full(len(place), tile), place.astype(np.int32), slot.astype(np.int32), ids[place],
                       top[place, slot, rank], who[place, slot, rank]]
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(got, _HEAP)], schema=_HEAP)
            held.clear()
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(j)[i].as_py() for j, c in enumerate(batch.schema.names)}
                tile, heaps = row["a_tile"], of(row)
                if tile in held:
                    held[tile] = held[tile][0], merge(held[tile][1], heaps)
                else:
                    held[tile] = np.frombuffer(row["a_ids"], np.int64), heaps
                if sum(len(ids) for ids, _ in held.values()) >= HELD_ANCHORS:
                    yield from handed()
        yield from handed()
    return pairs.mapInArrow(run, _HEAP_DDL)


def _first(heaps: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows of all heaps of a key, with their rank."""
    order = Window.partitionBy("a_tile", "place", "slot").orderBy(F.desc("score"), "id")
    return heaps.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, anchor_step: int = 50, positives: int = 5, negatives: int = 3,
         low: int = 50, high: int = 95, scale: int = 256) -> DataFrame:
    """Hard negatives of the rows of ``vectors`` (vec_id, embedding, label)
    whose id is divisible by ``anchor_step``: anchor_id, positive_id, rank,
    negative_id, positive_score, negative_score."""
    spark = vectors.sparkSession
    common.bounded_batches(spark)
    rows = usable(vectors, scale)
    is_anchor = F.col("id") % anchor_step == 0
    total = vectors.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("vec_id") % anchor_step == 0).alias("a")).first()
    parts, shards = max(1, math.ceil(total.a / ANCHOR_TILE)), max(1, math.ceil(total.n / CANDIDATE_TILE))
    candidates = common.written(tiles(rows, CANDIDATE_TILE), "candidate-tiles")
    anchors = common.written(tiles(rows.where(is_anchor).repartition(parts), ANCHOR_TILE), "anchor-tiles")

    with_pairs = _pairs(anchors, candidates, parts, shards)
    near = _first(_heaps(with_pairs, lambda row: _positive_heaps(row, positives)), positives) \
        .select("a_tile", "place", F.col("rank").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    near = common.written(near, "positives")

    windows = near.groupBy("a_tile").agg(F.collect_list(F.struct("place", "slot", "positive_score")).alias("scores"))
    spread = _with_windows(anchors.hint("merge").join(windows, anchors["tile"] == windows["a_tile"]).drop("a_tile"), positives)
    spread = common.written(spread, "anchor-windows")
    hard = _first(_heaps(_pairs(spread, candidates, parts, shards), lambda row: _window_heaps(row, negatives, low, high)), negatives)
    hard = hard.withColumn("slot", F.col("slot") + 1)
    return hard.hint("merge").join(near, ["a_tile", "place", "slot"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))


def _with_windows(anchors: DataFrame, k: int) -> DataFrame:
    """Anchor tiles with the scores of their positives as a matrix (anchors x k)."""
    schema = pa.schema([*_TILE, ("windows", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                w = np.full((len(row["ids"]) // 8, k), NOTHING)
                for s in row.pop("scores"):
                    w[s["place"], s["slot"] - 1] = s["positive_score"]
                row["windows"] = w.tobytes()
                yield pa.RecordBatch.from_pylist([row], schema=schema)
    return anchors.mapInArrow(pack, f"{_TILE_DDL}, windows binary")
