"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprint: a text is lower-cased (A-Z only), cut into words at ASCII white
space and into shingles of ``shingle`` consecutive words, repeats included;
each of the 64 bits is set if more than half of the shingles' XXH64 values
(seed 42) have it.  Fewer words than a shingle: one shingle of all words.  No
word or a null text: fingerprint zero, linked like any other.

Linking: the 64 bits are grouped into four partitions of 16 correlated bits.
If two fingerprints differ in at most ``max_bits`` bits and the four
thresholds sum to ``max_bits - 3``, some partition differs in at most its
threshold of bits.  Every fingerprint gets its own thresholds (-1: partition
not probed) from a dynamic program over the candidate counts that the exact
histogram of partition values gives; it then probes the values within those
radii, and candidates are verified on all 64 bits.

Scale: work is on distinct fingerprints; histograms have at most 4 x 65,536
entries whatever the input, so they may be collected and broadcast.  A
partition value held by many fingerprints is cut into blocks of
``CELL`` fingerprints whose pairs of blocks are separate tasks; a block pair
emits a spanning forest of its links (never all pairs).  Components come from
alternating star contraction with written tables between the rounds.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordfold.llm import common

PARTS, WIDTH = 4, 16
VALUES = 1 << WIDTH
CELL = 1024
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


# ------------------------------------------------------------- fingerprints

def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle, as unsigned 64-bit numbers."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    digest = xxhash.xxh64_intdigest
    n = len(words) - shingle + 1
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1:].tolist())), np.uint64, n)


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """Fingerprint of one text as a signed 64-bit number."""
    h = shingle_hashes(text, shingle)
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):  # bounds the unpacked bits of a very long text
        part = h[i:i + (1 << 16)].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<i8")[0])


def fingerprint_column(text: Column, shingle: int = 4) -> Column:
    """Fingerprint as an Arrow-batched column expression."""
    @F.arrow_udf("bigint")
    def simhash64(batch: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t, shingle) for t in batch.to_pylist()], pa.int64())
    return simhash64(text)


def hex_fingerprint(c: Column) -> Column:
    return F.lower(F.lpad(F.hex(c), 16, "0"))


# ---------------------------------------------------------------- partitions

def _unsigned(batch: pa.RecordBatch, name: str = "fp") -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def correlated_partitions(fps: DataFrame) -> list[list[int]]:
    """Group the 64 bits into PARTS lists of WIDTH bits, strongly correlated
    bits together, from the bit co-occurrence counts of all fingerprints."""
    def count(batches):
        total, n = np.zeros((64, 64), np.float64), 0
        for b in batches:
            x = _unsigned(b).astype("<u8").view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(x, axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
            n += len(bits)
        if n:
            yield pa.RecordBatch.from_pydict({
                "cell": pa.array(range(4097), pa.int32()),
                "n": pa.array([*total.astype(np.int64).ravel().tolist(), n], pa.int64())})
    counts = fps.select("fp").mapInArrow(count, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    table = np.zeros(4097)
    for r in counts.collect():  # 4,097 rows at every size
        table[r["cell"]] = r["n"]
    n, both = max(table[4096], 1.0), table[:4096].reshape(64, 64)
    p = np.diag(both) / n
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    phi = np.abs((both / n - np.outer(p, p)) / np.outer(spread, spread))
    left, parts = list(range(64)), []
    while left:
        part = [max(left, key=lambda b: (phi[b, left].sum(), -b))]
        left.remove(part[0])
        while len(part) < WIDTH:
            best = max(left, key=lambda b: (phi[b, part].sum(), -b))
            part.append(best)
            left.remove(best)
        parts.append(sorted(part))
    return parts


def partition_values(fp: np.ndarray, parts: list[list[int]]) -> np.ndarray:
    """The 16-bit value of every partition, shape (len(fp), PARTS)."""
    out = np.zeros((len(fp), len(parts)), np.int64)
    for i, bits in enumerate(parts):
        for k, b in enumerate(bits):
            out[:, i] |= ((fp >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << k
    return out


def value_histograms(fps: DataFrame, parts: list[list[int]]) -> np.ndarray:
    """Exact counts of all partition values, shape (PARTS, VALUES)."""
    def count(batches):
        total = np.zeros(PARTS * VALUES, np.int64)
        for b in batches:
            v = partition_values(_unsigned(b), parts) + np.arange(PARTS) * VALUES
            total += np.bincount(v.ravel(), minlength=PARTS * VALUES)
        key = np.flatnonzero(total)
        for i in range(0, len(key), 50_000):
            k = key[i:i + 50_000]
            yield pa.RecordBatch.from_pydict({"k": pa.array(k, pa.int32()), "n": pa.array(total[k], pa.int64())})
    out = np.zeros(PARTS * VALUES, np.int64)
    counts = fps.select("fp").mapInArrow(count, "k int, n bigint").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    out[counts["k"].to_numpy()] = counts["n"].to_numpy()
    return out.reshape(PARTS, VALUES)


def ball_counts(histogram: np.ndarray, radius: int) -> np.ndarray:
    """For each value, the fingerprints within 0..radius bits, shape
    (PARTS, radius + 1, VALUES): shells built bit by bit on the hypercube."""
    index = np.arange(VALUES)
    out = np.zeros((len(histogram), radius + 1, VALUES), np.int64)
    for p, h in enumerate(histogram):
        shell = np.zeros((radius + 1, VALUES), np.int64)
        shell[0] = h
        for bit in range(WIDTH):
            flipped = shell[:, index ^ (1 << bit)]
            shell = shell + np.vstack([np.zeros((1, VALUES), np.int64), flipped[:-1]])
        out[p] = np.cumsum(shell, axis=0)
    return out


def _masks(radius: int) -> list[np.ndarray]:
    """Masks of at most r bits for r = 0..radius."""
    pop = np.bitwise_count(np.arange(VALUES, dtype=np.uint32))
    return [np.flatnonzero(pop <= r) for r in range(radius + 1)]


def allocate(values: np.ndarray, balls: np.ndarray, max_bits: int) -> np.ndarray:
    """Thresholds per fingerprint and partition (-1: not probed) that sum to
    ``max_bits - PARTS + 1`` at the least estimated cost: candidates to verify
    plus values to probe, by dynamic programming over the partitions."""
    n, budget = len(values), max_bits + 1  # thresholds + 1 sum to this
    ball = [len(m) for m in _masks(max_bits)]
    cost = np.zeros((PARTS, budget + 1, n))
    for p in range(PARTS):
        for t in range(max_bits + 1):
            cost[p, t + 1] = balls[p, t, values[:, p]] + 2.0 * ball[t]
    best = np.full((PARTS + 1, budget + 1, n), np.inf)
    pick = np.zeros((PARTS, budget + 1, n), np.int8)
    best[0, 0] = 0
    for p in range(PARTS):
        for total in range(budget + 1):
            for u in range(total + 1):
                c = best[p, total - u] + cost[p, u]
                better = c < best[p + 1, total]
                best[p + 1, total][better] = c[better]
                pick[p, total][better] = u
    out, left, row = np.zeros((n, PARTS), np.int64), np.full(n, budget), np.arange(n)
    for p in range(PARTS - 1, -1, -1):
        u = pick[p, left, row]
        out[:, p] = u.astype(np.int64) - 1
        left = left - u
    return out


# -------------------------------------------------------------------- links

def _probe_rows(parts, histogram, balls, max_bits):
    """Rows (key, d, p, probe, fp): every fingerprint under its own values as
    data and under all values it probes; values with many fingerprints are cut
    into d x p cells."""
    masks = _masks(max_bits)
    near = balls[:, min(1, max_bits)]

    def emit(batches):
        for b in batches:
            fps = _unsigned(b)
            for i in range(0, len(fps), 2000):
                yield from rows(fps[i:i + 2000])

    def out(key, d, p, probe, fp):
        return pa.RecordBatch.from_pydict({
            "key": pa.array(key, pa.int32()), "d": pa.array(d, pa.int32()), "p": pa.array(p, pa.int32()),
            "probe": pa.array(np.full(len(key), probe, np.int8), pa.int8()), "fp": pa.array(fp.view(np.int64), pa.int64())})

    def spread(key, fp, chunks_own, chunks_other):
        """Block of the row among its own kind and one copy per block of the other kind."""
        mixed = (fp * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        own = (mixed % chunks_own.astype(np.uint64)).astype(np.int64)
        rep = np.repeat(np.arange(len(key)), chunks_other)
        first = np.repeat(np.cumsum(chunks_other) - chunks_other, chunks_other)
        return key[rep], own[rep], np.arange(len(rep)) - first, fp[rep]

    def rows(fps):
        values = partition_values(fps, parts)
        t = allocate(values, balls, max_bits)
        for part in range(PARTS):
            v = values[:, part]
            blocks_d = -(-histogram[part, v] // CELL)
            blocks_p = np.maximum(1, -(-near[part, v] // CELL))
            key, d, p, fp = spread(part * VALUES + v, fps, blocks_d, blocks_p)
            yield out(key, d, p, 0, fp)
            for radius in range(max_bits + 1):
                who = np.flatnonzero(t[:, part] == radius)
                if not len(who):
                    continue
                step = max(1, 200_000 // len(masks[radius]))
                for i in range(0, len(who), step):
                    w = who[i:i + step]
                    probed = (v[w][:, None] ^ masks[radius][None, :]).ravel()
                    fp = np.repeat(fps[w], len(masks[radius]))
                    own = np.repeat(v[w], len(masks[radius])) == probed
                    hit = histogram[part, probed] > own  # nobody else there: nothing to find
                    probed, fp = probed[hit], fp[hit]
                    bd = -(-histogram[part, probed] // CELL)
                    bp = np.maximum(1, -(-near[part, probed] // CELL))
                    key, p, d, fp = spread(part * VALUES + probed, fp, bp, bd)
                    yield out(key, d, p, 1, fp)
    return emit


def _forest(probes: np.ndarray, data: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links between two sets."""
    near = np.bitwise_count(probes[:, None] ^ data[None, :]) <= max_bits
    near &= probes[:, None] != data[None, :]
    rows, cols = near.any(1), near.any(0)
    if not rows.any():
        return []
    probes, data, near = probes[rows], data[cols], near[np.ix_(rows, cols)]
    top = np.iinfo(np.int64).max
    lp, ld = probes.view(np.int64).copy(), data.view(np.int64).copy()
    while True:
        a = np.minimum(lp, np.where(near, ld[None, :], top).min(1))
        b = np.minimum(ld, np.where(near, a[:, None], top).min(0))
        if (a == lp).all() and (b == ld).all():
            break
        lp, ld = a, b
    ends = np.concatenate([probes, data]).view(np.int64)
    roots = np.concatenate([lp, ld])
    far = ends != roots
    return list(zip(ends[far].tolist(), roots[far].tolist()))


def _cells(max_bits):
    """Verify the cells of a sorted partition; one cell in memory at a time."""
    def link(batches):
        cell, data, probes, found = None, [], [], set()

        def close():
            if data and probes:
                d = np.unique(np.concatenate(data))
                p = np.unique(np.concatenate(probes))
                for i in range(0, len(p), CELL):
                    found.update(_forest(p[i:i + CELL], d, max_bits))

        for b in batches:
            if not b.num_rows:
                continue
            fp = _unsigned(b)
            probe = b.column("probe").to_numpy(zero_copy_only=False)
            ids = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "d", "p")], 1)
            cuts = np.flatnonzero((ids[1:] != ids[:-1]).any(1)) + 1
            starts = [0, *cuts.tolist()]
            for a, z in zip(starts, [*starts[1:], len(fp)]):
                here = tuple(ids[a].tolist())
                if here != cell:
                    close()
                    cell, data, probes = here, [], []
                part, kind = fp[a:z], probe[a:z]
                data.append(part[kind == 0])
                probes.append(part[kind == 1])
                if sum(map(len, probes)) > 16 * CELL:  # a long run of probes is worked off
                    close()
                    probes = []
            if len(found) > 100_000:
                yield edges(found)
                found = set()
        close()
        if found:
            yield edges(found)

    def edges(found):
        a, b = zip(*found)
        return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
    return link


def links(fps: DataFrame, max_bits: int = 4) -> DataFrame:
    """Edges (a, b) between fingerprints whose components are those of all
    links of at most ``max_bits`` bits.  ``fps``: distinct column ``fp``."""
    if not PARTS - 1 <= max_bits <= WIDTH:
        raise ValueError(f"max_bits must be {PARTS - 1}..{WIDTH}")
    sc = fps.sparkSession.sparkContext
    parts = correlated_partitions(fps)
    histogram = value_histograms(fps, parts)
    balls = ball_counts(histogram, max_bits)
    shared = sc.broadcast((parts, histogram, balls))  # fixed size: 4 x 65,536 x (max_bits + 2) numbers

    def emit(batches):
        yield from _probe_rows(*shared.value, max_bits)(batches)

    rows = fps.select("fp").mapInArrow(emit, "key int, d int, p int, probe tinyint, fp bigint")
    cells = rows.repartition(common.wide_partitions(fps), "key", "d", "p") \
        .sortWithinPartitions("key", "d", "p", "probe")
    return cells.mapInArrow(_cells(max_bits), "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): connected components by alternating large-star and
    small-star steps; root is the smallest node.  A round's table is written
    to the shared folder; rounds grow with the logarithm of the diameter.

    Edges point from the larger node u to the smaller v.  A hub of very many
    nodes is their v.  Its rows meet the small table of smallest neighbours in a
    join whose sides are plain tables, which the engine broadcasts or, for a
    skewed v, splits; no aggregate needs a hub's rows together.  The smaller
    neighbours of a node, gathered per u, are few: a forest gives a node an edge
    per cell it is in, and every round replaces them by their minimum."""
    e = common.written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                       .where("u <> v").distinct(), "links")
    seen = None
    while True:
        low = common.written(e.groupBy(F.col("u").alias("y")).agg(F.min("v").alias("m")), "low")
        large = e.join(low, e["v"] == low["y"], "left").select("u", F.coalesce("m", "v").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.collect_set("v").alias("vs"))
        star = least.select("u", "m", F.explode("vs").alias("v"))
        e = common.written(star.select("u", F.col("m").alias("v")).union(
            star.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct(), "star")
        state = e.agg(F.count("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = tuple(state)


# ----------------------------------------------------------------- operator

def fingerprint_components(marked: DataFrame, max_bits: int = 4) -> DataFrame:
    """``marked``: rows (doc_id, fp).  Returns (fp, component_id, keep_fp): one
    row per distinct fingerprint with its component's smallest doc_id and the
    fingerprint that carries it (null ids come last)."""
    fps = common.written(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")), "fingerprints")
    root = fps.join(components(links(fps, max_bits)), F.col("fp") == F.col("node"), "left") \
        .select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    root = common.written(root, "roots")
    # the group's row: smallest id first, a fingerprint without ids last
    first = root.groupBy("root").agg(F.min(F.struct(F.col("rep").isNull().alias("no_id"), F.col("rep").alias("rep"),
                                                    F.col("fp").alias("fp"))).alias("w"))
    return root.join(first, "root").select("fp", F.col("w.rep").alias("component_id"), F.col("w.fp").alias("keep_fp"))


def near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """One row per input row: doc_id, fp (long), fingerprint (16 hex digits),
    component_id (smallest doc_id reachable, itself included).

    Null ids never become a component id unless a component has no other (then
    it is null).  Repeated rows and ids stay as often as they come.  An empty
    table gives an empty result.  Extra columns are ignored."""
    common.bounded_batches(docs.sparkSession)
    marked = common.written(docs.select("doc_id", fingerprint_column(F.col("text"), shingle).alias("fp")), "simhash")
    comp = fingerprint_components(marked, max_bits).select("fp", "component_id")
    return marked.join(comp, "fp").select("doc_id", "fp", hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the row
    with the smallest doc_id stays (null ids last; rows that share it: the
    smallest text).  All columns are kept as they are."""
    common.bounded_batches(docs.sparkSession)
    plain = [f.name for f in docs.schema.fields if f.name != "text" and f.dataType.typeName() not in ("map", "variant")]
    marked = docs.select(F.struct("*").alias("row")) \
        .withColumn("fp", fingerprint_column(F.col("row.text"), shingle)) \
        .withColumn("k", F.struct("fp", F.col("row.doc_id").alias("id")))
    small = common.written(marked.select(F.col("row.doc_id").alias("doc_id"), "fp"), "simhash")
    comp = fingerprint_components(small, max_bits)
    winners = comp.where("fp = keep_fp").select(F.struct("fp", F.col("component_id").alias("id")).alias("k"))
    tie = F.struct("row.text", F.xxhash64(*[F.col("row")[c] for c in plain]))
    kept = marked.join(winners, "k", "left_semi").groupBy("k").agg(F.min_by("row", tie).alias("row"))
    return kept.select("row.*")
