"""Mixing sources to target weights.

The rows of a source, by document id, are cut into blocks of ``block`` rows; the
schedule gives every block a slot.  The sources are the leaves of a Huffman tree
of their weights, taken as exact fractions.  A node hands its slots to its two
children: of its first n slots the left one has n * share, rounded to the nearest.
So the slot of a source's j-th block follows from j by integer arithmetic along
its path to the root, for every block by itself.  A node is off by at most half a
block more than its share of its parent's deviation, and an inner node has at
most 2/3 of its parent: up to any slot t of a phase a source of weight w has
fewer than two blocks more or less than w * t, however long the phase is and
however many sources there are.  (Pfair's bound of one block needs the slots laid
out one after the other.)

When a source runs out, its phase ends and the others share its weight from the
next slot on.  There are at most as many phases as sources; the driver holds one
number for each source and phase.

With a ``period``, weights are instead rounded to slots of that period, at least
one each; one period is laid out by Pfair scheduling (block j is released at
floor(j / w), the earliest deadline ceil((j + 1) / w) first) and repeated.

Scale: only ids and sources are sorted (range partitions over (source, id), so
a source with a third of all rows is spread over many tasks); per-partition
counts give the row numbers.  No row is dropped or repeated: the output is a
permutation.
"""
from __future__ import annotations

import heapq
import math
from collections.abc import Mapping, Sequence
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordfold.llm import common

BLOCK, PERIOD = 64, 1000  # PERIOD: for fractions and schedule alone
#: Default weights: shares of the sources' rows to this power (below 1 raises small sources).
TEMPERATURE = 0.7


def fractions(weights: Mapping[str, float], period: int = PERIOD) -> dict[str, int]:
    """Slots of a period for each source: the largest-remainder rounding of the
    weights, at least one each; they sum to max(period, number of sources)."""
    if not weights:
        return {}
    if any(not w > 0 for w in weights.values()):
        raise ValueError("target weights must be positive")
    period, total = max(period, len(weights)), sum(weights.values())
    names = sorted(weights)
    spare = period - len(names)
    exact = {s: spare * weights[s] / total for s in names}
    out = {s: 1 + int(exact[s]) for s in names}
    for s in sorted(names, key=lambda s: (int(exact[s]) - exact[s], s))[:period - sum(out.values())]:
        out[s] += 1
    return out


def pfair_period(slots: Mapping[str, int]) -> list[str]:
    """Source of every slot of one period, earliest deadline first."""
    period = sum(slots.values())
    waiting = [(0, s, 0) for s in sorted(slots)]  # (release, source, block)
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []  # (deadline, source, block)
    out = []
    for t in range(period):
        while waiting and waiting[0][0] <= t:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * period // slots[s]), s, j))
        _, s, j = heapq.heappop(ready)
        out.append(s)
        if j + 1 < slots[s]:
            heapq.heappush(waiting, ((j + 1) * period // slots[s], s, j + 1))
    return out


def schedule(blocks: Mapping[str, int], weights: Mapping[str, float], period: int = PERIOD) -> list[tuple]:
    """Phases as rows (source, nth,
    first_block, rounds, slot0, period length, place, slots): in a
    phase, block first_block + r * slots + nth of the source, r < rounds, has
    the slot slot0 + r * (period length) + (its place in the period).

    Whole periods run until a source has fewer blocks left than a period
    takes; one more period, in which its slots behind its last block stay
    empty, ends that source and the phase."""
    done = {s: 0 for s in blocks}
    rows, at = [], 0
    while True:
        left = {s: n - done[s] for s, n in blocks.items() if n > done[s]}
        if not left:
            return rows
        slots = fractions({s: weights[s] for s in left}, period)
        rounds = max(1, min(left[s] // slots[s] for s in left))
        order = pfair_period(slots)
        nth = {s: 0 for s in slots}
        for place, s in enumerate(order):
            rows.append((s, nth[s], done[s], rounds, at, len(order), place, slots[s]))
            nth[s] += 1
        for s in slots:
            done[s] = min(blocks[s], done[s] + rounds * slots[s])
        at += rounds * len(order)


class Tree:
    """Huffman tree of positive integer weights: node i is the i-th weight's leaf, the last node the root."""

    def __init__(self, weights: Sequence[int]):
        self.weight, self.leaves = list(weights), len(weights)
        self.parent, self.left = [-1] * (2 * len(weights) - 1), [False] * (2 * len(weights) - 1)
        self.children: list[tuple[int, int]] = []  # of the inner nodes
        heap = [(w, i) for i, w in enumerate(weights)]
        heapq.heapify(heap)
        while len(heap) > 1:
            (wr, r), (wl, left) = heapq.heappop(heap), heapq.heappop(heap)
            node = len(self.weight)
            self.weight.append(wl + wr)
            self.parent[left] = self.parent[r] = node
            self.left[left] = True
            self.children.append((left, r))
            heapq.heappush(heap, (wl + wr, node))

    def slot(self, leaf: int, j: int) -> int:
        """Slot of the leaf's j-th block."""
        node = leaf
        while (up := self.parent[node]) >= 0:
            own, both = self.weight[node], self.weight[up]
            j = -((both // 2 - (j + 1) * both) // own) - 1 if self.left[node] else (j * both + both // 2) // own
            node = up
        return j

    def counts(self, slots: int) -> list[int]:
        """Blocks of every leaf in the first ``slots`` slots."""
        n = [0] * len(self.weight)
        n[-1] = slots
        for k in range(len(self.children) - 1, -1, -1):
            (left, right), node = self.children[k], self.leaves + k
            n[left] = (n[node] * self.weight[left] + self.weight[node] // 2) // self.weight[node]
            n[right] = n[node] - n[left]
        return n[:self.leaves]


class Plan:
    """Phases of a schedule by exact weights: where each starts, and which block of each source is its first there."""

    def __init__(self, blocks: Mapping[str, int], weights: Mapping[str, float]):
        if any(not weights[s] > 0 for s in blocks):
            raise ValueError("target weights must be positive")
        self.names = sorted(blocks)
        exact = [Fraction(weights[s]) for s in self.names]
        scale = math.lcm(*(w.denominator for w in exact))
        self.weights = [int(w * scale) for w in exact]
        self.total = [blocks[s] for s in self.names]
        self.number = {s: i for i, s in enumerate(self.names)}
        done, at, first, starts = [0] * len(self.names), 0, [], []
        self.held: tuple[int, Tree | None, dict[int, int]] = (-1, None, {})
        while live := [i for i, n in enumerate(self.total) if done[i] < n]:
            first.append(list(done))
            starts.append(at)
            tree = Tree([self.weights[i] for i in live])
            length = 1 + min(tree.slot(k, self.total[i] - done[i] - 1) for k, i in enumerate(live))
            for i, n in zip(live, tree.counts(length)):
                done[i] += n
            at += length
        self.starts, self.first = starts, np.array(first, np.int64).reshape(len(first), len(self.names))

    def phase(self, source: str, block: int) -> int:
        return int(np.searchsorted(self.first[:, self.number[source]], block, "right")) - 1

    def slot(self, phase: int, source: str, block: int) -> int:
        """Slot of a block of a phase; the phase's tree is kept for the next call."""
        i = self.number[source]
        if self.held[0] != phase:
            live = [k for k, n in enumerate(self.total) if self.first[phase, k] < n]
            self.held = phase, Tree([self.weights[k] for k in live]), {k: at for at, k in enumerate(live)}
        _, tree, leaf = self.held
        return self.starts[phase] + tree.slot(leaf[i], block - int(self.first[phase, i]))


def _exact_slots(blocks: DataFrame, plan: Plan) -> DataFrame:
    """``blocks`` (src, block) with their slots."""
    shared = blocks.sparkSession.sparkContext.broadcast(plan)
    phased, placed = (pa.schema([*c, ("src", pa.string()), ("block", pa.int64()), *d]) for c, d in (
        ([("phase", pa.int64())], []), ([], [("slot", pa.int64())])))

    def phase(batches):
        return common.rows_to_batches(((shared.value.phase(s, j), s, j) for b in batches
                                       for s, j in zip(b["src"].to_pylist(), b["block"].to_pylist())), phased)

    def place(batches):
        return common.rows_to_batches(((s, j, shared.value.slot(p, s, j)) for b in batches for p, s, j in zip(
            b["phase"].to_pylist(), b["src"].to_pylist(), b["block"].to_pylist())), placed)
    # phase by phase, so that a task meets few trees
    return blocks.mapInArrow(phase, "phase bigint, src string, block bigint") \
        .repartitionByRange(common.wide_partitions(blocks), "phase", "src", "block").sortWithinPartitions("phase") \
        .mapInArrow(place, "src string, block bigint, slot bigint")


def _period_slots(blocks: DataFrame, phases: list[tuple]) -> DataFrame:
    """``blocks`` (src, block) with their slots in repeated periods."""
    plan = blocks.sparkSession.createDataFrame(
        phases or [("", 0, 0, 0, 0, 1, 0, 1)],
        "src string, nth bigint, first_block bigint, rounds bigint, slot0 bigint, length bigint, place bigint, slots bigint")
    # block -> slot: the phase whose run of blocks holds it, then its turn in the period
    runs = plan.select("src", "first_block", "rounds", "slots", "slot0", "length").distinct()
    placed = blocks.join(runs, "src").where(
        (F.col("block") >= F.col("first_block")) & (F.col("block") < F.col("first_block") + F.col("rounds") * F.col("slots"))) \
        .withColumn("nth", (F.col("block") - F.col("first_block")) % F.col("slots")) \
        .withColumn("round", F.floor((F.col("block") - F.col("first_block")) / F.col("slots")))
    turn = plan.select("src", "first_block", "nth", "place")
    return placed.join(turn, ["src", "first_block", "nth"]) \
        .select("src", "block", (F.col("slot0") + F.col("round") * F.col("length") + F.col("place")).alias("slot"))


def _numbered(keys: DataFrame) -> DataFrame:
    """``keys`` (src, doc_id, tie) with ``n``, the row's number in its source
    by (doc_id, tie), nulls first."""
    kept = keys.repartitionByRange(common.wide_partitions(keys), "src", "doc_id", "tie") \
        .sortWithinPartitions("src", "doc_id", "tie").withColumn("at", F.monotonically_increasing_id())
    kept = common.written(kept, "mix-keys")
    part = F.shiftright("at", 33)
    counts = kept.groupBy("src", part.alias("part")).agg(F.count("at").alias("rows"), F.min("at").alias("first"))
    before = Window.partitionBy("src").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # a row per source and partition: small whatever the rows of a source
    offsets = counts.select(F.col("src").alias("o_src"), F.col("part").alias("o_part"), "first",
                            F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    return kept.withColumn("part", part).join(offsets, (F.col("src") == F.col("o_src")) & (F.col("part") == F.col("o_part"))) \
        .select("src", "doc_id", "tie", (F.col("offset") + F.col("at") - F.col("first")).alias("n"))


def positions(docs: DataFrame, weights: Mapping[str, float] | None = None, block: int = BLOCK,
              period: int | None = None) -> DataFrame:
    """Rows (src, doc_id, tie, block, slot, position): a row's place in the mix.

    ``weights``: target share by source name; without it, the sources' row
    counts to the power TEMPERATURE.  Null sources count as the source ''.
    ``tie`` is a hash of the text: rows that agree in source, id and text are
    interchangeable.  ``position`` counts from 0 without gaps within a block;
    a last short block leaves a gap behind it (and with a ``period`` the slots of
    an ended source do).  ``period``: round the weights to so many slots."""
    keys = docs.select(F.coalesce("source", F.lit("")).alias("src"), "doc_id",
                       F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"))
    numbered = common.written(_numbered(keys), "mix-numbers")
    sizes = {r["src"]: r["c"] for r in numbered.groupBy("src").agg(F.count("n").alias("c")).collect()}  # one row a source
    if weights is None:
        weights = {s: c ** TEMPERATURE for s, c in sizes.items()}
    missing = sorted(set(sizes) - set(weights))
    if missing:
        raise ValueError(f"no target weight for sources {missing}")
    n_blocks = {s: -(-c // block) for s, c in sizes.items()}
    blocks = numbered.select("src", F.floor(F.col("n") / block).alias("block")).distinct()
    slots = _exact_slots(blocks, Plan(n_blocks, weights)) if period is None else _period_slots(blocks, schedule(n_blocks, weights, period))
    rows = numbered.withColumn("block", F.floor(F.col("n") / block))
    return rows.join(slots, ["src", "block"]).select(
        "src", "doc_id", "tie", "block", "slot", (F.col("slot") * block + F.col("n") % block).alias("position"))


def mixed(docs: DataFrame, weights: Mapping[str, float] | None = None, block: int = BLOCK, period: int | None = None) -> DataFrame:
    """All rows of ``docs`` with their columns, in mixed order (partition by
    partition, and within each).  Rows equal in source, id and text take the
    positions of their group in any order; such a group, copies of one id, is
    the only thing gathered.  Extra columns stay as they are."""
    where = positions(docs, weights, block, period).groupBy("src", "doc_id", "tie") \
        .agg(F.array_sort(F.collect_list("position")).alias("at"))
    key = F.struct(F.coalesce("source", F.lit("")).alias("src"), "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"))
    rows = docs.select(key.alias("k"), F.struct("*").alias("row"))
    turn = F.row_number().over(Window.partitionBy("k").orderBy(F.lit(1)))
    rows = rows.join(where.select(F.struct("src", "doc_id", "tie").alias("k"), "at"), "k") \
        .withColumn("position", F.get("at", turn - 1))
    return rows.select("position", "row").repartitionByRange(common.wide_partitions(docs), "position") \
        .sortWithinPartitions("position").select("row.*")
