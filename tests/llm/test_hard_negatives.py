import random

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordfold.llm import hard_negatives as H

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                       T.StructField("label", T.IntegerType())])


def brute(rows, step=50):
    good = [(i, lab, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v, lab in rows
            if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, la, va in good:
        if a % step:
            continue
        pos = sorted((-dot(va, v), i) for i, lab, v in good if lab == la and i != a)[:5]
        for ps, p in pos:
            neg = sorted((-s, i) for i, lab, v in good if lab != la for s in [dot(va, v)] if 50 * -ps <= 100 * s <= 95 * -ps)[:3]
            out += [(a, p, r + 1, n, -ps, -s) for r, (s, n) in enumerate(neg)]
    return sorted(out)


def answer(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def test_strassen_is_exact_with_odd_sides_and_wrapping_sums():
    rng = np.random.default_rng(1)
    for m, k, n in [(1, 1, 1), (9, 17, 33), (50, 3, 70), (31, 64, 45), (20, 0, 20)]:
        a, b = rng.integers(-9, 9, (m, k)), rng.integers(-9, 9, (k, n))
        assert (H.strassen(a, b, 4) == a @ b).all()
    a = rng.integers(-2 ** 62, 2 ** 62, (33, 34))
    assert (H.strassen(a, np.eye(34, dtype=np.int64), 2) == a).all()


def test_heaps_merge():
    rng = np.random.default_rng(2)
    s = rng.integers(-3, 4, (20, 40))
    ids = np.sort(rng.permutation(1000)[:40])
    whole = H.best_of(s.copy(), ids, 5)
    one, two = H.best_of(s[:, ::2].copy(), ids[::2], 5), H.best_of(s[:, 1::2].copy(), ids[1::2], 5)
    for got, want in zip(H.merge(one, two), whole):
        assert (got == want).all()
    few = H.merge(H.best_of(s[:, :2].copy(), ids[:2], 5), H.best_of(s[:, 2:3].copy(), ids[2:3], 5))
    assert (few[0][:, 3:] == H.NOTHING).all() and (few[0][:, :3] != H.NOTHING).all()


def test_same_rows_as_brute_force(spark, monkeypatch):
    monkeypatch.setattr(H, "CANDIDATE_TILE", 60)
    monkeypatch.setattr(H, "ANCHOR_TILE", 3)
    monkeypatch.setattr(H, "HELD_ANCHORS", 7)
    rng = random.Random(5)
    vec = lambda: [rng.uniform(-1, 1) for _ in range(9)]
    rows = [(i, vec(), rng.choice([0, 0, 0, 1, 2])) for i in range(700)]
    common = vec()
    rows += [(i, common, i % 3) for i in range(700, 1000)]                                    # a very common vector: ties
    rows += [(None, vec(), 1), (1001, None, 1), (1002, vec(), None), (1003, [float("nan")] * 9, 1), (1050, [1.0, None] * 4, 1),
             (1004, [float("inf")] * 9, 0), (1005, [], 2), (1006, [0.5] * 4, 1), (-50, vec(), 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    extra = df.withColumn("tile", F.lit(1)).withColumn("score", F.lit(2)).withColumn("id", F.lit(3)).repartition(5)
    assert answer(H.mine(extra)) == brute(rows)


def test_repeated_ids_large_components_and_empty_tables(spark):
    rng = random.Random(6)
    rows = [(i % 60, [rng.uniform(0, 1) for _ in range(5)], i % 2) for i in range(180)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = H.mine(df, anchor_step=30)
    assert got.groupBy("anchor_id").count().count() == 2
    assert answer(got) == brute(rows, 30)
    assert H.mine(df.limit(0)).count() == 0
    assert H.mine(df.where("vec_id % 50 != 0")).count() == 0
    big = [(0, [3e5, 1.0], 0), (1, [2e5, 1.0], 0), (2, [1.5e5, 7.0], 1), (3, [3e38, 3e38], 1)]
    assert answer(H.mine(spark.createDataFrame(big, SCHEMA))) == brute(big[:3])


def test_repeated_tiles_are_not_broadcast_and_cells_hold_groups_of_tiles(spark, monkeypatch, capsys):
    monkeypatch.setattr(H, "CANDIDATE_TILE", 5)
    monkeypatch.setattr(H, "ANCHOR_TILE", 1)
    rng = random.Random(7)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)], i % 3) for i in range(400)]
    tiles = lambda n, keep: H.tiles(H.usable(spark.createDataFrame(rows, SCHEMA).where(keep), 256).repartition(n), 5)
    anchors, candidates = tiles(40, "vec_id % 10 = 0"), tiles(8, "true")
    monkeypatch.setattr(H.common, "wide_partitions", lambda df: 2)
    pairs = H._pairs(anchors, candidates, 40, 80)
    pairs.explain()
    plan = capsys.readouterr().out
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
    met = pairs.select("row", "col", "a_tile", "c_tile").collect()
    assert len({(r.a_tile, r.c_tile) for r in met}) == len(met) == anchors.count() * candidates.count()
    assert len({(r.row, r.col) for r in met}) <= 5 * 10
    assert answer(H.mine(spark.createDataFrame(rows, SCHEMA), anchor_step=10)) == brute(rows, 10)
