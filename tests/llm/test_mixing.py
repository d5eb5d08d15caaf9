import random
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from recordfold.llm import mixing


def test_period_deviates_by_less_than_one_block():
    rng = random.Random(1)
    for _ in range(40):
        w = {f"s{i}": rng.random() ** 3 + 1e-3 for i in range(rng.choice([1, 2, 5, 20]))}
        slots = mixing.fractions(w, rng.choice([7, 30, 200]))
        order, n = mixing.pfair_period(slots), sum(slots.values())
        seen = Counter()
        for t, s in enumerate(order, 1):
            seen[s] += 1
            assert all(abs(seen[x] - Fraction(slots[x] * t, n)) < 1 for x in slots)
        assert seen == Counter(slots)


def test_fractions_and_errors():
    assert mixing.fractions({}) == {} and sum(mixing.fractions({"a": 1, "b": 1e-9}, 10).values()) == 10
    assert mixing.fractions({str(i): 1 for i in range(30)}, 10) == {str(i): 1 for i in range(30)}
    with pytest.raises(ValueError):
        mixing.fractions({"a": 0.0})


def brute_slots(blocks, weights, period):
    """Slot of every (source, block), phase by phase, laid out one by one."""
    done, at, out = dict.fromkeys(blocks, 0), 0, {}
    while any(done[s] < n for s, n in blocks.items()):
        live = {s: weights[s] for s in blocks if done[s] < blocks[s]}
        slots = mixing.fractions(live, period)
        for place, s in enumerate(mixing.pfair_period(slots)):
            if done[s] < blocks[s]:
                out[s, done[s]] = at + place
                done[s] += 1
        at += sum(slots.values())
    return out


def test_positions_equal_brute_force(spark):
    rng = random.Random(2)
    rows = [(i if rng.random() < .98 else None, f"t{rng.randrange(300)}", rng.choice(["hot"] * 6 + ["a", "b", None, "rare" if i < 5 else "c"]))
            for i in rng.sample(range(5000), 700)] + [(9, "same", "a")] * 3
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("slot", F.lit(1)).repartition(5)
    weights = {"hot": 1.0, "a": 2.0, "b": 0.5, "c": 1.0, "rare": 3.0, "": 1.0}
    got = mixing.positions(docs, weights, block=4, period=20).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.src, []).append(r)
    want = brute_slots({s: -(-len(v) // 4) for s, v in by.items()}, weights, 20)
    for s, v in by.items():
        v.sort(key=lambda r: r.position)
        ids = [r.doc_id for r in v]
        assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
        assert [(r.block, r.slot) for r in v] == [(n // 4, want[s, n // 4]) for n in range(len(v))]
        assert [r.position for r in v] == [want[s, n // 4] * 4 + n % 4 for n in range(len(v))]
    assert len({r.position for r in got}) == len(rows)
    with pytest.raises(ValueError):
        mixing.positions(docs, {"hot": 1.0})


def test_mixed_is_a_permutation(spark, make_docs):
    docs = make_docs([(i % 50, f"text {i % 60}") for i in range(120)] + [(None, None), (None, None)]).withColumn("position", F.lit("x"))
    out = mixing.mixed(docs, block=2, period=9)
    assert out.columns == docs.columns
    assert sorted(map(str, out.collect())) == sorted(map(str, docs.collect()))
    assert mixing.mixed(docs.limit(0)).count() == 0


def deviation(blocks, weights):
    """Largest |blocks so far - weight * slots so far| of any source in any phase, at its own blocks."""
    plan = mixing.Plan(blocks, weights)
    slots = {(s, j): plan.slot(plan.phase(s, j), s, j) for s, n in sorted(blocks.items()) for j in range(n)}
    assert sorted(slots.values()) == list(range(sum(blocks.values())))
    worst = 0
    for p, start in enumerate(plan.starts):
        first = dict(zip(plan.names, plan.first[p].tolist()))
        live = [s for s in blocks if first[s] < blocks[s]]
        total = sum(Fraction(weights[s]) for s in live)
        for s in live:
            w, end = Fraction(weights[s]) / total, plan.first[p + 1][plan.number[s]] if p + 1 < len(plan.starts) else blocks[s]
            for n in range(int(end) - first[s]):
                t = slots[s, first[s] + n] - start
                worst = max(worst, abs(n - w * t), abs(n + 1 - w * (t + 1)))
    return worst


def test_exact_weights_over_many_periods():
    rest = {f"s{i:02d}": 0.7 / 19 for i in range(19)}
    weights = {"big": 0.3, **rest}
    assert deviation({s: int(12_000 * w) for s, w in weights.items()}, weights) < 2
    rng = random.Random(3)
    for _ in range(15):
        names = [f"s{i}" for i in range(rng.choice([1, 2, 3, 9]))]
        assert deviation({s: rng.randrange(1, 400) for s in names}, {s: rng.random() ** 4 + 1e-6 for s in names}) < 2


def test_more_sources_than_a_period_keep_their_weights():
    weights = {"big": 1 / 3, **{f"s{i:04d}": 2 / 3 / 1200 for i in range(1200)}}
    plan = mixing.Plan({"big": 1200, **{s: 4 for s in weights if s != "big"}}, weights)
    at = [plan.slot(plan.phase("big", j), "big", j) for j in range(1200)]
    assert all(abs(j + 1 - (t + 1) / 3) < 2 for j, t in enumerate(at))


def test_default_positions_follow_the_weights(spark):
    docs = spark.createDataFrame([(i, f"t{i}", "big" if i % 10 < 5 else f"s{i % 10}") for i in range(3000)],
                                 "doc_id bigint, text string, source string").repartition(4)
    weights = {"big": 0.5003, **{f"s{i}": 0.4997 / 5 for i in range(5, 10)}}
    got = mixing.positions(docs, weights, block=1).orderBy("position").collect()
    assert [r.position for r in got] == list(range(3000))
    seen = Counter()
    for t, r in enumerate(got[:2900], 1):
        seen[r.src] += 1
        assert all(abs(seen[s] - w * t) < 2 for s, w in weights.items())
    for s in weights:
        assert [r.doc_id for r in got if r.src == s] == sorted(r.doc_id for r in got if r.src == s)
    assert mixing.positions(docs.limit(0)).count() == 0
