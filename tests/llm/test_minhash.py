import hashlib
import random
import time

import numpy as np
from pyspark.sql import functions as F

from recordfold.llm import common, minhash


def shingles(t):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def corpus(n=40, seed=7):
    rng = random.Random(seed)
    vocab = [f"W{i}" for i in range(400)] + ["été", "中文🙂"]
    out = [None, "", " \n", "a", "two words", "one two three four five"]
    for _ in range(n):
        w = [rng.choice(vocab) for _ in range(rng.choice([4, 30, 120]))]
        out.append(" ".join(w))
        for _ in range(rng.choice([0, 0, 1, 3])):
            v = list(w)
            v[rng.randrange(len(v))] = "x"
            out.append("  ".join(v).lower())
    return out + ["long " * 30_000]


def test_signature_estimates_jaccard():
    rng = random.Random(1)
    base = [f"w{i}" for i in range(2000)]
    for keep in (0, 500, 1000, 1600, 2000):
        other = base[:keep] + [f"v{rng.random()}" for _ in range(2000 - keep)]
        a, b = " ".join(base), " ".join(other)
        s = [minhash.signature(minhash.shingle_hashes(t)) for t in (a, b)]
        assert abs(minhash.likeness(*s) - jaccard(a, b)) < 0.16
    assert len(minhash.shingle_hashes("a b c d e f a b c d e f")) == len(shingles("a b c d e f a b c d e f"))


def test_with_next_equals_brute_force(spark, make_docs):
    pairs = [(3 * i, t) for i, t in enumerate(corpus())] + [(None, "no id here at all today"), (6, "another six")]
    docs = make_docs(pairs).withColumn("fp", F.lit("x")).withColumn("tie", F.lit("x")).repartition(3)
    got = minhash.with_next(docs).collect()
    assert len(got) == len(pairs)
    tie = {(r.doc_id, r.text or ""): r.h for r in docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(((i, t or "") for i, t in pairs), key=lambda p: (p[0] is not None, p[0] or 0, tie[p]), reverse=True)
    want = []
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        edited = t[:len(t) - len(t) // 3] + nxt[:len(t) // 3]
        s, e, n = (minhash.signature(minhash.shingle_hashes(x)) for x in (t, edited, nxt))
        hx = lambda x: minhash.fingerprint_bytes(x).hex()
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), hx(s), hx(e), minhash.likeness(s, e), minhash.likeness(s, n)))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    one = minhash.with_next(docs.where("doc_id = 18")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert minhash.with_next(docs.limit(0)).count() == 0


def test_near_duplicates_equal_brute_force(spark, make_docs):
    pairs = [(500 - i, t) for i, t in enumerate(corpus(25))] + [(None, "alone without id"), (None, None)]
    old = minhash.CELL
    minhash.CELL = 4
    try:
        got = minhash.near_duplicates(make_docs(pairs)).collect()
    finally:
        minhash.CELL = old
    root = list(range(len(pairs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(pairs)):
        for j in range(i):
            if jaccard(pairs[i][1], pairs[j][1]) >= 0.8:
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(pairs):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    want = sorted(((d, low.get(find(i))) for i, (d, _) in enumerate(pairs)), key=str)
    assert sorted(map(tuple, got), key=str) == want


def test_registered_query_returns_classes(spark, make_docs, tmp_path):
    from recordfold.llm import queries
    pairs = [(500 - i, t) for i, t in enumerate(corpus(15))] + [(None, None), (None, None), (7, "seven is here twice"), (7, "but as another text")]
    docs = make_docs(pairs)
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    out = queries.QUERIES["op1_fingerprints"](spark, str(tmp_path))
    plain = minhash.with_next(docs)
    assert sorted(map(str, out.select(plain.columns).collect())) == sorted(map(str, plain.collect()))
    got = sorted(map(tuple, out.select("doc_id", "class_id").collect()), key=str)
    assert got == sorted(map(tuple, minhash.near_duplicates(docs).collect()), key=str)
    assert len({c for _, c in got}) < len(got) - 3


def test_texts_and_sets_are_moved_a_slice_at_a_time(spark, make_docs, monkeypatch):
    """No job moves the texts of all sets that met, or compares them all; together the jobs do."""
    docs = make_docs([(i, " ".join(f"w{k}" for k in range(100)) + f" end{i // 2}" + " more" * (i % 2)) for i in range(100)])
    monkeypatch.setattr(minhash, "CELL", 16)
    counts, written = {}, common.written

    def noted(df, label):
        out = written(df, label)
        counts.setdefault(label, []).append(out.count())
        return out
    monkeypatch.setattr(common, "written", noted)
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == 100 and {r.class_id for r in got} == {0}
    for label in ("minhash-met", "minhash-links"):
        assert sum(n > 0 for n in counts[label]) > 1, label
    assert max(counts["minhash-met"]) < sum(counts["minhash-met"]) == sum(counts["minhash-reps"])


def test_shuffle_files_go_with_the_query_that_made_them(spark):
    common.bounded_batches(spark)
    blocks = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    names = lambda: {b for b in blocks.getAllFiles().mkString("\n").split("\n") if "shuffle_" in b}
    before = names()
    common.written(spark.range(5000).groupBy("id").count(), "freed")
    for _ in range(50):
        if not names() - before:
            break
        time.sleep(0.1)
    assert not names() - before
