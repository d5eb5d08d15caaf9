import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from recordfold.llm import simhash


def brute_fp(text, k=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[ \t-\r]+", low) if w]
    sh = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def brute_components(fps, bits):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    fps = list(parent)
    for i, a in enumerate(fps):
        for b in fps[i + 1:]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= bits:
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {f: find(f) for f in fps}


def corpus(seed=5, n=60):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["Été", "ÀÉ", "naïve", "中文"]
    out = [None, "", "  \t\n ", "one", "One two", "one two three four five", "A " * 5000]
    for _ in range(n):
        words = [rng.choice(vocab) for _ in range(rng.choice([3, 10, 80, 200]))]
        out.append(" ".join(words))
        for _ in range(rng.choice([0, 0, 2])):
            w = list(words)
            w[rng.randrange(len(w))] = "edited"
            out.append("\n".join(w))
    return out + out[10:14]


def test_fingerprint_is_the_majority_of_shingle_hashes():
    for t in corpus():
        assert simhash.fingerprint(t) & (2**64 - 1) == brute_fp(t)


def test_near_duplicates_equal_brute_force(spark, make_docs):
    texts = corpus()
    pairs = [(900 - i, t) for i, t in enumerate(texts)] + [(None, texts[12]), (890, texts[10]), (None, "alone here")]
    got = simhash.near_duplicates(make_docs(pairs).withColumn("fp", F.lit(1)).withColumn("root", F.lit("x"))).collect()
    assert len(got) == len(pairs)
    fp = {}
    for i, t in pairs:
        fp.setdefault(brute_fp(t), []).append(i)
    root = brute_components(fp, 4)
    low = {}
    for f, ids in fp.items():
        for i in ids:
            if i is not None:
                low[root[f]] = min(i, low.get(root[f], i))
    want = sorted(((i, f"{brute_fp(t):016x}", low.get(root[brute_fp(t)])) for i, t in pairs), key=str)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == want


def test_links_find_every_close_pair_in_dense_clusters(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 6, dtype=np.uint64)
    fps = set(rng.integers(0, 2**63, 400, dtype=np.uint64).tolist())
    for b in base.tolist():
        for _ in range(400):
            x = b
            for bit in rng.choice(64, rng.integers(0, 5), replace=False):
                x ^= 1 << int(bit)
            fps.add(x)
    signed = [(int(np.uint64(x).view(np.int64)),) for x in fps]
    df = spark.createDataFrame(signed, "fp bigint").cache()
    old = simhash.CELL
    simhash.CELL = 64  # many blocks per value
    try:
        got = {r.node: r.root for r in simhash.components(simhash.links(df, 4)).collect()}
    finally:
        simhash.CELL = old
    want = brute_components([x for (x,) in signed], 4)
    groups = {}
    for x, r in want.items():
        groups.setdefault(r, set()).add(x)
    assert all(got.get(x, x) == min(g) for g in groups.values() for x in g)


def test_thresholds_sum_and_ball_counts():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 3, (simhash.PARTS, simhash.VALUES))
    balls = simhash.ball_counts(h, 4)
    v = 1234
    pop = np.bitwise_count(np.arange(simhash.VALUES) ^ v)
    assert [balls[2, r, v] for r in range(5)] == [h[2][pop <= r].sum() for r in range(5)]
    values = rng.integers(0, simhash.VALUES, (500, simhash.PARTS))
    t = simhash.allocate(values, balls, 4)
    assert (t.sum(1) == 1).all() and (t >= -1).all()


def test_keep_one_and_empty(spark, make_docs):
    docs = make_docs([(3, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (7, "x y z w v"), (None, "solo text alone here"),
                      (7, "x y z w v")]).withColumn("fp", F.lit("k")).withColumn("row", F.lit(2))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "7", "None"]
    assert simhash.keep_one(docs.limit(0)).count() == 0
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
