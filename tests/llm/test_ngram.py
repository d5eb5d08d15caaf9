import math
import random
import zlib
from collections import Counter

from pyspark.sql import functions as F

from recordfold.llm import ngram


def toks(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return [w for w in __import__("re").split("[ \t-\r]+", low) if w] + [None]


def corpus():
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(30)] + ["The", "été", "中"]
    out = [None, "", "The the THE", "only once here"]
    for _ in range(120):
        n, t = rng.choice([2, 20, 60]), [rng.choice(vocab)]
        for _ in range(n):
            k = vocab.index(t[-1]) if t[-1] in vocab else 0
            t.append(vocab[(k * 7 + rng.choice([1, 1, 1, 2, 5])) % len(vocab)] if rng.random() < .9 else f"rare{rng.randrange(400)}")
        out.append("  ".join(t) + "\n")
    return out


def brute(pairs, share, d=ngram.DISCOUNT):
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in pairs]
    c, bi = Counter(), Counter()
    for (_, t), h in zip(pairs, held):
        if not h:
            w = toks(t)
            c.update(w)
            bi.update(zip(["<s>", *w[:-1]], w))
    n, v, least = sum(c.values()), len(c), max(2, math.ceil(sum(c.values()) * share))
    uni = lambda w: (c[w] + 1) / (n + v + 1)
    head = {w for w in c if w is None or c[w] >= least} | {"<s>"}
    kept = {k: x for k, x in bi.items() if x >= least and k[0] in head and k[1] in head}
    seen = lambda h: c[None] if h == "<s>" else c[h]

    def prob(h, w):
        if (h, w) in kept:
            return (kept[h, w] - d) / seen(h)
        mine = {b: x for (a, b), x in kept.items() if a == h}
        return uni(w) * (1 - sum(x - d for x in mine.values()) / (seen(h) or 1)) / (1 - sum(map(uni, mine)))
    memo = {}
    out = []
    for (i, t), h in zip(pairs, held):
        w = toks(t)
        lp = sum(memo.setdefault((a, b), math.log10(prob(a, b))) for a, b in zip(["<s>", *w[:-1]], w))
        out.append((i, h, len(w), sum(c[x] > 0 for x in w), n, sum(math.log10(uni(x)) for x in w), lp))
    return out, prob, c


def close(a, b):
    return all(x == y if not isinstance(x, float) else abs(x - y) < 1e-6 for x, y in zip(a, b))


def test_scores_equal_brute_force(spark, make_docs):
    pairs = list(enumerate(corpus())) + [(None, "the w1 w8"), (5, "repeated row"), (5, "repeated row")]
    docs = make_docs(pairs).withColumn("n", F.lit(1)).withColumn("row", F.lit(1)).withColumn("h", F.lit(1)).repartition(3)
    for share in (1e-6, 0.004):
        want, prob, c = brute(pairs, share)
        got = sorted(map(tuple, ngram.train_and_score(docs, share).collect()), key=str)
        assert len(got) == len(want)
        for a, b in zip(got, sorted(want, key=str)):
            assert close(a, b), (a, b)
        for h in ("<s>", "w1", "été", "rare1"):  # every history sums to one over known words and one unknown
            assert abs(sum(prob(h, w) for w in c) + prob(h, "never seen") - 1) < 1e-9
    held = [r for r in want if r[1]]
    assert held and sum(r[6] for r in held) > sum(r[5] for r in held)  # beats unigrams on held-out texts


def test_empty_and_all_held_out(spark, make_docs):
    docs = make_docs(["a b"])
    assert ngram.train_and_score(docs.limit(0)).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    got = ngram.train_and_score(make_docs([(held, "a b")])).first()
    assert (got.held_out, got.n_tokens, got.n_known, got.train_tokens, got.base_score) == (True, 3, 0, 0, 0.0)


def test_broadcast_part_changes_no_score(spark, make_docs):
    """Every bigram of two occurrences is kept however small the part of the automaton that is broadcast."""
    pairs = list(enumerate(corpus())) + [(7000 + i, "odd pair here") for i in range(9)] + [(None, "never rare1 rare1 odd pair never")] * 2
    docs = make_docs(pairs).repartition(3)
    want = sorted(brute(pairs, 0)[0], key=str)
    for broadcast in (0.004, 0.05, 1.0):
        got = sorted(map(tuple, ngram.train_and_score(docs, broadcast=broadcast).collect()), key=str)
        assert len(got) == len(want)
        for a, b in zip(got, want):
            assert close(a, b), (broadcast, a, b)


def test_scoring_sorts_no_rows_to_aggregate_them(spark, make_docs):
    plan = ngram.train_and_score(make_docs(corpus()))._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "ObjectHashAggregate" not in plan


def test_texts_are_scored_a_slice_at_a_time(spark, make_docs, monkeypatch):
    """The last job has a part of the rows; all slices together have every row, repeated and null ones too."""
    pairs = list(enumerate(corpus())) + [(None, "the w1 w8"), (None, None), (5, "repeated row"), (5, "repeated row")]
    docs = make_docs(pairs).repartition(3)
    labels, written = [], ngram.common.written
    monkeypatch.setattr(ngram.common, "written", lambda df, label: labels.append(label) or written(df, label))
    got = sorted(map(tuple, ngram.train_and_score(docs).collect()), key=str)
    assert labels.count("lm-scores") == ngram.SLICES - 1 > 0
    want = sorted(brute(pairs, 0)[0], key=str)
    assert len(got) == len(want) and all(map(close, got, want))
    own = F.pmod(F.xxhash64("doc_id", "text"), F.lit(ngram.SLICES))
    assert 0 < docs.where(own == ngram.SLICES - 1).count() < len(pairs)
