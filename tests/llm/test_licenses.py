import math
import random
import re

from pyspark.sql import functions as F

from recordfold.llm import licenses


def brute_words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def corpus():
    rng = random.Random(6)
    pool = sorted({w for v in licenses.NOTICES.values() for t in v for w in t.split()} | {"cc", "by", "all", "rights", "reserved", "x", "été", "中"})
    seps = [" ", "-", ". ", "\n", " / "]
    say = lambda n: "".join(rng.choice(pool).upper() + rng.choice(seps) if rng.random() < .3 else rng.choice(pool) + rng.choice(seps) for _ in range(n))
    out = [None, "", "!!", "CC BY", "cc.by", "ccby", "cc by cc by", "Cc-By-NC", "All rights\nreserved", "the General PUBLIC License"]
    notices = [t for v in licenses.NOTICES.values() for t in v]
    for _ in range(150):
        w = rng.choice(notices).split()
        for _ in range(rng.choice([0, 0, 1, 3])):
            w[rng.randrange(len(w))] = "other"
        out.append(say(rng.choice([0, 7, 40])) + " " + " ".join(w) + " " + say(rng.choice([0, 30])))
        out.append("plain words " * rng.choice([1, 30]) + rng.choice(["", "cc by", "all rights reserved!", "by cc"]) + " end" * rng.choice([0, 50]))
    return out + ["word " * 20_000 + "cc by", "dup cc by", "dup cc by"]


def brute(t):
    ws = brute_words(t)
    base = [(i, lab) for p, lab in licenses.PHRASES.items() for i in range(len(ws)) if ws[i:i + len(p.split())] == p.split()]
    labels, score = {lab for _, lab in base}, 1.0 if base else 0.0
    blocks = set()
    for lab, ts in licenses.NOTICES.items():
        for n in ts:
            n = n.split()
            for s in range(0, max(1, len(ws)), len(n)):
                share = len(set(n) & set(ws[s:s + 2 * len(n)]))
                if share >= math.ceil(licenses.THRESHOLD * len(set(n)) - 1e-9):
                    labels.add(lab)
                    score = max(score, share / len(set(n)))
                    blocks.add((lab, " ".join(n), s, share / len(set(n))))
    starts = [i for i, _ in base]
    return (len(ws), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in base})),
            ",".join(sorted(labels)), score), blocks


def test_scan_equals_brute_force(spark, make_docs):
    texts = corpus()
    docs = make_docs([(None if i == 7 else i, t) for i, t in enumerate(texts)]).withColumn("labels", F.lit(1))
    want = [(None if i == 7 else i, *brute(t)[0]) for i, t in enumerate(texts)]
    assert sorted(map(tuple, licenses.scan(docs).collect()), key=str) == sorted(want, key=str)
    index = licenses.templates(docs)
    got = {(r.doc_id, r.label, r.template, r.block_word, r.containment) for r in licenses.matching_blocks(docs, index).collect()
           if r.template not in licenses.PHRASES}
    assert got == {(None if i == 7 else i, *b) for i, t in enumerate(texts) for b in brute(t)[1]}
    assert len({b[0] for *_, b in []} | {g[1] for g in got}) == len(licenses.NOTICES)


def test_order_is_rarest_first_and_empty(spark, make_docs):
    docs = make_docs(["license license mit", "license", "the the", None])
    order = licenses.word_order(docs, frozenset([b"license", b"mit", b"the", b"gnu"]))
    assert order == {b"license": 2, b"mit": 1, b"the": 1}
    assert licenses.scan(docs.limit(0)).count() == 0


def brute_any_start(t):
    """labels and score by the window of 2L words at every start."""
    ws = brute_words(t)
    labels = {lab for p, lab in licenses.PHRASES.items() for i in range(len(ws)) if ws[i:i + len(p.split())] == p.split()}
    score = 1.0 if labels else 0.0
    for lab, ts in licenses.NOTICES.items():
        for n in map(str.split, ts):
            share = max((len(set(n) & set(ws[s:s + 2 * len(n)])) / len(set(n)) for s in range(len(ws))), default=0)
            if share * len(set(n)) >= math.ceil(licenses.THRESHOLD * len(set(n)) - 1e-9) - 1e-9:
                labels.add(lab)
                score = max(score, share)
    return ",".join(sorted(labels)), score


def test_inserted_words_at_any_offset(spark, make_docs):
    texts = ["pad " * k + n + " and more text" * 3 for k in range(9) for n in (
        "licensed under the terms of the apache license version 2 0", "released under the terms of the mit license")]
    rng = random.Random(8)
    for _ in range(120):
        w = rng.choice([t for v in licenses.NOTICES.values() for t in v]).split()
        for _ in range(rng.choice([0, 1, 3, len(w) - 1, len(w) + 1])):
            w.insert(rng.randrange(1, len(w)), rng.choice(["other", "the", "x", "of"]))
        if rng.random() < .3:
            w[rng.randrange(len(w))] = "other"
        texts.append("pad " * rng.randrange(40) + " ".join(w) + " tail" * rng.randrange(40))
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(make_docs(texts), any_start=True).collect()}
    want = {i: brute_any_start(t) for i, t in enumerate(texts)}
    assert all(got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) < 1e-12 for i in want)
    assert all(want[i][0] == ("apache-2.0", "mit")[i % 2] for i in range(18))
