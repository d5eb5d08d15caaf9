import hashlib
import random
import re

from pyspark.sql import functions as F

from recordfold.llm import fill_middle as M


def brute(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    d = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * i:8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return (doc_id, n, "plain", None, None, text)
    pre, mid, suf = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    out = f"<S>{suf}<P>{pre}<M>{mid}" if h[3] % 100 < 20 else f"<P>{pre}<S>{suf}<M>{mid}"
    return (doc_id, n, "spm" if h[3] % 100 < 20 else "psm", len(pre), len(mid), out)


def corpus():
    rng = random.Random(3)
    parts = ["word", "A", " ", "é", "🙂", "\n", "<", ">", "<S", "P>", "M", "1", "ſ", "K", "\x00", "[", "`", "{", "@", "ß"]
    fixed = [None, "", "a", " ", "<P>", "x<M>y", "<<S>>", "word" * 30_000, "é " * 60_000, "ab " * 100_000]
    return fixed + ["".join(rng.choice(parts) for _ in range(rng.choice([1, 2, 9, 80, 700]))) for _ in range(900)]


def test_skip_list_finds_every_rank():
    for text in ["", "a", "one two  three", "é🙂" * 300 + "abc" * 50 + " x" * 900]:
        starts = M.unit_starts(text)
        units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
        s = M.SkipList(starts, len(text))
        assert [s.chars_before(r) for r in range(len(units) + 1)] == [len("".join(units[:r])) for r in range(len(units) + 1)]
    assert len(M.SkipList(M.unit_starts("a " * 5000), 10_000).lanes) > 3


def test_same_rows_as_brute_force(spark, make_docs):
    texts = corpus()
    docs = make_docs(texts).withColumn("form", F.lit(1)).withColumn("n", F.lit(2)).withColumn("output", F.lit(3))
    got = sorted(tuple(r) for r in M.rewritten(docs).collect())
    want = sorted(brute(i, t) for i, t in enumerate(texts))
    assert got == want and {r[2] for r in got} == {"plain", "psm", "spm"}
    assert all(M.restored(r[5], r[2]) == (texts[r[0]] or "") for r in got)


def test_digests_and_odd_tables(spark, make_docs):
    docs = make_docs([(1, "some text here"), (1, "some text here"), (2, None), (None, "no id")])
    got = M.digests(docs).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert len(got) == 4 and got[0] == got[1]
    for r, (i, t) in zip(got, [(1, "some text here"), (1, "some text here"), (2, ""), (None, "no id")]):
        want = brute(i, t)
        assert tuple(r)[:5] == want[:5] and (r.output_sha256, r.restored_sha256) == (sha(want[5]), sha(t))
    assert M.digests(docs.limit(0)).count() == 0 and M.rewritten(docs.limit(0)).count() == 0
