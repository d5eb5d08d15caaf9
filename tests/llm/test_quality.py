import math
import random
import re
import unicodedata
from collections import Counter

from pyspark.sql import functions as F

from recordfold.llm import quality


def brute_words(t):
    return [w for w in re.split("[ \t-\r]+", t or "") if w]


def brute_base(t):
    t = t or ""
    ws = brute_words(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if brute_words(line):
            dup += line in seen
            seen.add(line)
    wins = [tuple(ws[i:i + 8]) for i in range(len(ws) - 7)]
    n = Counter(wins)
    rep = len({i + k for i, w in enumerate(wins) if n[w] > 1 for k in range(8)})
    return (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), dup, rep, len(ws) < 20 or 100 * rep > 30 * len(ws))


def brute_histograms(t, lang):
    chars = "".join(brute_words(t))
    kind = lambda c: (0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if c in "0123456789"
                      else 3 if unicodedata.category(c)[0] == "L" else 4 if c in ".,;:!?'\"()-" else 5)
    k = Counter(map(kind, chars))
    ws = Counter(brute_words(t))
    own = [ws[w] for w in quality.COMMON_WORDS.get(lang, [])]
    return [k[i] for i in range(6)], own + [sum(ws.values()) - sum(own)]


def brute_distance(p, q):
    p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
    kl = lambda a, m: sum(x * math.log2(x / y) for x, y in zip(a, m) if x)
    m = [(x + y) / 2 for x, y in zip(p, q)]
    return math.sqrt(max(0, (kl(p, m) + kl(q, m)) / 2))


def corpus():
    rng = random.Random(2)
    vocab = "the of and to in it is alpha beta Gamma delta, été naïve x1 2024 (yes) a-b".split() + [f"w{i}" for i in range(80)]
    say = lambda n, v=vocab: " ".join(rng.choice(v) for _ in range(n))
    out = [None, "", " \t\n", "a\n\na\na \nb", "the the", say(8) + " " + say(3), ("p q r s t u v w " * 6).strip(), "x " * 3000]
    out += [say(rng.choice([15, 60, 300])) for _ in range(25)]
    for _ in range(8):
        block = say(rng.choice([8, 9, 20]))
        out.append(say(40) + " " + block + "\n" + say(rng.choice([0, 5, 30])) + "\n" + block + "\n" + say(20))
    out += [" ".join(w + "###" for w in say(80).split()), " " + say(30), "中文 🙂 " + say(60)]
    return out + out[8:10]


def test_report_equals_brute_force(spark, make_docs):
    docs = make_docs(corpus()).withColumn("q", F.lit(1)).withColumn("row", F.lit("r")).withColumn("kept", F.lit(0))
    rows = {r.doc_id: r for r in docs.collect()}
    refs = {}
    for r in rows.values():
        if r.lang in quality.COMMON_WORDS and len(brute_words(r.text)) >= 20:
            c, w = brute_histograms(r.text, r.lang)
            a = refs.setdefault(r.lang, [[0] * 6, [0] * 21])
            refs[r.lang] = [[x + y for x, y in zip(a[0], c)], [x + y for x, y in zip(a[1], w)]]
    got = quality.quality_report(docs).collect()
    assert len(got) == len(rows)
    for g in got:
        r = rows[g.doc_id]
        base = brute_base(r.text)
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words, g.base_failed) == base, r.text[:200]
        cd = wd = None
        if r.lang in refs:
            c, w = brute_histograms(r.text, r.lang)
            cd = brute_distance(c, refs[r.lang][0]) if sum(c) >= quality.MIN_CHARS else None
            wd = brute_distance(w, refs[r.lang][1]) if sum(w) >= quality.MIN_WORDS else None
        for have, want in ((g.class_distance, cd), (g.word_distance, wd)):
            assert (have is None) == (want is None) and (want is None or abs(have - want) < 1e-9)
        far = (cd or 0) > quality.MAX_CLASS_DISTANCE or (wd or 0) > quality.MAX_WORD_DISTANCE or (
            (cd or 0) > quality.ODD_CLASS_DISTANCE and (wd or 0) > quality.ODD_WORD_DISTANCE)
        assert g.kept == (not base[5] and not far)


def test_keep_good_keeps_columns_and_handles_empty(spark, make_docs):
    docs = make_docs(corpus()).withColumn("q", F.lit(1))
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert kept.count() == quality.quality_report(docs).where("kept").count()
    assert quality.keep_good(docs.limit(0)).count() == 0
    assert "PythonUDF" not in kept._jdf.queryExecution().executedPlan().toString()


def test_query_equals_its_duckdb_twin(spark):
    import os

    import duckdb
    import pytest

    from recordfold.llm import queries
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("driver tables absent")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    got = queries.QUERIES["op3_quality_rules"](spark, sf)
    want = con.execute(queries.ORACLE["op3_quality_rules"]).df()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want[got.columns].values.tolist()))


def test_ordinary_letters_without_common_words_are_rejected(spark, make_docs):
    rng = random.Random(7)
    salad = lambda n: " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(n))
    plain = [" ".join(rng.choice(quality.COMMON_WORDS["en"] + ["word", "table", "green", "river", "stone"] * 5) for _ in range(300)) for _ in range(30)]
    docs = make_docs([*plain, salad(400), salad(30)]).withColumn("lang", F.lit("en"))
    got = {r.doc_id: r for r in quality.quality_report(docs).collect()}
    assert all(got[i].kept for i in range(30))
    assert not got[30].kept and not got[30].base_failed and got[30].word_distance > quality.MAX_WORD_DISTANCE
    assert got[31].kept and got[31].word_distance is None  # too short to judge by its words
    assert quality.quality_report(docs.limit(0)).count() == 0
