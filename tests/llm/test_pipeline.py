from collections import Counter

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
import corpus_pipeline as cp  # noqa: E402
from recordfold.llm import mixing, pii, quality, simhash  # noqa: E402


def test_stages_take_effect_in_order(spark, make_docs, tmp_path):
    good = [" ".join(f"word{(i * 37 + k * k) % 97} and the" for k in range(30)) for i in range(12)]
    texts = [*good, good[0], good[0] + " x", "too short", None, good[3] + " mail me@host.example.org now", "a b c d e f g h " * 30]
    make_docs(texts).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names = [n for n, _ in cp.STAGES]
    assert names == ["quality_rules", "simhash_neardup", "pii", "source_mix", "bpe_codec"]
    kept = cp.quality_rules(spark, docs, "")
    want = {r.doc_id for r in quality.quality_report(docs).where("kept").collect()}
    assert {r.doc_id for r in kept.collect()} == want and 14 not in want and 15 not in want and 17 not in want
    one = cp.near_duplicates(spark, kept, "")
    comp = simhash.near_duplicates(kept).collect()
    assert sorted(r.doc_id for r in one.collect()) == sorted({r.component_id for r in comp})
    clean = cp.personal_data(spark, one, "")
    assert pii.report(clean).agg(F.sum("n_email")).first()[0] in (0, None) and clean.count() == one.count()
    mix = cp.mix_sources(spark, clean, "")
    assert Counter(map(str, mix.collect())) == Counter(map(str, clean.collect())) and mix.columns == docs.columns
    out = cp.run(spark, str(tmp_path))
    assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in one.collect())
    assert all(r.n_tokens == len(r.ids.split()) == len(r.decoded.split(" ")) for r in out.collect())


def test_empty_table(spark, make_docs):
    docs = make_docs(["x"]).limit(0)
    for _, stage in cp.STAGES:
        out = stage(spark, docs, "")
        assert out.count() == 0


def test_positions_follow_the_mix(spark, tmp_path):
    rows = [(i, f"text {i} " * (1 + 40 * (i % 7 == 0)), "big" if i % 2 else f"s{i % 3}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3)
    weights = {"big": 0.5, "s0": 0.3, "s1": 0.1, "s2": 0.1}
    mixing.mixed(docs, weights, block=1).write.parquet(str(tmp_path / "mix"))
    out = cp.encode(spark, spark.read.parquet(str(tmp_path / "mix")), "").orderBy("position").collect()
    assert [r.position for r in out] == list(range(600))
    want = mixing.positions(docs, weights, block=1).orderBy("position").collect()
    assert [r.doc_id for r in out] == [r.doc_id for r in want]
    source = {i: s for i, _, s in rows}
    for t in range(20, 320, 20):
        seen = Counter(source[r.doc_id] for r in out[:t])
        assert all(abs(seen[s] - w * t) < 2 for s, w in weights.items())
    assert "position" in cp.run(spark, _documents(docs, tmp_path)).columns


def _documents(docs, folder):
    docs.withColumn("lang", F.lit("en")).withColumn("n_chars", F.length("text").cast("bigint")).write.parquet(str(folder / "documents.parquet"))
    return str(folder)
