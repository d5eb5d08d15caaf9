"""Per-file tolerance, compaction in place, comment batches, ranged positions."""
import os
import random
import tempfile

from pyspark.sql import functions as F

from helpers import rows
from recordfold.operators.positional import ranged_index
from recordfold.schemas import ANNOTATIONS, RULE_COMMENTS
from recordfold.sources import copartition, decisions, ingest, rule_store


def test_damaged_files_are_rejected_one_by_one(spark):
    base = tempfile.mkdtemp(prefix="files-")
    df = spark.createDataFrame([("p1", "F", 3), ("p2", "M", 4)], "patient_id string, sexe string, age int")
    df.repartition(2).write.parquet(f"{base}/a")
    for name, content in (("bad.parquet", b"PAR1 nothing PAR1"), ("empty.parquet", b"")):
        with open(f"{base}/{name}", "wb") as f:
            f.write(content)
    good, rejects = ingest.load_files(spark, base, "patients")
    assert rows(good, "patient_id", "age") == [("p1", 3), ("p2", 4)]
    got = {os.path.basename(r.file): r.reason for r in rejects.collect()}
    assert got == {"bad.parquet": "no_row_read"}
    os.makedirs(f"{base}/only")
    with open(f"{base}/only/x.parquet", "wb") as f:
        f.write(b"no")
    good, rejects = ingest.load_files(spark, f"{base}/only", "patients")
    assert good.count() == 0 and rejects.count() == 1 and "patient_id" in good.columns
    good, rejects = ingest.load_files(spark, f"{base}/nowhere", "patients")
    assert good.count() == rejects.count() == 0


def test_compaction_in_place_never_shows_a_row_twice(spark):
    root = tempfile.mkdtemp(prefix="log-")
    log = spark.range(40).select(*[(F.col("id") if f.name == "seq" else F.concat(F.lit("x"), F.col("id") % 3) if f.name == "user" else F.lit(None))
                                   .cast(f.dataType).alias(f.name) for f in ANNOTATIONS.fields])
    seqs = lambda: sorted(r.seq for r in decisions.read_all_decisions(spark, root).collect())
    for i in range(4):
        decisions.append_decisions(log.where(F.col("seq") % 4 == i), root, f"b{i}")
    opened = decisions.read_all_decisions(spark, root)
    decisions.compact(spark, root)
    assert opened.count() == 40 and seqs() == list(range(40))
    decisions.append_decisions(log.where("seq = 7"), root)
    decisions.append_decisions(log, root, f"{decisions.COMPACTED}unfinished")   # no list of replaced batches: not live
    decisions.append_decisions(log.where(F.col("seq") % 4 == 2), root, "b2")    # replayed
    assert seqs() == sorted([*range(40), 7])
    decisions.compact(spark, root)
    assert seqs() == sorted([*range(40), 7])
    assert decisions.read_user_decisions(spark, root, "x1").count() == len([i for i in [*range(40), 7] if i % 3 == 1])


def test_comment_batches_belong_to_a_version(spark):
    root = tempfile.mkdtemp(prefix="rules-")
    c = lambda i: spark.createDataFrame([(f"c{i}", "RG-01", "ana", None, "t")], RULE_COMMENTS)
    ids = lambda: sorted(r.id for r in rule_store.read_current(spark, root, "rules_commentaires").collect())
    rule_store.append_comments(c(0), root, spark)
    rule_store.append_comments(c(1), root, spark, "b")
    rule_store.append_comments(c(1), root, spark, "b")
    assert ids() == ["c0", "c1"]
    rule_store.fold_comments(spark, root)
    rule_store.append_comments(c(2), root, spark)
    assert ids() == ["c0", "c1", "c2"] and rule_store.current_version(spark, root, "rules_commentaires") == 1


def test_ranged_positions_equal_row_numbers(spark):
    rng = random.Random(1)
    data = [(rng.choice(["hot"] * 5 + ["a", "b", None]), rng.randrange(50) if rng.random() < .95 else None, i) for i in range(900)]
    df = spark.createDataFrame(data, "g string, o int, u int").repartition(5)
    got = {(r.g, r.o, r.u): r.idx for r in ranged_index(df, ["g"], ["o", "u"]).collect()}
    for g in {"hot", "a", "b", None}:
        want = sorted([d for d in data if d[0] == g], key=lambda d: (d[1] is not None, d[1] or 0, d[2]))
        assert [got[d] for d in want] == list(range(len(want)))
    alone = ranged_index(df, [], ["u"]).orderBy("u")
    assert [r.idx for r in alone.collect()] == list(range(900))
    plan = alone._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan or "row_number" not in plan
    assert ranged_index(df.limit(0), ["g"], ["o"]).count() == 0


def test_tables_by_stay_meet_without_an_exchange(spark):
    one = spark.range(200).selectExpr("concat('p', id % 7) patient_id", "concat('s', id % 20) id_sejour", "id v")
    t = copartition.tables_by_stay({"a": one, "b": one.withColumnRenamed("v", "w"), "c": spark.range(3)}, 4)
    k = list(copartition.KEY)
    both = t["a"].groupBy(*k).agg(F.sum("v").alias("v")).join(t["b"].groupBy(*k).agg(F.count("w").alias("n")).hint("merge"), k)
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and both.agg(F.sum("n")).first()[0] == 200
    assert t["c"].count() == 3


def test_dealt_by_less_than_the_key_meets_without_an_exchange(spark):
    """Tables dealt by the patient alone: their union folded by item, the join by
    item and the patient's row need no exchange; a join by item had one before."""
    rows_ = spark.range(60).select((F.col("id") % 7).cast("string").alias("patient_id"), (F.col("id") % 20).cast("string").alias("id_sejour"),
                                   F.col("id").cast("string").alias("item"), "id")
    t = copartition.tables_by_stay({"a": rows_, "b": rows_.where("id % 2 = 0")}, 4, by=["patient_id"])
    key = [*copartition.KEY, "item"]
    folded = t["a"].select(F.lit("u").alias("user"), *key, "id").unionByName(t["b"].select(F.lit("u").alias("user"), *key, "id")) \
        .groupBy("user", *key).agg(F.count("id").alias("n"))
    per_patient = t["a"].join(folded, key).groupBy("patient_id").agg(F.sum("n").alias("n"))
    with_joins = per_patient._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in with_joins
    want = {str(p): sum(1 + (i % 2 == 0) for i in range(60) if i % 7 == p) for p in range(7)}
    assert {r.patient_id: r.n for r in per_patient.collect()} == want


def test_passages_are_looked_for_without_the_orders(spark, tmp_path, monkeypatch):
    """Neither the words nor the texts of documents move for the patients' sake,
    and lines meet their orders once however many tables are made of them."""
    from recordfold.operators import textmatch
    from recordfold.plans import adapters
    when = "TIMESTAMP '2024-01-02 03:04:05'"
    for name, sql in {
            "orders": f"SELECT id AS o_orderkey, id + 50 AS o_custkey, {when} AS o_orderdate, '1-URGENT' AS o_orderpriority FROM range(4)",
            "lineitem": f"SELECT id % 4 AS l_orderkey, id AS l_linenumber, id AS l_partkey, id AS l_suppkey, 1.0D AS l_extendedprice, {when} AS l_shipdate,"
                        " 2.0D AS l_quantity, 0.5D AS l_discount, 'R' AS l_returnflag FROM range(8)",
            "customer": "SELECT id + 50 AS c_custkey, 1 AS c_nationkey FROM range(4)",
            "events": f"SELECT id AS event_id, {when} AS ts, id AS user_id, 'view' AS event_type, 1.0D AS value, '{{\"k\": 3}}' AS props FROM range(2)",
            "pages": "SELECT id AS page_id, 'u' AS url FROM range(3)",
            "conversations": "SELECT id AS conv_id, 1 AS turn, 'user' AS role, 'hi' AS text FROM range(3)",
            "documents": "SELECT * FROM VALUES (1L, 'the red fox ran', 'en', 's'), (1L, 'the red fox sat', 'en', 's'), (0L, 'the red fox', 'en', 's'),"
                         " (9L, 'the red fox', 'en', 's'), (2L, 'nothing', 'en', 's'), (NULL, 'the red fox', 'en', 's') AS t(doc_id, text, lang, source)",
            "benchmark": "SELECT * FROM VALUES (6L, 'the red fox'), (7L, ''), (8L, NULL) AS t(item_id, text)"}.items():
        spark.sql(sql).write.parquet(f"{tmp_path}/{name}.parquet")
    seen, find, joined = [], textmatch.find_passages, []
    monkeypatch.setattr(textmatch, "find_passages", lambda texts, *a: seen.append(texts) or find(texts, *a))
    t = adapters.domain_tables(spark, str(tmp_path), lambda df, label: joined.append(label) or df, place=("l_linenumber", "l_partkey", "l_shipdate"))
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "o_custkey" not in plan
    assert joined.count("lines") == 1 and t["biologie"].count() == 16
    # repeated documents are found each; those without a stay, a patient or an id are not
    assert sorted(map(tuple, t["suggestions"].select("patient_id", "id_sejour", "suggestion_id", "source_id", "highlight").collect())) \
        == [("51", "1", "1-6", "1", "the red fox")] * 2
