import os
import tempfile

from recordfold.operators import access, scope
from recordfold.schemas import TABLES
from recordfold.sources import ingest
from helpers import rows


def _acc(spark):
    accounts = spark.createDataFrame([("root", "admin"), ("ana", "user"), ("bob", "user"), ("cy", "user")],
                                     "username string, role string")
    raw = spark.createDataFrame([("ana", "P1", 3), ("ana", "P2", 1), ("ana", "P1", 5), ("bob", "P9", 2)],
                                "username string, patient_id string, pos int")
    patients = spark.createDataFrame([("P1", "F", 70), ("P2", "M", 55), ("P3", "F", 40)],
                                     "patient_id string, sexe string, age int")
    return accounts, access.dedupe_assignments(raw), patients


def test_visibility_and_counts(spark):
    accounts, assign, patients = _acc(spark)
    assert rows(assign) == [("ana", "P1", 3), ("ana", "P2", 1), ("bob", "P9", 2)]
    vis = rows(access.visible_patients(accounts, assign, patients), "username", "patient_id", "scope")
    # the unknown P9 vanishes; the admin sees everything (one flag row)
    assert vis == [("ana", "P1", "assigned"), ("ana", "P2", "assigned"), ("root", None, "all")]
    cnt = rows(access.patient_count(accounts, assign), "username", "n_patients", "count_label")
    assert cnt == [("ana", 2, "2"), ("bob", 1, "1"), ("cy", 0, "0"), ("root", 0, "all")]
    st = access.account_stats(accounts).first()
    assert (st.n_accounts, st.n_admins, st.first_admin) == (4, 1, "root")
    assert rows(access.patient_filter(patients, "  p1 "), "label") == [("P1 (F, 70)",)]
    assert access.patient_filter(patients, "   ").count() == 3


def test_annotation_accept(spark):
    accounts, assign, patients = _acc(spark)
    dec = spark.createDataFrame([("ana", "P1"), ("ana", "P3"), ("bob", "P9"), ("root", "P3"),
                                 ("root", "P7"), ("zed", "P1")], "user string, patient_id string")
    got = rows(access.annotation_accept(dec, accounts, assign, patients), "user", "patient_id", "accepted")
    assert got == [("ana", "P1", True), ("ana", "P3", False), ("bob", "P9", True), ("root", "P3", True),
                   ("root", "P7", False), ("zed", "P1", False)]


def test_scope_filters(spark):
    docs = spark.createDataFrame([("P1", "S1", "d1"), ("P1", "S2", "d2"), ("P1", None, "d0"), ("P2", "S3", "d3")],
                                 "patient_id string, id_sejour string, doc_id string")
    req = spark.createDataFrame([("ana", "P1", None), ("bob", "P1", "S2")],
                                "user string, patient_id string, id_sejour string")
    got = rows(scope.rows_for(docs, req), "user", "doc_id", "scope")
    assert got == [("ana", "d0", "patient"), ("ana", "d1", "patient"), ("ana", "d2", "patient"),
                   ("bob", "d2", "stay")]
    assert rows(scope.outside_stays(docs), "doc_id") == [("d0",)]


def test_tolerant_load(spark):
    base = tempfile.mkdtemp(prefix="load-")
    # biologie written with ids as doubles, a missing column and rows without stay
    spark.createDataFrame([(42.0, 7.0, "01/02", "k", 3.1), (42.0, None, "02/02", "k", 3.3),
                           (None, 8.0, "03/02", "k", 3.0)],
                          "patient_id double, id_sejour double, date string, code string, valeur double") \
        .write.parquet(os.path.join(base, "biologie.parquet"))
    # documents as CSV with the columns in another order and one missing
    with open(os.path.join(base, "documents.csv"), "w") as f:
        f.write("doc_id,patient_id,full_text,id_sejour\n12,42,texte,\n13,43,autre,9\n")
    bio = ingest.load_table(spark, base, "biologie")
    assert bio.columns == TABLES["biologie"].names
    assert rows(bio, "patient_id", "id_sejour", "valeur", "unite") == [("42", "7", 3.1, None)]
    docs = ingest.load_table(spark, base, "documents", fmt="csv")
    assert rows(docs, "patient_id", "id_sejour", "doc_id", "full_text") == [
        ("42", None, "12", "texte"), ("43", "9", "13", "autre")]
    missing = ingest.load_table(spark, base, "observations")
    assert missing.count() == 0 and missing.columns == TABLES["observations"].names


def test_decision_log_roundtrip_and_tables(spark):
    import datetime as dt
    from recordfold.schemas import ANNOTATIONS
    from recordfold.sources import decisions
    root = tempfile.mkdtemp(prefix="log-")
    t0 = dt.datetime(2025, 1, 1, 12, 0, 0, 123456)
    rows_in = [(t0, "ana", "P1", "S1", "suggestion", "s1", "validé", None, None, None, "a, \"b\"", 1),
               (t0, "a.b", "P1", "S1", "suggestion", "s2", "rejeté", None, None, None, None, 2)]
    df = spark.createDataFrame(rows_in, ANNOTATIONS)
    decisions.append_decisions(df, root, batch_id=1)
    decisions.append_decisions(df, root, batch_id=1)   # a replayed batch replaces itself
    back = decisions.read_all_decisions(spark, root)
    assert sorted(tuple(r) for r in back.collect()) == sorted(rows_in)
    assert [r.item_id for r in decisions.read_user_decisions(spark, root, "a.b").collect()] == ["s2"]
    assert decisions.read_all_decisions(spark, root + "/absent").count() == 0
    counts = ingest.write_tables({"annotations": df}, tempfile.mkdtemp(prefix="tables-"))
    assert counts == {"annotations": 2}
