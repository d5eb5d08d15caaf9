"""Gaps, damage and odd text in the inputs: nothing is lost or misread."""
import datetime as dt

from pyspark.sql import functions as F

from recordfold.functions import scalars as fs
from recordfold.operators import access, rules
from recordfold.operators.positional import positional_index
from recordfold.schemas import RULE_PARAMS, RULES, TABLES
from recordfold.sources import decisions, ingest
from helpers import rows


def test_null_bucket_keeps_its_rows(spark):
    df = spark.createDataFrame([("s", None, 1), ("s", None, 2), ("s", 5, 3), ("s", 6, 4), (None, None, 5)], "g string, d int, o int")
    got = positional_index(df, ["g"], [F.col("d").asc_nulls_first(), "o"], bucket=F.col("d"))
    assert rows(got, "o", "idx") == [(1, 0), (2, 1), (3, 2), (4, 3), (5, 0)]


def test_day_month_in_a_leap_year(spark):
    df = spark.createDataFrame([("29/02", dt.date(2023, 12, 5)), ("29/02", dt.date(2024, 1, 5)), ("31/12", dt.date(2023, 12, 5)),
                                ("03/01", dt.date(2023, 12, 5)), ("29/02", dt.date(2022, 3, 1)), ("x", dt.date(2022, 3, 1)),
                                (None, dt.date(2022, 3, 1))], "dm string, entree date")
    got = [r.d for r in df.select(fs.resolve_day_month("dm", "entree").alias("d")).collect()]
    assert got == [dt.date(2024, 2, 29), dt.date(2024, 2, 29), dt.date(2023, 12, 31), dt.date(2024, 1, 3), None, None, None]


def test_damaged_parquet_is_an_empty_table(spark, tmp_path):
    (tmp_path / "patients.parquet").write_bytes(b"PAR1 this is not a footer PAR1")
    assert ingest.load_table(spark, str(tmp_path), "patients").collect() == []
    assert ingest.load_table(spark, str(tmp_path), "patients", position=True).columns[-1] == "pos"


def test_numbers_become_integer_text(spark):
    df = spark.createDataFrame([(85.0, 72.0, 1.0), (None, None, None), (85.9, float("nan"), 0.0)], "confiance double, fc double, removed double")
    got = ingest.conform(df, TABLES["suggestions"]).select("confiance").collect()
    assert [r.confiance for r in got] == ["85", None, "85"]
    assert [r.fc for r in ingest.conform(df, TABLES["constantes"]).collect()] == ["72", None, None]
    assert [r.removed for r in ingest.conform(df, TABLES["codes_valides"]).collect()] == ["true", None, "false"]


def test_patches_fold_and_conditions_clear(spark):
    r = spark.createDataFrame([(f"R{i}", "t", None, None, "c", None, None, None) for i in range(3)], RULES)
    p = spark.createDataFrame([("R1", 0, "a", None, None), ("R1", 1, None, "l", None), ("R1", 2, "b", None, None), ("R9", 0, "x", None, None)],
                              "id string, pos int, titre string, logique string, description string")
    updated, unknown = rules.patch(r, p)
    assert rows(updated, "id", "titre", "logique", "status") == [
        ("R0", "t", None, "unchanged"), ("R1", "b", "l", "patched"), ("R2", "t", None, "unchanged")]
    assert unknown.count() == 1
    old = spark.createDataFrame([(f"R{i}", 0, "a.b", "lt", "1", None) for i in range(3)], RULE_PARAMS)
    new = spark.createDataFrame([("R1", 0, "a.b", "lt", "2", None, 1), ("R1", 0, "a.b", "lt", "3", None, 2)],
                                "rule_id string, ordre int, champ string, operateur string, valeur string, flags string, edit int")
    got = rules.replace_conditions(old, new, r, cleared=spark.createDataFrame([("R2",)], "rule_id string"))
    assert rows(got, "rule_id", "valeur", "origin") == [("R0", "1", "kept"), ("R1", "3", "new")]


def test_account_order_and_admin_list(spark):
    acc = spark.createDataFrame([("bob", "user"), ("ann", "admin"), ("al", "user"), ("zoe", "user")], "username string, role string")
    assert [(r.username, r.place) for r in access.account_list(acc).collect()] == [("al", 0), ("ann", 1), ("bob", 2), ("zoe", 3)]
    pats = spark.createDataFrame([("p1", 0), ("p2", 1)], "patient_id string, pos int")
    seen = access.visible_patients(acc, spark.createDataFrame([("bob", "p2", 0)], "username string, patient_id string, pos int"), pats)
    lists = {u: rows(access.patient_list_for(pats, seen, acc, u), "patient_id") for u in ("ann", "bob", "al", "nobody")}
    assert lists == {"ann": [("p1",), ("p2",)], "bob": [("p2",)], "al": [], "nobody": []}


def test_reviewer_files_with_offsets_and_no_seq(spark, tmp_path):
    head = "timestamp,user,patient_id,id_sejour,item_type,item_id,action,code,libelle,type_code,commentaire\n"
    (tmp_path / "ana.csv").write_text(head + '2025-03-01T10:00:00+02:00,ana,P,S,suggestion,1,validé,,,,"a ""quoted"", text\nsecond line"\n'
                                      + "2025-03-01T10:00:00+02:00,ana,P,S,suggestion,1,rejeté,C,,,\n", encoding="utf-8")
    (tmp_path / "bob.csv").write_text(head + "not a time,bob,P,S,suggestion,1,annulé,,,,\n", encoding="utf-8")
    log = decisions.read_reviewer_files(spark, str(tmp_path))
    ana = log.where("user = 'ana'").orderBy("seq").collect()
    assert [r.timestamp for r in ana] == [dt.datetime(2025, 3, 1, 8)] * 2
    assert [(r.action, r.commentaire) for r in ana] == [("validé", 'a "quoted", text\nsecond line'), ("rejeté", None)]
    bob = log.where("user = 'bob'").first()
    assert bob.timestamp is None and bob.action == "annulé"


def test_reviewer_files_written_by_tasks_come_back_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(decisions, "HELD_BYTES", 50)
    users = ["ana", "_hidden", ".dot", "a/b c%", "é" * 90, "", None]
    notes = [' blank ', 'a "quoted", text\nsecond line', "back\\slash", None, "#x", ","]
    at = dt.datetime(2025, 3, 1, 8, 0, 0, 5)
    data = [(at, i, u, "P", "S", "suggestion", "1", "validé", None, None, None, n) for u in users for i, n in enumerate(notes)]
    log = spark.createDataFrame(data[::-1],
                                "timestamp timestamp_ntz, seq bigint, user string, patient_id string, id_sejour string, item_type string, "
                                "item_id string, action string, code string, libelle string, type_code string, commentaire string")
    decisions.write_reviewer_files(log, f"{tmp_path}/log")
    files = sorted(p for p in (tmp_path / "log").rglob("*") if p.is_file())
    assert len(files) == 6 and all(p.parent.parent == tmp_path / "log" for p in files)  # '' and null share one
    back = decisions.read_reviewer_files(spark, f"{tmp_path}/log/*").orderBy("seq").collect()
    assert {r.timestamp for r in back} == {at}
    for u in users[:5]:
        assert [r.commentaire for r in back if r.user == u] == notes
    assert sorted(str(r.commentaire) for r in back if r.user is None) == sorted(2 * list(map(str, notes)))
