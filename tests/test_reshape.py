import datetime as dt

from pyspark.sql import functions as F

from recordfold.operators import reshape
from helpers import rows

D = dt.date


def _presc(spark, data):
    return spark.createDataFrame(data, "id_sejour string, nom string, debut date, fin date, frequence string")


def test_dose_expansion_cases(spark):
    stays = spark.createDataFrame([("S", D(2024, 1, 1), D(2024, 1, 20))],
                                  "id_sejour string, entree date, sortie date")
    p = _presc(spark, [
        ("S", "A", D(2024, 1, 2), D(2024, 1, 14), "2x/jour"),    # 13 days x 2
        ("S", "B", D(2024, 1, 10), D(2024, 1, 5), "1x/jour"),    # ends before it starts
        ("S", "C", D(2024, 1, 18), None, "3x/jour"),             # no end: until the stay ends
        ("S", "E", D(2024, 2, 1), D(2024, 2, 3), "1x/jour"),     # starts after the stay: last day
        ("S", "F", D(2024, 1, 20), D(2024, 1, 20), "si besoin"),  # one dose at 08:00
    ])
    out = reshape.expand_doses(p, stays, key=["id_sejour"])
    counts = dict(rows(out.groupBy("nom").count()))
    assert counts == {"A": 26, "C": 9, "E": 1, "F": 1}
    f = out.where("nom = 'F'").first().date_administration
    assert f == dt.datetime(2024, 1, 20, 8, 0)
    # every dose lies inside its stay
    inside = out.where((F.to_date("date_administration") < F.lit(D(2024, 1, 1))) |
                       (F.to_date("date_administration") > F.lit(D(2024, 1, 20)))).count()
    assert inside == 0


def test_lab_split_and_unpivot(spark):
    df = spark.createDataFrame([("5400 ng/L",), ("3.2 mmol/L",), ("négatif",)], "raw string")
    got = rows(reshape.split_lab_values(df), "raw", "valeur", "unite", "valeur_kind")
    assert got == sorted([("5400 ng/L", 5400.0, "ng/L", "int"), ("3.2 mmol/L", 3.2, "mmol/L", "float"),
                          ("négatif", None, "", "raw")], key=lambda t: tuple(str(x) for x in t))
    wide = spark.createDataFrame([("S", "01/02", 1.0, None), ("S", "02/02", 2.0, 3.0)],
                                 "id_sejour string, date string, k double, hb double")
    long = reshape.unpivot_labs(wide, ["id_sejour", "date"], ["k", "hb"])
    assert long.count() == 3  # the missing analyte is skipped


def test_drug_lookup_flags_unknown(spark):
    doses = spark.createDataFrame([("Aspirine",), ("Inconnu",)], "nom string")
    cat = spark.createDataFrame([("Aspirine", "B01AC06", "9200004")], "nom string, atc string, ucd string")
    got = rows(reshape.drug_lookup(doses, cat), "nom", "atc", "matched")
    assert got == [("Aspirine", "B01AC06", True), ("Inconnu", None, False)]


def test_explode_children(spark):
    df = spark.createDataFrame([("P1", [("S1", 1), ("S2", 2)]), ("P2", [])],
                               "patient_id string, stays array<struct<id_sejour:string, ordre:int>>")
    flat = reshape.explode_children(df, ["patient_id"], "stays", pos="i")
    assert rows(flat, "patient_id", "i", "id_sejour", "ordre") == [("P1", 0, "S1", 1), ("P1", 1, "S2", 2)]
    outer = reshape.explode_children(df, ["patient_id"], "stays", pos="i", outer=True)
    assert outer.count() == 3
