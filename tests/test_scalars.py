from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordfold.functions import scalars as fs


def test_id_string(spark):
    df = spark.createDataFrame([(42.0,), (12.5,), (None,), (float("nan"),)], "v double")
    got = [r[0] for r in df.select(fs.id_string("v", T.DoubleType())).collect()]
    assert got == ["42", "12.5", None, None]
    s = spark.createDataFrame([("042",), (None,)], "v string")
    assert [r[0] for r in s.select(fs.id_string("v", T.StringType())).collect()] == ["042", None]
    i = spark.createDataFrame([(42,)], "v bigint")
    assert i.select(fs.id_string("v", T.LongType())).first()[0] == "42"


def test_safe_int(spark):
    df = spark.createDataFrame([(None,), ("12",), ("12.5",), ("72 kg",), (" 12 ",), ("-3",), ("\t7\n",)],
                               "v string")
    got = [r[0] for r in df.select(fs.safe_int("v", T.StringType(), 0)).collect()]
    assert got == [0, 12, 0, 0, 12, -3, 7]
    d = spark.createDataFrame([(12.9,), (-12.9,), (None,), (float("nan"),)], "v double")
    assert [r[0] for r in d.select(fs.safe_int("v", T.DoubleType(), 5)).collect()] == [12, -12, 5, 5]
    n = spark.createDataFrame([(None,)], "v string")
    assert n.select(fs.safe_int("v", T.StringType(), None)).first()[0] is None


def test_safe_bool(spark):
    df = spark.createDataFrame([(None,), (" Oui ",), ("vrai",), ("non",), ("YES",), ("1",)], "v string")
    got = [r[0] for r in df.select(fs.safe_bool("v", T.StringType())).collect()]
    assert got == [False, True, True, False, True, True]
    n = spark.createDataFrame([(1,), (0,), (None,)], "v int")
    assert [r[0] for r in n.select(fs.safe_bool("v", T.IntegerType())).collect()] == [True, False, False]


def test_split_value_unit(spark):
    df = spark.createDataFrame([("5400 ng/L",), ("3.2 mmol/L",), ("négatif",), ("140",)], "raw string")
    v, u, i = fs.split_value_unit("raw")
    got = df.select(v, u, i).collect()
    assert [tuple(r) for r in got] == [(5400.0, "ng/L", True), (3.2, "mmol/L", False),
                                       (None, "", None), (140.0, "", True)]


def test_dose_hours(spark):
    df = spark.createDataFrame([("1x/jour",), ("2x/jour",), ("4x/jour",), ("7x/jour",), ("si besoin",),
                                (None,)], "f string")
    got = [r[0] for r in df.select(fs.dose_hours("f")).collect()]
    assert got == [["08:00"], ["08:00", "20:00"], ["08:00", "12:00", "16:00", "20:00"], ["08:00"],
                   ["08:00"], ["08:00"]]


def test_clamp_and_labels(spark):
    df = spark.createDataFrame([(5, 1, 3), (0, 1, 3), (2, 1, 3)], "d int, lo int, hi int")
    assert [r[0] for r in df.select(fs.clamp("d", "lo", "hi")).collect()] == [3, 1, 2]
    p = spark.createDataFrame([("P1", "F", 67, "admin", 3)], "p string, s string, a int, r string, n int")
    r = p.select(fs.patient_label("p", "s", "a"), fs.count_label("r", "n")).first()
    assert tuple(r) == ("P1 (F, 67)", "all")


def test_unicode_regex_folds_accents(spark):
    df = spark.createDataFrame([("INSUFFISANCE RÉNALE AIGUË",)], "t string")
    pat = fs.unicode_regex(r"insuffisance\s+r[ée]nale\s+(aigu[eë]|chronique)", "i")
    r = df.select(F.col("t").rlike(pat), F.lower(F.regexp_extract("t", pat, 1))).first()
    assert tuple(r) == (True, "aiguë")


def test_resolve_day_month(spark):
    import datetime as dt
    df = spark.createDataFrame([("29/12", dt.date(2024, 12, 28)), ("03/01", dt.date(2024, 12, 28)),
                                ("15/06", dt.date(2024, 6, 1)), ("31/02", dt.date(2024, 1, 1)),
                                (None, dt.date(2024, 1, 1))], "dm string, entree date")
    got = [r[0] for r in df.select(fs.resolve_day_month("dm", "entree")).collect()]
    assert got == [dt.date(2024, 12, 29), dt.date(2025, 1, 3), dt.date(2024, 6, 15), None, None]
