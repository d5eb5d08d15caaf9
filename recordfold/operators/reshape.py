"""Reshaping raw exports: value/unit split, dose expansion, drug lookup,
wide-to-long lab results and nested-to-flat.

All are narrow (per-row) transformations plus at most one equi-join, so they
run map-side; the explosions (days x hours, analytes, list items) are
generators, not shuffles.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordfold.functions.scalars import clamp, dose_hours, split_value_unit


def split_lab_values(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Add ``valeur`` (DOUBLE), ``unite`` and ``valeur_kind`` ('int', 'float' or
    'raw' when the text does not start with a number, e.g. 'négatif')."""
    value, unit, is_int = split_value_unit(raw)
    kind = F.when(is_int.isNull(), "raw").when(is_int, "int").otherwise("float")
    return df.withColumn("valeur", value).withColumn("unite", unit).withColumn("valeur_kind", kind)


def expand_doses(prescriptions: DataFrame, stays: DataFrame,
                 key: Sequence[str] = ("patient_id", "id_sejour")) -> DataFrame:
    """One row per dose actually given: every day of the prescription clamped
    to the stay, times every daily hour of its frequency.

    ``prescriptions``: key, ``debut`` DATE, ``fin`` DATE (NULL = until the
    stay ends), ``frequence`` text ('2x/jour'), plus any carried columns.
    ``stays``: key, ``entree``, ``sortie`` DATE.  A prescription outside the
    stay is clamped to its first/last day; one ending before it starts after
    clamping gives no dose.
    """
    key = list(key)
    j = prescriptions.join(stays.select(*key, "entree", "sortie"), key)
    start = clamp(F.col("debut"), F.col("entree"), F.col("sortie"))
    end = clamp(F.coalesce(F.col("fin"), F.col("sortie")), F.col("entree"), F.col("sortie"))
    j = j.withColumn("_start", start).withColumn("_end", end).where(F.col("_end") >= F.col("_start"))
    # daily hours as minutes after midnight, computed once per prescription
    minutes = F.transform(dose_hours("frequence"), lambda h: F.substring(h, 1, 2).cast("int") * 60
                          + F.substring(h, 4, 2).cast("int"))
    j = j.withColumn("_mins", minutes)
    days = j.withColumn("_day", F.explode(F.sequence("_start", "_end")))
    doses = days.withColumn("_min", F.explode("_mins"))
    ts = F.col("_day").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("_min"))
    return doses.withColumn("date_administration", ts) \
        .drop("_start", "_end", "_day", "_mins", "_min", "entree", "sortie")


def drug_lookup(doses: DataFrame, catalogue: DataFrame, name: str = "nom") -> DataFrame:
    """Attach (atc, ucd) by drug name; ``matched`` is false for unknown names
    (the reject set, instead of failing the whole job)."""
    cat = catalogue.select(F.col(name), "atc", "ucd", F.lit(True).alias("matched"))
    out = doses.join(cat, name, "left")
    return out.withColumn("matched", F.coalesce(F.col("matched"), F.lit(False)))


def unpivot_labs(wide: DataFrame, ids: Sequence[str], analytes: Sequence[str],
                 code: str = "code", value: str = "valeur") -> DataFrame:
    """Wide lab rows (one column per analyte) -> long (one row per measure);
    missing measures are dropped."""
    long = wide.unpivot(list(ids), list(analytes), code, value)
    return long.where(F.col(value).isNotNull())


def explode_children(df: DataFrame, keys: Sequence[str], array_col: str,
                     pos: str = "pos", outer: bool = False) -> DataFrame:
    """Nested list column -> one row per element with its position, the
    element's struct fields spread into columns."""
    gen = F.posexplode_outer if outer else F.posexplode
    x = df.select(*keys, gen(array_col).alias(pos, "_child"))
    child_t = x.schema["_child"].dataType
    if hasattr(child_t, "fieldNames"):
        return x.select(*keys, pos, "_child.*")
    return x.withColumnRenamed("_child", array_col)
