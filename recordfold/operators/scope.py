"""Scope filters: rows of a patient (optionally of one stay), unattached rows."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rows_for(table: DataFrame, requests: DataFrame) -> DataFrame:
    """Batch form of "rows of patient p (and stay s if given)".

    ``requests`` has ``patient_id`` and a nullable ``id_sejour`` plus any
    columns to carry (e.g. the requesting user).  A NULL stay asks for every
    row of the patient.  Two equi-joins (patient; patient+stay) instead of one
    join with an OR condition, so both stay hash/sort-merge joins.
    """
    carry = [c for c in requests.columns if c not in ("patient_id", "id_sejour")]
    whole = (requests.where(F.col("id_sejour").isNull()).select(*carry, "patient_id")
             .join(table, "patient_id")
             .withColumn("scope", F.lit("patient")))
    one = (requests.where(F.col("id_sejour").isNotNull()).select(*carry, "patient_id", "id_sejour")
           .join(table, ["patient_id", "id_sejour"])
           .withColumn("scope", F.lit("stay")))
    return whole.unionByName(one)


def outside_stays(table: DataFrame) -> DataFrame:
    """Rows tied to a patient but to no stay (letters, forms outside any stay)."""
    return table.where(F.col("patient_id").isNotNull() & F.col("id_sejour").isNull())
