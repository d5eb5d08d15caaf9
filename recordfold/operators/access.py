"""Who may see what: accounts, assignments and visibility filters.

Visibility is expressed with semi/anti joins on (username, patient_id); an
admin's "every patient" is kept as a flag instead of being expanded into one
row per patient (that would be a cross join of admins and patients).
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordfold.functions.scalars import count_label, patient_label

ADMIN = "admin"


def dedupe_assignments(raw: DataFrame) -> DataFrame:
    """Repeated (username, patient_id) pairs collapse to their first position."""
    return raw.groupBy("username", "patient_id").agg(F.min("pos").alias("pos"))


def visible_patients(accounts: DataFrame, assignments: DataFrame, patients: DataFrame) -> DataFrame:
    """(username, patient_id, scope) rows.

    Reviewers: their assigned patients that exist in the patient table
    (assigned but unknown ids vanish), in assignment order ``pos``.
    Admins: one row with ``patient_id`` NULL and scope 'all'.
    """
    known = patients.select("patient_id").distinct()
    reviewers = accounts.where(F.col("role") != ADMIN).select("username")
    rows = (assignments.join(reviewers, "username", "left_semi")
            .join(known, "patient_id", "left_semi")
            .select("username", "patient_id", "pos", F.lit("assigned").alias("scope")))
    admins = accounts.where(F.col("role") == ADMIN).select(
        "username", F.lit(None).cast("string").alias("patient_id"),
        F.lit(None).cast("bigint").alias("pos"), F.lit("all").alias("scope"))
    return rows.unionByName(admins)


def patient_list(patients: DataFrame, visible: DataFrame) -> DataFrame:
    """Per reviewer, the known patients they can open, with the patient table's
    position (the list order).  Admins open the patient table itself."""
    assigned = visible.where(F.col("scope") == "assigned").select("username", "patient_id")
    rows = patients.select("patient_id", "pos").join(assigned, "patient_id")
    return rows.select("username", "patient_id", F.col("pos").alias("patient_pos"))


def patient_list_for(patients: DataFrame, visible: DataFrame, accounts: DataFrame, user: str) -> DataFrame:
    """One user's patients with their position: an admin gets the whole patient
    table, a reviewer the assigned ones, an unknown user none."""
    role = accounts.where(F.col("username") == user).select("role").first()
    if role is not None and role["role"] == ADMIN:
        return patients.select("patient_id", F.col("pos").alias("patient_pos"))
    mine = visible.where((F.col("username") == user) & (F.col("scope") == "assigned")).select("patient_id").distinct()
    return patients.join(mine, "patient_id", "left_semi").select("patient_id", F.col("pos").alias("patient_pos"))


def account_list(accounts: DataFrame) -> DataFrame:
    """Accounts ordered by name, each with its place in that order.

    The place is counted by sampled ranges of names: no single sorting task,
    and no range that all names beginning alike would fall into."""
    from recordfold.operators.positional import ranged_index
    return ranged_index(accounts.select("username", "role"), [], ["username"], name="place").orderBy("place")


def patient_count(accounts: DataFrame, assignments: DataFrame) -> DataFrame:
    """Assigned-patient count per account (zero stays zero) and its label."""
    n = assignments.groupBy("username").agg(F.count("patient_id").alias("n_patients"))
    j = accounts.join(n, "username", "left")
    n_col = F.coalesce(F.col("n_patients"), F.lit(0)).cast("bigint")
    return j.select("username", "role", n_col.alias("n_patients"),
                    count_label("role", n_col).alias("count_label"))


def account_stats(accounts: DataFrame) -> DataFrame:
    """Number of accounts and of admins, and the first admin by name."""
    is_admin = F.col("role") == ADMIN
    return accounts.agg(F.count("*").alias("n_accounts"),
                        F.count(F.when(is_admin, 1)).alias("n_admins"),
                        F.min(F.when(is_admin, F.col("username"))).alias("first_admin"))


def patient_filter(patients: DataFrame, query: str) -> DataFrame:
    """Case-insensitive substring match on the patient id; a blank query keeps all."""
    q = (query or "").strip().lower()
    rows = patients if not q else patients.where(F.lower("patient_id").contains(q))
    return rows.select("patient_id", patient_label("patient_id", "sexe", "age").alias("label"))


def annotation_accept(decisions: DataFrame, accounts: DataFrame, assignments: DataFrame,
                      patients: DataFrame) -> DataFrame:
    """Flag each incoming decision: accepted iff the patient is visible to its
    author (admin: any known patient; reviewer: an assigned id, known or not;
    an author without an account: never)."""
    known = patients.select("patient_id").distinct().withColumn("_known", F.lit(True))
    roles = accounts.select(F.col("username").alias("user"), "role")
    assigned = (assignments.select(F.col("username").alias("user"), "patient_id")
                .distinct().withColumn("_assigned", F.lit(True)))
    j = (decisions.join(roles, "user", "left")
         .join(assigned, ["user", "patient_id"], "left")
         .join(known, "patient_id", "left"))
    is_known = F.coalesce(F.col("_known"), F.lit(False))
    is_assigned = F.coalesce(F.col("_assigned"), F.lit(False))
    ok = F.when(F.col("role") == ADMIN, is_known).when(F.col("role").isNotNull(), is_assigned)
    return j.withColumn("accepted", F.coalesce(ok, F.lit(False))).drop("_known", "_assigned", "role")
