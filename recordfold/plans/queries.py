"""Registered queries: one per operator of the inventory, run on the driver's
tables through the adapters, each with its DuckDB oracle.

Tested outputs are flat (text, integers, booleans, exact doubles) so that the
value hash cannot differ on nested or floating types.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordfold.operators import overlay
from recordfold.plans import adapters as ad
from recordfold.plans.oracle import with_ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def ts_text(c) -> F.Column:
    return F.date_format(F.col(c) if isinstance(c, str) else c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


TS_SQL = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"


# ------------------------------------------------------------------ overlay

def _latest(spark, sf_dir) -> DataFrame:
    return overlay.latest_actions(ad.decision_log(spark, sf_dir))


@register("latest_actions", with_ctes(["latest"], f"""
SELECT "user", patient_id, id_sejour, item_id, {TS_SQL.format('"timestamp"')} AS last_ts,
       item_type, action, code, libelle, type_code, commentaire
FROM latest"""))
def q_latest_actions(spark, sf_dir):
    la = _latest(spark, sf_dir)
    return la.select("user", "patient_id", "id_sejour", "item_id", ts_text("timestamp").alias("last_ts"),
                     "item_type", "action", "code", "libelle", "type_code", "commentaire")


def _worklist(base: DataFrame, assign: DataFrame) -> DataFrame:
    """Reviewer x item rows: every item of every patient assigned to a reviewer."""
    return assign.select(F.col("username").alias("user"), "patient_id").join(base, "patient_id")


@register("suggestion_status", with_ctes(["latest", "suggestions", "assign"], """
SELECT a.username AS "user", s.patient_id, s.id_sejour, s.suggestion_id,
       CASE WHEN l.action = 'modifié' THEN l.code ELSE s.code END AS code,
       CASE WHEN l.action = 'modifié' THEN l.libelle ELSE s.libelle END AS libelle,
       CASE WHEN regexp_matches(s.confiance, '^\\s*[+-]?[0-9]+\\s*$') THEN CAST(trim(s.confiance) AS BIGINT)
            ELSE 0 END AS confiance,
       CASE WHEN l.item_id IS NULL THEN 'pending' WHEN l.action = 'annulé' THEN 'pending'
            ELSE l.action END AS status,
       coalesce(l.item_id IS NOT NULL AND l.action = 'modifié', false) AS amended
FROM assign a JOIN suggestions s ON a.patient_id = s.patient_id
LEFT JOIN latest l ON l."user" = a.username AND l.patient_id = s.patient_id
     AND l.id_sejour = s.id_sejour AND l.item_id = s.suggestion_id"""))
def q_suggestion_status(spark, sf_dir):
    out = overlay.suggestion_status(worklist_items(spark, sf_dir), _latest(spark, sf_dir))
    return out.select("user", "patient_id", "id_sejour", "suggestion_id", "code", "libelle",
                      "confiance", "status", "amended")


def worklist_items(spark, sf_dir) -> DataFrame:
    """Every suggestion of every patient assigned to a reviewer."""
    return _worklist(ad.suggestions(spark, sf_dir), _dedupe_assignments(ad.raw_assignments(spark, sf_dir)))


def _dedupe_assignments(raw: DataFrame) -> DataFrame:
    from recordfold.operators.access import dedupe_assignments
    return dedupe_assignments(raw)


@register("codes_overlay", with_ctes(["latest", "codes", "assign"], """
SELECT a.username AS "user", c.patient_id, c.id_sejour, c.code_id,
       CASE WHEN l.action = 'modifié' THEN l.code ELSE c.code END AS code,
       CASE WHEN l.action = 'modifié' THEN l.libelle ELSE c.libelle END AS libelle,
       CASE WHEN l.action = 'supprimé' THEN true WHEN l.action = 'restauré' THEN false
            ELSE coalesce(lower(trim(c.removed)) IN ('true', '1', 'vrai', 'oui', 'yes'), false) END AS removed
FROM assign a JOIN codes c ON a.patient_id = c.patient_id
LEFT JOIN latest l ON l."user" = a.username AND l.patient_id = c.patient_id
     AND l.id_sejour = c.id_sejour AND l.item_id = c.code_id"""))
def q_codes_overlay(spark, sf_dir):
    assign = _dedupe_assignments(ad.raw_assignments(spark, sf_dir))
    base = _worklist(ad.clinician_codes(spark, sf_dir), assign)
    out = overlay.codes_overlay(base, _latest(spark, sf_dir))
    return out.select("user", "patient_id", "id_sejour", "code_id", "code", "libelle", "removed")


MANUAL_SQL = """
SELECT "user", patient_id, id_sejour, item_id AS code_id, code, type_code AS type, libelle,
       strftime("timestamp", '%Y-%m-%d') AS date, false AS removed, true AS manuel
FROM latest WHERE item_type = 'manuel' AND action IS DISTINCT FROM 'supprimé'"""


@register("manual_codes", with_ctes(["latest"], MANUAL_SQL))
def q_manual_codes(spark, sf_dir):
    return overlay.manual_codes(_latest(spark, sf_dir))


@register("codes_with_manual", with_ctes(["latest", "codes", "assign"], f"""
SELECT a.username AS "user", c.patient_id, c.id_sejour, c.code_id,
       CASE WHEN l.action = 'modifié' THEN l.code ELSE c.code END AS code,
       CASE WHEN l.action = 'modifié' THEN l.libelle ELSE c.libelle END AS libelle,
       CASE WHEN l.action = 'supprimé' THEN true WHEN l.action = 'restauré' THEN false
            ELSE coalesce(lower(trim(c.removed)) IN ('true', '1', 'vrai', 'oui', 'yes'), false) END AS removed,
       false AS manuel
FROM assign a JOIN codes c ON a.patient_id = c.patient_id
LEFT JOIN latest l ON l."user" = a.username AND l.patient_id = c.patient_id
     AND l.id_sejour = c.id_sejour AND l.item_id = c.code_id
UNION ALL
SELECT "user", patient_id, id_sejour, code_id, code, libelle, removed, manuel FROM ({MANUAL_SQL}) m"""))
def q_codes_with_manual(spark, sf_dir):
    latest = _latest(spark, sf_dir)
    assign = _dedupe_assignments(ad.raw_assignments(spark, sf_dir))
    base = _worklist(ad.clinician_codes(spark, sf_dir), assign)
    codes = overlay.codes_overlay(base, latest)
    manual = overlay.manual_codes(latest)
    cols = ["user", "patient_id", "id_sejour", "code_id", "code", "libelle", "removed", "manuel"]
    return overlay.codes_with_manual(codes.select(*cols), manual.select(*cols))
