"""Registered queries: access, scope, ingest and scalar operators."""
from __future__ import annotations

from pyspark.sql import functions as F

from recordfold.functions import scalars as fs
from recordfold.operators import access, scope
from recordfold.plans import adapters as ad
from recordfold.plans.oracle import with_ctes
from recordfold.plans.queries import ORACLE, TS_SQL, register, ts_text
from recordfold.schemas import ANNOTATIONS, TABLES
from recordfold.session import materialised, scratch_path
from recordfold.sources import decisions, ingest, rule_store


def _assign(spark, sf_dir):
    return access.dedupe_assignments(ad.raw_assignments(spark, sf_dir))


@register("assign_dedupe", with_ctes(["assign"], "SELECT username, patient_id, pos FROM assign"))
def q_assign_dedupe(spark, sf_dir):
    return _assign(spark, sf_dir)


@register("visible_patients", with_ctes(["assign", "accounts", "patients"], """
SELECT a.username, a.patient_id, CAST(a.pos AS VARCHAR) AS pos, 'assigned' AS scope
FROM assign a JOIN accounts c ON a.username = c.username AND c.role <> 'admin'
WHERE a.patient_id IN (SELECT patient_id FROM patients)
UNION ALL
SELECT username, NULL AS patient_id, NULL AS pos, 'all' AS scope FROM accounts WHERE role = 'admin'"""))
def q_visible_patients(spark, sf_dir):
    out = access.visible_patients(ad.accounts(spark, sf_dir), _assign(spark, sf_dir),
                                  ad.patients(spark, sf_dir))
    # nullable integers are compared as text (NULL for the admins' row)
    return out.withColumn("pos", F.col("pos").cast("string"))


@register("patient_count", with_ctes(["assign", "accounts"], """
SELECT c.username, c.role, coalesce(n.n, 0) AS n_patients,
       CASE WHEN c.role = 'admin' THEN 'all' ELSE CAST(coalesce(n.n, 0) AS VARCHAR) END AS count_label
FROM accounts c LEFT JOIN (SELECT username, count(patient_id) AS n FROM assign GROUP BY username) n
  ON n.username = c.username"""))
def q_patient_count(spark, sf_dir):
    return access.patient_count(ad.accounts(spark, sf_dir), _assign(spark, sf_dir))


@register("account_stats", with_ctes(["accounts"], """
SELECT count(*) AS n_accounts, count(*) FILTER (WHERE role = 'admin') AS n_admins,
       min(username) FILTER (WHERE role = 'admin') AS first_admin FROM accounts"""))
def q_account_stats(spark, sf_dir):
    return access.account_stats(ad.accounts(spark, sf_dir))


PATIENT_QUERY = " 12 "


@register("patient_filter", with_ctes(["patients"], """
SELECT patient_id, patient_id || ' (' || sexe || ', ' || CAST(age AS VARCHAR) || ')' AS label
FROM patients WHERE contains(lower(patient_id), '12')"""))
def q_patient_filter(spark, sf_dir):
    return access.patient_filter(ad.patients(spark, sf_dir), PATIENT_QUERY)


@register("annotation_accept", with_ctes(["log", "accounts", "assign", "patients"], """
SELECT l.seq, l."user", l.patient_id,
       coalesce(CASE WHEN c.role = 'admin' THEN p.patient_id IS NOT NULL
                     WHEN c.role IS NOT NULL THEN a.username IS NOT NULL END, false) AS accepted
FROM log l LEFT JOIN accounts c ON c.username = l."user"
LEFT JOIN (SELECT DISTINCT username, patient_id FROM assign) a
  ON a.username = l."user" AND a.patient_id = l.patient_id
LEFT JOIN (SELECT DISTINCT patient_id FROM patients) p ON p.patient_id = l.patient_id"""))
def q_annotation_accept(spark, sf_dir):
    log = ad.decision_log(spark, sf_dir).select("seq", "user", "patient_id")
    out = access.annotation_accept(log, ad.accounts(spark, sf_dir), _assign(spark, sf_dir),
                                   ad.patients(spark, sf_dir))
    return out.select("seq", "user", "patient_id", "accepted")


# -------------------------------------------------------------------- scope

@register("table_for", with_ctes(["assign", "log", "docs"], """
SELECT r.username AS "user", d.patient_id, d.id_sejour, d.doc_id, 'patient' AS scope
FROM assign r JOIN docs d ON d.patient_id = r.patient_id
UNION ALL
SELECT r."user", d.patient_id, d.id_sejour, d.doc_id, 'stay' AS scope
FROM (SELECT DISTINCT "user", patient_id, id_sejour FROM log WHERE item_type = 'code_valide') r
JOIN docs d ON d.patient_id = r.patient_id AND d.id_sejour = r.id_sejour"""))
def q_table_for(spark, sf_dir):
    whole = _assign(spark, sf_dir).select(F.col("username").alias("user"), "patient_id",
                                          F.lit(None).cast("string").alias("id_sejour"))
    one = (ad.decision_log(spark, sf_dir).where(F.col("item_type") == "code_valide")
           .select("user", "patient_id", "id_sejour").distinct())
    docs = ad.documents(spark, sf_dir).select("patient_id", "id_sejour", "doc_id")
    return scope.rows_for(docs, whole.unionByName(one)) \
        .select("user", "patient_id", "id_sejour", "doc_id", "scope")


@register("hors_sejour", with_ctes(["docs"], """
SELECT patient_id, doc_id, titre FROM docs WHERE patient_id IS NOT NULL AND id_sejour IS NULL"""))
def q_hors_sejour(spark, sf_dir):
    return scope.outside_stays(ad.documents(spark, sf_dir)).select("patient_id", "doc_id", "titre")


# ------------------------------------------------------------------- ingest

def _id_sql(x: str) -> str:
    return (f"CASE WHEN {x} IS NULL OR isnan({x}) THEN NULL WHEN {x} = floor({x}) "
            f"THEN CAST(CAST({x} AS DECIMAL(38,0)) AS VARCHAR) ELSE CAST({x} AS VARCHAR) END")


@register("load_filter", f"""
SELECT 'documents' AS tbl, patient_id, id_sejour, item_id FROM (
  SELECT {_id_sql('pd')} AS patient_id, {_id_sql('sd')} AS id_sejour, {_id_sql('dd')} AS item_id FROM (
    SELECT CASE WHEN d.doc_id % 7 = 0 THEN NULL ELSE CAST(o.o_custkey AS DOUBLE) END AS pd,
           CASE WHEN d.doc_id % 5 = 0 THEN NULL ELSE CAST(d.doc_id AS DOUBLE) END AS sd,
           CAST(d.doc_id AS DOUBLE) AS dd
    FROM documents d LEFT JOIN orders o ON d.doc_id = o.o_orderkey) x) y
WHERE patient_id IS NOT NULL
UNION ALL
SELECT 'medicaments', patient_id, id_sejour, item_id FROM (
  SELECT {_id_sql('pd')} AS patient_id, {_id_sql('sd')} AS id_sejour, {_id_sql('ud')} AS item_id FROM (
    SELECT CAST(l_suppkey AS DOUBLE) AS pd,
           CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_orderkey AS DOUBLE) END AS sd,
           CASE WHEN l_partkey % 4 = 0 THEN CAST(l_partkey AS DOUBLE) + 0.5 ELSE CAST(l_partkey AS DOUBLE) END AS ud
    FROM lineitem) x) y
WHERE patient_id IS NOT NULL AND id_sejour IS NOT NULL""")
def q_load_filter(spark, sf_dir):
    d = ad.table(spark, sf_dir, "documents").select("doc_id")
    o = ad.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    raw_docs = d.join(o, d.doc_id == o.o_orderkey, "left").select(
        F.when(F.col("doc_id") % 7 == 0, F.lit(None)).otherwise(F.col("o_custkey").cast("double"))
        .alias("patient_id"),
        F.when(F.col("doc_id") % 5 == 0, F.lit(None)).otherwise(F.col("doc_id").cast("double"))
        .alias("id_sejour"),
        F.col("doc_id").cast("double").alias("doc_id"))
    docs = ingest.drop_unattached(ingest.conform(raw_docs, TABLES["documents"]), "documents")
    li = ad.table(spark, sf_dir, "lineitem")
    raw_meds = li.select(
        F.col("l_suppkey").cast("double").alias("patient_id"),
        F.when(F.col("l_linenumber") == 7, F.lit(None)).otherwise(F.col("l_orderkey").cast("double"))
        .alias("id_sejour"),
        F.when(F.col("l_partkey") % 4 == 0, F.col("l_partkey").cast("double") + 0.5)
        .otherwise(F.col("l_partkey").cast("double")).alias("ucd"),
        F.col("l_quantity").alias("qte"))
    meds = ingest.drop_unattached(ingest.conform(raw_meds, TABLES["medicaments"]), "medicaments")
    return (docs.select(F.lit("documents").alias("tbl"), "patient_id", "id_sejour",
                        F.col("doc_id").alias("item_id"))
            .unionByName(meds.select(F.lit("medicaments").alias("tbl"), "patient_id", "id_sejour",
                                     F.col("ucd").alias("item_id"))))


@register("id_normalise", f"""
SELECT event_id, {_id_sql("CASE WHEN event_type = 'error' THEN NULL ELSE value END")} AS id_value,
       {_id_sql('floor(value)')} AS id_floor, CAST(user_id AS VARCHAR) AS id_user
FROM events""")
def q_id_normalise(spark, sf_dir):
    ev = ad.table(spark, sf_dir, "events")
    v = F.when(F.col("event_type") == "error", F.lit(None)).otherwise(F.col("value"))
    dbl = ev.schema["value"].dataType
    return ev.select("event_id", fs.id_string(v, dbl).alias("id_value"),
                     fs.id_string(F.floor("value").cast("double"), dbl).alias("id_floor"),
                     fs.id_string(F.col("user_id"), ev.schema["user_id"].dataType).alias("id_user"))


_INT_SQL = ("CASE WHEN regexp_matches({0}, '^\\s*[+-]?[0-9]+\\s*$') "
            "THEN CAST(trim({0}) AS BIGINT) ELSE 0 END")


@register("safe_int", f"""
SELECT event_id, {_INT_SQL.format('t_text')} AS i_text, {_INT_SQL.format('t_pad')} AS i_pad,
       {_INT_SQL.format('t_unit')} AS i_unit, coalesce(CAST(trunc(value) AS BIGINT), 0) AS i_double
FROM (SELECT event_id, value, CAST(value AS VARCHAR) AS t_text,
             ' ' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || ' ' AS t_pad,
             CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || ' kg' AS t_unit FROM events) e""")
def q_safe_int(spark, sf_dir):
    ev = ad.table(spark, sf_dir, "events")
    whole = F.floor("value").cast("bigint").cast("string")
    t = ev.select("event_id", "value", F.col("value").cast("string").alias("t_text"),
                  F.concat(F.lit(" "), whole, F.lit(" ")).alias("t_pad"),
                  F.concat(whole, F.lit(" kg")).alias("t_unit"))
    st, dt = t.schema["t_text"].dataType, t.schema["value"].dataType
    return t.select("event_id", fs.safe_int("t_text", st).alias("i_text"),
                    fs.safe_int("t_pad", st).alias("i_pad"), fs.safe_int("t_unit", st).alias("i_unit"),
                    fs.safe_int("value", dt).alias("i_double"))


BOOL_WORDS_SQL = "('true', '1', 'vrai', 'oui', 'yes')"


@register("safe_bool", f"""
SELECT event_id, coalesce(lower(trim(t)) IN {BOOL_WORDS_SQL}, false) AS b_text,
       coalesce(value - floor(value) <> 0, false) AS b_num
FROM (SELECT event_id, value,
             CASE event_type WHEN 'view' THEN ' Oui ' WHEN 'click' THEN 'vrai' WHEN 'error' THEN 'non'
                             WHEN 'purchase' THEN '1' END AS t FROM events) e""")
def q_safe_bool(spark, sf_dir):
    ev = ad.table(spark, sf_dir, "events")
    et = F.col("event_type")
    t = (F.when(et == "view", " Oui ").when(et == "click", "vrai").when(et == "error", "non")
         .when(et == "purchase", "1"))
    x = ev.select("event_id", t.alias("t"), (F.col("value") - F.floor("value")).alias("frac"))
    return x.select("event_id", fs.safe_bool("t", x.schema["t"].dataType).alias("b_text"),
                    fs.safe_bool("frac", x.schema["frac"].dataType).alias("b_num"))


# ----------------------------------------------------- identity and counts

@register("first_identity", """
SELECT CAST(o_custkey AS VARCHAR) AS patient_id, arg_min(o_orderstatus, o_orderkey) AS sexe,
       arg_min(CAST(trunc(o_totalprice) AS BIGINT) % 100, o_orderkey) AS age, count(*) AS n_rows
FROM orders GROUP BY o_custkey""")
def q_first_identity(spark, sf_dir):
    o = ad.table(spark, sf_dir, "orders")
    rows = o.select("o_custkey", "o_orderkey", F.col("o_orderstatus").alias("sexe"),
                    (F.col("o_totalprice").cast("bigint") % 100).alias("age"))
    from recordfold.operators.dossier import first_row
    ident = first_row(rows, ["o_custkey"], "o_orderkey", ["sexe", "age"])
    return ident.select(F.col("o_custkey").cast("string").alias("patient_id"), "sexe", "age",
                        "n_rows")


@register("table_counts", with_ctes(["patients", "stays", "docs", "log", "suggestions", "codes",
                                      "accounts", "assign"], """
SELECT 'patients' AS tbl, count(*) AS n_rows FROM patients UNION ALL
SELECT 'sejours', count(*) FROM stays UNION ALL
SELECT 'documents', count(*) FROM docs UNION ALL
SELECT 'annotations', count(*) FROM log UNION ALL
SELECT 'suggestions', count(*) FROM suggestions UNION ALL
SELECT 'codes_valides', count(*) FROM codes UNION ALL
SELECT 'accounts', count(*) FROM accounts UNION ALL
SELECT 'assignments', count(*) FROM assign"""))
def q_table_counts(spark, sf_dir):
    from recordfold.operators.dossier import table_counts
    return table_counts({
        "patients": ad.patients(spark, sf_dir), "sejours": ad.stays(spark, sf_dir),
        "documents": ad.documents(spark, sf_dir), "annotations": ad.decision_log(spark, sf_dir),
        "suggestions": ad.suggestions(spark, sf_dir), "codes_valides": ad.clinician_codes(spark, sf_dir),
        "accounts": ad.accounts(spark, sf_dir), "assignments": _assign(spark, sf_dir)})


@register("export_all", with_ctes(["log"], f"""
SELECT {TS_SQL.format('"timestamp"')} AS "timestamp", "user", patient_id, id_sejour, item_type, item_id,
       action, code, libelle, type_code, commentaire, seq FROM log"""))
def q_export_all(spark, sf_dir):
    """Append every decision to a per-reviewer log on storage, then read all
    reviewers' logs back as one table (the consolidated export)."""
    root = scratch_path(spark, "decision-log")
    log = ad.decision_log(spark, sf_dir).select(*[f.name for f in ANNOTATIONS.fields])
    decisions.append_decisions(log, root)
    back = decisions.read_all_decisions(spark, root)
    return back.select(ts_text("timestamp").alias("timestamp"), "user", "patient_id", "id_sejour",
                       "item_type", "item_id", "action", "code", "libelle", "type_code",
                       "commentaire", "seq")


@register("patient_list", with_ctes(["assign", "accounts", "patients"], """
SELECT a.username, p.patient_id, p.pos AS patient_pos
FROM assign a JOIN accounts c ON a.username = c.username AND c.role <> 'admin'
JOIN patients p ON p.patient_id = a.patient_id"""))
def q_patient_list(spark, sf_dir):
    """Each reviewer's patient list: known assigned patients with their
    position in the patient table (the list order)."""
    vis = access.visible_patients(ad.accounts(spark, sf_dir), _assign(spark, sf_dir),
                                  ad.patients(spark, sf_dir))
    return access.patient_list(ad.patients(spark, sf_dir), vis)


@register("account_list", with_ctes(["accounts"], """
SELECT username, role, row_number() OVER (ORDER BY username) - 1 AS place FROM accounts"""))
def q_account_list(spark, sf_dir):
    """Accounts in name order with their place in it."""
    return access.account_list(ad.accounts(spark, sf_dir)).select("username", "role", "place")


@register("patient_list_admin", with_ctes(["accounts", "patients"], """
SELECT c.username, p.patient_id, p.pos AS patient_pos
FROM patients p, (SELECT min(username) AS username FROM accounts WHERE role = 'admin') c"""))
def q_patient_list_admin(spark, sf_dir):
    """The first admin's patient list: the whole patient table."""
    accounts = ad.accounts(spark, sf_dir)
    admin = access.account_stats(accounts).first()["first_admin"] or ""
    visible = access.visible_patients(accounts, _assign(spark, sf_dir), ad.patients(spark, sf_dir))
    rows = access.patient_list_for(ad.patients(spark, sf_dir), visible, accounts, admin)
    return rows.select(F.lit(admin).alias("username"), "patient_id", "patient_pos")


@register("load_typed", """
SELECT o_orderkey,
       CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE o_orderkey % 100 END AS confiance_double,
       CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE o_orderkey % 100 END AS confiance_text,
       CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE o_orderkey % 100 END AS confiance_int,
       CASE WHEN o_orderkey % 5 <> 0 THEN CAST(60 + o_orderkey % 40 AS VARCHAR) END AS fc_double,
       (o_orderkey % 3 = 1) AS removed_double, (o_orderkey % 3 = 1) AS removed_text,
       (o_orderkey % 3 = 1) AS removed_bool
FROM orders""")
def q_load_typed(spark, sf_dir):
    """Integer and truth columns stored as doubles with gaps, as text, as
    integers and as booleans, through the tolerant load."""
    from pyspark.sql import types as T

    from recordfold.functions.scalars import safe_bool, safe_int
    from recordfold.schemas import TABLES
    from recordfold.sources.ingest import conform
    o = ad.table(spark, sf_dir, "orders").select("o_orderkey")
    k, key = F.col("o_orderkey"), T.StructField("o_orderkey", T.LongType())
    sugg = T.StructType([key, TABLES["suggestions"]["confiance"]])
    code = T.StructType([key, TABLES["codes_valides"]["removed"]])
    vital = T.StructType([key, TABLES["constantes"]["fc"]])
    number, truth = F.when(k % 7 != 0, k % 100), F.when(k % 3 != 2, k % 3)
    out = o
    for name, c in (("double", number.cast("double")), ("text", F.coalesce(number.cast("string"), F.lit("n/a"))),
                    ("int", number.cast("int"))):
        x = conform(o.withColumn("confiance", c), sugg)
        out = out.join(x.select(k, safe_int("confiance", T.StringType()).alias(f"confiance_{name}")), "o_orderkey")
    x = conform(o.withColumn("fc", F.when(k % 5 != 0, 60.0 + k % 40)), vital)
    out = out.join(x.select(k, safe_int("fc", T.StringType(), None).cast("string").alias("fc_double")), "o_orderkey")
    for name, c in (("double", truth.cast("double")), ("text", F.when(truth == 1, "Vrai").otherwise("non")),
                    ("bool", truth == 1)):
        x = conform(o.withColumn("removed", c), code)
        out = out.join(x.select(k, safe_bool("removed", T.StringType()).alias(f"removed_{name}")), "o_orderkey")
    return out


@register("import_reviewer_logs", ORACLE["latest_actions"])
def q_import_reviewer_logs(spark, sf_dir):
    """Write the log as one CSV per reviewer with offset timestamps, doubled
    quotes and no ``seq``, read the files back and fold them."""
    from recordfold.operators.overlay import latest_actions
    root = scratch_path(spark, "reviewer-logs")
    decisions.write_reviewer_files(ad.decision_log(spark, sf_dir), root)
    # parsed once: the fold reads the log twice
    la = latest_actions(materialised(decisions.read_reviewer_files(spark, f"{root}/*"), "reviewer-rows"))
    return la.select("user", "patient_id", "id_sejour", "item_id", ts_text("timestamp").alias("last_ts"),
                     "item_type", "action", "code", "libelle", "type_code", "commentaire")


@register("export_file", ORACLE["export_all"])
def q_export_file(spark, sf_dir):
    """The consolidated log written as CSV files and read back by its schema."""
    path = scratch_path(spark, "export")
    decisions.export_csv(ad.decision_log(spark, sf_dir).select(*decisions.COLUMNS), path)
    back = spark.read.schema(ANNOTATIONS).options(**decisions.CSV_OPTIONS).csv(path)
    return back.select(ts_text("timestamp").alias("timestamp"), "user", "patient_id", "id_sejour", "item_type", "item_id",
                       "action", "code", "libelle", "type_code", "commentaire", "seq")


@register("tables_roundtrip", with_ctes(["log"], """
SELECT 'patients' AS tbl, CAST(c_custkey AS VARCHAR) AS patient_id, NULL AS id_sejour, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS v, 1 AS n FROM customer
UNION ALL SELECT 'sejours', CAST(o_custkey AS VARCHAR), CAST(o_orderkey AS VARCHAR), o_orderpriority, 1 FROM orders
UNION ALL SELECT 'constantes', CAST(o_custkey AS VARCHAR), CAST(o_orderkey AS VARCHAR), strftime(o_orderdate, '%d/%m'), 1 FROM orders
UNION ALL SELECT 'parcours', patient_id, id_sejour, CAST(seq AS VARCHAR), 1 FROM log
UNION ALL SELECT t, CAST(o_custkey AS VARCHAR), CAST(l_orderkey AS VARCHAR), CAST(l_partkey AS VARCHAR), count(*)
FROM lineitem JOIN orders ON o_orderkey = l_orderkey, (VALUES ('medicaments'), ('codes_valides')) k(t) GROUP BY t, o_custkey, l_orderkey, l_partkey
UNION ALL SELECT 'biologie', CAST(o_custkey AS VARCHAR), CAST(l_orderkey AS VARCHAR), strftime(l_shipdate, '%d/%m'), 2 * count(*)
FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY o_custkey, l_orderkey, strftime(l_shipdate, '%d/%m')
UNION ALL SELECT 'documents', CAST(o_custkey AS VARCHAR), CASE WHEN doc_id % 5 <> 0 THEN CAST(doc_id AS VARCHAR) END, CAST(doc_id AS VARCHAR), 1
FROM documents JOIN orders ON o_orderkey = doc_id
UNION ALL SELECT 'fiches', CAST(o_custkey AS VARCHAR), CASE WHEN conv_id % 5 <> 0 THEN CAST(conv_id AS VARCHAR) END, CAST(conv_id AS VARCHAR), count(*)
FROM conversations JOIN orders ON o_orderkey = conv_id GROUP BY o_custkey, conv_id
UNION ALL SELECT 'observations', CAST(o_custkey AS VARCHAR), CASE WHEN page_id % 5 <> 0 THEN CAST(o_orderkey AS VARCHAR) END, CAST(page_id AS VARCHAR), 1
FROM pages JOIN orders ON o_orderkey = page_id // 3
UNION ALL SELECT 'suggestions', CAST(o_custkey AS VARCHAR), CAST(doc_id AS VARCHAR), CAST(doc_id AS VARCHAR) || '-' || CAST(item_id AS VARCHAR), 1
FROM documents d JOIN benchmark b ON contains(d.text, b.text) JOIN orders ON o_orderkey = doc_id
WHERE doc_id % 5 <> 0 AND b.text IS NOT NULL AND b.text <> ''"""))
def q_tables_roundtrip(spark, sf_dir):
    """All eleven tables written as files (a fresh folder) and loaded back the
    tolerant way: rows by patient, stay and a value of each."""
    base = scratch_path(spark, "tables")
    value = {"patients": "sexe", "sejours": "service", "constantes": "date", "parcours": "event_id", "medicaments": "ucd", "codes_valides": "code",
             "biologie": "date", "documents": "doc_id", "fiches": "fiche_id", "observations": "observation_id", "suggestions": "suggestion_id"}
    # the lines with their patient are what three tables are made of: joined once, with the columns these have
    tables = ad.domain_tables(spark, sf_dir, lambda df, label: materialised(df, label) if label == "lines" else df,
                              place=("l_linenumber", "l_partkey", "l_shipdate"))
    ingest.write_tables({n: df.drop("pos") for n, df in tables.items()}, base)
    out = None
    for name, column in value.items():
        t = ingest.load_table(spark, base, name)
        stay = F.col("id_sejour") if "id_sejour" in t.columns else F.lit(None).cast("string")
        rows = t.select(F.lit(name).alias("tbl"), "patient_id", stay.alias("id_sejour"), F.col(column).cast("string").alias("v"))
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("tbl", "patient_id", "id_sejour", "v").agg(F.count(F.lit(1)).alias("n"))


@register("load_damaged", with_ctes(["patients"], """
SELECT 'row' AS kind, patient_id AS k, sexe AS v FROM patients UNION ALL SELECT 'reject', NULL, 'no_row_read'"""))
def q_load_damaged(spark, sf_dir):
    """A folder of files of which one is damaged: the rows of the good ones, and the reject."""
    base = scratch_path(spark, "damaged")
    ad.patients(spark, sf_dir).select("patient_id", "sexe", "age").repartition(4).write.parquet(f"{base}/good")
    spark.range(1).selectExpr("'PAR1 and no more' AS value").coalesce(1).write.text(f"{base}/bad")
    rows, rejects = ingest.load_files(spark, base, "patients")
    return rows.select(F.lit("row").alias("kind"), F.col("patient_id").alias("k"), F.col("sexe").alias("v")).unionByName(
        rejects.select(F.lit("reject").alias("kind"), F.lit(None).cast("string").alias("k"), F.col("reason").alias("v")))


@register("one_reviewer", with_ctes(["log"], f"""
SELECT "user", patient_id, id_sejour, item_id, {TS_SQL.format('"timestamp"')} AS "timestamp", action, seq
FROM log WHERE "user" = (SELECT min("user") FROM log)"""))
def q_one_reviewer(spark, sf_dir):
    """The first reviewer's log, read from their bucket of the written log."""
    root = scratch_path(spark, "logs")
    log = ad.decision_log(spark, sf_dir)
    decisions.append_decisions(log, root)
    mine = decisions.read_user_decisions(spark, root, log.agg(F.min("user")).first()[0])
    return mine.select("user", "patient_id", "id_sejour", "item_id", ts_text("timestamp").alias("timestamp"), "action", "seq")


@register("log_compaction", with_ctes(["log"], """
SELECT r.reader, seq, "user", item_id, commentaire FROM log, (VALUES ('before'), ('after')) r(reader)"""))
def q_log_compaction(spark, sf_dir):
    """The log written in four batches and compacted in place: a reader that was
    open before, and one that comes after a replayed batch, a batch written
    since and a compaction that was cut short -- the same rows."""
    root = scratch_path(spark, "compacted-log")
    log = ad.decision_log(spark, sf_dir)
    for i in range(3):
        decisions.append_decisions(log.where(F.col("seq") % 4 == i), root, f"b{i}")
    before = decisions.read_all_decisions(spark, root)
    decisions.compact(spark, root)
    before = materialised(before, "read-while-compacted")
    decisions.append_decisions(log.where(F.col("seq") % 4 == 1), root, "b1")
    decisions.append_decisions(log.where(F.col("seq") % 4 == 3), root, "b3")
    decisions.append_decisions(log.where(F.col("seq") % 4 == 0), root, f"{decisions.COMPACTED}cut-short")
    after = decisions.read_all_decisions(spark, root)
    late = log.where(F.col("seq") % 4 == 3).select(*decisions.COLUMNS)
    tagged = lambda df, who: df.select(F.lit(who).alias("reader"), "seq", "user", "item_id", "commentaire")
    return tagged(before.unionByName(late), "before").unionByName(tagged(after, "after"))


@register("comment_batches", """
SELECT 'c' || CAST(s_suppkey AS VARCHAR) AS id, 'RG-' || CAST(s_suppkey * 37 AS VARCHAR) AS rule_id, 'u' || CAST(s_suppkey % 150 AS VARCHAR) AS auteur
FROM supplier""")
def q_comment_batches(spark, sf_dir):
    """Comments appended in batches (one of them twice) to a saved version, and
    folded into the next one before the last batch."""
    root = scratch_path(spark, "comments")
    c = ad.rule_comments(spark, sf_dir)
    part = lambda i: c.where(F.pmod(F.xxhash64("id"), F.lit(4)) == i)
    rule_store.save_version(part(0), root, "rules_commentaires", 1)
    for i in (1, 2, 1):
        rule_store.append_comments(part(i), root, spark, f"b{i}")
    rule_store.fold_comments(spark, root)
    rule_store.append_comments(part(3), root, spark)
    return rule_store.read_current(spark, root, "rules_commentaires").select("id", "rule_id", "auteur")


@register("load_nan", """
SELECT CAST(l_orderkey AS VARCHAR) AS id_sejour, l_linenumber, count(*) AS n, count(*) FILTER (WHERE l_linenumber % 3 <> 0) AS n_values,
       CAST(max(CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity END) AS BIGINT) AS most
FROM lineitem GROUP BY l_orderkey, l_linenumber""")
def q_load_nan(spark, sf_dir):
    """Measures of which a third are NaN, and stay ids that are doubles, through
    the tolerant load: NaN is no value, and ids lose their '.0'."""
    from pyspark.sql import types as T
    li = ad.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    raw = li.select(F.col("l_orderkey").cast("double").alias("id_sejour"), "l_linenumber",
                    F.when(F.col("l_linenumber") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("l_quantity")).alias("valeur"))
    t = ingest.conform(raw, T.StructType([f for f in TABLES["biologie"].fields if f.name in ("id_sejour", "valeur")]
                                         + [raw.schema["l_linenumber"]]))
    return t.groupBy("id_sejour", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.count("valeur").alias("n_values"),
                                                      F.max("valeur").cast("bigint").alias("most"))
