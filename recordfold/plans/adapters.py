"""Views of the driver's tables in the shape of the review domain.

The library's operators work on the domain tables (patients, stays, decision
log, suggestions, ...).  These adapters derive such tables from the driver's
TPC-H-like parquet so that every registered query reads whole tables and its
work grows with them.  Each adapter has a DuckDB twin in ``plans.oracle``.

Mapping (keys stay numeric inside the plans and become text at the edges):
  patient = customer, stay = orders, dose / lab / code = lineitem,
  document = documents (a document's stay is the order with the same key; no
  stay when ``doc_id % 5 = 0``), form = conversations,
  decision log = events (user = user_id, item = ``props.k``, seq = event_id).
"""
from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _s(c) -> F.Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


# --------------------------------------------------------------- decision log

def _event_item(spark, sf_dir) -> DataFrame:
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    return ev.withColumn("k", F.get_json_object("props", "$.k").try_cast("bigint"))


def decision_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> annotations(timestamp, seq, user, patient_id, id_sejour, item_type,
    item_id, action, code, libelle, type_code, commentaire)."""
    e = _event_item(spark, sf_dir)
    k, et, v = F.col("k"), F.col("event_type"), F.col("value")
    # three neighbouring reviewers share ten customers; each customer has ten orders
    patient = (F.col("user_id") - F.col("user_id") % 3) * 10 + k % 10
    manual = k >= 90
    item_type = (F.when(manual, "manuel").when(k % 2 == 0, "suggestion").otherwise("code_valide"))
    action = (F.when(et == "view", F.when(manual, "ajouté").otherwise("validé"))
              .when(et == "click", F.when((k < 90) & (k % 2 == 1), "restauré").otherwise("rejeté"))
              .when(et == "error", "annulé")
              .when(et == "signup", "modifié")
              .when(et == "purchase", "supprimé"))
    code = F.when((et == "signup") | ((et == "view") & manual),
                  F.concat(F.lit("C"), _s(F.floor(v).cast("bigint"))))
    libelle = F.when(et == "signup", F.concat(F.lit("lib "), _s("event_id")))
    type_code = F.when(et == "signup", F.when(v < 100, "CCAM").otherwise("CIM-10"))
    # free text with a line break, quotes, a backslash and blanks around it
    comment = F.when(v > 400, F.concat(F.lit(" note "), _s("event_id"), F.lit('\n "b\\s", ')))
    return e.select(
        F.col("ts").alias("timestamp"), F.col("event_id").alias("seq"),
        F.concat(F.lit("u"), _s("user_id")).alias("user"),
        _s(patient).alias("patient_id"), _s(patient * 10 + F.floor(k / 10)).alias("id_sejour"),
        item_type.alias("item_type"), _s(k).alias("item_id"), action.alias("action"),
        code.alias("code"), libelle.alias("libelle"), type_code.alias("type_code"),
        comment.alias("commentaire"), "user_id", "event_type", "k")


def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One suggestion per suggestion-type item seen in the log, plus a twin item
    (id + 100) that no reviewer ever touches."""
    log = decision_log(spark, sf_dir)
    items = (log.where(F.col("item_type") == "suggestion")
             .select("patient_id", "id_sejour", "k").distinct())
    it = items.select("patient_id", "id_sejour",
                      F.explode(F.array(F.col("k"), F.col("k") + 100)).alias("item"))
    i = F.col("item")
    return it.select(
        "patient_id", "id_sejour", _s(i).alias("suggestion_id"),
        F.concat(F.lit("B"), _s(i)).alias("code"), F.lit("CIM-10").alias("type"),
        F.concat(F.lit("base "), _s(i)).alias("libelle"),
        F.when(i % 7 == 0, F.lit("n/a")).otherwise(_s(i % 100)).alias("confiance"),
        F.lit("document").alias("source_kind"), _s(i).alias("source_id"),
        F.concat(F.lit("RG-"), _s(i * 17)).alias("regle_id"))


def clinician_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One clinician code per code-type item seen in the log; base ``removed`` is
    a French yes/no word (``k % 3 = 0`` -> 'oui')."""
    log = decision_log(spark, sf_dir)
    items = (log.where(F.col("item_type") == "code_valide")
             .select("patient_id", "id_sejour", "k").distinct())
    k = F.col("k")
    return items.select(
        "patient_id", "id_sejour", _s(k).alias("code_id"),
        F.concat(F.lit("K"), _s(k)).alias("code"), F.lit("CIM-10").alias("type"),
        F.concat(F.lit("clin "), _s(k)).alias("libelle"),
        F.when(k % 3 == 0, F.lit("oui")).otherwise(F.lit("non")).alias("removed"))


def raw_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(username, patient_id, pos) with repeats: patients a reviewer opened."""
    log = decision_log(spark, sf_dir)
    return (log.where(F.col("event_type").isin("view", "click", "signup"))
            .select(F.col("user").alias("username"), "patient_id", F.col("seq").alias("pos")))


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(username, role): one account per user of the log; every tenth is admin."""
    ev = table(spark, sf_dir, "events").select("user_id").distinct()
    return ev.select(F.concat(F.lit("u"), _s("user_id")).alias("username"),
                     F.when(F.col("user_id") % 10 == 0, "admin").otherwise("user").alias("role"))


# ------------------------------------------------------------ stays and more

def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(_s("c_custkey").alias("patient_id"),
                    F.when(F.col("c_custkey") % 2 == 0, "F").otherwise("M").alias("sexe"),
                    (F.lit(18) + F.col("c_nationkey") * 3).alias("age"),
                    F.col("c_custkey").alias("pos"))


def stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders -> sejours; a stay lasts 60 days from the order date."""
    o = table(spark, sf_dir, "orders")
    entree = F.to_date("o_orderdate")
    return o.select("o_orderkey", "o_custkey",
                    _s("o_custkey").alias("patient_id"), _s("o_orderkey").alias("id_sejour"),
                    F.col("o_orderpriority").alias("service"),
                    entree.alias("entree"), F.date_add(entree, 60).alias("sortie"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents joined to the order of the same key for their patient; no stay
    when ``doc_id % 5 = 0``."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    # the orders of documents are found by their ids, so no text moves for them while there are few
    o = d.select(F.col("doc_id").alias("_id")).distinct().join(o, F.col("_id") == F.col("o_orderkey")).select("o_orderkey", "o_custkey")
    j = d.join(o, d.doc_id == o.o_orderkey, "left")
    return j.select(_s("o_custkey").alias("patient_id"),
                    F.when(F.col("doc_id") % 5 != 0, _s("doc_id")).alias("id_sejour"),
                    _s("doc_id").alias("doc_id"), F.col("lang").alias("type"),
                    F.col("source").alias("titre"), F.col("text").alias("full_text"))


LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")


def drug_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drug name -> (ATC, UCD) from part; every seventh part is missing, so
    some doses find no entry."""
    p = table(spark, sf_dir, "part").where(F.col("p_partkey") % 7 != 0)
    atc = F.concat(F.upper(F.substring("p_type", 1, 1)), F.lpad(_s("p_size"), 2, "0"),
                   F.expr("substr(p_brand, 7)"))
    return p.select(F.concat(F.lit("drug-"), _s("p_partkey")).alias("nom"), atc.alias("atc"),
                    _s(F.col("p_partkey") + 9200000).alias("ucd"), "p_partkey")


# ------------------------------------------------------------ rule dictionary

def rule_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part -> rules (id 'RG-<partkey>')."""
    p = table(spark, sf_dir, "part")
    return p.select(F.concat(F.lit("RG-"), _s("p_partkey")).alias("id"), F.col("p_name").alias("titre"),
                    F.col("p_type").alias("categorie"),
                    F.concat(F.lit("SI "), F.col("p_name")).alias("logique"),
                    F.col("p_brand").alias("code"), F.col("p_name").alias("libelle"),
                    F.when(F.col("p_size") % 2 == 0, "CIM-10").otherwise("CCAM").alias("type"),
                    F.concat_ws(" ", "p_type", _s("p_size")).alias("description"))


def rule_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem -> conditions of the rule of its part (ordre = line number)."""
    li = table(spark, sf_dir, "lineitem")
    m = F.col("l_linenumber") % 4
    op = (F.when(m == 0, "wordlist").when(m == 1, "lt").when(m == 2, "regex").otherwise("startswith"))
    val = (F.when(m == 0, F.when(F.col("l_quantity") <= 45,
                                 F.concat_ws("|", "l_returnflag", "l_linestatus")))
           .when(m == 1, _s("l_quantity"))
           .when(m == 2, F.concat(F.lit("R"), F.col("l_returnflag")))
           .otherwise(F.col("l_linestatus")))
    return li.select(F.concat(F.lit("RG-"), _s("l_partkey")).alias("rule_id"),
                     F.col("l_linenumber").alias("ordre"), F.lit("lineitem.l_quantity").alias("champ"),
                     op.alias("operateur"), val.alias("valeur"),
                     F.when(m == 2, F.lit("i")).alias("flags"))


def rule_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier -> comments on rule 'RG-<37*suppkey>' (blank text every ninth)."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    return s.select(F.concat(F.lit("c"), _s(k)).alias("id"),
                    F.concat(F.lit("RG-"), _s(k * 37)).alias("rule_id"),
                    F.concat(F.lit("u"), _s(k % 150)).alias("auteur"),
                    F.lit(None).cast("timestamp_ntz").alias("date"),
                    F.when(k % 18 == 0, F.lit("\t\n")).when(k % 9 == 0, F.lit("   "))
                    .otherwise(F.concat(F.lit(" "), F.col("s_name"), F.lit("\n")))
                    .alias("texte"))


def rule_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier -> partial updates of rule 'RG-<23*suppkey>'; every fifth is
    followed by a second patch of the same rule."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    x = s.select(k, "s_name", F.explode(F.when(k % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("pos"))
    first = F.col("pos") == 0
    return x.select(F.concat(F.lit("RG-"), _s(k * 23)).alias("id"), "pos",
                    F.when(first & (k % 2 == 0), F.col("s_name"))
                    .when(~first & (k % 4 == 0), F.concat(F.lit("again "), F.col("s_name"))).alias("titre"),
                    F.when(first & (k % 3 == 0), F.concat(F.lit("SI "), F.col("s_name"))).alias("logique"),
                    F.when(~first, F.lit("second")).alias("description"))


def new_rule_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier -> replacement condition sets (two conditions per rule)."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    x = s.select(k, "s_nationkey", F.explode(F.array(F.lit(0), F.lit(1))).alias("ordre"))
    return x.select(F.concat(F.lit("RG-"), _s(k * 23)).alias("rule_id"), "ordre",
                    F.when(F.col("ordre") == 0, "supplier.s_nationkey").otherwise("supplier.s_name")
                    .alias("champ"),
                    F.when(F.col("ordre") == 0, "lt").otherwise("startswith").alias("operateur"),
                    F.when(F.col("ordre") == 0, _s("s_nationkey")).otherwise(F.lit("Supp")).alias("valeur"),
                    F.lit(None).cast("string").alias("flags"))


# ------------------------------------------------------- full domain tables

def stay_lines(spark: SparkSession, sf_dir: str, place: Sequence[str] = LINE_ORDER) -> DataFrame:
    """lineitem with its patient and stay: what doses, lab results and codes are made of."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return li.select(_s("l_orderkey").alias("id_sejour"), *place, "l_quantity", "l_discount", "l_returnflag").join(
        o.select(_s("o_orderkey").alias("id_sejour"), _s("o_custkey").alias("patient_id")), "id_sejour")


def domain_tables(spark: SparkSession, sf_dir: str,
                  stored: Callable[[DataFrame, str], DataFrame] = lambda df, label: df,
                  place: Sequence[str] = LINE_ORDER) -> dict[str, DataFrame]:
    """All eleven reference tables derived from the driver's tables, each
    with its file position ``pos``.  Forms are conversations (no stay when
    ``conv_id % 5 = 0``); doses, lab results (two measures per line) and
    clinician codes are line items; suggestions are benchmark passages found
    in documents that belong to a stay; pathway events are the decision log's
    events, observations are pages (no stay when ``page_id % 5 = 0``) and
    vitals come one per order.

    ``stored`` may write what several tables are projections of: the line items
    with their patient, and the orders.  ``place`` is what a line's position is
    made of; less of it does where no order is asked for."""
    from recordfold.operators.textmatch import find_passages

    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    li = stored(stay_lines(spark, sf_dir, place), "lines")
    li_pos = F.struct(*place)  # a line's place in its order: unique, unlike its number
    t: dict[str, DataFrame] = {}
    t["patients"] = patients(spark, sf_dir)
    o = stored(table(spark, sf_dir, "orders").select(
        _s("o_custkey").alias("patient_id"), _s("o_orderkey").alias("id_sejour"), "o_orderkey", "o_orderdate", "o_orderpriority"), "orders")
    t["sejours"] = o.select(
        "patient_id", F.datediff(F.lit("2030-01-01").cast("date"), F.to_date("o_orderdate")).alias("ordre"),
        "id_sejour", F.col("o_orderpriority").alias("service"),
        F.to_date("o_orderdate").alias("entree"), F.date_add(F.to_date("o_orderdate"), 60).alias("sortie"),
        F.col("o_orderkey").alias("pos"))
    log = decision_log(spark, sf_dir)
    none = lambda kind="string": F.lit(None).cast(kind)
    t["parcours"] = log.select(
        "patient_id", "id_sejour", _s("seq").alias("event_id"), F.to_date("timestamp").alias("date"),
        F.date_format("timestamp", "HH:mm").alias("heure"), F.col("event_type").alias("type"),
        F.concat(F.lit("item "), _s("k")).alias("titre"), none().alias("detail"), none().alias("uf"), F.col("seq").alias("pos"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url").join(orders, F.floor(F.col("page_id") / 3) == F.col("o_orderkey"))
    noted = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 37 % 400).cast("int"))
    t["observations"] = pages.select(
        _s("o_custkey").alias("patient_id"), F.when(F.col("page_id") % 5 != 0, _s("o_orderkey")).alias("id_sejour"),
        _s("page_id").alias("observation_id"), F.when(F.col("page_id") % 7 != 0, noted).alias("date"), none().alias("uf"), F.lit("page").alias("categorie"),
        F.col("url").alias("texte"), F.col("page_id").cast("bigint").alias("pos"))
    t["constantes"] = o.select(
        "patient_id", "id_sejour", F.date_format("o_orderdate", "dd/MM").alias("date"),
        F.when(F.col("o_orderkey") % 9 != 0, _s(F.col("o_orderkey") % 60 + 50)).otherwise(F.lit("n/a")).alias("fc"),
        F.col("o_orderpriority").alias("ta"), none().alias("spo2"), none().alias("temp"), none().alias("poids"),
        F.col("o_orderkey").alias("pos"))
    docs = documents(spark, sf_dir)
    t["documents"] = docs.select(
        "patient_id", "id_sejour", "doc_id", F.lit(None).cast("date").alias("date"), "type", "titre",
        F.lit(None).cast("string").alias("uf"), F.substring("full_text", 1, 80).alias("excerpt"),
        "full_text", F.col("doc_id").cast("bigint").alias("pos"))
    conv = table(spark, sf_dir, "conversations").join(orders, F.col("conv_id") == F.col("o_orderkey"))
    t["fiches"] = conv.select(
        _s("o_custkey").alias("patient_id"),
        F.when(F.col("conv_id") % 5 != 0, _s("conv_id")).alias("id_sejour"),
        _s("conv_id").alias("fiche_id"), F.lit("conversation").alias("titre"), F.lit("chat").alias("type"),
        F.lit(None).cast("date").alias("date"), F.lit(None).cast("string").alias("uf"),
        F.col("turn").cast("int").alias("champ_ordre"), F.col("role").alias("champ_label"),
        F.col("text").alias("champ_valeur"), F.struct("conv_id", "turn").alias("pos"))
    bio = li.select("patient_id", "id_sejour", F.date_format("l_shipdate", "dd/MM").alias("date"), li_pos.alias("pos"),
                    F.explode(F.array(
                        F.struct(F.lit("quantite").alias("code"), F.col("l_quantity").alias("valeur")),
                        F.struct(F.lit("remise").alias("code"), (F.col("l_discount") + 0.0).alias("valeur"))))
                    .alias("m"))
    t["biologie"] = bio.select("patient_id", "id_sejour", "date", "m.code", "m.valeur",
                               F.lit("").alias("unite"), "pos")
    t["medicaments"] = li.select(
        "patient_id", "id_sejour", F.concat(F.lit("drug-"), _s("l_partkey")).alias("nom"), F.col("l_quantity").alias("qte"),
        F.lit("mg").alias("unite"), F.lit(None).cast("string").alias("atc"), _s("l_partkey").alias("ucd"),
        F.col("l_shipdate").alias("date_administration"), li_pos.alias("pos"))
    t["codes_valides"] = li.select(
        "patient_id", "id_sejour", F.concat_ws("-", "id_sejour", "l_linenumber", "l_partkey").alias("code_id"),
        _s("l_partkey").alias("code"), F.lit("CIM-10").alias("type"), F.lit(None).cast("string").alias("libelle"),
        F.to_date("l_shipdate").alias("date"),
        F.when(F.col("l_returnflag") == "R", "oui").otherwise("non").alias("removed"), li_pos.alias("pos"))
    # found by the document alone: its patient is joined to the few hits, not to every word of its text
    staydocs = table(spark, sf_dir, "documents").where(F.col("doc_id") % 5 != 0).select("doc_id", "text")
    bench = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("passage"))
    hits = find_passages(staydocs, ["doc_id"], "text", bench, ["item_id"], "passage")
    hits = hits.join(bench, "item_id").join(orders, F.col("doc_id") == F.col("o_orderkey")).withColumns(
        {"patient_id": _s("o_custkey"), "id_sejour": _s("doc_id"), "doc_id": _s("doc_id")}).where(F.col("patient_id").isNotNull())
    t["suggestions"] = hits.select(
        "patient_id", "id_sejour", F.concat_ws("-", "doc_id", "item_id").alias("suggestion_id"),
        F.concat(F.lit("B"), _s("item_id")).alias("code"), F.lit("CIM-10").alias("type"),
        F.lit(None).cast("string").alias("libelle"), F.lit("50").alias("confiance"),
        F.lit("document").alias("source_kind"), F.col("doc_id").alias("source_id"),
        F.lit(None).cast("string").alias("justification"), F.lit(None).cast("string").alias("regle_id"),
        F.when(F.col("item_id") % 5 != 0, F.when(F.col("item_id") % 7 != 0, F.col("passage")).otherwise("")).alias("highlight"),
        F.col("item_id").alias("pos"))
    return t


def record_log(t: Mapping[str, DataFrame]) -> DataFrame:
    """One reviewer's decisions on the items of ``domain_tables``: every third
    supplier's codes are deleted, restored, amended or cancelled in turn, four
    of five suggestions are decided on, and every eleventh stay has a code added
    by hand, every second of them deleted again."""
    k = F.col("pos")["l_suppkey"]
    said = lambda n, words: F.element_at(F.array(*[F.lit(w) for w in words]), (n + 1).cast("int"))
    row = lambda kind, item, ts, seq, action, code, libelle, type_code=F.lit(None): [
        ts.cast("timestamp_ntz").alias("timestamp"), F.lit("u").alias("user"), "patient_id", "id_sejour", F.lit(kind).alias("item_type"),
        item.alias("item_id"), action.alias("action"), code.alias("code"), libelle.alias("libelle"),
        type_code.cast("string").alias("type_code"), F.lit(None).cast("string").alias("commentaire"), seq.cast("bigint").alias("seq")]
    done = said(F.floor(k / 3) % 4, ("supprimé", "restauré", "modifié", "annulé"))
    codes = t["codes_valides"].where(k % 3 == 0).select(*row(
        "code_valide", F.col("code_id"), F.col("pos")["l_shipdate"], k, done, F.when(done == "modifié", F.concat(F.lit("N"), _s(k))),
        F.when(done == "modifié", F.concat(F.lit("new "), _s(k)))))
    item = F.col("pos")
    done = said(item % 5 - 1, ("validé", "rejeté", "modifié", "annulé"))
    sugg = t["suggestions"].where(item % 5 != 0).select(*row(
        "suggestion", F.col("suggestion_id"), F.lit("2024-05-01"), F.lit(1), done, F.when(done == "modifié", F.concat(F.lit("S"), _s(item))),
        F.when(done == "modifié", F.concat(F.lit("amended "), "source_id"))))
    by_hand = t["sejours"].where(F.col("pos") % 11 == 0).withColumn("_n", F.explode(
        F.when(F.col("pos") % 22 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    added = F.col("_n") == 1
    manual = by_hand.select(*row(
        "manuel", F.concat(F.lit("man-"), "id_sejour"), F.col("entree"), F.col("_n"), F.when(added, "ajouté").otherwise("supprimé"),
        F.when(added, F.concat(F.lit("M"), "id_sejour")), F.lit(None).cast("string"), F.when(added, "CCAM")))
    return codes.unionByName(sugg).unionByName(manual)
