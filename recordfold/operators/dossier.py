"""Record assembly: per-stay children, form assembly, highlights and the
nested per-patient record.

Plan shape: each child table is aggregated to one row per (patient_id,
id_sejour) *before* joining (joining raw children would multiply them), then
left-joined from the stays, all on the same key so the joins share one hash
partitioning.  Flat variants (counts, flattened rows) use only algebraic
aggregates (count, min_by, max_by) that combine map-side; only the nested
record collects a stay's children into arrays, which is its purpose, and its
size is one patient's record.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordfold.functions.scalars import safe_bool, safe_int

STAY_KEY = ["patient_id", "id_sejour"]


def first_row(df: DataFrame, keys: Sequence[str], order: str | Column, cols: Sequence[str]) -> DataFrame:
    """First row per key by ``order`` (the identity row, the rule row), plus the
    number of rows sharing the key."""
    o = F.col(order) if isinstance(order, str) else order
    picked = F.min_by(F.struct(*cols), o).alias("_first")
    return df.groupBy(*keys).agg(picked, F.count(F.lit(1)).alias("n_rows")) \
        .select(*keys, "_first.*", "n_rows")


def last_value(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str],
               name: str = "last_value") -> DataFrame:
    """Value of the last row per key in ``order`` (e.g. the latest lab result
    of a stay).  One combinable aggregate: no sort, no window."""
    ordering = F.struct(*[F.col(c) for c in order], F.col(value))
    return df.groupBy(*keys).agg(F.max_by(F.col(value), ordering).alias(name))


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows per table (the load report)."""
    out = None
    for name, df in tables.items():
        c = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("tbl"), "n_rows")
        out = c if out is None else out.unionByName(c)
    return out


def child_counts(stays: DataFrame, children: Mapping[str, DataFrame],
                 key: Sequence[str] = STAY_KEY) -> DataFrame:
    """One row per stay with ``n_<child>`` counts; children of unknown stays vanish."""
    out = stays
    for name, child in children.items():
        agg = child.groupBy(*key).agg(F.count(F.lit(1)).alias(f"n_{name}"))
        out = out.join(agg, list(key), "left") \
            .withColumn(f"n_{name}", F.coalesce(F.col(f"n_{name}"), F.lit(0)).cast("bigint"))
    return out


def flatten_children(stays: DataFrame, children: Mapping[str, DataFrame],
                     key: Sequence[str] = STAY_KEY) -> DataFrame:
    """The record as flat rows: (stay columns, kind, item_id, label) for every
    child row of a known stay.  Each child must expose ``item_id`` and ``label``."""
    rows = None
    for kind, child in children.items():
        r = child.select(*key, F.lit(kind).alias("kind"), F.col("item_id").cast("string"),
                         F.col("label").cast("string"))
        rows = r if rows is None else rows.unionByName(r)
    return stays.join(rows, list(key), "inner")


# ----------------------------------------------------------------- highlights

def highlights_by_source(suggestions: DataFrame, pos: str = "pos") -> DataFrame:
    """(patient, stay, source_kind, source_id) -> list of highlight passages in
    suggestion order; NULL and empty passages are skipped."""
    h = suggestions.where(F.col("highlight").isNotNull() & (F.col("highlight") != ""))
    lst = F.sort_array(F.collect_list(F.struct(F.col(pos).alias("p"), F.col("highlight").alias("h"))))
    return h.groupBy(*STAY_KEY, "source_kind", "source_id") \
        .agg(F.transform(lst, lambda x: x["h"]).alias("highlights"))


def attach_highlights(rows: DataFrame, highlights: DataFrame, kind: str, id_col: str) -> DataFrame:
    """Left-join a source table to its highlights (missing -> empty list)."""
    hl = highlights.where(F.col("source_kind") == kind) \
        .select(*STAY_KEY, F.col("source_id").alias(id_col), "highlights")
    out = rows.join(hl, [*STAY_KEY, id_col], "left")
    return out.withColumn("highlights", F.coalesce(F.col("highlights"), F.array().cast("array<string>")))


# ---------------------------------------------------------------------- forms

def _ordre_key(c: str) -> Column:
    # nulls last, then value (arrays sort nested nulls first, so flag them)
    return F.struct(F.col(c).isNull().alias("n"), F.col(c).alias("v"))


def form_headers(fiches: DataFrame, pos: str = "pos") -> DataFrame:
    """One row per form (fiche_id within patient and stay): header fields from
    the row with the lowest ``champ_ordre``, field count, first and last label.
    Rows without a form id are left out (they cannot be grouped)."""
    order = F.struct(_ordre_key("champ_ordre").alias("o"), F.col(pos).alias("p"))
    head = F.min_by(F.struct("titre", "type", "date", "uf"), order).alias("_h")
    return (fiches.where(F.col("fiche_id").isNotNull())
            .groupBy(*STAY_KEY, "fiche_id")
            .agg(head, F.count(F.lit(1)).alias("n_champs"),
                 F.min_by("champ_label", order).alias("first_label"),
                 F.max_by("champ_label", order).alias("last_label"),
                 F.min(F.col(pos)).alias("first_pos"))
            .select(*STAY_KEY, "fiche_id", "_h.*", "n_champs", "first_label", "last_label", "first_pos"))


def assemble_forms(fiches: DataFrame, pos: str = "pos") -> DataFrame:
    """Nested forms: header from the lowest field, fields ordered by
    ``champ_ordre`` (nulls last, then file order); forms keep first-seen order
    through ``first_pos``."""
    order = F.struct(_ordre_key("champ_ordre").alias("o"), F.col(pos).alias("p"))
    fields = F.sort_array(F.collect_list(F.struct(
        order.alias("k"), F.col("champ_label").alias("label"), F.col("champ_valeur").alias("valeur"))))
    return (fiches.where(F.col("fiche_id").isNotNull())
            .groupBy(*STAY_KEY, "fiche_id")
            .agg(F.min_by(F.struct("titre", "type", "date", "uf"), order).alias("_h"),
                 fields.alias("_f"), F.min(F.col(pos)).alias("first_pos"))
            .select(*STAY_KEY, "fiche_id", "_h.*", "first_pos",
                    F.transform("_f", lambda f: F.struct(f["label"].alias("label"),
                                                         f["valeur"].alias("valeur"))).alias("champs")))


# ------------------------------------------------------------- nested record

def _ordered_list(df: DataFrame, key: Sequence[str], pos: str, fields: Sequence[Column],
                  name: str) -> DataFrame:
    """Per key, ``name`` = array of struct(fields) in ``pos`` order."""
    lst = F.sort_array(F.collect_list(F.struct(F.col(pos).alias("_p"), F.struct(*fields).alias("_v"))))
    return df.groupBy(*key).agg(F.transform(lst, lambda x: x["_v"]).alias(name))


def _numbered_list(meds: DataFrame, chrono: Column, fields: Sequence) -> DataFrame:
    """Doses of a stay: ids number the list in file order, then it is put in
    time order (file order among equals)."""
    in_file = F.sort_array(F.collect_list(F.struct(F.col("pos").alias("_p"), chrono.alias("_c"), F.struct(*fields).alias("_v"))))
    names = [c if isinstance(c, str) else "dateAdministration" for c in fields]
    dose = lambda x, i: F.struct(
        x["_c"].alias("c"), i.alias("i"), F.struct(F.concat("id_sejour", F.lit("-med-"), i.cast("string")).alias("id"),
                                                   *[x["_v"][n].alias(n) for n in names]).alias("v"))
    lists = meds.groupBy(*STAY_KEY).agg(in_file.alias("_l"))
    return lists.select(*STAY_KEY, F.transform(F.sort_array(F.transform("_l", dose)), lambda x: x["v"]).alias("medicaments"))


def order_bucket(pos: str, dtype) -> Column | None:
    """A coarse value that never decreases along ``pos``: cuts a hot stay into
    ordered buckets for ``positional_index``."""
    if isinstance(dtype, (T.IntegerType, T.LongType)):
        return F.shiftright(F.col(pos), 20)
    if isinstance(dtype, T.StructType):
        if dtype.fieldNames() == ["_file", "_row"]:
            return F.struct(F.col(pos)["_file"], F.shiftright(F.col(pos)["_row"], 20))
        return F.col(pos)[dtype.fieldNames()[0]]
    return None


def build_stays(t: Mapping[str, DataFrame], latest: DataFrame | None = None) -> DataFrame:
    """The record in bulk form: one row per stay (patient_id, id_sejour, stay)
    with the stay's ordered lists, so a patient never gathers in one row."""
    return _stays(t, latest).select(*STAY_KEY, "stay")


def build_dossiers(t: Mapping[str, DataFrame], latest: DataFrame | None = None) -> DataFrame:
    """One nested record per patient (identity, sejourOrder, sejours map,
    horsSejour), for all patients in one plan.

    ``t`` holds the loaded tables, each with a ``pos`` column (file order).
    ``latest`` is the reader's folded decision log (``latest_actions``) keyed
    by (patient_id, id_sejour, item_id); without it no decision is applied.
    """
    return _per_patient(t, _stays(t, latest))


def _stays(t: Mapping[str, DataFrame], latest: DataFrame | None) -> DataFrame:
    from recordfold.operators import overlay

    k = STAY_KEY
    sug = t["suggestions"]
    hl = highlights_by_source(sug)

    docs_in = t["documents"].where(F.col("id_sejour").isNotNull())
    docs = attach_highlights(docs_in, hl, "document", "doc_id")
    doc_fields, form_fields, obs_fields = _text_fields()
    forms = assemble_forms(t["fiches"].where(F.col("id_sejour").isNotNull()))
    forms = attach_highlights(forms, hl, "fiche", "fiche_id")
    obs = attach_highlights(t["observations"].where(F.col("id_sejour").isNotNull()), hl,
                            "observation", "observation_id")
    obs = obs.withColumn("_chrono", F.struct(F.col("date").isNull().alias("n"), F.col("date").alias("d"),
                                             F.col("pos").alias("p")))

    meds = t["medicaments"]
    chrono = F.struct(F.col("date_administration").isNull().alias("n"), F.col("date_administration").alias("d"))
    med_fields = ["nom", "qte", "unite", "atc", "ucd", F.col("date_administration").alias("dateAdministration")]

    codes = t["codes_valides"]
    sugg = sug
    if latest is not None:
        # one reader's log: a constant user key lets the overlays' joins apply
        la = latest.withColumn("user", F.lit("_"))
        codes = overlay.codes_overlay(codes.withColumn("user", F.lit("_")), la)
        sugg = overlay.suggestion_status(sug.withColumn("user", F.lit("_")), la)
        manual = overlay.manual_codes(la)
    else:
        codes = codes.withColumn("removed", safe_bool("removed", codes.schema["removed"].dataType)) \
            .withColumn("manuel", F.lit(False))
        sugg = sug.withColumn("status", F.lit("pending")).withColumn("amended", F.lit(False)) \
            .withColumn("confiance", safe_int("confiance", sug.schema["confiance"].dataType, 0))
        manual = None
    code_fields = [F.col("code_id").alias("id"), "code", "type", "libelle", "date", "removed", "manuel"]
    sug_fields = [F.col("suggestion_id").alias("id"), "code", "type", "libelle", "confiance",
                  F.struct(F.col("source_kind").alias("kind"), F.col("source_id").alias("id")).alias("source"),
                  "justification", "status", "amended", F.col("regle_id").alias("regleId"), "highlight"]

    parts = {
        "parcours": _ordered_list(t["parcours"], k, "pos",
                                  [F.col("event_id").alias("id"), "date", "heure", "type", "titre",
                                   "detail", "uf"], "parcours"),
        "documents": _ordered_list(docs, k, "pos", doc_fields, "documents"),
        "fiches": _ordered_list(forms, k, "first_pos", form_fields, "fiches"),
        "observations": _ordered_list(obs, k, "_chrono", obs_fields, "observations"),
        "constantes": _ordered_list(t["constantes"], k, "pos",
                                    ["date", safe_int("fc", t["constantes"].schema["fc"].dataType, None)
                                     .alias("fc"), "ta", "spo2", "temp", "poids"], "constantes"),
        "biologie": _ordered_list(t["biologie"], k, "pos", ["date", "code", "valeur", "unite"], "biologie"),
        "medicaments": _numbered_list(meds, chrono, med_fields),
        "codesValides": _ordered_list(codes, k, "pos", code_fields, "codesValides"),
        "suggestions": _ordered_list(sugg, k, "pos", sug_fields, "suggestions"),
    }
    if manual is not None:
        # codes added by hand come after the clinician's, by item id
        manual = manual.withColumn("date", F.col("date").cast(codes.schema["date"].dataType))
        parts["_manual"] = _ordered_list(manual, k, "code_id", code_fields, "_manual")
    st = t["sejours"]
    stays = st.select(*k, "ordre", "pos", "service", "entree", "sortie")
    for name, part in parts.items():
        stays = stays.join(part, k, "left")
    empty = {n: F.coalesce(F.col(n), F.array()) for n in parts}
    if manual is not None:
        empty["codesValides"] = F.concat(empty["codesValides"], empty.pop("_manual"))
    stay_struct = F.struct(F.col("id_sejour").alias("idSejour"), "service", "entree", "sortie",
                           *[column.alias(n) for n, column in empty.items()])
    # duplicate stay rows: the last by ordre supplies the map value
    order = F.struct(F.col("ordre").isNull().alias("n"), F.col("ordre").alias("o"), F.col("pos").alias("p"))
    return stays.groupBy(*k).agg(F.max_by(stay_struct, order).alias("stay"))


def _text_fields():
    """Output fields of documents, forms and observations."""
    return ([F.col("doc_id").alias("id"), "date", "type", "titre", "uf", "excerpt",
             F.col("full_text").alias("fullText"), "highlights"],
            [F.col("fiche_id").alias("id"), "titre", "type", "date", "uf", "highlights", "champs"],
            [F.col("observation_id").alias("id"), "date", "uf", "categorie", "highlights", "texte"])


def _per_patient(t: Mapping[str, DataFrame], per_stay: DataFrame) -> DataFrame:
    doc_fields, form_fields, obs_fields = _text_fields()
    st = t["sejours"]
    order = F.struct(F.col("ordre").isNull().alias("n"), F.col("ordre").alias("o"), F.col("pos").alias("p"))
    no_stays = F.from_json(F.lit("{}"), T.MapType(T.StringType(), per_stay.schema["stay"].dataType))
    stay_map = per_stay.groupBy("patient_id").agg(
        F.map_from_entries(F.collect_list(F.struct("id_sejour", "stay"))).alias("sejours"))
    stay_order = st.groupBy("patient_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), F.col("id_sejour").alias("s")))),
                    lambda x: x["s"]).alias("sejourOrder"))

    def outside(name, fields):
        rows = t[name].where(F.col("id_sejour").isNull())
        if name == "fiches":
            rows = assemble_forms(rows).withColumn("pos", F.col("first_pos"))
        rows = rows.withColumn("highlights", F.array().cast("array<string>"))
        return _ordered_list(rows, ["patient_id"], "pos", fields, name)

    hors = [outside("documents", doc_fields), outside("fiches", form_fields),
            outside("observations", obs_fields)]

    pat = t["patients"]
    ident = first_row(pat, ["patient_id"], "pos", ["sexe", "age"]).select(
        "patient_id", F.struct(F.col("patient_id").alias("id"), "sexe",
                               safe_int("age", pat.schema["age"].dataType, 0).alias("age")).alias("identity"))
    out = ident.join(stay_order, "patient_id", "left").join(stay_map, "patient_id", "left")
    for h in hors:
        out = out.join(h, "patient_id", "left")
    return out.select(
        "patient_id", "identity",
        F.coalesce("sejourOrder", F.array().cast("array<string>")).alias("sejourOrder"),
        F.coalesce("sejours", no_stays).alias("sejours"),
        F.struct(*[F.coalesce(F.col(n), F.array()).alias(n)
                   for n in ("documents", "fiches", "observations")]).alias("horsSejour"))


CHILDREN = ("parcours", "documents", "fiches", "observations", "constantes", "biologie", "medicaments", "codesValides",
            "suggestions")
OUTSIDE = ("documents", "fiches", "observations")


def flatten_dossiers(dossiers: DataFrame) -> dict[str, DataFrame]:
    """Nested records back to the eleven flat tables: patients, stays and one
    table per child list, rows outside any stay with a NULL ``id_sejour``.  Each
    row keeps its place in its list as ``pos``; every table is one projection
    and explode over the records, without a shuffle."""
    stays = dossiers.select("patient_id", F.explode("sejours").alias("id_sejour", "_s"))
    out = {
        "patients": dossiers.select("patient_id", "identity.sexe", "identity.age"),
        "sejours": dossiers.select("patient_id", F.posexplode("sejourOrder").alias("ordre", "id_sejour"), "sejours").select(
            "patient_id", "ordre", "id_sejour", *[F.try_element_at("sejours", F.col("id_sejour"))[c].alias(c)
                                                  for c in ("service", "entree", "sortie")]),
    }
    for name in CHILDREN:
        rows = stays.select("patient_id", "id_sejour", F.posexplode(F.col("_s")[name]).alias("pos", "_x"))
        if name in OUTSIDE:
            rows = rows.unionByName(dossiers.select(
                "patient_id", F.lit(None).cast("string").alias("id_sejour"),
                F.posexplode(F.col("horsSejour")[name]).alias("pos", "_x")))
        out[name] = rows.select("patient_id", "id_sejour", "pos", "_x.*")
    return out


def flatten_rows(dossiers: DataFrame) -> DataFrame:
    """The tables of ``flatten_dossiers`` as one, in one pass over the records,
    which then need not be written: patient_id, id_sejour, ``kind`` (the table),
    ``pos`` (the stay's place in the patient's order, for stays), and for each
    table a struct of its other columns, NULL in rows of other kinds."""
    stay = dossiers.schema["sejours"].dataType.valueType
    of_stay = lambda s: F.struct(*[F.try_element_at("sejours", s)[c].alias(c) for c in ("service", "entree", "sortie")])
    person = F.struct("identity.sexe", "identity.age")
    none = F.lit(None).cast("string")
    types = {name: stay[name].dataType.elementType for name in CHILDREN}
    types |= {"sejours": T.StructType([stay[c] for c in ("service", "entree", "sortie")]),
              "patients": T.StructType([dossiers.schema["identity"].dataType[c] for c in ("sexe", "age")])}

    def row(kind: str, id_sejour: Column, pos: Column, value: Column) -> Column:
        fields = [(value if name == kind else F.lit(None)).cast(_nullable(t)).alias(name) for name, t in types.items()]
        return F.struct(id_sejour.alias("id_sejour"), F.lit(kind).alias("kind"), pos.cast("int").alias("pos"), *fields)
    parts = [F.array(row("patients", none, F.lit(None), person)),
             F.transform("sejourOrder", lambda s, i: row("sejours", s, i, of_stay(s)))]
    def children(kind: str, values: Column, id_sejour: Column) -> Column:
        return F.transform(values, lambda x, i: row(kind, id_sejour, i, x))

    def of_stays(kind: str) -> Column:
        return F.flatten(F.transform(F.map_entries("sejours"), lambda e: children(kind, e["value"][kind], e["key"])))
    for name in CHILDREN:
        parts.append(of_stays(name))
        if name in OUTSIDE:
            parts.append(children(name, F.col("horsSejour")[name], none))
    return dossiers.select("patient_id", F.explode(F.concat(*parts)).alias("_x")).select("patient_id", "_x.*")


def _nullable(t: T.DataType) -> T.DataType:
    """``t`` with every part nullable, so that rows of all kinds have one type."""
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, _nullable(f.dataType)) for f in t.fields])
    if isinstance(t, T.ArrayType):
        return T.ArrayType(_nullable(t.elementType))
    return t
