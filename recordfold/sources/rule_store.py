"""The rule dictionary on storage, and its built-in seed.

Three tables -- rules, rule conditions (``rules_parametres``) and comments --
plus our own ``rule_outputs`` (how a rule picks the code it emits when that is
not a single fixed code).  Edits never overwrite the files being read: each
save appends a new version ``v=<n>`` and readers keep the highest version, so
a failed job leaves the previous version intact.
"""
from __future__ import annotations

import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from recordfold.schemas import RULE_COMMENTS, RULE_OUTPUTS, RULE_PARAMS, RULES
from recordfold.sources.ingest import conform, empty

# --- fixed values: the built-in rule catalogue ------------------------------
# (id, titre, categorie, code, libelle, type)
BUILTIN_RULES = [
    ("RG-01", "Antécédent codé lors d'un séjour précédent", "Antécédent", "E11.9",
     "Diabète de type 2, sans complication (exemple)", "CIM-10"),
    ("RG-02", "Insulinothérapie pendant le séjour", "Médicament", "E11.9",
     "Diabète de type 2, sans complication", "CIM-10"),
    ("RG-03", "Double antiagrégation après pose de stent", "Médicament", "Z95.5",
     "Présence d'un implant et d'une greffe cardiaques et vasculaires — endoprothèse coronaire", "CIM-10"),
    ("RG-04", "Mention de cardiopathie ischémique", "Mots-clés", "I25.9",
     "Cardiopathie ischémique chronique, sans précision", "CIM-10"),
    ("RG-05", "Insuffisance rénale, aiguë ou chronique", "Mots-clés", "N17.9 / N18.9",
     "Insuffisance rénale aiguë, SP / Maladie rénale chronique, SP", "CIM-10"),
    ("RG-06", "DFG abaissé → maladie rénale chronique", "Seuil biologique", "N18.2 / N18.3 / N18.4",
     "Maladie rénale chronique, stade 2 / 3 / 4 selon le DFG mesuré", "CIM-10"),
    ("RG-07", "Hypokaliémie", "Seuil biologique", "E87.6", "Hypokaliémie", "CIM-10"),
    ("RG-08", "Pose de sonde vésicale à demeure", "Acte", "JDLD001",
     "Pose d'une sonde vésicale à demeure", "CCAM"),
    ("RG-09", "Lexique clinique générique dans les documents", "Mots-clés", "(variable)",
     "Dépend du terme détecté — voir le lexique en paramètres", "CIM-10"),
    ("RG-10", "Mentions dans les fiches de liaison et de suivi", "Fiche", "(variable)",
     "Dépend du terme détecté — voir le lexique en paramètres", "CIM-10"),
    ("RG-11", "Mentions dans les observations médicales", "Observation", "(variable)",
     "Dépend du terme détecté — voir le lexique en paramètres", "CIM-10"),
]
# (rule_id, ordre, champ, operateur, valeur, flags); list values joined by '|'
BUILTIN_CONDITIONS = [
    ("RG-01", 0, "codes_valides.code", "present_in_prior_sejour", None, None),
    ("RG-02", 0, "medicaments.atc", "startswith", "A10", None),
    ("RG-03", 0, "medicaments.atc", "startswith", "B01AC", None),
    ("RG-03", 1, "parcours.titre", "regex", "endoproth[eè]se coronaire|pose.*stent", "i"),
    ("RG-04", 0, "documents.full_text", "regex", r"cardiopath(?:ie)?\s+isch[ée]miqu\w*", "i"),
    ("RG-05", 0, "documents.full_text", "regex", r"insuffisance\s+r[ée]nale\s+(aigu[eë]|chronique)", "i"),
    ("RG-06", 0, "biologie.dfg", "lt", "60", None),
    ("RG-07", 0, "biologie.k", "lt", "3.5", None),
    ("RG-08", 0, "parcours.titre", "regex", r"sonde\s+v[ée]sicale|cath[ée]ter\s+urinaire", "i"),
    ("RG-09", 0, "documents.full_text", "wordlist",
     "stent actif|prothèse totale de hanche|coxarthrose|foyer de condensation alvéolaire", None),
    ("RG-10", 0, "fiches.champ_valeur", "wordlist", "aide pour la toilette|toux productive", None),
    ("RG-11", 0, "observations.texte", "wordlist", "dyspnée|douleur", None),
]
# (rule_id, mode, key, code, rank): matched term / captured group / band upper bound
BUILTIN_OUTPUTS = [
    ("RG-05", "capture", "aiguë", "N17.9", 0),
    ("RG-05", "capture", "aigue", "N17.9", 0),
    ("RG-05", "capture", "chronique", "N18.9", 1),
    ("RG-06", "band", "30", "N18.4", 0),
    ("RG-06", "band", "45", "N18.3", 1),
    ("RG-06", "band", "60", "N18.2", 2),
    ("RG-09", "term", "stent actif", "DDAF004", 0),
    ("RG-09", "term", "prothèse totale de hanche", "Z96.6", 0),
    ("RG-09", "term", "coxarthrose", "M16.1", 0),
    ("RG-09", "term", "foyer de condensation alvéolaire", "J18.1", 0),
    ("RG-10", "term", "aide pour la toilette", "Z74.1", 0),
    ("RG-10", "term", "toux productive", "R05", 0),
    ("RG-11", "term", "dyspnée", "R06.0", 0),
    ("RG-11", "term", "douleur", "R52", 0),
]
# ---------------------------------------------------------------------------

NAMES = {"rules": RULES, "rules_parametres": RULE_PARAMS, "rules_commentaires": RULE_COMMENTS,
         "rule_outputs": RULE_OUTPUTS}


def builtin_tables(spark: SparkSession) -> dict[str, DataFrame]:
    """The seed catalogue as DataFrames (rules, conditions, outputs, no comments)."""
    # the seed has no stored logic or description text: both stay NULL until edited
    rules = [(i, t, c, None, code, lib, ty, None) for i, t, c, code, lib, ty in BUILTIN_RULES]
    return {
        "rules": spark.createDataFrame(rules, RULES),
        "rules_parametres": spark.createDataFrame(BUILTIN_CONDITIONS, RULE_PARAMS),
        "rules_commentaires": empty(spark, RULE_COMMENTS),
        "rule_outputs": spark.createDataFrame(BUILTIN_OUTPUTS, RULE_OUTPUTS),
    }


def _path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}"


def read_current(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Highest version of a rule table; absent -> empty table with its columns."""
    schema, version = NAMES[name], current_version(spark, root, name)
    # the version is a folder: its number is known before any row is read
    rows = _folder(spark, f"{_path(root, name)}/v={version}", schema)
    return rows.unionByName(_folder(spark, _added(root, version), schema)) if name == "rules_commentaires" else rows


def _folder(spark: SparkSession, path: str, schema) -> DataFrame:
    try:
        df = spark.read.parquet(path)
        df.schema  # noqa: B018
    except AnalysisException:
        return empty(spark, schema)
    return conform(df, schema)


def save_version(df: DataFrame, root: str, name: str, version: int) -> None:
    """Write ``df`` as version ``version`` of a table (older versions stay).  A
    version is written once: a second edit of it fails instead of merging."""
    cols = [f.name for f in NAMES[name].fields]
    df.select(*cols).write.mode("errorifexists").parquet(f"{_path(root, name)}/v={version}")


def current_version(spark: SparkSession, root: str, name: str) -> int:
    """Highest version folder of a table, 0 without one (no row is read)."""
    try:
        files = spark.read.parquet(_path(root, name)).inputFiles()
    except AnalysisException:
        return 0
    found = [re.search(r"/v=(\d+)/", f) for f in files]
    return max((int(m[1]) for m in found if m), default=0)


def ensure_initialized(spark: SparkSession, root: str) -> None:
    """Seed the built-in catalogue when no rule table exists yet."""
    if current_version(spark, root, "rules") > 0:
        return
    for name, df in builtin_tables(spark).items():
        save_version(df, root, name, 1)


def load_rule_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    ensure_initialized(spark, root)
    return {n: read_current(spark, root, n) for n in NAMES}


def append_comments(comments: DataFrame, root: str, spark: SparkSession, batch_id: str | None = None) -> None:
    """Add accepted comments.  Only their own rows are written, as a batch that
    belongs to the table's current version (``read_current`` merges them);
    writing the same ``batch_id`` again replaces that batch.  Saving a whole new
    version starts without the batches of the one before."""
    v = current_version(spark, root, "rules_commentaires")
    cols = [f.name for f in RULE_COMMENTS.fields]
    comments.select(*cols).write.mode("overwrite").parquet(f"{_added(root, v)}/batch={batch_id or uuid.uuid4().hex}")


def _added(root: str, version: int) -> str:
    return f"{_path(root, 'rules_commentaires_ajouts')}/v={version}"


def fold_comments(spark: SparkSession, root: str) -> None:
    """Save the current version and its batches as the next version (a reader of
    the older one keeps its files)."""
    v = current_version(spark, root, "rules_commentaires")
    save_version(read_current(spark, root, "rules_commentaires"), root, "rules_commentaires", v + 1)
