"""Explicit schemas of the review domain (no inference at read time)."""
from __future__ import annotations

from pyspark.sql import types as T

S, I, D, B, DT, TS, L = (T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType(),
                         T.DateType(), T.TimestampNTZType(), T.LongType())


def _st(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


TABLES: dict[str, T.StructType] = {
    "patients": _st(("patient_id", S), ("sexe", S), ("age", I)),
    "sejours": _st(("patient_id", S), ("ordre", I), ("id_sejour", S), ("service", S),
                   ("entree", DT), ("sortie", DT)),
    "parcours": _st(("patient_id", S), ("id_sejour", S), ("event_id", S), ("date", DT), ("heure", S),
                    ("type", S), ("titre", S), ("detail", S), ("uf", S)),
    "documents": _st(("patient_id", S), ("id_sejour", S), ("doc_id", S), ("date", DT), ("type", S),
                     ("titre", S), ("uf", S), ("excerpt", S), ("full_text", S)),
    "fiches": _st(("patient_id", S), ("id_sejour", S), ("fiche_id", S), ("titre", S), ("type", S),
                  ("date", DT), ("uf", S), ("champ_ordre", I), ("champ_label", S), ("champ_valeur", S)),
    "observations": _st(("patient_id", S), ("id_sejour", S), ("observation_id", S), ("date", DT),
                        ("uf", S), ("categorie", S), ("texte", S)),
    "constantes": _st(("patient_id", S), ("id_sejour", S), ("date", S), ("fc", S), ("ta", S),
                      ("spo2", S), ("temp", S), ("poids", S)),
    "biologie": _st(("patient_id", S), ("id_sejour", S), ("date", S), ("code", S), ("valeur", D),
                    ("unite", S)),
    "medicaments": _st(("patient_id", S), ("id_sejour", S), ("nom", S), ("qte", D), ("unite", S),
                       ("atc", S), ("ucd", S), ("date_administration", TS)),
    "codes_valides": _st(("patient_id", S), ("id_sejour", S), ("code_id", S), ("code", S), ("type", S),
                         ("libelle", S), ("date", DT), ("removed", S)),
    "suggestions": _st(("patient_id", S), ("id_sejour", S), ("suggestion_id", S), ("code", S),
                       ("type", S), ("libelle", S), ("confiance", S), ("source_kind", S),
                       ("source_id", S), ("justification", S), ("regle_id", S), ("highlight", S)),
}

# Decision log; ``seq`` (append order) breaks ties between equal timestamps.
ANNOTATIONS = _st(("timestamp", TS), ("user", S), ("patient_id", S), ("id_sejour", S),
                  ("item_type", S), ("item_id", S), ("action", S), ("code", S), ("libelle", S),
                  ("type_code", S), ("commentaire", S), ("seq", L))

RULES = _st(("id", S), ("titre", S), ("categorie", S), ("logique", S), ("code", S), ("libelle", S),
            ("type", S), ("description", S))
RULE_PARAMS = _st(("rule_id", S), ("ordre", I), ("champ", S), ("operateur", S), ("valeur", S),
                  ("flags", S))
RULE_COMMENTS = _st(("id", S), ("rule_id", S), ("auteur", S), ("date", TS), ("texte", S))
# How a rule's emitted code is chosen when it is not the rule's own code:
# mode 'term' (matched word -> code), 'capture' (captured group -> code; the
# lowest rank found in the stay wins), 'band' (the last value of the stay is
# below the bound ``key`` -> code; the lowest bound wins).
RULE_OUTPUTS = _st(("rule_id", S), ("mode", S), ("key", S), ("code", S), ("rank", I))

ACCOUNTS = _st(("username", S), ("role", S))
ASSIGNMENTS = _st(("username", S), ("patient_id", S), ("pos", I))

# Text columns that hold an integer or a truth value: numeric sources are read
# as such before they become text.
INT_TEXT = {"confiance", "fc"}
BOOL_TEXT = {"removed"}

# Tables whose rows may belong to a patient but to no stay.
ALLOW_MISSING_STAY = {"documents", "fiches", "observations"}


def is_id_column(name: str) -> bool:
    return name.endswith("_id") or name.endswith("_key") or name in ("id_sejour", "ucd")
