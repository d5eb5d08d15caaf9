"""An invented hospital extract in the reference's table shapes.

Three patients: P1 has an old and a new stay, P2 one stay, P3 none.  Texts
are written for the tests; they exercise every built-in rule.
"""
from __future__ import annotations

import datetime as dt

from pyspark.sql import types as T

from recordfold.schemas import TABLES

D = dt.date


def _df(spark, name, data):
    """Table ``name`` with a ``pos`` column holding the row's file position."""
    schema = T.StructType(TABLES[name].fields + [T.StructField("pos", T.LongType())])
    return spark.createDataFrame([(*r, i) for i, r in enumerate(data)], schema)


def tables(spark):
    t = {}
    t["patients"] = _df(spark, "patients", [("P1", "F", 70), ("P2", "M", 55), ("P3", "F", 40),
                                            ("P1", "X", 99)])
    t["sejours"] = _df(spark, "sejours", [
        ("P1", 1, "S_OLD", "Cardiologie", D(2024, 1, 10), D(2024, 1, 20)),
        ("P1", 0, "S_NEW", "Néphrologie", D(2024, 12, 28), D(2025, 1, 10)),
        ("P2", 0, "S_B", "Orthopédie", D(2024, 3, 1), D(2024, 3, 5)),
    ])
    t["parcours"] = _df(spark, "parcours", [
        ("P1", "S_NEW", "e1", D(2024, 12, 29), "10:00", "acte", "Pose de STENT actif coronaire", None, "UF1"),
        ("P1", "S_NEW", "e2", D(2024, 12, 30), "08:30", "acte", "Sonde vésicale posée", None, "UF1"),
        ("P2", "S_B", "e3", D(2024, 3, 2), "09:00", "consult", "Consultation", None, "UF2"),
    ])
    t["documents"] = _df(spark, "documents", [
        ("P1", "S_NEW", "d1", D(2024, 12, 29), "CRH", "Compte rendu", "UF1", None,
         "Antécédent de CARDIOPATHIE ISCHÉMIQUE. Insuffisance rénale aiguë sur fond ancien. Coxarthrose droite."),
        ("P1", "S_NEW", "d2", D(2025, 1, 5), "CR", "Suivi", "UF1", None,
         "Insuffisance rénale chronique stable."),
        ("P2", "S_B", "d3", D(2024, 3, 2), "CR", "Bilan", "UF2", None,
         "Porteur d'un stent actif et d'une prothèse totale de hanche gauche."),
        ("P1", None, "d0", D(2023, 5, 1), "courrier", "Lettre", "UF9", None, "Coxarthrose connue."),
    ])
    t["fiches"] = _df(spark, "fiches", [
        ("P1", "S_NEW", "f1", "Liaison", "liaison", D(2025, 1, 2), "UF1", 2, "Mobilité", "Aide partielle"),
        ("P1", "S_NEW", "f1", "Liaison", "liaison", D(2025, 1, 2), "UF1", 0, "Motif", "Toux productive"),
        ("P1", "S_NEW", "f1", "Liaison", "liaison", D(2025, 1, 2), "UF1", 1, "Douleur", "Non"),
        ("P1", None, "f0", "Ancienne", "suivi", D(2023, 5, 1), "UF9", 0, "Note", "RAS"),
    ])
    t["observations"] = _df(spark, "observations", [
        ("P1", "S_NEW", "o1", D(2024, 12, 30), "UF1", "médicale", "Dyspnée d'effort modérée"),
        ("P2", "S_B", "o2", D(2024, 3, 3), "UF2", "médicale", "douleur à la marche"),
    ])
    t["constantes"] = _df(spark, "constantes", [
        ("P1", "S_NEW", "29/12", "88", "13/8", "96%", "37.2", "70 kg"),
        ("P1", "S_NEW", "02/01", "72 bpm", "12/7", "98%", "36.8", "69 kg"),
    ])
    t["biologie"] = _df(spark, "biologie", [
        ("P1", "S_NEW", "29/12", "dfg", 50.0, "mL/min"),
        ("P1", "S_NEW", "03/01", "dfg", 44.0, "mL/min"),   # next year: the last value
        ("P1", "S_NEW", "30/12", "dfg", 28.0, "mL/min"),
        ("P1", "S_NEW", "29/12", "k", 3.2, "mmol/L"),
        ("P2", "S_B", "02/03", "k", 4.1, "mmol/L"),
    ])
    t["medicaments"] = _df(spark, "medicaments", [
        ("P1", "S_NEW", "Aspirine", 75.0, "mg", "B01AC06", "9200004", dt.datetime(2024, 12, 29, 8, 0)),
        ("P1", "S_NEW", "Clopidogrel", 75.0, "mg", "B01AC04", "9200005", dt.datetime(2024, 12, 29, 8, 0)),
        ("P2", "S_B", "Paracétamol", 1.0, "g", "N02BE01", "9200009", dt.datetime(2024, 3, 2, 8, 0)),
    ])
    t["codes_valides"] = _df(spark, "codes_valides", [
        ("P1", "S_OLD", "cv1", "I25.1", "CIM-10", "Cardiopathie", D(2024, 1, 15), "non"),
        ("P1", "S_OLD", "cv2", "E11.9", "CIM-10", "Diabète", D(2024, 1, 15), "oui"),
        ("P1", "S_NEW", "cv3", "N18.3", "CIM-10", "MRC 3", D(2025, 1, 6), None),
    ])
    t["suggestions"] = _df(spark, "suggestions", [
        ("P1", "S_NEW", "sg1", "I25.9", "CIM-10", "Cardiopathie", "90", "document", "d1", "regex",
         "RG-04", "CARDIOPATHIE ISCHÉMIQUE"),
        ("P1", "S_NEW", "sg2", "N17.9", "CIM-10", "IRA", "n/a", "document", "d1", "regex",
         "RG-05", "Insuffisance rénale aiguë"),
        ("P1", "S_NEW", "sg3", "Z95.5", "CIM-10", "Stent", "70", "document", "d1", "x", "RG-03", ""),
        ("P1", "S_NEW", "sg4", "JDLD001", "CCAM", "Sonde", "80", "parcours", "e2", "x", "RG-08", None),
    ])
    return t
