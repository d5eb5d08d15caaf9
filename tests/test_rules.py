import tempfile

from recordfold.operators import rules
from recordfold.schemas import RULE_COMMENTS, RULE_PARAMS
from recordfold.sources import rule_store
from helpers import rows


def test_decode_encode(spark):
    c = spark.createDataFrame([("R1", 0, "t.x", "wordlist", None, None),
                               ("R1", 1, "t.x", "wordlist", "a|b", None),
                               ("R2", 0, "t.y", "lt", "60", None),
                               ("R3", 0, "t.y", "regex", None, "i")], RULE_PARAMS)
    got = rows(rules.decode_values(c), "rule_id", "ordre", "valeur", "terms")
    assert got == [("R1", 0, None, []), ("R1", 1, None, ["a", "b"]), ("R2", 0, "60", None),
                   ("R3", 0, None, None)]
    lst = spark.createDataFrame([("R1", ["x", "y"])], "rule_id string, valeur array<string>")
    assert rules.encode_values(lst).first().valeur == "x|y"


def test_catalog_search_patch_replace_comments(spark):
    b = rule_store.builtin_tables(spark)
    cat = rules.catalog(b["rules"], b["rules_parametres"], b["rules_commentaires"])
    assert dict(rows(cat, "id", "n_conditions"))["RG-03"] == 2
    nested = {r.id: r for r in rules.catalog_nested(b["rules"], b["rules_parametres"],
                                                   b["rules_commentaires"]).collect()}
    assert [p.operateur for p in nested["RG-03"].parametres] == ["startswith", "regex"]
    assert nested["RG-09"].parametres[0].terms[0] == "stent actif"
    # search by code or by id, case-insensitive
    assert sorted(r.id for r in rules.search(b["rules"], "n18").collect()) == ["RG-05", "RG-06"]
    assert [r.id for r in rules.search(b["rules"], "rg-04").collect()] == ["RG-04"]
    # an all-NULL patch is the identity; unknown ids are reported
    p = spark.createDataFrame([("RG-02", None, None, None), ("RG-99", "t", None, None)],
                              "id string, titre string, logique string, description string")
    updated, unknown = rules.patch(b["rules"], p)
    before = rows(b["rules"], "id", "titre", "logique", "description")
    assert rows(updated, "id", "titre", "logique", "description") == before
    assert [r.id for r in unknown.collect()] == ["RG-99"]
    # replacing conditions swaps the whole set of a known rule only
    new = spark.createDataFrame([("RG-03", 0, "medicaments.atc", "startswith", "B01", None),
                                 ("RG-77", 0, "x.y", "lt", "1", None)], RULE_PARAMS)
    rep = rules.replace_conditions(b["rules_parametres"], new, b["rules"])
    assert rows(rep.where("rule_id = 'RG-03'"), "ordre", "valeur", "origin") == [(0, "B01", "new")]
    assert rep.where("rule_id = 'RG-77'").count() == 0
    # comments: blank text and unknown rules are rejected
    cm = spark.createDataFrame([("c1", "RG-01", "ana", None, "  ok  "), ("c2", "RG-01", "ana", None, "   "),
                                ("c3", "RG-42", "ana", None, "bien")], RULE_COMMENTS)
    got = rows(rules.accept_comments(cm, b["rules"]), "id", "texte", "reason", "accepted")
    assert got == [("c1", "ok", "ok", True), ("c2", "", "empty", False), ("c3", "bien", "unknown_rule", False)]


def test_rule_store_versions(spark):
    root = tempfile.mkdtemp(prefix="rules-")
    t = rule_store.load_rule_tables(spark, root)
    assert t["rules"].count() == 11 and t["rules_parametres"].count() == 12
    # a new version replaces what readers see; the old one stays on storage
    patched, _ = rules.patch(t["rules"], spark.createDataFrame(
        [("RG-07", "Hypokaliémie sévère", None, None)], "id string, titre string, logique string, "
        "description string"))
    rule_store.save_version(patched, root, "rules", rule_store.current_version(spark, root, "rules") + 1)
    again = rule_store.load_rule_tables(spark, root)
    assert again["rules"].count() == 11
    assert again["rules"].where("id = 'RG-07'").first().titre == "Hypokaliémie sévère"
    c = rules.new_comment_ids(spark.createDataFrame([("RG-07", "ana", "vu")], "rule_id string, auteur string, "
                                                    "texte string"))
    rule_store.append_comments(c, root, spark)
    assert rule_store.load_rule_tables(spark, root)["rules_commentaires"].count() == 1
