"""Registered queries: the rule dictionary (part = rules, lineitem rows =
conditions, supplier rows = comments, patches and replacement conditions)."""
from __future__ import annotations

from pyspark.sql import functions as F

from recordfold.operators import rules
from recordfold.plans import adapters as ad
from recordfold.plans.oracle import with_ctes
from recordfold.plans.queries import register


@register("rule_decode", with_ctes(["conds"], """
SELECT rule_id, ordre, operateur,
       CASE WHEN operateur <> 'wordlist' THEN valeur END AS valeur,
       CASE WHEN operateur = 'wordlist' THEN array_to_string(coalesce(string_split(valeur, '|'), []), ',') END AS terms,
       CASE WHEN operateur = 'wordlist' THEN CAST(len(coalesce(string_split(valeur, '|'), [])) AS BIGINT) ELSE 0 END AS n_terms
FROM conds"""))
def q_rule_decode(spark, sf_dir):
    dec = rules.decode_values(ad.rule_conditions(spark, sf_dir))
    return dec.select("rule_id", "ordre", "operateur", "valeur",
                      F.array_join("terms", ",").alias("terms"),
                      # size(NULL) is -1 when ANSI mode is off: guard the NULL list
                      F.when(F.col("terms").isNull(), F.lit(0)).otherwise(F.size("terms"))
                      .cast("bigint").alias("n_terms"))


@register("rule_catalog", with_ctes(["rules", "conds", "comments"], """
SELECT r.id, r.titre, coalesce(c.n, 0) AS n_conditions, c.first_operateur, coalesce(m.n, 0) AS n_comments
FROM rules r
LEFT JOIN (SELECT rule_id, count(*) AS n, arg_min(operateur, (ordre IS NULL, ordre, operateur)) AS first_operateur
           FROM conds GROUP BY rule_id) c ON c.rule_id = r.id
LEFT JOIN (SELECT rule_id, count(*) AS n FROM comments GROUP BY rule_id) m ON m.rule_id = r.id"""))
def q_rule_catalog(spark, sf_dir):
    out = rules.catalog(ad.rule_table(spark, sf_dir), ad.rule_conditions(spark, sf_dir),
                        ad.rule_comments(spark, sf_dir))
    return out.select("id", "titre", "n_conditions", "first_operateur", "n_comments")


RULE_QUERY = "12"


@register("rule_search", with_ctes(["rules"], """
SELECT id, code, titre FROM rules WHERE contains(lower(code), '12') OR contains(lower(id), '12')"""))
def q_rule_search(spark, sf_dir):
    return rules.search(ad.rule_table(spark, sf_dir), RULE_QUERY).select("id", "code", "titre")


@register("rule_patch", with_ctes(["rules", "patches", "patch1"], """
SELECT r.id, coalesce(p.titre, r.titre) AS titre, coalesce(p.logique, r.logique) AS logique,
       coalesce(p.description, r.description) AS description,
       CASE WHEN p.id IS NOT NULL THEN 'patched' ELSE 'unchanged' END AS status
FROM rules r LEFT JOIN patch1 p ON p.id = r.id
UNION ALL
SELECT p.id, p.titre, p.logique, p.description, 'unknown' AS status
FROM patches p WHERE p.id NOT IN (SELECT id FROM rules)"""))
def q_rule_patch(spark, sf_dir):
    updated, unknown = rules.patch(ad.rule_table(spark, sf_dir), ad.rule_patches(spark, sf_dir))
    cols = ["id", "titre", "logique", "description", "status"]
    return updated.select(*cols).unionByName(unknown.withColumn("status", F.lit("unknown")).select(*cols))


@register("params_replace", with_ctes(["rules", "conds", "new_conds"], """
WITH known AS (SELECT * FROM new_conds WHERE rule_id IN (SELECT id FROM rules))
SELECT rule_id, ordre, champ, operateur, valeur, 'kept' AS origin FROM conds
WHERE rule_id NOT IN (SELECT rule_id FROM known)
UNION ALL
SELECT rule_id, ordre, champ, operateur, valeur, 'new' AS origin FROM known""").replace(
    "\nWITH known AS", ",\nknown AS"))
def q_params_replace(spark, sf_dir):
    out = rules.replace_conditions(ad.rule_conditions(spark, sf_dir), ad.new_rule_conditions(spark, sf_dir),
                                   ad.rule_table(spark, sf_dir))
    return out.select("rule_id", "ordre", "champ", "operateur", "valeur", "origin")


@register("comment_accept", with_ctes(["rules", "comments"], """
SELECT c.id, c.rule_id, c.t AS texte,
       CASE WHEN c.t = '' OR c.t IS NULL THEN 'empty'
            WHEN c.rule_id NOT IN (SELECT id FROM rules) THEN 'unknown_rule' ELSE 'ok' END AS reason,
       (c.t <> '' AND c.rule_id IN (SELECT id FROM rules)) AS accepted
FROM (SELECT *, regexp_replace(texte, '^\\s+|\\s+$', '', 'g') AS t FROM comments) c"""))
def q_comment_accept(spark, sf_dir):
    out = rules.accept_comments(ad.rule_comments(spark, sf_dir), ad.rule_table(spark, sf_dir))
    return out.select("id", "rule_id", "texte", "reason", "accepted")


@register("suggestion_rule", with_ctes(["rules"], """
SELECT s.suggestion_id, s.l_partkey, s.regle_id, r.titre AS rule_titre, r.code AS rule_code
FROM (SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS suggestion_id, l_partkey,
             CASE WHEN l_linenumber = 7 THEN 'RG-X' ELSE 'RG-' END || CAST(l_partkey AS VARCHAR) AS regle_id
      FROM lineitem) s LEFT JOIN rules r ON r.id = s.regle_id"""))
def q_suggestion_rule(spark, sf_dir):
    """Every line item as a suggestion carrying the id of the rule (its part)
    that produced it; line 7 cites a rule that does not exist."""
    li = ad.table(spark, sf_dir, "lineitem")
    prefix = F.when(F.col("l_linenumber") == 7, F.lit("RG-X")).otherwise(F.lit("RG-"))
    sugg = li.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("suggestion_id"), "l_partkey",
                     F.concat(prefix, F.col("l_partkey").cast("string")).alias("regle_id"))
    out = rules.rule_badges(sugg, ad.rule_table(spark, sf_dir))
    return out.select("suggestion_id", "l_partkey", "regle_id", "rule_titre", "rule_code")


@register("rule_catalog_nested", with_ctes(["rules", "conds", "comments"], """
SELECT r.id, coalesce(c.ops, '') AS operateurs, coalesce(c.n, 0) AS n_conditions,
       CAST(coalesce(c.n_terms, 0) AS BIGINT) AS n_terms, coalesce(m.n, 0) AS n_comments
FROM rules r
LEFT JOIN (SELECT rule_id, count(*) AS n,
                  string_agg(operateur, '|' ORDER BY ordre, operateur) AS ops,
                  sum(CASE WHEN operateur = 'wordlist' THEN len(coalesce(string_split(valeur, '|'), [])) ELSE 0 END) AS n_terms
           FROM conds GROUP BY rule_id) c ON c.rule_id = r.id
LEFT JOIN (SELECT rule_id, count(*) AS n FROM comments GROUP BY rule_id) m ON m.rule_id = r.id"""))
def q_rule_catalog_nested(spark, sf_dir):
    """Nested catalogue (J5 as the dictionary returns it): conditions in
    ``ordre`` order with decoded word lists, and comments, per rule."""
    cat = rules.catalog_nested(ad.rule_table(spark, sf_dir), ad.rule_conditions(spark, sf_dir),
                               ad.rule_comments(spark, sf_dir))
    terms = F.aggregate("parametres", F.lit(0).cast("bigint"),
                        lambda acc, p: acc + F.when(p["terms"].isNull(), F.lit(0)).otherwise(F.size(p["terms"])))
    return cat.select("id", F.array_join(F.transform("parametres", lambda p: p["operateur"]), "|").alias("operateurs"),
                      F.size("parametres").cast("bigint").alias("n_conditions"), terms.alias("n_terms"),
                      F.size("commentaires").cast("bigint").alias("n_comments"))


@register("rule_versions", with_ctes(["rules", "patches", "patch1"], """
SELECT r.id, coalesce(p.titre, r.titre) AS titre, coalesce(p.logique, r.logique) AS logique,
       coalesce(p.description, r.description) AS description, 2 AS version
FROM rules r LEFT JOIN patch1 p ON p.id = r.id"""))
def q_rule_versions(spark, sf_dir):
    """The rule table saved as version 1, edited, saved as version 2, and read
    back as readers see it."""
    from recordfold.session import scratch_path
    from recordfold.sources import rule_store
    root = scratch_path(spark, "rule-store")
    rule_store.save_version(ad.rule_table(spark, sf_dir), root, "rules", 1)
    updated, _ = rules.patch(rule_store.read_current(spark, root, "rules"), ad.rule_patches(spark, sf_dir))
    rule_store.save_version(updated, root, "rules", 2)
    current = rule_store.read_current(spark, root, "rules")
    return current.select("id", "titre", "logique", "description",
                          F.lit(rule_store.current_version(spark, root, "rules")).alias("version"))


@register("rule_encode", with_ctes(["conds"], """
SELECT rule_id, ordre, CASE WHEN operateur = 'wordlist' THEN coalesce(valeur, '') END AS stored FROM conds"""))
def q_rule_encode(spark, sf_dir):
    """Word lists as arrays, stored as one text again."""
    dec = rules.decode_values(ad.rule_conditions(spark, sf_dir))
    enc = rules.encode_values(dec.select("rule_id", "ordre", F.col("terms").alias("valeur")))
    return enc.select("rule_id", "ordre", F.col("valeur").alias("stored"))
