"""The rule dictionary as DataFrame operations: condition encoding, the
catalogue join, search, partial updates, condition replacement and comment
validation.  The dictionary is small next to the records, but none of this
relies on that: every step is a join or an aggregate on the rule id.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordfold.functions.scalars import strip_ws

WORDLIST = "wordlist"


def encode_values(conditions: DataFrame, col: str = "valeur") -> DataFrame:
    """List-valued conditions stored as one '|'-joined text."""
    t = conditions.schema[col].dataType
    if hasattr(t, "elementType"):
        return conditions.withColumn(col, F.array_join(F.col(col), "|"))
    return conditions


def decode_values(conditions: DataFrame) -> DataFrame:
    """Add ``terms`` (array) for 'wordlist' conditions -- NULL text gives an
    empty list -- and keep ``valeur`` as text for the others."""
    is_list = F.col("operateur") == WORDLIST
    terms = F.when(is_list, F.coalesce(F.split(F.col("valeur"), r"\|"), F.array().cast("array<string>")))
    return (conditions.withColumn("terms", terms)
            .withColumn("valeur", F.when(~is_list | F.col("operateur").isNull(), F.col("valeur"))))


def catalog(rules: DataFrame, conditions: DataFrame, comments: DataFrame) -> DataFrame:
    """Flat catalogue: each rule with its number of conditions, its first
    condition's operator (by ``ordre``) and its number of comments."""
    order = F.struct(F.col("ordre").isNull(), F.col("ordre"), F.col("operateur"))
    c = conditions.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n_conditions"),
                                          F.min_by("operateur", order).alias("first_operateur"))
    m = comments.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n_comments"))
    out = (rules.join(c.withColumnRenamed("rule_id", "id"), "id", "left")
           .join(m.withColumnRenamed("rule_id", "id"), "id", "left"))
    return (out.withColumn("n_conditions", F.coalesce("n_conditions", F.lit(0)).cast("bigint"))
            .withColumn("n_comments", F.coalesce("n_comments", F.lit(0)).cast("bigint")))


def catalog_nested(rules: DataFrame, conditions: DataFrame, comments: DataFrame) -> DataFrame:
    """Nested catalogue (one row per rule): ``parametres`` ordered by ``ordre``
    and ``commentaires``, each collected per rule before the join."""
    dec = decode_values(conditions)
    cond = F.struct("champ", "operateur", "valeur", "terms", "flags")
    key = F.struct(F.col("ordre").isNull().alias("n"), F.col("ordre").alias("o"))
    c = dec.groupBy("rule_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct(key.alias("k"), cond.alias("c")))), lambda x: x["c"])
        .alias("parametres"))
    # comments by date, then id (undated ones first)
    m = comments.groupBy("rule_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct(F.struct("date", "id").alias("k"), F.struct(
            "id", "auteur", "date", "texte").alias("c")))), lambda x: x["c"]).alias("commentaires"))
    out = (rules.join(c.withColumnRenamed("rule_id", "id"), "id", "left")
           .join(m.withColumnRenamed("rule_id", "id"), "id", "left"))
    return (out.withColumn("parametres", F.coalesce("parametres", F.array()))
            .withColumn("commentaires", F.coalesce("commentaires", F.array())))


def search(rules: DataFrame, query: str) -> DataFrame:
    """Rules whose code *or* id contains the query, case-insensitively."""
    q = (query or "").strip().lower()
    if not q:
        return rules
    return rules.where(F.lower("code").contains(q) | F.lower("id").contains(q))


PATCHABLE = ("titre", "logique", "description")


def fold_patches(patches: DataFrame, order: str = "pos") -> DataFrame:
    """One patch per rule: each field's last non-NULL value in ``order``
    (without such a column, the greatest value)."""
    at = F.col(order) if order in patches.columns else None
    last = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(F.lit(0) if at is None else at, c))).alias(c)
            for c in PATCHABLE]
    return patches.groupBy("id").agg(*last)


def patch(rules: DataFrame, patches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply partial updates (NULL field = unchanged); several patches of one
    rule are folded first, so a rule stays one row.  Returns the updated rules
    (with ``status`` 'patched'/'unchanged') and the patches whose rule id is
    unknown (the error set)."""
    p = fold_patches(patches).select(F.col("id"), *[F.col(c).alias(f"_new_{c}") for c in PATCHABLE],
                                     F.lit(True).alias("_hit"))
    j = rules.join(p, "id", "left")
    for c in PATCHABLE:
        j = j.withColumn(c, F.coalesce(F.col(f"_new_{c}"), F.col(c)))
    j = j.withColumn("status", F.when(F.col("_hit"), "patched").otherwise("unchanged"))
    updated = j.drop("_hit", *[f"_new_{c}" for c in PATCHABLE])
    unknown = patches.join(rules.select("id"), "id", "left_anti")
    return updated, unknown


def replace_conditions(conditions: DataFrame, new_conditions: DataFrame,
                       rules: DataFrame, cleared: DataFrame | None = None) -> DataFrame:
    """A rule's conditions are replaced as a whole by its new ones; new
    conditions of unknown rules are ignored (the update is refused).

    With a column ``edit`` in ``new_conditions``, only a rule's last edit
    counts.  ``cleared`` (rule_id) names rules replaced by an empty list: they
    lose all their conditions."""
    known_new = new_conditions.join(rules.select(F.col("id").alias("rule_id")), "rule_id", "left_semi")
    if "edit" in new_conditions.columns:
        last = known_new.groupBy("rule_id").agg(F.max("edit").alias("edit"))
        known_new = known_new.join(last, ["rule_id", "edit"], "left_semi").drop("edit")
    replaced = known_new.select("rule_id")
    if cleared is not None:
        replaced = replaced.union(cleared.select("rule_id"))
        known_new = known_new.join(cleared.select("rule_id"), "rule_id", "left_anti")
    kept = conditions.join(replaced.distinct(), "rule_id", "left_anti")
    return (kept.withColumn("origin", F.lit("kept"))
            .unionByName(known_new.withColumn("origin", F.lit("new"))))


def accept_comments(comments: DataFrame, rules: DataFrame) -> DataFrame:
    """Validate incoming comments: text trimmed; rejected if empty or if the
    rule does not exist.  ``reason`` is 'ok', 'empty' or 'unknown_rule'."""
    known = rules.select(F.col("id").alias("rule_id"), F.lit(True).alias("_known")).distinct()
    j = comments.withColumn("texte", strip_ws("texte")).join(known, "rule_id", "left")
    empty = F.col("texte").isNull() | (F.col("texte") == "")
    reason = (F.when(empty, "empty").when(F.col("_known").isNull(), "unknown_rule").otherwise("ok"))
    return j.withColumn("reason", reason).withColumn("accepted", F.col("reason") == "ok").drop("_known")


def new_comment_ids(comments: DataFrame) -> DataFrame:
    """Random 8-hex ids and a UTC second timestamp for comments being added."""
    return (comments.withColumn("id", F.substring(F.md5(F.expr("uuid()")), 1, 8))
            .withColumn("date", F.date_trunc("second", F.current_timestamp()).cast("timestamp_ntz")))


def rule_badges(suggestions: DataFrame, rules: DataFrame) -> DataFrame:
    """Each suggestion with the title and code of the rule that produced it
    (NULL when the rule id is unknown)."""
    r = rules.select(F.col("id").alias("regle_id"), F.col("titre").alias("rule_titre"),
                     F.col("code").alias("rule_code"))
    return suggestions.join(r, "regle_id", "left")
