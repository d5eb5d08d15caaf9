"""Registered queries: reshaping operators."""
from __future__ import annotations

from pyspark.sql import functions as F

from recordfold.operators import reshape
from recordfold.plans import adapters as ad
from recordfold.plans.queries import register


def _lab_raw(li):
    ln = F.col("l_linenumber")
    raw = (F.when(ln == 1, F.lit("négatif"))
           .when(ln % 2 == 0, F.concat(F.col("l_quantity").cast("string"), F.lit(" mg")))
           .otherwise(F.concat(F.col("l_quantity").cast("bigint").cast("string"), F.lit("ng/L"))))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", raw.alias("raw"))


@register("split_value_unit", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, raw,
       CASE WHEN regexp_matches(raw, '^[0-9.]') THEN TRY_CAST(regexp_extract(raw, '^([0-9.]+)\\s*(.*)', 1) AS DOUBLE) END AS valeur,
       CASE WHEN regexp_matches(raw, '^[0-9.]') THEN regexp_extract(raw, '^([0-9.]+)\\s*(.*)', 2) ELSE '' END AS unite,
       CASE WHEN NOT regexp_matches(raw, '^[0-9.]') THEN 'raw'
            WHEN contains(regexp_extract(raw, '^([0-9.]+)', 1), '.') THEN 'float' ELSE 'int' END AS valeur_kind
FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
             CASE WHEN l_linenumber = 1 THEN 'négatif'
                  WHEN l_linenumber % 2 = 0 THEN CAST(l_quantity AS VARCHAR) || ' mg'
                  ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || 'ng/L' END AS raw
      FROM lineitem) t""")
def q_split_value_unit(spark, sf_dir):
    return reshape.split_lab_values(_lab_raw(ad.table(spark, sf_dir, "lineitem")))


DOSE_SQL = """
WITH p AS (
  SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey,
         CAST(o.o_orderdate AS DATE) AS entree, CAST(o.o_orderdate AS DATE) + 60 AS sortie,
         CAST(l.l_shipdate AS DATE) AS debut,
         CASE WHEN l.l_linenumber = 3 THEN NULL ELSE CAST(l.l_shipdate AS DATE) + CAST(l.l_linenumber - 2 AS INTEGER) END AS fin,
         CASE WHEN l.l_linenumber % 5 = 0 THEN 'si besoin' ELSE CAST(l.l_linenumber % 5 AS VARCHAR) || 'x/jour' END AS frequence
  FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey),
c AS (
  SELECT *, greatest(entree, least(debut, sortie)) AS s,
         greatest(entree, least(coalesce(fin, sortie), sortie)) AS e FROM p),
h AS (
  SELECT *, CASE TRY_CAST(regexp_extract(frequence, '^([0-9]+)x/jour', 1) AS INTEGER)
              WHEN 1 THEN ['08:00'] WHEN 2 THEN ['08:00', '20:00'] WHEN 3 THEN ['08:00', '14:00', '20:00']
              WHEN 4 THEN ['08:00', '12:00', '16:00', '20:00'] ELSE ['08:00'] END AS hours
  FROM c WHERE e >= s)
SELECT CAST(l_orderkey AS VARCHAR) AS id_sejour, l_linenumber, l_partkey, l_suppkey,
       strftime(s + CAST(d AS INTEGER), '%Y-%m-%d') || ' ' || hr AS date_administration
FROM h, LATERAL (SELECT unnest(range(0, datediff('day', s, e) + 1)) AS d) dd,
     LATERAL (SELECT unnest(hours) AS hr) hh"""


@register("dose_expand", DOSE_SQL)
def q_dose_expand(spark, sf_dir):
    """Prescriptions (one per line item: from the ship date for linenumber-2
    days, open-ended for line 3, '<n>x/jour' by line number) expanded into
    doses inside the order's 60-day stay."""
    li = ad.table(spark, sf_dir, "lineitem")
    ln = F.col("l_linenumber")
    debut = F.to_date("l_shipdate")
    presc = li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", debut.alias("debut"),
        F.when(ln == 3, F.lit(None)).otherwise(F.date_add(debut, ln - 2)).alias("fin"),
        F.when(ln % 5 == 0, F.lit("si besoin"))
        .otherwise(F.concat((ln % 5).cast("string"), F.lit("x/jour"))).alias("frequence"))
    stays = ad.stays(spark, sf_dir).select("o_orderkey", "entree", "sortie") \
        .withColumnRenamed("o_orderkey", "l_orderkey")
    doses = reshape.expand_doses(presc, stays, key=["l_orderkey"])
    return doses.select(F.col("l_orderkey").cast("string").alias("id_sejour"), "l_linenumber",
                        "l_partkey", "l_suppkey",
                        F.date_format("date_administration", "yyyy-MM-dd HH:mm").alias("date_administration"))


@register("drug_lookup", """
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, 'drug-' || CAST(l.l_partkey AS VARCHAR) AS nom,
       c.atc, c.ucd, c.nom IS NOT NULL AS matched
FROM lineitem l LEFT JOIN (
  SELECT 'drug-' || CAST(p_partkey AS VARCHAR) AS nom,
         upper(substr(p_type, 1, 1)) || lpad(CAST(p_size AS VARCHAR), 2, '0') || substr(p_brand, 7) AS atc,
         CAST(9200000 + p_partkey AS VARCHAR) AS ucd
  FROM part WHERE p_partkey % 7 <> 0) c ON c.nom = 'drug-' || CAST(l.l_partkey AS VARCHAR)""")
def q_drug_lookup(spark, sf_dir):
    li = ad.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.concat(F.lit("drug-"), F.col("l_partkey").cast("string")).alias("nom"))
    return reshape.drug_lookup(li, ad.drug_catalogue(spark, sf_dir)).select(
        "l_orderkey", "l_linenumber", "l_partkey", "nom", "atc", "ucd", "matched")


@register("lab_unpivot", """
SELECT CAST(l_orderkey AS VARCHAR) AS id_sejour, l_linenumber, l_partkey, l_suppkey, code, valeur + 0.0 AS valeur
FROM (UNPIVOT (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS quantite,
                      l_extendedprice AS prix, l_discount AS remise, l_tax AS taxe FROM lineitem)
      ON quantite, prix, remise, taxe INTO NAME code VALUE valeur) u""")
def q_lab_unpivot(spark, sf_dir):
    li = ad.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.col("l_quantity").alias("quantite"), F.col("l_extendedprice").alias("prix"),
        F.col("l_discount").alias("remise"), F.col("l_tax").alias("taxe"))
    long = reshape.unpivot_labs(li, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"],
                                ["quantite", "prix", "remise", "taxe"])
    return long.select(F.col("l_orderkey").cast("string").alias("id_sejour"), "l_linenumber",
                       "l_partkey", "l_suppkey", "code", (F.col("valeur") + 0.0).alias("valeur"))


@register("flatten_conversations", """
SELECT conv_id, turn, role, generate_subscripts(arr, 1) - 1 AS line_no, unnest(arr) AS line
FROM (SELECT conv_id, turn, role, string_split(text, chr(10)) AS arr FROM conversations) t""")
def q_flatten_conversations(spark, sf_dir):
    """Nested (turn -> struct(role, lines[])) -> one flat row per line."""
    conv = ad.table(spark, sf_dir, "conversations")
    nested = conv.select("conv_id", "turn", F.struct(
        "role", F.split("text", "\n").alias("lines")).alias("body"))
    flat = reshape.explode_children(nested.select("conv_id", "turn", "body.role", "body.lines"),
                                    ["conv_id", "turn", "role"], "lines", pos="line_no")
    return flat.select("conv_id", "turn", "role", F.col("line_no").cast("bigint").alias("line_no"),
                       F.col("lines").alias("line"))
