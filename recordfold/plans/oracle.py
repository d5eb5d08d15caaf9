"""DuckDB twins of the adapters, as named CTEs, and a tiny composer.

``with_ctes(["log", "latest"], "SELECT ...")`` returns ``WITH log AS (...),
latest AS (...) SELECT ...``, adding dependencies first.  The driver's tables
are pre-registered as DuckDB views under their own names.
"""
from __future__ import annotations

CTES: dict[str, tuple[list[str], str]] = {}


def cte(name: str, sql: str, deps: list[str] | None = None) -> None:
    CTES[name] = (deps or [], sql)


def with_ctes(names: list[str], body: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTES[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    parts = [f"{n} AS (\n{CTES[n][1]}\n)" for n in order]
    return "WITH " + ",\n".join(parts) + "\n" + body


cte("ev", """
SELECT event_id, ts, user_id, event_type, value, props,
       TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
FROM events""")

cte("log", """
SELECT ts AS "timestamp", event_id AS seq, 'u' || CAST(user_id AS VARCHAR) AS "user",
       CAST((user_id - user_id % 3) * 10 + k % 10 AS VARCHAR) AS patient_id,
       CAST(((user_id - user_id % 3) * 10 + k % 10) * 10 + k // 10 AS VARCHAR) AS id_sejour,
       CASE WHEN k >= 90 THEN 'manuel' WHEN k % 2 = 0 THEN 'suggestion' ELSE 'code_valide' END AS item_type,
       CAST(k AS VARCHAR) AS item_id,
       CASE WHEN event_type = 'view' THEN CASE WHEN k >= 90 THEN 'ajouté' ELSE 'validé' END
            WHEN event_type = 'click' THEN CASE WHEN k < 90 AND k % 2 = 1 THEN 'restauré' ELSE 'rejeté' END
            WHEN event_type = 'error' THEN 'annulé'
            WHEN event_type = 'signup' THEN 'modifié'
            WHEN event_type = 'purchase' THEN 'supprimé' END AS action,
       CASE WHEN event_type = 'signup' OR (event_type = 'view' AND k >= 90)
            THEN 'C' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END AS code,
       CASE WHEN event_type = 'signup' THEN 'lib ' || CAST(event_id AS VARCHAR) END AS libelle,
       CASE WHEN event_type = 'signup' THEN CASE WHEN value < 100 THEN 'CCAM' ELSE 'CIM-10' END END AS type_code,
       CASE WHEN value > 400 THEN ' note ' || CAST(event_id AS VARCHAR) || chr(10) || ' "b' || chr(92) || 's", ' END AS commentaire,
       user_id, event_type, k
FROM ev""", ["ev"])


def _last(col: str) -> str:
    return (f'max_by({col}, ("timestamp" IS NULL, "timestamp", seq)) '
            f'FILTER (WHERE {col} IS NOT NULL) AS {col}')


cte("latest", f"""
SELECT "user", patient_id, id_sejour, item_id,
       {_last('"timestamp"')}, {_last('item_type')}, {_last('action')}, {_last('code')},
       {_last('libelle')}, {_last('type_code')}, {_last('commentaire')}
FROM log
WHERE "user" IS NOT NULL AND patient_id IS NOT NULL AND id_sejour IS NOT NULL AND item_id IS NOT NULL
GROUP BY "user", patient_id, id_sejour, item_id""", ["log"])

cte("suggestions", """
SELECT patient_id, id_sejour, CAST(item AS VARCHAR) AS suggestion_id, 'B' || CAST(item AS VARCHAR) AS code,
       'CIM-10' AS type, 'base ' || CAST(item AS VARCHAR) AS libelle,
       CASE WHEN item % 7 = 0 THEN 'n/a' ELSE CAST(item % 100 AS VARCHAR) END AS confiance,
       'document' AS source_kind, CAST(item AS VARCHAR) AS source_id,
       'RG-' || CAST(item * 17 AS VARCHAR) AS regle_id
FROM (SELECT DISTINCT patient_id, id_sejour, k FROM log WHERE item_type = 'suggestion') s,
     LATERAL (SELECT unnest([k, k + 100]) AS item)""", ["log"])

cte("codes", """
SELECT patient_id, id_sejour, CAST(k AS VARCHAR) AS code_id, 'K' || CAST(k AS VARCHAR) AS code,
       'CIM-10' AS type, 'clin ' || CAST(k AS VARCHAR) AS libelle,
       CASE WHEN k % 3 = 0 THEN 'oui' ELSE 'non' END AS removed
FROM (SELECT DISTINCT patient_id, id_sejour, k FROM log WHERE item_type = 'code_valide') s""", ["log"])

cte("raw_assign", """
SELECT "user" AS username, patient_id, seq AS pos FROM log
WHERE event_type IN ('view', 'click', 'signup')""", ["log"])

cte("assign", """
SELECT username, patient_id, min(pos) AS pos FROM raw_assign GROUP BY username, patient_id""",
    ["raw_assign"])

cte("accounts", """
SELECT 'u' || CAST(user_id AS VARCHAR) AS username,
       CASE WHEN user_id % 10 = 0 THEN 'admin' ELSE 'user' END AS role
FROM (SELECT DISTINCT user_id FROM events) u""")

cte("patients", """
SELECT CAST(c_custkey AS VARCHAR) AS patient_id, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS sexe,
       18 + c_nationkey * 3 AS age, c_custkey AS pos
FROM customer""")

cte("stays", """
SELECT o_orderkey, o_custkey, CAST(o_custkey AS VARCHAR) AS patient_id, CAST(o_orderkey AS VARCHAR) AS id_sejour,
       o_orderpriority AS service, CAST(o_orderdate AS DATE) AS entree,
       CAST(o_orderdate AS DATE) + INTERVAL 60 DAY AS sortie
FROM orders""")

cte("docs", """
SELECT CAST(o.o_custkey AS VARCHAR) AS patient_id,
       CASE WHEN d.doc_id % 5 <> 0 THEN CAST(d.doc_id AS VARCHAR) END AS id_sejour,
       CAST(d.doc_id AS VARCHAR) AS doc_id, d.lang AS type, d.source AS titre, d.text AS full_text
FROM documents d LEFT JOIN orders o ON d.doc_id = o.o_orderkey""")

cte("rules", """
SELECT 'RG-' || CAST(p_partkey AS VARCHAR) AS id, p_name AS titre, p_type AS categorie, 'SI ' || p_name AS logique,
       p_brand AS code, p_name AS libelle, CASE WHEN p_size % 2 = 0 THEN 'CIM-10' ELSE 'CCAM' END AS type,
       p_type || ' ' || CAST(p_size AS VARCHAR) AS description
FROM part""")

cte("conds", """
SELECT 'RG-' || CAST(l_partkey AS VARCHAR) AS rule_id, l_linenumber AS ordre, 'lineitem.l_quantity' AS champ,
       CASE l_linenumber % 4 WHEN 0 THEN 'wordlist' WHEN 1 THEN 'lt' WHEN 2 THEN 'regex' ELSE 'startswith' END AS operateur,
       CASE l_linenumber % 4 WHEN 0 THEN CASE WHEN l_quantity <= 45 THEN l_returnflag || '|' || l_linestatus END
                             WHEN 1 THEN CAST(l_quantity AS VARCHAR) WHEN 2 THEN 'R' || l_returnflag
                             ELSE l_linestatus END AS valeur,
       CASE WHEN l_linenumber % 4 = 2 THEN 'i' END AS flags
FROM lineitem""")

cte("comments", """
SELECT 'c' || CAST(s_suppkey AS VARCHAR) AS id, 'RG-' || CAST(s_suppkey * 37 AS VARCHAR) AS rule_id,
       'u' || CAST(s_suppkey % 150 AS VARCHAR) AS auteur,
       CASE WHEN s_suppkey % 18 = 0 THEN chr(9) || chr(10) WHEN s_suppkey % 9 = 0 THEN '   '
            ELSE ' ' || s_name || chr(10) END AS texte
FROM supplier""")

cte("patches", """
SELECT 'RG-' || CAST(s_suppkey * 23 AS VARCHAR) AS id, 0 AS pos, CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS titre,
       CASE WHEN s_suppkey % 3 = 0 THEN 'SI ' || s_name END AS logique, CAST(NULL AS VARCHAR) AS description
FROM supplier
UNION ALL
SELECT 'RG-' || CAST(s_suppkey * 23 AS VARCHAR), 1, CASE WHEN s_suppkey % 4 = 0 THEN 'again ' || s_name END,
       CAST(NULL AS VARCHAR), 'second'
FROM supplier WHERE s_suppkey % 5 = 0""")

cte("patch1", """
SELECT id, arg_max(titre, pos) FILTER (WHERE titre IS NOT NULL) AS titre,
       arg_max(logique, pos) FILTER (WHERE logique IS NOT NULL) AS logique,
       arg_max(description, pos) FILTER (WHERE description IS NOT NULL) AS description
FROM patches GROUP BY id""", ["patches"])

cte("new_conds", """
SELECT 'RG-' || CAST(s_suppkey * 23 AS VARCHAR) AS rule_id, o AS ordre,
       CASE WHEN o = 0 THEN 'supplier.s_nationkey' ELSE 'supplier.s_name' END AS champ,
       CASE WHEN o = 0 THEN 'lt' ELSE 'startswith' END AS operateur,
       CASE WHEN o = 0 THEN CAST(s_nationkey AS VARCHAR) ELSE 'Supp' END AS valeur, CAST(NULL AS VARCHAR) AS flags
FROM supplier, (SELECT unnest([0, 1]) AS o) x""")
