"""DuckDB twin of the quality rules query."""
from __future__ import annotations

from recordfold.llm import quality as q

_SPACE = r"[\x20\x09-\x0D]+"


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _distance(p: str, r: str) -> str:
    """Jensen-Shannon distance of two count lists."""
    def half(a: str, b: str) -> str:
        return f"CASE WHEN {a} > 0 THEN {a} * log2({a} / (({a} + {b}) / 2)) ELSE 0 END / 2"
    x, y = f"({p}[i] / list_sum({p}))", f"({r}[i] / list_sum({r}))"
    return f"sqrt(greatest(0.0, list_sum(list_transform(range(1, len({p}) + 1), lambda i: {half(x, y)} + {half(y, x)}))))"


def oracle() -> str:
    lists = " ".join(f"WHEN '{code}' THEN {_list(ws)}" for code, ws in q.COMMON_WORDS.items())
    langs = ", ".join(f"'{code}'" for code in q.COMMON_WORDS)
    bins = len(next(iter(q.COMMON_WORDS.values()))) + 1
    sums = lambda c, n: "[" + ", ".join(f"sum({c}[{i}])" for i in range(1, n + 1)) + "]"
    w = q.WINDOW
    return rf"""
WITH t AS (SELECT row_number() OVER () AS row, doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '{_SPACE}'), lambda x: x <> '') AS ws FROM t),
c AS (SELECT *, array_to_string(ws, '') AS c0 FROM w),
c1 AS (SELECT *, regexp_replace(c0, '[a-z]+', '', 'g') AS r1 FROM c),
c2 AS (SELECT *, regexp_replace(r1, '[A-Z]+', '', 'g') AS r2 FROM c1),
c3 AS (SELECT *, regexp_replace(r2, '[0-9]+', '', 'g') AS r3 FROM c2),
c4 AS (SELECT *, regexp_replace(r3, '\p{{L}}+', '', 'g') AS r4 FROM c3),
c5 AS (SELECT *, regexp_replace(r4, '[.,;:!?''"()\-]+', '', 'g') AS r5 FROM c4),
win AS (SELECT row, i, array_to_string(ws[i:i + {w - 1}], ' ') AS s FROM (SELECT row, ws, unnest(range(1, len(ws) - {w - 2})) AS i FROM w)),
rep AS (SELECT row, count(DISTINCT i + k) AS n FROM (SELECT row, i, count(*) OVER (PARTITION BY row, s) AS m FROM win) x,
        (SELECT unnest(range({w})) AS k) y WHERE m > 1 GROUP BY row),
f AS (SELECT c5.row, doc_id, lang, len(ws) AS n_words, length(c0) AS word_chars,
             length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             len(ln) - len(list_distinct(ln)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
             [length(c0) - length(r1), length(r1) - length(r2), length(r2) - length(r3), length(r3) - length(r4),
              length(r4) - length(r5), length(r5)] AS classes,
             CASE WHEN lang IN ({langs}) THEN list_transform(CASE lang {lists} END, lambda k: len(list_filter(ws, lambda x: x = k))) END AS own, ws
      FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ln FROM c5) c5
      LEFT JOIN rep ON rep.row = c5.row),
g AS (SELECT *, list_append(own, n_words - list_sum(own)) AS common,
             (n_words < {q.BASE_MIN_WORDS} OR 100 * n_repeat_words > {q.BASE_MAX_REPEAT} * n_words) AS base_failed FROM f),
r AS (SELECT lang, {sums('classes', len(q.CLASSES))} AS rc, {sums('common', bins)} AS rw
      FROM g WHERE lang IN ({langs}) AND n_words >= {q.BASE_MIN_WORDS} GROUP BY lang),
d AS (SELECT g.*, CASE WHEN word_chars >= {q.MIN_CHARS} AND rc IS NOT NULL THEN {_distance('classes', 'rc')} ELSE 0 END AS cd,
             CASE WHEN n_words >= {q.MIN_WORDS} AND rw IS NOT NULL THEN {_distance('common', 'rw')} ELSE 0 END AS wd
      FROM g LEFT JOIN r ON r.lang = g.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR cd > {q.MAX_CLASS_DISTANCE} OR wd > {q.MAX_WORD_DISTANCE} OR (cd > {q.ODD_CLASS_DISTANCE} AND wd > {q.ODD_WORD_DISTANCE})) AS kept
FROM d"""
