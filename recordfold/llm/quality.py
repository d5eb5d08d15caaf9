"""Quality rules by distribution divergence, in native expressions only.

Two histograms of a document are compared with those of its language: the
character classes of its non-space characters, and its common (function)
words, with all other words as one more bin.  The distance is the
Jensen-Shannon distance (square root of the divergence to base 2, 0 to 1).
The language references are the summed histograms of all documents of the
language with ``BASE_MIN_WORDS`` words, so they follow the corpus.  A document
is rejected if a base rule fails, if its character classes are far from the
reference, or if its classes are odd and its common words too.  A histogram
shorter than ``MIN_CHARS`` characters or ``MIN_WORDS`` words, or of a language
without a word list, never rejects.

Scale: one map-only pass for the references (a sum per language; the languages
are those of COMMON_WORDS, so the table has at most that many rows and is
broadcast) and one for the verdicts.  No text is shuffled.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frequent function words by language.
COMMON_WORDS = {
    "en": "the of and to in a is that it for as with was on by be are this from at".split(),
    "fr": "de la le et les des en un une du est que qui dans pour sur pas plus par avec".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al".split(),
}
CLASSES = ("lower", "upper", "digit", "letter", "mark", "other")
MIN_CHARS, MIN_WORDS = 200, 50
#: Rejected beyond either of the first two, or beyond the other two together.
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE, ODD_CLASS_DISTANCE, ODD_WORD_DISTANCE = 0.32, 0.42, 0.14, 0.30
BASE_MIN_WORDS, BASE_MAX_REPEAT, WINDOW = 20, 30, 8

_SPACE = r"[\x20\x09-\x0D]+"


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def _without(c: Column, pattern: str) -> Column:
    return F.regexp_replace(c, pattern, "")


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, _SPACE, -1), "")


def repeated_words(ws: Column) -> Column:
    """Words inside 8-word windows that occur twice or more in the text."""
    starts = F.sequence(F.lit(1), F.size(ws) - (WINDOW - 1))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(ws, i, WINDOW)))
    # equal windows have equal hashes: a text without equal hashes has no repeat
    may_repeat = _let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))

    def covered(run: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(run, k)["w"] == x["w"], F.lit(False))
        at = F.array_sort(F.transform(F.filter(run, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))
        return _let(at, lambda p: F.aggregate(
            F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))),
            F.lit(0), lambda acc, x: acc + x))

    windows = F.transform(starts, lambda i: F.struct(F.concat_ws(" ", F.slice(ws, i, WINDOW)).alias("w"), i.alias("i")))
    return F.when(F.size(ws) <= WINDOW, F.lit(0)).when(may_repeat, _let(F.array_sort(windows), covered)) \
        .otherwise(F.lit(0)).cast("bigint")


def duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint"))


def _word_counts(ws: Column, lang: Column) -> Column:
    """Counts of the language's common words and of all other words; null for
    a language without a list."""
    known = sorted({w for ws_ in COMMON_WORDS.values() for w in ws_})
    own = F.when(F.lit(False), F.array(F.lit("")))
    for code, lst in COMMON_WORDS.items():
        own = own.when(lang == code, F.array(*[F.lit(w) for w in lst]))

    def counts(found: Column) -> Column:
        # found words as one string, two spaces between: bytes that " word " takes up
        per = F.transform(own, lambda k: (F.octet_length(found) - F.octet_length(
            F.replace(found, F.concat(F.lit(" "), k, F.lit(" ")), F.lit("")))).cast("int")
            / (F.octet_length(k) + 2)).cast("array<int>")
        return _let(per, lambda p: F.concat(p, F.array(F.size(ws) - F.aggregate(p, F.lit(0), lambda a, x: a + x))))
    found = F.concat(F.lit(" "), F.array_join(F.filter(ws, lambda w: w.isin(*known)), "  "), F.lit(" "))
    return F.when(lang.isin(*COMMON_WORDS), _let(found, counts))


def _classes(c: Column, r1: Column) -> Column:
    """Counts of CLASSES in ``c`` (no spaces); each step removes one class from
    what the step before has left, ``r1`` is ``c`` without a-z."""
    size = F.length
    return _let(_without(r1, "[A-Z]+"), lambda r2: _let(_without(r2, "[0-9]+"), lambda r3: _let(
        _without(r3, r"\p{L}+"), lambda r4: _let(_without(r4, r"[.,;:!?'\"()\-]+"), lambda r5: F.array(
            size(c) - size(r1), size(r1) - size(r2), size(r2) - size(r3), size(r3) - size(r4),
            size(r4) - size(r5), size(r5))))))


def features(rows: DataFrame, text: Column, lang: Column, rules: bool = True) -> DataFrame:
    """``rows`` with a struct column ``q`` of histograms and, with ``rules``,
    the base values.

    Every intermediate value is bound once, and the struct passes through a
    one-element generator: a filter on it can then not be pushed below, which
    would evaluate the whole expression again in every place it is used."""
    def base(t, ws, c, r1):
        n = F.size(ws)
        return _let(repeated_words(ws), lambda rep: F.struct(
            n.cast("bigint").alias("n_words"), F.length(c).cast("bigint").alias("word_chars"),
            (F.length(r1) - F.length(_without(r1, "[#*$%&|<>]+"))).cast("bigint").alias("n_symbols"),
            duplicate_lines(t).alias("n_dup_lines"), rep.alias("n_repeat_words"),
            ((n < BASE_MIN_WORDS) | (100 * rep > BASE_MAX_REPEAT * n)).alias("base_failed"),
            _classes(c, r1).alias("classes"), _word_counts(ws, lang).alias("common")))

    def histograms(t, ws, c, r1):
        return F.struct(F.size(ws).alias("n_words"), _classes(c, r1).alias("classes"),
                        _word_counts(ws, lang).alias("common"))

    body = base if rules else histograms
    q = _let(F.coalesce(text, F.lit("")), lambda t: _let(words(t), lambda ws: _let(
        F.array_join(ws, ""), lambda c: _let(_without(c, "[a-z]+"), lambda r1: body(t, ws, c, r1)))))
    return rows.select("*", F.explode(F.array(q)).alias("q"))


def language_references(docs: DataFrame) -> DataFrame:
    """(lang, ref_classes, ref_common): summed histograms of all documents of
    each language of COMMON_WORDS that have BASE_MIN_WORDS words."""
    known = docs.where(F.col("lang").isin(*COMMON_WORDS)).select("text", "lang")
    q = features(known, F.col("text"), F.col("lang"), rules=False).select("lang", "q").where(
        F.col("q.n_words") >= BASE_MIN_WORDS)
    bins = len(next(iter(COMMON_WORDS.values()))) + 1
    sums = [F.sum(F.col("q.classes")[i]).alias(f"c{i}") for i in range(len(CLASSES))]
    sums += [F.sum(F.col("q.common")[i]).alias(f"w{i}") for i in range(bins)]
    return q.groupBy("lang").agg(*sums).select(
        "lang", F.array(*[f"c{i}" for i in range(len(CLASSES))]).alias("ref_classes"),
        F.array(*[f"w{i}" for i in range(bins)]).alias("ref_common"))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two count arrays of the same length, 0 to 1;
    null if one is null or sums to zero."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)

    def shares(a: Column) -> Column:
        return _let(total(a), lambda s: F.when(s > 0, F.transform(a, lambda x: x / s)))

    def half(a: Column, m: Column) -> Column:
        return F.when(a > 0, a * F.log2(a / m)).otherwise(0.0) / 2

    def term(a: Column, b: Column) -> Column:
        return _let((a + b) / 2, lambda m: half(a, m) + half(b, m))
    parts = F.zip_with(shares(p), shares(q), term)
    return _let(total(parts), lambda d: F.when(d.isNotNull(), F.sqrt(F.greatest(F.lit(0.0), d))))


def judged(docs: DataFrame, references: DataFrame | None = None) -> DataFrame:
    """Rows (row, q, class_distance, word_distance, kept): each input row as
    struct ``row`` with its base values and verdict.  Null text counts as
    empty and fails the base rules; a null or unknown language is judged by
    the base rules alone.  Repeated rows are judged alike; extra columns stay
    inside ``row``."""
    refs = language_references(docs) if references is None else references
    refs = refs.where(F.col("lang").isin(*COMMON_WORDS)) \
        .select(F.col("lang").alias("_lang"), "ref_classes", "ref_common")
    rows = docs.select(F.struct("*").alias("row"))
    q = features(rows, F.col("row.text"), F.col("row.lang"))
    # one row per language of COMMON_WORDS at most: a bounded broadcast
    q = q.join(F.broadcast(refs), F.col("row.lang") == F.col("_lang"), "left")
    chars, n = F.col("q.word_chars"), F.col("q.n_words")
    out = q.select(
        "row", "q",
        F.when(chars >= MIN_CHARS, js_distance(F.col("q.classes"), F.col("ref_classes"))).alias("class_distance"),
        F.when(n >= MIN_WORDS, js_distance(F.col("q.common"), F.col("ref_common"))).alias("word_distance"))
    chars_off, words_off = F.coalesce("class_distance", F.lit(0.0)), F.coalesce("word_distance", F.lit(0.0))
    far = (chars_off > MAX_CLASS_DISTANCE) | (words_off > MAX_WORD_DISTANCE) | ((chars_off > ODD_CLASS_DISTANCE) & (words_off > ODD_WORD_DISTANCE))
    return out.withColumn("kept", ~(F.col("q.base_failed") | far))


def quality_report(docs: DataFrame) -> DataFrame:
    """One row per document: base values, distances and verdict; none for an empty table."""
    return judged(docs).select("row.doc_id", *[f"q.{c}" for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")],
        "kept", "class_distance", "word_distance")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows that the rules keep, all columns unchanged."""
    return judged(docs).where("kept").select("row.*")
