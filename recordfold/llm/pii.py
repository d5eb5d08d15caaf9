"""Personal data by patterns, checksums and context, in native expressions.

Regular expressions propose spans (leftmost, non-overlapping, per kind),
validators confirm them (octet range, digit counts, Luhn, mod-97), and context
words near a span raise its score.  Base kinds email, ip, card and phone are
always reported when their validator holds; the method adds IBANs in either
case, as long as their country's are (mod-97 confirms them), and 13 to 15 digit
cards (Luhn, and a context word or they score too little).

Offsets count code points: ``split`` gives the text between the matches and
``regexp_extract_all`` the matches, so the running sum of their lengths is
each match's place.  Patterns are possessive and start at the beginning of a
run of their characters (or where the last match ended), which keeps their
leftmost greedy meaning without quadratic rescans of very long runs.

Scale: map-only, no shuffle, no Python.  Texts without the character a kind
needs skip its patterns.  Very long texts take time in proportion to their
length, and an empty table gives none of the rows of ``report``, ``found`` or
``redact``.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LOCAL, _HOST = "A-Za-z0-9._%+-", "A-Za-z0-9-"
EMAIL = rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[{_HOST}]++(?:\.[{_HOST}]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?:(?<![0-9])|\G)[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# fixed values: countries by the number of characters of their IBANs
IBAN_COUNTRIES = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU", 31: "MT SC", 32: "LC"}
IBAN = "(?<![A-Za-z0-9])(?=[A-Za-z]{2}[0-9]{2})(?i:" + "|".join(
    rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_COUNTRIES.items()) + ")(?![A-Za-z0-9])"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
VALID_IP = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"

#: Kinds in report order; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "iban", "short_card")
BASE = KINDS[:4]
PATTERNS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "iban": IBAN, "short_card": CARD}
#: A text without a match of this cannot hold the kind.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]",
         "iban": r"(?<![A-Za-z0-9])[A-Za-z]{2}[0-9]{2}", "short_card": r"[0-9](?:[\x20-]?[0-9]){12}"}
#: Score of a confirmed span, what a context word adds, and the least score reported.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "short_card": 0.4}
BOOST, LEAST = 0.3, 0.5
CONTEXT = {"email": "mail|contact|write", "ip": r"\bip\b|address|server|host", "card": "card|visa|credit|payment",
           "phone": "phone|tel|call|mobile|fax", "iban": "iban|account|bank|konto|compte|cuenta",
           "short_card": "card|visa|amex|credit|payment"}
#: Code points looked at on each side of a span for context words.
NEAR = 40


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Luhn check of a string of ASCII digits."""
    def step(acc: Column, i: Column) -> Column:
        d = F.substr(number, F.length(number) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when(i % 2 == 1, twice).otherwise(d)
    return F.aggregate(F.sequence(F.lit(0), F.length(number) - 1), F.lit(0), step) % 10 == 0


def mod97(iban: Column) -> Column:
    """ISO 7064 mod 97-10 check of an IBAN without spaces."""
    moved = F.concat(F.substr(iban, F.lit(5), F.length(iban)), F.substr(iban, F.lit(1), F.lit(4)))

    def step(acc: Column, ch: Column) -> Column:
        v = F.when(ch.between("0", "9"), ch.cast("int")).otherwise(F.ascii(ch) - 55)
        return F.when(v > 9, acc * 100 + v).otherwise(acc * 10 + v) % 97
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda acc, ch: F.when(ch == "", acc).otherwise(step(acc, ch))) == 1


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(VALID_IP)
    if kind in ("card", "short_card"):
        low, high = (16, 19) if kind == "card" else (13, 15)
        return _let(digits(m), lambda d: F.when(F.length(d).between(low, high), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(digits(m)).between(8, 15)
    if kind == "iban":
        return mod97(F.upper(F.replace(m, F.lit(" "), F.lit(""))))
    return F.lit(True)


def _spans_of(kind: str, text: Column) -> Column:
    """Confirmed spans of one kind as array of (kind, start, end, score)."""
    empty = F.array().cast("array<struct<kind:int,start:bigint,end:bigint,score:double>>")
    pattern = F.lit(PATTERNS[kind])

    def placed(gaps: Column, found: Column) -> Column:
        # start of match k: everything before it; a running sum that keeps (next start, starts)
        init = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("starts"))

        def walk(acc: Column, x: Column) -> Column:
            start = acc["at"] + x["gap"]
            return F.struct((start + x["n"]).alias("at"), F.concat(acc["starts"], F.array(start)).alias("starts"))
        sizes = F.transform(found, lambda m, k: F.struct(
            F.length(F.get(gaps, k)).cast("bigint").alias("gap"), F.length(m).cast("bigint").alias("n")))
        return _let(F.aggregate(sizes, init, walk)["starts"], lambda starts: confirmed(found, starts))

    def confirmed(found: Column, starts: Column) -> Column:
        spans = F.transform(found, lambda m, k: F.struct(m.alias("m"), F.get(starts, k).alias("s")))
        good = F.filter(spans, lambda x: _valid(kind, x["m"]))
        scored = F.transform(good, lambda x: F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), x["s"].alias("start"),
            (x["s"] + F.length(x["m"])).alias("end"), score(x).alias("score")))
        return scored if kind in BASE else F.filter(scored, lambda x: x["score"] >= LEAST)

    def score(x: Column) -> Column:
        before = F.greatest(F.lit(0).cast("bigint"), x["s"] - NEAR)
        around = F.concat(F.substr(text, (before + 1).cast("int"), (x["s"] - before).cast("int")), F.lit(" "),
                          F.substr(text, (x["s"] + F.length(x["m"]) + 1).cast("int"), F.lit(NEAR)))
        hit = F.lower(around).rlike(CONTEXT[kind])
        return F.least(F.lit(1.0), F.lit(PRIOR[kind]) + F.when(hit, F.lit(BOOST)).otherwise(0.0))

    spans = _let(F.split(text, PATTERNS[kind], -1), lambda gaps: _let(
        F.regexp_extract_all(text, pattern, F.lit(0)), lambda found: placed(gaps, found)))
    may = F.contains(text, F.lit("@")) if kind == "email" else text.rlike(NEEDS[kind])
    return F.when(may, spans).otherwise(empty)


def spans_column(text: Column) -> Column:
    """All reported spans of a text (null: none) as an array of structs (kind
    index, start, end, score) by kind, then start; offsets in code points."""
    return _let(F.coalesce(text, F.lit("")), lambda t: F.concat(*[_spans_of(k, t) for k in KINDS]))


def kind_name(index: Column) -> Column:
    return F.get(F.array(*[F.lit(k) for k in KINDS]), index)


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", kind_name(x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def found(docs: DataFrame) -> DataFrame:
    """Rows (row, spans): each input row as struct ``row`` with its spans.
    A null text has no span; repeated rows are treated alike; extra columns
    stay inside ``row``.  The generator keeps the spans from being computed
    again in every place that uses them."""
    return docs.select(F.struct("*").alias("row")).select("row", F.explode(F.array(spans_column(F.col("row.text")))).alias("spans"))


def report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_<base kind>, base spans and all spans as
    text, and ``scores``, the spans' scores in the same order."""
    base = F.filter("spans", lambda x: x["kind"] < len(BASE))

    def count(i: int) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == i)).cast("bigint")
    per = [count(i).alias(f"n_{k}") for i, k in enumerate(BASE)]
    return found(docs).select("row.doc_id", *per, spans_text(base).alias("base_spans"), spans_text(F.col("spans")).alias("spans"),
                               F.array_join(F.transform("spans", lambda x: F.round(x["score"], 2).cast("string")), ",").alias("scores"))


def masked(text: Column, spans: Column) -> Column:
    """``text`` with every span replaced by ``[KIND]``.  Of overlapping spans
    the earliest names the mask, which covers their union."""
    init = F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>")
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))

    def merge(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        here = F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))
        joined = F.struct(last["kind"].alias("kind"), last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        return F.when(F.size(acc) == 0, F.array(here)).when(x["start"] >= last["end"], F.concat(acc, F.array(here))) \
            .otherwise(F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(joined)))

    def pieces(u: Column) -> Column:
        part = F.transform(u, lambda x, k: _let(
            F.when(k == 0, F.lit(0).cast("bigint")).otherwise(F.get(u, k - 1)["end"]),
            lambda a: F.concat(F.substr(text, (a + 1).cast("int"), (x["start"] - a).cast("int")),
                               F.lit("["), F.upper(kind_name(x["kind"])), F.lit("]"))))
        tail = F.substr(text, (F.element_at(u, -1)["end"] + 1).cast("int"), F.length(text))
        return F.concat(F.array_join(part, ""), tail)
    return F.when(F.size(spans) == 0, text).otherwise(_let(F.aggregate(ordered, init, merge), pieces))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span masked in ``text`` and, where there is such a
    column, ``n_chars`` of the new text.  All other columns stay."""
    text = F.col("masked")
    cols = []
    for f in docs.schema.fields:
        if f.name == "text":
            cols.append(text.alias("text"))
        elif f.name == "n_chars":
            cols.append(F.when(F.size("spans") == 0, F.col("row.n_chars")).otherwise(F.length(text)).cast(f.dataType).alias("n_chars"))
        else:
            cols.append(F.col("row")[f.name].alias(f.name))
    done = found(docs).withColumn("masked", F.when(F.col("row.text").isNotNull(), masked(F.col("row.text"), F.col("spans"))))
    return done.select(*cols)
