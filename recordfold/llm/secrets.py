"""Secrets by patterns and by sliding-window entropy, in native expressions.

Base kinds come from three patterns (assigned values, access keys, hex runs).
The method adds candidate strings, maximal runs of a character class, in which
the Shannon entropy of some window of ``WINDOW`` characters reaches the class's
limit.  The window slides by one character: the count of the one that enters
rises, the count of the one that leaves falls, and the sum of n*log2(n) over
the counts changes by the four values concerned (in units of 2**-40, so that
sums are whole numbers and the order of additions does not matter).  A found
span runs from the first such window's start to the last one's end.

An allow-list suppresses added spans only: candidates of letters or of digits
alone, with a common placeholder word, an alphabet or number sequence, in a
URL, or after a word that announces a public digest; and those within a base
span, which is reported already.

Offsets count code points.  Matches of failing length are dropped without a
new try inside them.

Defined results: a null text has no span; repeated rows are treated alike; an
empty table gives none; extra columns stay inside ``row``, whatever their
names.  Very long texts and very long runs take time in proportion to their
length; the counts of one window are all that a run's scan holds.

Scale: map-only, no shuffle, no Python.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in report order; the first three are the base kinds.
KINDS = ("assign", "access", "hex", "random_hex", "random_text")
BASE = KINDS[:3]
ASSIGN = (r"""(?i:password|passwd|secret|token|api_?key)["']?+\x20*+[:=]\x20*+["']?+""" r"""([A-Za-z0-9+/_.=-]++)""")
ACCESS = r"AKIA[A-Z0-9]{16,}+"   # 20 and more characters; a shorter run holds no other match
HEX = r"[0-9a-f]{24,}+"          # 24 and more, likewise
LEAST_VALUE = 6

#: Characters of a window.
WINDOW = 24
#: The added kinds: class of characters, and the least entropy in bits per
#: character.  24 random hex digits have 3.4 on the average, 24 random base64
#: characters 4.2; runs of words joined by underscores or slashes stay below 3.9.
CLASSES = {"random_hex": ("0-9A-Fa-f", 3.0), "random_text": ("A-Za-z0-9+/_-", 4.0)}
#: Suppressed when the run matches this ...
ALLOWED_RUN = "(?i)^[a-z+/_-]*$|^[0-9+/_-]*$|example|sample|placeholder|change_?me|dummy|x{6}|abcdefgh|01234567|12345678"
#: ... or the NEAR characters before it end with this.
ALLOWED_BEFORE = r"(?i)(?:https?://|www\.)[^\s]*$|(?:sha-?(?:1|256|384|512)|md5|checksum|commit|integrity|digest)[\s:=\"'(-]*$|base64,$"
NEAR = 200

#: First code and number of codes that the counts of a window cover.
_LOW, _CODES = 43, 80
_NONE = ord("0")
_UNIT = 2 ** 40
#: n*log2(n) in units, for n of 0 to WINDOW.
N_LOG_N = [round(n * math.log2(n) * _UNIT) if n else 0 for n in range(WINDOW + 1)]


def most(bits: float) -> int:
    """The largest sum of n*log2(n), in units, at which a window has ``bits`` of entropy."""
    return math.floor(WINDOW * (math.log2(WINDOW) - bits) * _UNIT)


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _array(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


_SPAN = "struct<kind:int,start:bigint,end:bigint>"


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Matches of ``pattern``, leftmost and non-overlapping, as array of (m,
    value, s): the match, its ``group``, and the code points before it."""
    def placed(gaps: Column, found: Column, values: Column) -> Column:
        init = F.struct(F.lit(0).cast("bigint").alias("at"), _array("struct<m:string,value:string,s:bigint>").alias("out"))
        parts = F.transform(found, lambda m, k: F.struct(m.alias("m"), F.get(values, k).alias("value"), F.length(F.get(gaps, k)).alias("gap")))

        def walk(acc: Column, x: Column) -> Column:
            start = acc["at"] + x["gap"]
            hit = F.struct(x["m"].alias("m"), x["value"].alias("value"), start.alias("s"))
            return F.struct((start + F.length(x["m"])).alias("at"), F.concat(acc["out"], F.array(hit)).alias("out"))
        return F.aggregate(parts, init, walk)["out"]
    every = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))
    return _let(F.split(text, pattern, -1), lambda gaps: _let(every(0), lambda found: placed(gaps, found, every(group))))


def _spans(kind: str, found: Column) -> Column:
    return F.transform(found, lambda x: F.struct(
        F.lit(KINDS.index(kind)).alias("kind"), x["s"].alias("start"), (x["s"] + F.length(x["m"])).alias("end")))


def _count(counts: Column, k: Column) -> Column:
    """The count at place ``k``.  Counts are the codes of a string's characters,
    from '0' for none: Spark copies a short string faster than an array."""
    return F.ascii(F.substr(counts, k + 1, F.lit(1))) - _NONE


def _put(counts: Column, k: Column, n: Column) -> Column:
    """``counts`` with ``n`` at place ``k``."""
    return F.overlay(counts, F.char(n + _NONE), k + 1, F.lit(1))


def random_part(run: Column, limit: int) -> Column:
    """First start and last end (from 0, exclusive) of the windows of ``run``
    whose sum is at most ``limit``; nulls if there are none."""
    table = F.array(*[F.lit(x) for x in N_LOG_N])
    init = F.struct(F.repeat(F.lit("0"), F.lit(_CODES)).alias("counts"), F.lit(0).cast("bigint").alias("sum"),
                    F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))

    def moved(counts: Column, total: Column, k: Column, by: int) -> Column:
        """Counts and sum after one character more or less of place ``k``."""
        return _let(_count(counts, k), lambda n: F.struct(
            _put(counts, k, n + by).alias("counts"), (total + F.get(table, n + by) - F.get(table, n)).alias("sum")))

    def step(codes: Column, acc: Column, i: Column) -> Column:
        code = lambda at: F.get(codes, at - 1)
        left = F.when(i > WINDOW, moved(acc["counts"], acc["sum"], code(i - WINDOW), -1)) \
            .otherwise(F.struct(acc["counts"].alias("counts"), acc["sum"].alias("sum")))
        return _let(left, lambda a: _let(moved(a["counts"], a["sum"], code(i), 1), lambda b: _let(
            (i >= WINDOW) & (b["sum"] <= limit), lambda high: F.struct(
                b["counts"].alias("counts"), b["sum"].alias("sum"),
                F.coalesce(acc["first"], F.when(high, i - WINDOW)).alias("first"),
                F.when(high, i).otherwise(acc["last"]).alias("last")))))
    letters = F.filter(F.split(run, ""), lambda c: c != "")
    return _let(F.transform(letters, lambda c: F.ascii(c) - _LOW), lambda codes: F.aggregate(
        F.sequence(F.lit(1), F.size(codes)), init, lambda acc, i: step(codes, acc, i),
        lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last"))))


def _random(kind: str, text: Column) -> Column:
    """Spans of an added kind, those within base spans too."""
    chars, bits = CLASSES[kind]

    def suppressed(x: Column) -> Column:
        before = F.greatest(F.lit(0).cast("bigint"), x["s"] - NEAR)
        return x["m"].rlike(ALLOWED_RUN) | F.substr(text, (before + 1).cast("int"), (x["s"] - before).cast("int")).rlike(ALLOWED_BEFORE)
    pattern = f"[{chars}]{{{WINDOW},}}+"
    runs = F.filter(matches(text, pattern), lambda x: ~suppressed(x))
    parts = F.transform(runs, lambda x: F.struct(x["s"].alias("s"), random_part(x["m"], most(bits)).alias("w")))
    return F.when(text.rlike(pattern), F.transform(F.filter(parts, lambda x: x["w"]["last"].isNotNull()), lambda x: F.struct(
        F.lit(KINDS.index(kind)).alias("kind"), (x["s"] + x["w"]["first"]).alias("start"),
        (x["s"] + x["w"]["last"]).alias("end")))).otherwise(_array(_SPAN))


def _base(text: Column) -> Column:
    assign = F.filter(matches(text, ASSIGN, 1), lambda x: F.length(x["value"]) >= LEAST_VALUE)
    none = _array(_SPAN)
    return F.concat(
        F.when(text.rlike(ASSIGN), _spans("assign", assign)).otherwise(none),
        F.when(F.contains(text, F.lit("AKIA")), _spans("access", matches(text, ACCESS))).otherwise(none),
        F.when(text.rlike(HEX), _spans("hex", matches(text, HEX))).otherwise(none))


def spans_column(text: Column) -> Column:
    """All spans of a text (null: none), structs (start, kind index, end) by start, then kind."""
    def within(x: Column, others: Column) -> Column:
        return F.exists(others, lambda y: (y["start"] <= x["start"]) & (y["end"] >= x["end"]))

    def together(base: Column, t: Column) -> Column:
        hexes = _random("random_hex", t)
        added = _let(hexes, lambda h: F.concat(h, F.filter(_random("random_text", t), lambda x: ~within(x, h))))
        every = F.concat(base, F.filter(added, lambda x: ~within(x, base)))
        return F.array_sort(F.transform(every, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))))
    return _let(F.coalesce(text, F.lit("")), lambda t: _let(_base(t), lambda base: together(base, t)))


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    name = lambda x: F.get(F.array(*[F.lit(k) for k in KINDS]), x["kind"])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x), x["start"].cast("string"), x["end"].cast("string"))), ",")


def found(docs: DataFrame) -> DataFrame:
    """Rows (row, spans): each input row as struct ``row`` with its spans.  The
    generator keeps them from being computed again wherever they are used."""
    return docs.select(F.struct("*").alias("row")).select("row", F.explode(F.array(spans_column(F.col("row.text")))).alias("spans"))


def report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_<base kind>, base spans and all spans as text."""
    base = F.filter("spans", lambda x: x["kind"] < len(BASE))

    def count(i: int) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == i)).cast("bigint")
    per = [count(i).alias(f"n_{k}") for i, k in enumerate(BASE)]
    return found(docs).select("row.doc_id", *per, spans_text(base).alias("base_spans"), spans_text(F.col("spans")).alias("spans"))


def masked(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of ``text`` replaced by ``[SECRET]`` (spans that
    overlap by one); all other columns stay."""
    text = F.col("row.text")
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def union(acc: Column, x: Column) -> Column:
        last, here = F.element_at(acc, -1), F.struct(x["start"].alias("start"), x["end"].alias("end"))
        wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        return F.when((F.size(acc) == 0) | (x["start"] >= F.try_element_at(acc, F.lit(-1))["end"]), F.concat(acc, F.array(here))) \
            .otherwise(F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(wider)))

    def pieces(u: Column) -> Column:
        before = F.transform(u, lambda x, k: _let(
            F.when(k == 0, F.lit(0).cast("bigint")).otherwise(F.get(u, k - 1)["end"]),
            lambda a: F.concat(F.substr(text, (a + 1).cast("int"), (x["start"] - a).cast("int")), F.lit("[SECRET]"))))
        return F.concat(F.array_join(before, ""), F.substr(text, (F.element_at(u, -1)["end"] + 1).cast("int"), F.length(text)))
    new = F.when(F.size("spans") == 0, text).otherwise(_let(F.aggregate("spans", none, union), pieces))
    return found(docs).select(*[(new if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns])
