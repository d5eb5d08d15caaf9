"""Scalar column functions: tolerant typing, splitting and small lookups.

All of them return built-in Spark expressions (no Python UDF), so they stay
inside whole-stage codegen.  Functions that depend on the input column's type
take the Spark data type (``df.schema[name].dataType``) as a second argument.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------
# Words read as "true" by the tolerant boolean parser (after trim + lower).
TRUE_WORDS = ["true", "1", "vrai", "oui", "yes"]
# Daily administration hours by doses per day ("<n>x/jour"); any other count
# gives a single dose at 08:00.
DOSE_HOURS_BY_FREQUENCY = {
    1: ["08:00"],
    2: ["08:00", "20:00"],
    3: ["08:00", "14:00", "20:00"],
    4: ["08:00", "12:00", "16:00", "20:00"],
}
DEFAULT_DOSE_HOURS = ["08:00"]
# ---------------------------------------------------------------------------

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FRACTIONAL = (T.FloatType, T.DoubleType)
# Python's str.strip() / int() accept surrounding whitespace of any kind.
_WS = r"[\s ]"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Trim all leading/trailing whitespace (not only spaces, unlike ``trim``)."""
    return F.regexp_replace(_c(c), rf"^{_WS}+|{_WS}+$", "")


def nan_to_null(c, dtype: T.DataType | None = None) -> Column:
    """NaN -> NULL for floating columns; other types pass through."""
    c = _c(c)
    if dtype is None or isinstance(dtype, _FRACTIONAL):
        return F.when(F.isnan(c), F.lit(None)).otherwise(c)
    return c


def id_string(c, dtype: T.DataType) -> Column:
    """Identifier normalisation: NULL stays NULL, a whole-valued float becomes
    integer text (42.0 -> '42'), anything else becomes its text."""
    c = _c(c)
    if isinstance(dtype, _FRACTIONAL):
        whole = (c == F.floor(c)) & (F.abs(c) < F.lit(1e38))
        return (F.when(c.isNull() | F.isnan(c), F.lit(None).cast("string"))
                .when(whole, c.try_cast(T.DecimalType(38, 0)).cast("string"))
                .otherwise(c.cast("string")))
    if isinstance(dtype, T.StringType):
        return c
    return c.cast("string")


def safe_int(c, dtype: T.DataType, default=0) -> Column:
    """Tolerant integer: NULL or unparsable -> ``default``.

    Text parses only when it is an optionally signed run of digits with
    surrounding whitespace ('12.5' and '72 kg' give the default); floats
    truncate toward zero; NaN gives the default.
    """
    c = _c(c)
    d = F.lit(default).cast("bigint")
    if isinstance(dtype, T.StringType):
        s = strip_ws(c)
        return F.coalesce(F.when(s.rlike(r"^[+-]?[0-9]+$"), s.try_cast("bigint")), d)
    if isinstance(dtype, _FRACTIONAL):
        return F.coalesce(F.when(~F.isnan(c), c.try_cast("bigint")), d)
    if isinstance(dtype, T.BooleanType):
        return F.coalesce(c.cast("bigint"), d)
    return F.coalesce(c.cast("bigint"), d)


def safe_bool(c, dtype: T.DataType) -> Column:
    """Tolerant boolean: NULL -> false; text is true iff (trim, lower) is one of
    TRUE_WORDS; numbers are true iff non-zero (NaN -> false)."""
    c = _c(c)
    if isinstance(dtype, T.StringType):
        return F.coalesce(F.lower(strip_ws(c)).isin(TRUE_WORDS), F.lit(False))
    if isinstance(dtype, T.BooleanType):
        return F.coalesce(c, F.lit(False))
    if isinstance(dtype, _FRACTIONAL):
        return F.coalesce(F.when(~F.isnan(c), c != 0), F.lit(False))
    return F.coalesce(c != 0, F.lit(False))


def split_value_unit(raw) -> tuple[Column, Column, Column]:
    """Split '5400 ng/L' into (number, unit) with pattern ``([\\d.]+)\\s*(.*)``
    anchored at the start.

    Returns three columns: the numeric value (DOUBLE, NULL when the text does
    not start with a number or the number does not parse), the unit ('' when
    there is no match) and a flag telling whether the number is an integer.
    A text that does not match keeps its raw value in the caller's hands.
    """
    raw = _c(raw)
    pattern = r"^([0-9.]+)[ \t\n\x0B\f\r]*(.*)"
    matched = raw.rlike(r"^[0-9.]")
    number = F.regexp_extract(raw, pattern, 1)
    unit = F.when(matched, F.regexp_extract(raw, pattern, 2)).otherwise(F.lit(""))
    value = F.when(matched, number.try_cast("double"))
    is_int = F.when(matched, ~number.contains("."))
    return value, unit, is_int


def dose_hours(frequency) -> Column:
    """'2x/jour' -> array('08:00','20:00'); unknown counts -> one dose at 08:00."""
    n = F.regexp_extract(_c(frequency), r"^([0-9]+)x/jour", 1).try_cast("int")
    pairs = []
    for k, hours in DOSE_HOURS_BY_FREQUENCY.items():
        pairs += [F.lit(k), F.array(*[F.lit(h) for h in hours])]
    table = F.create_map(*pairs)
    default = F.array(*[F.lit(h) for h in DEFAULT_DOSE_HOURS])
    return F.coalesce(F.try_element_at(table, F.coalesce(n, F.lit(1))), default)


def clamp(d, lo, hi) -> Column:
    """max(lo, min(d, hi))."""
    return F.greatest(_c(lo), F.least(_c(d), _c(hi)))


def resolve_day_month(dm, entree) -> Column:
    """'DD/MM' text without a year -> DATE in the stay's entry year, or the
    next year when that is not a date or falls before the entry (a stay over
    New Year; 29/02 of a stay that began in the year before a leap year)."""
    parts = F.split(_c(dm), "/")

    def in_year(offset: int) -> Column:
        year = (F.year(_c(entree)) + offset).cast("string")
        return F.try_to_timestamp(F.concat_ws("-", year, F.get(parts, 1), F.get(parts, 0)), F.lit("yyyy-M-d")).cast("date")
    return F.coalesce(F.when(in_year(0) >= _c(entree), in_year(0)), in_year(1))


def date_text(ts) -> Column:
    """Date part of a timestamp as 'yyyy-MM-dd' text."""
    return F.date_format(_c(ts), "yyyy-MM-dd")


def patient_label(pid, sexe, age) -> Column:
    """Display label 'id (sexe, age)'."""
    return F.format_string("%s (%s, %s)", _c(pid), _c(sexe), _c(age).cast("string"))


def count_label(role, n) -> Column:
    """Admins see every patient: their count reads 'all'."""
    return F.when(_c(role) == "admin", F.lit("all")).otherwise(_c(n).cast("string"))


def unicode_regex(pattern: str, flags: str | None = None) -> str:
    """Java-regex form of a stored pattern written for Python's ``re``.

    Python's ``\\w`` and case folding are Unicode-aware; Java needs the ``U``
    flag (UNICODE_CHARACTER_CLASS, which implies UNICODE_CASE) for the same.
    """
    inline = "U"
    if flags and "i" in flags.lower():
        inline = "iU"
    return f"(?{inline}){pattern}"
