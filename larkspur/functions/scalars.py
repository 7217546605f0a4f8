"""Column expressions for observations: numbers in text, months, seasons, departures, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Numbers and texts that stand for "missing" and "trace".
MISSING = (-999.0, -99.9, 999.9, 9999.0, -9999.0, 99.9)
TRACE = ("t", "tr", "trace")
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
SEASONS = {"JF": (1, 2), "MAM": (3, 4, 5), "JJAS": (6, 7, 8, 9), "OND": (10, 11, 12)}
BANDS = (("Large Excess", 60.0), ("Excess", 20.0), ("Normal", -19.0), ("Deficient", -59.0), ("Large Deficient", -99.0), ("No Rain", -100.0))

#: What counts as a number once signs of grouping and currency are gone.
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def parse_number(c: Column, missing: tuple[float, ...] = MISSING) -> Column:
    """struct(value, text, is_missing, is_trace) of a text cell.

    Blank and the codes in ``missing`` give no value; trace words give 0.0 and the
    trace flag; brackets around the whole negate; a percent sign, in brackets
    too, divides by 100; other text is passed on as text, also a number with a
    footnote in brackets.
    """
    t = F.trim(F.coalesce(c, F.lit("")))
    # a plain number, as nearly all are, takes one pattern
    number = t.try_cast("double")
    code = number.isin(*missing)
    plain = F.struct(F.when(~code, number).alias("value"), F.lit(None).cast("string").alias("text"), code.alias("is_missing"), F.lit(False).alias("is_trace"))
    return F.when(t.rlike(NUMBER), plain).otherwise(_written(t, missing))


def _written(t: Column, codes: tuple[float, ...]) -> Column:
    """As ``parse_number``, for any trimmed text."""
    trace = F.lower(t).isin(*TRACE)
    held = t.startswith("(") & t.endswith(")")
    inner = F.regexp_replace(F.regexp_replace(t, r"^[()]+|[()]+$", ""), r"[,\s₹$€£¥]", "")
    bare = F.regexp_replace(inner, "%+$", "")
    raw = F.when(bare.rlike(NUMBER), bare.try_cast("double"))
    value = raw * F.when(held, F.lit(-1.0)).otherwise(F.lit(1.0)) / F.when(inner.endswith("%"), F.lit(100.0)).otherwise(F.lit(1.0))
    missing = (t == "") | F.lower(bare).isin("nan", "inf", "-inf") | F.coalesce(value.isin(*codes), F.lit(False))
    return F.struct(
        F.when(trace, F.lit(0.0)).when(~missing, value).alias("value"),
        F.when(~trace & ~missing & value.isNull(), t).alias("text"),
        (missing & ~trace).alias("is_missing"),
        trace.alias("is_trace"),
    )


def _spellings(months) -> str:
    """A pattern of the months' names, and of what begins them with three letters at least."""
    cut = lambda name: name[:3] + "".join(f"(?:{x}" for x in name[3:]) + ")?" * len(name[3:])
    return "^(?:" + "|".join(cut(MONTHS[k - 1]) for k in sorted(set(months)) if 1 <= k <= 12) + ")$"


def _letters(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"[^A-Za-z]", ""))


def month_number(c: Column) -> Column:
    """1..12 from a month's name or at least its first three letters, else null."""
    first = F.create_map(*[F.lit(x) for k, m in enumerate(MONTHS, 1) for x in (m[:3], k)])
    t = _letters(c)
    return F.when(t.rlike(_spellings(range(1, 13))), F.try_element_at(first, F.left(t, F.lit(3))))


def in_months(c: Column, months) -> Column:
    """As ``month_number(c).isin(*months)``, by one pattern."""
    return _letters(c).rlike(_spellings(months))


def season(month: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for name, months in SEASONS.items():
        out = out.when(month.isin(*months), F.lit(name))
    return out


def departure(value: Column, normal: Column) -> Column:
    """Percent by which a value departs from its normal; null for no or zero normal."""
    return F.try_divide((value - normal) * 100.0, normal)


def departure_band(percent: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for name, least in BANDS:
        out = out.when(percent >= least, F.lit(name))
    return out


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), 1)


def row_hash(*columns: Column) -> Column:
    """First 16 hex digits of SHA-1 over the values; null is a value of its own."""
    return F.substring(F.sha1(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("None")) for c in columns])), 1, 16)


# Marks of a station's type that stand in its name.
STATION_MARKS = ("(a)", "ams", "mo")


def station_name(c: Column, names: dict[str, str]) -> Column:
    """A station's present name in lower case, without type marks (whole words only) and brackets."""
    words = "|".join(m for m in STATION_MARKS if m.isalpha())
    brackets = "|".join(f"\\({m.strip('()')}\\)" for m in STATION_MARKS if not m.isalpha())
    bare = F.regexp_replace(F.lower(c), f"{brackets}|\\b({words})\\b|[()]", " ")
    return alias(F.regexp_replace(bare, r"\s+", " "), names)


def ist_from_utc(c: Column) -> Column:
    """A UTC time in Indian time, five and a half hours ahead."""
    return c + F.expr("INTERVAL '05:30' HOUR TO MINUTE")


def alias(c: Column, names: dict[str, str]) -> Column:
    """Former names replaced by current ones; any other stays, in lower case."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    key = F.lower(F.trim(c))
    return F.coalesce(F.try_element_at(table, key), key)
