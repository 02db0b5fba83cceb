"""Column expressions over delivered text. All of them stay in generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values that stand for "not set" when data is profiled. Fixed values.
SENTINELS = ("00000000", "99999999", "99991231", "0000-00-00", "9999-12-31", "N/A", "NA", "NULL", "NONE", "UNKNOWN", "-", ".", "?")
#: Values that count as unset when a mapping's coverage is measured. Fixed values.
UNSET = ("00000000", "")

#: Characters Unicode calls white space. Fixed values.
WHITE_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
PLAIN_NUMBER = r"^[+-]?([0-9]{1,3}(,[0-9]{3})+|[0-9]+)?(\.[0-9]*)?$"


def q(name: str) -> Column:
    """A column by its exact name, whatever characters the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def strip(c: Column) -> Column:
    """Without any white space at either end (SQL trim removes blanks only)."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def populated(c: Column) -> Column:
    """Profiling's notion: neither null, blank nor a sentinel after stripping white space."""
    t = strip(c)
    return c.isNotNull() & (t != "") & ~t.isin(*SENTINELS)


def is_set(c: Column) -> Column:
    """Mapping's notion: neither null, empty nor zeros; white space is not stripped."""
    return c.isNotNull() & ~c.cast("string").isin(*UNSET)


def blank(c: Column) -> Column:
    """Delivered files' notion: null or empty."""
    return c.isNull() | (c.cast("string") == "")


def to_double(c: Column) -> Column:
    """A number or null. The pattern keeps out what a cast alone would accept, such as 1d, NaN or Infinity."""
    return F.when(F.trim(c).rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\z"), F.trim(c).try_cast("double"))


def to_date(c: Column) -> Column:
    """YYYYMMDD to a date; unset or impossible ones to null."""
    return F.when(is_ymd(c), F.make_date(F.substring(c, 1, 4).try_cast("int"), F.substring(c, 5, 2).try_cast("int"), F.substring(c, 7, 2).try_cast("int")))


def join_date(y: Column, m: Column, d: Column) -> Column:
    """A date from parts kept in columns of their own: no year, no date; no month or day, the first; impossible, null."""
    whole = lambda c: F.trim(c.cast("string")).try_cast("int")
    part = lambda c: F.coalesce(F.nullif(whole(c), F.lit(0)), F.lit(1))
    return F.when(calendar_day(whole(y), part(m), part(d)), F.make_date(whole(y), part(m), part(d)))


def canonical_text(c: Column, kind: str) -> Column:
    """How a typed value is written in a delivered file: doubles without exponents, everything else as cast."""
    t = c.cast("string")
    if kind not in ("double", "float"):
        return t
    plain = F.regexp_replace(t.cast("decimal(38,20)").cast("string"), r"0+$", "")
    plain = F.when(F.endswith(plain, F.lit(".")), F.concat(plain, F.lit("0"))).otherwise(plain)
    size = F.abs(c)
    return F.when(F.contains(t, F.lit("E")) & (size >= 1e-4) & (size < 1e15), plain).otherwise(t)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def calendar_day(y: Column, m: Column, d: Column) -> Column:
    """Whether three integers are a day of the calendar. Plain arithmetic: no parser, hence no exception per bad row."""
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    last = F.when(m.isin(4, 6, 9, 11), 30).when((m == 2) & leap, 29).when(m == 2, 28).otherwise(31)
    return y.between(1, 9999) & m.between(1, 12) & (d >= 1) & (d <= last)


def is_ymd(c: Column, first_year: int = 1, last_year: int = 9999) -> Column:
    """Exactly YYYYMMDD and a calendar date of the given years; null for null."""
    part = lambda a, n: F.substring(c, a, n).try_cast("int")
    y = part(1, 4)
    fine = c.rlike(r"^[0-9]{8}\z") & y.between(first_year, last_year) & calendar_day(y, part(5, 2), part(7, 2))
    return F.when(c.isNull(), F.lit(None).cast("boolean")).otherwise(F.coalesce(fine, F.lit(False)))


def canonical_number(c: Column) -> Column:
    """Text that is equal for plain numbers of equal value, else the text as it is.

    A plain number has an optional sign, digits with or without thousands commas, an
    optional decimal part and blanks around it. Works on the digits, so it is exact at
    any length.
    """
    t = F.trim(c)
    plain = t.rlike(PLAIN_NUMBER) & t.rlike("[0-9]")
    digits = F.regexp_replace(t, r"[+,-]", "")
    whole = F.regexp_replace(F.substring_index(digits, ".", 1), "^0+", "")
    frac = F.when(F.instr(digits, ".") > 0, F.regexp_replace(F.substring_index(digits, ".", -1), "0+$", "")).otherwise("")
    body = F.concat(F.when(whole == "", "0").otherwise(whole), F.when(frac == "", "").otherwise(F.concat(F.lit("."), frac)))
    signed = F.when(F.startswith(t, F.lit("-")) & (body != "0"), F.concat(F.lit("-"), body)).otherwise(body)
    return F.when(plain, F.concat(F.lit("#"), signed)).otherwise(F.concat(F.lit("'"), c))
