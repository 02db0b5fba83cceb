"""Delimited records that may fail to parse.

Every field is loaded as nullable text; cast and constraint rules are evaluated as columns
into one array of faults per record; records with an empty array are the sound ones, the
others leave with their reasons. Nothing is dropped and nothing throws.

Quoting is decided by the text between quote characters alone: split at the quote
character, pieces at even places lie outside quotes, pieces at odd places inside. An outside
piece between two quotes is either empty (a doubled quote inside a field) or starts and ends
with the delimiter; the first ends with it, the last starts with it; and the number of
quotes is even. This needs no regular expression with a repeated group, so it holds for
texts of any length.

Defined results: a null record has one empty field, hence ``column_count``; an empty field,
quoted or not, is null; line breaks inside or outside quotes belong to the field.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_ymd

AMOUNT = r"^-?[0-9]+(\.[0-9]+)?\z"
_SEP, _ESC = "\u0001", "\u0002"


def quoting_fault(pieces: Column, count: Column, delimiter: str = ",") -> Column:
    """True where a quote neither encloses a whole field nor is doubled inside one, or isn't closed.

    ``pieces`` is the record split at the quote character, ``count`` their number; both should be columns,
    not expressions, so they are computed once a record.
    """
    d = F.lit(delimiter)

    def wrong(p: Column, i: Column) -> Column:
        first, last = i == 0, i == count - 1
        return (i % 2 == 0) & (p != "") & ~((first | F.startswith(p, d)) & (last | F.endswith(p, d)))

    return F.when(count == 1, False).otherwise((count % 2 == 0) | F.exists(F.transform(pieces, wrong), lambda x: x))


def fields(raw: Column, pieces: Column, count: Column, delimiter: str = ",", quote: str = '"') -> Column:
    """The fields of a soundly quoted record, as an array of text; quotes removed, doubled ones halved."""
    sep, esc, d = F.lit(_SEP), F.lit(_ESC), F.lit(delimiter)
    safe = lambda p: F.replace(F.replace(p, esc, F.lit(_ESC + "b")), sep, F.lit(_ESC + "a"))
    back = lambda p: F.replace(F.replace(p, F.lit(_ESC + "a"), sep), F.lit(_ESC + "b"), esc)

    def piece(p: Column, i: Column) -> Column:
        return F.when(i % 2 == 1, safe(p)).when((i > 0) & (i < count - 1) & (p == ""), F.lit(quote)).otherwise(F.replace(safe(p), d, sep))

    quoted = F.transform(F.split(F.array_join(F.transform(pieces, piece), ""), _SEP, -1), back)
    return F.when(count == 1, F.split(raw, f"[{delimiter}]", -1)).otherwise(quoted)


def parse(df: DataFrame, raw: str, names: list[str], rules: dict[str, tuple[str, callable]], delimiter: str = ",", quote: str = '"') -> DataFrame:
    """The input's columns, ``names`` as text, and ``faults``: an array of reasons in order of precedence.

    ``rules`` maps a field to (reason, predicate of its non-null text that holds for sound values).
    A record with bad quoting has no fields, so nothing else is said of it; one with a wrong number of
    fields is not checked field by field. Parsed fields that clash with the input's columns get the
    suffix ``_field``.
    """
    r = F.coalesce(F.col(f"`{raw}`"), F.lit(""))
    pieces, count = F.col("__pieces"), F.col("__count")
    cut = _once(df.withColumn("__raw", r), __pieces=F.split("__raw", quote, -1))
    cut = cut.withColumn("__count", F.size("__pieces"))
    parted = _once(cut, __f=F.when(~quoting_fault(pieces, count, delimiter), fields(F.col("__raw"), pieces, count, delimiter, quote))).drop("__pieces", "__count", "__raw")
    bad, count_ok = F.col("__f").isNull(), F.size("__f") == len(names)
    field = {n: F.when(count_ok, F.nullif(F.col("__f")[i], F.lit(""))) for i, n in enumerate(names)}
    out = {n if n not in df.columns else f"{n}_field": c for n, c in field.items()}
    checks = [F.when(bad, F.lit("quoting")), F.when(~bad & ~count_ok, F.lit("column_count"))]
    checks += [F.when(~ok(field[n]), F.lit(reason)) for n, (reason, ok) in rules.items()]
    return _once(parted, faults=F.array_compact(F.array(*checks))).withColumns(out).drop("__f")


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once a row.

    They leave a generator of one row, which filters on them and projections above them can't be merged
    into; merged, costly expressions are evaluated once for every use.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def amount_ok(c: Column) -> Column:
    return c.rlike(AMOUNT)


def date_ok(c: Column) -> Column:
    return (c == "00000000") | is_ymd(c)
