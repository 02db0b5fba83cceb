"""Column transformations of a mapping, as data. Each renders to a Column and to Spark SQL text."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def literal(value: str | None) -> str:
    return "NULL" if value is None else "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


@dataclass(frozen=True)
class Transform:
    """Base: what columns are read, the expression, and the same as SQL."""

    def sources(self) -> tuple[str, ...]:
        return tuple(getattr(self, a) for a in ("column", "amount", "frequency", "year", "month", "day") if getattr(self, a, None))

    def column_of(self) -> Column:
        return F.expr(self.sql())

    def sql(self) -> str:
        raise NotImplementedError


@dataclass(frozen=True)
class Copy(Transform):
    column: str

    def sql(self) -> str:
        return f"nullif({quoted(self.column)}, '')"


@dataclass(frozen=True)
class TrimCopy(Transform):
    column: str

    def sql(self) -> str:
        return f"nullif(trim({quoted(self.column)}), '')"


@dataclass(frozen=True)
class EnumDecode(Transform):
    """Codes to target values; codes without one become null."""

    column: str
    pairs: tuple[tuple[str, str], ...]

    def sql(self) -> str:
        if not self.pairs:
            return quoted(self.column)
        return f"CASE {quoted(self.column)} " + " ".join(f"WHEN {literal(k)} THEN {literal(v)}" for k, v in self.pairs) + " ELSE NULL END"


@dataclass(frozen=True)
class DateYmd(Transform):
    column: str

    def column_of(self) -> Column:
        return T.to_date(T.q(self.column))

    def sql(self) -> str:
        c = quoted(self.column)
        return f"CASE WHEN {c} RLIKE '^[0-9]{{8}}$' THEN try_to_date({c}, 'yyyyMMdd') END"


@dataclass(frozen=True)
class Numeric(Transform):
    column: str

    def column_of(self) -> Column:
        return T.to_double(T.q(self.column))

    def sql(self) -> str:
        c = quoted(self.column)
        return f"CASE WHEN trim({c}) RLIKE '^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$' THEN try_cast(trim({c}) AS DOUBLE) END"


@dataclass(frozen=True)
class SplitDate(Transform):
    year: str
    month: str | None = None
    day: str | None = None

    def column_of(self) -> Column:
        part = lambda n: T.q(n) if n else F.lit(None).cast("string")
        return T.join_date(part(self.year), part(self.month), part(self.day))

    def sql(self) -> str:
        n = lambda c: f"coalesce(nullif(try_cast({quoted(c)} AS INT), 0), 1)" if c else "1"
        return f"CASE WHEN try_cast({quoted(self.year)} AS INT) > 0 THEN try_to_date(format_string('%04d-%02d-%02d', try_cast({quoted(self.year)} AS INT), {n(self.month)}, {n(self.day)}), 'yyyy-MM-dd') END"


@dataclass(frozen=True)
class Annualise(Transform):
    """An instalment times its instalments a year; unknown frequencies count nothing."""

    amount: str
    frequency: str
    factors: tuple[tuple[str, int], ...] = (("M", 12), ("Q", 4), ("H", 2), ("A", 1))

    def sql(self) -> str:
        return f"try_cast({quoted(self.amount)} AS DOUBLE) * CASE {quoted(self.frequency)} " + " ".join(f"WHEN {literal(k)} THEN {v}" for k, v in self.factors) + " ELSE 0 END"


@dataclass(frozen=True)
class InListFlag(Transform):
    column: str
    values: tuple[str, ...]

    def sql(self) -> str:
        return f"CASE WHEN {quoted(self.column)} IN ({', '.join(map(literal, self.values))}) THEN true ELSE false END" if self.values else "false"


@dataclass(frozen=True)
class Const(Transform):
    value: str | None

    def sql(self) -> str:
        return literal(self.value)


@dataclass(frozen=True)
class SqlExpr(Transform):
    """Certified expression, run as it is after :func:`refusal` found nothing against it."""

    text: str
    reads: tuple[str, ...] = field(default=())

    def sources(self) -> tuple[str, ...]:
        return self.reads

    def sql(self) -> str:
        return self.text


#: Tokens that make an expression's value change from run to run. Fixed values; those of Spark's own functions follow.
NONDETERMINISTIC = (
    "now(", "today(", "random(", "uuid(", "gen_random_uuid",
    "current_timestamp", "current_date", "current_time", "current_localtime",
    "localtimestamp", "localtime", "transaction_timestamp",
    "statement_timestamp", "get_current_timestamp", "nextval", "currval",
    "rand(", "randn(", "monotonically_increasing_id", "shuffle(", "input_file_name",
)
_STATEMENTS = re.compile(r"\b(select|insert|update|delete|drop|create|alter|attach|copy|pragma|call)\s", re.I)
_QUOTED = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`(?:[^`]|``)*`", re.S)


def nondeterministic(sql: str) -> bool:
    return any(t in sql.lower().replace(" ", "") for t in NONDETERMINISTIC)


def refusal(df: DataFrame, sql: str) -> str | None:
    """Why an expression can't be used on ``df``; null if it can. Analyses it, runs nothing."""
    bare = _QUOTED.sub("''", sql)  # what literals and quoted names hold is text
    if ";" in bare or _STATEMENTS.search(bare):
        return "statements are not expressions"
    try:
        df.limit(0).select(F.expr(sql)).schema  # noqa: B018
    except Exception as e:  # the analyser's message is the reason
        return str(e).splitlines()[0][:200]
    return None


def project(df: DataFrame, mapping: dict[str, Transform], unmapped: dict[str, str | None] | None = None) -> DataFrame:
    """The target rows: every mapped attribute, then unmapped ones with their default text. One projection."""
    out = {a: t.column_of() for a, t in mapping.items()} | {a: F.lit(v).cast("string") for a, v in (unmapped or {}).items()}
    return df.select(*[c.alias(a) for a, c in out.items()])


def as_delivered(df: DataFrame) -> DataFrame:
    """All columns as text, the way a delivered file holds them."""
    return df.select(*[T.canonical_text(T.q(c), k).alias(c) for c, k in df.dtypes])
