"""Data-quality rules a table implies: mined from its profile, run in a fixed number of jobs, kept as SQL to run again.

Formats come from columns that look like personal data, calendar dates from date columns, orders of dates from pairs that
keep one on most rows, conditions from mined dependencies, uniqueness from candidate keys. All rules with a predicate
of one row are counted by one aggregate; repeated keys by one grouping over all keys.

Defined results: values that aren't populated break no rule but the conditional ones; a table without rows, or one that implies
nothing, has no rules; a rule that holds everywhere is reported with severity info.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import SENTINELS, populated, q, strip
from ..plans.lineage import stage
from ..plans.transforms import literal, quoted
from .profile import cells, date_orders, dependencies, personal_data, profile

#: A National Insurance number, the pairs of letters never issued, and a postcode. Fixed values.
NI_NUMBER = "^[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z][0-9]{6}[A-D]$"
NI_PAIRS = ("BG", "GB", "KN", "NK", "NT", "TN", "ZZ")
POSTCODE = "^(GIR 0AA|[A-Z]{1,2}[0-9][A-Z0-9]? ?[0-9][A-Z]{2})$"
LEAST_CONFIDENCE = 0.9


@dataclass(frozen=True)
class DataRule:
    """``applies`` and ``violation`` are predicates of one row; a ``unique`` rule counts rows of keys that occur more than once."""

    id: str
    category: str
    columns: tuple[str, ...]
    severity: str
    applies: str
    violation: str
    unique: bool = False

    def sql(self, table: str) -> str:
        return f"SELECT count(*) AS violations FROM {table} WHERE ({self.applies}) AND ({self.violation.replace('{table}', table)})"


def _filled(c: str) -> str:
    x = quoted(c)
    return f"{x} IS NOT NULL AND trim({x}) <> '' AND trim({x}) NOT IN ({', '.join(map(literal, SENTINELS))})"


def _ni(c: str) -> str:
    x = f"trim({quoted(c)})"
    return f"NOT ({x} RLIKE '{NI_NUMBER}' AND substr({x}, 1, 2) NOT IN ({', '.join(map(literal, NI_PAIRS))}))"


def mine(df: DataFrame, columns: list[str] | None = None) -> list[DataRule]:
    """The rules of a table, formats first; a few jobs over weighted values, whatever the number of columns."""
    columns = columns or df.columns
    raw = stage(cells(df, columns))
    prof = {r.colname: r for r in profile(df, columns, raw).collect()}  # one row a column
    kind = {r.colname: r.category for r in personal_data(df, columns, raw=raw).collect()}
    out = []
    for c in columns:
        if kind.get(c) == "National Insurance Number":
            out.append(DataRule(f"ni_format:{c}", "format", (c,), "major", _filled(c), _ni(c)))
        if kind.get(c) == "Postcode":
            out.append(DataRule(f"uk_postcode:{c}", "format", (c,), "minor", _filled(c), f"NOT upper(trim({quoted(c)})) RLIKE '{POSTCODE}'"))
    dates = [c for c in columns if c in prof and prof[c].inferred_type == "DATE_YYYYMMDD"]
    out += [DataRule(f"date_valid:{c}", "validity", (c,), "major", _filled(c), f"try_to_date(trim({quoted(c)}), 'yyyyMMdd') IS NULL") for c in dates]
    if len(dates) > 1:
        for r in date_orders(df, dates).collect():
            out.append(DataRule(f"date_order:{r.lo}<={r.hi}", "consistency", (r.lo, r.hi), "minor", f"({_filled(r.lo)}) AND ({_filled(r.hi)})", f"{quoted(r.lo)} > {quoted(r.hi)}"))
    for r in dependencies(df, columns, prof).where(F.col("confidence") >= LEAST_CONFIDENCE).orderBy("dependent").collect():
        values = ", ".join(map(literal, r.driver_values.split(", ")))
        out.append(DataRule(f"conditional:{r.dependent}", "completeness", (r.dependent, r.driver), "minor", f"trim({quoted(r.driver)}) IN ({values})", f"NOT ({_filled(r.dependent)})"))
    for c in columns:
        p = prof.get(c)
        if p and p.row_count and p.row_count == p.populated_count == p.distinct_count:
            x = quoted(c)
            out.append(DataRule(f"key_unique:{c}", "uniqueness", (c,), "major", _filled(c), f"{x} IN (SELECT {x} FROM {{table}} GROUP BY {x} HAVING count(*) > 1)", True))
    return out


def run(df: DataFrame, rules: list[DataRule]) -> DataFrame:
    """(rule, category, severity, total, failed, pass_rate) of every rule on ``df``, which may be another load than the one they were mined from."""
    spark = df.sparkSession
    schema = "rule string, category string, severity string, total bigint, failed bigint, pass_rate double"
    if not rules:
        return spark.createDataFrame([], schema)
    plain, keys = [r for r in rules if not r.unique], [r for r in rules if r.unique]
    row = lambda r, total, failed: F.struct(F.lit(r.id).alias("rule"), F.lit(r.category).alias("category"), F.lit(r.severity).alias("severity"), total.alias("total"), failed.alias("failed"))
    parts = []
    if plain:
        counts = [x for i, r in enumerate(plain) for x in (F.count_if(F.expr(r.applies)).alias(f"t{i}"), F.count_if(F.expr(f"({r.applies}) AND ({r.violation})")).alias(f"f{i}"))]
        parts.append(df.agg(*counts).select(F.explode(F.array(*[row(r, F.col(f"t{i}"), F.col(f"f{i}")) for i, r in enumerate(plain)])).alias("r")).select("r.*"))
    if keys:
        # a populated value's rows by its stripped form; a key repeated in a third of all rows is one record a map task
        c = cells(df, [r.columns[0] for r in keys]).where(populated(F.col("value")))
        per = c.groupBy("colname").agg(F.sum("n").alias("total"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("failed"))
        named = spark.createDataFrame([(r.columns[0], r.id, r.category, r.severity) for r in keys], "colname string, rule string, category string, severity string")
        parts.append(F.broadcast(named).join(per, "colname", "left").select("rule", "category", "severity", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("failed", F.lit(0)).alias("failed")))  # one row a key rule
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    rate = F.when(F.col("total") > 0, F.round(1 - F.col("failed") / F.col("total"), 4)).otherwise(1.0)
    return out.select("rule", "category", F.when(F.col("failed") > 0, F.col("severity")).otherwise("info").alias("severity"), "total", "failed", rate.alias("pass_rate"))


def samples(df: DataFrame, rule: DataRule, most: int = 3) -> list[str]:
    """The smallest distinct offending values of one rule: a top-k report."""
    shown = F.concat_ws(" > ", *[q(c) for c in rule.columns]) if rule.category == "consistency" else q(rule.columns[-1 if rule.category == "completeness" else 0])
    if rule.unique:
        c = cells(df, [rule.columns[0]]).where(populated(F.col("value")) & (F.col("n") > 1))
        return [r[0] for r in c.select(strip(F.col("value")).alias("v")).distinct().orderBy("v").limit(most).collect()]
    return [r[0] for r in df.where(F.expr(f"({rule.applies}) AND ({rule.violation})")).select(shown.alias("v")).distinct().orderBy("v").limit(most).collect()]
