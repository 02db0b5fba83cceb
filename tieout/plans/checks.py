"""Checks as data, and their fusion into one aggregate.

A check has rows it applies to and rows that violate it. Any number of them cost one scan:
``count_if`` pairs in a single aggregate. Samples are a second job over failing checks only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HARD, SOFT = "hard", "soft"


@dataclass(frozen=True)
class Check:
    name: str
    category: str
    severity: str
    attribute: str
    applies: str
    violation: str
    why: str = ""

    def evidence(self, table: str) -> str:
        return f"SELECT count_if({self.violation}) FROM {table} WHERE {self.applies}"


@dataclass
class Result:
    name: str
    category: str
    severity: str
    status: str
    total: int
    offending: int
    sql: str
    attribute: str = ""
    reason: str = ""
    sample: tuple = ()


def fuse(df: DataFrame, checks: list[Check]) -> DataFrame:
    """(check_name, category, severity, attribute, total, violations), one aggregate over ``df`` for all."""
    counts = [c for i, k in enumerate(checks) for c in (F.count_if(F.expr(k.applies)).alias(f"t{i}"), F.count_if(F.expr(f"({k.applies}) AND ({k.violation})")).alias(f"v{i}"))]
    rows = F.explode(F.array(*[F.struct(F.lit(k.name).alias("check_name"), F.lit(k.category).alias("category"), F.lit(k.severity).alias("severity"), F.lit(k.attribute).alias("attribute"), F.col(f"t{i}").alias("total"), F.col(f"v{i}").alias("violations")) for i, k in enumerate(checks)]))
    return df.agg(*counts).select(rows.alias("r")).select("r.*")


def run(df: DataFrame, checks: list[Check], table: str = "target", samples: int = 10, sample_of: tuple[str, ...] = ()) -> list[Result]:
    """All checks in one job; samples of failing ones in one more. Results are as many as the checks."""
    if not checks:
        return []
    got = {r.check_name: r for r in fuse(df, checks).collect()}
    out = []
    for k in checks:
        r = got[k.name]
        out.append(Result(k.name, k.category, k.severity, "pass" if not r.violations else "fail", r.total, r.violations, k.evidence(table), k.attribute, k.why))
    failing = [(k, o) for k, o in zip(checks, out) if o.offending]
    if failing and samples:
        shown = lambda k: F.concat_ws(" | ", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("NULL")) for c in dict.fromkeys((*sample_of, *([k.attribute] if k.attribute in df.columns else [])))] or [F.lit("")])
        picks = [F.when(F.expr(f"({k.applies}) AND ({k.violation})"), F.struct(F.lit(i).alias("i"), shown(k).alias("s"))) for i, (k, _) in enumerate(failing)]
        hits = df.select(F.explode(F.array_compact(F.array(*picks))).alias("h")).select("h.*").distinct()
        for r in _few(hits, samples):
            failing[r.i][1].sample = tuple(r.s)
    return out


def _few(hits: DataFrame, n: int):
    """The smallest n samples of each check, by a window, so no group is gathered whole."""
    w = Window.partitionBy("i").orderBy("s")
    return hits.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).groupBy("i").agg(F.array_sort(F.collect_list("s")).alias("s")).collect()


def verdict(results: list[Result]) -> str:
    """Blocked by a hard failure, in need of review by any other; skipped and warned checks decide nothing."""
    failed = [r for r in results if r.status == "fail"]
    return "blocked" if any(r.severity == HARD for r in failed) else "needs_review" if failed else "certified"
