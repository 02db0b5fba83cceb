"""Standalone PySpark scripts of what the engine ran: the ETL, its validation, its reconciliation, the rule library.

Scripts hold the same check data the engine fuses, so a script and a run can't disagree on what is checked.
Checking scripts end with exit code 0 only if everything passed.
"""

from __future__ import annotations

import json

from ..plans.checks import Check
from .match import Mapping

_HEAD = '''"""Written by tieout. Run with: spark-submit {name} INPUT{more}"""

import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.sql.timeType.enabled", "true").getOrCreate()
src = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(sys.argv[1])
'''


def etl_script(maps: list[Mapping], unmapped: dict[str, str | None], name: str = "etl.py") -> str:
    pairs = {m.target: m.transform.sql() for m in maps if m.gate != "reject" and m.transform is not None}
    return _HEAD.format(name=name, more=" OUTPUT") + (
        f"TARGETS = {json.dumps(pairs, indent=4, ensure_ascii=False)}\nDEFAULTS = {unmapped!r}\n"
        "out = src.select(*[F.expr(e).cast('string').alias(a) for a, e in TARGETS.items()], *[F.lit(v).cast('string').alias(a) for a, v in DEFAULTS.items()])\n"
        "out.write.mode('overwrite').option('header', True).csv(sys.argv[2])\n"
    )


def check_script(checks: list[Check], name: str = "validate.py") -> str:
    rows = [[c.name, c.category, c.severity, c.applies, c.violation] for c in checks]
    return _HEAD.format(name=name, more="") + (
        f"CHECKS = {json.dumps(rows, indent=4, ensure_ascii=False)}\n"
        "aggs = [F.count_if(F.expr(f'({a}) AND ({v})')).alias(f'v{i}') for i, (_, _, _, a, v) in enumerate(CHECKS)]\n"
        "row = src.agg(*aggs).first()\n"
        "bad = 0\n"
        "for i, (n, c, s, _, _) in enumerate(CHECKS):\n"
        "    print('PASS' if not row[f'v{i}'] else 'FAIL', n, row[f'v{i}'])\n"
        "    bad += bool(row[f'v{i}'])\n"
        "sys.exit(1 if bad else 0)\n"
    )


_CHECKING = '''"""Written by tieout. Run with: spark-submit {name} SOURCE.csv DELIVERED.csv (tieout on the path)"""

import sys

from tieout.operators import assure
from tieout.plans import spec
from tieout.session import session
from tieout.sources.csv import stage_text

SPEC = {spec}

spark = session("{name}")
maps, targets, rules, key, _ = spec.load(SPEC)
source, delivered = stage_text(spark, sys.argv[1]), stage_text(spark, sys.argv[2])
verdict, results = {call}
for r in results:
    print(r.status.upper(), r.name, f"{{r.offending}} of {{r.total}}", r.reason, *r.sample[:3])
failed = [r for r in results if r.status == "fail"]
print(verdict, f"{{len(failed)}} failed")
sys.exit(1 if failed else 0)
'''


def validation_script(spec_json: str, name: str = "validate.py") -> str:
    """The whole delivered report (columns, grain, key, completeness, domain, type, duplicates, values recomputed), as the engine runs it."""
    return _CHECKING.format(name=name, spec=repr(spec_json), call="assure.delivered_report(delivered, targets, maps, source, key)")


def reconciliation_script(spec_json: str, name: str = "reconcile.py") -> str:
    """The certified rules of a specification, as the engine runs them; exit code 0 only if all pass."""
    return _CHECKING.format(name=name, spec=repr(spec_json), call="assure.reconcile(rules, source, delivered, maps, targets)")


def rule_library(checks: list[Check], table: str, suppressed: dict[str, str] | None = None) -> str:
    """Annotated SQL of a rule library; suppressed rules are commented out with their note."""
    out = [f"-- Data-quality rules of {table}\n"]
    for c in checks:
        sql = f"-- {c.name} [{c.category}/{c.severity}]\n{c.evidence(table)};"
        if note := (suppressed or {}).get(c.name):
            sql = f"-- suppressed: {note}\n" + "\n".join("-- " + line for line in sql.splitlines())
        out.append(sql)
    return "\n\n".join(out) + "\n"


def spec_sql(maps: list[Mapping], source: str, target: str) -> str:
    cols = ",\n  ".join(f"{m.transform.sql()} AS `{m.target}`" for m in maps if m.gate != "reject" and m.transform is not None)
    return f"CREATE TABLE {target} AS SELECT\n  {cols}\nFROM {source}"


def spec_markdown(maps: list[Mapping]) -> str:
    rows = [f"| {m.target} | {', '.join(m.sources)} | {m.confidence:.2f} | {m.gate} | `{m.transform.sql() if m.transform else ''}` |" for m in maps]
    return "| Target | Sources | Confidence | Gate | Expression |\n|---|---|---|---|---|\n" + "\n".join(rows) + "\n"
