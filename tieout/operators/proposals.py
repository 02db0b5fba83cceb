"""Proposals from outside, such as a language model's: asked for in batches, tested on the data, never accepted outright.

A provider is anything with :class:`Provider`'s methods. What it says counts only if real columns are named, the expression runs, its
coverage isn't less than what stands, its values have the target's shape and, where values are permitted, are among them. Whatever passes
goes to review.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import transforms as X
from .match import TARGET_FAMILIES, Mapping, SourceColumn, Target, accept_proposal

#: Targets a request, values looked at, and the share of them that must have the target's shape. Fixed values.
BATCH, SAMPLE, SHAPE = 10, 20, 0.6
#: What values of a type look like as text. Fixed values.
SHAPES = {"decimal": r"^[+-]?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$", "date": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"}


@dataclass(frozen=True)
class Proposal:
    target: str
    sql: str | None
    reads: tuple[str, ...] = ()
    why: str = ""


class Provider(Protocol):
    def propose(self, targets: list[Target], sources: list[SourceColumn]) -> Iterable[Proposal]:
        """Expressions for targets; one without an expression says that no source has the target."""

    def map_values(self, target: Target, source: SourceColumn, codes: tuple[str, ...]) -> dict[str, str | None]:
        """Permitted values for source codes."""


def shape_fault(df: DataFrame, sql: str, t: Target) -> str:
    """Why sampled values of an expression don't look like the target, or nothing. Reads at most SAMPLE distinct values: a test of shape."""
    got = [r[0] for r in df.select(F.expr(sql).cast("string").alias("v")).where("v is not null").distinct().limit(SAMPLE).collect()]
    if not got:
        return "no values"
    if t.allowed:
        bad = [v for v in got if v not in t.allowed]
        return f"{bad[0]} is not a permitted value" if bad else ""
    pattern = SHAPES.get(TARGET_FAMILIES.get(t.type, ""))
    import re

    fit = sum(bool(re.match(pattern, v)) for v in got) / len(got) if pattern else 1.0
    return "" if fit >= SHAPE else f"values don't look like {t.type}"


def recover(df: DataFrame, maps: list[Mapping], targets: list[Target], sources: list[SourceColumn], provider: Provider) -> list[tuple[Mapping, str]]:
    """(mapping, why a proposal was refused) of every target; only rejected and unmapped ones are asked for, in batches."""
    by = {t.name: t for t in targets}
    weak = [m.target for m in maps if m.gate == "reject"]
    said: dict[str, Proposal] = {}
    for at in range(0, len(weak), BATCH):
        said |= {p.target: p for p in provider.propose([by[n] for n in weak[at : at + BATCH]], sources) if p.target in weak}
    out = []
    for m in maps:
        p = said.get(m.target)
        if not p or not p.sql:
            out.append((m, ""))
            continue
        new, why = accept_proposal(df, m, p.sql, p.reads)
        why = why or shape_fault(df, p.sql, by[m.target])
        out.append((m, why) if why else (replace(new, notes=(*new.notes, p.why) if p.why else new.notes), ""))
    return out


def verify(maps: list[Mapping], targets: list[Target], sources: list[SourceColumn], provider: Provider) -> list[Mapping]:
    """Contested mappings stand only if the provider picks the same source by itself; without an opinion they stay in review."""
    contested = [m for m in maps if any(n.startswith(("contested", "reassigned")) for n in m.notes)]
    by = {t.name: t for t in targets}
    view = {p.target: p for at in range(0, len(contested), BATCH) for p in provider.propose([by[m.target] for m in contested[at : at + BATCH]], sources)}
    out = []
    for m in maps:
        p = view.get(m.target) if m in contested else None
        if p is not None and tuple(p.reads) != m.sources:
            out.append(Mapping(m.target, (), None, m.signal, notes=(f"the reader of both descriptions chose {', '.join(p.reads) or 'no source'}",)))
        else:
            out.append(m)
    return out


def map_codes(df: DataFrame, m: Mapping, t: Target, source: SourceColumn, provider: Provider) -> tuple[Mapping, str]:
    """Values for codes that have none. Keys must be codes of the column, values permitted ones, and the rebuilt decode must give values."""
    if not m.unmapped_codes or len(m.sources) != 1:
        return m, "no codes without a value"
    codes = {c for c, _ in source.decode}
    said = {k: v for k, v in provider.map_values(t, source, m.unmapped_codes).items() if v is not None}
    if bad := [k for k in said if k not in codes]:
        return m, f"{bad[0]} is not a code of {source.name}"
    if bad := [v for v in said.values() if v not in t.allowed]:
        return m, f"{bad[0]} is not a permitted value"
    known = dict(m.transform.pairs) if isinstance(m.transform, X.EnumDecode) else {}
    decode = X.EnumDecode(source.name, tuple((known | said).items()))
    if not said or df.select(decode.column_of().alias("v")).where("v is not null").isEmpty():
        return m, "gives no values"
    return replace(m, transform=decode, unmapped_codes=tuple(c for c in m.unmapped_codes if c not in said), gate="review", notes=(*m.notes, "codes proposed")), ""
