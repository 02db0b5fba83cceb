"""Mappings, targets and rules as JSON documents, so that a certified specification outlives the session that made it."""

from __future__ import annotations

import json
from dataclasses import asdict, fields, replace

from ..operators.assure import Rule
from ..operators.match import Mapping, SourceColumn, Target
from . import transforms as X

TRANSFORMS = {c.__name__: c for c in (X.Copy, X.TrimCopy, X.EnumDecode, X.DateYmd, X.Numeric, X.SplitDate, X.Annualise, X.InListFlag, X.Const, X.SqlExpr)}


def _tuples(v):
    return tuple(map(_tuples, v)) if isinstance(v, list) else v


def _made(cls, d: dict):
    known = {f.name for f in fields(cls)}
    return cls(**{k: _tuples(v) if k != "params" else v for k, v in d.items() if k in known})


def _transform(d: dict | None) -> X.Transform | None:
    return _made(TRANSFORMS[d["kind"]], d) if d else None


def dump(maps: list[Mapping], targets: list[Target], rules: list[Rule] = (), key: str | None = None, unmapped: dict | None = None) -> str:
    def one(m: Mapping) -> dict:
        return asdict(m) | {"transform": {"kind": type(m.transform).__name__} | asdict(m.transform) if m.transform else None}

    return json.dumps({"mappings": [one(m) for m in maps], "targets": [asdict(t) for t in targets], "rules": [asdict(r) for r in rules], "key": key, "unmapped": unmapped or {}}, indent=1, ensure_ascii=False, default=list)


def load(text: str) -> tuple[list[Mapping], list[Target], list[Rule], str | None, dict]:
    d = json.loads(text)
    maps = [replace(_made(Mapping, m | {"transform": None}), transform=_transform(m["transform"])) for m in d["mappings"]]
    return maps, [_made(Target, t) for t in d["targets"]], [_made(Rule, r) for r in d["rules"]], d.get("key"), d.get("unmapped", {})


def source_columns(dictionary: dict) -> list[SourceColumn]:
    """A source dictionary's columns; decodes and aliases may be missing, names may be bare."""
    out = []
    for a in dictionary["attributes"]:
        decode = a.get("value_decode") or a.get("decode") or {}
        out.append(SourceColumn(a["name"], a.get("business_name") or a["name"], a.get("inferred_type") or a.get("type") or "FREE_TEXT", a.get("description") or "", tuple(a.get("aliases") or ()), tuple(decode.items() if isinstance(decode, dict) else map(tuple, decode)), tuple(a.get("evidence") or ())))
    return out


def target_attributes(dictionary: dict) -> list[Target]:
    """A target dictionary's attributes; permitted values may be a list, or a map to their meanings."""
    out = []
    for a in dictionary["attributes"]:
        allowed = a.get("allowed_values") or a.get("allowed") or ()
        meanings = a.get("value_meanings") or a.get("meanings") or (allowed if isinstance(allowed, dict) else {})
        out.append(Target(a["name"], (a.get("type") or "string").lower(), a.get("description") or "", tuple(allowed), tuple(meanings.items()), bool(a.get("nullable", not a.get("required", False)))))
    return out
