"""Command line: from profiles of delivered files to a mapping, the delivery it makes, and the proof of it. Prints JSON lines.

``map`` writes a specification that ``review``, ``certify``, ``transform``, ``validate`` and ``reconcile`` read; checks end with
exit code 0 only if nothing failed.
"""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from .legacy import programs
from .operators import assure, codegen, match, profile, relate, rules
from .plans import spec as specs
from .plans import transforms
from .session import session
from .sources.csv import deliver, dictionary, stage_text


def _show(rows) -> None:
    for r in rows:
        print(json.dumps(r.asDict() if hasattr(r, "asDict") else r.__dict__, default=str, ensure_ascii=False))


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tieout")
    sub = p.add_subparsers(dest="verb", required=True)
    for verb, what in (("profile", "columns of a file"), ("dependencies", "columns filled only for some values of another"), ("findings", "data-quality findings"), ("personal", "columns that look like personal data")):
        sub.add_parser(verb, help=what).add_argument("file")
    sub.add_parser("relate", help="how files join, the primary and the join plan").add_argument("files", nargs="+")
    sub.add_parser("program", help="layouts and code meanings of a program text").add_argument("file")
    sub.add_parser("rules", help="data-quality rules a file implies, and how it keeps them").add_argument("file")
    m = sub.add_parser("map", help="map a file to a target: writes the specification")
    for x in ("file", "source_dictionary", "target_dictionary", "spec"):
        m.add_argument(x)
    for verb, what, more in (("transform", "make the delivery", ("file", "out")), ("validate", "check a delivery against the specification", ("file", "delivered")), ("reconcile", "run the certified rules on both sides", ("file", "delivered")), ("review", "what a person must look at; applies decisions from a JSON file", ("decisions",)), ("certify", "certify the rules the mapping implies", ("who",)), ("script", "write a script: etl, validate or reconcile", ("kind", "out"))):
        v = sub.add_parser(verb, help=what)
        v.add_argument("spec")
        for x in more:
            v.add_argument(x, nargs="?" if x == "decisions" else None)
    a = p.parse_args(argv)
    if a.verb == "program":
        g = programs.parse(Path(a.file).read_text(), a.file)
        print(json.dumps({"program": g.name, "files": g.files, "records": {k: [f.name for f in v] for k, v in g.records.items()}, "codes": programs.code_meanings(g), "coverage": g.coverage()}))
        return 0
    spark = session()
    if a.verb == "relate":
        tabs = {Path(f).stem: stage_text(spark, f) for f in a.files}
        found = relate.discover(tabs)
        start = relate.primary({t: d.count() for t, d in tabs.items()}, found)
        steps, out = relate.join_plan(start, list(tabs), found)
        _show(found)
        print(json.dumps({"primary": start, "steps": [s.__dict__ for s in steps], "excluded": out}))
        return 0
    if a.verb == "rules":
        df = stage_text(spark, a.file)
        _show(rules.run(df, rules.mine(df)).collect())
        return 0
    if a.verb == "map":
        df = stage_text(spark, a.file)
        targets = specs.target_attributes(dictionary(a.target_dictionary))
        maps = match.map_all(df, specs.source_columns(dictionary(a.source_dictionary)), targets, frozenset(r.colname for r in profile.profile(df).where("inferred_type = 'EMPTY'").collect()))
        keys = assure.candidate_keys(df)
        verdict, found, maps = assure.mapping_report(maps, targets, df, keys[0] if keys else None)
        key = next((x.target for x in maps if keys and x.sources == (keys[0],) and x.gate != "reject"), None)
        left = {t.name: assure.default_value(t, Path(a.file).stem) for t in targets if next(x for x in maps if x.target == t.name).gate == "reject"}
        Path(a.spec).write_text(specs.dump(maps, targets, assure.derive_rules(maps, targets, keys, []), key, left))
        _show(found)
        print(json.dumps({"verdict": verdict, "mapped": sum(x.gate != "reject" for x in maps), "of": len(maps)}))
        return 0
    if a.verb in ("transform", "validate", "reconcile", "review", "certify", "script"):
        return _specified(spark, a)
    run = {"profile": profile.profile, "dependencies": profile.dependencies, "findings": profile.findings, "personal": profile.personal_data}[a.verb]
    _show(run(stage_text(spark, a.file)).collect())
    return 0


def _specified(spark, a) -> int:
    maps, targets, certified, key, left = specs.load(Path(a.spec).read_text())
    if a.verb == "review":
        if a.decisions:
            maps = assure.decide(maps, json.loads(Path(a.decisions).read_text()), targets)
            left = {k: v for k, v in left.items() if next(m for m in maps if m.target == k).gate == "reject"}
            Path(a.spec).write_text(specs.dump(maps, targets, certified, key, left))
        for item in assure.review_queue(maps, []):
            print(json.dumps(item, default=list, ensure_ascii=False))
        return 0
    if a.verb == "certify":
        certified = assure.certify(certified, {}, a.who, targets)
        Path(a.spec).write_text(specs.dump(maps, targets, certified, key, left))
        for r in certified:
            print(json.dumps({"id": r.id, "kind": r.kind, "enabled": r.enabled, "by": r.certified_by, "fault": assure.rule_fault(r, targets)}))
        return 0
    if a.verb == "script":
        text = Path(a.spec).read_text()
        Path(a.out).write_text({"etl": lambda: codegen.etl_script(maps, left), "validate": lambda: codegen.validation_script(text), "reconcile": lambda: codegen.reconciliation_script(text)}[a.kind]())
        return 0
    source = stage_text(spark, a.file)
    if a.verb == "transform":
        live = {m.target: m.transform for m in maps if m.gate != "reject" and m.transform is not None}
        deliver(transforms.as_delivered(transforms.project(source, live, left)), a.out)
        return 0
    delivered = stage_text(spark, a.delivered)
    verdict, found = assure.delivered_report(delivered, targets, maps, source, key) if a.verb == "validate" else assure.reconcile(certified, source, delivered, maps, targets)
    _show(found)
    print(json.dumps({"verdict": verdict}))
    return 1 if any(r.status == "fail" for r in found) else 0


if __name__ == "__main__":
    raise SystemExit(main())
