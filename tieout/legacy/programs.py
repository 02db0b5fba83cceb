"""COBOL programs and PHP screens as data: layouts, I/O, code meanings, def-use slices, guards.

A program is a few thousand lines, so parsing is plain Python; an estate of programs is parsed in
parallel by :func:`parse_estate`, one text a row.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

_FIELD = re.compile(r"^\s*(\d\d)\s+([A-Z0-9-]+)(.*)$", re.I)
_PIC = re.compile(r"\bPIC(?:TURE)?(?:\s+IS)?\s+(\S+?)\.?(?:\s|$)", re.I)
_VALUE = re.compile(r"\bVALUES?(?:\s+(?:IS|ARE))?\s+(.*?)\.?\s*$", re.I)
_PARAGRAPH = re.compile(r"^\s{0,7}([A-Z0-9][A-Z0-9-]*)\.\s*$", re.I)
_TOKEN = re.compile(r"[A-Z][A-Z0-9-]*[A-Z0-9]|[A-Z]", re.I)
#: Verbs whose statements are understood; the share of them is a program's parse coverage. Fixed values.
VERBS = frozenset("MOVE ADD SUBTRACT MULTIPLY DIVIDE COMPUTE IF ELSE END-IF EVALUATE WHEN END-EVALUATE PERFORM GO DISPLAY READ WRITE OPEN CLOSE STOP GOBACK EXIT SET INITIALIZE ACCEPT REWRITE CALL STRING".split())
ARITHMETIC = frozenset("ADD SUBTRACT MULTIPLY DIVIDE COMPUTE".split())
_NOISE = frozenset("TO GIVING FROM BY INTO ROUNDED OF IN THAN EQUAL IS NOT AND OR GREATER LESS ZERO ZEROS SPACES TRUE OTHER UNTIL VARYING END-COMPUTE FUNCTION".split())


@dataclass
class Field:
    level: int
    name: str
    pic: str
    position: int
    conditions: dict[str, str] = field(default_factory=dict)


@dataclass
class Paragraph:
    name: str
    statements: list[str]

    def targets(self) -> set[str]:
        return set().union(*(assigned(s) for s in self.statements)) if self.statements else set()


@dataclass
class Program:
    name: str
    records: dict[str, list[Field]]
    files: dict[str, str]
    copybooks: list[str]
    paragraphs: list[Paragraph]

    def coverage(self) -> float:
        s = [x for p in self.paragraphs for x in p.statements]
        return sum(x.split(None, 1)[0].upper() in VERBS for x in s) / len(s) if s else 1.0


def _clean(text: str) -> list[str]:
    """Code lines without sequence numbers and comments."""
    out = []
    for line in text.splitlines():
        if len(line) > 6 and line[6] in "*/":
            continue
        if re.match(r"^[0-9]{6}", line):
            line = " " * 6 + line[6:72]
        line = re.sub(r"\*>.*$", "", line).rstrip()
        if line.strip() and not line.lstrip().startswith("*"):
            out.append(line)
    return out


def parse(text: str, name: str = "") -> Program:
    lines = _clean(text)
    m = re.search(r"PROGRAM-ID\.\s*([A-Z0-9-]+)", text, re.I)
    files, copies, records = {}, [], {}
    for f, a in re.findall(r"SELECT\s+([A-Z0-9-]+)\s+ASSIGN(?:\s+TO)?\s+\"?([A-Z0-9.-]+?)\"?[.\s]", text + " ", re.I):
        files[f.upper()] = a.upper()
    copies = [c.upper() for c in re.findall(r"\bCOPY\s+([A-Z0-9-]+)", text, re.I)]
    current: list[Field] | None = None
    in_procedure = False
    paragraphs: list[Paragraph] = []
    buffer = ""
    for line in lines:
        if re.search(r"PROCEDURE\s+DIVISION", line, re.I):
            in_procedure = True
            continue
        if in_procedure:
            if pm := _PARAGRAPH.match(line):
                paragraphs.append(Paragraph(pm[1].upper(), []))
                continue
            buffer += " " + line.strip()
            while paragraphs and (cut := re.match(r"\s*(.+?)(?:\.(?:\s+|$)|(?=\s(?:" + "|".join(sorted(VERBS, key=len, reverse=True)) + r")\b))(.*)$", buffer, re.I)):
                paragraphs[-1].statements.append(cut[1].strip())
                buffer = cut[2]
                if not buffer.strip():
                    break
            if line.rstrip().endswith(".") and buffer.strip() and paragraphs:
                paragraphs[-1].statements.append(buffer.strip().rstrip("."))
                buffer = ""
            continue
        fm = _FIELD.match(line)
        if not fm:
            continue
        level, fname, rest = int(fm[1]), fm[2].upper(), fm[3]
        if level == 88:
            if current and (vm := _VALUE.search(rest)):
                for v in re.findall(r"'([^']*)'|\"([^\"]*)\"|(\d+)", vm[1]):
                    current[-1].conditions[next(x for x in v if x != "")] = fname
        elif level in (1, 77):
            current = records.setdefault(fname, [])
            if pic := _PIC.search(rest):
                current.append(Field(level, fname, pic[1], 1))
        elif level != 66 and current is not None and (pic := _PIC.search(rest)):
            current.append(Field(level, fname, pic[1].rstrip("."), len(current) + 1))
    return Program((m[1] if m else name).upper(), {k: v for k, v in records.items() if v}, files, copies, paragraphs)


def assigned(statement: str) -> set[str]:
    """Variables a statement gives a value."""
    s = statement.upper()
    verb = s.split(None, 1)[0]
    if verb == "MOVE" and " TO " in s:
        part = s.split(" TO ", 1)[1]
    elif verb in ("ADD", "SUBTRACT", "MULTIPLY", "DIVIDE"):
        part = s.split(" GIVING ", 1)[1] if " GIVING " in s else re.split(r" TO | FROM | BY | INTO ", s)[-1]
    elif verb == "COMPUTE" and "=" in s:
        part = s[7:].split("=", 1)[0]
    elif verb in ("SET", "INITIALIZE", "ACCEPT"):
        part = s.split(None, 1)[1].split(" TO ", 1)[0] if " " in s else ""
    else:
        return set()
    return {t for t in _TOKEN.findall(part) if t not in _NOISE}


def used(statement: str) -> set[str]:
    words = set(_TOKEN.findall(re.sub(r"'[^']*'|\"[^\"]*\"", " ", statement.upper())))
    return words - _NOISE - VERBS - assigned(statement)


def backward_slice(program: Program, variable: str) -> tuple[list[Paragraph], set[str], float]:
    """Paragraphs and variables a value depends on, to a fixed point, with the parse coverage.

    Seeds are the paragraphs that assign the variable; working variables they use are followed, record
    fields are inputs and end the search.
    """
    inputs = {f.name for fs in program.records.values() for f in fs if f.level > 1}
    seeds = [p for p in program.paragraphs if variable.upper() in p.targets()]
    reached: set[str] = {variable.upper()}
    assignable = set().union(*(p.targets() for p in program.paragraphs)) if program.paragraphs else set()
    while True:
        live = [p for p in program.paragraphs if p.targets() & reached]
        more = {v for p in live for s in p.statements if assigned(s) & reached for v in used(s) if v in assignable - inputs} - reached
        if not more:
            return (live if seeds else []), reached, program.coverage()
        reached |= more


def code_meanings(program: Program) -> dict[str, dict[str, str]]:
    """Field to {code: meaning} from condition names and from EVALUATE branches that display or move a literal."""
    out: dict[str, dict[str, str]] = {}
    for fs in program.records.values():
        for f in fs:
            if f.conditions:
                out[f.name] = {c: humanise(n) for c, n in f.conditions.items()}
    for p in program.paragraphs:
        subject, code = None, None
        for s in p.statements:
            u = s.upper()
            if m := re.match(r"EVALUATE\s+([A-Z0-9-]+)", u):
                subject = m[1]
            elif u.startswith("END-EVALUATE"):
                subject = None
            elif subject and (m := re.match(r"WHEN\s+['\"]?([A-Z0-9]+)['\"]?", u)):
                code = m[1]
                if d := re.search(r"(?:DISPLAY|MOVE)\s+['\"]([^'\"]+)['\"]", s, re.I):
                    out.setdefault(subject, {}).setdefault(code, d[1].strip())
            elif subject and code and (d := re.match(r"(?:DISPLAY|MOVE)\s+['\"]([^'\"]+)['\"]", s, re.I)):
                out.setdefault(subject, {}).setdefault(code, d[1].strip())
    return out


def guarded_rules(program: Program, variable: str) -> list[tuple[str, tuple[str, ...]]]:
    """(statement, guards): each assignment of a variable with the conditions it runs under."""
    out = []
    for p in program.paragraphs:
        guards: list[str] = []
        for s in p.statements:
            u = s.upper()
            if u.startswith("IF "):
                guards.append(re.sub(r"\s+THEN$", "", s[3:].strip(), flags=re.I))
            elif u.startswith("ELSE") and guards:
                guards[-1] = f"NOT ({guards[-1]})"
            elif u.startswith(("END-IF", "END-EVALUATE")) and guards:
                guards.pop()
            elif u.startswith("EVALUATE "):
                guards.append(s[9:].strip())
            elif u.startswith("WHEN ") and guards:
                guards[-1] = f"{guards[-1].split(' = ')[0]} = {s[5:].strip()}"
            if variable.upper() in assigned(s):
                out.append((s, tuple(guards)))
    return out


def humanise(name: str) -> str:
    return " ".join(w.capitalize() for w in re.split(r"[-_]+", name) if w)


def screen(text: str) -> dict:
    """Columns, code arrays and labels of a PHP screen."""
    cols = [c.strip().strip("`\"") for m in re.findall(r"SELECT\s+(.*?)\s+FROM", text, re.I | re.S) for c in m.split(",")]
    decodes = {n: dict(re.findall(r"['\"]([^'\"]+)['\"]\s*=>\s*['\"]([^'\"]*)['\"]", body)) for n, body in re.findall(r"\$(\w+)\s*=\s*(?:array\(|\[)(.*?)(?:\)|\])\s*;", text, re.S)}
    labels = {c: label.strip().rstrip(":") for label, c in re.findall(r"<(?:th|label|td)[^>]*>([^<]+)</(?:th|label|td)>\s*(?:<td[^>]*>)?\s*<\?(?:php|=)[^?]*\[['\"](\w+)['\"]\]", text, re.I)}
    return {"columns": cols, "decodes": decodes, "labels": labels}


#: Inferred types whose values a numeric picture can hold. Fixed values.
NUMERIC_TYPES = frozenset(("DATE_YYYYMMDD", "DECIMAL", "INTEGER", "IDENTIFIER"))


def layout_for(program: Program, columns: list[str], types: list[str] | None = None) -> list[tuple[str, str]]:
    """(field, column) by position, of a record with exactly as many fields as the extract has columns.

    Of several such records the one whose pictures fit the columns' inferred types best is meant, then the one whose fields the
    procedure uses most.
    """
    fit = [fs for fs in program.records.values() if len(fs) == len(columns)]
    if not fit:
        return []
    words = Counter(t for p in program.paragraphs for s in p.statements for t in _TOKEN.findall(s.upper()))
    numeric = lambda f: bool(re.match(r"S?9", f.pic.upper()))
    agree = lambda fs: sum((1 if k in NUMERIC_TYPES else -1) for f, k in zip(fs, types or ()) if numeric(f))
    best = max(fit, key=lambda fs: (agree(fs), sum(words[f.name] for f in fs)))
    return [(f.name, c) for f, c in zip(best, columns)]


def rule_text(program: Program, variable: str, labels: dict[str, str] | None = None) -> str:
    """A calculated field as sentences: its steps with what is new in each step's conditions, then the variables it rests on."""
    labels = {k.upper(): v for k, v in (labels or {}).items()}
    named = lambda text: _TOKEN.sub(lambda m: labels.get(m[0].upper(), m[0]), text)

    def steps(v: str) -> list[str]:
        out, before = [], set()
        for statement, guards in guarded_rules(program, v):
            new = [g for g in guards if g not in before]
            before = set(guards)
            when = " and ".join(map(named, new))
            out.append(named(statement) + (f", when {when}" if when else ""))
        return out

    _, reached, _ = backward_slice(program, variable)
    lines = [f"{labels.get(variable.upper(), variable.upper())}:", *[f"  {x}" for x in steps(variable)]]
    for v in sorted(reached - {variable.upper()}):
        if own := steps(v):
            lines.append(f"  where {labels.get(v, v)}: " + "; ".join(own))
    return "\n".join(lines)


def input_roles(program: Program, variable: str) -> dict[str, list[str]]:
    """Record fields a calculation reads: as operand, in conditions, or both."""
    inputs = {f.name for fs in program.records.values() for f in fs if f.level > 1}
    _, reached, _ = backward_slice(program, variable)
    out: dict[str, set[str]] = {}
    for v in reached:
        for statement, guards in guarded_rules(program, v):
            for role, words in (("operand", used(statement)), ("condition", set().union(*(set(_TOKEN.findall(g.upper())) for g in guards)) if guards else set())):
                for w in words & inputs - {variable.upper()}:
                    out.setdefault(w, set()).add(role)
    return {k: sorted(r) for k, r in sorted(out.items())}


@dataclass(frozen=True)
class Enriched:
    name: str
    business_name: str
    description: str
    inferred_type: str
    field: str | None
    pic: str | None
    label: str | None
    decode: tuple[tuple[str, str], ...]
    derivation: str | None
    confidence: float
    evidence: tuple[str, ...]


#: How sure a name is: from the data alone, from a program's layout, from a screen, from both; and bounds for calculated fields. Fixed values.
BY_DATA, BY_LAYOUT, BY_SCREEN, BY_BOTH, CALCULATED, POORLY_READ, READ = 0.4, 0.7, 0.9, 0.95, 0.75, 0.6, 0.8


def enrich(columns: list[tuple[str, str, str]], program: Program | None = None, seen: dict | None = None) -> list[Enriched]:
    """What columns (name, inferred type, role) mean, from the program that writes them and the screen that shows them.

    A screen's label names a column before the program's field does; of code meanings the screen's go over the program's.
    """
    seen = seen or {}
    names = [c for c, _, _ in columns]
    at = {c: f for f, c in layout_for(program, names, [t for _, t, _ in columns])} if program else {}
    pics = {f.name: f.pic for fs in program.records.values() for f in fs} if program else {}
    codes = code_meanings(program) if program else {}
    label_of, decode_of = seen.get("labels", {}), seen.get("decodes", {})
    out = []
    for name, kind, role in columns:
        label, f = label_of.get(name), at.get(name)
        decode = {k: v.title() for k, v in codes.get(f, {}).items()} | dict(decode_of.get(name, {}))
        confidence = BY_BOTH if label and f else BY_SCREEN if label else BY_LAYOUT if f else BY_DATA
        evidence = [f"screen label {label}"] if label else []
        evidence += [f"field {f} {pics.get(f, '')}".strip()] if f else []
        derivation = None
        if program and f and any(f in assigned(s) and s.split(None, 1)[0].upper() in ARITHMETIC for p in program.paragraphs for s in p.statements):
            read = backward_slice(program, f)[2]
            derivation = rule_text(program, f, {x: label_of.get(c, humanise(x)) for c, x in at.items()})
            evidence.append(f"calculated in {program.name}; {read:.0%} of its statements understood")
            if not (label and f):
                confidence = max(confidence, CALCULATED) if read >= READ else min(confidence, POORLY_READ)
        business = label or (humanise(f) if f else role.split(" (")[0].title())
        text = f"{business}: {kind.lower().replace('_', ' ')}."
        if role.startswith(("dead", "constant")):
            text = f"{business}: {'filler without meaning' if role.startswith('dead') else 'control field, always the same'}."
        text += f" Codes: {', '.join(f'{k} = {v}' for k, v in decode.items())}." if decode else ""
        text += f" Calculated by {program.name}." if derivation else ""
        out.append(Enriched(name, business, text, kind, f, pics.get(f), label, tuple(decode.items()), derivation, confidence, (*evidence, f"data: {role}, {kind}")))
    return out


def program_graph(program: Program, columns: dict[str, str] | None = None, labels: dict[str, str] | None = None) -> tuple[list[tuple[str, str, str, dict]], list[tuple[str, str, str]]]:
    """(nodes, edges) of a program for the knowledge store. ``columns``: field to the extract's column it is aligned to."""
    columns, labels = columns or {}, labels or {}
    pgm = f"pgm:{program.name}"
    nodes = {pgm: ("program", program.name, {"coverage": round(program.coverage(), 3)})}
    edges: list[tuple[str, str, str]] = []
    for f, dataset in program.files.items():
        nodes[f"ds:{dataset}"] = ("dataset", dataset, {"file": f})
        edges.append((pgm, f"ds:{dataset}", "READS"))
    for record, fs in program.records.items():
        nodes[f"rec:{record}"] = ("record", record, {})
        edges += [(f"rec:{record}", f"ds:{d}", "STORED_ON") for d in program.files.values()]
        edges.append((f"rec:{record}", pgm, "DEFINED_IN"))
        for f in fs:
            nodes[f"fld:{f.name}"] = ("field", labels.get(f.name, humanise(f.name)), {"pic": f.pic, "position": f.position})
            edges.append((f"rec:{record}", f"fld:{f.name}", "HAS_FIELD"))
            if f.name in columns:
                nodes[f"col:{columns[f.name]}"] = ("column", columns[f.name], {})
                edges.append((f"fld:{f.name}", f"col:{columns[f.name]}", "ALIGNED_TO"))
            if f.name in labels:
                nodes[f"lbl:{labels[f.name]}"] = ("label", labels[f.name], {})
                edges.append((f"fld:{f.name}", f"lbl:{labels[f.name]}", "LABELLED_AS"))
    for p in program.paragraphs:
        for s in p.statements:
            for v in assigned(s):
                me = f"fld:{v}" if f"fld:{v}" in nodes else f"var:{v}"
                nodes.setdefault(me, ("variable", humanise(v), {}))
                edges.append((me, pgm, "DERIVED_BY"))
                for u in sorted(used(s)):
                    if f"fld:{u}" in nodes:
                        edges.append((me, f"fld:{u}", "USES"))
                    elif any(u in q.targets() for q in program.paragraphs):
                        nodes.setdefault(f"var:{u}", ("variable", humanise(u), {}))
                        edges.append((me, f"var:{u}", "DEPENDS_ON"))
    return [(i, *n) for i, n in nodes.items()], list(dict.fromkeys(e for e in edges if e[0] != e[1]))


def read_estate(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of all program texts below a folder."""
    return spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).selectExpr("_metadata.file_path AS path", "value AS text")


def parse_estate(texts: DataFrame) -> DataFrame:
    """(path, program, record, position, field, pic) of all layouts of (path, text) rows, in parallel."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, g.name, r, f.position, f.name, f.pic) for p, t in zip(b["path"], b["text"]) for g in [parse(t or "", p)] for r, fs in g.records.items() for f in fs]
            yield pd.DataFrame(rows, columns=["path", "program", "record", "position", "field", "pic"])

    return texts.select("path", "text").mapInPandas(run, "path string, program string, record string, position int, field string, pic string")
