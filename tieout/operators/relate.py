"""How tables join, found from their values, and the working table built from it.

All column pairs are measured at once: distinct trimmed values in long form, one grouping by value
to see which columns share it, one by pair to count. Only table-level numbers (a row a column,
a row an edge) reach the driver, where edges are picked and the join plan is made.

Defined results: null and blank values belong to no column's value set; a table without rows has
no edges; a joined table's columns whose names clash get the table's name in front.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import q
from ..plans.joins import small_enough

#: Thresholds of join discovery. Fixed values.
LEAST_DISTINCT, LEAST_CONTAINMENT, DOMAIN_DISTINCT, UNIQUE = 2, 0.60, 40, 0.99


@dataclass(frozen=True)
class Edge:
    left_table: str
    left_column: str
    right_table: str
    right_column: str
    shared: int
    containment_left: float
    containment_right: float
    cardinality: str
    kind: str
    confidence: float


def values(tables: dict[str, DataFrame], columns: dict[str, list[str]]) -> DataFrame:
    """(tab, col, value, n): weighted trimmed values of the named columns."""
    out = None
    for t, df in tables.items():
        each = F.explode(F.array(*[F.struct(F.lit(t).alias("tab"), F.lit(c).alias("col"), F.trim(q(c).cast("string")).alias("value")) for c in columns[t]]))
        part = df.select(each.alias("c")).select("c.*").where("value <> ''").groupBy("tab", "col", "value").agg(F.count(F.lit(1)).alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


def overlaps(vals: DataFrame) -> DataFrame:
    """(t1, c1, t2, c2, shared): shared distinct values of all column pairs of different tables.

    Columns sharing a value are gathered per value: as many as there are columns, however often the value occurs.
    """
    per = vals.groupBy("value").agg(F.array_sort(F.collect_set(F.struct("tab", "col"))).alias("cs")).where(F.size("cs") > 1)
    pairs = per.select("cs", F.posexplode("cs").alias("i", "a")).select("a", F.explode(F.slice("cs", F.col("i") + 2, F.size("cs"))).alias("b")).where("a.tab <> b.tab")
    return pairs.groupBy(F.col("a.tab").alias("t1"), F.col("a.col").alias("c1"), F.col("b.tab").alias("t2"), F.col("b.col").alias("c2")).agg(F.count(F.lit(1)).alias("shared"))


def column_sizes(vals: DataFrame) -> DataFrame:
    return vals.groupBy("tab", "col").agg(F.sum("n").alias("filled"), F.count(F.lit(1)).alias("distinct_count"))


def edges(vals: DataFrame) -> DataFrame:
    """All edges above the containment threshold, with cardinality, kind and confidence; not yet picked."""
    s = column_sizes(vals)
    side = lambda k: s.select(*[F.col(c).alias(n) for c, n in (("tab", f"t{k}"), ("col", f"c{k}"), ("filled", f"f{k}"), ("distinct_count", f"d{k}"))])
    e = overlaps(vals).join(F.broadcast(side(1)), ["t1", "c1"]).join(F.broadcast(side(2)), ["t2", "c2"])  # a row a column
    e = e.withColumns({"k1": F.col("shared") / F.col("d1"), "k2": F.col("shared") / F.col("d2"), "u1": F.col("d1") / F.col("f1") >= UNIQUE, "u2": F.col("d2") / F.col("f2") >= UNIQUE})
    best = F.greatest("k1", "k2")
    e = e.where((best >= LEAST_CONTAINMENT) & (F.least("d1", "d2") >= LEAST_DISTINCT))
    card = F.when(F.col("u1") & F.col("u2"), "1:1").when(F.col("u1"), "1:N").when(F.col("u2"), "N:1").otherwise("M:N")
    kind = F.when(F.col("u1") | F.col("u2"), "join_key").when((F.col("d1") <= DOMAIN_DISTINCT) & (F.col("d2") <= DOMAIN_DISTINCT), "shared_domain").otherwise("value_overlap")
    weight = F.when(kind == "join_key", F.when(F.col("u1") & F.col("u2"), 1.0).otherwise(0.75)).when(kind == "shared_domain", 0.6).otherwise(0.4)
    return e.select("t1", "c1", "t2", "c2", "shared", F.round("k1", 3).alias("containment_left"), F.round("k2", 3).alias("containment_right"), card.alias("cardinality"), kind.alias("kind"), F.round(best * weight, 3).alias("confidence"))


def pick(found: list[Edge]) -> list[Edge]:
    """The best edge per column and side: join keys before domains before overlaps, then confidence, then name."""
    order = {"join_key": 0, "shared_domain": 1, "value_overlap": 2}
    used: set[tuple[str, str, str]] = set()
    out = []
    for e in sorted(sorted(found, key=lambda e: (e.left_column, e.right_column)), key=lambda e: (order[e.kind], -e.confidence)):
        left, right = (e.left_table, e.left_column, e.right_table), (e.right_table, e.right_column, e.left_table)
        if left in used or right in used:
            continue
        used |= {left, right}
        out.append(e)
    return out


def discover(tables: dict[str, DataFrame], columns: dict[str, list[str]] | None = None) -> list[Edge]:
    vals = values(tables, columns or {t: d.columns for t, d in tables.items()})
    return pick([Edge(*r) for r in edges(vals).collect()])


def primary(sizes: dict[str, int], found: list[Edge]) -> str:
    """The table that reaches most others going from many to one; then most rows; then first named."""
    out: dict[str, set[str]] = {t: set() for t in sizes}
    for e in found:
        if e.kind == "join_key" and e.cardinality in ("N:1", "1:1"):
            out[e.left_table].add(e.right_table)
        if e.kind == "join_key" and e.cardinality in ("1:N", "1:1"):
            out[e.right_table].add(e.left_table)

    def reach(t: str) -> int:
        seen, todo = {t}, [t]
        while todo:
            for u in out.get(todo.pop(), ()):
                if u not in seen:
                    seen.add(u)
                    todo.append(u)
        return len(seen)

    names = list(sizes)
    return max(names, key=lambda t: (reach(t), sizes[t], -names.index(t)))


@dataclass(frozen=True)
class Step:
    from_table: str
    from_column: str
    to_table: str
    to_column: str


def join_plan(start: str, tables: list[str], found: list[Edge]) -> tuple[list[Step], dict[str, str]]:
    """Steps from the primary along edges unique on the new side, and why other tables stay out."""
    steps, inside = [], {start}
    more = True
    while more:
        more = False
        for e in found:
            if e.kind != "join_key":
                continue
            for a, ac, b, bc, fine in ((e.left_table, e.left_column, e.right_table, e.right_column, e.cardinality in ("N:1", "1:1")), (e.right_table, e.right_column, e.left_table, e.left_column, e.cardinality in ("1:N", "1:1"))):
                if a in inside and b not in inside and fine:
                    steps.append(Step(a, ac, b, bc))
                    inside.add(b)
                    more = True
    reached = {t for e in found for t in (e.left_table, e.right_table) if {e.left_table, e.right_table} & inside}
    why = {t: "joining it would repeat rows; it needs an aggregation first" if t in reached else "no join key leads to it" for t in tables if t not in inside}
    return steps, why


def workset(tables: dict[str, DataFrame], start: str, steps: list[Step]) -> DataFrame:
    """The primary with every planned table joined to it on trimmed keys; the primary's grain is kept.

    A joined table must be unique on its key, exactly; one that isn't is refused. Small tables are broadcast.
    """
    out = tables[start]
    named = {(start, c): c for c in out.columns}
    for s in steps:
        t = tables[s.to_table]
        key = F.trim(q(s.to_column).cast("string"))
        if t.where(key.isNotNull()).groupBy(key).count().where("count > 1").limit(1).count():
            raise ValueError(f"{s.to_table}.{s.to_column} repeats; joining it would change the grain")
        names = {c: c if c not in out.columns else f"{s.to_table}_{c}" for c in t.columns}
        named |= {(s.to_table, c): n for c, n in names.items()}
        side = t.select(key.alias("__k"), *[q(c).alias(n) for c, n in names.items()])
        side = F.broadcast(side) if small_enough(side, row_bytes=64 * len(names)) else side
        out = out.join(side, F.trim(q(named[(s.from_table, s.from_column)]).cast("string")) == F.col("__k"), "left").drop("__k")
    return out


def pair_dictionaries(tables: list[str], dictionaries: list[tuple[str, dict]]) -> tuple[dict[str, dict], list[str]]:
    """(table to its dictionary, tables without one). A dictionary says its table or is called like it; with a single table
    any dictionary is its. Of several for one table the last given counts."""
    out = {}
    for stem, d in dictionaries:
        name = d.get("table") or stem
        name = tables[0] if name not in tables and len(tables) == 1 else name
        if name in tables:
            out[name] = d
    return out, sorted(set(tables) - out.keys())


def annotate_files(maps: list, origin: dict[str, tuple[str, str]], default: str) -> dict[str, tuple[tuple[str, ...], str]]:
    """Target to (files its mapping reads, a note if they aren't the primary alone). ``origin``: working column to (table, column)."""
    out = {}
    for m in maps:
        at = [origin.get(c, (default, c)) for c in m.sources]
        files = tuple(dict.fromkeys(t for t, _ in at))
        note = f"combines {', '.join(f'{t}.{c}' for t, c in at)} by the discovered join" if len(files) > 1 else f"from the joined file {files[0]}" if files and files[0] != default else ""
        out[m.target] = (files, note)
    return out
