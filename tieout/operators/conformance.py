"""Delivered data against what the certified mapping makes of the source.

Rows are aligned on the mapped key where it is unique, else on ordinals; all columns are compared in
one full outer join. Reconciliation compares totals, counts and buckets of both sides.

Defined results: null equals null; a row on one side only differs in every column that isn't null on
it; comparison is suspended if the two sides' row counts differ.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import all_of, blank, q
from ..plans.joins import small_enough

#: A sum ties if it is this near, relatively plus absolutely. Fixed values.
RELATIVE, ABSOLUTE = 1e-6, 1e-9
CATEGORIES = 25


def ordinal(df: DataFrame, name: str = "_rn") -> DataFrame:
    """File positions from 1. Rows of files are in order of path, split and place; other data in the order the plan yields it.

    Spark packs splits into tasks by size, so places are counted within a split and offset by the rows of the splits
    before it: one row a split is summed up, no row is sorted.
    """
    keyed = df.withColumn("__at", F.monotonically_increasing_id())
    try:
        keyed = df.select(*[q(c) for c in df.columns], F.col("_metadata.file_path").alias("__path"), F.col("_metadata.file_block_start").alias("__start")).withColumn("__at", F.monotonically_increasing_id())
        keyed.schema  # noqa: B018
    except AnalysisException:  # not read from files
        keyed = keyed.withColumns({"__path": F.lit(""), "__start": F.shiftright("__at", 33)})
    splits = keyed.groupBy("__path", "__start").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    before = Window.orderBy("__path", "__start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("__path", "__start", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__offset"))
    side = F.broadcast(offsets) if small_enough(offsets) else offsets
    return keyed.join(side, ["__path", "__start"]).withColumn(name, F.col("__at") + F.col("__offset") + 1).drop("__path", "__start", "__at", "__offset")


def align(expected: DataFrame, delivered: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, e_*, d_*) of both sides in one full outer join."""
    e = expected.select(q(key).alias("k"), *[q(c).alias(f"e_{c}") for c in columns], F.lit(True).alias("in_e"))
    d = delivered.select(q(key).alias("k"), *[q(c).alias(f"d_{c}") for c in columns], F.lit(True).alias("in_d"))
    return e.join(d, "k", "full_outer")


def mismatches(aligned: DataFrame, columns: list[str]) -> DataFrame:
    """(attribute, compared, mismatches): all columns in one aggregate."""
    differs = lambda c: ~F.col(f"e_{c}").eqNullSafe(F.col(f"d_{c}"))
    one = aligned.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(differs(c)).alias(f"m{i}") for i, c in enumerate(columns)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("attribute"), F.col("n").alias("compared"), F.col(f"m{i}").alias("mismatches")) for i, c in enumerate(columns)])).alias("r")).select("r.*")


def offenders(aligned: DataFrame, columns: list[str], most: int = 10) -> DataFrame:
    """(attribute, k, expected, delivered, rank): the first ``most`` differing rows of each column by key."""
    cell = lambda c: F.struct(F.lit(c).alias("attribute"), F.col(f"e_{c}").cast("string").alias("expected"), F.col(f"d_{c}").cast("string").alias("delivered"))
    diffs = F.array_compact(F.array(*[F.when(~F.col(f"e_{c}").eqNullSafe(F.col(f"d_{c}")), cell(c)) for c in columns]))
    long = aligned.select("k", F.explode(diffs).alias("c")).select("k", "c.*")
    return long.withColumn("rank", F.row_number().over(Window.partitionBy("attribute").orderBy("k"))).where(F.col("rank") <= most)


def ties(a: Column, b: Column) -> Column:
    x, y = F.coalesce(a.cast("double"), F.lit(0.0)), F.coalesce(b.cast("double"), F.lit(0.0))
    return F.abs(x - y) <= RELATIVE * F.greatest(F.abs(x), F.abs(y)) + ABSOLUTE


def value_counts(df: DataFrame, attributes: dict[str, Column]) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), c.cast("string").alias("value")) for a, c in attributes.items()]))
    return df.select(each.alias("c")).groupBy("c.attribute", "c.value").agg(F.count(F.lit(1)).alias("n"))


def category_profiles(source: DataFrame, delivered: DataFrame, expected: dict[str, Column], most: int = CATEGORIES) -> DataFrame:
    """(attribute, value, expected, delivered, diff) of attributes that really are categories: few values, not none, not one a row."""
    e = value_counts(source, expected).withColumnRenamed("n", "expected")
    d = value_counts(delivered, {a: q(a) for a in expected}).withColumnRenamed("n", "delivered")
    kind = d.groupBy("attribute").agg(F.count("value").alias("v"), F.sum("delivered").alias("rows_")).where((F.col("v") > 0) & (F.col("v") <= most) & (F.col("v") != F.col("rows_")))
    l, r = e.alias("l"), d.alias("r")
    both = l.join(r, (F.col("l.attribute") == F.col("r.attribute")) & F.col("l.value").eqNullSafe(F.col("r.value")), "full_outer")
    out = both.select(F.coalesce("l.attribute", "r.attribute").alias("attribute"), F.coalesce("l.value", "r.value").alias("value"), F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("delivered", F.lit(0)).alias("delivered"))
    return out.join(F.broadcast(kind.select("attribute")), "attribute", "left_semi").withColumn("diff", F.col("delivered") - F.col("expected"))


_AGGREGATES = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count, "count_distinct": F.countDistinct}


def aggregate_by(source: DataFrame, delivered: DataFrame, groups_s: dict[str, Column], groups_d: dict[str, Column], value_s: Column, value_d: Column, function: str) -> DataFrame:
    """(group columns, source_value, delivered_value, ties): buckets of both sides, keyed by all group columns with nulls kept apart."""
    fn = _AGGREGATES[function]
    g = list(groups_s)
    s = source.groupBy(*[c.alias(a) for a, c in groups_s.items()]).agg(fn(value_s).alias("source_value")).alias("s")
    d = delivered.groupBy(*[c.alias(a) for a, c in groups_d.items()]).agg(fn(value_d).alias("delivered_value")).alias("d")
    both = s.join(d, all_of([F.col(f"s.{a}").eqNullSafe(F.col(f"d.{a}")) for a in g]), "full_outer")
    return both.select(*[F.coalesce(f"s.{a}", f"d.{a}").alias(a) for a in g], "source_value", "delivered_value", ties(F.col("source_value"), F.col("delivered_value")).alias("ties"))


def fill_rates(delivered: DataFrame, attributes: list[str], mandatory: set[str]) -> DataFrame:
    """(attribute, populated, blank, mandatory), one aggregate."""
    one = delivered.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(blank(q(a))).alias(f"b{i}") for i, a in enumerate(attributes)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), (F.col("n") - F.col(f"b{i}")).alias("populated"), F.col(f"b{i}").alias("blank"), F.lit(a in mandatory).alias("mandatory")) for i, a in enumerate(attributes)])).alias("r")).select("r.*")


def duplicate_groups(df: DataFrame) -> DataFrame:
    """Groups of identical rows with their sizes."""
    return df.groupBy(*[q(c) for c in df.columns]).count().where("count > 1")
