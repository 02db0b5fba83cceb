"""Per-key results when a few keys hold most rows.

Value-frequency compression: rows are grouped by (key, value) before key. Partial
aggregation makes one record per (key, value) and map task, so a key holding a third of all
rows is spread over as many partitions as it has values, and the second grouping by key sees
distinct values only. Totals, exact distinct counts and modes are combinable sums over
weighted values. Percentiles come from weighted values too: the range of all values is cut into
at most ``WIDTH`` buckets, the one holding the wanted rank is found from bucket totals and cut again,
until a bucket is one value. At most ``WIDTH`` buckets of a key are ranked at a time, so no task ever holds
all values of a hot key, however far they spread.

Defined results: null keys form a group of their own; null values count as rows but neither
as distinct values nor towards mode or percentiles; a mode tie goes to the smallest value;
percentile p is the smallest value whose cumulative weight reaches p of the key's values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 4096


def compress(df: DataFrame, key: Column, value: Column, **extra: Column) -> DataFrame:
    """(key, value, n): weighted distinct values of each key."""
    keys = {"key": key} | extra | {"value": value}
    return df.select(*[c.alias(k) for k, c in keys.items()]).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def totals(weighted: DataFrame, *by: str) -> DataFrame:
    """Rows, distinct values and the mode per key."""
    rank = F.when(F.col("value").isNotNull(), F.struct((-F.col("n")).alias("m"), F.col("value").alias("v")))
    return weighted.groupBy(*by).agg(F.sum("n").alias("row_count"), F.count("value").alias("distinct_count"), F.min(rank)["v"].alias("mode_value"))


def compress_all(df: DataFrame, key: Column, values: dict[str, Column]) -> DataFrame:
    """(key, name, value text, n): weighted distinct values of several columns of each key, from one scan and one shuffle."""
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), c.cast("string").alias("value")) for k, c in values.items()]))
    return df.select(key.alias("key"), cells.alias("c")).groupBy("key", "c.name", "c.value").agg(F.count(F.lit(1)).alias("n"))


def percentiles(weighted: DataFrame, by: list[str], points: dict[str, float]) -> DataFrame:
    """Exact weighted percentiles of an integer ``value`` per key; one column for each of ``points``."""
    v = weighted.where(F.col("value").isNotNull()).select(*by, F.col("value").cast("bigint").alias("value"), "n")
    lo, hi = v.agg(F.min("value"), F.max("value")).first()
    lo, hi = lo or 0, hi or 0
    steps = 1
    while WIDTH**steps <= hi - lo:
        steps += 1
    whole = "bigint" if hi - lo < 2**63 else "decimal(20,0)"
    v = v.withColumn("off", F.col("value").cast(whole) - F.lit(lo).cast(whole))
    over = lambda c, width: F.expr(f"{c} div CAST({width} AS DECIMAL(20, 0))").cast(whole)
    at = lambda k: over("off", WIDTH**k) if k else F.col("off").cast(whole)
    all_ = v.groupBy(*by).agg(F.sum("n").alias("all"))
    wanted = F.explode(F.array(*[F.struct(F.lit(k).alias("point"), F.greatest(F.ceil(F.col("all") * p), F.lit(1)).cast("bigint").alias("rest")) for k, p in points.items()]))
    open_ = all_.select(*by, wanted.alias("w")).select(*by, "w.point", "w.rest", F.lit(0).cast(whole).alias("node"))
    for k in range(steps - 1, -1, -1):
        buckets = v.groupBy(*by, at(k).alias("bucket")).agg(F.sum("n").alias("n")).withColumn("node", over("bucket", WIDTH) if k < steps - 1 else F.lit(0).cast(whole))
        l, r = buckets.alias("l"), open_.alias("r")
        cond = F.col("l.node") == F.col("r.node")
        for c in by:
            cond = cond & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
        inside = Window.partitionBy(*by, "point").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        hit = l.join(r, cond).select(*[F.col(f"l.{c}").alias(c) for c in by], "bucket", "point", "rest", "n").withColumn("upto", F.sum("n").over(inside))
        hit = hit.where((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("n") < F.col("rest")))
        open_ = hit.select(*by, "point", (F.col("rest") - (F.col("upto") - F.col("n"))).alias("rest"), F.col("bucket").alias("node"))
    return open_.groupBy(*by).agg(*[F.max(F.when(F.col("point") == k, (F.col("node") + F.lit(lo).cast(whole)).cast("bigint"))).alias(k) for k in points])


def heavy(weighted: DataFrame, by: list[str], share: float) -> DataFrame:
    """Non-null keys that hold at least ``share`` of all rows (rows with null keys included) of their column."""
    per_key = weighted.groupBy(*by).agg(F.sum("n").alias("row_count"))
    column = [b for b in by if b != "key"]
    all_rows = weighted.groupBy(*column).agg(F.sum("n").alias("all_rows"))
    # one row per profiled column: as many as the caller named
    joined = per_key.join(F.broadcast(all_rows), column)
    return joined.where(F.col("key").isNotNull() & (F.col("row_count") >= F.lit(share) * F.col("all_rows"))).drop("all_rows")
