"""Column-level quality profile of every load, and its changes against the load before.

Method: each column is compressed to (load, column, value, n) first, so a value held by a
third of all rows is one record per map task before anything moves. Null rates, exact
distinct counts, ranges and rule violations are sums over the compressed values. Numeric
columns carry exact power sums (n, sum x .. sum x^4 of hundredths): a value is split into two
limbs, hi x 10^7 + lo, and the sums of products of limbs are kept as whole decimals, which hold
ten billion rows a load of the largest values declared. They are mergeable, so moments of any union of
loads follow without a second pass, and the change of a column between loads is the difference of means
over the pooled standard deviation.

Defined results: a null load is a load of its own without neighbours; a column with no
value at all has null minimum, maximum and moments and 0 distinct values; an empty table
gives no rows; columns of the input that aren't named are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal
from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import q

#: Hundredths of twelve-digit amounts are two limbs of seven digits.
LIMB = 10**7
DECIMAL = r"^-?[0-9]{1,12}(\.[0-9]{1,4})?$"


@dataclass(frozen=True)
class ColumnRule:
    """What a column is checked against. ``violates`` maps a value to a boolean (null: no violation).
    ``states`` are values whose share per load is watched; nulls always are."""

    name: str
    violates: callable = None
    numeric: bool = False
    states: tuple[str, ...] = field(default=())


def compressed(df: DataFrame, load: str, rules: list[ColumnRule]) -> DataFrame:
    """(load, colname, value, n): the only shuffle that sees values, pre-aggregated on the map side."""
    cells = F.explode(F.array(*[F.struct(F.lit(r.name).alias("colname"), q(r.name).cast("string").alias("value")) for r in rules]))
    return df.select(q(load).alias("load_id"), cells.alias("c")).groupBy("load_id", "c.colname", "c.value").agg(F.count(F.lit(1)).alias("n"))


def _per_rule(rules: list[ColumnRule], of) -> Column:
    out = F.lit(None)
    for r in rules:
        if (c := of(r)) is not None:
            out = F.when(F.col("colname") == r.name, c).otherwise(out)
    return out


def profile(df: DataFrame, load: str, rules: list[ColumnRule]) -> DataFrame:
    """One row per load and column."""
    v, n = F.col("value"), F.col("n")
    bad = F.coalesce(_per_rule(rules, lambda r: r.violates(v) if r.violates else None).cast("boolean"), F.lit(False))
    numeric = [r.name for r in rules if r.numeric]
    x = F.when(F.col("colname").isin(numeric) & v.rlike(DECIMAL), v.try_cast("decimal(16,4)")) if numeric else F.lit(None).cast("decimal(16,4)")
    cells = compressed(df, load, rules).withColumns({"bad": bad, "x": x})
    # powers as doubles would depend on the order of summation; hundredths as integers don't
    h = F.round(F.col("x") * 100, 0).cast("bigint")
    cells = cells.withColumn("h", h).withColumns({"hi": F.expr(f"h div {LIMB}"), "lo": F.expr(f"h % {LIMB}")})
    h = F.col("h")
    product = lambda i, j: F.sum((n.cast("decimal(10,0)") * _times("hi", i) * _times("lo", j)).cast("decimal(38,0)")).alias(f"limb_{i}{j}")
    out = cells.groupBy("load_id", "colname").agg(
        F.sum("n").alias("row_count"),
        F.coalesce(F.sum(F.when(v.isNull(), n)), F.lit(0)).alias("null_count"),
        F.count("value").alias("distinct_count"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
        F.coalesce(F.sum(F.when(F.col("bad"), n)), F.lit(0)).alias("violation_count"),
        F.coalesce(F.sum(F.when(h.isNotNull(), n)), F.lit(0)).alias("numeric_count"),
        *[product(i, k - i) for k in range(1, 5) for i in range(k + 1)],
    )
    return out.withColumns({f"sum{k}": power_sum(k) for k in range(1, 5)})


def power_sum(k: int) -> Column:
    """Sum of k-th powers of hundredths from the exact limb sums, rounded once at the end."""
    out = F.lit(0.0)
    for i in range(k + 1):
        out = out + F.col(f"limb_{i}{k - i}").cast("double") * float(comb(k, i) * LIMB**i)
    return out


def _times(limb: str, k: int) -> Column:
    """A limb's k-th power. Four limbs multiply to 28 digits, which with ten of the count fit a decimal."""
    small = F.col(limb)  # up to the second power it fits 64 bits
    if k == 0:
        return F.lit(1).cast("decimal(1,0)")
    if k < 3:
        return (small if k == 1 else small * small).cast(f"decimal({7 * k},0)")
    return (_times(limb, 2) * _times(limb, k - 2)).cast(f"decimal({7 * k},0)")


def drift(profiled: DataFrame) -> DataFrame:
    """Changes against the load before, from the profile alone (loads x columns rows)."""
    w = Window.partitionBy("colname").orderBy("load_id")
    n = F.col("numeric_count").cast("double")
    mean = F.col("sum1").cast("double") / n
    var = F.greatest(F.col("sum2").cast("double") / n - mean * mean, F.lit(0.0))
    m3 = F.col("sum3").cast("double") / n - 3 * mean * F.col("sum2").cast("double") / n + 2 * mean**3
    out = profiled.where(F.col("load_id").isNotNull()).withColumns(
        {"null_rate": F.col("null_count") / F.col("row_count"), "mean": F.when(n > 0, mean / 100), "variance": F.when(n > 0, var / 10000), "skewness": F.when((n > 0) & (var > 0), m3 / F.pow(var, 1.5))}
    )
    before = lambda c: F.lag(c).over(w)
    pooled = F.sqrt((F.col("variance") + before("variance")) / 2)
    return out.withColumns(
        {
            "null_rate_change": F.col("null_rate") - before("null_rate"),
            "distinct_change": F.col("distinct_count") - before("distinct_count"),
            "standardised_difference": F.when(pooled > 0, (F.col("mean") - before("mean")) / pooled),
        }
    )


def shifts(df: DataFrame, load: str, rules: list[ColumnRule], tolerance: float) -> DataFrame:
    """(colname, load_id): loads in which the share of nulls or of a watched state is more than
    ``tolerance`` away from that of the load before. Shares are of all rows of the load.
    Shares are compared as exact integers (a/n against b/m), never as rounded ratios."""
    v, n = F.col("value"), F.col("n")
    state = F.when(v.isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), v))
    watched = _per_rule(rules, lambda r: F.coalesce(v.isin(*r.states), F.lit(True)) if r.states else v.isNull()).cast("boolean")
    cells = compressed(df, load, rules).withColumn("state", F.when(watched, state))
    wide = {r.name: ["null", *("=" + s for s in r.states)] for r in rules}
    names = sorted({s for x in wide.values() for s in x})
    shares = cells.groupBy("load_id", "colname").agg(F.sum("n").alias("rows_"), *[F.coalesce(F.sum(F.when(F.col("state") == s, n)), F.lit(0)).alias(f"s{i}") for i, s in enumerate(names)])
    w = Window.partitionBy("colname").orderBy("load_id")
    big = lambda c: c.cast("decimal(18,0)")
    n, m, t = big(F.col("rows_")), big(F.lag("rows_").over(w)), F.lit(Decimal(str(tolerance)))
    # |a/n - b/m| > t  <=>  |a m - b n| > t n m
    moved = F.lit(False)
    for i in range(len(names)):
        moved = moved | (F.abs(big(F.col(f"s{i}")) * m - big(F.lag(f"s{i}").over(w)) * n) > t * n * m)
    return shares.where(F.col("load_id").isNotNull()).withColumn("moved", F.coalesce(moved, F.lit(False))).where("moved").select("colname", "load_id")


def violations(df: DataFrame, load: str, row_id: str, rules: list[ColumnRule]) -> DataFrame:
    """(colname, load_id, row_id) of every non-null value that breaks its column's rule; one scan, no shuffle."""
    checks = [F.when(F.coalesce(r.violates(q(r.name)), F.lit(False)), F.lit(r.name)) for r in rules if r.violates]
    return df.select(q(load).alias("load_id"), q(row_id).alias("row_id"), F.explode(F.array_compact(F.array(*checks))).alias("colname"))
