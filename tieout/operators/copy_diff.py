"""Differences between two copies of a table, by hierarchical checksums over key ranges.

Both sides are read once into narrow tables of key, place, record hash and fields. Keys lie on two lines: whole
numbers by value, all others by hash. A line is cut into leaf ranges as wide as ``LEAF_KEYS`` keys usually
lie apart (the median spacing of sampled quantiles, so outlying keys don't widen the rest); a range's checksum is
the xor of its distinct record hashes with their count. Checksums of wider ranges are folds of the narrower ones.
From the widest level down, only ranges whose parents differ are compared, and fields are compared only for keys in
differing leaves: these are counted first and, if their size allows, filter both sides before any record moves.
What moves is 24 bytes a record for checksums, and the records of differing leaves.

Defined results: a null key identifies nothing and is left out; repeated rows of a key count
once (of disagreeing repeats the smallest record stands for the key); null differs from any
value but null; an empty side makes every key of the other missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.joins import small_enough
from ..plans.lineage import stage

#: Usual keys in a leaf range, how many ranges of a level make one of the next wider level, and quantiles sampled.
LEAF_KEYS, FAN, QUANTILES = 2, 64, 64
#: A leaf in a broadcast set takes so many bytes, and the set at most so many.
LEAF_BYTES, LEAVES_BYTES = 40, 32 << 20


def _prepared(df: DataFrame, key: Column, fields: dict[str, Column]) -> DataFrame:
    """(key, number, place, h, fields), in the shared folder: every expression over the delivered text runs once."""
    d = df.select(key.alias("key"), *[c.alias(f) for f, c in fields.items()]).where(F.col("key").isNotNull())
    number = F.col("key").try_cast("bigint")
    # nulls are hashed as flags, since a hash passes over null
    parts = [x for f in fields for x in (F.col(f).isNull(), F.col(f))]
    return stage(d.select("key", number.isNotNull().alias("number"), F.coalesce(number, F.xxhash64("key")).alias("place"), F.xxhash64("key", *parts).alias("h"), *fields))


def leaf_widths(both: DataFrame) -> dict[bool, int]:
    """The width of a leaf on the line of whole numbers (true) and on that of the other keys."""
    places = F.percentile_approx("place", F.array(*[F.lit(i / QUANTILES) for i in range(QUANTILES + 1)]), F.lit(20 * QUANTILES))
    out = {True: 1, False: 1}
    for r in both.groupBy("number").agg(F.count(F.lit(1)).alias("n"), places.alias("q")).collect():
        gaps = sorted(b - a for a, b in zip(r.q, r.q[1:]) if b > a)
        # both sides hold the usual key, so as many rows lie apart as twice the keys
        out[r.number] = max(1, gaps[len(gaps) // 2] * QUANTILES * 2 * LEAF_KEYS // r.n) if gaps else 1
    return out


def _leaf(widths: dict[bool, int]) -> Column:
    return F.when(F.col("number"), F.expr(f"place div {widths[True]}L")).otherwise(F.expr(f"place div {widths[False]}L"))


def _sums(df: DataFrame, widths: dict[bool, int]) -> DataFrame:
    h = df.select("number", _leaf(widths).alias("leaf"), "h").distinct()
    return h.groupBy("number", "leaf").agg(F.bit_xor("h").alias("x"), F.count(F.lit(1)).alias("n"))


def differing_leaves(a: DataFrame, b: DataFrame, widths: dict[bool, int], levels: int = 2) -> DataFrame:
    """(number, leaf) of the differing leaf ranges of two prepared sides.

    A range's two checksums are folded into one (xor of both, difference of counts), which is
    zero exactly where they agree, so every level is read once.
    """
    fold = [F.bit_xor("x").alias("x"), F.sum("n").alias("n")]
    leaves = stage(_sums(a, widths).unionByName(_sums(b, widths).withColumn("n", -F.col("n"))).groupBy("number", "leaf").agg(*fold))
    parent = lambda step: F.floor(F.col("leaf") / step).cast("bigint")
    open_ = None
    for level in range(levels, -1, -1):
        here = leaves.withColumn("leaf", parent(FAN**level)).groupBy("number", "leaf").agg(*fold) if level else leaves
        if open_ is not None:
            here = here.withColumn("parent", parent(FAN)).join(_light(open_.withColumnRenamed("leaf", "parent")), ["number", "parent"], "left_semi")
        open_ = stage(here.where("x <> 0 or n <> 0").select("number", "leaf"))
    return open_


def _light(leaves: DataFrame) -> DataFrame:
    return F.broadcast(leaves) if small_enough(leaves, LEAF_BYTES, LEAVES_BYTES) else leaves


def differences(source: DataFrame, copy: DataFrame, source_key: Column, copy_key: Column, fields: dict[str, callable], levels: int = 2) -> DataFrame:
    """(key, difference, source_value, copy_value): ``missing_in_copy``, ``missing_in_source`` or a field's name.

    ``fields`` maps a field, present on both sides, to the function that makes its values comparable.
    """
    a = _prepared(source, source_key, {f: canon(F.col(f"`{f}`")) for f, canon in fields.items()})
    b = _prepared(copy, copy_key, {f: canon(F.col(f"`{f}`")) for f, canon in fields.items()})
    widths = leaf_widths(a.select("number", "place").unionByName(b.select("number", "place")))
    leaves = _light(differing_leaves(a, b, widths, levels))
    at_leaf = lambda d, side: d.withColumn("leaf", _leaf(widths)).join(leaves, ["number", "leaf"], "left_semi").select("key", F.lit(side).alias("side"), F.struct(*fields).alias("r"))
    both = at_leaf(a, 0).unionByName(at_leaf(b, 1))
    one = both.groupBy("key").agg(F.min(F.when(F.col("side") == 0, F.col("r"))).alias("s"), F.min(F.when(F.col("side") == 1, F.col("r"))).alias("c"))
    text = lambda side, f: F.col(f"{side}.{f}")
    row = lambda what, s, c: F.struct(F.lit(what).alias("difference"), s.alias("source_value"), c.alias("copy_value"))
    null = F.lit(None).cast("string")
    found = [F.when(F.col("s").isNotNull() & F.col("c").isNull(), row("missing_in_copy", null, null)), F.when(F.col("s").isNull() & F.col("c").isNotNull(), row("missing_in_source", null, null))]
    found += [F.when(F.col("s").isNotNull() & F.col("c").isNotNull() & ~text("s", f).eqNullSafe(text("c", f)), row(f, text("s", f), text("c", f))) for f in fields]
    return one.select("key", F.explode(F.array_compact(F.array(*found))).alias("d")).select("key", "d.*")
