"""Joins whose strategy is decided on measured sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A lookup side is broadcast only if its counted rows, at this many bytes a row, stay below the bound.
BROADCAST_BYTES = 8 << 20
ROW_BYTES = 120
#: Rows of the large side above this share of all rows make a key hot; at most 1 / HOT_SHARE keys can be.
HOT_SHARE = 0.01
SALTS = 32


def small_enough(df: DataFrame, row_bytes: int = ROW_BYTES, limit: int = BROADCAST_BYTES) -> bool:
    """Whether a counted bound on the side's size allows a broadcast. Counts at most limit / row_bytes + 1 rows."""
    most = limit // row_bytes
    return df.limit(most + 1).count() <= most


def lookup_join(large: DataFrame, lookup: DataFrame, key: str, how: str = "left", salts: int = SALTS) -> DataFrame:
    """Join a large, skewed side to a lookup that is unique per ``key``.

    The lookup is broadcast if its counted size allows it. Otherwise the keys holding more
    than ``HOT_SHARE`` of the large side (at most ``1 / HOT_SHARE`` of them) are spread over
    ``salts`` partitions each: their lookup rows are repeated once per salt, all other rows
    keep salt 0. No row is dropped. Null keys match nothing and get random salts, so they
    don't meet in one task.
    """
    if small_enough(lookup):
        return large.join(F.broadcast(lookup), key, how)
    total = large.count()
    hot = [r[0] for r in large.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") > F.lit(HOT_SHARE * total)).collect()]
    random_salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in large.columns]), F.lit(salts)).cast("int")
    salted = large.withColumn("__salt", F.when(F.col(key).isin(hot) | F.col(key).isNull(), random_salt).otherwise(F.lit(0)))
    copies = F.when(F.col(key).isin(hot), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return salted.join(lookup.withColumn("__salt", F.explode(copies)), [key, "__salt"], how).drop("__salt")
