"""References to records that do not exist, over composite keys with partial nulls.

References are grouped by their null mask: which of the key's columns are null. What a mask
means is declared: ``simple`` (any null: refers to nothing), ``partial`` (the non-null columns
must match some record), ``full`` (a mix of null and non-null is an orphan in itself). Each mask
that has to match is joined to the target reduced to the mask's non-null columns, one row per
key with the spans in which the record existed, so the join never multiplies rows.

Defined results: an all-null reference refers to nothing under every semantics; a key value
named as ``nothing`` counts as null; a reference without a time is sound if the record ever
existed; a record without ``since`` existed always, one without ``until`` still does; of late and
deleted, late is said if no span had begun.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import all_of, any_of
from ..plans.joins import lookup_join


def _spans(target: DataFrame, columns: list[str]) -> DataFrame:
    present = all_of([F.col(c).isNotNull() for c in columns])
    return target.where(present).groupBy(*columns).agg(F.collect_set(F.struct("since", "until")).alias("spans"))


def orphans(refs: DataFrame, target: DataFrame, keys: list[str], at: Column, semantics: str = "simple") -> DataFrame:
    """``refs`` rows without a sound target, plus ``reason``: missing, late, deleted or partial.

    ``refs`` holds the key columns ``keys`` (normalised, null for "refers to nothing"); ``target`` the same
    columns and the timestamps ``since`` and ``until``.
    """
    if semantics not in ("simple", "partial", "full"):
        raise ValueError(f"unknown match semantics: {semantics}")
    refs = refs.withColumn("__at", at)
    mask = F.concat(*[F.when(F.col(k).isNull(), "0").otherwise("1") for k in keys])
    masks = ["1" * len(keys)]
    parts = []
    if semantics == "partial" and len(keys) > 1:
        masks += [m for i in range(1, 2 ** len(keys) - 1) if (m := format(i, f"0{len(keys)}b"))]
    if semantics == "full" and len(keys) > 1:
        mixed = any_of([F.col(k).isNull() for k in keys]) & any_of([F.col(k).isNotNull() for k in keys])
        parts.append(refs.where(mixed).withColumn("reason", F.lit("partial")))
    for m in masks:
        columns = [k for k, bit in zip(keys, m) if bit == "1"]
        spans = _spans(target, columns)
        one = F.struct(*columns) if len(columns) > 1 else F.col(columns[0])
        spans = spans.select(one.alias("__key"), F.col("spans").alias("__spans"))
        mine = refs.where(mask == m).withColumn("__key", one)
        joined = lookup_join(mine, spans, "__key")
        begun = F.exists("__spans", lambda s: s["since"].isNull() | F.col("__at").isNull() | (s["since"] <= F.col("__at")))
        sound = F.exists("__spans", lambda s: (s["since"].isNull() | F.col("__at").isNull() | (s["since"] <= F.col("__at"))) & (s["until"].isNull() | F.col("__at").isNull() | (s["until"] > F.col("__at"))))
        reason = F.when(F.col("__spans").isNull(), "missing").when(sound, None).when(~begun, "late").otherwise("deleted")
        parts.append(joined.withColumn("reason", reason).where(F.col("reason").isNotNull()).drop("__spans", "__key"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.drop("__at")
