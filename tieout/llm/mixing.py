"""Mixing sources to target shares of all tokens, along a time-varying curriculum.

Each source has a weight schedule over training time t in [0, 1] whose integral is its target
share. Demand up to t is the integral of the weight times the mixture's size; a record at
cumulative token offset c of its source is trained at the t where demand reaches c, so positions
are found by inverting the schedule's integral, and records are range-sorted by position.

A schedule is the caller's: knots (t, weight) a source, joined by straight lines, scaled so that their integral is
the target share. Without one, w_s(t) = share_s (1 + g_s (2 t - 1)), with g_s in [-1, 1] and sum share_s g_s = 0, so
the weights of all sources add up to 1 at every t. The integral is quadratic between knots and inverted in closed form.

The mixture is as large as the caps allow: its size is the least over sources of
max_repeats x tokens / share. A source is passed through in a fixed pseudo-random order as many
whole times as its demand holds, and once more up to the record with which demand is met. Offsets
come from a two-level prefix sum (buckets of the order, then records inside a bucket), so a source
holding most records is never sorted in one task.

Defined results: sources without records, or with a share of zero or less, or a null share or
cap, take no part and the others' shares are scaled to 1; records of unlisted or null sources
aren't used; records without tokens carry no weight and aren't used; the overshoot of a source is
less than one record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of a source's order. A source of 1e10 records has 2.4 million a bucket.
BUCKETS = 4096
#: How far weights move over training: a source's weight changes by up to this share of itself.
SLOPE = 0.5


def _segments(knots: Column) -> Column:
    """Knots (t, w) in order of t to pieces (t0, t1, w0, w1, from_, whole): a piece's ends, the integral before it and that of all."""
    n = F.size(knots)
    pieces = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.struct(F.element_at(knots, i)["t"].alias("t0"), F.element_at(knots, i + 1)["t"].alias("t1"), F.element_at(knots, i)["w"].alias("w0"), F.element_at(knots, i + 1)["w"].alias("w1")))
    area = lambda x: (x["w0"] + x["w1"]) / 2 * (x["t1"] - x["t0"])
    upto = lambda some: F.aggregate(some, F.lit(0.0), lambda acc, x: acc + area(x))
    return F.transform(pieces, lambda x, i: F.struct(x["t0"].alias("t0"), x["t1"].alias("t1"), x["w0"].alias("w0"), x["w1"].alias("w1"), upto(F.slice(pieces, F.lit(1), i)).alias("from_"), upto(pieces).alias("whole")))


def _time_of(u: Column, segments: Column) -> Column:
    """The t in [0, 1] at which the schedule's integral reaches the share ``u`` of the whole."""
    at = lambda x: u * x["whole"]
    x = F.element_at(F.filter(segments, lambda x: (x["from_"] <= at(x)) & (x["t1"] > x["t0"])), -1)
    rest, d = at(x) - x["from_"], x["t1"] - x["t0"]
    # w0 y + (w1 - w0) y^2 / 2 d = rest, in the form that holds for a level piece too
    root = x["w0"] + F.sqrt(F.greatest(x["w0"] * x["w0"] + 2 * (x["w1"] - x["w0"]) / d * rest, F.lit(0.0)))
    return F.least(x["t0"] + F.when(root > 0, 2 * rest / root).otherwise(0.0), x["t1"])


def plan(counts: DataFrame, weights: DataFrame, slope: float = SLOPE, schedule: DataFrame | None = None) -> DataFrame:
    """One row per source that takes part: share, max_repeats, tokens, demand, passes, rest, g, segments.

    ``counts``: (source, n_tokens, ...) per record; ``weights``: (source, target_share, max_repeats), a
    handful of rows; ``schedule``: (source, t, weight), knots from t = 0 to t = 1 with weights of at least 0 that aren't all
    0 (of several at one t their mean; a jump is two knots close together); sources without knots keep the line. In the default line, sources whose records may be repeated more (the small, curated ones) gain weight over
    training time, the others lose it.
    """
    sizes = counts.where("n_tokens > 0 and source is not null").groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("records"))
    usable = weights.where("target_share > 0 and max_repeats > 0").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    p = sizes.join(F.broadcast(usable), "source")  # as many rows as the caller named sources
    every = Window.partitionBy(F.lit(0))
    p = p.withColumn("share", F.col("target_share") / F.sum("target_share").over(every))
    p = p.withColumn("size", F.floor(F.min(F.col("max_repeats") * F.col("tokens") / F.col("share")).over(every)))
    p = p.withColumn("demand", F.least(F.round(F.col("share") * F.col("size")).cast("bigint"), F.col("max_repeats") * F.col("tokens")))
    p = p.withColumns({"passes": F.floor(F.col("demand") / F.col("tokens")).cast("bigint"), "rest": F.col("demand") % F.col("tokens")})
    p = p.withColumn("lean", F.col("max_repeats") - F.sum(F.col("share") * F.col("max_repeats")).over(every))
    most = F.max(F.abs("lean")).over(every)
    p = p.withColumn("g", F.when(most > 0, slope * F.col("lean") / most).otherwise(0.0)).drop("lean")
    knot = lambda t, w: F.struct(F.lit(t).cast("double").alias("t"), w.cast("double").alias("w"))
    line = F.array(knot(0.0, 1 - F.col("g")), knot(1.0, 1 + F.col("g")))
    if schedule is None:
        return p.withColumn("segments", _segments(line))
    one = F.struct(F.col("t").cast("double").alias("t"), F.col("weight").cast("double").alias("w"))
    given = schedule.where("source is not null and t between 0 and 1 and weight >= 0").groupBy("source", "t").agg(F.avg("weight").alias("weight")).groupBy("source").agg(F.array_sort(F.collect_list(one)).alias("knots"))  # as many as the caller wrote
    return p.join(F.broadcast(given), "source", "left").withColumn("segments", _segments(F.coalesce("knots", line))).drop("knots")


def mix(counts: DataFrame, planned: DataFrame, seed: int = 0) -> DataFrame:
    """(source, doc_id, copy, n_tokens, position): every use of every record, sorted by position in [0, 1]."""
    order = F.xxhash64(F.lit(seed), "doc_id")
    recs = counts.where("n_tokens > 0").join(F.broadcast(planned.select("source", "tokens", "demand", "passes", "rest", "segments")), "source")
    recs = recs.withColumns({"order": order, "bucket": F.pmod(F.shiftrightunsigned(order, 40), F.lit(BUCKETS))})
    # buckets must follow the order used inside them: (bucket, order) is the order
    sums = recs.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("bt"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("start", F.coalesce(F.sum("bt").over(before), F.lit(0))).select("source", "bucket", "start")
    inside = Window.partitionBy("source", "bucket").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    recs = recs.withColumn("within", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(starts, ["source", "bucket"])
    recs = recs.withColumn("offset", F.col("start") + F.col("within"))
    copies = F.col("passes") + F.when(F.col("offset") < F.col("rest"), 1).otherwise(0)
    uses = recs.withColumn("copies", copies).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    at = (F.col("copy") - 1) * F.col("tokens") + F.col("offset") + F.col("n_tokens") / 2
    u = F.least(at / F.col("demand"), F.lit(1.0))
    t = _time_of(u, F.col("segments"))
    return uses.select("source", "doc_id", F.col("copy").cast("int").alias("copy"), "n_tokens", t.alias("position")).orderBy("position", "doc_id", "copy")


def shares(counts: DataFrame, planned: DataFrame, weights: DataFrame, seed: int = 0) -> DataFrame:
    """Per listed source: target, tokens there were and used, share reached, most uses of a record."""
    used = mix(counts, planned, seed).groupBy("source").agg(F.sum("n_tokens").alias("used_tokens"), F.max("copy").alias("most_uses"), F.countDistinct("doc_id").alias("used_records"))
    all_used = F.sum("used_tokens").over(Window.partitionBy(F.lit(0)))
    out = weights.select("source", "target_share", "max_repeats").join(planned.select("source", "share", "tokens", "demand"), "source", "left").join(used, "source", "left")
    return out.select("source", "target_share", "share", "max_repeats", "tokens", "demand", "used_tokens", "used_records", "most_uses", F.when(all_used > 0, F.coalesce("used_tokens", F.lit(0)) / all_used).alias("reached_share"))
