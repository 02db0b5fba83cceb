"""Quantities recorded in different units, brought to one unit.

What a value says about itself is read first: a unit, a scale and a frequency written in the
text, and the frequency field in any of its spellings. What nothing in the row says is found
from the history: every source's values of one subject, in order of time, as logarithms of the
annual amount under the declared unit. An exact penalised changepoint search (the segmentation with
the least squared error plus ``PENALTY`` per change; short histories by optimal partitioning, long
ones with PELT's pruning, which loses nothing) cuts the history into levels. The heaviest level that says
its unit, or else explains most of the history, is the anchor. From there outwards the shift to the next
level is compared with the known factors: a shift within ``NEAR`` of one marks a change of unit, which is
reversed. A shift that matches none is a change of the amount itself; the new level, like a lone
one, is moved by the one factor that brings it into the range of true amounts, if there is one.

Histories are sorted by a shuffle on the subject and walked in batches; runs of equal levels are merged into
one weighted point first, and short histories of equal length are solved together. One subject's history is
read by one task in order of time, as the search demands; nothing of it is cut.

Defined results: a null amount, a single premium and a text without a number have no annual
amount; a null subject is a history of one row; repeated rows are points of equal level;
equal times are ordered by row id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PENALTY = 0.5
#: How near the logarithm of a shift must come to that of a known factor.
NEAR = 0.25
#: Histories up to this many points are solved together by length. A choice of plan: both searches are exact.
TOGETHER = 64

#: Spellings of payment frequencies (lower case) and their instalments a year. Fixed values.
FREQUENCIES = {
    12: ("m", "12", "mthly", "monthly", "mth", "month", "pm", "p.m.", "per month", "12 a year"),
    4: ("q", "4", "qtr", "qtrly", "quarterly", "quarter", "3-monthly", "pq", "per quarter"),
    2: ("h", "2", "hy", "half-yearly", "half yearly", "6-monthly", "semi-annual", "per half year"),
    1: ("a", "1", "ann", "annual", "annually", "yearly", "yrly", "yr", "pa", "p.a.", "per annum", "per year", "y"),
}
#: Frequencies written into an amount, tried in this order. Fixed values.
AMOUNT_FREQUENCIES = ((2, r"half|6-monthly|semi"), (4, r"quarter|/\s*q|\bqtr|3-monthly|\bpq\b"), (12, r"month|/\s*m|\bmth|\bp\.?m\b"), (1, r"annum|annual|year|/\s*y|/\s*a|\byrly|\bp\.?a\b"))
NUMBER = r"([0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?|[0-9]+(?:\.[0-9]+)?)"
PLAIN = r"^[0-9]+(\.[0-9]+)?$"


@dataclass(frozen=True)
class Declared:
    """How an extract says it records an amount: units of the common unit in one of its own, and the codes of its frequencies."""

    unit: int
    frequencies: tuple[str, ...]
    never: tuple[str, ...] = ("sp",)


def _frequency(field: Column) -> Column:
    t = F.lower(F.trim(field))
    out = F.lit(None).cast("int")
    for per_year, spellings in FREQUENCIES.items():
        out = F.when(t.isin(*spellings), per_year).otherwise(out)
    return out


def read_amounts(df: DataFrame, amount: Column, frequency: Column, declared: Declared) -> DataFrame:
    """Adds ``number``, ``unit`` (common units in one of the text's, null if unsaid), ``per_year`` and ``as_declared``."""
    t = F.lower(F.trim(amount))
    number = F.replace(F.regexp_extract(t, NUMBER, 1), F.lit(","), F.lit("")).try_cast("decimal(20,4)")
    tail = F.regexp_replace(t, r"^[^0-9]*[0-9][0-9,]*(\.[0-9]+)?", "")
    pence = tail.rlike(r"^\s*(p|pence|penny)(?![a-z.])")
    pounds = t.rlike(r"£|gbp|\bstg\b|sterling|pounds?\b|/-")
    thousand = tail.rlike(r"^\s*k\b")
    unit = F.when(pence, 1).when(thousand, 100_000).when(pounds, 100)
    written = F.lit(None).cast("int")
    for per_year, pattern in reversed(AMOUNT_FREQUENCIES):
        written = F.when(tail.rlike(pattern), per_year).otherwise(written)
    plain = F.trim(amount).rlike(PLAIN)
    return df.withColumns(
        {
            "number": F.when(~F.lower(F.trim(F.coalesce(frequency, F.lit("")))).isin(*declared.never), number),
            "unit": unit,
            "per_year": F.coalesce(written, _frequency(frequency)),
            "as_declared": F.coalesce(plain & frequency.isin(*declared.frequencies), F.lit(False)),
            "declared_unit": F.lit(declared.unit),
        }
    )


def segment_levels(level: np.ndarray, weight: np.ndarray, bounds: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The level of each point's segment; series i is level[bounds[i]:bounds[i + 1]]. Exact at any length."""
    out = level.copy()
    lengths = np.diff(bounds)
    for n in np.unique(lengths[lengths > 1]):
        at = bounds[:-1][lengths == n]
        if n > TOGETHER:
            for a in at:
                out[a : a + n] = _pelt(level[a : a + n], weight[a : a + n], penalty)
        else:
            idx = at[:, None] + np.arange(n)
            out[idx] = _solve(level[idx], weight[idx], penalty)
    return out


def _solve(x: np.ndarray, w: np.ndarray, penalty: float) -> np.ndarray:
    """Optimal partitioning of k series of n points at once."""
    k, n = x.shape
    sums = [np.concatenate([np.zeros((k, 1)), np.cumsum(v, axis=1)], axis=1) for v in (w, w * x, w * x * x)]
    best, last, rows = np.zeros((k, n + 1)), np.zeros((k, n + 1), dtype=np.int64), np.arange(k)
    for t in range(1, n + 1):
        sw, sx, sxx = (s[:, [t]] - s[:, :t] for s in sums)
        total = best[:, :t] + np.maximum(sxx - sx * sx / sw, 0) + penalty
        last[:, t] = np.argmin(total, axis=1)
        best[:, t] = total[rows, last[:, t]]
    out = np.empty_like(x)
    end = np.full(k, n)
    for t in range(n, 0, -1):  # walk back: point t-1 belongs to the segment that ends at `end`
        end = np.where(last[rows, end] >= t, last[rows, end], end)
        start = last[rows, end]
        out[:, t - 1] = (sums[1][rows, end] - sums[1][rows, start]) / (sums[0][rows, end] - sums[0][rows, start])
    return out


def _pelt(x: np.ndarray, w: np.ndarray, penalty: float) -> np.ndarray:
    """Optimal partitioning of one long series. A start whose cost already exceeds the best one can't come back."""
    n = len(x)
    sw, sx, sxx = (np.concatenate([[0.0], np.cumsum(v)]) for v in (w, w * x, w * x * x))
    best, last, live = np.zeros(n + 1), np.zeros(n + 1, dtype=np.int64), np.array([0])
    for t in range(1, n + 1):
        d, m = sw[t] - sw[live], sx[t] - sx[live]
        cost = best[live] + np.maximum(sxx[t] - sxx[live] - m * m / d, 0)
        i = np.argmin(cost)
        best[t], last[t] = cost[i] + penalty, live[i]
        live = np.append(live[cost <= best[t]], t)
    out, end = np.empty(n), n
    while end:
        start = last[end]
        out[start:end] = (sx[end] - sx[start]) / (sw[end] - sw[start])
        end = start
    return out


def _factor_of(level: np.ndarray, factors: np.ndarray, low: float, high: float) -> np.ndarray:
    """Index of the first factor that brings a level into the range, -1 if none does."""
    out = np.full(len(level), -1)
    for i, f in reversed(list(enumerate(np.log(factors)))):
        out[(level + f >= low) & (level + f <= high)] = i
    return out


def _by_shifts(level: np.ndarray, weight: np.ndarray, said: np.ndarray, factors: np.ndarray, low: float, high: float) -> np.ndarray:
    """Index of the factor of each segment of one history: outwards from the anchor, by shifts between neighbours."""
    f = np.log(factors)
    fits = _factor_of(level, factors, low, high)
    if said.any():
        anchor = int(np.argmax(np.where(said, weight, -1)))
        first = 0
    else:
        true = level + np.where(fits >= 0, f[fits], 0.0)
        near = (np.abs(level[None, :, None] + f - true[:, None, None]) <= NEAR).any(axis=2)
        worth = np.where(fits >= 0, (near * weight).sum(axis=1), -1)
        anchor = int(np.argmax(worth + (fits == 0) * 0.5))
        first = fits[anchor]
    out = np.full(len(level), -1)
    out[anchor] = first
    for way in (range(anchor + 1, len(level)), range(anchor - 1, -1, -1)):
        before = level[anchor] + (f[first] if first >= 0 else 0.0)
        for i in way:
            off = np.abs(level[i] + f - before)
            k = int(np.argmin(off))
            out[i] = 0 if said[i] else k if off[k] <= NEAR else fits[i]
            before = level[i] + (f[out[i]] if out[i] >= 0 else 0.0)
    return out


def _walk(factors: list[float], low: float, high: float):
    """``factors`` starts with 1: as declared."""
    f, lo, hi = np.array(factors), np.log(low) - 1e-3, np.log(high) + 1e-3

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        series, level, said = pdf["series"].to_numpy(), pdf["level"].to_numpy(), pdf["said"].to_numpy()
        new_series = np.r_[True, series[1:] != series[:-1]]
        new_run = new_series | np.r_[True, level[1:] != level[:-1]]
        run = np.cumsum(new_run) - 1
        start = np.flatnonzero(new_run)
        weight = np.bincount(run).astype(float)
        bounds = np.r_[run[new_series], len(start)]
        levels = segment_levels(level[start], weight, bounds)
        first_of = np.isin(np.arange(len(levels)), bounds[:-1])
        new_segment = first_of | np.r_[True, levels[1:] != levels[:-1]]
        segment = np.cumsum(new_segment) - 1
        at = levels[new_segment]
        found = _factor_of(at, f, lo, hi)
        heavy = np.bincount(segment, weights=weight)
        spoken = np.bincount(segment[run], weights=said) > 0
        ends = np.r_[segment[bounds[:-1]], len(at)]
        for i in np.flatnonzero(np.diff(ends) > 1):
            a, b = ends[i], ends[i + 1]
            found[a:b] = _by_shifts(at[a:b], heavy[a:b], spoken[a:b], f, lo, hi)
        found = found[segment][run]
        return pdf.drop(columns=["series", "level"]).assign(factor=np.where(found >= 0, f[found], np.nan))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            held.append(pdf)
            last = pdf["series"].iloc[-1]
            if pdf["series"].iloc[0] == last and held[0]["series"].iloc[0] == last:
                continue  # one history so far
            whole = pd.concat(held, ignore_index=True)
            cut = int(np.argmax(whole["series"].to_numpy() == last))
            if cut:
                yield solve(whole.iloc[:cut])
            held = [whole.iloc[cut:]]
        if held:
            yield solve(pd.concat(held, ignore_index=True))

    return walk


def unit_factors(points: DataFrame, factors: list[float], low: float, high: float) -> DataFrame:
    """``points`` (series bigint, at timestamp, level double, said boolean, extract_name, row_id and more) without series, at and level, plus ``factor``.

    ``level`` is the logarithm of the amount under the declared unit, or the one it ``said``; ``factors`` multiply it and
    start with 1.
    """
    ordered = points.repartition("series").sortWithinPartitions("series", "at", "extract_name", "row_id").drop("at")
    kept = ", ".join(f"{c} {t}" for c, t in ordered.dtypes if c not in ("series", "level"))
    return ordered.mapInPandas(_walk(factors, low, high), f"{kept}, factor double")


def annual_amounts(df: DataFrame, series: Column, time: Column, low: float, high: float, factors: tuple[float, ...] = (1.0, 100.0, 0.01)) -> DataFrame:
    """(extract_name, row_id, annual_pence, recorded_otherwise, factor) of every row with an annual amount.

    ``df`` comes from :func:`read_amounts`. Amounts that say their unit are points of the history
    too, at the level they say, so they steady the levels around them; only the others are moved.
    """
    base = (F.col("number") * F.coalesce(F.col("unit"), F.col("declared_unit")) * F.col("per_year") * 10000).cast("bigint")
    key = F.xxhash64(F.coalesce(series, F.concat_ws("#", "extract_name", F.col("row_id").cast("string"))))
    points = df.select("extract_name", "row_id", key.alias("series"), time.alias("at"), base.alias("base"), F.col("unit").isNotNull().alias("said"), "as_declared")
    points = points.where(F.col("base") > 0).withColumn("level", F.ln(F.col("base") / 10000))
    found = unit_factors(points, list(factors), low, high)
    factor = F.when(F.col("said"), 1.0).otherwise(F.coalesce("factor", F.lit(1.0)))
    pence = F.round((F.col("base").cast("decimal(20,0)") * factor.cast("decimal(10,4)")) / 10000, 0).cast("bigint")
    return found.select("extract_name", "row_id", pence.alias("annual_pence"), (~F.col("as_declared") | F.col("said") | (factor != 1.0)).alias("recorded_otherwise"), factor.alias("factor"))
