"""General data-quality operators on small fixtures: nulls, ties, repeats, empty tables, clashing names, brute force."""

import random
from collections import Counter
from datetime import date, datetime
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from tieout.functions import text as T
from tieout.operators import copy_diff, key_totals, load_profile, orphans, unit_changes
from tieout.plans import joins
from tieout.queries.quality import WATCHED, policy_key
from tieout.sources import records

RULE = load_profile.ColumnRule("v", lambda v: ~v.isin("a", "b"), states=("a",))


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# ------------------------------------------------------------- loads


def test_shift_needs_more_than_the_tolerance(spark):
    data = [("L1", "a")] * 8 + [("L1", None)] * 2 + [("L2", "a")] * 7 + [("L2", None)] * 3 + [("L3", "a")] * 10 + [(None, None)] * 50
    df = spark.createDataFrame(data, "load string, v string")
    assert rows(load_profile.shifts(df, "load", [RULE], 0.1)) == [("v", "L3")]  # L2 moved by exactly 0.10


def test_violations_keep_nulls_out_and_survive_clashing_names(spark):
    df = spark.createDataFrame([("L1", 1, None, 9), ("L1", 2, "x", 9), (None, 3, "", 9), ("L1", 4, "a", 9)], "load string, row_id long, v string, colname int")
    assert rows(load_profile.violations(df, "load", "row_id", [RULE])) == [("L1", 2, "v"), (None, 3, "v")]


def test_profile_of_an_empty_and_an_all_null_table(spark):
    empty = spark.createDataFrame([], "load string, v string")
    assert load_profile.profile(empty, "load", [RULE]).count() == 0
    assert load_profile.shifts(empty, "load", [RULE], 0.1).count() == 0
    one = load_profile.profile(spark.createDataFrame([("L", None)] * 3, "load string, v string"), "load", [RULE]).first()
    assert (one.row_count, one.null_count, one.distinct_count, one.min_value, one.sum1) == (3, 3, 0, None, None)


def test_power_sums_are_exact_and_merge(spark):
    rule = load_profile.ColumnRule("v", numeric=True)
    df = spark.createDataFrame([("L1", "0.10"), ("L1", "9999.99"), ("L2", "0.10"), ("L2", "x")], "load string, v string")
    def exact(r, k):
        return sum(comb(k, i) * load_profile.LIMB**i * int(r[f"limb_{i}{k - i}"]) for i in range(k + 1))

    p = {r.load_id: r for r in load_profile.profile(df, "load", [rule]).collect()}
    assert exact(p["L1"], 2) == 10**2 + 999999**2 and exact(p["L1"], 4) == 10**4 + 999999**4 and p["L1"].sum4 == pytest.approx(999999**4)
    whole = load_profile.profile(df.withColumn("load", F.lit("all")), "load", [rule]).first()
    assert exact(whole, 3) == exact(p["L1"], 3) + exact(p["L2"], 3)
    # the largest amounts declared, often
    top = spark.range(50_000).select(F.lit("L").alias("load"), F.when(F.col("id") % 2 == 0, "999999999999.99").otherwise("-999999999999.98").alias("v"))
    t = load_profile.profile(top, "load", [rule]).first()
    assert exact(t, 4) == 25_000 * (99999999999999**4 + 99999999999998**4) and exact(t, 1) == 25_000


def test_calendar_dates(spark):
    values = ["20240229", "20230229", "19000229", "20000229", "20241301", "00000101", "2024-1-1", "2024010", "20240101 ", "٢٠٢٤٠١٠١", "", None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(T.is_ymd(F.col("v"))).collect()]

    def plain(v):
        if v is None:
            return None
        try:
            return v.isascii() and len(v) == 8 and v.isdigit() and bool(date(int(v[:4]), int(v[4:6]), int(v[6:])))
        except ValueError:
            return False

    assert got == [plain(v) for v in values]


def test_watched_columns_match_a_plain_reading(spark):
    values = ["IF", "if", "IF ", "", None, "CL"]
    df = spark.createDataFrame([("L1", i, "00000000", v, None) for i, v in enumerate(values)], "load_id string, row_id long, exitdt string, statcd string, unpddt string")
    assert [r[1] for r in rows(load_profile.violations(df, "load_id", "row_id", WATCHED))] == [1, 2, 3]


# ----------------------------------------------------------- records


def csv_fault(raw):
    """The fields of a record, or None if a quote is out of place; one character at a time."""
    out, i, n = [], 0, len(raw)
    while True:
        if i < n and raw[i] == '"':
            i, buf = i + 1, ""
            while True:
                if i >= n:
                    return None
                if raw[i] == '"':
                    if i + 1 < n and raw[i + 1] == '"':
                        buf, i = buf + '"', i + 2
                        continue
                    i += 1
                    break
                buf, i = buf + raw[i], i + 1
            if i < n and raw[i] != ",":
                return None
        else:
            j = raw.find(",", i)
            j = n if j < 0 else j
            buf, i = raw[i:j], j
            if '"' in buf:
                return None
        out.append(buf)
        if i >= n:
            return out
        i += 1


def test_parsing_agrees_with_a_character_by_character_reader(spark):
    rng = random.Random(7)
    raws = ["".join(rng.choice(['"', ",", "a", '""', "\n", '","', "\u0001", "\u0002a", "é"]) for _ in range(rng.randint(0, 9))) for _ in range(1500)]
    raws += ['"' + "x" * 200_000 + '""' * 50_000 + '",b,c', "y" * 300_000, None, "", '""', '"",""', "a,b,c"]
    df = spark.createDataFrame(list(enumerate(raws)), "i long, raw string")
    got = {r.i: r for r in records.parse(df, "raw", ["p", "q", "r"], {}).collect()}
    for i, raw in enumerate(raws):
        want = csv_fault(raw or "")
        faults = ["quoting"] if want is None else [] if len(want) == 3 else ["column_count"]
        assert got[i].faults == faults, raw
        if not faults:
            assert [got[i].p, got[i].q, got[i].r] == [w or None for w in want], raw


def test_first_fault_wins_and_clashing_names_get_a_suffix(spark):
    df = spark.createDataFrame([("x,-1.50,20240101", 5), ("x,1.,20241340", 5), ("x,,00000000", 5), ("x, 1,", 5)], "raw string, amt int")
    got = records.parse(df, "raw", ["id", "amt", "dt"], {"amt": ("bad_amount", records.amount_ok), "dt": ("bad_date", records.date_ok)})
    assert [r.faults for r in got.collect()] == [[], ["bad_amount", "bad_date"], [], ["bad_amount"]]
    assert [r.amt for r in got.collect()] == [5] * 4 and got.first().amt_field == "-1.50"


# -------------------------------------------------------- key totals


def test_weighted_statistics_equal_brute_force_with_a_hot_key_and_null_keys(spark):
    rng = random.Random(3)
    data = [("hot" if rng.random() < 0.4 else rng.choice(["a", "b", None]), rng.choice([None, *range(-9000, 9000, 7)])) for _ in range(6000)] + [("one", 5), ("none", None)]
    weighted = key_totals.compress(spark.createDataFrame(data, "k string, v long"), F.col("k"), F.col("v"))
    points = {"p10": 0.1, "p50": 0.5, "p100": 1.0}
    got = {r.key: r for r in key_totals.percentiles(weighted, ["key"], points).collect()}
    tot = {r.key: r for r in key_totals.totals(weighted, "key").collect()}
    for k in {k for k, _ in data}:
        vs = sorted(v for kk, v in data if kk == k and v is not None)
        assert tot[k].row_count == sum(kk == k for kk, _ in data) and tot[k].distinct_count == len(set(vs))
        if not vs:
            assert k not in got and tot[k].mode_value is None
            continue
        c = Counter(vs)
        assert tot[k].mode_value == min(c, key=lambda v: (-c[v], v))
        for name, p in points.items():
            assert getattr(got[k], name) == vs[max(1, int(np.ceil(len(vs) * p))) - 1]


def test_percentiles_of_values_that_spread_far(spark):
    rng = random.Random(8)
    data = [(k, v) for k in ("a", None) for v in [rng.randrange(-(2**62), 2**62) for _ in range(300)] + [5, 5, 5, -(2**63), 2**63 - 1]]
    w = key_totals.compress(spark.createDataFrame(data, "k string, v long"), F.col("k"), F.col("v"))
    got = {r.key: r for r in key_totals.percentiles(w, ["key"], {"p0": 0.0, "p50": 0.5, "p100": 1.0}).collect()}
    for k in ("a", None):
        vs = sorted(v for kk, v in data if kk == k)
        assert (got[k].p0, got[k].p50, got[k].p100) == (vs[0], vs[int(np.ceil(len(vs) * 0.5)) - 1], vs[-1])
    assert key_totals.percentiles(w.limit(0), ["key"], {"p50": 0.5}).count() == 0


def test_heavy_keys_count_null_rows_in_the_whole(spark):
    df = spark.createDataFrame([("c", "a")] * 2 + [("c", "b")] * 1 + [("c", None)] * 97, "colname string, k string")
    w = key_totals.compress(df, F.col("k"), F.lit(1), colname=F.col("colname"))
    assert rows(key_totals.heavy(w, ["colname", "key"], 0.02)) == [("c", "a", 2)]
    assert key_totals.heavy(w.limit(0), ["colname", "key"], 0.02).count() == 0


# -------------------------------------------------------------- copies


def test_differences_equal_a_plain_comparison(spark):
    rng = random.Random(5)
    src = {f"{k:010d}": (f"{rng.randint(1, 99)}.00", str(rng.randint(1, 9))) for k in rng.sample(range(10**7), 900)}
    cp = {k: v for k, v in src.items() if rng.random() > 0.05}
    for k in rng.sample(sorted(cp), 60):
        cp[k] = rng.choice([(None, cp[k][1]), (cp[k][0], "77"), ("x", "y")])
    cp |= {"0009999999": ("1", "1"), "odd key": ("1", "1")}
    a = [(k, *v) for k, v in src.items()] * 2 + [(None, "1", "1")]
    b = [(f" {int(k)} " if k.isdigit() else k, *v) for k, v in cp.items()]
    schema = "polno string, premamt string, sumassd string"
    key = policy_key(F.col("polno"))
    got = copy_diff.differences(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), key, key, {"premamt": T.canonical_number, "sumassd": T.canonical_number})
    want = {(k, "missing_in_copy") for k in src.keys() - cp.keys()} | {(k, "missing_in_source") for k in cp.keys() - src.keys()}
    num = lambda x: x if x is None or not x.replace(".", "").isdigit() else float(x)
    for k in src.keys() & cp.keys():
        want |= {(k, f) for i, f in enumerate(("premamt", "sumassd")) if num(src[k][i]) != num(cp[k][i])}
    assert {(r.key, r.difference) for r in got.collect()} == want and got.count() == len(want)


def test_one_odd_key_or_outlier_keeps_leaves_narrow(spark):
    a = spark.range(20_000).select(F.lpad(F.col("id").cast("string"), 10, "0").alias("k"), F.lit("x").alias("f"))
    a = a.unionByName(spark.createDataFrame([("ABC-1", "x"), ("999999999999999999", "x")], "k string, f string"))
    b = a.withColumn("f", F.when(F.col("k") == "0000012345", "y").otherwise(F.col("f")))
    pa, pb = (copy_diff._prepared(d, F.col("k"), {"f": F.col("f")}) for d in (a, b))
    widths = copy_diff.leaf_widths(pa.unionByName(pb))
    leaves = copy_diff.differing_leaves(pa, pb, widths)
    assert leaves.count() == 1 and widths[True] <= 8
    assert pa.withColumn("leaf", copy_diff._leaf(widths)).join(leaves, ["number", "leaf"], "left_semi").count() <= 8
    c = F.col("k")
    assert rows(copy_diff.differences(a, b, c, c, {"f": lambda x: x})) == [("0000012345", "f", "x", "y")]


def test_a_value_that_changes_places_with_a_null_is_a_difference(spark):
    schema = "k string, f string, g string"
    a, b = spark.createDataFrame([("1", None, "5")], schema), spark.createDataFrame([("1", "5", None)], schema)
    c = F.col("k")
    assert [r[1] for r in rows(copy_diff.differences(a, b, c, c, {"f": lambda x: x, "g": lambda x: x}))] == ["f", "g"]


def test_one_empty_side_makes_all_of_the_other_missing(spark):
    schema = "k string, f string"
    a = spark.createDataFrame([("1", "x"), ("2", None)], schema)
    c = F.col("k")
    assert rows(copy_diff.differences(a, a.limit(0), c, c, {"f": lambda x: x}).select("key", "difference")) == [("1", "missing_in_copy"), ("2", "missing_in_copy")]
    assert copy_diff.differences(a.limit(0), a.limit(0), c, c, {"f": lambda x: x}).count() == 0


@pytest.mark.parametrize(("a", "b", "same"), [("1,000.50", " 1000.5 ", True), ("+5", "5.00", True), ("-0", "0", True), ("007", "7", True), ("1,00", "100", False), ("1e3", "1000", False), ("", "", True), ("5.", "5", True), ("9" * 50, "9" * 49 + "8", False), (".5", "0.50", True), (".", ".", True)])
def test_numbers_compare_by_value(spark, a, b, same):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(T.canonical_number(F.col("a")) == T.canonical_number(F.col("b"))).first()[0] is same


# ------------------------------------------------------------- units


def brute_levels(x, penalty):
    """Least squared error plus penalty over every segmentation."""
    best = None
    n = len(x)
    for mask in range(1 << (n - 1)):
        cuts = [0, *[i + 1 for i in range(n - 1) if mask >> i & 1], n]
        cost = sum(((x[a:b] - x[a:b].mean()) ** 2).sum() for a, b in zip(cuts, cuts[1:])) + penalty * (len(cuts) - 1)
        if best is None or cost < best[0] - 1e-12:
            best = (cost, cuts)
    return best[0]


def test_changepoints_are_optimal():
    rng = np.random.default_rng(1)
    for _ in range(60):
        n = int(rng.integers(1, 9))
        x = rng.choice([0.0, 4.6, 1.0], n) + rng.normal(0, 0.1, n)
        lev = unit_changes.segment_levels(x, np.ones(n), np.array([0, n]), 0.5)
        parts = 1 + int((lev[1:] != lev[:-1]).sum())
        assert ((x - lev) ** 2).sum() + 0.5 * parts == pytest.approx(brute_levels(x, 0.5))


def test_both_searches_are_exact_at_any_length():
    rng = np.random.default_rng(2)
    for n in (2, 40, 300, 900):
        x = np.repeat(rng.choice([0.0, 4.6, 1.0], n), 1) + rng.normal(0, 0.3, n)
        w = rng.integers(1, 4, n).astype(float)
        cost = lambda lev: (w * (x - lev) ** 2).sum() + 0.5 * (lev[1:] != lev[:-1]).sum()
        assert cost(unit_changes._pelt(x, w, 0.5)) == pytest.approx(cost(unit_changes._solve(x[None], w[None], 0.5)[0]))
    x = np.r_[np.zeros(700), np.full(900, 4.6), np.zeros(3)]
    assert np.allclose(unit_changes.segment_levels(x, np.ones(len(x)), np.array([0, len(x)])), x)


def _history(spark, amounts, factors):
    said = lambda a: a.startswith("£")
    df = spark.createDataFrame([("e", i, "one", datetime(2024, 1, 1 + i), a, "A") for i, a in enumerate(amounts)], "extract_name string, row_id long, s string, at timestamp, amt string, frq string")
    read = unit_changes.read_amounts(df, F.col("amt"), F.col("frq"), unit_changes.Declared(100, ("A",)))
    return [r.annual_pence for r in sorted(unit_changes.annual_amounts(read, F.col("s"), F.col("at"), 12000, 600000, factors).collect(), key=lambda r: r.row_id)]


def test_shifts_decide_where_the_range_of_true_amounts_can_not(spark):
    factors = (1.0, 100.0, 0.01, 12.0)
    # 2,400 a year became 200 a month: both are in the range, only the shift by twelve tells
    assert _history(spark, ["2400.00"] * 4 + ["200.00"] * 3 + ["2400.00"] * 2, factors) == [240000] * 9
    # a slow rise is no change of unit; the level before the shift is the one to compare with
    assert _history(spark, ["1000.00", "1100.00", "1210.00", "1331.00", "133100", "146410"], factors) == [100000, 110000, 121000, 133100, 133100, 146410]
    # what says its unit is the anchor; a shift that matches no factor is a new amount
    assert _history(spark, ["£200.00", "20000", "500.00"], factors) == [20000, 20000, 50000]
    assert _history(spark, ["13000"], (1.0, 100.0, 0.01)) == [13000]


def test_amounts_in_every_spelling(spark):
    cases = [("100.00", "M", 120000, False), ("10000", "M", 120000, True), ("£1.2k", "A", 120000, True), ("1,200p/mth", "A", 14400, True), ("GBP 50 p.a.", "M", 5000, True), ("90.00 quarterly", None, 36000, True), ("stg 10.00", "M", 12000, True), ("600.00", "HY", 120000, True), ("£95/-", "M", 114000, True), ("100.00", "SP", None, None), (None, "M", None, None), ("n/a", "M", None, None)]
    df = spark.createDataFrame([("e", i, str(i), datetime(2024, 1, 1), a, f) for i, (a, f, _, _) in enumerate(cases)], "extract_name string, row_id long, s string, at timestamp, amt string, frq string")
    read = unit_changes.read_amounts(df, F.col("amt"), F.col("frq"), unit_changes.Declared(100, ("M", "Q", "H", "A")))
    got = {r.row_id: r for r in unit_changes.annual_amounts(read, F.col("s"), F.col("at"), 5000, 600000).collect()}
    for i, (a, f, pence, other) in enumerate(cases):
        assert (got[i].annual_pence, got[i].recorded_otherwise) == (pence, other) if pence else i not in got, (a, f)


def test_batches_don_t_split_a_history(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(400).select(F.lit("e").alias("extract_name"), F.col("id").alias("row_id"), F.lit(None).cast("string").alias("s"), F.timestamp_seconds("id").alias("at"), F.when(F.col("id") % 5 == 0, "10000.00").otherwise("100.00").alias("amt"), F.lit("M").alias("frq"))
        read = unit_changes.read_amounts(df.withColumn("s", F.lit("one")), F.col("amt"), F.col("frq"), unit_changes.Declared(100, ("M",)))
        got = unit_changes.annual_amounts(read, F.col("s"), F.col("at"), 12000, 600000)
        assert got.count() == 400 and got.where("recorded_otherwise").count() == 80 and got.where("annual_pence <> 120000").count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


# ------------------------------------------------------------ orphans


def _ts(d):
    return None if d is None else datetime(2024, 1, d)


def test_orphans_by_time_and_null_mask(spark):
    target = spark.createDataFrame([("A", _ts(5), None), ("B", None, _ts(10)), ("C", None, None), (None, None, None), ("D", _ts(5), _ts(8))], "k string, since timestamp, until timestamp")
    refs = [("A", 4), ("A", 5), ("B", 10), ("B", 9), ("C", None), ("D", 9), ("Z", 1), (None, 1), ("A", None)]
    df = spark.createDataFrame([(k, _ts(d)) for k, d in refs], "k string, at timestamp")
    got = rows(orphans.orphans(df, target, ["k"], F.col("at")).select("k", F.dayofmonth("at"), "reason"))
    assert got == [("A", 4, "late"), ("B", 10, "deleted"), ("D", 9, "deleted"), ("Z", 1, "missing")]
    assert orphans.orphans(df, target.limit(0), ["k"], F.col("at")).count() == 8
    assert orphans.orphans(df.limit(0), target, ["k"], F.col("at")).count() == 0


@pytest.mark.parametrize(("semantics", "want"), [("simple", {("a", "9")}), ("partial", {("a", "9"), ("z", None)}), ("full", {("a", "9"), ("z", None), ("a", None)})])
def test_composite_keys_follow_the_declared_semantics(spark, semantics, want):
    target = spark.createDataFrame([("a", "1")], "x string, y string").withColumns({"since": F.lit(None).cast("timestamp"), "until": F.lit(None).cast("timestamp")})
    refs = spark.createDataFrame([("a", "1"), ("a", "9"), ("a", None), ("z", None), (None, None)], "x string, y string")
    assert {(r.x, r.y) for r in orphans.orphans(refs, target, ["x", "y"], F.lit(None).cast("timestamp"), semantics).collect()} == want


def test_salted_lookup_equals_the_broadcast_one(spark, monkeypatch):
    large = spark.range(2000).select(F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.col("id").cast("string")).alias("k"), "id")
    lookup = spark.createDataFrame([("hot", 1), ("3", 2), ("999", 3)], "k string, v int")
    want = rows(joins.lookup_join(large, lookup, "k"))
    monkeypatch.setattr(joins, "small_enough", lambda *_, **__: False)
    got = joins.lookup_join(large, lookup, "k")
    assert rows(got.select(*joins.lookup_join(large, lookup, "k").columns)) == want and got.count() == 2000


# ------------------------------------------------------------- folders


def test_a_cluster_without_a_shared_folder_is_refused():
    from types import SimpleNamespace

    from tieout.plans import lineage

    conf = SimpleNamespace(get=lambda *_: None)
    away = SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: conf, getCheckpointDir=lambda: None, master="spark://far:7077"))
    for master in ("spark://far:7077", "yarn", "local-cluster[2,1,1024]"):
        away.sparkContext.master = master
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            lineage.shared_folder(away)


def test_staged_tables_are_removed_on_request(spark):
    from pathlib import Path

    from tieout.plans import lineage

    t = lineage.stage(spark.range(3))
    folder = Path(lineage._tables(spark).removeprefix("file:"))
    assert t.count() == 3 and folder.exists()
    lineage.remove_tables(spark)
    assert not folder.exists() and lineage.stage(spark.range(2)).count() == 2
