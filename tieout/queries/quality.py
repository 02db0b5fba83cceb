"""Queries of the general data-quality problems, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import canonical_number, is_ymd
from ..operators import copy_diff, key_totals, load_profile, orphans, unit_changes
from ..plans.lineage import stage
from ..sources import records
from ..sources.tables import table

STATUSES = ("IF", "PU", "LA", "CL")
SHIFT = 0.10


def _date_rule(name: str, states=()) -> load_profile.ColumnRule:
    return load_profile.ColumnRule(name, lambda v: ~((v == "00000000") | is_ymd(v, 1900, 2099)), states=states)


WATCHED = [
    _date_rule("exitdt", ("00000000",)),
    load_profile.ColumnRule("statcd", lambda v: ~v.isin(*STATUSES), states=STATUSES),
    _date_rule("unpddt", ("00000000",)),
]
EFAS_RULES = [
    load_profile.ColumnRule("rectype"),
    load_profile.ColumnRule("polno", lambda v: ~v.rlike(r"^[0-9]{10}\z")),
    load_profile.ColumnRule("prodcd", lambda v: ~v.rlike(r"^[A-Z]{4}\z")),
    _date_rule("commdt"),
    *WATCHED,
    load_profile.ColumnRule("exitrsn"),
    load_profile.ColumnRule("xa08"),
    load_profile.ColumnRule("schno", lambda v: ~((v == "00000000") | v.rlike(r"^SCH[0-9]{8}\z"))),
    load_profile.ColumnRule("schnm"),
    load_profile.ColumnRule("premamt", lambda v: ~v.rlike(r"^[0-9]+\.[0-9]{2}\z"), numeric=True),
    load_profile.ColumnRule("premfrq", lambda v: ~v.isin("M", "Q", "H", "A", "SP")),
    load_profile.ColumnRule("xa14"),
    load_profile.ColumnRule("sumassd", lambda v: ~v.rlike(r"^[0-9]+\z"), numeric=True),
    load_profile.ColumnRule("region"),
    load_profile.ColumnRule("mbrname"),
    _date_rule("birthdt"),
    load_profile.ColumnRule("nino", lambda v: ~v.rlike(r"^[A-Z]{2}[0-9]{6}[A-D]\z")),
    load_profile.ColumnRule("pcode", lambda v: ~v.rlike(r"^[A-Z]{1,2}[0-9][0-9A-Z]? [0-9][A-Z]{2}\z")),
    _date_rule("covstdt"),
    load_profile.ColumnRule("xa22", lambda v: ~v.isin("C", "U")),
    load_profile.ColumnRule("loybonus", lambda v: ~v.rlike(r"^[0-9]+\.[0-9]{2}\z"), numeric=True),
    load_profile.ColumnRule("extpnpct", lambda v: ~v.rlike(r"^[0-9]+\.[0-9]{2}\z"), numeric=True),
    load_profile.ColumnRule("custid"),
]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    efas = table(spark, d, "efas0042")
    bad = load_profile.violations(efas, "load_id", "row_id", WATCHED).select(F.lit("violation").alias("kind"), "colname", "load_id", F.col("row_id").cast("bigint").alias("row_id"))
    moved = load_profile.shifts(efas, "load_id", WATCHED, SHIFT).select(F.lit("shift").alias("kind"), "colname", "load_id", F.lit(-1).cast("bigint").alias("row_id"))
    return bad.unionByName(moved)


def p2_profile(spark: SparkSession, d: str) -> DataFrame:
    p = load_profile.profile(table(spark, d, "efas0042"), "load_id", EFAS_RULES)
    return p.select("load_id", "colname", "row_count", "null_count", "distinct_count", "min_value", "max_value", "violation_count", "numeric_count", *[F.col(f"sum{k}").cast("double").alias(f"power_sum_{k}") for k in (1, 2)])


def p2_drift(spark: SparkSession, d: str) -> DataFrame:
    p = load_profile.drift(load_profile.profile(table(spark, d, "efas0042"), "load_id", EFAS_RULES))
    r = lambda c: F.round(F.col(c), 6).alias(c)
    return p.select("load_id", "colname", r("null_rate_change"), "distinct_change", F.round("mean", 4).alias("mean"), F.round("skewness", 3).alias("skewness"), F.round("standardised_difference", 4).alias("standardised_difference"))


CLAIM_FIELDS = ["clm_ref", "claim_type", "amt_paid", "settle_dt", "assessor", "unicode_col", "notes"]
CLAIM_RULES = {"amt_paid": ("bad_amount", records.amount_ok), "settle_dt": ("bad_date", records.date_ok)}


def _claims(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "claims99_raw").where("rec_no is null or rec_no <> 0")
    return records.parse(raw, "raw", CLAIM_FIELDS, CLAIM_RULES)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _claims(spark, d).where(F.size("faults") > 0).select("rec_id", F.col("faults")[0].alias("reason"))


def p3_sound(spark: SparkSession, d: str) -> DataFrame:
    """The valid rows, as the seven fields; typed amount and date beside the delivered text."""
    return _claims(spark, d).where(F.size("faults") == 0).select("rec_id", *CLAIM_FIELDS)


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    c = _claims(spark, d)
    reason = F.when(F.size("faults") > 0, F.col("faults")[0]).otherwise("sound")
    return c.groupBy("file_id", reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    efas = table(spark, d, "efas0042")
    both = F.explode(F.array(*[F.struct(F.lit(c).alias("colname"), F.col(c).alias("key")) for c in ("schno", "prodcd")]))
    cells = efas.select(both.alias("c"), F.col("statcd"))
    weighted = key_totals.compress(cells, F.col("c.key"), F.col("statcd"), colname=F.col("c.colname"))
    return key_totals.heavy(weighted, ["colname", "key"], 0.02).select("colname", F.col("key").alias("keyvalue"))


def _p4_totals(spark: SparkSession, d: str, column: str) -> DataFrame:
    efas = table(spark, d, "efas0042")
    every = stage(key_totals.compress_all(efas, F.col(column), {"polno": F.col("polno"), "statcd": F.col("statcd"), "sumassd": F.col("sumassd").try_cast("bigint")}))
    of = lambda name: every.where(F.col("name") == name)
    policies = key_totals.totals(of("polno"), "key").select("key", "row_count", F.col("distinct_count").alias("policies"))
    sums = of("sumassd").withColumn("value", F.col("value").cast("bigint"))
    modes = key_totals.totals(of("statcd"), "key").select("key", F.col("distinct_count").alias("statuses"), F.col("mode_value").alias("mode_statcd"))
    amounts = sums.groupBy("key").agg(F.sum(F.col("value") * F.col("n")).alias("sum_assured"))
    points = key_totals.percentiles(sums, ["key"], {"p50_sumassd": 0.5, "p90_sumassd": 0.9})
    out = policies.alias("p")
    for t in (modes, amounts, points):  # all unique per key and pre-aggregated: one small row a key
        t = t.withColumnRenamed("key", "k2")
        out = out.join(t, F.col("key").eqNullSafe(F.col("k2")), "left").drop("k2")
    return out.withColumnRenamed("key", column)


def p4_schno_totals(spark: SparkSession, d: str) -> DataFrame:
    return _p4_totals(spark, d, "schno")


def p4_prodcd_totals(spark: SparkSession, d: str) -> DataFrame:
    return _p4_totals(spark, d, "prodcd")


def policy_key(c):
    """Ten digits: blanks around and leading zeros don't matter. Anything else stays as trimmed text."""
    t = F.trim(c)
    digits = F.regexp_replace(t, "^0+", "")
    return F.when(t.rlike("^[0-9]+$") & (F.length(digits) <= 10), F.lpad(digits, 10, "0")).otherwise(t)


def _p5(spark: SparkSession, d: str) -> DataFrame:
    key = policy_key(F.col("polno"))
    return copy_diff.differences(table(spark, d, "efas0042"), table(spark, d, "efas0042_copy"), key, key, {"premamt": canonical_number, "sumassd": canonical_number})


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _p5(spark, d).select(F.col("key").alias("polno"), "difference")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return _p5(spark, d).groupBy("difference").agg(F.count(F.lit(1)).alias("n"))


#: Every premium that isn't a single one is 120 to 6,000 pounds a year.
LOW_PENCE, HIGH_PENCE = 12_000, 600_000


def _p6(spark: SparkSession, d: str) -> DataFrame:
    nine = lambda c: F.right(F.trim(c), F.lit(9))
    efas = table(spark, d, "efas0042").select(F.lit("efas0042").alias("extract_name"), "row_id", nine(F.col("polno")).alias("policy"), F.col("loaded_at").alias("at"), "premamt", "premfrq")
    efas = unit_changes.read_amounts(efas, F.col("premamt"), F.col("premfrq"), unit_changes.Declared(100, ("M", "Q", "H", "A"))).drop("premamt", "premfrq")
    src = table(spark, d, "src").select(F.lit("src").alias("extract_name"), "row_id", nine(F.col("polno")).alias("policy"), F.col("received_at").alias("at"), "prem_pence", "prem_freq")
    src = unit_changes.read_amounts(src, F.col("prem_pence"), F.col("prem_freq"), unit_changes.Declared(1, ("M", "Q", "A"))).drop("prem_pence", "prem_freq")
    return unit_changes.annual_amounts(efas.unionByName(src), F.col("policy"), F.col("at"), LOW_PENCE, HIGH_PENCE)


def p6_annual(spark: SparkSession, d: str) -> DataFrame:
    """Every premium in pence a year."""
    return _p6(spark, d).select("extract_name", "row_id", "annual_pence")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _p6(spark, d).where("recorded_otherwise").select("extract_name", "row_id", "annual_pence")


def _p7(spark: SparkSession, d: str) -> DataFrame:
    norm = lambda c: F.upper(F.trim(c))
    refs = table(spark, d, "efas0042").select("load_id", "row_id", "loaded_at", norm(F.col("schno")).alias("ref"))
    refs = refs.withColumn("ref", F.when(~F.col("ref").isin("00000000", ""), F.col("ref")))
    target = table(spark, d, "esch0009").select(norm(F.col("schref")).alias("ref"), F.col("arrived_at").alias("since"), F.col("deleted_at").alias("until"))
    return orphans.orphans(refs, target, ["ref"], F.col("loaded_at"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _p7(spark, d).select("load_id", "row_id", "reason")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphans per load and reason, with the distinct references behind them."""
    return _p7(spark, d).groupBy("load_id", "reason", "ref").agg(F.count(F.lit(1)).alias("n")).groupBy("load_id", "reason").agg(F.sum("n").alias("orphan_rows"), F.count("ref").alias("orphan_refs"))


def _p7_named(spark: SparkSession, d: str):
    """References by scheme number and name together, either of which may be null; names without case and outer blanks."""
    norm = lambda c: F.nullif(F.upper(F.trim(c)), F.lit(""))
    refs = table(spark, d, "efas0042").select("load_id", "row_id", "loaded_at", norm(F.col("schno")).alias("ref"), norm(F.col("schnm")).alias("name"))
    refs = refs.withColumn("ref", F.when(F.col("ref") != "00000000", F.col("ref")))
    target = table(spark, d, "esch0009").select(norm(F.col("schref")).alias("ref"), norm(F.col("schname")).alias("name"), F.col("arrived_at").alias("since"), F.col("deleted_at").alias("until"))
    return refs, target


def p7_composite(spark: SparkSession, d: str) -> DataFrame:
    """Orphans of the composite key per load, semantics and reason."""
    refs, target = _p7_named(spark, d)
    out = None
    for semantics in ("simple", "partial", "full"):
        part = orphans.orphans(refs, target, ["ref", "name"], F.col("loaded_at"), semantics).groupBy("load_id", "reason").agg(F.count(F.lit(1)).alias("orphan_rows")).withColumn("semantics", F.lit(semantics))
        out = part if out is None else out.unionByName(part)
    return out.select("semantics", "load_id", "reason", "orphan_rows")


QUERIES = {f.__name__: f for f in (p2_found, p2_profile, p2_drift, p3_found, p3_sound, p3_report, p4_found, p4_schno_totals, p4_prodcd_totals, p5_found, p5_report, p6_found, p6_annual, p7_found, p7_report, p7_composite)}

_YMD = "regexp_full_match({c}, '[0-9]{{8}}') AND try_strptime({c}, '%Y%m%d') IS NOT NULL AND TRY_CAST(left({c}, 4) AS INT) BETWEEN {lo} AND {hi}"


def _sql_bad_date(c: str) -> str:
    return f"{c} IS NOT NULL AND NOT ({c} = '00000000' OR ({_YMD.format(c=c, lo=1900, hi=2099)}))"


def _sql_bad(pattern: str):
    return lambda c: f"{c} IS NOT NULL AND NOT regexp_full_match({c}, '{pattern}')"


_SQL_BAD = {
    "polno": _sql_bad("[0-9]{10}"), "prodcd": _sql_bad("[A-Z]{4}"), "commdt": _sql_bad_date, "exitdt": _sql_bad_date, "unpddt": _sql_bad_date, "birthdt": _sql_bad_date, "covstdt": _sql_bad_date,
    "statcd": _sql_bad("IF|PU|LA|CL"), "schno": _sql_bad("00000000|SCH[0-9]{8}"), "premamt": _sql_bad("[0-9]+[.][0-9]{2}"), "premfrq": _sql_bad("M|Q|H|A|SP"), "sumassd": _sql_bad("[0-9]+"),
    "nino": _sql_bad("[A-Z]{2}[0-9]{6}[A-D]"), "pcode": _sql_bad("[A-Z]{1,2}[0-9][0-9A-Z]? [0-9][A-Z]{2}"), "xa22": _sql_bad("C|U"), "loybonus": _sql_bad("[0-9]+[.][0-9]{2}"), "extpnpct": _sql_bad("[0-9]+[.][0-9]{2}"),
}
_SQL_NUMERIC = ("premamt", "sumassd", "loybonus", "extpnpct")


def _sql_profile(c: str) -> str:
    bad = _SQL_BAD.get(c, lambda _: "false")(c)
    x = f"CASE WHEN regexp_full_match({c}, '-?[0-9]{{1,12}}([.][0-9]{{1,4}})?') THEN CAST(round(CAST({c} AS DECIMAL(18, 4)) * 100) AS HUGEINT) END" if c in _SQL_NUMERIC else "CAST(NULL AS HUGEINT)"
    return f"""SELECT load_id, '{c}' AS colname, count(*) AS row_count, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS distinct_count,
 min({c}) AS min_value, max({c}) AS max_value, count(*) FILTER (WHERE {bad}) AS violation_count, count({x}) AS numeric_count,
 CAST(sum({x}) AS DOUBLE) AS power_sum_1, CAST(sum(({x}) * ({x})) AS DOUBLE) AS power_sum_2 FROM efas0042 GROUP BY load_id"""


def _sql_shift(c: str, states: list[str]) -> str:
    share = [f"avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) AS s0"] + [f"avg(CASE WHEN {c} = '{s}' THEN 1.0 ELSE 0.0 END) AS s{i + 1}" for i, s in enumerate(states)]
    moved = " OR ".join(f"abs(s{i} - lag(s{i}) OVER (ORDER BY load_id)) > 0.1" for i in range(len(states) + 1))
    return f"SELECT 'shift' AS kind, '{c}' AS colname, load_id, CAST(-1 AS BIGINT) AS row_id FROM (SELECT load_id, {moved} AS moved FROM (SELECT load_id, {', '.join(share)} FROM efas0042 WHERE load_id IS NOT NULL GROUP BY load_id)) WHERE moved"


_CLAIMS_SQL = """WITH r AS (SELECT rec_id, coalesce(raw, '') AS raw FROM claims99_raw WHERE rec_no IS NULL OR rec_no <> 0),
 q AS (SELECT *, regexp_full_match(raw, '(?s)([^",]*|"([^"]|"")*")(,([^",]*|"([^"]|"")*"))*') AS quoted FROM r),
 s AS (SELECT *, regexp_replace(raw, '(?s)"([^"]|"")*"', 'x', 'g') AS bare FROM q),
 n AS (SELECT *, length(bare) - length(replace(bare, ',', '')) + 1 AS cols FROM s),
 f AS (SELECT *, CASE WHEN quoted AND cols = 7 THEN regexp_extract(raw, '(?s)^([^",]*|"(?:[^"]|"")*"),([^",]*|"(?:[^"]|"")*"),([^",]*|"(?:[^"]|"")*"),([^",]*|"(?:[^"]|"")*"),([^",]*|"(?:[^"]|"")*"),([^",]*|"(?:[^"]|"")*"),([^",]*|"(?:[^"]|"")*")$', ['clm_ref', 'claim_type', 'amt_paid', 'settle_dt', 'assessor', 'unicode_col', 'notes']) END AS t FROM n),
 u AS (SELECT rec_id, quoted, cols, """ + ", ".join(f"nullif(CASE WHEN t.{c} LIKE '\"%' THEN replace(substr(t.{c}, 2, length(t.{c}) - 2), '\"\"', '\"') ELSE t.{c} END, '') AS {c}" for c in CLAIM_FIELDS) + """ FROM f),
 v AS (SELECT *, CASE WHEN NOT quoted THEN 'quoting' WHEN cols <> 7 THEN 'column_count' WHEN amt_paid IS NOT NULL AND NOT regexp_full_match(amt_paid, '-?[0-9]+([.][0-9]+)?') THEN 'bad_amount'
   WHEN settle_dt IS NOT NULL AND settle_dt <> '00000000' AND NOT (regexp_full_match(settle_dt, '[0-9]{8}') AND try_strptime(settle_dt, '%Y%m%d') IS NOT NULL) THEN 'bad_date' END AS reason FROM u)
"""

_NUMBER_SQL = "CASE WHEN regexp_full_match(trim({c}), '[+-]?([0-9]{{1,3}}(,[0-9]{{3}})+|[0-9]+)?([.][0-9]*)?') AND regexp_matches({c}, '[0-9]') THEN '#' || CAST(CAST(replace(replace(trim({c}), ',', ''), '+', '') AS DECIMAL(30, 8)) AS VARCHAR) ELSE '=' || {c} END"
_KEY_SQL = "lpad(ltrim(trim(polno), '0'), 10, '0')"
_P5_SQL = f"""WITH s AS (SELECT {_KEY_SQL} AS k, min({_NUMBER_SQL.format(c='premamt')}) AS p, min({_NUMBER_SQL.format(c='sumassd')}) AS a FROM efas0042 WHERE polno IS NOT NULL GROUP BY 1),
 c AS (SELECT {_KEY_SQL} AS k, min({_NUMBER_SQL.format(c='premamt')}) AS p, min({_NUMBER_SQL.format(c='sumassd')}) AS a FROM efas0042_copy WHERE polno IS NOT NULL GROUP BY 1),
 d AS (SELECT k AS polno, 'missing_in_copy' AS difference FROM s WHERE k NOT IN (SELECT k FROM c) UNION ALL SELECT k, 'missing_in_source' FROM c WHERE k NOT IN (SELECT k FROM s)
 UNION ALL SELECT s.k, 'premamt' FROM s JOIN c USING (k) WHERE s.p IS DISTINCT FROM c.p UNION ALL SELECT s.k, 'sumassd' FROM s JOIN c USING (k) WHERE s.a IS DISTINCT FROM c.a)
"""

_P7_SQL = """WITH r AS (SELECT load_id, row_id, loaded_at, upper(trim(schno)) AS ref FROM efas0042), o AS (
 SELECT r.*, CASE WHEN e.schref IS NULL THEN 'missing' WHEN e.arrived_at > loaded_at THEN 'late' WHEN e.deleted_at <= loaded_at THEN 'deleted' END AS reason
 FROM r LEFT JOIN esch0009 e ON r.ref = upper(trim(e.schref)) WHERE ref IS NOT NULL AND ref NOT IN ('', '00000000'))
"""


def _p7_composite_sql() -> str:
    """Each reference against the records that agree on its non-null columns."""
    late = "r.loaded_at IS NULL OR since IS NULL OR since <= r.loaded_at"
    sound = f"({late}) AND (r.loaded_at IS NULL OR until IS NULL OR until > r.loaded_at)"
    parts = []
    for mask, on in (("11", "t.ref = r.ref AND t.name = r.name"), ("10", "t.ref = r.ref"), ("01", "t.name = r.name")):
        has = f"(ref IS {'NOT ' if mask[0] == '1' else ''}NULL AND name IS {'NOT ' if mask[1] == '1' else ''}NULL)"
        parts.append(f"SELECT '{mask}' AS mask, r.load_id, r.row_id, count(t.ok) AS hits, bool_or(t.ok AND ({late})) AS begun, bool_or(t.ok AND {sound}) AS sound FROM (SELECT * FROM r WHERE {has}) r LEFT JOIN (SELECT *, true AS ok FROM t) t ON {on} GROUP BY r.load_id, r.row_id")
    reason = "CASE WHEN hits = 0 THEN 'missing' WHEN sound THEN NULL WHEN NOT begun THEN 'late' ELSE 'deleted' END"
    pick = lambda s, where, why=reason: f"SELECT '{s}' AS semantics, load_id, {why} AS reason FROM m WHERE {where}"
    every = [pick("simple", "mask = '11'"), pick("partial", "true"), pick("full", "mask = '11'"), pick("full", "mask <> '11'", "'partial'")]
    return f"""WITH r AS (SELECT load_id, row_id, loaded_at, CASE WHEN upper(trim(schno)) NOT IN ('', '00000000') THEN upper(trim(schno)) END AS ref, nullif(upper(trim(schnm)), '') AS name FROM efas0042),
 t AS (SELECT nullif(upper(trim(schref)), '') AS ref, nullif(upper(trim(schname)), '') AS name, arrived_at AS since, deleted_at AS until FROM esch0009), m AS ({' UNION ALL '.join(parts)}),
 o AS ({' UNION ALL '.join(every)}) SELECT semantics, load_id, reason, count(*) AS orphan_rows FROM o WHERE reason IS NOT NULL GROUP BY 1, 2, 3"""


def _sql_drift(c: str) -> str:
    x = f"CASE WHEN regexp_full_match({c}, '-?[0-9]{{1,12}}([.][0-9]{{1,4}})?') THEN CAST({c} AS DECIMAL(18, 4)) END" if c in _SQL_NUMERIC else "CAST(NULL AS DOUBLE)"
    return f"""SELECT load_id, '{c}' AS colname, 1.0 - count({c}) / count(*) AS nr, count(DISTINCT {c}) AS dc, avg({x}) AS mean, var_pop(CAST({x} AS DOUBLE)) AS v,
 avg(pow(CAST({x} AS DOUBLE) - m, 3)) AS m3 FROM (SELECT load_id, {c}, avg(CAST({x} AS DOUBLE)) OVER (PARTITION BY load_id) AS m FROM efas0042 WHERE load_id IS NOT NULL) GROUP BY load_id"""


def _p4_sql(c: str) -> str:
    return f"""WITH t AS (SELECT {c}, count(*) AS row_count, count(DISTINCT polno) AS policies, count(DISTINCT statcd) AS statuses, CAST(sum(TRY_CAST(sumassd AS BIGINT)) AS BIGINT) AS sum_assured,
  quantile_disc(TRY_CAST(sumassd AS BIGINT), 0.5) AS p50_sumassd, quantile_disc(TRY_CAST(sumassd AS BIGINT), 0.9) AS p90_sumassd FROM efas0042 GROUP BY {c}),
 m AS (SELECT {c}, statcd FROM (SELECT {c}, statcd, row_number() OVER (PARTITION BY {c} ORDER BY count(*) DESC, statcd) AS r FROM efas0042 WHERE statcd IS NOT NULL GROUP BY {c}, statcd) WHERE r = 1)
 SELECT t.*, m.statcd AS mode_statcd FROM t LEFT JOIN m ON t.{c} IS NOT DISTINCT FROM m.{c}"""


def _p6_sql(name: str, amount: str, freq: str, unit: int, codes: str) -> str:
    return f"""SELECT '{name}' AS extract_name, row_id, CAST(round(CASE WHEN x NOT BETWEEN 11988 AND 600600 AND u IS NULL AND x * 100 BETWEEN 11988 AND 600600 THEN x * 100 WHEN x NOT BETWEEN 11988 AND 600600 AND u IS NULL AND x / 100 BETWEEN 11988 AND 600600 THEN x / 100 ELSE x END) AS BIGINT) AS annual_pence,
 NOT plain OR u IS NOT NULL OR x NOT BETWEEN 11988 AND 600600 AS otherwise FROM (
 SELECT row_id, u, plain, CAST(n * coalesce(u, {unit}) * k AS DECIMAL(20, 4)) AS x FROM (SELECT row_id, coalesce(regexp_full_match({amount}, '[0-9]+([.][0-9]+)?') AND {freq} IN ({codes}), false) AS plain,
  TRY_CAST(replace(regexp_extract({amount}, '[0-9][0-9,]*([.][0-9]+)?'), ',', '') AS DECIMAL(16, 2)) AS n,
  CASE WHEN regexp_matches({amount}, '[0-9] ?(pence|p( |/|$))') THEN 1 WHEN regexp_matches({amount}, '[0-9][kK]') THEN 100000 WHEN regexp_matches({amount}, '£|GBP|stg|pounds|/-') THEN 100 END AS u,
  CASE WHEN regexp_matches({amount}, 'half') THEN 2 WHEN regexp_matches({amount}, 'quarter|/qtr') THEN 4 WHEN regexp_matches({amount}, 'month|/mth| pm| p[.]m[.]') THEN 12 WHEN regexp_matches({amount}, 'annum|year|/yr| pa| p[.]a[.]') THEN 1
   WHEN {freq} IN ('M', '12', 'MTHLY', 'Monthly', 'monthly', 'mth', 'pm') THEN 12 WHEN {freq} IN ('Q', '4', 'QTR', 'Quarterly', 'qtrly', '3-monthly') THEN 4 WHEN {freq} IN ('H', '2', 'HY', 'Half-yearly', '6-monthly') THEN 2 WHEN {freq} IN ('A', '1', 'ANN', 'Annual', 'Yearly', 'pa', 'yrly') THEN 1 END AS k
  FROM {name} WHERE {freq} IS DISTINCT FROM 'SP')) WHERE x > 0"""


_MQHA, _MQA = "'M', 'Q', 'H', 'A'", "'M', 'Q', 'A'"
_P6_SQL = f"WITH a AS ({_p6_sql('efas0042', 'premamt', 'premfrq', 100, _MQHA)} UNION ALL {_p6_sql('src', 'prem_pence', 'prem_freq', 1, _MQA)}) "

ORACLE_SQL = {
    "p2_found": " UNION ALL ".join([f"SELECT 'violation' AS kind, '{c}' AS colname, load_id, row_id FROM efas0042 WHERE {_SQL_BAD[c](c)}" for c in ("exitdt", "statcd", "unpddt")] + [_sql_shift("exitdt", ["00000000"]), _sql_shift("statcd", list(STATUSES)), _sql_shift("unpddt", ["00000000"])]),
    "p2_profile": " UNION ALL ".join(_sql_profile(r.name) for r in EFAS_RULES),
    "p2_drift": "WITH p AS (" + " UNION ALL ".join(_sql_drift(r.name) for r in EFAS_RULES) + """), b AS (SELECT *, lag(nr) OVER w AS nr0, lag(dc) OVER w AS dc0, lag(mean) OVER w AS mean0, lag(v) OVER w AS v0 FROM p WINDOW w AS (PARTITION BY colname ORDER BY load_id))
 SELECT load_id, colname, round(nr - nr0, 6) AS null_rate_change, dc - dc0 AS distinct_change, round(mean, 4) AS mean, CASE WHEN v > 0 THEN round(m3 / pow(v, 1.5), 3) END AS skewness,
  CASE WHEN v + v0 > 0 THEN round((mean - mean0) / sqrt((v + v0) / 2), 4) END AS standardised_difference FROM b""",
    "p3_report": _CLAIMS_SQL + "SELECT c.file_id, coalesce(reason, 'sound') AS reason, count(*) AS n FROM v JOIN claims99_raw c USING (rec_id) GROUP BY 1, 2",
    "p7_composite": _p7_composite_sql(),
    "p3_found": _CLAIMS_SQL + "SELECT rec_id, reason FROM v WHERE reason IS NOT NULL",
    "p3_sound": _CLAIMS_SQL + f"SELECT rec_id, {', '.join(CLAIM_FIELDS)} FROM v WHERE reason IS NULL",
    "p4_found": " UNION ALL ".join(f"SELECT '{c}' AS colname, {c} AS keyvalue FROM efas0042 WHERE {c} IS NOT NULL GROUP BY {c} HAVING count(*) >= 0.02 * (SELECT count(*) FROM efas0042)" for c in ("schno", "prodcd")),
    "p4_schno_totals": _p4_sql("schno"),
    "p4_prodcd_totals": _p4_sql("prodcd"),
    "p5_found": _P5_SQL + "SELECT polno, difference FROM d",
    "p5_report": _P5_SQL + "SELECT difference, count(*) AS n FROM d GROUP BY 1",
    "p6_annual": _P6_SQL + "SELECT extract_name, row_id, annual_pence FROM a",
    "p6_found": _P6_SQL + "SELECT extract_name, row_id, annual_pence FROM a WHERE otherwise",
    "p7_found": _P7_SQL + "SELECT load_id, row_id, reason FROM o WHERE reason IS NOT NULL",
    "p7_report": _P7_SQL + "SELECT load_id, reason, count(*) AS orphan_rows, count(DISTINCT ref) AS orphan_refs FROM o WHERE reason IS NOT NULL GROUP BY 1, 2",
}
