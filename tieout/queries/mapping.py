"""Queries of the mapping and assurance operators, over text views of the trading tables.

The views recreate what legacy extracts look like: padded keys, zero dates, columns filled for some
states only. The SQL beside each query is written on its own, not rendered from the same objects.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..legacy import graph
from ..operators import conformance as C
from ..operators import assure, match, profile, relate, rules
from ..plans import checks as K
from ..plans import transforms as X
from ..plans.lineage import shared_folder
from ..sources import csv
from ..sources.tables import table

ORDERS = ("POLNO", "CUSTNO", "STATCD", "COMMDT", "EXITDT", "EXITRSN", "PRIOCD", "AMTPENCE", "FILLER")


def legacy_orders(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    ymd = F.date_format("o_orderdate", "yyyyMMdd")
    final = F.col("o_orderstatus") == "F"
    prio = F.substring("o_orderpriority", 1, 1)
    return o.select(
        F.lpad(F.col("o_orderkey").cast("string"), 10, "0").alias("POLNO"), F.lpad(F.col("o_custkey").cast("string"), 8, "0").alias("CUSTNO"), F.col("o_orderstatus").alias("STATCD"), ymd.alias("COMMDT"),
        F.when(final, ymd).otherwise("00000000").alias("EXITDT"), F.when(final, prio).otherwise("").alias("EXITRSN"), prio.alias("PRIOCD"), F.round(F.col("o_totalprice") * 100).cast("bigint").cast("string").alias("AMTPENCE"), F.lit("").alias("FILLER"),
    )


def legacy_customer(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return c.select(F.concat(F.lpad(F.col("c_custkey").cast("string"), 8, "0"), F.lit("  ")).alias("CUSTREF"), F.col("c_name").alias("CUSTNAME"), F.col("c_mktsegment").alias("SEGCD"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0").alias("NATCD"))


_LO = """lo AS (SELECT lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS POLNO, lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS CUSTNO, o_orderstatus AS STATCD, strftime(o_orderdate, '%Y%m%d') AS COMMDT,
 CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%Y%m%d') ELSE '00000000' END AS EXITDT, CASE WHEN o_orderstatus = 'F' THEN substr(o_orderpriority, 1, 1) ELSE '' END AS EXITRSN,
 substr(o_orderpriority, 1, 1) AS PRIOCD, CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR) AS AMTPENCE, '' AS FILLER FROM orders)"""
_LC = "lc AS (SELECT lpad(CAST(c_custkey AS VARCHAR), 8, '0') || '  ' AS CUSTREF, c_name AS CUSTNAME, c_mktsegment AS SEGCD, lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS NATCD FROM customer)"
_W = f"WITH {_LO} "
_SENT = "('00000000', '99999999', '99991231', '0000-00-00', '9999-12-31', 'N/A', 'NA', 'NULL', 'NONE', 'UNKNOWN', '-', '.', '?')"
_POP = "({c} IS NOT NULL AND trim({c}) <> '' AND trim({c}) NOT IN " + _SENT + ")"

STATUS = X.EnumDecode("STATCD", (("F", "FINISHED"), ("O", "OPEN"), ("P", "PENDING")))
MAPPING: dict[str, X.Transform] = {
    "policy_reference": X.Copy("POLNO"), "customer_reference": X.TrimCopy("CUSTNO"), "policy_status": STATUS, "commencement_date": X.DateYmd("COMMDT"), "exit_date": X.DateYmd("EXITDT"),
    "exit_reason": X.Copy("EXITRSN"), "is_open": X.InListFlag("STATCD", ("O", "P")), "priority": X.Copy("PRIOCD"),
}
TARGET_SQL = """t AS (SELECT nullif(POLNO, '') AS policy_reference, nullif(trim(CUSTNO), '') AS customer_reference, CASE STATCD WHEN 'F' THEN 'FINISHED' WHEN 'O' THEN 'OPEN' WHEN 'P' THEN 'PENDING' END AS policy_status,
 CAST(try_strptime(COMMDT, '%Y%m%d') AS DATE) AS commencement_date, CAST(try_strptime(EXITDT, '%Y%m%d') AS DATE) AS exit_date, nullif(EXITRSN, '') AS exit_reason, STATCD IN ('O', 'P') AS is_open, nullif(PRIOCD, '') AS priority FROM lo)"""


def target(spark: SparkSession, d: str) -> DataFrame:
    return X.project(legacy_orders(spark, d), MAPPING)


def _date_text(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd").alias(c)


def _target_text(df: DataFrame) -> DataFrame:
    return df.select(*[_date_text(c) if k == "date" else F.col(c) for c, k in df.dtypes])


Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(_W + "SELECT POLNO, STATCD, COMMDT, EXITDT, nullif(EXITRSN, '') AS EXITRSN FROM lo")
def stage_text(spark, d):
    """The orders as a delivered file holds them: written as text files and staged from there."""
    path = f"{shared_folder(spark).rstrip('/')}/delivered-{uuid.uuid4().hex}"
    csv.deliver(legacy_orders(spark, d), path)
    return csv.stage_text(spark, path).select("POLNO", "STATCD", "COMMDT", "EXITDT", "EXITRSN")


@query(_W + f", {TARGET_SQL} SELECT policy_reference, customer_reference, policy_status, strftime(commencement_date, '%Y-%m-%d') AS commencement_date, strftime(exit_date, '%Y-%m-%d') AS exit_date, exit_reason, is_open, priority, 'ORDERS' AS source_system, CAST(NULL AS VARCHAR) AS investor_id FROM t")
def transform_select(spark, d):
    return _target_text(X.project(legacy_orders(spark, d), MAPPING, {"source_system": "ORDERS", "investor_id": None}))


@query(_W + "SELECT POLNO, CASE STATCD WHEN 'F' THEN 'FINISHED' WHEN 'O' THEN 'OPEN' WHEN 'P' THEN 'PENDING' END AS policy_status FROM lo")
def enum_decode(spark, d):
    return legacy_orders(spark, d).select("POLNO", STATUS.column_of().alias("policy_status"))


@query(_W + "SELECT POLNO, strftime(try_strptime(nullif(EXITDT, '00000000'), '%Y%m%d'), '%Y-%m-%d') AS exit_date FROM lo")
def date_parse(spark, d):
    return _target_text(legacy_orders(spark, d).select("POLNO", X.DateYmd("EXITDT").column_of().alias("exit_date")))


@query(_W + "SELECT POLNO, CAST(AMTPENCE AS DOUBLE) AS amount_pence FROM lo")
def numeric_cast(spark, d):
    return legacy_orders(spark, d).select("POLNO", X.Numeric("AMTPENCE").column_of().alias("amount_pence"))


@query(f"WITH {_LC} SELECT nullif(trim(CUSTREF), '') AS customer_reference, CUSTNAME AS customer_name FROM lc")
def trim_copy(spark, d):
    return legacy_customer(spark, d).select(X.TrimCopy("CUSTREF").column_of().alias("customer_reference"), F.col("CUSTNAME").alias("customer_name"))


@query(_W + "SELECT POLNO, CAST(AMTPENCE AS DOUBLE) * CASE PRIOCD WHEN '1' THEN 12 WHEN '2' THEN 4 WHEN '3' THEN 2 WHEN '4' THEN 1 ELSE 0 END AS annual_pence FROM lo")
def annualise(spark, d):
    return legacy_orders(spark, d).select("POLNO", X.Annualise("AMTPENCE", "PRIOCD", (("1", 12), ("2", 4), ("3", 2), ("4", 1))).column_of().alias("annual_pence"))


@query(_W + "SELECT POLNO, coalesce(STATCD IN ('O', 'P'), false) AS is_group FROM lo")
def group_flag(spark, d):
    return legacy_orders(spark, d).select("POLNO", X.InListFlag("STATCD", ("O", "P")).column_of().alias("is_group"))


_PARTS = "CAST(substr(COMMDT, 1, 4) AS INT) AS y, CASE WHEN PRIOCD = '5' THEN 13 WHEN PRIOCD = '4' THEN 0 ELSE CAST(substr(COMMDT, 5, 2) AS INT) END AS m, CASE WHEN PRIOCD = '3' THEN NULL ELSE CAST(substr(COMMDT, 7, 2) AS INT) END AS dd"


@query(_W + f", p AS (SELECT POLNO, {_PARTS} FROM lo), f AS (SELECT POLNO, y, CASE WHEN m = 0 THEN 1 ELSE m END AS m, coalesce(nullif(dd, 0), 1) AS dd FROM p) SELECT POLNO, strftime(try_strptime(lpad(CAST(y AS VARCHAR), 4, '0') || lpad(CAST(m AS VARCHAR), 2, '0') || lpad(CAST(dd AS VARCHAR), 2, '0'), '%Y%m%d'), '%Y-%m-%d') AS joined_date FROM f")
def split_date(spark, d):
    p = F.col("PRIOCD")
    parts = legacy_orders(spark, d).select("POLNO", F.substring("COMMDT", 1, 4).alias("Y"), F.when(p == "5", "13").when(p == "4", "0").otherwise(F.substring("COMMDT", 5, 2)).alias("M"), F.when(p != "3", F.substring("COMMDT", 7, 2)).alias("D"))
    return _target_text(parts.select("POLNO", X.SplitDate("Y", "M", "D").column_of().alias("joined_date")))


@query(_W + "SELECT POLNO, 'ORDERS' AS source_system, 'false' AS vulnerable, '0' AS loyalty_bonus, 'UNKNOWN' AS region, CAST(NULL AS VARCHAR) AS gone_away FROM lo")
def system_defaults(spark, d):
    want = [match.Target("source_system", nullable=False), match.Target("vulnerable", "boolean", nullable=False), match.Target("loyalty_bonus", "decimal", nullable=False), match.Target("region", nullable=False), match.Target("gone_away")]
    return legacy_orders(spark, d).select("POLNO", *[F.lit(assure.default_value(t, "ORDERS")).cast("string").alias(t.name) for t in want])


@query(_W + "SELECT POLNO, STATCD, CAST(row_number() OVER (PARTITION BY STATCD ORDER BY COMMDT, POLNO) AS INT) AS seq, regexp_replace(CUSTNO, '^0+', '') AS short_ref FROM lo")
def expr_passthrough(spark, d):
    return legacy_orders(spark, d).select("POLNO", "STATCD", F.expr("row_number() OVER (PARTITION BY STATCD ORDER BY COMMDT, POLNO)").alias("seq"), F.expr("regexp_replace(CUSTNO, '^0+', '')").alias("short_ref"))


@query(_W + " SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS colname, value, CAST(row_number() OVER (ORDER BY value) AS INT) AS rank FROM (SELECT DISTINCT {c} AS value FROM lo WHERE trim({c}) <> '')" for c in ("STATCD", "COMMDT", "PRIOCD")) + ") WHERE rank <= 4")
def distinct_samples(spark, d):
    return profile.distinct_samples(legacy_orders(spark, d), ["STATCD", "COMMDT", "PRIOCD"], 4)


@query(_W + "SELECT POLNO, CUSTNO FROM lo WHERE contains(lower(concat_ws('\n', POLNO, CUSTNO, STATCD, COMMDT, EXITDT, EXITRSN, PRIOCD, AMTPENCE)), '1234')")
def grid_search(spark, d):
    o = legacy_orders(spark, d)
    return o.where(T.any_of([F.contains(F.lower(c), F.lit("1234")) for c in ORDERS])).select("POLNO", "CUSTNO")


_COVER = {"policy_reference": "POLNO", "policy_status": "STATCD", "exit_date": "EXITDT", "exit_reason": "EXITRSN"}


@query(_W + f", {TARGET_SQL}, j AS (SELECT lo.*, t.* FROM lo JOIN t ON lo.POLNO = t.policy_reference) " + " UNION ALL ".join(f"SELECT '{t}' AS target, count(*) FILTER (WHERE {s} NOT IN ('00000000', '') AND {t} IS NOT NULL) AS num, count(*) FILTER (WHERE {s} NOT IN ('00000000', '')) AS denom FROM j" for t, s in _COVER.items()))
def coverage(spark, d):
    return match.coverage_counts(legacy_orders(spark, d), [_mapping(t) for t in _COVER])


def _per_column(select: str) -> str:
    return " UNION ALL ".join(select.format(c=c, pop=_POP.format(c=c)) for c in ORDERS)


_PROFILE = "SELECT '{c}' AS colname, count(*) AS row_count, count(*) FILTER (WHERE {pop}) AS populated_count, count(DISTINCT CASE WHEN {pop} THEN trim({c}) END) AS distinct_count FROM lo"


@query(_W + f"SELECT colname, row_count, populated_count, distinct_count, round(distinct_count / greatest(populated_count, 1), 3) AS distinct_ratio FROM ({_per_column(_PROFILE)})")
def profile_columns(spark, d):
    return profile.profile(legacy_orders(spark, d)).select("colname", "row_count", "populated_count", "distinct_count", "distinct_ratio")


_ALL = "coalesce(bool_and(CASE WHEN {pop} THEN {t} END), false)"
_TYPES = "SELECT '{c}' AS colname, count(DISTINCT CASE WHEN {pop} THEN {c} END) AS dc, count(*) FILTER (WHERE {pop}) AS pc, count(*) AS n, min(CASE WHEN {pop} THEN {c} END) AS lo_, max(length(CASE WHEN {pop} THEN {c} END)) AS ln, coalesce(bool_and(CASE WHEN {pop} THEN regexp_full_match({c}, '(19|20)[0-9][0-9](0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])') END), false) AS isd, coalesce(bool_and(CASE WHEN {pop} THEN regexp_full_match({c}, '-?[0-9]+[.][0-9]+') END), false) AS isn, coalesce(bool_and(CASE WHEN {pop} THEN regexp_full_match({c}, '[0-9]+') END), false) AS isi, coalesce(bool_and(CASE WHEN {pop} THEN regexp_full_match({c}, '[A-Za-z0-9_/-]+') END), false) AS isc FROM lo"


@query(_W + f"SELECT colname, CASE WHEN dc = 0 THEN 'EMPTY' WHEN isd THEN 'DATE_YYYYMMDD' WHEN isn THEN 'DECIMAL' WHEN isi AND pc = n AND dc >= 0.99 * pc AND length(lo_) >= 6 THEN 'IDENTIFIER' WHEN isi THEN 'INTEGER' WHEN dc <= 15 AND ln <= 8 AND isc THEN 'CATEGORICAL_CODE' ELSE 'FREE_TEXT' END AS inferred_type FROM ({_per_column(_TYPES)})")
def infer_types(spark, d):
    return profile.profile(legacy_orders(spark, d)).select("colname", "inferred_type")


@query(_W + "SELECT colname, value, n, rank FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS colname, {c} AS value, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, {c}) AS INT) AS rank FROM lo WHERE {_POP.format(c=c)} GROUP BY {c}" for c in ("STATCD", "EXITRSN", "PRIOCD", "COMMDT")) + ") WHERE rank <= 15")
def top_values(spark, d):
    return profile.top_values(legacy_orders(spark, d), ["STATCD", "EXITRSN", "PRIOCD", "COMMDT"])


_SMALL = ("STATCD", "EXITDT", "EXITRSN", "PRIOCD", "FILLER")


def _dependency_sql() -> str:
    parts = []
    for b in ("EXITDT", "EXITRSN"):
        for a in _SMALL:
            if a != b and a != "FILLER":
                pb, pa = _POP.format(c=b), _POP.format(c=a)
                parts.append(f"SELECT '{b}' AS dependent, '{a}' AS driver, (SELECT string_agg(DISTINCT {a}, ', ' ORDER BY {a}) FROM lo WHERE {pb}) AS driver_values, (SELECT count(*) FROM lo WHERE {pb}) AS support, (SELECT count(*) FROM lo WHERE {pb} AND NOT {pa}) AS holes, (SELECT count(DISTINCT {a}) FROM lo WHERE {pb}) AS nv, (SELECT count(DISTINCT {a}) FROM lo WHERE {pa}) AS card, (SELECT avg(CASE WHEN {pb} THEN 1.0 ELSE 0.0 END) FROM lo WHERE {a} IN (SELECT {a} FROM lo WHERE {pb})) AS cov")
    return _W + f", c AS ({' UNION ALL '.join(parts)}), r AS (SELECT *, row_number() OVER (PARTITION BY dependent ORDER BY nv, -cov, driver) AS k FROM c WHERE holes = 0 AND nv <= 3 AND nv < card) SELECT dependent, driver, driver_values, support, round(cov, 3) AS confidence FROM r WHERE k = 1"


@query(_dependency_sql())
def dependency_mining(spark, d):
    return profile.dependencies(legacy_orders(spark, d).select(*_SMALL))


@query(_W + f"SELECT 'EXITDT' AS col_a, 'EXITRSN' AS col_b FROM lo HAVING count(*) FILTER (WHERE {_POP.format(c='EXITDT')} <> {_POP.format(c='EXITRSN')}) = 0")
def copopulation_groups(spark, d):
    return profile.copopulated(legacy_orders(spark, d))


@query(_W + "SELECT colname, round(pc / n, 3) AS completeness, CASE WHEN pc = 0 THEN 1.0 ELSE round(ok / pc, 3) END AS validity, padded > 0 AS whitespace, CASE WHEN pc > 0 AND round(ok / pc, 3) < 0.9 THEN 'major' WHEN pc = 0 OR ok < pc OR padded > 0 THEN 'minor' ELSE 'ok' END AS severity FROM ("
       + " UNION ALL ".join(f"SELECT '{c}' AS colname, count(*) AS n, count(*) FILTER (WHERE {_POP.format(c=c)}) AS pc, count(*) FILTER (WHERE {_POP.format(c=c)} AND {('regexp_full_match(' + c + ', ' + chr(39) + p + chr(39) + ')') if p else 'true'}) AS ok, count(*) FILTER (WHERE {c} <> trim({c})) AS padded FROM lo" for c, p in (("POLNO", "[0-9]+"), ("STATCD", ""), ("COMMDT", "(19|20)[0-9]{2}(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])"), ("EXITDT", "(19|20)[0-9]{2}(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])"), ("AMTPENCE", "-?[0-9]+[.][0-9]+"), ("FILLER", ""))) + ")")
def dq_findings(spark, d):
    cols = ["POLNO", "STATCD", "COMMDT", "EXITDT", "AMTPENCE", "FILLER"]
    return profile.findings(legacy_orders(spark, d), cols, {"AMTPENCE": "DECIMAL"})


_RULE = "SELECT '{rule}' AS rule, '{cat}' AS category, '{sev}' AS severity, count(*) FILTER (WHERE {applies}) AS total, count(*) FILTER (WHERE ({applies}) AND ({bad})) AS failed FROM lo{having}"


def _rules_sql() -> str:
    day = lambda c: "try_strptime(trim(" + c + "), '%Y%m%d') IS NULL"
    pop = lambda c: _POP.format(c=c)
    parts = [_RULE.format(rule=f"date_valid:{c}", cat="validity", sev="major", applies=pop(c), bad=day(c), having="") for c in ("COMMDT", "EXITDT")]
    parts.append(_RULE.format(rule="date_order:COMMDT<=EXITDT", cat="consistency", sev="minor", applies=f"{pop('COMMDT')} AND {pop('EXITDT')}", bad="COMMDT > EXITDT", having=""))
    parts += [_RULE.format(rule=f"conditional:{c}", cat="completeness", sev="minor", applies="trim(STATCD) IN ('F')", bad=f"NOT {pop(c)}", having="") for c in ("EXITDT", "EXITRSN")]
    # a key where every row has a value of its own; then none repeats
    parts += [_RULE.format(rule=f"key_unique:{c}", cat="uniqueness", sev="major", applies=pop(c), bad="false", having=f" HAVING count(*) = count(DISTINCT CASE WHEN {pop(c)} THEN trim({c}) END) AND count(*) > 0") for c in ORDERS]
    return _W + f", r AS ({' UNION ALL '.join(parts)}) SELECT rule, category, CASE WHEN failed > 0 THEN severity ELSE 'info' END AS severity, total, failed, CASE WHEN total > 0 THEN round(1 - failed / total, 4) ELSE 1.0 END AS pass_rate FROM r"


@query(_rules_sql())
def dq_rules(spark, d):
    """All rules the orders imply, mined and run; none is written by hand."""
    o = legacy_orders(spark, d)
    return rules.run(o, rules.mine(o))


@query(f"""WITH x AS (SELECT strftime(l_shipdate, '%Y%m%d') AS s, strftime(o_orderdate, '%Y%m%d') AS o FROM lineitem JOIN orders ON l_orderkey = o_orderkey), c AS (SELECT count(*) AS n, count(*) FILTER (WHERE o <= s) AS le, count(*) FILTER (WHERE o > s) AS gt, count(*) FILTER (WHERE s > o) AS lt FROM x)
 SELECT CASE WHEN le >= n - le THEN 'O' ELSE 'S' END AS lo, CASE WHEN le >= n - le THEN 'S' ELSE 'O' END AS hi, n, round(greatest(le, n - le) / n, 3) AS ratio, CASE WHEN le >= n - le THEN gt ELSE lt END AS violations FROM c WHERE n >= 10 AND greatest(le, n - le) / n >= 0.9
 UNION ALL SELECT 'O', 'T', count(*), 1.0, 0 FROM x UNION ALL SELECT CASE WHEN count(*) FILTER (WHERE s <= o) >= count(*) FILTER (WHERE s > o) THEN 'S' ELSE 'T' END, CASE WHEN count(*) FILTER (WHERE s <= o) >= count(*) FILTER (WHERE s > o) THEN 'T' ELSE 'S' END, count(*), round(greatest(count(*) FILTER (WHERE s <= o), count(*) FILTER (WHERE s > o)) / count(*), 3), CASE WHEN count(*) FILTER (WHERE s <= o) >= count(*) FILTER (WHERE s > o) THEN count(*) FILTER (WHERE s > o) ELSE count(*) FILTER (WHERE o > s) END FROM x HAVING greatest(count(*) FILTER (WHERE s <= o), count(*) FILTER (WHERE s > o)) / count(*) >= 0.9""")
def date_order(spark, d):
    li, o = table(spark, d, "lineitem").select("l_orderkey", "l_shipdate"), table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    x = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.date_format("o_orderdate", "yyyyMMdd").alias("O"), F.date_format("l_shipdate", "yyyyMMdd").alias("S"), F.date_format("o_orderdate", "yyyyMMdd").alias("T"))
    return profile.date_orders(x, ["O", "S", "T"])


@query("SELECT * FROM (VALUES ('NINO', 'National Insurance Number', 'tokenize'), ('PCODE', 'Postcode', 'mask'), ('EMAIL', 'Email', 'mask'), ('SORTCD', 'Bank Sort Code', 'tokenize')) v(colname, category, action)")
def pii_scan(spark, d):
    c = table(spark, d, "customer")
    k = F.lpad(F.col("c_custkey").cast("string"), 6, "0")
    x = c.select(F.concat(F.lit("AB"), k, F.lit("C")).alias("NINO"), F.concat(F.lit("AB1 "), F.substring(k, 6, 1), F.lit("CD")).alias("PCODE"), F.concat(F.lit("u"), k, F.lit("@example.test")).alias("EMAIL"), F.concat_ws("-", F.substring(k, 1, 2), F.substring(k, 3, 2), F.substring(k, 5, 2)).alias("SORTCD"), F.col("c_name").alias("CUSTNAME"))
    return profile.personal_data(x)


@query("SELECT l_orderkey AS key, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def key_unique(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query(f"WITH {_LO}, {_LC} SELECT count(*) AS shared FROM (SELECT DISTINCT trim(CUSTNO) AS v FROM lo INTERSECT SELECT DISTINCT trim(CUSTREF) FROM lc)")
def value_overlap(spark, d):
    vals = relate.values({"lo": legacy_orders(spark, d), "lc": legacy_customer(spark, d)}, {"lo": ["CUSTNO"], "lc": ["CUSTREF"]})
    return relate.overlaps(vals).select("shared")


_JOIN_SQL = f"""WITH {_LO}, {_LC}, a AS (SELECT DISTINCT trim(CUSTNO) AS v FROM lo), b AS (SELECT DISTINCT trim(CUSTREF) AS v FROM lc), s AS (SELECT count(*) AS k FROM a JOIN b USING (v)), n AS (SELECT (SELECT count(*) FROM a) AS da, (SELECT count(*) FROM b) AS db, (SELECT count(*) FROM lo) AS na, (SELECT count(*) FROM lc) AS nb)
 SELECT 'lc' AS left_table, 'CUSTREF' AS left_column, 'lo' AS right_table, 'CUSTNO' AS right_column, k AS shared, round(k / db, 3) AS containment_left, round(k / da, 3) AS containment_right, CASE WHEN da / na >= 0.99 THEN '1:1' ELSE '1:N' END AS cardinality, 'join_key' AS kind, round(greatest(k / da, k / db) * CASE WHEN da / na >= 0.99 THEN 1.0 ELSE 0.75 END, 3) AS confidence FROM s, n"""


@query(_JOIN_SQL)
def join_discovery(spark, d):
    found = relate.discover({"lo": legacy_orders(spark, d), "lc": legacy_customer(spark, d)})
    return spark.createDataFrame([tuple(e.__dict__.values()) for e in found], "left_table string, left_column string, right_table string, right_column string, shared bigint, containment_left double, containment_right double, cardinality string, kind string, confidence double")


@query("SELECT 'lo' AS primary_table")
def choose_primary(spark, d):
    tabs = {"lc": legacy_customer(spark, d), "lo": legacy_orders(spark, d)}
    found = relate.discover(tabs, {"lo": ["POLNO", "CUSTNO"], "lc": ["CUSTREF"]})
    return spark.createDataFrame([(relate.primary({t: x.count() for t, x in tabs.items()}, found),)], "primary_table string")


@query(f"WITH {_LO}, {_LC} SELECT lo.POLNO, lo.STATCD AS STATCD, lc.CUSTNAME, lc.SEGCD, lc.NATCD AS lc_STATCD FROM lo LEFT JOIN lc ON trim(lo.CUSTNO) = trim(lc.CUSTREF)")
def workset_join(spark, d):
    tabs = {"lo": legacy_orders(spark, d), "lc": legacy_customer(spark, d).withColumnRenamed("NATCD", "STATCD")}
    return relate.workset(tabs, "lo", [relate.Step("lo", "CUSTNO", "lc", "CUSTREF")]).select("POLNO", "STATCD", "CUSTNAME", "SEGCD", "lc_STATCD")


def _mapping(target_name: str, transform: X.Transform | None = None) -> match.Mapping:
    t = transform or MAPPING[target_name]
    return match.Mapping(target_name, t.sources(), t, 1.0, 1.0, 1.0, "auto_accept")


_TYPES_OF = {"commencement_date": "date", "exit_date": "date", "is_open": "boolean", "amount_pence": "decimal", "priority_number": "integer"}
_NUMBERS = {"amount_pence": X.Numeric("AMTPENCE"), "priority_number": X.Numeric("PRIOCD")}


def _maps() -> list[match.Mapping]:
    return [_mapping(t) for t in MAPPING] + [_mapping(t, x) for t, x in _NUMBERS.items()]


def _targets() -> list[match.Target]:
    return [match.Target(m.target, _TYPES_OF.get(m.target, "string"), nullable=m.target not in ("policy_reference", "policy_status")) for m in _maps()]


def _delivered(spark: SparkSession, d: str) -> DataFrame:
    """A delivery with one policy in 89 lost, another doubled, and one amount in 97 zeroed."""
    t = X.as_delivered(X.project(legacy_orders(spark, d), {m.target: m.transform for m in _maps()}))
    n = F.col("policy_reference").cast("bigint")
    t = t.where(n % 89 != 0).withColumn("amount_pence", F.when(n % 97 == 0, "0").otherwise(F.col("amount_pence")))
    return t.unionByName(t.where(n % 89 == 1))


def _results(spark: SparkSession, found: list[K.Result]) -> DataFrame:
    """As many rows as there were checks."""
    return spark.createDataFrame([(r.name, r.status, int(r.total), int(r.offending)) for r in found], "name string, status string, total bigint, offending bigint")


def _reconciled(spark: SparkSession, d: str, *todo: assure.Rule) -> DataFrame:
    return _results(spark, assure.reconcile(list(todo), legacy_orders(spark, d), _delivered(spark, d), _maps(), _targets())[1])


_KEPT = "CAST(POLNO AS BIGINT) % 89 <> 0"
_DELIVERED = f"dv AS (SELECT * FROM lo WHERE {_KEPT} UNION ALL SELECT * FROM lo WHERE CAST(POLNO AS BIGINT) % 89 = 1)"
_STATUS = "CASE WHEN offending > 0 THEN 'fail' ELSE 'pass' END AS status"


@query(_W + f", {_DELIVERED}, n AS (SELECT (SELECT count(*) FROM lo) AS a, (SELECT count(*) FROM dv) AS b) SELECT name, {_STATUS}, total, offending FROM (SELECT 'control_total:rows' AS name, a AS total, abs(a - b) AS offending FROM n)")
def grain_check(spark, d):
    return _reconciled(spark, d, assure.Rule("control_total:rows"))


@query("SELECT 'control_total:columns' AS name, 'fail' AS status, 12 AS total, 2 AS offending")
def wellformed_columns(spark, d):
    return _reconciled(spark, d, assure.Rule("control_total:columns", {"expected_columns": [*MAPPING, *_NUMBERS, "gone_away", "investor_id"]}))


@query(_W + f", {_DELIVERED}, t AS (SELECT nullif(CUSTNO, '') AS k FROM dv) SELECT count(*) FILTER (WHERE k IS NULL) AS nulls, count(DISTINCT k) AS distinct_keys, count(*) AS row_count, CASE WHEN count(*) FILTER (WHERE k IS NULL) = 0 AND count(DISTINCT k) = count(*) THEN 'pass' ELSE 'fail' END AS status FROM t")
def key_integrity(spark, d):
    return assure.key_counts(_delivered(spark, d), "customer_reference")


_REQUIRED = ("policy_reference", "policy_status", "exit_date", "exit_reason")


@query(_W + f", {TARGET_SQL} " + " UNION ALL ".join(f"SELECT '{a}' AS attribute, count(*) AS total, count(*) FILTER (WHERE {a} IS NULL) AS violations FROM t" for a in _REQUIRED))
def completeness(spark, d):
    checks = [K.Check(f"required_present:{a}", "completeness", K.HARD, a, "true", f"`{a}` IS NULL") for a in _REQUIRED]
    return K.fuse(target(spark, d), checks).select("attribute", "total", "violations")


@query(_W + f", {TARGET_SQL} SELECT 'policy_status' AS attribute, count(*) FILTER (WHERE policy_status IS NOT NULL AND policy_status <> '') AS total, count(*) FILTER (WHERE policy_status NOT IN ('FINISHED', 'OPEN') AND policy_status <> '') AS violations FROM t UNION ALL SELECT 'exit_reason', count(exit_reason), count(*) FILTER (WHERE exit_reason NOT IN ('1', '2', '3')) FROM t")
def domain_check(spark, d):
    checks = [K.Check(f"domain:{a}", "domain", K.SOFT, a, f"{a} IS NOT NULL AND {a} <> ''", f"{a} NOT IN ({', '.join(map(X.literal, v))})") for a, v in (("policy_status", ("FINISHED", "OPEN")), ("exit_reason", ("1", "2", "3")))]
    return K.fuse(target(spark, d), checks).select("attribute", "total", "violations")


@query(_W + f", {TARGET_SQL} SELECT exit_reason AS value, count(*) AS n FROM t WHERE exit_reason NOT IN ('1', '2', '3') GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
def domain_offenders(spark, d):
    return target(spark, d).where("exit_reason NOT IN ('1', '2', '3')").groupBy(F.col("exit_reason").alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "value").limit(10)


@query(_W + "SELECT 'COMMDT' AS attribute, count(*) AS total, count(*) FILTER (WHERE true) AS violations FROM lo UNION ALL SELECT 'AMTPENCE', count(*), count(*) FILTER (WHERE NOT regexp_full_match(AMTPENCE, '[+-]?[0-9]+')) FROM lo UNION ALL SELECT 'PRIOCD', count(*), count(*) FILTER (WHERE NOT regexp_full_match(PRIOCD, '[+-]?[0-9]+')) FROM lo UNION ALL SELECT 'STATCD', count(*), count(*) FILTER (WHERE NOT regexp_full_match(STATCD, '[+-]?[0-9.]+')) FROM lo")
def type_check(spark, d):
    want = {"COMMDT": "date", "AMTPENCE": "integer", "PRIOCD": "integer", "STATCD": "decimal"}
    checks = [K.Check(f"data_type:{a}", "type", K.HARD, a, f"{a} IS NOT NULL AND {a} <> ''", assure.unparseable(X.quoted(a), assure.CASTS[k])) for a, k in want.items()]
    return K.fuse(legacy_orders(spark, d), checks).select("attribute", "total", "violations")


@query("SELECT count(*) AS duplicate_groups FROM (SELECT l_orderkey, l_returnflag, l_linestatus FROM lineitem GROUP BY ALL HAVING count(*) > 1)")
def duplicate_rows(spark, d):
    return C.duplicate_groups(table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus")).agg(F.count(F.lit(1)).alias("duplicate_groups"))


_TAMPER = "CASE WHEN CAST(policy_reference AS BIGINT) % 97 = 0 THEN 'OPEN' ELSE policy_status END"


def _tampered(spark: SparkSession, d: str) -> DataFrame:
    """A delivered copy with one status in 97 changed and exit dates of another class lost."""
    t = _target_text(target(spark, d))
    n = F.col("policy_reference").cast("bigint")
    return t.withColumn("policy_status", F.when(n % 97 == 0, "OPEN").otherwise(F.col("policy_status"))).withColumn("exit_date", F.when(n % 101 != 0, F.col("exit_date")))


_D_SQL = f"""{TARGET_SQL}, e AS (SELECT policy_reference, policy_status, strftime(exit_date, '%Y-%m-%d') AS exit_date, exit_reason FROM t),
 dl AS (SELECT policy_reference, {_TAMPER} AS policy_status, CASE WHEN CAST(policy_reference AS BIGINT) % 101 <> 0 THEN strftime(exit_date, '%Y-%m-%d') END AS exit_date, exit_reason FROM t)"""
_COMPARED = ["policy_status", "exit_date", "exit_reason"]


def _aligned(spark: SparkSession, d: str) -> DataFrame:
    return C.align(_target_text(target(spark, d)), _tampered(spark, d), "policy_reference", _COMPARED)


@query(_W + f", {_D_SQL} SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS attribute, e.policy_reference AS k, e.{a} AS expected, dl.{a} AS delivered, CAST(row_number() OVER (ORDER BY e.policy_reference) AS INT) AS rank FROM e JOIN dl USING (policy_reference) WHERE e.{a} IS DISTINCT FROM dl.{a}" for a in _COMPARED) + ") WHERE rank <= 10")
def offender_rows(spark, d):
    return C.offenders(_aligned(spark, d), _COMPARED)


@query(_W + f", {_D_SQL} " + " UNION ALL ".join(f"SELECT '{a}' AS attribute, count(*) AS compared, count(*) FILTER (WHERE e.{a} IS DISTINCT FROM dl.{a}) AS mismatches FROM e FULL JOIN dl USING (policy_reference)" for a in _COMPARED))
def transform_conformance(spark, d):
    return C.mismatches(_aligned(spark, d), _COMPARED)


@query(_W + " UNION ALL ".join(f"SELECT 'reconciliation:{t}' AS name, CASE WHEN count(*) FILTER (WHERE {lost}) > 0 THEN 'warn' ELSE 'pass' END AS status, count(*) FILTER (WHERE {s} NOT IN ('00000000', '')) AS total, count(*) FILTER (WHERE {s} NOT IN ('00000000', '') AND {lost}) AS offending FROM lo" for t, s, lost in (("policy_reference", "POLNO", "false"), ("policy_status", "STATCD", "STATCD NOT IN ('F', 'O')"), ("exit_date", "EXITDT", "try_strptime(EXITDT, '%Y%m%d') IS NULL AND EXITDT <> '00000000'"))))
def value_loss(spark, d):
    """Source values that a mapping without a code for one status turns into nulls, as the mapping's report finds them."""
    partial = X.EnumDecode("STATCD", (("F", "FINISHED"), ("O", "OPEN")))
    maps = [_mapping("policy_reference"), _mapping("policy_status", partial), _mapping("exit_date")]
    found = assure.mapping_report(maps, [t for t in _targets() if t.name in {m.target for m in maps}], legacy_orders(spark, d), "POLNO")[1]
    return _results(spark, [r for r in found if r.category == "reconciliation"])


_ZEROED = "CASE WHEN CAST(POLNO AS BIGINT) % 97 = 0 THEN 0 ELSE CAST(AMTPENCE AS DOUBLE) END"


@query(_W + f", {_DELIVERED}, s AS (SELECT sum(CAST(AMTPENCE AS DOUBLE)) AS a, sum(CAST(PRIOCD AS DOUBLE)) AS p FROM lo), v AS (SELECT sum({_ZEROED}) AS a, sum(CAST(PRIOCD AS DOUBLE)) AS p FROM dv), o AS (SELECT CAST(abs(s.a - v.a) > 1e-6 * s.a AS BIGINT) + CAST(abs(s.p - v.p) > 1e-6 * greatest(s.p, v.p) AS BIGINT) AS offending FROM s, v) SELECT 'control_total:numeric_sums' AS name, {_STATUS}, 2 AS total, offending FROM o")
def numeric_sums(spark, d):
    return _reconciled(spark, d, assure.Rule("control_total:numeric_sums", {"columns": list(_NUMBERS)}))


@query(_W + f", {TARGET_SQL} " + " UNION ALL ".join(f"SELECT '{a}' AS attribute, count({a}) AS populated, count(*) - count({a}) AS blank, {'true' if a in ('policy_reference', 'policy_status') else 'false'} AS mandatory FROM t" for a in ("policy_reference", "policy_status", "exit_reason", "exit_date")))
def populated_cells(spark, d):
    return C.fill_rates(_target_text(target(spark, d)), ["policy_reference", "policy_status", "exit_reason", "exit_date"], {"policy_reference", "policy_status"})


@query(_W + f", {_DELIVERED}, n AS (SELECT (SELECT count(DISTINCT POLNO) FROM lo) AS a, (SELECT count(DISTINCT POLNO) FROM dv) AS b) SELECT name, {_STATUS}, total, offending FROM (SELECT 'control_total:distinct_keys' AS name, a AS total, abs(a - b) AS offending FROM n)")
def distinct_keys(spark, d):
    return _reconciled(spark, d, assure.Rule("control_total:distinct_keys", {"source": "POLNO", "target": "policy_reference"}))


_FUNCTIONS = ("sum", "avg", "min", "max", "count", "count_distinct")
_SQL_FUNCTION = {"count_distinct": "count(DISTINCT {x})"}


def _aggregates_sql() -> str:
    parts = []
    for f in _FUNCTIONS:
        call = lambda x: _SQL_FUNCTION.get(f, f"{f}({{x}})").format(x=x)  # noqa: B023, E731
        parts.append(f"""SELECT 'aggregate_by:{f}:amount_pence~policy_status' AS name, count(*) AS total, count(*) FILTER (WHERE abs(coalesce(a, 0) - coalesce(b, 0)) > 1e-6 * greatest(abs(coalesce(a, 0)), abs(coalesce(b, 0))) + 1e-9) AS offending
 FROM (SELECT STATCD, {call('CAST(AMTPENCE AS DOUBLE)')} AS a FROM lo GROUP BY 1) s FULL JOIN (SELECT STATCD, {call(_ZEROED)} AS b FROM dv GROUP BY 1) v USING (STATCD)""")
    return _W + f", {_DELIVERED}, r AS ({' UNION ALL '.join(parts)}) SELECT name, {_STATUS}, total, offending FROM r"


@query(_aggregates_sql())
def aggregate_functions(spark, d):
    """All six business aggregates by status, through reconciliation."""
    return _reconciled(spark, d, *[assure.Rule("aggregate_by", {"function": f, "column": "amount_pence", "group_by": ["policy_status"]}) for f in _FUNCTIONS])


@query(_W + f", {_D_SQL} SELECT attribute, value, coalesce(expected, 0) AS expected, coalesce(delivered, 0) AS delivered, coalesce(delivered, 0) - coalesce(expected, 0) AS diff FROM (SELECT 'policy_status' AS attribute, policy_status AS value, count(*) AS expected FROM e GROUP BY 2 UNION ALL SELECT 'exit_reason', exit_reason, count(*) FROM e GROUP BY 2) x FULL JOIN (SELECT 'policy_status' AS attribute, coalesce(policy_status, '~') AS v, count(*) AS delivered FROM dl GROUP BY 2 UNION ALL SELECT 'exit_reason', coalesce(exit_reason, '~'), count(*) FROM dl GROUP BY 2) y USING (attribute) WHERE coalesce(x.value, '~') = y.v")
def category_profile(spark, d):
    exp = {"policy_status": STATUS.column_of(), "exit_reason": MAPPING["exit_reason"].column_of(), "customer_reference": MAPPING["customer_reference"].column_of()}
    return C.category_profiles(legacy_orders(spark, d), _tampered(spark, d), exp)


@query(_W + f", {_D_SQL}, s AS (SELECT policy_status, exit_reason, count(*) AS a FROM e GROUP BY 1, 2), v AS (SELECT policy_status, exit_reason, count(*) AS b FROM dl GROUP BY 1, 2) SELECT coalesce(s.policy_status, v.policy_status) AS policy_status, coalesce(s.exit_reason, v.exit_reason) AS exit_reason, a AS source_value, b AS delivered_value, coalesce(a, 0) = coalesce(b, 0) AS ties FROM s FULL JOIN v ON s.policy_status = v.policy_status AND coalesce(s.exit_reason, '~') = coalesce(v.exit_reason, '~')")
def aggregate_by(spark, d):
    o, t = legacy_orders(spark, d), _tampered(spark, d)
    return C.aggregate_by(o, t, {"policy_status": STATUS.column_of(), "exit_reason": MAPPING["exit_reason"].column_of()}, {"policy_status": F.col("policy_status"), "exit_reason": F.col("exit_reason")}, F.lit(1), F.lit(1), "count")


@query(_W + f", {_D_SQL} SELECT 'exit_reason' AS attribute, 'policy_status' AS driver, count(exit_reason) AS total, count(*) FILTER (WHERE exit_reason IS NOT NULL AND policy_status NOT IN ('FINISHED')) AS violations FROM dl")
def crossfield(spark, d):
    k = K.Check("crossfield:exit_reason~policy_status", "crossfield", K.HARD, "exit_reason", "exit_reason IS NOT NULL AND exit_reason <> ''", "policy_status NOT IN ('FINISHED')")
    return K.fuse(_tampered(spark, d), [k]).select("attribute", F.lit("policy_status").alias("driver"), "total", "violations")


_REPORT = [
    K.Check("required_present:policy_reference", "completeness", K.HARD, "policy_reference", "true", "policy_reference IS NULL"),
    K.Check("required_present:exit_date", "completeness", K.SOFT, "exit_date", "is_open = false", "exit_date IS NULL"),
    K.Check("domain:policy_status", "domain", K.SOFT, "policy_status", "policy_status IS NOT NULL", "policy_status NOT IN ('FINISHED', 'OPEN', 'PENDING')"),
    K.Check("crossfield:exit_reason~policy_status", "crossfield", K.SOFT, "exit_reason", "exit_reason IS NOT NULL", "policy_status <> 'FINISHED'"),
]


@query(_W + f", {TARGET_SQL}, c AS (SELECT 1 AS hard, count(*) FILTER (WHERE policy_reference IS NULL) AS v FROM t UNION ALL SELECT 0, count(*) FILTER (WHERE NOT is_open AND exit_date IS NULL) FROM t UNION ALL SELECT 0, count(*) FILTER (WHERE policy_status NOT IN ('FINISHED', 'OPEN', 'PENDING')) FROM t UNION ALL SELECT 0, count(*) FILTER (WHERE exit_reason IS NOT NULL AND policy_status <> 'FINISHED') FROM t) SELECT CASE WHEN max(CASE WHEN v > 0 THEN hard END) = 1 THEN 'blocked' WHEN max(v) > 0 THEN 'needs_review' ELSE 'certified' END AS verdict, count(*) FILTER (WHERE v = 0) AS passed, count(*) FILTER (WHERE v > 0) AS failed FROM c")
def verdict_rollup(spark, d):
    found = K.run(target(spark, d), _REPORT, samples=0)
    counts = [sum(r.status == s for r in found) for s in ("pass", "fail")]
    return spark.createDataFrame([(K.verdict(found), *counts)], "verdict string, passed bigint, failed bigint")


@query("SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(string_split_regex(lower(p_name || ' ' || p_type), '[^a-z0-9]+'), lambda x: x <> ''))), ' ') AS tokens FROM part")
def tokenize(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", F.array_join(F.array_sort(match.token_set(F.concat_ws(" ", "p_name", "p_type"))), " ").alias("tokens"))


_PHRASES = [("POLNO", "Policy Number"), ("COMMDT", "Policy Commencement Date"), ("EXITDT", "Policy Exit Date"), ("SCHNO", "Scheme Reference Number"), ("SCHNM", "Scheme Name"), ("PREMAMT", "Annual Premium Amount"), ("PREMFRQ", "Premium Frequency Code"), ("SUMASSD", "Sum Assured Amount")]
_TARGETS = [("policy_reference", "policy reference"), ("commencement_date", "policy commencement date"), ("exit_date", "exit date"), ("scheme_name", "scheme name"), ("scheme_reference", "scheme reference"), ("annual_premium", "annual premium"), ("sum_assured", "sum assured")]
_VAL = lambda rows: ", ".join(f"('{a}', '{b}')" for a, b in rows)
_TOK = "unnest(list_distinct(list_filter(string_split(regexp_replace(lower(phrase), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')))"


@query(f"WITH s(name, phrase) AS (VALUES {_VAL(_PHRASES)}), t AS (SELECT name, {_TOK} AS token FROM s) SELECT token, count(DISTINCT name) AS df FROM t GROUP BY 1 HAVING count(DISTINCT name) >= 2")
def shared_vocab(spark, d):
    return match.shared_vocabulary(spark.createDataFrame(_PHRASES, "name string, phrase string"))


_GENERIC_SQL = ", ".join(f"'{w}'" for w in ("id", "no", "ref", "reference", "number", "code", "of", "the", "date", "datetime", "timestamp", "time", "value"))


@query(f"""WITH s(source, phrase) AS (VALUES {_VAL(_PHRASES)}), t(target, phrase) AS (VALUES {_VAL(_TARGETS)}), st AS (SELECT * FROM (SELECT source, {_TOK} AS w FROM s) WHERE w NOT IN ({_GENERIC_SQL})), tt AS (SELECT * FROM (SELECT target, {_TOK} AS w FROM t) WHERE w NOT IN ({_GENERIC_SQL})),
 c AS (SELECT target, source, count(*) AS k FROM st JOIN tt USING (w) GROUP BY 1, 2), j AS (SELECT target, source, round(k / ((SELECT count(*) FROM st WHERE st.source = c.source) + (SELECT count(*) FROM tt WHERE tt.target = c.target) - k), 4) AS name_score FROM c)
 SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY target ORDER BY name_score DESC, source) AS INT) AS rank FROM j) WHERE rank <= 4""")
def match_candidates(spark, d):
    return match.candidates(spark.createDataFrame(_PHRASES, "name string, phrase string"), spark.createDataFrame(_TARGETS, "name string, phrase string"))


@query("SELECT p_partkey, round(p_retailprice / (SELECT max(p_retailprice) FROM part), 4) AS confidence, CASE WHEN round(p_retailprice / (SELECT max(p_retailprice) FROM part), 4) >= 0.85 THEN 'auto_accept' WHEN round(p_retailprice / (SELECT max(p_retailprice) FROM part), 4) >= 0.60 THEN 'review' ELSE 'reject' END AS gate FROM part")
def gate_bands(spark, d):
    p = table(spark, d, "part")
    most = p.agg(F.max("p_retailprice").alias("m"))
    c = F.round(F.col("p_retailprice") / most.scalar(), 4)
    return p.select("p_partkey", c.alias("confidence"), match.gate_of(c).alias("gate"))


_BEST = 1200


@query(f"""WITH c AS (SELECT 'p' || p_partkey AS target, p_brand AS source, least(p_retailprice / {_BEST}, 1.0) AS c, row_number() OVER (PARTITION BY p_brand ORDER BY least(p_retailprice / {_BEST}, 1.0) DESC, p_partkey) AS r, max(least(p_retailprice / {_BEST}, 1.0)) OVER (PARTITION BY p_brand) AS best, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
 SELECT target, CASE WHEN n > 1 AND r > 1 AND best >= 0.85 THEN NULL ELSE source END AS source, CASE WHEN n > 1 AND r > 1 AND best >= 0.85 THEN 0.0 WHEN r > 1 THEN least(c, 0.70) ELSE c END AS confidence, CASE WHEN r = 1 THEN (CASE WHEN c >= 0.85 THEN 'auto_accept' WHEN c >= 0.60 THEN 'review' ELSE 'reject' END) WHEN best >= 0.85 THEN 'reject' ELSE 'review' END AS gate FROM c""")
def contention(spark, d):
    """Parts that claim their brand: the dearest keeps it, the others are unmapped or go to review."""
    p = table(spark, d, "part").orderBy("p_partkey").select("p_partkey", "p_brand", "p_retailprice").collect()  # stands for a dictionary, which the driver holds
    sources = [match.SourceColumn(b, "") for b in sorted({r.p_brand for r in p})]
    claims = [match.Mapping(f"p{r.p_partkey}", (r.p_brand,), X.Copy(r.p_brand), 0.0, 1.0, c := min(r.p_retailprice / _BEST, 1.0), match.gate(c)) for r in p]
    settled = match.settle(claims, {m.target: match.Target(m.target, "opaque") for m in claims}, sources)
    return spark.createDataFrame([(m.target, m.sources[0] if m.sources else None, float(m.confidence), m.gate) for m in settled], "target string, source string, confidence double, gate string")


def _graph_edges(spark: SparkSession, d: str) -> DataFrame:
    n, r, c = table(spark, d, "nation"), table(spark, d, "region"), table(spark, d, "customer")
    a = n.select(F.concat(F.lit("n:"), "n_nationkey").alias("src"), F.concat(F.lit("r:"), "n_regionkey").alias("dst"), F.lit("IN").alias("kind"))
    b = c.select(F.concat(F.lit("c:"), "c_custkey").alias("src"), F.concat(F.lit("n:"), "c_nationkey").alias("dst"), F.lit("OF").alias("kind"))
    return a.unionByName(b).unionByName(r.select(F.concat(F.lit("r:"), "r_regionkey").alias("src"), F.lit("ds:world").alias("dst"), F.lit("ON").alias("kind")))


@query("""WITH RECURSIVE e AS (SELECT 'n:' || n_nationkey AS src, 'r:' || n_regionkey AS dst, 'IN' AS kind FROM nation UNION ALL SELECT 'c:' || c_custkey, 'n:' || c_nationkey, 'OF' FROM customer UNION ALL SELECT 'r:' || r_regionkey, 'ds:world', 'ON' FROM region),
 u AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e), w(node, hop) AS (SELECT 'r:1', 0 UNION SELECT u.b, hop + 1 FROM w JOIN u ON u.a = w.node WHERE hop < 4 AND w.node NOT LIKE 'ds:%')
 SELECT DISTINCT src, dst, kind FROM e WHERE src IN (SELECT node FROM w WHERE hop < 4 AND node NOT LIKE 'ds:%') OR dst IN (SELECT node FROM w WHERE hop < 4 AND node NOT LIKE 'ds:%')""")
def lineage_bfs(spark, d):
    return graph.lineage(_graph_edges(spark, d), "r:1")


_USES = [("TOTAL", "NET"), ("TOTAL", "TAX"), ("NET", "GROSS"), ("NET", "DISC"), ("TAX", "RATE"), ("OTHER", "THING"), ("GROSS", "QTY"), ("QTY", "NET")]


@query(f"WITH RECURSIVE e(variable, depends_on) AS (VALUES {_VAL(_USES)}), w(variable) AS (SELECT 'TOTAL' UNION SELECT depends_on FROM e JOIN w USING (variable)) SELECT variable FROM w")
def slice_fixpoint(spark, d):
    return graph.reach(spark.createDataFrame(_USES, "variable string, depends_on string"), "TOTAL", len(_USES))


@query("SELECT 'p:' || p_partkey AS id, p_name AS label FROM part WHERE contains(lower(p_name), '1') OR contains('p:' || p_partkey, '1') ORDER BY length(p_name), id LIMIT 20")
def kg_search(spark, d):
    p = table(spark, d, "part").select(F.concat(F.lit("p:"), "p_partkey").alias("id"), F.col("p_name").alias("label"))
    return graph.search(p, "1")


@query("SELECT 1 AS version, 'superseded' AS state, (SELECT count(*) FROM region) AS nodes, 0 AS edges UNION ALL SELECT 2, 'certified', (SELECT count(*) FROM region) + (SELECT count(*) FROM nation), (SELECT count(*) FROM nation) UNION ALL SELECT 3, 'draft', (SELECT count(*) FROM nation), 0")
def kg_latest(spark, d):
    """Versions of a knowledge store that was written, amended, certified and superseded, with what each holds."""
    store = graph.Store(spark, f"{shared_folder(spark).rstrip('/')}/store-{uuid.uuid4().hex}")
    regions = [(f"r:{r.r_regionkey}", "region", r.r_name, {}) for r in table(spark, d, "region").collect()]  # reference tables of some dozen rows
    nations = [(f"n:{r.n_nationkey}", "nation", r.n_name, {}) for r in table(spark, d, "nation").collect()]
    links = [(f"n:{r.n_nationkey}", f"r:{r.n_regionkey}", "IN") for r in table(spark, d, "nation").collect()]
    store.certify(store.create(regions, []))
    second = store.create(nations, links)
    store.amend(second, regions, "regions")
    store.certify(second)
    store.create(nations, [])
    held = lambda df, name: df.groupBy("version").agg(F.count(F.lit(1)).alias(name))
    out = store.versions().select("version", "state").join(held(store.nodes(), "nodes"), "version", "left").join(held(store.edges(), "edges"), "version", "left")
    return out.select("version", "state", F.coalesce("nodes", F.lit(0)).alias("nodes"), F.coalesce("edges", F.lit(0)).alias("edges"))


@query(f"WITH {_LO}, {TARGET_SQL} SELECT 'required_present:policy_reference' AS check_name, 'completeness' AS category, 'hard' AS severity, 'policy_reference' AS attribute, count(*) AS total, count(*) FILTER (WHERE policy_reference IS NULL) AS violations FROM t UNION ALL SELECT 'required_present:exit_date', 'completeness', 'soft', 'exit_date', count(*) FILTER (WHERE NOT is_open), count(*) FILTER (WHERE NOT is_open AND exit_date IS NULL) FROM t UNION ALL SELECT 'domain:policy_status', 'domain', 'soft', 'policy_status', count(policy_status), count(*) FILTER (WHERE policy_status NOT IN ('FINISHED', 'OPEN', 'PENDING')) FROM t UNION ALL SELECT 'crossfield:exit_reason~policy_status', 'crossfield', 'soft', 'exit_reason', count(exit_reason), count(*) FILTER (WHERE exit_reason IS NOT NULL AND policy_status <> 'FINISHED') FROM t")
def check_report(spark, d):
    """The flagship: all checks of the transformed orders in one aggregate."""
    return K.fuse(target(spark, d), _REPORT)


QUERIES, ORACLE_SQL = Q, SQL
