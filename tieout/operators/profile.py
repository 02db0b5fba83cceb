"""Profiles of delivered text tables in a fixed number of jobs, whatever the number of columns.

Tables are unpivoted to (colname, value), compressed to weighted values, and aggregated once per
column. Dependencies come from one contingency aggregate, pair tests from one fused aggregate.

Defined results: an empty table has no profile, dependencies or findings; blanks and sentinels
count as not populated; types hold for all populated values or not at all.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import PLAIN_NUMBER, any_of, populated, q, strip  # noqa: F401
from ..plans.lineage import stage

#: A column with at most so many distinct values may be a code; codes have at most CODE_LENGTH characters. Fixed values.
FEW_VALUES, CODE_LENGTH = 15, 8
#: An all-digit column is an identifier if filled throughout, nearly unique and at least so long. Fixed values.
KEY_RATIO, KEY_LENGTH = 0.99, 6
DRIVER_VALUES = 3
DATE_RATIO, DATE_ROWS = 0.9, 10


def cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """(colname, value, n): weighted values of all columns; one scan, aggregated before the shuffle."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("colname"), q(c).cast("string").alias("value")) for c in columns]))
    return df.select(each.alias("c")).groupBy("c.colname", "c.value").agg(F.count(F.lit(1)).alias("n"))


def profile(df: DataFrame, columns: list[str] | None = None, raw: DataFrame | None = None) -> DataFrame:
    """One row a column: counts, type, role. Values are stripped before they are compared. ``raw``: their :func:`cells`, where at hand."""
    columns = columns or df.columns
    raw = cells(df, columns) if raw is None else raw
    v = strip(F.col("value"))
    by_value = raw.groupBy("colname", F.when(populated(F.col("value")), v).alias("v")).agg(F.sum("n").alias("n"))
    x, n = F.col("v"), F.col("n")
    every = lambda c: F.bool_and(F.when(x.isNotNull(), c))
    num = lambda a, k: F.substring(x, a, k).try_cast("int")
    ymd = F.coalesce(x.rlike(r"^[0-9]{8}\z") & num(1, 4).between(1900, 2099) & num(5, 2).between(1, 12) & num(7, 2).between(1, 31), F.lit(False))
    per = by_value.groupBy("colname").agg(
        F.sum("n").alias("row_count"), F.coalesce(F.sum(F.when(x.isNotNull(), n)), F.lit(0)).alias("populated_count"), F.count("v").alias("distinct_count"), F.min("v").alias("least"), F.max(F.length("v")).alias("longest"),
        every(ymd).alias("all_ymd"), every(x.rlike(r"^-?[0-9]+\.[0-9]+\z")).alias("all_decimal"), every(x.rlike(r"^[0-9]+\z")).alias("all_digits"), every(x.rlike(r"^[A-Za-z0-9_/\-]+\z")).alias("all_code"),
    )
    filled = F.when(F.col("row_count") > 0, F.col("populated_count") / F.col("row_count")).otherwise(0.0)
    ratio = F.when(F.col("populated_count") > 0, F.col("distinct_count") / F.col("populated_count")).otherwise(0.0)
    key = (F.col("populated_count") == F.col("row_count")) & (ratio >= KEY_RATIO) & (F.length("least") >= KEY_LENGTH)
    kind = (
        F.when(F.col("distinct_count") == 0, "EMPTY").when(F.col("all_ymd"), "DATE_YYYYMMDD").when(F.col("all_decimal"), "DECIMAL").when(F.col("all_digits") & key, "IDENTIFIER").when(F.col("all_digits"), "INTEGER")
        .when((F.col("distinct_count") <= FEW_VALUES) & (F.col("longest") <= CODE_LENGTH) & F.col("all_code"), "CATEGORICAL_CODE").otherwise("FREE_TEXT")
    )
    p = per.withColumns({"inferred_type": kind, "populated_fraction": F.round(filled, 3), "distinct_ratio": F.round(ratio, 3)})
    t = F.col("inferred_type")
    role = F.when(t == "EMPTY", "dead").when(F.col("distinct_count") == 1, "constant").when(t == "IDENTIFIER", "key").when(t == "DATE_YYYYMMDD", "date").when(t.isin("DECIMAL", "INTEGER"), "measure").when(t == "CATEGORICAL_CODE", "code").otherwise("free text")
    some = (F.col("populated_count") > 0) & (F.col("populated_count") < F.col("row_count"))
    return p.withColumn("role", F.concat(role, F.when(some, " (conditionally populated)").otherwise(""))).drop("all_ymd", "all_decimal", "all_digits", "all_code")


def top_values(df: DataFrame, columns: list[str], most: int = FEW_VALUES) -> DataFrame:
    """(colname, value, n, rank): the most frequent populated values; ties in order of value."""
    v = cells(df, columns).where(populated(F.col("value"))).groupBy("colname", strip(F.col("value")).alias("value")).agg(F.sum("n").alias("n"))
    w = Window.partitionBy("colname").orderBy(F.col("n").desc(), "value")
    return v.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def distinct_samples(df: DataFrame, columns: list[str], most: int) -> DataFrame:
    """(colname, value, rank): the first distinct non-blank values in order."""
    v = cells(df, columns).where(F.trim("value") != "").select("colname", "value").distinct()
    w = Window.partitionBy("colname").orderBy("value")
    return v.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def dependencies(df: DataFrame, columns: list[str] | None = None, prof: dict | None = None) -> DataFrame:
    """(dependent, driver, driver_values, support, confidence): columns filled only where a driver has a few values.

    One contingency aggregate: (driver, value) with the number of rows and, per conditionally filled
    column, how many have it filled. A driver qualifies if it is filled wherever the dependent is, with at
    most DRIVER_VALUES values and not all it has. Fewest values win, then coverage, then name.
    """
    columns = columns or df.columns
    prof = prof or {r.colname: r for r in profile(df, columns).collect()}  # one row a column
    dependents = [c for c in columns if c in prof and 0 < prof[c].populated_count < prof[c].row_count]
    if not dependents:
        return df.sparkSession.createDataFrame([], "dependent string, driver string, driver_values string, support bigint, confidence double")
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("driver"), F.when(populated(q(c)), strip(q(c))).alias("value")) for c in columns if prof[c].distinct_count]))
    flags = [populated(q(c)).cast("int").alias(f"p{i}") for i, c in enumerate(dependents)]
    hits = df.select(each.alias("d"), *flags).where("d.value is not null").groupBy("d.driver", "d.value").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"p{i}").alias(f"p{i}") for i in range(len(dependents))])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("dependent"), F.col(f"p{i}").alias("hit"), F.lit(prof[c].populated_count).cast("bigint").alias("support")) for i, c in enumerate(dependents)]))
    long = hits.select("driver", "value", "n", pairs.alias("p")).where("p.hit > 0 and driver <> p.dependent")
    # counted before values are gathered: at most DRIVER_VALUES of them survive
    per = long.groupBy("p.dependent", "driver", "p.support").agg(F.sum("p.hit").alias("hit"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("values"))
    sizes = F.create_map(*[x for c in columns for x in (F.lit(c), F.lit(prof[c].distinct_count))])
    per = per.where((F.col("hit") == F.col("support")) & (F.col("values") <= DRIVER_VALUES) & (F.col("values") < sizes[F.col("driver")])).withColumn("cov", F.col("hit") / F.col("n"))
    best = per.withColumn("r", F.row_number().over(Window.partitionBy("dependent").orderBy("values", F.col("cov").desc(), "driver"))).where("r = 1")
    named = best.alias("b").join(long.select(F.col("p.dependent").alias("dependent"), "driver", "value"), ["dependent", "driver"])
    return named.groupBy("dependent", "driver", "support", "cov").agg(F.array_join(F.array_sort(F.collect_set("value")), ", ").alias("driver_values")).select("dependent", "driver", "driver_values", "support", F.round("cov", 3).alias("confidence"))


def copopulated(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(col_a, col_b): conditionally filled columns filled in exactly the same rows.

    Rows are counted by which columns they fill; each column then has a fingerprint over these patterns (the sum of the
    hashes of those that fill it, with its rows), and columns of equal fingerprints fill the same rows.
    """
    columns = columns or df.columns
    filled = F.array(*[populated(q(c)) for c in columns])
    patterns = df.select(filled.alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n")
    each = patterns.select(n, F.xxhash64("f").alias("h"), F.xxhash64("f", F.lit(1)).alias("g"), F.posexplode("f").alias("i", "full"))
    marks = [F.sum(F.when(F.col("full"), F.col(c).cast("decimal(38,0)"))).alias(c) for c in ("h", "g")]
    per = each.groupBy("i").agg(F.sum("n").alias("rows_"), F.coalesce(F.sum(F.when(F.col("full"), n)), F.lit(0)).alias("k"), *marks).where((F.col("k") > 0) & (F.col("k") < F.col("rows_")))
    named = F.array(*[F.lit(c) for c in columns])
    a, b = per.alias("a"), per.alias("b")
    same = (F.col("a.h") == F.col("b.h")) & (F.col("a.g") == F.col("b.g")) & (F.col("a.k") == F.col("b.k")) & (F.col("a.i") < F.col("b.i"))
    return a.join(b, same).select(F.element_at(named, F.col("a.i") + 1).alias("col_a"), F.element_at(named, F.col("b.i") + 1).alias("col_b"))


def date_orders(df: DataFrame, dates: list[str]) -> DataFrame:
    """(lo, hi, n, ratio, violations) of date pairs that keep an order on most rows; one aggregate for all pairs.

    Ties count for the first column not being later, as they do for the ratio; a violation is strict.
    """
    out = []
    aggs = []
    for k, (a, b) in enumerate(combinations(dates, 2)):
        both = populated(q(a)) & populated(q(b))
        aggs += [F.count_if(both).alias(f"n{k}"), F.count_if(both & (q(a) <= q(b))).alias(f"le{k}"), F.count_if(both & (q(a) > q(b))).alias(f"gt{k}"), F.count_if(both & (q(b) > q(a))).alias(f"lt{k}")]
        n, le = F.col(f"n{k}"), F.col(f"le{k}")
        forward = le >= n - le
        ratio = F.greatest(le, n - le) / n
        row = F.struct(F.when(forward, a).otherwise(b).alias("lo"), F.when(forward, b).otherwise(a).alias("hi"), n.alias("n"), F.round(ratio, 3).alias("ratio"), F.when(forward, F.col(f"gt{k}")).otherwise(F.col(f"lt{k}")).alias("violations"))
        out.append(F.when((n >= DATE_ROWS) & (ratio >= DATE_RATIO), row))
    return df.agg(*aggs).select(F.explode(F.array_compact(F.array(*out))).alias("p")).select("p.*")


#: Formats a column's type promises. Fixed values.
TYPE_FORMATS = {"DATE_YYYYMMDD": r"^(19|20)[0-9]{2}(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])\z", "DECIMAL": r"^-?[0-9]+\.[0-9]+\z", "INTEGER": r"^[0-9]+\z", "IDENTIFIER": r"^[0-9]+\z"}


def findings(df: DataFrame, columns: list[str] | None = None, expected: dict[str, str] | None = None) -> DataFrame:
    """(colname, completeness, validity, whitespace, severity). Types are inferred unless ``expected`` names them."""
    columns = columns or df.columns
    raw = stage(cells(df, columns))
    prof = profile(df, columns, raw).select("colname", "row_count", "populated_count", "inferred_type", "role")
    if expected:
        prof = prof.withColumn("inferred_type", F.coalesce(F.create_map(*[x for k, v in expected.items() for x in (F.lit(k), F.lit(v))])[F.col("colname")], F.col("inferred_type")))
    v = F.col("value")
    fit = F.lit(True)
    for kind, pattern in TYPE_FORMATS.items():
        fit = F.when(F.col("inferred_type") == kind, strip(v).rlike(pattern)).otherwise(fit)
    j = raw.join(F.broadcast(prof), "colname").groupBy("colname", "row_count", "populated_count", "role").agg(
        F.sum(F.when(populated(v) & fit, F.col("n")).otherwise(0)).alias("fit"), F.sum(F.when((v != "") & (v != strip(v)), F.col("n")).otherwise(0)).alias("padded")
    )
    completeness, validity = F.round(F.col("populated_count") / F.col("row_count"), 3), F.round(F.when(F.col("populated_count") > 0, F.col("fit") / F.col("populated_count")).otherwise(1.0), 3)
    issue = F.startswith("role", F.lit("dead")) | (validity < 1) | (F.col("padded") > 0)
    return j.select("colname", completeness.alias("completeness"), validity.alias("validity"), (F.col("padded") > 0).alias("whitespace"), F.when(validity < 0.9, "major").when(issue, "minor").otherwise("ok").alias("severity"))


#: Formats of personal data: column category, pattern, least share of samples. Fixed values, in order of precedence.
PERSONAL = (
    ("National Insurance Number", r"(?i)^[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z][0-9]{6}[A-D]\z", 0.8, "tokenize"),
    ("Postcode", r"(?i)^[A-Z]{1,2}[0-9][A-Z0-9]?\s*[0-9][A-Z]{2}\z", 0.8, "mask"),
    ("Email", r"^[^@\s]+@[^@\s]+\.[^@\s]+\z", 0.8, "mask"),
    ("Bank Sort Code", r"^[0-9]{2}-?[0-9]{2}-?[0-9]{2}\z", 0.8, "tokenize"),
    ("Name", r"^[A-Za-z][A-Za-z'\-]+,\s+[A-Za-z'\-]+\z", 0.6, "pseudonymize"),
)
ORGANISATION_WORDS = r"(?i)\b(scheme|plan|group|council|pension|ltd|limited|company|trust|fund)\b"
BIRTH_YEARS = (1980, 2010)


def personal_data(df: DataFrame, columns: list[str] | None = None, samples: int = 12, raw: DataFrame | None = None) -> DataFrame:
    """(colname, category, action) of columns whose first distinct samples look like personal data."""
    columns = columns or df.columns
    raw = stage(cells(df, columns)) if raw is None else raw
    v = raw.where(populated(F.col("value"))).select("colname", strip(F.col("value")).alias("value")).distinct()
    v = v.withColumn("r", F.row_number().over(Window.partitionBy("colname").orderBy("value"))).where(F.col("r") <= samples)
    x = F.col("value")
    rates = [F.avg(x.rlike(p).cast("double")).alias(f"r{i}") for i, (_, p, _, _) in enumerate(PERSONAL)]
    rated = v.groupBy("colname").agg(*rates, F.max(x.rlike(ORGANISATION_WORDS)).alias("org"))
    prof = profile(df, columns, raw).select("colname", "inferred_type")
    years = raw.where(strip(F.col("value")).rlike(r"^[0-9]{8}\z")).groupBy("colname").agg(F.min(F.substring(strip(F.col("value")), 1, 4).cast("int")).alias("y0"), F.max(F.substring(strip(F.col("value")), 1, 4).cast("int")).alias("y1"))
    j = rated.join(prof, "colname").join(years, "colname", "left")
    cat, act = F.lit(None).cast("string"), F.lit(None).cast("string")
    name_ok = (F.col("inferred_type") == "FREE_TEXT") & ~F.col("org")
    born = (F.col("inferred_type") == "DATE_YYYYMMDD") & (F.col("y0") < BIRTH_YEARS[0]) & (F.col("y1") <= BIRTH_YEARS[1])
    for i, (name, _, least, action) in reversed(list(enumerate(PERSONAL))):
        cond = (F.col(f"r{i}") >= least) & (name_ok if name == "Name" else F.lit(True))
        cat, act = F.when(cond, name).otherwise(cat), F.when(cond, action).otherwise(act)
        if name == "Name":
            cat, act = F.when(born, "Date of Birth").otherwise(cat), F.when(born, "mask").otherwise(act)
    return j.select("colname", cat.alias("category"), act.alias("action")).where("category is not null")
