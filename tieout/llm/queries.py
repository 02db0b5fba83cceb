"""Queries of the text and name operators, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import stage
from ..sources.tables import table
from . import mixing, names, stuffing, tokenize


def _people(spark: SparkSession, d: str) -> DataFrame:
    number = F.replace(F.upper(F.col("nino")), F.lit(" "), F.lit(""))
    place = F.replace(F.upper(F.col("pcode")), F.lit(" "), F.lit(""))
    e = table(spark, d, "efas0042").where("polno is not null and mbrname is not null")
    return e.select(
        F.col("polno").alias("id"),
        F.col("mbrname").alias("name"),
        F.col("birthdt").alias("born"),
        F.when(number.rlike(r"^[A-Z]{2}[0-9]{6}[A-D]\z"), number).alias("number"),
        F.when(place.rlike(r"^[A-Z]{1,2}[0-9][0-9A-Z]?[0-9][A-Z]{2}\z"), place).alias("place"),
    )


def _field_pairs(field: str, pairs: DataFrame) -> DataFrame:
    return pairs.select(F.lit(field).alias("field"), "key_a", "key_b")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    people = _people(spark, d)
    persons = names.entities(names.person_links(people))
    out = _field_pairs("mbrname", names.variant_pairs(persons, people.select("id", "name")))
    sch = table(spark, d, "esch0009").where("schref is not null").select(F.col("schref").alias("id"), "empnm", "schname", "estbdt").distinct()
    common = names.common_words(sch, "empnm", "schname")
    employers = names.entities(names.organisation_links(sch.select("id", F.col("empnm").alias("name")), common))
    out = out.unionByName(_field_pairs("empnm", names.variant_pairs(employers, sch.where("empnm is not null").select("id", F.col("empnm").alias("name")).distinct())))
    schemes = names.entities(names.scheme_links(sch.select("id", F.col("schname").alias("name"), F.col("empnm").alias("employer"), F.col("estbdt").alias("founded")), employers, common))
    return out.unionByName(_field_pairs("schname", names.variant_pairs(schemes, sch.where("schname is not null").select("id", F.col("schname").alias("name")).distinct())))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.token_ids(table(spark, d, "documents"))


def p8_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Every text's token count and whether its ids decode to it exactly, summed up per source."""
    r = tokenize.round_trips(table(spark, d, "documents"))
    src = table(spark, d, "documents").select("doc_id", "source")
    return r.join(src, "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("tokens"), F.count_if("exact").alias("exact"))


def _mixture(spark: SparkSession, d: str):
    counts = stage(tokenize.token_counts(table(spark, d, "documents"), ["doc_id", "source"]))  # texts are encoded once; 30 bytes a record, read four times
    weights = table(spark, d, "mix_weights")
    return counts, mixing.plan(counts, weights), weights


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    counts, planned, _ = _mixture(spark, d)
    return mixing.mix(counts, planned)


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    counts, planned, weights = _mixture(spark, d)
    return mixing.shares(counts, planned, weights)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return stuffing.stuffed_pages(table(spark, d, "documents"), lang_col="lang").select("doc_id")


def p10_report(spark: SparkSession, d: str) -> DataFrame:
    """Stuffed pages per source and reason."""
    found = stuffing.stuffed_pages(table(spark, d, "documents"), lang_col="lang")
    return found.join(table(spark, d, "documents").select("doc_id", "source"), "doc_id").groupBy("source", "reason").agg(F.count(F.lit(1)).alias("pages"), F.round(F.avg("stuffed_share"), 6).alias("mean_share"))


QUERIES = {f.__name__: f for f in (p1_found, p8_ids, p8_round_trip, p9_mix, p9_shares, p10_found, p10_report)}
ORACLE_SQL: dict[str, str] = {}
