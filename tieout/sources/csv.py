"""Delivered text files, read as text: leading zeros, dates and sentinels stay what they are."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stage_text(spark: SparkSession, path: str, typed: bool = False, multi_line: bool | None = None) -> DataFrame:
    """A CSV or TSV (by extension) with a header; all columns text unless ``typed``. Empty fields are null, blanks stay.

    A file whose quoted fields hold line breaks can't be split between tasks, so that is asked for only where a line leaves a
    quote open: one scan of the lines, in parallel, tells (``multi_line`` saves it).
    """
    sep = "\t" if str(path).lower().endswith(".tsv") else ","
    if multi_line is None:
        quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
        multi_line = not spark.read.text(str(path)).where(quotes % 2 != 0).isEmpty()
    reader = spark.read.option("header", True).option("sep", sep).option("multiLine", multi_line).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    return reader.option("inferSchema", typed).csv(str(path))


def from_text(spark: SparkSession, text: str) -> DataFrame:
    """The same from a file's contents, as an upload delivers it."""
    reader = spark.read.option("header", True).option("escape", '"')
    return reader.csv(spark.sparkContext.parallelize([text], 1).flatMap(_records))


def _records(text: str) -> list[str]:
    """Records of a CSV text; line breaks inside quotes don't end one."""
    out, buffer = [], ""
    for line in text.splitlines():
        buffer = f"{buffer}\n{line}" if buffer else line
        if buffer.count('"') % 2 == 0:
            out.append(buffer)
            buffer = ""
    return out + ([buffer] if buffer else [])


def dictionary(path: str) -> dict:
    """A source or target dictionary; attributes may be called columns or fields, and may be bare names."""
    d = json.loads(Path(path).read_text())
    attrs = d.get("attributes") or d.get("columns") or d.get("fields") or []
    return d | {"attributes": [{"name": a} if isinstance(a, str) else a for a in attrs]}


def deliver(df: DataFrame, path: str) -> None:
    """Writes the delivered form: a header, text, null as empty."""
    df.write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)
