"""Readers for tables that already are columnar."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.ship import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory; pruning and filters reach its scan."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog(spark: SparkSession, database: str | None = None) -> DataFrame:
    """(table_name, column_name, position, data_type) of the tables and views a session knows."""
    rows = [(t.name, c.name, i + 1, c.dataType) for t in spark.catalog.listTables(database) for i, c in enumerate(spark.catalog.listColumns(t.name, database))]
    return spark.createDataFrame(rows, "table_name string, column_name string, position int, data_type string")
