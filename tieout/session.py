"""Session settings the engine relies on; a cluster's own values win where it sets them."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

from .plans.ship import ship


def session(name: str = "tieout", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.timeType.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel(os.environ.get("TIEOUT_LOG", "ERROR"))
    ship(spark)
    return spark
