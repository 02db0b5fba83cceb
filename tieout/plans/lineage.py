"""Cutting lineage so that iterative jobs survive the loss of executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Only where all runs on this machine, as in tests, is one of its own made, and
    removed with the session; on a cluster every executor would write to its own disk and rows be lost unseen."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="tieout-checkpoint-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder and read from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stage(df: DataFrame) -> DataFrame:
    """The same rows as a columnar table in the shared folder: smaller than a checkpoint, and read by column.

    The table stays as long as the application, since the result may be read again at any time; then it is removed.
    """
    spark = df.sparkSession
    path = f"{_tables(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_folders: dict[str, str] = {}


def _tables(spark: SparkSession) -> str:
    """One folder of staged tables an application, removed when the session's context ends."""
    sc = spark.sparkContext
    if sc.applicationId not in _folders:
        path = _folders[sc.applicationId] = f"{shared_folder(spark).rstrip('/')}/tieout-{sc.applicationId}"
        stop = sc.stop

        def remove_and_stop() -> None:
            try:
                remove_tables(spark)
            finally:
                stop()

        sc.stop = remove_and_stop  # a session's stop comes here too
    return _folders[sc.applicationId]


def remove_tables(spark: SparkSession) -> None:
    """Removes what :func:`stage` wrote for this application; results that still read it can't be read any more."""
    path = _folders.pop(spark.sparkContext.applicationId, None)
    if path is not None:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
