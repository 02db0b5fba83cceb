"""The fused checks over a stream, one aggregate a micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.checks import Check, fuse


def watch(stream: DataFrame, checks: list[Check], out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends (batch, check_name, ..., total, violations) of every micro-batch to ``out``.

    A batch written twice after a failure overwrites its own folder, so counts stay exact.
    """

    def each(batch: DataFrame, n: int) -> None:
        fuse(batch, checks).withColumn("batch", F.lit(n)).coalesce(1).write.mode("overwrite").parquet(f"{out}/batch={n}")

    w = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def windowed_counts(stream: DataFrame, time: str, key: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Rows per key and window with a watermark; late rows beyond it are left out by definition."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
