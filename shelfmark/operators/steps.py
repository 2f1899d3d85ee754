"""Helpers of iterative operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows whose running sum one task forms.
BLOCK = 10_000


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage at a step: a checkpoint in the shared folder, or in local mode without one a cached table.

    A cluster without ``spark.checkpoint.dir`` is an error: cached blocks are
    lost with their executor.
    """
    context = df.sparkSession.sparkContext
    folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if folder and not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    if context.getCheckpointDir():
        return df.checkpoint()
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return df.persist()


def running_sum(rows: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` up to and with each row by ``order`` (whole numbers from 0, unique).

    Sums are formed in blocks of the order; only block totals meet in one place.
    """
    blocked = rows.withColumn("_block", F.floor(F.col(order) / BLOCK))
    totals = blocked.groupBy("_block").agg(F.sum(value).alias("_total"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_block", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    inside = F.sum(value).over(Window.partitionBy("_block").orderBy(order))
    summed = blocked.withColumn(name, inside).join(totals, "_block")
    return summed.withColumn(name, F.col(name) + F.col("_before")).drop("_block", "_before")
