"""Ranks and running sums over a total order, without one task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import stage


def running(df: DataFrame, order: list[Column | str], weight: Column | str | None = None, out: str = "before") -> DataFrame:
    """Adds the weight (or number) of all rows that come before a row.

    Rows are spread by ranges of the order; one sum a partition is added up,
    and each partition is scanned in its own order. Ties are broken by no more
    than ``order``: give a unique last column. Null weights count as 0; an
    empty table stays empty.
    """
    w = F.lit(1) if weight is None else F.coalesce(F.col(weight) if isinstance(weight, str) else weight, F.lit(0))
    ranged = stage(df.withColumn("_w", w).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    sums = ranged.groupBy("_part").agg(F.sum("_w").alias("_sum"))
    offsets = sums.select("_part", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    local = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # One row a partition: its number is that of the shuffle's partitions.
    joined = ranged.join(F.broadcast(offsets), "_part")
    return joined.withColumn(out, F.col("_offset") + F.coalesce(F.sum("_w").over(local), F.lit(0))).drop("_part", "_offset", "_w")


def ranked(df: DataFrame, order: list[Column | str], out: str = "rank") -> DataFrame:
    """Adds the 1-based position in the order."""
    return running(df, order, None, "_before").withColumn(out, F.col("_before") + 1).drop("_before")
