"""Traces as a stream: each episode once, pass rates by window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def stream(spark: SparkSession, path: str, schema: StructType, files_a_batch: int = 16) -> DataFrame:
    """New parquet files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def first_seen(traces: DataFrame, keys: list[str], time: str, late: str = "2 hours") -> DataFrame:
    """Each key once within the watermark; state is dropped behind it. Rows of a null key count as one key."""
    return traces.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def pass_rates(traces: DataFrame, time: str, passed: str, by: list[str], size: str = "1 day", slide: str | None = None) -> DataFrame:
    """by, start, n, pass_rate by tumbling or sliding window; a watermark must be set before. Null times fall in no window."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    g = traces.groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.avg(F.coalesce(F.col(passed).cast("double"), F.lit(0.0))).alias("pass_rate"))
    return g.select(*by, F.col("w.start").alias("start"), "n", F.round("pass_rate", 6).alias("pass_rate"))


def run_to_end(df: DataFrame, target: str, checkpoint: str, mode: str = "append") -> None:
    """Writes what is there to parquet and stops; the checkpoint folder makes a restart go on."""
    q = df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)
    q.awaitTermination()
