"""Files as data: hashes of files and folders, artifacts, checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def file_hashes(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """path (below the folder), bytes, sha256 of every file; files beyond 2 GB are an error of the binary source."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    root = folder.rstrip("/").split(":", 1)[-1].lstrip("/") + "/"
    return d.select(F.substring_index("path", root, -1).alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def folder_fingerprint(hashes: DataFrame, order: Column | None = None) -> DataFrame:
    """fingerprint: of the [path, hash] pairs, sorted by path or, where it is given, by ``order`` first."""
    pair = F.concat(F.lit('["'), F.regexp_replace("path", r'(["\\])', r"\\$1"), F.lit('","sha256:'), "sha256", F.lit('"]'))
    rows = F.array_sort(F.collect_list(F.struct((F.lit(0) if order is None else order).alias("o"), F.col("path").alias("p"), pair.alias("t"))))
    whole = F.concat(F.lit("["), F.array_join(F.transform(rows, lambda r: r["t"]), ","), F.lit("]"))
    return hashes.agg(F.concat(F.lit("sha256:"), F.sha2(whole, 256)).alias("fingerprint"))


def checkpoints(names: DataFrame, name: str) -> DataFrame:
    """Adds ``step`` of names such as checkpoint-120; others are left out."""
    return names.withColumn("step", F.regexp_extract(name, r"^checkpoint-(\d+)$", 1).try_cast("long")).where("step is not null")


def latest(names: DataFrame, name: str) -> DataFrame:
    """name, step of the highest step."""
    return checkpoints(names, name).agg(F.max_by(name, "step").alias(name), F.max("step").alias("step"))
