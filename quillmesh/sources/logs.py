"""Log files as a source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.operators import extract


def lines(spark: SparkSession, path: str, cutoff: Column | None = None, keep_untimed: bool = False) -> DataFrame:
    """id (the file), line, body of all log files under ``path``, from ``cutoff`` on. Files are read whole, so
    that lines have their numbers."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("id"), "value")
    rows = files.select("id", F.posexplode(F.split("value", r"\r?\n")).alias("line", "body")).withColumn("line", F.col("line") + 1)
    return rows if cutoff is None else extract.since(rows, cutoff, keep_untimed)


def contents(spark: SparkSession, path: str, cutoff: Column | None = None, keep_untimed: bool = False) -> DataFrame:
    """id, content of each file, as ``extract.frames`` and ``extract.error_messages`` take them."""
    if cutoff is None:
        return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("id"), F.col("value").alias("content"))
    rows = lines(spark, path, cutoff, keep_untimed)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "body"))), lambda x: x["body"]), "\n")
    return rows.groupBy("id").agg(joined.alias("content"))
