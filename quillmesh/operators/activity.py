"""Change activity: hotspots, recent files and churn, from a log of (path, at) events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hotspots(log: DataFrame, after: Column, most: int = 500) -> DataFrame:
    """path, n, churn (n over the largest n), commits (churn in hundredths) of the most changed paths since ``after``."""
    counts = log.filter(F.col("at") >= after).groupBy("path").agg(F.count("*").alias("n"))
    out = counts.orderBy(F.desc("n"), "path").limit(most)
    churn = F.col("n") / F.max("n").over(Window.partitionBy(F.lit(0)))  # over `most` rows, the largest among them
    return out.select("path", "n", F.round(churn, 6).alias("churn"), F.round(churn * 100).cast("long").alias("commits"))


def recent(log: DataFrame, after: Column, most: int = 50) -> DataFrame:
    """path, n of the paths changed since ``after``, the most changed first."""
    return log.filter(F.col("at") >= after).groupBy("path").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "path").limit(most)


def churn(log: DataFrame) -> DataFrame:
    """path, commits, last_modified, churn (a hundred commits are the most)."""
    return log.groupBy("path").agg(F.count("*").alias("commits"), F.max("at").alias("last_modified")).withColumn("churn", F.least(F.col("commits") / 100, F.lit(1.0)))
