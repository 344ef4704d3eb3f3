"""Extension: leaderboards and deduplication over streams of judgments and rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftspark.operators.leaderboard import valid


def running_scores(judgments: DataFrame, window: str | None = None, late: str = "1 hour", time: str = "ts") -> DataFrame:
    """(model, score, n) of a stream of judgments, or with a window, for each window of time; judgments later than ``late`` don't count.

    State is one row a model, and a window while it is open.
    """
    rows = valid(judgments)
    if window is None:
        return rows.groupBy("model").agg(F.avg("score").alias("score"), F.count("*").alias("n"))
    grouped = rows.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), "model")
    return grouped.agg(F.avg("score").alias("score"), F.count("*").alias("n")).select(F.col("w.start").alias("start"), "model", "score", "n")


def first_copies(rows: DataFrame, key: str, late: str = "1 hour", time: str = "ts") -> DataFrame:
    """The first row of each key within the time that copies may be late; state is a hash a key for that time."""
    return rows.withColumn("__key", F.sha2(F.col(key).cast("binary"), 256)).withWatermark(time, late).dropDuplicatesWithinWatermark(["__key"]).drop("__key")
