"""Scores of streams as they arrive: repeated rows are dropped, and each window of a stream is judged once,
when the watermark has passed it; rows that come later than that are left out, as the watermark says."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_alerts(scores: DataFrame, thresholds: DataFrame | None = None, window: str = "1 hour", late: str = "10 minutes", keys: tuple[str, ...] = ("stream", "ts"), threshold: float | None = None) -> DataFrame:
    """scores: stream, ts, score, streaming or not; keys tell rows apart. thresholds: stream, threshold (a
    static table); without it one threshold for all. Returns stream, begin, end, n, mean, most, above
    (scores over the threshold) and alert (the mean is over it; null without a threshold). Null scores
    count in n alone; rows without a time have no window."""
    timed = scores.where("ts IS NOT NULL").withWatermark("ts", late)
    rows = timed.dropDuplicatesWithinWatermark(list(keys)) if scores.isStreaming else timed.dropDuplicates(list(keys))
    if thresholds is not None:
        rows = rows.join(thresholds.select(F.col("stream").alias("_stream"), "threshold"), F.col("stream") == F.col("_stream"), "left").drop("_stream")
    else:
        rows = rows.withColumn("threshold", F.lit(threshold).cast("double"))
    judged = rows.groupBy("stream", "threshold", F.window("ts", window).alias("_w")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"), F.max("score").alias("most"), F.count_if(F.col("score") > F.col("threshold")).alias("above"))
    return judged.select("stream", F.col("_w.start").alias("begin"), F.col("_w.end").alias("end"), "n", "mean", "most", "above", (F.col("mean") > F.col("threshold")).alias("alert"))
