"""Label drift of a stream against a fitted distribution, per tumbling window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrortab.functions import metric


def window_label_counts(events: DataFrame, ts: str, label: str, window: str = "1 day", lateness: str = "1 hour") -> DataFrame:
    """``(window_start, label, n)`` of a streaming or static table; late rows are bounded by
    the watermark."""
    return (
        events.withWatermark(ts, lateness)
        .groupBy(F.window(ts, window).alias("w"), F.col(label).alias("label"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("window_start"), "label", "n")
    )


def label_drift(window_counts: DataFrame, reference: DataFrame) -> DataFrame:
    """``(window_start, n, tv)``: total variation of each window's labels from ``reference``
    ``(label, p)``.  Labels absent from a window count with their full probability."""
    totals = window_counts.groupBy("window_start").agg(F.sum("n").alias("total"))
    shares = window_counts.join(totals, "window_start").join(reference.select("label", F.col("p").alias("ref")), "label", "left")
    p, q = F.col("n") / F.col("total"), F.coalesce(F.col("ref"), F.lit(0.0))
    sums = shares.groupBy("window_start").agg(
        F.max("total").alias("n"), F.sum(F.abs(p - q)).alias("gap"), F.sum(q).alias("covered")
    )
    return sums.select("window_start", "n", metric((F.col("gap") + F.lit(1.0) - F.col("covered")) / 2).alias("tv"))
