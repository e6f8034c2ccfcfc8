"""J (extension): verdict counts per event-time window, with late rows.

A window's counts are emitted once, when the watermark (the greatest event time seen
less ``delay``) passes its end. Rows that arrive out of order but not later than that are
counted; rows of a window that an earlier micro-batch has closed are dropped, as its
counts are out. State is one row per open window and verdict.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_verdicts(scans: DataFrame, window: str = "1 hour", delay: str = "2 hours", time: str = "scanned_at",
                      verdict: str = "verdict") -> DataFrame:
    """(window_start, verdict, n, mean_score); use with outputMode('append') on a stream."""
    t = scans.withWatermark(time, delay) if scans.isStreaming else scans
    w = t.groupBy(F.window(time, window).alias("w"), verdict).agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("s"))
    return w.select(F.col("w.start").alias("window_start"), verdict, "n", (F.col("s") / F.col("n")).alias("mean_score"))


def closed_windows(scans: DataFrame, window: str = "1 hour", delay: str = "2 hours", time: str = "scanned_at") -> DataFrame:
    """The batch rows that a finished stream has emitted: those whose window ends no later
    than the last watermark (one row, broadcast)."""
    last = scans.agg((F.max(time) - F.expr(f"INTERVAL {delay}")).alias("_mark"))
    return scans.crossJoin(F.broadcast(last)).filter(F.window(time, window)["end"] <= F.col("_mark")).drop("_mark")
