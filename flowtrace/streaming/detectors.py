"""Bursts and hubs over streams of events, with watermarks that bound state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def burst_sessions(events: DataFrame, key: str = "user_id", time: str = "ts", gap: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """(key, start, end, n): runs of events of a key no more than gap apart; single events are left out."""
    runs = events.withWatermark(time, late).groupBy(F.col(key), F.session_window(time, gap)).agg(F.count("*").alias("n"))
    return runs.where("n > 1").select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def hub_windows(pairs: DataFrame, minutes: int = 60, slide: int = 15, least: int = 4, late: str = "10 minutes") -> DataFrame:
    """(wallet, start, n_sources) over pairs(source, target, ts): sliding windows in which many sources paid a wallet."""
    seen = pairs.withWatermark("ts", late).groupBy(F.window("ts", f"{minutes} minutes", f"{slide} minutes"), F.col("target").alias("wallet")).agg(F.approx_count_distinct("source", 0.01).alias("n_sources"))
    return seen.where(F.col("n_sources") >= least).select("wallet", F.col("window.start").alias("start"), "n_sources")
