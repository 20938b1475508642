"""Traces of iteration times: ``iteration, rank, it_time``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RANKS = 4
BUCKET_SECONDS = 21600


def from_events(spark: SparkSession, sf_dir: str, runs: int = 0) -> DataFrame:
    """Event values summed by six-hour bucket and rank, with zeros where a rank has no events; with ``runs``, users are dealt to so many."""
    if runs:
        return _run_trace(spark, sf_dir, runs)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.expr(f"timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', ts) div {BUCKET_SECONDS}").alias("iteration"),
        (F.col("user_id") % RANKS).cast("int").alias("rank"),
        "value",
    )
    seen = events.groupBy("iteration", "rank").agg(F.round(F.sum("value"), 6).alias("it_time"))
    grid = events.select("iteration").distinct().select("iteration", F.explode(F.sequence(F.lit(0), F.lit(RANKS - 1))).alias("rank"))
    return grid.join(seen, ["iteration", "rank"], "left").select("iteration", "rank", F.coalesce("it_time", F.lit(0.0)).alias("it_time"))


def _run_trace(spark: SparkSession, sf_dir: str, runs: int) -> DataFrame:
    """``run, iteration, rank, it_time`` for the iterations in which a run has events."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.expr(f"(user_id div {RANKS}) % {runs}").alias("run"),
        F.expr(f"timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', ts) div {BUCKET_SECONDS}").alias("iteration"),
        (F.col("user_id") % RANKS).cast("int").alias("rank"),
        "value",
    )
    return events.groupBy("run", "iteration", "rank").agg(F.round(F.sum("value"), 6).alias("it_time"))
