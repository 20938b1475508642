"""The cheapest rebalancing schedule: segment costs and a dynamic programme over frames.

Frames of a run are few; the pairs of (frame rebalanced at, frame) reach the driver, bounded by
``MOST_FRAMES`` frames.  The work model makes a frame dearer by a tenth for each frame since the last
rebalancing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_FRAMES = 2_000
SEGMENTS_SQL = ", seg AS (SELECT a.frame AS lb_frame, b.frame AS frame, b.cost * (1 + 0.1::DOUBLE * (b.frame - a.frame)) AS cost FROM fr a JOIN fr b ON a.frame <= b.frame)"


def segments(frames: DataFrame) -> DataFrame:
    """``lb_frame, frame, cost``: a frame's cost under each partition it may run with."""
    last = frames.agg(F.min("frame").alias("lo"))
    own = frames.crossJoin(F.broadcast(last)).select("frame", "cost", F.explode(F.sequence("lo", "frame")).alias("lb_frame"))
    started = frames.select(F.col("frame").alias("lb_frame"))
    return own.join(started, "lb_frame").select("lb_frame", "frame", (F.col("cost") * (1 + 0.1 * (F.col("frame") - F.col("lb_frame")))).alias("cost"))


def best_schedule(costs: dict[tuple[int, int], float], frames: list[int], lb_cost: float) -> tuple[float, list[int]]:
    """The least total and the frames to rebalance at; the first frame's rebalancing is free."""
    best = {0: (0.0, [])}
    for end in range(1, len(frames) + 1):
        options = []
        for start in range(end):
            total, chosen = best[start]
            run = sum(costs[frames[start], frames[k]] for k in range(start, end))
            options.append((total + run + (lb_cost if start else 0.0), [*chosen, frames[start]]))
        best[end] = min(options)
    return best[len(frames)]


def schedule(segment: DataFrame, lb_cost: float) -> DataFrame:
    """``frame, rebalance, total_cost`` of the cheapest schedule."""
    rows = segment.limit(MOST_FRAMES * (MOST_FRAMES + 1) // 2 + 1).collect()
    costs = {(x["lb_frame"], x["frame"]): x["cost"] for x in rows}
    frames = sorted({f for _, f in costs})
    if len(frames) > MOST_FRAMES:
        raise ValueError(f"more than {MOST_FRAMES} frames")
    total, chosen = best_schedule(costs, frames, lb_cost) if frames else (0.0, [])
    out = [(f, f in chosen, round(total, 4)) for f in frames]
    return segment.sparkSession.createDataFrame(out, "frame bigint, rebalance boolean, total_cost double")
