"""Sums that start anew whenever they reach a threshold, resolved without walking through the series.

The sum since the last reset reaches the cost at the first iteration whose prefix sum is at least that of the reset plus the cost.
That is one as-of search for all iterations at once: where each of them would be followed by the next reset if it were one itself.
The resets are those on the chain of these pointers from the series' beginning, which doubling finds in as many rounds as the
number of resets has binary digits.  Every step is a scan over blocks or a join on a row's place, so a long run is spread over all tasks.

Summands are not negative (for the cumulative criterion, the largest time less the mean).  They are added up exactly, as
decimals of ``PLACES`` places; a fold over doubles differs only where its rounding decides.  A cost of 0 or less resets at every iteration.
Null summands count 0.  Iterations of a run are distinct.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haloframe.operators.scan import blocked, scan
from haloframe.plans.session import cut

PLACES = 9


def next_resets(rows: DataFrame, cost: float, value: str = "u", blocks: int | None = None) -> DataFrame:
    """``run, iteration, next``: the reset that follows one at that iteration (null: none); ``iteration`` null stands for the beginning."""
    kind = f"decimal(38,{PLACES})"
    exact = F.coalesce(F.col(value).cast(f"decimal(28,{PLACES})"), F.lit(0).cast(f"decimal(28,{PLACES})"))
    series = blocked(rows.select("run", "iteration", exact.alias("u")), ["run"], ["iteration"], blocks)
    sums = cut(scan(series, ["run"], ["iteration"], {"sum": ("sum", F.col("u"))}).select("run", "iteration", "sum"))
    if cost <= 0:
        last = scan(series, ["run"], ["iteration"], {"next": ("min", F.col("iteration"))}, inclusive=False, reverse=True)
        begin = rows.groupBy("run").agg(F.min("iteration").alias("next")).select("run", F.lit(None).cast("bigint").alias("iteration"), "next")
        return last.select("run", "iteration", "next").unionByName(begin)
    wanted = F.lit(str(cost)).cast(kind)
    begin = sums.select("run").distinct().select("run", F.lit(None).cast("bigint").alias("iteration"), wanted.alias("at"))
    starts = sums.select("run", "iteration", (F.col("sum") + wanted).cast(kind).alias("at")).unionByName(begin)
    # At equal sums a search stands before the points, which it may find; points of equal sum are told by iteration.
    both = starts.select("run", "at", F.lit(0).alias("point"), "iteration").unionByName(sums.select("run", F.col("sum").cast(kind).alias("at"), F.lit(1).alias("point"), "iteration"))
    placed = blocked(both, ["run"], ["at", "point"], blocks)
    # Prefix sums grow with the iteration, so the first point behind a search is the least one.
    found = scan(placed, ["run"], ["at", "point"], {"next": ("min", F.when(F.col("point") == 1, F.col("iteration")))}, reverse=True)
    return found.where("point = 0").select("run", "iteration", "next")


def chain(pointers: DataFrame) -> DataFrame:
    """``run, iteration``: what the pointers reach from each run's beginning (``iteration`` null), by doubling.

    A round follows the pointers of all reached places and then joins the pointers to themselves; it ends when none reaches further.
    """
    jumps = cut(pointers.where("iteration IS NOT NULL AND next IS NOT NULL"))
    reached = cut(pointers.where("iteration IS NULL AND next IS NOT NULL").select("run", F.col("next").alias("iteration")))
    while True:
        # Places reached are distinct: pointers lead upwards, each round twice as far.
        further = cut(reached.join(jumps, ["run", "iteration"]).select("run", F.col("next").alias("iteration")))
        if further.isEmpty():
            return reached
        reached = cut(reached.unionByName(further))
        ahead = jumps.select("run", F.col("iteration").alias("next"), F.col("next").alias("beyond"))
        jumps = cut(jumps.join(ahead, ["run", "next"]).select("run", "iteration", F.col("beyond").alias("next")))


def resets(rows: DataFrame, cost: float, value: str = "u", blocks: int | None = None) -> DataFrame:
    """``run, iteration``: where the sum of ``value`` since the last such iteration reaches ``cost``."""
    return chain(next_resets(rows, cost, value, blocks))
