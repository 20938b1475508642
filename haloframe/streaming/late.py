"""Iteration times, interval times and rebalancing decisions in event time, from rows that come late and out of order.

Work is summed by run, iteration and rank in windows of event time; a window's row leaves once the watermark has passed its end, so
rows may come as late as the watermark's delay, in any order.  A second state for each run takes these sums, a row a rank: a
timer at an iteration's end closes it, in order of iterations, and only then is it decided whether to rebalance.  The state of a
run holds its open iterations and three numbers.

Results: a row for each closed iteration of a run.  A row that is later than the delay counts as long as its window has not been
closed (that is done in the batch after the one that moved the watermark); behind that it is dropped, as if it had never been: its iteration
keeps the values it was closed with, and one that has lost all its rows is missing.  Iterations whose end the watermark has not
passed are still open and not in the result.  Rows without a time or a run are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from haloframe.plans.session import shared_folder
from haloframe.sources.traces import BUCKET_SECONDS, RANKS

DELAY = "1 day"
#: 2024-01-01 00:00:00 UTC, where iteration 0 begins.
EPOCH = 1704067200
CLOSED = "run bigint, iteration bigint, max_it double, min_it double, sum_it double, lb_interval_time double, decision boolean"
#: State stores of each operator of a stream, which keeps their number for life; each holds its share of the runs.
STORES = 4
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def rank_times(rows: DataFrame, delay: str = DELAY, seconds: int = BUCKET_SECONDS) -> DataFrame:
    """``run, iteration, it_time, time`` of a stream of ``run, rank, ts, value``: a row a rank for each window the watermark has passed."""
    window = F.window("ts", f"{seconds} seconds")
    summed = rows.where("run IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", delay).groupBy("run", window, "rank").agg(F.round(F.sum("value"), 6).alias("it_time"))
    iteration = F.floor((F.unix_seconds("window.start") - EPOCH) / F.lit(seconds)).alias("iteration")
    return summed.select(F.col("run").cast("bigint"), iteration, "it_time", F.window_time("window").alias("time"))


class Decisions(StatefulProcessor):
    """The cumulative criterion over iterations that close in order."""

    def __init__(self, cost: float, ranks: int, seconds: int):
        self.cost, self.ranks, self.seconds = cost, ranks, seconds

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "iteration bigint", "max_it double, min_it double, sum_it double")
        # The sum since the last decision, what the last iteration adds to it, and the time since the last decision.
        self.sums = handle.getValueState("sums", "cum double, pending double, since double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for iteration, t in zip(batch["iteration"], batch["it_time"], strict=True):
                at, t = (int(iteration),), float(t)
                high, low, total = self.open.getValue(at) if self.open.containsKey(at) else (t, t, 0.0)
                self.open.updateValue(at, (max(high, t), min(low, t), total + t))
                self.handle.registerTimer((at[0] + 1) * self.seconds * 1000 + EPOCH * 1000)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = (expiredTimerInfo.getExpiryTimeInMs() // 1000 - EPOCH) // self.seconds
        closing = sorted((k[0], v) for k, v in self.open.iterator() if k[0] < upto)
        cum, pending, since = self.sums.get() if self.sums.exists() else (0.0, 0.0, 0.0)
        closed = []
        for iteration, (high, low, total) in closing:
            self.open.removeKey((iteration,))
            cum += pending
            fires = cum >= self.cost
            cum, since = (0.0, high) if fires else (cum, since + high)
            pending = high - total / self.ranks
            closed.append((int(key[0]), iteration, high, low, total, since, fires))
        self.sums.update((cum, pending, since))
        yield pd.DataFrame(closed, columns=[c.split()[0] for c in CLOSED.split(", ")])

    def close(self) -> None:
        pass


def decide(rows: DataFrame, cost: float, delay: str = DELAY, ranks: int = RANKS, seconds: int = BUCKET_SECONDS) -> DataFrame:
    """``CLOSED`` of a stream of ``run, rank, ts, value``; its session keeps state in RocksDB."""
    return rank_times(rows, delay, seconds).groupBy("run").transformWithStateInPandas(
        statefulProcessor=Decisions(cost, ranks, seconds), outputStructType=CLOSED, outputMode="Append", timeMode="eventTime", eventTimeColumnName=""
    )


def run_stream(spark: SparkSession, folder: str, schema: str, cost: float, delay: str = DELAY, stores: int = STORES) -> DataFrame:
    """The files of ``folder``, in order of their age, through ``decide`` to their end; each is a batch."""
    session = spark.newSession()  # what stores there are is a setting of the stream's session alone
    session.conf.set(_STORE, _ROCKSDB)
    session.conf.set("spark.sql.shuffle.partitions", stores)
    out = f"{shared_folder(spark)}/late-{uuid4()}"
    stream = session.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    writer = decide(stream, cost, delay).writeStream.format("parquet").option("path", f"{out}/closed").option("checkpointLocation", f"{out}/log")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(CLOSED).parquet(f"{out}/closed")


def arrive(rows: DataFrame, folder: str, batches: int, late: int) -> None:
    """``rows`` written as so many files in order of arrival: each row comes up to ``late`` seconds after its time, by a hash of it.

    A last file holds a row of no work a long time later, which moves the watermark over all the others.
    """
    arrival = F.unix_seconds("ts") + F.pmod(F.xxhash64("run", "rank", "ts", "value"), F.lit(late))
    ends = rows.agg(F.min(arrival).alias("lo"), F.max(arrival).alias("hi")).first()
    if ends["lo"] is None:
        return
    width = (ends["hi"] - ends["lo"]) // batches + 1
    own = rows.withColumn("batch", F.floor((arrival - ends["lo"]) / F.lit(width)).cast("int"))
    names = rows.columns
    for batch in range(batches):
        own.where(F.col("batch") == batch).select(*names).coalesce(1).write.mode("append").parquet(folder)
    last = rows.limit(1).select(*[F.timestamp_seconds(F.lit(ends["hi"] + 10**8)).alias(c) if c == "ts" else F.lit(-1).cast(t).alias(c) if c == "run" else F.lit(0).cast(t).alias(c) for c, t in rows.dtypes])
    last.write.mode("append").parquet(folder)


def replay(rows: DataFrame, cost: float, batches: int = 6, late: int = 80_000, delay: str = DELAY, stores: int = STORES) -> DataFrame:
    """``CLOSED`` of ``run, rank, ts, value`` (runs from 0), which arrive late and out of order, but within ``delay``."""
    spark = rows.sparkSession
    folder = f"{shared_folder(spark)}/arrived-{uuid4()}"
    arrive(rows, folder, batches, late)
    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    return run_stream(spark, folder, schema, cost, delay, stores).where("run >= 0")
