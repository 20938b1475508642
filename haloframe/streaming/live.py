"""A criterion decided while a run's iterations arrive, by Structured Streaming with a state for each run."""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from haloframe.plans.session import shared_folder


def decide(rows: DataFrame, cost: float) -> DataFrame:
    """``run, iteration`` of the decisions over a stream of ``run, iteration, u``.

    The imbalance since the last decision is summed until it reaches ``cost``.  Batches come in order; rows
    inside one are sorted.  The state is one number a run.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (total,) = state.get if state.exists else (0.0,)
        batch, fired = pd.concat(list(frames)).sort_values("iteration"), []
        for iteration, u in zip(batch["iteration"], batch["u"], strict=True):
            total += u
            if total >= cost:
                fired.append(int(iteration))
                total = 0.0
        state.update((float(total),))
        yield pd.DataFrame({"run": [key[0]] * len(fired), "iteration": fired}).astype({"run": "int32", "iteration": "int64"})

    return rows.groupBy("run").applyInPandasWithState(step, "run int, iteration bigint", "total double", "append", GroupStateTimeout.NoTimeout)


def replay(rows: DataFrame, cost: float) -> DataFrame:
    """``rows`` written to the shared folder, streamed from there through ``decide``, and the decisions read again."""
    spark = rows.sparkSession
    folder = f"{shared_folder(spark)}/live-{uuid4()}"
    own = rows.select("run", "iteration", "u")
    own.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(own.schema).parquet(f"{folder}/in")
    writer = decide(stream, cost).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("run int, iteration bigint").parquet(f"{folder}/out")
