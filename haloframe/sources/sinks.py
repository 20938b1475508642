"""Text sinks: particle frames and metric series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haloframe.functions.vectors import formatted

# The header of a frame; blanks belong to it.
HEADERS = {2: ["x coord", "y coord ", "rank"], 3: ["x coord", "y coord", "z coord ", "rank"]}


def write_frames(particles: DataFrame, path: str, frame: str = "frame", part: str = "part", dims: tuple[str, ...] = ("x", "y", "z")) -> None:
    """A folder of CSV files with a header for each frame: coordinates, then the part."""
    names = HEADERS[len(dims)]
    own = particles.select(F.col(frame).alias("frame"), *[F.col(c).alias(n) for c, n in zip((*dims, part), names, strict=True)])
    own.write.partitionBy("frame").option("ignoreTrailingWhiteSpace", False).csv(path, header=True)


def frame_lines(particles: DataFrame, frame: str = "frame", part: str = "part", dims: tuple[str, ...] = ("x", "y", "z"), separator: str = ",", precision: int = 6) -> DataFrame:
    """``frame, line``: each frame's header and a line for each particle, coordinates with so many digits, then the part."""
    rows = particles.select(F.col(frame).alias("frame"), F.concat_ws(separator, formatted([F.col(d) for d in dims], separator, precision), F.col(part).cast("string")).alias("line"))
    header = rows.select("frame").distinct().select("frame", F.lit(separator.join(HEADERS[len(dims)])).alias("line"))
    return header.unionByName(rows)


def series_lines(metrics: DataFrame, precision: int = 6) -> DataFrame:
    """``metric, iteration, line`` of ``iteration, metric, value``: the text of each value."""
    return metrics.select("metric", "iteration", formatted([F.col("value")], precision=precision).alias("line"))


def write_series(metrics: DataFrame, path: str) -> None:
    """A folder of text files for each metric of ``iteration, metric, value``, a value a line, in order of iteration."""
    ranged = metrics.repartitionByRange("metric", "iteration").sortWithinPartitions("metric", "iteration")
    ranged.select("metric", F.col("value").cast("string").alias("value")).write.partitionBy("metric").text(path)
