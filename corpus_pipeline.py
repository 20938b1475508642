"""A training corpus in five stages, from ``documents`` to packed sequences."""

from __future__ import annotations

from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from haloframe.llm import jaccard, lines, packing, quality, tiling
from haloframe.llm.common import ensure_checkpoint_dir

STAGES = [
    ("quality_classifier", quality.stage),
    ("line_dedup", lines.stage),
    ("jaccard_join", jaccard.stage),
    ("decontamination", tiling.stage),
    ("packing", packing.stage),
]

#: Quality, tiling and packing have no SQL form; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """The stages in order, each written as Parquet in the shared folder and read again.

    Null texts are empty, rows with a null id are documents like others, and repeated rows are one group of copies; each stage's module says what
    it makes of them.  Columns besides those of ``documents`` are carried up to the last stage.  An empty table gives no pieces.

    Given the ``folder`` of a run that broke off, it goes on behind the last stage that was finished there.  Folders are
    left for whoever named them, or the checkpoint folder, to clear.
    """
    ensure_checkpoint_dir(spark)
    folder = folder or f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid4()}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        if not _finished(spark, f"{folder}/{name}-finished"):
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{folder}/{name}")
            spark.range(1).write.mode("overwrite").parquet(f"{folder}/{name}-finished")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs


def _finished(spark: SparkSession, mark: str) -> bool:
    try:
        return not spark.read.parquet(mark).isEmpty()
    except AnalysisException:  # there is no such path
        return False
