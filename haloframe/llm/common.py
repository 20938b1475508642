"""Helpers shared by the operators: cutting lineage, size-checked broadcasts, connected components."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a narrow side of a join is broadcast; counted first, beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000
#: Bytes up to which a side of wide rows is broadcast; summed first, beyond it the join shuffles.
BROADCAST_BYTES = 16 << 20
#: A key is hot if it holds more than one in so many rows; so there are fewer hot keys than that.
HOT_SHARE = 1_000
SALTS = 64
#: Rows of an Arrow batch where the session names no other number: whole texts that a task holds at once.
BATCH_ROWS = 1_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in ``spark.checkpoint.dir``; only a local session gets an own one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="haloframe-")
    context.setCheckpointDir(named)


def ensure_small_batches(spark: SparkSession) -> None:
    """Arrow batches of ``BATCH_ROWS`` rows, unless the session or the cluster names a number of its own.

    Spark reads this setting when a lazy result is computed, so it stays set for the session.
    """
    if spark.sparkContext.getConf().get(_BATCH) is None and spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, BATCH_ROWS)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder: computed once, and safe from lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def small(df: DataFrame) -> DataFrame:
    """``df``, which is cut and has narrow rows, with a broadcast hint if they are few enough; otherwise unchanged."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def join_side(left: DataFrame, right: DataFrame, on: list[str], size: Column | int, spread: str | None = None, how: str = "left") -> DataFrame:
    """``left`` joined to ``right`` (cut, one row a key; rows of ``size`` bytes), which is broadcast if it is small.

    Beyond that, the hot keys of a join on one key are dealt out by a hash of ``spread``, where it is given.
    """
    size = F.lit(size) if isinstance(size, int) else size
    if (right.agg(F.sum(size.cast("bigint") + 64)).first()[0] or 0) <= BROADCAST_BYTES:
        return left.join(F.broadcast(right), on, how)
    return join_hot(left, right, on[0], spread, how) if spread else left.join(right, on, how)


def join_keyed(left: DataFrame, right: DataFrame, key: str, spread: str) -> DataFrame:
    """``left`` inner-joined to ``right`` (cut, narrow) on ``key``: broadcast if it has few rows, else as ``join_hot`` does."""
    return left.join(F.broadcast(right), key) if right.count() <= BROADCAST_ROWS else join_hot(left, right, key, spread, "inner")


def join_hot(left: DataFrame, right: DataFrame, key: str, spread: str, how: str = "left") -> DataFrame:
    """``left`` joined (left or inner) to ``right`` on ``key``, hot keys dealt out by a hash of ``spread``.

    Hot keys of ``left`` are fewer than ``HOT_SHARE`` whatever its size, so they are broadcast, and only
    their rows of ``right`` are copied ``SALTS`` times.  Rows with a null key match nothing.
    """
    counts = cut(left.groupBy(key).count())
    rows = counts.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    hot = F.broadcast(counts.where(F.col("count") * HOT_SHARE > rows).select(key, F.lit(True).alias("__halo_hot")))
    salt = F.when(F.col("__halo_hot"), F.pmod(F.xxhash64(spread), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    every = F.when(F.col("__halo_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    dealt = left.join(hot, key, "left").withColumn("__halo_salt", salt).drop("__halo_hot")
    copied = right.join(hot, key, "left").withColumn("__halo_salt", F.explode(every)).drop("__halo_hot")
    return dealt.join(copied, [key, "__halo_salt"], how).drop("__halo_salt")


def text_key(text: Column) -> Column:
    """A 128-bit identity of a text, the same for equal texts; nulls are equal to each other only."""
    return F.coalesce(F.unhex(F.md5(text)), F.lit(b""))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges ``(a, b)`` as ``(node, component)``.

    ``component`` is the smallest node that can be reached.  Large-star and small-star rounds
    alternate (each point's neighbours are linked to the smallest of them) until every edge points
    at its component's smallest node; edges that do so from the start need no round.  A round is two
    partially aggregated minima and joins, so no neighbourhood is ever gathered.  Rows with a null end
    and loops are left out.
    """
    links = cut(
        edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    )
    while not _are_stars(links):
        links = cut(_round(links))
    ends = F.explode(F.array(F.struct(F.col("hi").alias("node"), F.col("lo").alias("component")), F.struct(F.col("lo").alias("node"), F.col("lo").alias("component"))))
    return links.select(ends.alias("of")).select("of.*").distinct()


def _round(links: DataFrame) -> DataFrame:
    """A large-star and a small-star step."""
    pair = lambda a, b: F.struct(F.col(a).alias("u"), F.col(b).alias("v"))
    both = links.select(F.explode(F.array(pair("hi", "lo"), pair("lo", "hi"))).alias("p")).select("p.u", "p.v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
    starred = large.join(large.groupBy("hi").agg(F.min("lo").alias("m")), "hi")
    return starred.select(F.explode(F.array(pair("hi", "m"), pair("lo", "m"))).alias("p")).select(F.col("p.u").alias("hi"), F.col("p.v").alias("lo")).where("hi <> lo").distinct()


def _are_stars(links: DataFrame) -> bool:
    """Whether no node both points and is pointed at, nor points at two."""
    end = lambda c, up: F.struct(F.col(c).alias("node"), F.lit(up).alias("up"))
    ends = links.select(F.explode(F.array(end("hi", 1), end("lo", 0))).alias("e")).groupBy("e.node").agg(F.sum("e.up").alias("up"), F.min("e.up").alias("least"))
    return ends.agg(F.count_if((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("least") == 0)))).first()[0] == 0
