"""Neighbour counts without pairs, and the neighbour join with crowded cells split up.

A particle meets all particles of the 3**N cells around its own.  How many there are follows from the cell histogram alone: one
three-point sum a dimension, so 3 * N copies of a filled cell instead of a row for each pair.  The same sums tell in advance which
cells the join would crowd, so that these are split by the size they will have.

Ids are distinct.  Rows without a position are in no cell and meet nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haloframe.plans.session import cut
from haloframe.sources.particles import POSITION

#: A cell is crowded if it makes more than one in so many of all pairs.
SHARE = 500


def histogram(celled: DataFrame, dims=POSITION, keys: tuple[str, ...] = ()) -> DataFrame:
    """``c<dim>, n``: rows of each filled cell (and of each of further ``keys``)."""
    cells = [f"c{d}" for d in dims]
    return celled.where(reduce(Column.__and__, [F.col(c).isNotNull() for c in cells])).groupBy(*keys, *cells).agg(F.count(F.lit(1)).alias("n"))


def around(counts: DataFrame, dims=POSITION) -> DataFrame:
    """``c<dim>, n, total``: for each filled cell of a histogram, also the rows of all cells around it, its own among them.

    Each dimension adds up three neighbours along one axis; a cell's own count travels in a column of its own, which tells the
    filled cells from those that merely lie beside one.
    """
    cells = [f"c{d}" for d in dims]
    sums = counts.select(*cells, "n", F.col("n").alias("total"))
    for c in cells:
        shifted = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("shift")
        spread = sums.select("*", shifted).select(*[(F.col(k) + F.col("shift")).alias(k) if k == c else k for k in cells], F.when(F.col("shift") == 0, F.col("n")).otherwise(0).alias("n"), "total")
        sums = spread.groupBy(*cells).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    return sums.where("n > 0")


def cell_interactions(celled: DataFrame, dims=POSITION) -> DataFrame:
    """``c<dim>, n, interactions``: in each filled cell, the rows and their ordered pairs, each row also counted itself."""
    return around(histogram(celled, dims), dims).select(*[f"c{d}" for d in dims], "n", (F.col("n") * F.col("total")).alias("interactions"))


def part_interactions(celled: DataFrame, dims=POSITION, part: str = "part") -> DataFrame:
    """``part, n, interactions``: the same by the receivers' part, which may share its cells with others."""
    own = histogram(celled, dims, (part,))
    cells = [f"c{d}" for d in dims]
    totals = around(own.groupBy(*cells).agg(F.sum("n").alias("n")), dims).select(*cells, "total")
    return own.join(totals, cells).groupBy(part).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("total")).alias("interactions"))


def pair_count(celled: DataFrame, dims=POSITION) -> DataFrame:
    """One row: ``pairs`` (ordered, of different rows) and ``interactions`` (with each row itself)."""
    return cell_interactions(celled, dims).agg(
        F.coalesce(F.sum(F.col("interactions") - F.col("n")), F.lit(0)).alias("pairs"), F.coalesce(F.sum("interactions"), F.lit(0)).alias("interactions")
    )


def crowded(receivers: DataFrame, sources: DataFrame, dims=POSITION, share: int = SHARE) -> DataFrame:
    """``c<dim>, side``: the cells that are to be split, and into how many rows and columns.

    The copies of receivers and the sources of a cell are counted by the stencil; their product is the cell's pairs.  Fewer than
    ``share`` cells make more than one in ``share`` of all pairs, however many rows there are.
    """
    cells = [f"c{d}" for d in dims]
    met = histogram(receivers, dims).select(*cells, F.col("n").alias("receivers"), F.lit(0).cast("bigint").alias("sources"))
    both = met.unionByName(histogram(sources, dims).select(*cells, F.lit(0).cast("bigint").alias("receivers"), F.col("n").alias("sources")))
    for c in cells:
        spread = both.select("*", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("shift"))
        spread = spread.select(*[(F.col(k) + F.col("shift")).alias(k) if k == c else k for k in cells], "receivers", F.when(F.col("shift") == 0, F.col("sources")).otherwise(0).alias("sources"))
        both = spread.groupBy(*cells).agg(F.sum("receivers").alias("receivers"), F.sum("sources").alias("sources"))
    work = cut(both.where("sources > 0").select(*cells, (F.col("receivers").cast("double") * F.col("sources")).alias("work")))
    pairs = max(1.0, work.agg(F.sum("work")).first()[0] or 0.0)
    return work.where(F.col("work") * share > pairs).select(*cells, F.ceil(F.sqrt(F.col("work") * share / F.lit(pairs))).cast("int").alias("side"))


def split_pairs(receivers: DataFrame, sources: DataFrame, dims=POSITION, share: int = SHARE) -> DataFrame:
    """The pairs of ``spatial.neighbour_pairs`` with the rows of crowded cells dealt out.

    A crowded cell becomes a square of ``side`` by ``side`` keys: its receivers are dealt to the rows and its sources to the columns by
    hashes of their ids, and each is copied along its row or column there only.  So a pair meets once, and no key makes many more pairs
    than one in ``share`` of all.
    """
    cells = [f"c{d}" for d in dims]
    hot = F.broadcast(crowded(receivers, sources, dims, share))
    near = receivers
    for c in cells:
        near = near.withColumn(c, F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1)))
    side = F.coalesce("side", F.lit(1))
    dealt, copied = F.pmod(F.xxhash64("gid"), side).cast("int"), F.explode(F.sequence(F.lit(0), side - 1))
    near = near.join(hot, cells, "left").withColumn("salt", dealt).withColumn("salt_s", copied).drop("side")
    there = sources.select("gid", *dims, *cells).join(hot, cells, "left").withColumn("salt_s", dealt).withColumn("salt", copied).drop("side")
    there = there.withColumnsRenamed({c: f"{c}_s" for c in ("gid", *dims)})
    return near.join(there, [*cells, "salt", "salt_s"]).drop("salt", "salt_s").where("gid <> gid_s")
