"""Which particles lie near which boxes: an interval join through an index of grids.

Each box, widened by the halo, is filed under the cells that it touches in a grid whose edge fits its size: a level doubles the
edge, and a box's level is the first at which it touches two cells (three, at a cell's border) in each dimension.  A particle is looked up in its one
cell of every level that has a box.  So the join is on equal keys, a pair meets once at most, and the exact test remains for what
meets.  Boxes that are alike use one level or two, whatever their number.

A box is closed on all sides.  Rows without a position, and boxes without all of their ends, meet nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haloframe.plans.session import cut
from haloframe.sources.particles import POSITION

#: Filed cells up to which the index is sent to all tasks; counted first, beyond it both sides are shuffled.
INDEX_ROWS = 500_000
#: Boxes of more levels of size than this are filed at the coarsest one.
MOST_LEVELS = 62
#: A cell is crowded if it holds more than one in so many of the looked-up rows.
SHARE = 500


def file_boxes(boxes: DataFrame, halo: float, dims=POSITION) -> DataFrame:
    """``boxes`` (``<dim>lo``, ``<dim>hi``) with ``level`` and ``k<dim>``: a row for each cell that a widened box touches."""
    width = F.greatest(*[F.col(f"{d}hi") - F.col(f"{d}lo") for d in dims]) if len(dims) > 1 else F.col(f"{dims[0]}hi") - F.col(f"{dims[0]}lo")
    level = F.least(F.greatest(F.ceil(F.log2((width + 2 * halo) / F.lit(halo))), F.lit(0)), F.lit(MOST_LEVELS)).cast("int")
    filed = boxes.where(reduce(Column.__and__, [F.col(f"{d}{end}").isNotNull() for d in dims for end in ("lo", "hi")])).withColumn("level", level)
    edge = F.lit(halo) * F.pow(F.lit(2.0), "level")
    for d in dims:
        # What the exact test lets in by rounding lies within a hair of the widened box.
        first, last = (F.floor((F.col(f"{d}{end}") + sign * (halo + edge * 1e-9)) / edge) for end, sign in (("lo", -1), ("hi", 1)))
        filed = filed.withColumn(f"k{d}", F.explode(F.sequence(first, last)))
    return filed


def near_boxes(particles: DataFrame, boxes: DataFrame, halo: float, dims=POSITION, most: int = INDEX_ROWS, share: int = SHARE) -> DataFrame:
    """Each row of ``particles`` with each row of ``boxes`` that it lies within ``halo`` of, in every dimension; once each.

    Columns of the two sides have different names.  An index of up to ``most`` cells goes to all tasks.  Beyond that, the lookups of
    cells that hold more than one in ``share`` of all are dealt out by salts, and only the boxes of these cells are copied to each salt.
    """
    keys = ["level", *[f"k{d}" for d in dims]]
    index = cut(file_boxes(boxes, halo, dims))
    filed = {row["level"]: row["count"] for row in index.groupBy("level").count().collect()}  # at most MOST_LEVELS rows
    edge = F.lit(halo) * F.pow(F.lit(2.0), "level")
    looked = particles.where(reduce(Column.__and__, [F.col(d).isNotNull() for d in dims])).withColumn("level", F.explode(F.array(*map(F.lit, filed)).cast("array<int>")))
    looked = looked.withColumns({f"k{d}": F.floor(F.col(d) / edge) for d in dims})
    near = [(F.col(d) + halo >= F.col(f"{d}lo")) & (F.col(d) - halo <= F.col(f"{d}hi")) for d in dims]
    if sum(filed.values()) <= most:
        joined = looked.join(F.broadcast(index), keys)
    else:
        counts = cut(looked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")))
        rows = counts.agg(F.sum("n")).first()[0] or 1
        # Fewer than ``share`` cells a level.
        hot = F.broadcast(counts.where(F.col("n") * share > rows).select(*keys, F.ceil(F.col("n") * share / F.lit(float(rows))).cast("int").alias("salts")))
        salts = F.coalesce("salts", F.lit(1))
        dealt = looked.join(hot, keys, "left").withColumn("salt", F.pmod(F.xxhash64(*dims), salts).cast("int")).drop("salts")
        copied = index.join(hot, keys, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
        joined = dealt.join(copied, [*keys, "salt"]).drop("salt")
    return joined.where(reduce(Column.__and__, near)).drop(*keys)
