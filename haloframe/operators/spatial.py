"""Cells, bounding boxes and the neighbour self-join.

The join replicates each receiver to its 3**N neighbour cells and joins on the cell key: an equi-join
that Spark shuffles or broadcasts, never a product.  Skewed cells are left to adaptive skew handling; forces and the pair
list go by ``blocks`` instead.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haloframe.operators.blocks import force_parts
from haloframe.operators.scan import blocked, scan
from haloframe.sources.particles import POSITION


def cell(position: str | Column, rc: float) -> Column:
    return F.floor(F.col(position) / F.lit(rc)) if isinstance(position, str) else F.floor(position / F.lit(rc))


def with_cells(particles: DataFrame, rc: float, dims=POSITION) -> DataFrame:
    return particles.withColumns({f"c{d}": cell(d, rc) for d in dims})


def bounding_box(particles: DataFrame, rc: float, dims=POSITION) -> DataFrame:
    """One row: each dimension's extent snapped to the grid and padded by a cell."""
    ends = {}
    for d in dims:
        ends[f"{d}min"] = F.floor(F.min(d) / F.lit(rc)) * F.lit(rc) - F.lit(rc)
        ends[f"{d}max"] = F.ceil(F.max(d) / F.lit(rc)) * F.lit(rc) + F.lit(rc)
    return particles.agg(*[v.alias(k) for k, v in ends.items()])


def extend_box(box: DataFrame, particles: DataFrame, rc: float, dims=POSITION) -> DataFrame:
    """A box (one row) widened to hold more particles, snapped to the grid and padded again; both sides are one row."""
    seen = particles.agg(*[f(d).alias(f"p{d}{n}") for d in dims for f, n in ((F.min, "min"), (F.max, "max"))])
    ends = {}
    for d in dims:
        ends[f"{d}min"] = F.floor(F.least(f"{d}min", f"p{d}min") / F.lit(rc)) * F.lit(rc) - F.lit(rc)
        ends[f"{d}max"] = F.ceil(F.greatest(f"{d}max", f"p{d}max") / F.lit(rc)) * F.lit(rc) + F.lit(rc)
    return box.crossJoin(seen).select(*[v.alias(k) for k, v in ends.items()])


def box_cells(box: DataFrame, rc: float, dims=POSITION) -> DataFrame:
    """Cells of a box by dimension (``n<dim>``), by the ceiling, and their product; none where the box is inside out."""
    counted = {f"n{d}": F.ceil(F.greatest(F.col(f"{d}max") - F.col(f"{d}min"), F.lit(0.0)) / F.lit(rc)).cast("bigint") for d in dims}
    return box.withColumns(counted).withColumn("cells", reduce(lambda a, b: a * b, [F.col(f"n{d}") for d in dims]))


def box_measures(box: DataFrame, dims=POSITION) -> DataFrame:
    """Centre and width by dimension, and the least and largest width."""
    width = {d: F.greatest(F.col(f"{d}max") - F.col(f"{d}min"), F.lit(0.0)) for d in dims}
    centre = [((F.col(f"{d}min") + F.col(f"{d}max")) / 2).alias(f"{d}centre") for d in dims]
    return box.select(*centre, *[w.alias(f"{d}width") for d, w in width.items()], F.least(*width.values()).alias("least_width"), F.greatest(*width.values()).alias("largest_width"))


def linear_cells(particles: DataFrame, rc: float) -> DataFrame:
    """``gid``, the cell within the snapped box (``i<dim>``), its number and the number with x and y truncated, and where it starts."""
    box = box_cells(bounding_box(particles, rc), rc)
    own = particles.select("gid", *POSITION).crossJoin(F.broadcast(box))  # one row
    place = {d: (F.col(d) - F.col(f"{d}min")) / F.lit(rc) for d in POSITION}
    number = lambda x, y, z: x + F.col("nx") * y + F.col("nx") * F.col("ny") * z
    cells = own.withColumns({f"i{d}": F.floor(place[d]) for d in POSITION})
    return cells.select(
        "gid",
        number(F.col("ix"), F.col("iy"), F.col("iz")).alias("linear"),
        number(place["x"].cast("bigint"), place["y"].cast("bigint"), F.col("iz")).alias("truncated"),
        "nx",
        "ny",
        *[(F.col(f"{d}min") + F.col(f"i{d}") * F.lit(rc)).alias(f"{d}start") for d in POSITION],
    )


def cell_of_number(linear: Column, nx: Column, ny: Column) -> tuple[Column, Column, Column]:
    """The cell of a number, by dimension."""
    rest = F.floor(linear / nx)
    return linear % nx, rest % ny, F.floor(rest / ny)


def neighbour_pairs(receivers: DataFrame, sources: DataFrame, dims=POSITION) -> DataFrame:
    """Ordered pairs of different particles in neighbouring cells.

    Both sides have ``gid``, the positions and cells ``c<dim>``; a source's columns end in ``_s``.
    """
    keys = [f"c{d}" for d in dims]
    around = receivers
    for d in dims:
        around = around.withColumn(f"c{d}", F.explode(F.sequence(F.col(f"c{d}") - 1, F.col(f"c{d}") + 1)))
    there = sources.select("gid", *dims, *keys).withColumnsRenamed({c: f"{c}_s" for c in ("gid", *dims)})
    return around.join(there, keys).where("gid <> gid_s")


def force_sums(receivers: DataFrame, sources: DataFrame, eps: float, sig: float, dims=POSITION, unary: dict[str, Column] | None = None, same: str | None = None) -> DataFrame:
    """Per receiver ``gid`` the summed force ``f<dim>``, on top of the ``unary`` one, and its interactions, itself counted.

    Pairs are made and summed by blocks (``blocks.force_parts``), so no row is made for one.  Every receiver adds a row of its own to
    the sums, so those without neighbours stay without a second join.  ``same`` is that of ``blocks.force_parts``.
    """
    each = force_parts(receivers, sources, eps, sig, dims, same=same)
    one = F.lit(1).cast("bigint").alias("interactions")
    own = receivers.select("gid", *[(unary[d] if unary else F.lit(0.0)).alias(f"f{d}") for d in dims], one)
    return each.unionByName(own).groupBy("gid").agg(*[F.sum(f"f{d}").alias(f"f{d}") for d in dims], F.sum("interactions").alias("interactions"))


def pair_forces(receivers: DataFrame, sources: DataFrame, eps: float, sig: float, dims=POSITION, unary: dict[str, Column] | None = None, same: str | None = None) -> DataFrame:
    """The receivers with their ``force_sums``, without cells."""
    return receivers.drop(*[f"c{d}" for d in dims]).join(force_sums(receivers, sources, eps, sig, dims, unary, same), "gid")


def local_ids(rows: DataFrame, part: str = "part", key: str = "gid") -> DataFrame:
    """Adds ``lid``: each part's rows numbered from 0 in order of ``key``, by a count over blocks of them, whatever the keys' density."""
    counted = scan(blocked(rows, [part], [key]), [part], [key], {"lid": ("count", F.lit(1))})
    return counted.withColumn("lid", F.col("lid") - 1).drop("block")
