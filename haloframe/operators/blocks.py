"""Pairs of neighbouring cells as pairs of blocks.

The pairs of a short-range force grow with the square of the density, and a row for each of them costs far more than its arithmetic.
Here a cell's particles are dealt into blocks of about ``BLOCK`` rows, blocks of neighbouring cells are joined, and the pairs of blocks
are dealt out evenly, whichever cells they are of.  So a task holds some blocks at a time, no crowded cell lands in one task, and the
pairs themselves are made where they are used.  Where receivers and sources are the same rows, two blocks meet once: what one particle
does to another is what that does to it, turned round.  If only some rows are the same on both sides, blocks of these do so.

Rows without an id or without a cell meet nothing.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haloframe.operators.stencil import histogram
from haloframe.sources.particles import POSITION

#: Rows of a block, about.
BLOCK = 4096
#: Rows of a block whose pairs become rows: Spark holds all that it makes of one row of its input.
ROWS_BLOCK = 256
#: Pairs held as arrays at a time: some 250 KB an array, which a core's cache holds.
AT_ONCE = 32_768
#: Pairs, counted in both orders, that a task is to make: some ten seconds of forces.
PAIRS_A_TASK = 1 << 30
#: Pairs that a task is to make as rows, about half a minute if they are written; and so many blocks a side then go to one task together.
ROWS_A_TASK, TOGETHER = 1 << 26, 8
#: Up to so many tasks, Spark's own number of them does; more than the most cost more than they spread.
FEW, MOST_TASKS = 16, 1 << 14


def blocks(rows: DataFrame, held: Column, dims=POSITION, block: int = BLOCK, keys: tuple[str, ...] = ()) -> DataFrame:
    """``c<dim>, block, held``: each filled cell's rows (and of each of further ``keys``) as arrays of ``held``, dealt by hashes of their ids.

    Only cells of more than ``block`` rows need a deal, and there is at most one of them for so many rows: these go to every task, so
    rows are shuffled by cell and block only, and a crowded cell's rows never lie together.
    """
    cells = [*keys, *[f"c{d}" for d in dims]]
    crowded = F.broadcast(histogram(rows, dims, keys).where(F.col("n") > block))
    dealt = F.coalesce(F.pmod(F.xxhash64("gid"), F.ceil(F.col("n") / F.lit(block))), F.lit(0).cast("bigint")).alias("block")
    filed = reduce(Column.__and__, [F.col(c).isNotNull() for c in ("gid", *cells)])
    own = rows.where(filed).join(crowded, cells, "left").select(*cells, dealt, held.alias("held"))
    return own.groupBy(*cells, "block").agg(F.collect_list("held").alias("held"))


def tasks_for(receivers: DataFrame, sources: DataFrame, dims=POSITION, each: int | None = None) -> int:
    """How many tasks make ``each`` (else ``PAIRS_A_TASK``) pairs at most, by the largest number of pairs that the cells' counts allow."""
    sides = [receivers] if receivers is sources else [receivers, sources]
    squares = [histogram(rows, dims).agg(F.sum(F.col("n").cast("double") * F.col("n"))).first()[0] or 0.0 for rows in sides]
    return min(MOST_TASKS, math.ceil(3 ** len(dims) * math.sqrt(squares[0] * squares[-1]) / (each or PAIRS_A_TASK)))


def block_pairs(receivers: DataFrame, sources: DataFrame, held: Column, dims=POSITION, block: int = BLOCK, once: bool | str = False, each: int | None = None, together: int = 1) -> DataFrame:
    """``mine, theirs``: the blocks of receivers with each block of sources in a neighbouring cell, dealt out by hashes of both.

    Full blocks make the same number of pairs a byte, so what Spark deals out by bytes is dealt out by pairs; where they are many,
    the cells are counted first and as many tasks made as ``each`` takes; then ``together`` blocks of one cell go with as many of another to
    one task, which so holds few ids.  If receivers and sources are the same rows, two blocks can
    meet ``once``: ``twice`` then tells those that stand for both orders from a block with itself.
    ``once`` can also name a column of both sides, true for the rows that are the same on both, their cell among it: these have blocks of
    their own, which meet once, and all others meet in the orders that their cells give.
    """
    cells = [f"c{d}" for d in dims]
    own = [f"{c}_r" for c in cells]
    keys = (once,) if isinstance(once, str) else ()
    kinds = [f"{k}_{side}" for k in keys for side in ("r", "s")]
    tasks = tasks_for(receivers, sources, dims, each)
    if keys:
        receivers, sources = (rows.withColumn(once, F.coalesce(once, F.lit(False))) for rows in (receivers, sources))
    mine = blocks(receivers, held, dims, block, keys).withColumnsRenamed({"held": "mine"} | {k: f"{k}_r" for k in keys})
    mine = mine.withColumns({r: F.col(c) for r, c in zip(own, cells, strict=True)})
    for c in cells:
        mine = mine.withColumn(c, F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1)))
    theirs = blocks(sources, held, dims, block, keys).withColumnsRenamed({"held": "theirs", "block": "block_s"} | {k: f"{k}_s" for k in keys})
    if once is True:
        mine = mine.where(F.struct(*own) <= F.struct(*cells))
    near = mine.join(theirs, cells)
    if once:
        here, there = F.struct(*own, "block"), F.struct(*cells, "block_s")
        same = reduce(Column.__and__, map(F.col, kinds), F.lit(True))
        near = near.where(~same | (here <= there)).withColumn("twice", same & (here < there))
    by = [*cells, "block_s", *own, "block", *kinds]
    if tasks > FEW:
        dealt = [F.floor(F.col(b) / F.lit(together)) if b in ("block", "block_s") else F.col(b) for b in by]
        return near.repartition(max(tasks, near.sparkSession.sparkContext.defaultParallelism), *dealt).drop(*by)
    return near.repartition(*by).drop(*by)


def id_pairs(receivers: DataFrame, sources: DataFrame, dims=POSITION, block: int = ROWS_BLOCK) -> DataFrame:
    """``gid, gid_s``: ordered pairs of different particles in neighbouring cells.

    A row costs far more than a pair's force, so a task makes fewer of them.  Rows of few ids make small files: their dictionaries hold.
    """
    near = block_pairs(receivers, sources, F.col("gid"), dims, block, each=ROWS_A_TASK, together=TOGETHER)
    return near.select(F.explode("mine").alias("gid"), "theirs").select("gid", F.explode("theirs").alias("gid_s")).where("gid <> gid_s")


def force_parts(receivers: DataFrame, sources: DataFrame, eps: float, sig: float, dims=POSITION, block: int = BLOCK, same: str | None = None) -> DataFrame:
    """``gid, f<dim>, interactions``: for each receiver and each block that it meets, the summed Lennard-Jones force and the pairs.

    Given the same DataFrame as receivers and sources, each two particles' coefficient is computed once.  So it is for the rows that a
    column ``same`` of both sides names as those with one cell and one position on either.
    """
    held = F.struct("gid", *[F.col(d).cast("double").alias(d) for d in dims])
    near = block_pairs(receivers, sources, held, dims, block, once=receivers is sources or same or False)
    kind = receivers.schema["gid"].dataType.simpleString()

    def summed(batches):
        for batch in batches:
            yield _sums(batch, eps, sig, [f"f{d}" for d in dims])

    return near.mapInArrow(summed, f"gid {kind}, {', '.join(f'f{d} double' for d in dims)}, interactions bigint")


class _Side:
    """One side's blocks of a batch: where each starts, and the ids and positions of all of them, and which positions are null.

    Also what each of them gets from the ``other`` side: the force and how many rows it meets.
    """

    def __init__(self, lists: pa.ListArray, other: pa.ListArray):
        self.sizes = lists.value_lengths().to_numpy()
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.gid, *places = lists.flatten().flatten()
        self.ids = self.gid.to_numpy(zero_copy_only=False)
        self.lost = [np.asarray(p.is_null()) for p in places]
        self.gone = reduce(np.logical_or, self.lost)
        self.at = [p.fill_null(0.0).to_numpy() for p in places]
        self.force = np.zeros((len(places), len(self.ids)))
        self.met = np.repeat(other.value_lengths().to_numpy(), self.sizes).astype(np.int64)


def _coefficient(apart: list[np.ndarray], eps: float, sig: float, unknown: np.ndarray | None = None) -> np.ndarray:
    """``vectors.lj_coefficient`` of displacements, operation by operation; an ``unknown`` distance is the least one, as in ``greatest``."""
    near, other = apart[0] * apart[0], np.empty_like(apart[0])
    for d in apart[1:]:
        near += np.multiply(d, d, out=other)
    if unknown is not None:
        near[unknown] = 0.0
    np.divide(1.0, np.maximum(near, sig * sig, out=near), out=near)
    sixth = np.multiply(near, near, out=other)
    sixth *= near
    k = sixth * (-48.0 * eps * sig**12)
    k += 24.0 * eps * sig**6
    k *= sixth
    k *= near
    return k


def _sums(batch: pa.RecordBatch, eps: float, sig: float, names: list[str]) -> pa.RecordBatch:
    mine, theirs = _Side(batch.column(0), batch.column(1)), _Side(batch.column(1), batch.column(0))
    twice = batch.column(2).to_numpy(zero_copy_only=False) if batch.num_columns > 2 else np.zeros(batch.num_rows, bool)
    if not pa.types.is_integer(mine.gid.type):  # one numbering of both sides' ids
        both = pa.concat_arrays([mine.gid, theirs.gid]).dictionary_encode().indices.to_numpy()
        mine.ids, theirs.ids = both[: len(mine.ids)], both[len(mine.ids) :]
    large = mine.sizes.astype(np.int64) * theirs.sizes > AT_ONCE // 4
    for k in np.flatnonzero(large):
        own, other = (slice(s.starts[k], s.starts[k] + s.sizes[k]) for s in (mine, theirs))
        _dense(mine, theirs, own, other, twice[k], eps, sig)
    # Small pairs of blocks are put together, a row for each pair of particles.
    rows = np.flatnonzero(~np.repeat(large, mine.sizes))
    sizes, first, turned = (np.repeat(x, mine.sizes) for x in (theirs.sizes, theirs.starts, twice))
    ends = np.cumsum(sizes[rows])
    cuts = np.searchsorted(ends, np.arange(AT_ONCE, ends[-1] if len(ends) else 0, AT_ONCE), "left")
    for part in np.split(rows, np.unique(cuts)):
        if len(part):
            _flat(mine, theirs, part, sizes[part], first[part], turned[part], eps, sig)
    back = np.repeat(twice, theirs.sizes)
    gid = pa.concat_arrays([mine.gid, theirs.gid.filter(pa.array(back))])
    sums = [np.concatenate([a, b[back]]) for a, b in zip((*mine.force, mine.met), (*theirs.force, theirs.met), strict=True)]
    return pa.RecordBatch.from_arrays([gid, *map(pa.array, sums)], names=["gid", *names, "interactions"])


def _dense(mine: _Side, theirs: _Side, own: slice, other: slice, twice: bool, eps, sig) -> None:
    """Some receivers at a time against a whole block."""
    width = other.stop - other.start
    ids, gone = theirs.ids[other], theirs.gone[other]
    odd = gone.any() or mine.gone[own].any() or np.isin(mine.ids[own], ids).any()
    for start in range(own.start, own.stop, step := max(1, AT_ONCE // width)):
        rows = slice(start, min(start + step, own.stop))
        apart = [a[rows, None] - b[None, other] for a, b in zip(mine.at, theirs.at, strict=True)]
        k = _coefficient(apart, eps, sig, gone | mine.gone[rows, None] if odd else None)
        if odd:
            same = mine.ids[rows, None] == ids
            mine.met[rows] -= same.sum(1)
            theirs.met[other] -= same.sum(0)
            k[same] = 0.0
            for d, a, b in zip(apart, mine.lost, theirs.lost, strict=True):
                d[same | a[rows, None] | b[other]] = 0.0
        for f, g, d in zip(mine.force, theirs.force, apart, strict=True):
            if twice:
                d *= k
                f[rows] = d.sum(1)
                g[other] -= d.sum(0)
            else:
                f[rows] = np.vecdot(k, d)


def _flat(mine: _Side, theirs: _Side, rows, sizes, first, twice, eps, sig) -> None:
    """Receivers of several blocks, each against the block that begins at ``first``."""
    i = np.repeat(np.arange(len(rows)), sizes)
    j = np.arange(len(i)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first, sizes)
    own, turned = rows[i], twice[i]
    apart = [a[own] - b[j] for a, b in zip(mine.at, theirs.at, strict=True)]
    k = _coefficient(apart, eps, sig, theirs.gone[j] | mine.gone[own])
    same = mine.ids[own] == theirs.ids[j]
    k[same] = 0.0
    for d, a, b in zip(apart, mine.lost, theirs.lost, strict=True):
        d[same | a[own] | b[j]] = 0.0
    for f, g, d in zip(mine.force, theirs.force, apart, strict=True):
        d *= k
        f[rows] = np.bincount(i, d, len(rows))
        np.subtract.at(g, j[turned], d[turned])
    mine.met[rows] -= np.bincount(i[same], minlength=len(rows))
    np.subtract.at(theirs.met, j[same], 1)
