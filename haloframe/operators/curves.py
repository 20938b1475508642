"""Parts of equal load along a Hilbert curve, and what such a partition costs once the particles have moved on.

Cells, not particles, are put in order, so codes and cuts cost by filled cells.  Loads are added up along the curve by a scan over
blocks, and a cell's part is the share of the whole load that stands before it; so no part exceeds the fair share by more than its last cell.

Cells outside the cube that origin and bits span are taken at its border.  A table without rows has no parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haloframe.operators.scan import blocked, scan
from haloframe.sources.particles import POSITION


def _let(value: Column, use) -> Column:
    """``use`` applied to ``value``, which is evaluated once."""
    return F.transform(F.array(value), use)[0]


def hilbert(axes: list[Column], bits: int) -> Column:
    """The place of a cell on the Hilbert curve through a cube of ``2**bits`` cells a side.

    From the highest bit down, each axis that has it set turns the lower bits of the first one over, and any other swaps them with the
    first one's.  A Gray code of the axes, read bit by bit, is the place.
    """
    flipped = lambda a, b: a.bitwiseXOR(b)
    bit_set = lambda x, k: F.getbit(x, k) == 1
    below = lambda k: F.call_function("shiftleft", F.lit(1).cast("bigint"), k) - 1

    def turned(k: Column, i: int):
        def of(x: Column) -> Column:
            swap = flipped(x[0], x[i]).bitwiseAND(below(k))
            first = F.when(bit_set(x[i], k), flipped(x[0], below(k))).otherwise(flipped(x[0], swap))
            own = F.when(bit_set(x[i], k), x[i]).otherwise(flipped(x[i], swap))
            return F.array(*[first if j == 0 else own if j == i else x[j] for j in range(len(axes))])

        return of

    def level(x: Column, k: Column) -> Column:
        start = F.array(F.when(bit_set(x[0], k), flipped(x[0], below(k))).otherwise(x[0]), *[x[j] for j in range(1, len(axes))])
        for i in range(1, len(axes)):
            start = _let(start, turned(k, i))
        return start

    def coded(x: Column) -> Column:
        gray = [x[0]]
        for i in range(1, len(axes)):
            gray.append(flipped(x[i], gray[-1]))
        last = gray[-1]
        turn = F.aggregate(F.sequence(F.lit(1), F.lit(max(1, bits - 1))), F.lit(0).cast("bigint"), lambda t, k: F.when(bit_set(last, k), flipped(t, below(k))).otherwise(t))

        def read(y: Column) -> Column:
            digits = lambda code, k: sum((F.getbit(y[i], k).cast("bigint") * (1 << (len(axes) - 1 - i)) for i in range(len(axes))), code * (1 << len(axes)))
            return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), F.lit(0).cast("bigint"), digits)

        return _let(_let(turn, lambda t: F.array(*[flipped(g, t) for g in gray])), read)

    begin = F.array(*[a.cast("bigint") for a in axes])
    if bits < 2:
        return _let(begin, coded)
    return _let(F.aggregate(F.sequence(F.lit(bits - 1), F.lit(1), F.lit(-1)), begin, level), coded)


def coded_cells(cells: DataFrame, origin: int, bits: int, dims=POSITION) -> DataFrame:
    """``cells`` (``c<dim>``) with ``code``, their place on the curve."""
    inside = [F.least(F.greatest(F.col(f"c{d}") + origin, F.lit(0)), F.lit(2**bits - 1)) for d in dims]
    return cells.withColumn("code", hilbert(inside, bits))


def equal_loads(loads: DataFrame, parts: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """``keys, code, load, part`` of rows ``keys, code, load`` (a code once): each series of codes cut into parts of equal load."""
    names = list(keys) or ["whole"]
    rows = loads if keys else loads.withColumn("whole", F.lit(0))
    ranged = blocked(rows.select(*names, "code", F.col("load").cast("bigint").alias("load")), names, ["code"])
    upto = scan(ranged, names, ["code"], {"upto": ("sum", F.col("load"))})
    total = F.broadcast(ranged.groupBy(*names).agg(F.sum("load").alias("total"))) if not keys else ranged.groupBy(*names).agg(F.sum("load").alias("total"))
    before = (F.col("upto") - F.col("load")).cast("decimal(38,0)") * parts
    part = F.when(F.col("total") > 0, F.least(F.floor(before / F.greatest(F.col("total"), F.lit(1))), F.lit(parts - 1))).otherwise(0)
    return upto.join(total, names).select(*keys, "code", "load", part.cast("int").alias("part"))


def by_hilbert(celled: DataFrame, loads: DataFrame, parts: int, origin: int, bits: int, dims=POSITION) -> DataFrame:
    """``celled`` rows with ``part``; ``loads`` (``c<dim>, load``) holds every filled cell.  Cells that share a code share a part."""
    cells = [f"c{d}" for d in dims]
    coded = coded_cells(loads, origin, bits, dims)
    cut = equal_loads(coded.groupBy("code").agg(F.sum("load").alias("load")), parts).select("code", "part")
    return celled.join(coded.select(*cells, "code").join(cut, "code").drop("code"), cells)


def drifted(particles: DataFrame, frames: int, dt: float, dims=POSITION) -> DataFrame:
    """``frame, gid, <dim>``: each particle where its velocity takes it by each frame."""
    rows = particles.withColumn("frame", F.explode(F.sequence(F.lit(0), F.lit(frames - 1))))
    return rows.select("frame", "gid", *[(F.col(d) + F.col(f"v{d}") * (F.col("frame") * F.lit(dt))).alias(d) for d in dims])


def segment_loads(histogram: DataFrame, parts: int) -> DataFrame:
    """``lb_frame, frame, cost``: the largest part's rows in each frame, under the partition made at each frame up to it.

    ``histogram``: ``frame, code, n``.  A partition is the codes at which its parts begin; each later frame's cells look theirs up
    there as of the last beginning that is not behind them (cells before the first one belong to the first part).
    """
    made = equal_loads(histogram.select("frame", "code", F.col("n").alias("load")), parts, ("frame",))
    starts = made.groupBy(F.col("frame").alias("lb_frame"), "part").agg(F.min("code").alias("code"))
    asked = histogram.withColumn("lb_frame", F.explode(F.sequence(F.lit(0).cast("int"), F.col("frame").cast("int")))).join(histogram.select(F.col("frame").alias("lb_frame")).distinct(), "lb_frame")
    both = starts.select("lb_frame", "code", F.lit(0).alias("asks"), "part", F.lit(None).cast("int").alias("frame"), F.lit(0).cast("bigint").alias("n")).unionByName(
        asked.select("lb_frame", "code", F.lit(1).alias("asks"), F.lit(None).cast("int").alias("part"), F.col("frame").cast("int"), F.col("n").cast("bigint"))
    )
    rows = blocked(both, ["lb_frame"], ["code", "asks"])
    found = scan(rows, ["lb_frame"], ["code", "asks"], {"of": ("last", F.col("part"))}).where("asks = 1")
    held = found.groupBy("lb_frame", "frame", F.coalesce("of", F.lit(0)).alias("of")).agg(F.sum("n").alias("n"))
    return held.groupBy("lb_frame", "frame").agg(F.max("n").alias("cost"))
