"""Partition assignment, migration counts, halos and per-part work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haloframe.operators.halos import near_boxes
from haloframe.plans.session import cut
from haloframe.sources.particles import POSITION


def by_grid(rc: float, parts: int) -> Column:
    """Cells dealt round robin."""
    return F.pmod(sum((F.floor(F.col(d) / F.lit(rc)) for d in POSITION), F.lit(0)), F.lit(parts)).cast("int")


def quantiles(rows: DataFrame, dim: str, shares: list[float], part: str = "part", most: int = 4096) -> DataFrame:
    """``part, ends``: exact interpolated quantiles of each part, without gathering its values.

    A histogram of ``most`` equal ranges between the ends tells in which range each wanted order statistic lies;
    such a range is split again, until it holds ``most`` values or a single one.  Only counts of ranges are kept,
    pre-aggregated, and the values of the last ranges.
    """
    values = rows.where(F.col(dim).isNotNull()).select(part, F.col(dim).alias("v"))
    spans = values.groupBy(part).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count(F.lit(1)).alias("n"))
    at = [F.lit(q) * (F.col("n") - 1) for q in shares]
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(k), F.ceil(k)) for k in at])))
    found = cut(spans.select(part, "n", F.explode(ranks).alias("rank"), "low", "high", F.col("n").alias("c"), F.lit(0).cast("bigint").alias("below")))
    wide = (F.col("low") < F.col("high")) & (F.col("c") > most)

    def near(spans: DataFrame) -> DataFrame:
        few = spans.select(part, "low", "high").distinct()  # as many a part as it has wanted ranks, at most
        return values.join(F.broadcast(few), part).where("v BETWEEN low AND high")

    while not found.where(wide).isEmpty():
        slot = F.least(F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * most), F.lit(most - 1))
        ranges = near(found.where(wide)).groupBy(part, "low", "high", slot.alias("slot")).agg(F.count(F.lit(1)).alias("held"), F.min("v").alias("from"), F.max("v").alias("to"))
        before = Window.partitionBy(part, "low", "high").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)  # ``most`` ranges
        ranges = ranges.withColumn("start", F.coalesce(F.sum("held").over(before), F.lit(0)))
        split = found.where(wide).join(ranges, [part, "low", "high"]).withColumn("start", F.col("below") + F.col("start"))
        inside = split.where((F.col("rank") >= F.col("start")) & (F.col("rank") < F.col("start") + F.col("held")))
        narrowed = inside.select(part, "n", "rank", F.col("from").alias("low"), F.col("to").alias("high"), F.col("held").alias("c"), F.col("start").alias("below"))
        found = cut(found.where(~wide).unionByName(narrowed))
    last = near(found.where("low < high")).groupBy(part, "low", "high").agg(F.array_sort(F.collect_list("v")).alias("held"))
    chosen = F.coalesce(F.get("held", (F.col("rank") - F.col("below")).cast("int")), "low")
    named = found.join(last, [part, "low", "high"], "left").select(part, "n", "rank", chosen.alias("v"))
    held = named.groupBy(part, "n").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))
    value = lambda k: F.element_at("at", F.floor(k)) + (k - F.floor(k)) * (F.element_at("at", F.ceil(k)) - F.element_at("at", F.floor(k)))
    return held.select(part, F.array(*[value(k) for k in at]).alias("ends"))


def by_stripes(particles: DataFrame, parts: int, dim: str = "x") -> DataFrame:
    """``part`` by quantiles of one coordinate; the quantiles are one row."""
    ends = cut(quantiles(particles.withColumn("whole", F.lit(0)), dim, [k / parts for k in range(1, parts)], "whole").select("ends"))  # used wherever the parts are
    return particles.crossJoin(F.broadcast(ends)).withColumn("part", F.size(F.filter("ends", lambda q: q < F.col(dim)))).drop("ends")


def by_bisection(particles: DataFrame, dims=("x", "y")) -> DataFrame:
    """Recursive coordinate bisection: each part halved at the median of the next dimension."""
    own = particles.withColumn("part", F.lit(0))
    for d in dims:
        medians = quantiles(own, d, [0.5]).select("part", F.get("ends", F.lit(0)).alias("middle"))
        own = own.join(F.broadcast(medians), "part").withColumn("part", (F.col("part") * 2 + (F.col(d) > F.col("middle")).cast("int")))
        own = own.drop("middle")
    return own


def by_morton(rc: float, origin: int, bits: int, parts: int) -> Column:
    """Cells in Morton order, cut into equal ranges of codes."""
    code = F.lit(0).cast("bigint")
    for k, d in enumerate(POSITION):
        c = F.least(F.greatest(F.floor(F.col(d) / F.lit(rc)) + origin, F.lit(0)), F.lit(2**bits - 1))
        for b in range(bits):
            code = code + F.floor(c / F.lit(2**b)) % 2 * (2 ** (3 * b + k))
    return F.floor(code * parts / F.lit(2 ** (3 * bits))).cast("int")


def domains(parted: DataFrame) -> DataFrame:
    """Each part's box."""
    return parted.groupBy("part").agg(*[f(d).alias(f"{d}{n}") for d in POSITION for f, n in ((F.min, "lo"), (F.max, "hi"))])


def ghosts(parted: DataFrame, rc: float) -> DataFrame:
    """``gid, part, to``: particles within ``rc`` of another part's box, by an index of the boxes."""
    boxes = domains(parted).withColumnRenamed("part", "to")
    near = near_boxes(parted.select("gid", "part", *POSITION), boxes, rc)
    return near.where(F.col("part") != F.col("to")).select("gid", "part", "to")
