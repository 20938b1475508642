"""Particle tables: flat columns ``gid, x, y, z, vx, vy, vz``, so that expressions stay in codegen."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POSITION, VELOCITY = ("x", "y", "z"), ("vx", "vy", "vz")


def from_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position and velocity from the first six components of each embedding."""
    part = lambda i: F.get("embedding", F.lit(i)).cast("double")
    names = POSITION + VELOCITY
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        F.col("vec_id").alias("gid"), *[part(i).alias(c) for i, c in enumerate(names)]
    )


def from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in the unit cube dealt out by the keys of orders, at rest."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        k.alias("gid"),
        (((k * 7919) % 10007) / F.lit(10007.0)).alias("x"),
        (((c * 104729 + k * 31) % 10009) / F.lit(10009.0)).alias("y"),
        (((k * 15485863 + c * 17) % 10037) / F.lit(10037.0)).alias("z"),
        *[F.lit(0.0).alias(v) for v in VELOCITY],
    )


def parse_line(value: Column, dims: tuple[str, ...] = POSITION) -> list[Column]:
    """The first reals of a comma-separated line; further fields are ignored, missing ones are null."""
    parts = F.split(value, ",")
    return [F.try_element_at(parts, F.lit(i + 1)).cast("double").alias(d) for i, d in enumerate(dims)]


def read_csv(spark: SparkSession, path: str, dims: tuple[str, ...] = POSITION) -> DataFrame:
    """A particle file: a line of reals for each row, no header."""
    return spark.read.text(path).select(*parse_line(F.col("value"), dims))


def hashed(seed: int = 0):
    """Draws uniform in (0, 1) that depend on the row's ``gid`` and the number of the draw alone, so a task run again draws the same."""
    return lambda k: (F.pmod(F.xxhash64("gid", k if isinstance(k, Column) else F.lit(k), F.lit(seed)), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))


def _around(r: Column, draw, dims: tuple[str, ...]) -> list[Column]:
    """A point at distance ``r`` in a direction uniform on the sphere; in two dimensions its shadow on the plane."""
    phi, theta = F.acos(2 * draw(1) - 1), 2 * F.pi() * draw(2)
    at = (r * F.sin(phi) * F.sin(theta), r * F.sin(phi) * F.cos(theta), r * F.cos(phi))
    return [c.alias(d) for c, d in zip(at, dims, strict=False)]


def in_ball(ids: DataFrame, radius: float, inner: float = 0.0, dims: tuple[str, ...] = POSITION, draw=None) -> DataFrame:
    """A point for each ``gid``, uniform between two spheres around 0."""
    draw = draw or hashed()
    return ids.select("gid", *_around(F.cbrt(draw(0) * (radius**3 - inner**3) + inner**3), draw, dims))


def on_sphere(ids: DataFrame, radius: float, dims: tuple[str, ...] = POSITION, draw=None) -> DataFrame:
    """A point for each ``gid``, uniform on a sphere around 0."""
    return ids.select("gid", *_around(F.lit(radius), draw or hashed(), dims))


def outside_ball(ids: DataFrame, size: float, centre: tuple[float, ...] = (0.0, 0.0, 0.0), draw=None, tries: int = 40) -> DataFrame:
    """A point for each ``gid``, normal about ``centre`` with deviation ``size / 2``, kept outside the ball of that radius.

    The first try outside is taken.  None of 40 is outside once in about 10^16 points of a plane, or 10^28 of space; then the
    last one is moved outwards along its ray, so that no row is lost.
    """
    draw, names = draw or hashed(), POSITION[: len(centre)]
    normal = lambda t, k: F.sqrt(-2 * F.log(draw(t * 8 + 2 * k))) * F.cos(2 * F.pi() * draw(t * 8 + 2 * k + 1))
    made = F.transform(F.sequence(F.lit(1), F.lit(tries)), lambda t: F.struct(*[(normal(t, k) * (size / 2)).alias(c) for k, c in enumerate(names)]))
    square = lambda p: sum((p[c] * p[c] for c in names), F.lit(0.0))
    drawn = ids.select("gid", made.alias("made"))
    outside = F.get(F.filter("made", lambda p: square(p) > size * size / 4), F.lit(0))
    chosen = drawn.select("gid", outside.alias("p"), F.element_at("made", -1).alias("q"))
    longer = F.lit(size / 2 * 1.000001) / F.sqrt(square(F.col("q")))
    return chosen.select("gid", *[(F.coalesce(F.col("p")[c], F.col("q")[c] * longer) + m).alias(c) for c, m in zip(names, centre, strict=True)])


#: Knots for each unit of -log(u), and units: draws are no less than 2**-53.
KNOTS, UNITS = 64, 38


@lru_cache(maxsize=1)
def _radii() -> tuple[np.ndarray, np.ndarray]:
    """``(r**2 - 1) / 2`` and its slope at each knot ``z``, for the radius that a normal point of space, being beyond 1, exceeds with chance ``exp(-z)``."""
    beyond = lambda t: math.erfc(math.sqrt((1 + 2 * t) / 2)) + math.sqrt((1 + 2 * t) * 2 / math.pi) * math.exp(-(1 + 2 * t) / 2)
    density = lambda t: math.sqrt(2 * (1 + 2 * t) / math.pi) * math.exp(-(1 + 2 * t) / 2)
    at, slopes, t = [], [], 0.0
    for k in range(KNOTS * UNITS + 2):
        goal = math.log(beyond(0.0)) - k / KNOTS
        for _ in range(60):
            step = (math.log(beyond(t)) - goal) * beyond(t) / density(t)
            t += step
            if abs(step) < 1e-15 * (1 + t):
                break
        at.append(t)
        slopes.append(beyond(t) / density(t) / KNOTS)
    return np.array(at), np.array(slopes)


def radius_beyond(u: Column, dims: int) -> Column:
    """The distance of a standard normal point of the plane or of space, given that it is beyond 1; ``u`` is uniform in (0, 1).

    In the plane the square is exponential behind 1.  In space its distribution is inverted at evenly spaced knots and
    between them by cubics of the same slopes, to ten digits.
    """
    z = -F.log(u)
    if dims == 2:
        return F.sqrt(1 + 2 * z)
    at, slopes = map(F.lit, _radii())
    k = F.least(F.floor(z * KNOTS), F.lit(KNOTS * UNITS)).cast("int")
    s = z * KNOTS - k
    value = (1 + 2 * s) * (1 - s) * (1 - s) * F.get(at, k) + s * (1 - s) * (1 - s) * F.get(slopes, k) + s * s * (3 - 2 * s) * F.get(at, k + 1) + s * s * (s - 1) * F.get(slopes, k + 1)
    return F.sqrt(1 + 2 * value)


def beyond_ball(ids: DataFrame, size: float, centre: tuple[float, ...] = (0.0, 0.0, 0.0), draw=None) -> DataFrame:
    """A point for each ``gid``, normal about ``centre`` with deviation ``size / 2`` and outside the ball of that radius.

    The distance is drawn by inversion and the direction uniformly, so every row has its point at once: what ``outside_ball``
    finds by trying, without a number of tries.
    """
    draw, names = draw or hashed(), POSITION[: len(centre)]
    r, turn = radius_beyond(draw(0), len(centre)) * (size / 2), 2 * F.pi() * draw(1)
    if len(centre) == 2:
        at = (r * F.cos(turn), r * F.sin(turn))
    else:
        rise = 2 * draw(2) - 1
        flat = F.sqrt(1 - rise * rise)
        at = (r * flat * F.cos(turn), r * flat * F.sin(turn), r * rise)
    return ids.select("gid", *[(c + m).alias(n) for c, m, n in zip(at, centre, names, strict=True)])
