"""Time stepping: kick, drift, reflection, and the full step."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haloframe.operators.spatial import cell, pair_forces
from haloframe.plans.session import cut
from haloframe.sources.particles import POSITION


def clamped(v: Column, rc: float, dt: float) -> Column:
    """A velocity that would cross a cell in one step becomes half a cell a step, its sign lost."""
    return F.when((F.abs(v * dt) >= rc) | F.isnan(v), F.lit(0.5 * rc / dt)).otherwise(v)


def kick_drift(particles: DataFrame, rc: float, dt: float, dims=POSITION, acceleration: dict[str, Column] | None = None) -> DataFrame:
    """Half a kick by the ``acceleration`` of each dimension (none: 0), the clamp, and the drift."""
    half = {d: F.col(f"v{d}") + acceleration[d] * dt / 2 if acceleration else F.col(f"v{d}") for d in dims}
    kicked = particles.withColumns({f"v{d}": clamped(half[d], rc, dt) for d in dims})
    return kicked.withColumns({d: F.col(d) + F.col(f"v{d}") * dt for d in dims})


def kick(particles: DataFrame, dt: float, acceleration: dict[str, Column], dims=POSITION) -> DataFrame:
    """The second half kick, without a clamp."""
    return particles.withColumns({f"v{d}": F.col(f"v{d}") + acceleration[d] * dt / 2 for d in dims})


@dataclass(frozen=True)
class Box:
    low: float
    high: float
    bounce: float = 1.0


@dataclass(frozen=True)
class Sphere:
    radius: float
    centre: tuple[float, ...] = (0.0, 0.0, 0.0)


def reflect(particles: DataFrame, boundary: Box | Sphere, dims=POSITION) -> DataFrame:
    """What left the boundary is mirrored back into it."""
    if isinstance(boundary, Box):
        return reflect_box(particles, boundary.low, boundary.high, boundary.bounce, dims)
    return reflect_sphere(particles, boundary.radius, dims, boundary.centre).drop("is_valid")


def reflect_box(particles: DataFrame, low: float, high: float, bounce: float, dims=POSITION) -> DataFrame:
    """Mirrors what is beyond the low wall, then what is beyond the high wall, dimension by dimension."""
    for wall, beyond in ((low, lambda x: x < low), (high, lambda x: x > high)):
        changed = {}
        for d in dims:
            x, v = F.col(d), F.col(f"v{d}")
            mirrored = 2 * F.lit(wall) - x
            changed[d] = F.when(beyond(x), mirrored + (1 - bounce) * (wall - mirrored)).otherwise(x)
            changed[f"v{d}"] = F.when(beyond(x), -v * bounce).otherwise(v)
        particles = particles.withColumns(changed)
    return particles


def reflect_sphere(particles: DataFrame, radius: float, dims=POSITION, centre: tuple[float, ...] | None = None) -> DataFrame:
    """Mirrors particles outside a sphere (around 0 or ``centre``) at where their path met it; ``is_valid`` tells if it did."""
    if centre is not None and any(centre):
        moved = particles.withColumns({d: F.col(d) - m for d, m in zip(dims, centre, strict=True)})
        back = reflect_sphere(moved, radius, dims)
        return back.withColumns({d: F.col(d) + m for d, m in zip(dims, centre, strict=True)})
    dot = lambda a, b: sum((F.col(p) * F.col(q) for p, q in zip(a, b, strict=True)), F.lit(0.0))
    vel = [f"v{d}" for d in dims]
    speed = F.sqrt(dot(vel, vel))
    own = particles.withColumns({f"u{d}": F.try_divide(F.col(f"v{d}"), speed) for d in dims})
    units = [f"u{d}" for d in dims]
    half, gap = dot(dims, units), dot(dims, dims) - radius * radius
    own = own.withColumn("delta", half * half - gap).withColumn("out", gap > 0)
    ok = F.col("out") & (F.col("delta") >= 0) & F.col(units[0]).isNotNull()
    root = F.sqrt(F.greatest(F.col("delta"), F.lit(0.0)))
    first, second = -half + root, -half - root
    own = own.withColumn("t", F.when(F.abs(first) <= F.abs(second), first).otherwise(second)).withColumn("hit", F.coalesce(ok, F.lit(False)))
    own = own.withColumns({f"n{d}": -(F.col(d) + F.col("t") * F.col(f"u{d}")) / F.lit(radius) for d in dims})
    normals = [f"n{d}" for d in dims]
    depth = sum(((F.col(d) + F.col(n) * radius) * F.col(n) for d, n in zip(dims, normals, strict=True)), F.lit(0.0))
    own = own.withColumn("depth", depth).withColumn("along", dot(vel, normals))
    changed = {d: F.when(F.col("hit"), F.col(d) - 2 * F.col("depth") * F.col(f"n{d}")).otherwise(F.col(d)) for d in dims}
    changed |= {f"v{d}": F.when(F.col("hit"), F.col(f"v{d}") - 2 * F.col("along") * F.col(f"n{d}")).otherwise(F.col(f"v{d}")) for d in dims}
    return own.withColumns(changed).withColumn("is_valid", F.col("hit") | ~F.col("out")).select(*particles.columns, "is_valid")


def step(particles: DataFrame, rc: float, dt: float, eps: float, sig: float, low: float, high: float, bounce: float = 1.0) -> DataFrame:
    """One step: sources are found in the cells they had before the drift, everything else is after it.

    Most particles stay in their cell, and each two of those are met once.
    """
    before = {f"o{d}": cell(d, rc) for d in POSITION}
    moved = reflect_box(kick_drift(particles.select("gid", *POSITION, "vx", "vy", "vz").withColumns(before), rc, dt), low, high, bounce)
    moved = moved.withColumn("stayed", reduce(Column.__and__, [F.col(f"o{d}") == cell(d, rc) for d in POSITION]))
    receivers = moved.withColumns({f"c{d}": cell(d, rc) for d in POSITION}).drop(*before)
    sources = moved.withColumnsRenamed({f"o{d}": f"c{d}" for d in POSITION})
    forced = pair_forces(receivers, sources, eps, sig, same="stayed").drop("stayed")
    return forced.withColumns({f"v{d}": F.col(f"v{d}") + F.col(f"f{d}") * dt / 2 for d in POSITION})


def simulate(particles: DataFrame, steps: int, **how) -> DataFrame:
    """``steps`` steps, each cut from its lineage by a checkpoint."""
    for k in range(steps):
        particles = step(particles, **how)
        if k + 1 < steps:
            particles = cut(particles)
    return particles
