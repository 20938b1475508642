"""All registered queries of the engine and their SQL.

Results are rounded, and ``+ 0.0`` makes one zero of both, so that sums in another order agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from haloframe.functions import vectors as V
from haloframe.operators import blocks, metrics, partitions, physics, search, spatial, stencil
from haloframe.sources import particles as sources
from haloframe.sources import traces
from haloframe.sources.particles import POSITION
from haloframe.streaming import live

RC, SIG, DT, COST, PARTS = 0.1, 0.05, 0.05, 2000.0, 4
BOX, RADIUS, FRAME = 0.25, 0.3, 10
STEP = {"rc": RC, "dt": DT, "eps": 0.001, "sig": SIG, "low": -BOX, "high": BOX}

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

P = """p AS (SELECT vec_id AS gid, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z,
 embedding[4]::DOUBLE AS vx, embedding[5]::DOUBLE AS vy, embedding[6]::DOUBLE AS vz FROM embeddings),
c AS (SELECT *, floor(x / 0.1::DOUBLE)::BIGINT AS cx, floor(y / 0.1::DOUBLE)::BIGINT AS cy, floor(z / 0.1::DOUBLE)::BIGINT AS cz FROM p)"""
T = """e AS (SELECT (floor(epoch(ts))::BIGINT - 1704067200) // 21600 AS iteration, (user_id % 4)::INT AS rank, value FROM events),
g AS (SELECT iteration, r::INT AS rank FROM (SELECT DISTINCT iteration FROM e), range(4) AS q(r)),
t AS (SELECT iteration, rank, coalesce(round(sum(value), 6), 0.0) AS it_time FROM g LEFT JOIN e USING (iteration, rank) GROUP BY ALL),
s AS (SELECT iteration, max(it_time) AS max_it, min(it_time) AS min_it, sum(it_time) AS sum_it, sum(it_time) / 4.0::DOUBLE AS avg_it,
 max(it_time) / nullif(sum(it_time) / 4.0::DOUBLE, 0) - 1 AS imbalance, max(it_time) - sum(it_time) / 4.0::DOUBLE AS imbalance_time,
 sum(it_time) / 4.0::DOUBLE / nullif(max(it_time), 0) AS efficiency FROM t GROUP BY iteration),
l AS (SELECT iteration, lag(max_it, 1, 0.0) OVER w AS max_it, lag(min_it, 1, 0.0) OVER w AS min_it, lag(sum_it, 1, 0.0) OVER w AS sum_it,
 lag(max_it, 1, 0.0) OVER w - lag(sum_it, 1, 0.0) OVER w / 4.0::DOUBLE AS u FROM s WINDOW w AS (ORDER BY iteration))"""


def query(sql: str | None = None, name: str | None = None):
    def register(function):
        key = name or function.__name__
        QUERIES[key] = function
        if sql:
            ORACLES[key] = sql
        return function

    return register


def particles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.from_embeddings(spark, sf_dir)


def celled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.with_cells(particles(spark, sf_dir), RC)


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.iteration_stats(traces.from_events(spark, sf_dir)).withColumn("run", F.lit(0))


def r(column, places: int = 4):
    return F.round(F.col(column) if isinstance(column, str) else column, places) + F.lit(0.0)


def rounded(df: DataFrame, keys: list[str], values: list[str], places: int = 4) -> DataFrame:
    return df.select(*keys, *[r(v, places).alias(v) for v in values])


def sql_rounded(keys: str, values: str, rest: str, places: int = 4) -> str:
    return f"SELECT {keys}, {', '.join(f'round({v}, {places}) + 0.0 AS {v}' for v in values.split())} FROM {rest}"


# Cells, boxes and filters


@query(f"WITH {P} SELECT cx, cy, cz, count(*) AS n FROM c GROUP BY ALL")
def cell_histogram(spark, d):
    return celled(spark, d).groupBy("cx", "cy", "cz").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {P} SELECT DISTINCT cx, cy, cz FROM c")
def nonempty_cells(spark, d):
    return celled(spark, d).select("cx", "cy", "cz").distinct()


_BOX_SQL = ", ".join(
    f"floor(min({a}) / 0.1::DOUBLE) * 0.1::DOUBLE - 0.1::DOUBLE AS {a}min, ceil(max({a}) / 0.1::DOUBLE) * 0.1::DOUBLE + 0.1::DOUBLE AS {a}max" for a in "xyz"
)


@query(f"WITH {P}, b AS (SELECT {_BOX_SQL} FROM p) {sql_rounded('1 AS one', 'xmin xmax ymin ymax zmin zmax', 'b', 6)}")
def bbox_snap(spark, d):
    box = spatial.bounding_box(particles(spark, d), RC)
    return rounded(box.withColumn("one", F.lit(1)), ["one"], box.columns, 6)


@query(f"WITH {P}, b AS (SELECT {_BOX_SQL} FROM p) SELECT {', '.join(f'round(({a}max - {a}min) / 0.1::DOUBLE)::BIGINT AS n{a}' for a in 'xyz')} FROM b")
def cell_dims(spark, d):
    box = spatial.bounding_box(particles(spark, d), RC)
    return box.select(*[F.round((F.col(f"{a}max") - F.col(f"{a}min")) / F.lit(RC)).cast("bigint").alias(f"n{a}") for a in POSITION])


@query(
    f"WITH {P}, i AS (SELECT gid, (cx + 50) + 100 * (cy + 50) + 10000 * (cz + 50) AS linear FROM c) SELECT gid, linear, "
    "linear % 100 - 50 AS cx, (linear // 100) % 100 - 50 AS cy, linear // 10000 - 50 AS cz FROM i"
)
def linear_cell_roundtrip(spark, d):
    own = celled(spark, d).select("gid", ((F.col("cx") + 50) + 100 * (F.col("cy") + 50) + 10000 * (F.col("cz") + 50)).alias("linear"))
    return own.select(
        "gid", "linear", F.expr("linear % 100 - 50 AS cx"), F.expr("(linear div 100) % 100 - 50 AS cy"), F.expr("linear div 10000 - 50 AS cz")
    )


@query(f"WITH {P} SELECT gid FROM p WHERE x >= -0.1 AND x < 0.1 AND y >= -0.1 AND y < 0.1 AND z >= -0.1 AND z < 0.1")
def box_filter(spark, d):
    inside = [(F.col(a) >= -0.1) & (F.col(a) < 0.1) for a in POSITION]
    return particles(spark, d).where(inside[0] & inside[1] & inside[2]).select("gid")


# Neighbour joins and forces


def _near(dims: str) -> str:
    return " AND ".join(f"abs(a.c{q} - b.c{q}) <= 1" for q in dims) + " AND a.gid <> b.gid"


def _forces(dims: str, eps: float, rest: str) -> str:
    r2 = " + ".join(f"(a.{q} - b.{q}) * (a.{q} - b.{q})" for q in dims)
    sums = ", ".join(f"sum(k * (x{q} - y{q})) AS f{q}" for q in dims)
    both = ", ".join(f"a.{q} AS x{q}, b.{q} AS y{q}" for q in dims)
    s12, s6 = 48.0 * eps * SIG**12, 24.0 * eps * SIG**6
    return f"""near AS (SELECT a.gid, {both}, 1.0 / greatest({r2}, {SIG * SIG!r}::DOUBLE) AS i FROM {rest}),
w AS (SELECT *, -((i * i * i) * ({s12!r}::DOUBLE * (i * i * i) - {s6!r}::DOUBLE) * i) AS k FROM near),
f AS (SELECT gid, {sums}, count(*) AS n FROM w GROUP BY gid)"""


for _dims in ("xy", "xyz"):

    @query(f"WITH {P} SELECT count(*) AS pairs, count(*) + (SELECT count(*) FROM p) AS interactions FROM c a JOIN c b ON {_near(_dims)}", f"pair_count_{len(_dims)}d")
    def _pair_count(spark, d, dims=tuple(_dims)):
        return stencil.pair_count(celled(spark, d), dims)

    @query(
        f"WITH {P}, {_forces(_dims, 1.0, f'c a JOIN c b ON {_near(_dims)}')} SELECT gid, "
        + ", ".join(f"round(coalesce(f{q}, 0), 4) + 0.0 AS f{q}" for q in _dims)
        + ", coalesce(n, 0) + 1 AS interactions FROM p LEFT JOIN f USING (gid)",
        f"lj_force_{len(_dims)}d",
    )
    def _lj_force(spark, d, dims=tuple(_dims)):
        own = celled(spark, d).select("gid", *POSITION, *[f"c{q}" for q in dims])
        return rounded(spatial.force_sums(own, own, 1.0, SIG, dims), ["gid", "interactions"], [f"f{q}" for q in dims])


@query(f"WITH {P} SELECT a.gid AS gid_a, b.gid AS gid_b FROM c a JOIN c b ON {_near('xyz')}")
def pair_list(spark, d):
    own = celled(spark, d)
    return blocks.id_pairs(own, own).select(F.col("gid").alias("gid_a"), F.col("gid_s").alias("gid_b"))


# Time stepping


def _clamp(q: str) -> str:
    return f"CASE WHEN abs(v{q} * {DT}::DOUBLE) >= {RC}::DOUBLE OR isnan(v{q}) THEN {0.5 * RC / DT!r}::DOUBLE ELSE v{q} END"


def _step_sql(before: str, k: int) -> str:
    lo, hi = f"(-{BOX}::DOUBLE)", f"{BOX}::DOUBLE"
    kick = ", ".join(f"{_clamp(q)} AS v{q}, {q} AS o{q}" for q in "xyz")
    drift = ", ".join(f"v{q}, o{q}, o{q} + v{q} * {DT}::DOUBLE AS {q}" for q in "xyz")
    low = ", ".join(f"o{q}, CASE WHEN {q} < {lo} THEN 2 * {lo} - {q} ELSE {q} END AS {q}, CASE WHEN {q} < {lo} THEN -v{q} ELSE v{q} END AS v{q}" for q in "xyz")
    high = ", ".join(f"o{q}, CASE WHEN {q} > {hi} THEN 2 * {hi} - {q} ELSE {q} END AS {q}, CASE WHEN {q} > {hi} THEN -v{q} ELSE v{q} END AS v{q}" for q in "xyz")
    near = " AND ".join(f"abs(floor(a.{q} / {RC}::DOUBLE) - floor(b.o{q} / {RC}::DOUBLE)) <= 1" for q in "xyz") + " AND a.gid <> b.gid"
    renamed = _forces("xyz", 0.001, f"h{k} a JOIN h{k} b ON {near}").replace("near AS", f"near{k} AS").replace("FROM near)", f"FROM near{k})").replace("\nw AS", f"\nw{k} AS").replace("FROM w GROUP", f"FROM w{k} GROUP").replace("\nf AS", f"\nf{k} AS")
    out = ", ".join(f"{q}, v{q} + coalesce(f{q}, 0) * {DT}::DOUBLE / 2 AS v{q}" for q in "xyz")
    return f"""k{k} AS (SELECT gid, {kick} FROM {before}), d{k} AS (SELECT gid, {drift} FROM k{k}), w_{k} AS (SELECT gid, {low} FROM d{k}),
h{k} AS (SELECT gid, {high} FROM w_{k}), {renamed}, p{k} AS (SELECT gid, {out}, coalesce(n, 0) + 1 AS interactions FROM h{k} LEFT JOIN f{k} USING (gid))"""


_STATE = ["x", "y", "z", "vx", "vy", "vz"]
for _steps in (1, 3):
    _ctes = ", ".join(_step_sql("p" if k == 1 else f"p{k - 1}", k) for k in range(1, _steps + 1))

    @query(f"WITH {P}, {_ctes} {sql_rounded('gid, interactions', ' '.join(_STATE), f'p{_steps}', 6)}", f"nbody_step_{_steps}")
    def _nbody(spark, d, steps=_steps):
        return rounded(physics.simulate(particles(spark, d), steps, **STEP), ["gid", "interactions"], _STATE, 6)


@query(f"WITH {P}, k AS (SELECT gid, {', '.join(f'{_clamp(q)} AS v{q}, {q}' for q in 'xyz')} FROM p), m AS (SELECT gid, {', '.join(f'v{q}, {q} + v{q} * {DT}::DOUBLE AS {q}' for q in 'xyz')} FROM k) {sql_rounded('gid', ' '.join(_STATE), 'm', 6)}")
def kick_drift(spark, d):
    return rounded(physics.kick_drift(particles(spark, d), RC, DT), ["gid"], _STATE, 6)


@query(f"WITH {P}, q AS (SELECT gid, {', '.join(f'v{q} * 20 AS v{q}' for q in 'xyz')} FROM p), k AS (SELECT gid, {', '.join(f'{_clamp(q)} AS v{q}' for q in 'xyz')} FROM q) {sql_rounded('gid', 'vx vy vz', 'k', 6)}")
def velocity_clamp(spark, d):
    fast = particles(spark, d).select("gid", *[(F.col(f"v{q}") * 20).alias(f"v{q}") for q in POSITION])
    return fast.select("gid", *[r(physics.clamped(F.col(f"v{q}"), RC, DT), 6).alias(f"v{q}") for q in POSITION])


def _reflect_sql(bounce: float) -> str:
    ctes, before = [], "p"
    for k, (op, wall) in enumerate((("<", "(-0.25::DOUBLE)"), (">", "0.25::DOUBLE"))):
        cols = ", ".join(
            f"CASE WHEN {q} {op} {wall} THEN (2 * {wall} - {q}) + {1 - bounce} * ({wall} - (2 * {wall} - {q})) ELSE {q} END AS {q}, "
            f"CASE WHEN {q} {op} {wall} THEN -v{q} * {bounce} ELSE v{q} END AS v{q}"
            for q in "xyz"
        )
        ctes.append(f"b{k} AS (SELECT gid, {cols} FROM {before})")
        before = f"b{k}"
    return f"WITH {P}, {', '.join(ctes)} {sql_rounded('gid', ' '.join(_STATE), before, 6)}"


@query(_reflect_sql(0.5))
def reflect_box(spark, d):
    return rounded(physics.reflect_box(particles(spark, d), -BOX, BOX, 0.5), ["gid"], _STATE, 6)


@query(
    f"""WITH {P}, u AS (SELECT *, sqrt(vx * vx + vy * vy + vz * vz) AS sp, x * x + y * y + z * z - 0.09 AS gap FROM p),
h AS (SELECT *, (x * vx + y * vy + z * vz) / nullif(sp, 0) AS half FROM u),
q AS (SELECT *, gap > 0 AND half * half - gap >= 0 AS hit, sqrt(greatest(half * half - gap, 0)) AS root FROM h),
t AS (SELECT *, CASE WHEN abs(-half + root) <= abs(-half - root) THEN -half + root ELSE -half - root END AS t FROM q),
n AS (SELECT *, {", ".join(f"-({q} + t * v{q} / nullif(sp, 0)) / 0.3 AS n{q}" for q in "xyz")} FROM t),
m AS (SELECT *, {" + ".join(f"({q} + n{q} * 0.3) * n{q}" for q in "xyz")} AS depth, {" + ".join(f"v{q} * n{q}" for q in "xyz")} AS along FROM n)
SELECT gid, coalesce(hit, false) OR gap <= 0 AS is_valid,
{", ".join(f"round(CASE WHEN hit THEN {q} - 2 * depth * n{q} ELSE {q} END, 6) + 0.0 AS {q}, round(CASE WHEN hit THEN v{q} - 2 * along * n{q} ELSE v{q} END, 6) + 0.0 AS v{q}" for q in "xyz")} FROM m"""
)
def reflect_sphere(spark, d):
    return rounded(physics.reflect_sphere(particles(spark, d), RADIUS), ["gid", "is_valid"], _STATE, 6)


# Partitions


def _parted(spark, d):
    return particles(spark, d).withColumn("part", partitions.by_grid(RC, PARTS))


_GRID = f"{P}, a AS (SELECT *, ((((cx + cy + cz) % 4) + 4) % 4)::INT AS part FROM c)"


@query(f"WITH {_GRID} SELECT gid, part FROM a")
def part_grid(spark, d):
    return _parted(spark, d).select("gid", "part")


_QUANTILES = "quantile_cont(x, [0.25, 0.5, 0.75])"


@query(f"WITH {P}, q AS (SELECT {_QUANTILES} AS e FROM p) SELECT gid, ((x > e[1])::INT + (x > e[2])::INT + (x > e[3])::INT) AS part FROM p, q")
def part_stripes(spark, d):
    return partitions.by_stripes(particles(spark, d), PARTS).select("gid", "part")


_RCB = f"{P}, h AS (SELECT *, (x > (SELECT quantile_cont(x, 0.5) FROM p))::INT AS half FROM p), m AS (SELECT half, quantile_cont(y, 0.5) AS middle FROM h GROUP BY half)"


@query(f"WITH {_RCB} SELECT gid, half * 2 + (y > middle)::INT AS part FROM h JOIN m USING (half)")
def part_rcb(spark, d):
    return partitions.by_bisection(particles(spark, d)).select("gid", "part")


_MORTON = " + ".join(f"((least(greatest(c{q} + 8, 0), 15) // {2**b}) % 2) * {2 ** (3 * b + k)}" for k, q in enumerate("xyz") for b in range(4))


@query(f"WITH {P} SELECT gid, (({_MORTON}) * 4 // 4096)::INT AS part FROM c")
def part_morton(spark, d):
    return particles(spark, d).select("gid", partitions.by_morton(RC, 8, 4, PARTS).alias("part"))


@query()
def migrate_matrix(spark, d):
    """How many rows each pair of parts exchanges when the grid gives way to bisection."""
    old, new = _parted(spark, d).select("gid", F.col("part").alias("src")), partitions.by_bisection(particles(spark, d)).select("gid", F.col("part").alias("dst"))
    return old.join(new, "gid").where("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


_MOVES = f"WITH {_GRID}, {_RCB.removeprefix(P)[2:]}, b AS (SELECT gid, half * 2 + (y > middle)::INT AS part FROM h JOIN m USING (half)), x AS (SELECT a.part AS src, b.part AS dst, count(*) AS n FROM a JOIN b USING (gid) WHERE a.part <> b.part GROUP BY ALL)"
ORACLES["migrate_matrix"] = f"{_MOVES} SELECT src, dst, n FROM x"


@query(f"{_MOVES} SELECT dst AS part, src AS from_part, n FROM x")
def invert_list(spark, d):
    return migrate_matrix(spark, d).select(F.col("dst").alias("part"), F.col("src").alias("from_part"), "n")


_BOXES = "bx AS (SELECT part AS dst, min(x) AS xlo, max(x) AS xhi, min(y) AS ylo, max(y) AS yhi, min(z) AS zlo, max(z) AS zhi FROM s4 GROUP BY part)"
_STRIPED = f"{P}, q AS (SELECT {_QUANTILES} AS e FROM p), s4 AS (SELECT p.*, ((x > e[1])::INT + (x > e[2])::INT + (x > e[3])::INT) AS part FROM p, q), {_BOXES}"
_OVERLAP = " AND ".join(f"{q} + 0.1::DOUBLE >= {q}lo AND {q} - 0.1::DOUBLE <= {q}hi" for q in "xyz")


@query(f"WITH {_STRIPED} SELECT part, dst AS to, count(*) AS n FROM s4 JOIN bx ON {_OVERLAP} AND part <> dst GROUP BY ALL")
def ghosts_per_part(spark, d):
    own = partitions.by_stripes(particles(spark, d), PARTS)
    return partitions.ghosts(own, RC).groupBy("part", "to").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_STRIPED}, g AS (SELECT DISTINCT part, dst FROM s4 JOIN bx ON {_OVERLAP} AND part <> dst), b AS (SELECT part, dst FROM g UNION SELECT dst, part FROM g) SELECT part, count(*) AS neighbours FROM b GROUP BY part")
def neighbor_ranks(spark, d):
    pairs = ghosts_per_part(spark, d).select("part", "to")
    both = pairs.union(pairs.select("to", "part"))
    return both.groupBy("part").agg(F.count_distinct("to").alias("neighbours"))


@query(f"WITH {_GRID}, n AS (SELECT a.gid, count(b.gid) AS k FROM c a LEFT JOIN c b ON {_near('xyz')} GROUP BY a.gid) SELECT part, (count(*) + sum(k))::BIGINT AS interactions FROM a JOIN n USING (gid) GROUP BY part")
def part_interactions(spark, d):
    own = celled(spark, d).withColumn("part", partitions.by_grid(RC, PARTS))
    return stencil.part_interactions(own).select("part", "interactions")


@query(f"WITH {_GRID}, n AS (SELECT part, count(*) AS k FROM a GROUP BY part) SELECT round(sum(k) / 4.0 / max(k), 6) + 0.0 AS efficiency FROM n")
def part_efficiency(spark, d):
    counts = _parted(spark, d).groupBy("part").agg(F.count(F.lit(1)).alias("k"))
    return counts.agg(r(F.sum("k") / F.lit(float(PARTS)) / F.max("k"), 6).alias("efficiency"))


# Metrics of the trace

_STATS = "max_it min_it sum_it avg_it imbalance imbalance_time efficiency"


@query(f"WITH {T} {sql_rounded('iteration', _STATS, 's', 6)}")
def iter_stats(spark, d):
    return rounded(stats(spark, d), ["iteration"], _STATS.split(), 6)


_SERIES = {
    "cum_time": ("sum(max_it) OVER (ORDER BY iteration)", lambda o: F.sum("max_it").over(o)),
    "suffix_time": ("sum(avg_it) OVER (ORDER BY iteration ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)", lambda o: F.sum("avg_it").over(o.rowsBetween(0, Window.unboundedFollowing))),
    "adjacent_diff": ("max_it - lag(max_it, 1, 0.0) OVER (ORDER BY iteration)", lambda o: F.col("max_it") - F.lag("max_it", 1, 0.0).over(o)),
    "exclusive_prefix": ("coalesce(sum(max_it) OVER (ORDER BY iteration ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)", lambda o: F.coalesce(F.sum("max_it").over(o.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))),
    "running_eff": ("avg(efficiency) OVER (ORDER BY iteration)", lambda o: F.avg("efficiency").over(o)),
    "median3": (
        "list_sort(list(max_it) OVER (ORDER BY iteration ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))[len(list(max_it) OVER (ORDER BY iteration ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) // 2 + 1]",
        lambda o: V.upper_median(F.collect_list("max_it").over(o.rowsBetween(-2, 0))),
    ),
}
for _name, (_sql, _column) in _SERIES.items():

    @query(f"WITH {T} SELECT iteration, round({_sql}, 4) + 0.0 AS value FROM s", _name)
    def _series(spark, d, column=_column):
        return stats(spark, d).select("iteration", r(column(metrics.ordered())).alias("value"))


_EPOCH = "cum_imbalance van_cum_imbalance lb_interval_time lb_effort"


@query(
    f"""WITH {T}, e1 AS (SELECT *, sum(((iteration + 1) % 10 = 0)::INT) OVER (ORDER BY iteration) AS epoch FROM s),
e2 AS (SELECT *, first(imbalance_time) OVER (PARTITION BY epoch ORDER BY iteration) AS base FROM e1),
e3 AS (SELECT iteration, sum(greatest(0.0, imbalance_time - base)) OVER w AS cum_imbalance, sum(imbalance_time) OVER w AS van_cum_imbalance,
 sum(max_it) OVER w AS lb_interval_time, sum(max_it) OVER w / count(*) OVER w AS lb_effort FROM e2 WINDOW w AS (PARTITION BY epoch ORDER BY iteration))
{sql_rounded("iteration", _EPOCH, "e3", 8)}"""
)
def epoch_imbalance(spark, d):
    return rounded(metrics.epochs(stats(spark, d), FRAME), ["iteration"], _EPOCH.split(), 8)


@query(f"WITH {T} SELECT iteration // 10 AS frame, round(sum(max_it), 4) + 0.0 AS frame_time FROM s GROUP BY 1")
def frame_time(spark, d):
    return stats(spark, d).groupBy(F.expr(f"iteration div {FRAME}").alias("frame")).agg(r(F.sum("max_it")).alias("frame_time"))


@query(f"WITH {T} SELECT round(regr_slope(max_it, iteration), 4) + 0.0 AS slope, round(regr_intercept(max_it, iteration), 4) + 0.0 AS intercept FROM s")
def regression(spark, d):
    own = stats(spark, d)
    return own.agg(r(F.regr_slope("max_it", "iteration")).alias("slope"), r(F.regr_intercept("max_it", "iteration")).alias("intercept"))


@query(f"WITH {T} UNPIVOT (SELECT iteration, {', '.join(f'round({c}, 4) + 0.0 AS {c}' for c in ('imbalance', 'efficiency', 'max_it'))} FROM s) ON imbalance, efficiency, max_it INTO NAME metric VALUE value")
def metrics_long(spark, d):
    wide = rounded(stats(spark, d), ["iteration"], ["imbalance", "efficiency", "max_it"])
    return wide.unpivot("iteration", ["imbalance", "efficiency", "max_it"], "metric", "value").where("value IS NOT NULL")


# Criteria


@query(f"WITH {T} SELECT iteration, false AS decision FROM l")
def crit_static(spark, d):
    return stats(spark, d).select("iteration", F.lit(False).alias("decision"))


@query(f"WITH {T} SELECT iteration, (iteration + 1) % 25 = 0 AS decision FROM l")
def crit_periodic(spark, d):
    return stats(spark, d).select("iteration", ((F.col("iteration") + 1) % 25 == 0).alias("decision"))


@query(f"WITH {T} SELECT iteration, min_it < sum_it / 4.0 * (1 - 0.2::DOUBLE) OR sum_it / 4.0 * (1 + 0.2::DOUBLE) < max_it AS decision FROM l")
def crit_marquez(spark, d):
    avg = F.col("sum_it") / F.lit(4.0)
    own = metrics.lagged(stats(spark, d))
    return own.select("iteration", ((F.col("min_it") < avg * (1 - 0.2)) | (avg * (1 + 0.2) < F.col("max_it"))).alias("decision"))


@query(f"WITH {T} SELECT iteration, iteration IN (5, 17, 60) AS decision FROM l")
def crit_reproduce(spark, d):
    scenario = F.broadcast(spark.range(0, 61).where("id IN (5, 17, 60)").select(F.col("id").alias("iteration"), F.lit(True).alias("fires")))
    return stats(spark, d).join(scenario, "iteration", "left").select("iteration", F.coalesce("fires", F.lit(False)).alias("decision"))


def _recursive(state: str, start: str, update: str, decide: str, reset: str) -> str:
    return f"""WITH RECURSIVE {T}, f AS (SELECT -1::BIGINT AS iteration, {start}, false AS dec UNION ALL
SELECT q.iteration, {reset}, q.dec FROM (SELECT *, {decide} AS dec FROM (SELECT l.iteration, l.u, {update} FROM f JOIN l ON l.iteration = f.iteration + 1)) q)
SELECT 0 AS run, iteration FROM f WHERE dec"""


_FRESH = "CASE WHEN f.fresh THEN l.u ELSE f.base END"
_CUM = "CASE WHEN q.dec THEN 0.0::DOUBLE ELSE q.cum END AS cum"
_TAIL_SQL = "list_append(CASE WHEN len(f.tail) = 3 THEN f.tail[2:3] ELSE f.tail END, l.max_it)"
_CRITERIA_SQL = {
    "menon": _recursive("cum", "0.0::DOUBLE AS cum", "f.cum + l.u AS cum", "cum >= 2000.0", _CUM),
    "improved": _recursive("", "0.0::DOUBLE AS cum, 0.0::DOUBLE AS base, true AS fresh", f"f.cum + greatest(0.0, l.u - {_FRESH}) AS cum, {_FRESH} AS base", "cum >= 2000.0", f"{_CUM}, q.base, q.dec OR q.iteration = 0 AS fresh"),
    "nomax": _recursive("", "0.0::DOUBLE AS cum, 0.0::DOUBLE AS base, true AS fresh", f"f.cum + (l.u - {_FRESH}) AS cum, {_FRESH} AS base", "cum >= 2000.0", f"{_CUM}, q.base, q.dec OR q.iteration = 0 AS fresh"),
    "bastien": _recursive("", "0.0::DOUBLE AS cum, 1::BIGINT AS tau", "f.cum + l.u AS cum, f.tau AS tau", "tau * u - cum >= 2000.0", f"{_CUM}, CASE WHEN q.dec THEN 1 ELSE q.tau + 1 END AS tau"),
    "offline": _recursive(
        "", "0::BIGINT AS prev, 0::BIGINT AS n", "f.prev AS prev, f.n + (l.iteration > 0)::BIGINT AS n",
        "(prev + CASE WHEN n > 0 AND u > 0 THEN floor(sqrt(2 * 2000.0::DOUBLE / (u / greatest(n, 1))))::BIGINT ELSE 4294967295 END) % 4294967296 <= iteration",
        "CASE WHEN q.dec THEN q.iteration ELSE q.prev END AS prev, CASE WHEN q.dec THEN 0 ELSE q.n END AS n",
    ),
    "zhai": _recursive(
        "", "0.0::DOUBLE AS cum, 0.0::DOUBLE AS total, 0::BIGINT AS n, []::DOUBLE[] AS tail",
        f"f.cum + CASE WHEN l.iteration > 0 THEN list_sort({_TAIL_SQL})[len({_TAIL_SQL}) // 2 + 1] - (f.total + l.max_it) / (f.n + 1) ELSE 0 END AS cum,"
        " f.total + CASE WHEN l.iteration > 0 THEN l.max_it ELSE 0 END AS total, f.n + (l.iteration > 0)::BIGINT AS n,"
        f" CASE WHEN l.iteration > 0 THEN {_TAIL_SQL} ELSE f.tail END AS tail",
        "cum >= 2000.0",
        f"{_CUM}, CASE WHEN q.dec THEN 0.0::DOUBLE ELSE q.total END AS total, CASE WHEN q.dec THEN 0 ELSE q.n END AS n, CASE WHEN q.dec THEN []::DOUBLE[] ELSE q.tail END AS tail",
    ),
}
for _kind, _sql in _CRITERIA_SQL.items():

    @query(_sql, f"crit_{_kind}")
    def _criterion(spark, d, kind=_kind):
        return metrics.fold(metrics.lagged(stats(spark, d)), kind, COST)


_PROCASSINI = """b AS (SELECT iteration, iteration // 10 AS frame, lag(coalesce(efficiency, 0)) OVER w AS last,
 (coalesce(sum(coalesce(efficiency, 0)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1) / (row_number() OVER w) AS mean FROM s WINDOW w AS (ORDER BY iteration)),
h AS (SELECT iteration // 10 + 1 AS frame, sum(max_it) AS time FROM s GROUP BY 1),
pr AS (SELECT iteration, last, mean, time FROM b LEFT JOIN h USING (frame))"""
_FIRES = "coalesce(time * (last / nullif(mean, 0)) + 2000.0::DOUBLE < {0} * time, false)"


@query(f"WITH {T}, {_PROCASSINI} SELECT iteration, {_FIRES.format('1.5::DOUBLE')} AS decision FROM pr")
def crit_procassini(spark, d):
    return metrics.procassini(stats(spark, d), [1.5], COST, FRAME).select("iteration", "decision")


def _sweep_sql() -> str:
    counts = lambda values, prefix, scale, start, rest: (
        f"SELECT {start} + k AS config, '{prefix}' || (arg * {scale})::INT AS name, {rest} FROM"
        f" (SELECT unnest({[float(v) for v in values]}::DOUBLE[]) AS arg, unnest(range({len(values)})) AS k)"
    )
    parts = [
        f"SELECT {k} AS config, '{name}' AS name, " + (f"(SELECT count(*) FROM ({_CRITERIA_SQL[kind]})) AS decisions" if kind else "0 AS decisions")
        for k, (name, kind) in enumerate(metrics.PLAIN)
    ]
    at, periods, factors = len(metrics.PLAIN), len(metrics.PERIODS), len(metrics.FACTORS)
    parts.append(counts(metrics.PERIODS, "Periodic_", 1, at, "count(*) FILTER ((iteration + 1) % arg = 0) AS decisions") + ", l GROUP BY ALL")
    parts.append(counts(metrics.FACTORS, "Procassini_", 100, at + periods, f"count(*) FILTER ({_FIRES.format('arg')}) AS decisions") + ", pr GROUP BY ALL")
    outside = "min_it < sum_it / 4.0::DOUBLE * (1 - arg) OR sum_it / 4.0::DOUBLE * (1 + arg) < max_it"
    parts.append(counts(metrics.TOLERANCES, "Marquez_", 100, at + periods + factors, f"count(*) FILTER ({outside}) AS decisions") + ", l GROUP BY ALL")
    return f"WITH {T}, {_PROCASSINI} " + " UNION ALL ".join(parts)


@query(_sweep_sql())
def config_sweep(spark, d):
    return metrics.sweep(stats(spark, d), COST, FRAME)


@query(_CRITERIA_SQL["menon"])
def stream_menon(spark, d):
    return live.replay(metrics.lagged(stats(spark, d)), COST)


# Search for the best schedule


@query(f"WITH {T}, fr AS (SELECT iteration // 10 AS frame, sum(max_it) AS cost FROM s GROUP BY 1) {search.SEGMENTS_SQL} SELECT lb_frame, frame, round(cost, 4) + 0.0 AS cost FROM seg")
def segment_costs(spark, d):
    return rounded(search.segments(_frames(spark, d)), ["lb_frame", "frame"], ["cost"])


@query()
def optimal_schedule(spark, d):
    return search.schedule(search.segments(_frames(spark, d)), COST)


def _frames(spark, d):
    return stats(spark, d).groupBy(F.expr(f"iteration div {FRAME}").alias("frame")).agg(F.sum("max_it").alias("cost"))


# Scalars, vectors and arrays over the particles

_A, _B = "[x, y, z]", "[vx, vy, vz]"


@query(
    f"WITH {P} SELECT gid, round(list_dot_product({_A}, {_B}), 6) + 0.0 AS dot, round(sqrt(x * x + y * y + z * z), 6) + 0.0 AS norm, "
    "abs(x - vx) <= 0.1 AND abs(y - vy) <= 0.1 AND abs(z - vz) <= 0.1 AS close, round(x / sqrt(x * x + y * y + z * z), 6) + 0.0 AS unit_x FROM p"
)
def vec_ops(spark, d):
    a, b = F.array("x", "y", "z"), F.array("vx", "vy", "vz")
    return particles(spark, d).select(
        "gid", r(V.dot(a, b), 6).alias("dot"), r(V.norm(a), 6).alias("norm"), V.almost_equal(a, b, 0.1).alias("close"), r(F.get(V.normalize(a), F.lit(0)), 6).alias("unit_x")
    )


@query(
    f"WITH {P}, q AS (SELECT gid, x, y, z, y * y - 4 * x * z AS d FROM p) SELECT gid, "
    "CASE WHEN x = 0 THEN CASE WHEN y = 0 THEN 0 ELSE 1 END WHEN d >= 0 THEN 2 ELSE 0 END AS roots, "
    "CASE WHEN x = 0 THEN round(-z / nullif(y, 0), 4) + 0.0 WHEN d >= 0 THEN round(CASE WHEN y > 0 THEN 2 * z / (-y - sqrt(d)) ELSE (-y + sqrt(d)) / (2 * x) END, 4) + 0.0 END AS first FROM q"
)
def quadratic_whole(spark, d):
    roots = V.quadratic_roots(F.col("x"), F.col("y"), F.col("z"))
    return particles(spark, d).select("gid", F.size(roots).alias("roots"), r(F.get(roots, F.lit(0))).alias("first"))


@query(f"WITH {P} SELECT gid, round(z * cos(y) * cos(x), 6) + 0.0 AS px, round(z * cos(y) * sin(x), 6) + 0.0 AS py, round(z * sin(y), 6) + 0.0 AS pz FROM p")
def sph2cart(spark, d):
    az, el, rad = F.col("x"), F.col("y"), F.col("z")
    return particles(spark, d).select(
        "gid", r(rad * F.cos(el) * F.cos(az), 6).alias("px"), r(rad * F.cos(el) * F.sin(az), 6).alias("py"), r(rad * F.sin(el), 6).alias("pz")
    )


@query("SELECT vec_id AS gid, round(list_sum(embedding::DOUBLE[]), 4) + 0.0 AS last, len(embedding) + 1 AS size FROM embeddings")
def scan_left_whole(spark, d):
    own = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("gid"), V.scan_left(F.col("embedding"), F.lit(0.0)).alias("s"))
    return own.select("gid", r(F.element_at("s", -1)).alias("last"), F.size("s").cast("bigint").alias("size"))


@query("SELECT vec_id AS gid, len(embedding[3:6]) AS size, round(list_sum(embedding[3:6]::DOUBLE[]), 4) + 0.0 AS total FROM embeddings", "slice")
def slice_(spark, d):
    own = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("gid"), V.slice_to(F.col("embedding"), 2, 5).cast("array<double>").alias("v"))
    return own.select("gid", F.size("v").cast("bigint").alias("size"), r(F.aggregate("v", F.lit(0.0), lambda s, x: s + x)).alias("total"))


@query("SELECT vec_id AS gid, round(list_sum(list_transform(list_zip(embedding, list_reverse(embedding)), lambda q: q[1]::DOUBLE * q[2])), 4) + 0.0 AS total FROM embeddings")
def zip_unzip_whole(spark, d):
    own = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("gid"), F.col("embedding").alias("a"), F.reverse("embedding").alias("b"))
    zipped = own.select("gid", F.arrays_zip("a", "b").alias("ab"))
    return zipped.select("gid", r(V.dot(F.transform("ab", lambda q: q["a"].cast("double")), F.transform("ab", lambda q: q["b"].cast("double")))).alias("total"))


@query("SELECT p_partkey, string_split(p_name, ' ')[1] AS head, array_to_string(string_split(p_name, ' '), ',') AS joined FROM part")
def split_join(spark, d):
    parts = F.split("p_name", " ")
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.get(parts, F.lit(0)).alias("head"), F.array_join(parts, ",").alias("joined"))
