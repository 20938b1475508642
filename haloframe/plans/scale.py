"""Queries over the operators made for many rows, parts and iterations, and their SQL."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from haloframe.operators import curves, metrics, partitions, resets, spatial, stencil
from haloframe.operators.scan import blocked, scan
from haloframe.plans.catalogue import FRAME, RC, SIG, P, celled, particles, rounded, sql_rounded
from haloframe.plans.catalogue import _forces as forces_sql
from haloframe.plans.catalogue import _near as near_sql
from haloframe.plans.measures import _PO as PO
from haloframe.plans.measures import _draw, _u
from haloframe.plans.session import shared_folder
from haloframe.sources import files, traces
from haloframe.sources import particles as sources
from haloframe.sources.particles import POSITION
from haloframe.streaming import late

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
EDGE = 0.03125


def query(sql: str | None = None, name: str | None = None):
    def register(function):
        key = name or function.__name__
        QUERIES[key] = function
        if sql:
            ORACLES[key] = sql
        return function

    return register


def orders(spark, d):
    return spatial.with_cells(sources.from_orders(spark, d), EDGE)


# Neighbour counts and joins

for _view, _ctes, _rows in (("particle", P, celled), ("orders", PO, orders)):

    @query(
        f"WITH {_ctes}, h AS (SELECT cx, cy, cz, count(*) AS n FROM c GROUP BY ALL), o(u) AS (VALUES (-1), (0), (1)), s AS (SELECT cx + i.u AS cx, cy + j.u AS cy, cz + k.u AS cz, n FROM h, o i, o j, o k), "
        "t AS (SELECT cx, cy, cz, sum(n)::BIGINT AS total FROM s GROUP BY ALL) SELECT cx, cy, cz, n, n * total AS interactions FROM h JOIN t USING (cx, cy, cz)",
        f"{_view}_cell_interactions",
    )
    def _cells(spark, d, rows=_rows):
        return stencil.cell_interactions(rows(spark, d))


@query(f"WITH {PO}, h AS (SELECT cx, cy, cz, (gid % 7)::INT AS part, count(*) AS n FROM c GROUP BY ALL), o(u) AS (VALUES (-1), (0), (1)), s AS (SELECT cx + i.u AS cx, cy + j.u AS cy, cz + k.u AS cz, n FROM h, o i, o j, o k), t AS (SELECT cx, cy, cz, sum(n)::BIGINT AS total FROM s GROUP BY ALL) SELECT part, sum(n)::BIGINT AS n, sum(n * total)::BIGINT AS interactions FROM h JOIN t USING (cx, cy, cz) GROUP BY part")
def orders_part_interactions(spark, d):
    """Parts that have no cell of their own: each cell is shared by seven."""
    return stencil.part_interactions(orders(spark, d).withColumn("part", (F.col("gid") % 7).cast("int")))


@query(
    f"WITH {P}, {forces_sql('xyz', 1.0, f'c a JOIN c b ON {near_sql('xyz')}')} SELECT gid, "
    + ", ".join(f"round(coalesce(f{q}, 0), 4) + 0.0 AS f{q}" for q in "xyz")
    + ", coalesce(n, 0) + 1 AS interactions FROM p LEFT JOIN f USING (gid)"
)
def lj_force_split(spark, d):
    """Pair forces with crowded cells dealt out, as every force query does it: by blocks."""
    own = celled(spark, d).select("gid", *POSITION, "cx", "cy", "cz")
    return rounded(spatial.force_sums(own, own, 1.0, SIG), ["gid", "interactions"], ["fx", "fy", "fz"])


# Halos of many parts

_EIGHTHS = 8
_CUBES = f"""{PO}, a AS (SELECT *, (floor(x * {_EIGHTHS}) + {_EIGHTHS} * floor(y * {_EIGHTHS}) + {_EIGHTHS**2} * floor(z * {_EIGHTHS}))::INT AS part FROM p),
b AS (SELECT part AS dst, min(x) AS xlo, max(x) AS xhi, min(y) AS ylo, max(y) AS yhi, min(z) AS zlo, max(z) AS zhi FROM a GROUP BY part)"""


@query(f"WITH {_CUBES} SELECT part, dst AS to, count(*) AS n FROM a JOIN b ON {' AND '.join(f'{q} + {EDGE}::DOUBLE >= {q}lo AND {q} - {EDGE}::DOUBLE <= {q}hi' for q in 'xyz')} AND part <> dst GROUP BY ALL")
def orders_halos(spark, d):
    """Halo copies that each of 512 parts gets from each other one."""
    slab = lambda q: F.floor(F.col(q) * _EIGHTHS)
    parted = sources.from_orders(spark, d).withColumn("part", (slab("x") + _EIGHTHS * slab("y") + _EIGHTHS**2 * slab("z")).cast("int"))
    return partitions.ghosts(parted, EDGE).groupBy("part", "to").agg(F.count(F.lit(1)).alias("n"))


# Long series

RUNS = 3
TR = f"""e AS (SELECT (user_id // 4) % {RUNS} AS run, (floor(epoch(ts))::BIGINT - 1704067200) // 21600 AS iteration, (user_id % 4)::INT AS rank, value FROM events),
t AS (SELECT run, iteration, rank, round(sum(value), 6) AS it_time FROM e GROUP BY ALL),
s AS (SELECT run, iteration, max(it_time) AS max_it, min(it_time) AS min_it, sum(it_time) AS sum_it, sum(it_time) / 4.0::DOUBLE AS avg_it,
 max(it_time) - sum(it_time) / 4.0::DOUBLE AS imbalance_time, sum(it_time) / 4.0::DOUBLE / nullif(max(it_time), 0) AS efficiency FROM t GROUP BY ALL),
l AS (SELECT run, iteration, lag(max_it, 1, 0.0) OVER w AS max_it, lag(max_it, 1, 0.0) OVER w - lag(sum_it, 1, 0.0) OVER w / 4.0::DOUBLE AS u FROM s WINDOW w AS (PARTITION BY run ORDER BY iteration))"""


def run_stats(spark, d):
    return metrics.iteration_stats(traces.from_events(spark, d, runs=RUNS), keys=("run", "iteration"))


@query(
    f"""WITH {TR}, v AS (SELECT run, iteration, sum(max_it) OVER w AS cum_time, coalesce(sum(max_it) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS exclusive_prefix,
 avg(efficiency) OVER w AS running_eff, max(max_it) OVER w AS peak, min(min_it) OVER w AS least, sum(avg_it) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS suffix_time
 FROM s WINDOW w AS (PARTITION BY run ORDER BY iteration)) {sql_rounded("run, iteration", "cum_time exclusive_prefix running_eff peak least suffix_time", "v")}"""
)
def scanned_series(spark, d):
    """Cumulative, exclusive and remaining time, mean efficiency so far and extremes, by scans over blocks."""
    rows = blocked(run_stats(spark, d), ["run"], ["iteration"])
    up = scan(rows, ["run"], ["iteration"], {"cum_time": ("sum", F.col("max_it")), "effs": ("sum", F.col("efficiency")), "seen": ("count", F.col("efficiency")), "peak": ("max", F.col("max_it")), "least": ("min", F.col("min_it"))})
    up = up.withColumn("exclusive_prefix", F.col("cum_time") - F.col("max_it")).withColumn("running_eff", F.try_divide("effs", "seen"))
    both = scan(up, ["run"], ["iteration"], {"suffix_time": ("sum", F.col("avg_it"))}, reverse=True)
    return rounded(both, ["run", "iteration"], ["cum_time", "exclusive_prefix", "running_eff", "peak", "least", "suffix_time"])


@query(
    f"""WITH {TR}, e1 AS (SELECT *, sum(((iteration + 1) % 10 = 0)::INT) OVER (PARTITION BY run ORDER BY iteration)::BIGINT AS epoch FROM s)
SELECT run, iteration, epoch, round(sum(imbalance_time) OVER w, 4) + 0.0 AS van_cum_imbalance, round(sum(max_it) OVER w, 4) + 0.0 AS lb_interval_time FROM e1 WINDOW w AS (PARTITION BY run, epoch ORDER BY iteration)"""
)
def scanned_epochs(spark, d):
    """Sums since the last rebalancing: a scan numbers the epochs, a second one adds up within them."""
    rows = blocked(run_stats(spark, d), ["run"], ["iteration"])
    fires = F.when((F.col("iteration") + 1) % FRAME == 0, F.lit(1))
    numbered = scan(rows, ["run"], ["iteration"], {"epoch": ("count", fires)})
    own = scan(numbered, ["run", "epoch"], ["iteration"], {"van_cum_imbalance": ("sum", F.col("imbalance_time")), "lb_interval_time": ("sum", F.col("max_it"))})
    return rounded(own, ["run", "iteration", "epoch"], ["van_cum_imbalance", "lb_interval_time"])


@query(
    f"""WITH RECURSIVE {TR}, k AS (SELECT run, iteration, u, row_number() OVER (PARTITION BY run ORDER BY iteration) AS n FROM l),
f AS (SELECT run, -1::BIGINT AS iteration, 0::BIGINT AS n, 0.0::DOUBLE AS cum, false AS dec FROM (SELECT DISTINCT run FROM k) UNION ALL
SELECT run, iteration, n, CASE WHEN cum >= 700.0 THEN 0.0::DOUBLE ELSE cum END, cum >= 700.0 FROM (SELECT k.run, k.iteration, k.n, f.cum + k.u AS cum FROM f JOIN k ON k.run = f.run AND k.n = f.n + 1) q)
SELECT run, iteration FROM f WHERE dec"""
)
def menon_by_pointers(spark, d):
    """The cumulative criterion over three runs, by pointers to the next decision."""
    return resets.resets(lagged_by_scan(run_stats(spark, d)), 700.0)


def lagged_by_scan(stats):
    """``run, iteration, u``: the largest time less the mean of the iteration before (0 at first)."""
    rows = blocked(stats, ["run"], ["iteration"])
    before = scan(rows, ["run"], ["iteration"], {"last_max": ("last", F.col("max_it")), "last_sum": ("last", F.col("sum_it"))}, inclusive=False)
    return before.select("run", "iteration", (F.coalesce("last_max", F.lit(0.0)) - F.coalesce("last_sum", F.lit(0.0)) / F.lit(float(traces.RANKS))).alias("u"))


# Event time


@query(
    f"""WITH RECURSIVE {TR}, m AS (SELECT s.run, s.iteration, s.max_it, s.min_it, s.sum_it, l.u, row_number() OVER (PARTITION BY s.run ORDER BY s.iteration) AS n FROM s JOIN l USING (run, iteration)),
f AS (SELECT run, 0::BIGINT AS n, 0.0::DOUBLE AS cum, 0.0::DOUBLE AS since, false AS dec FROM (SELECT DISTINCT run FROM m) UNION ALL
SELECT run, n, CASE WHEN cum >= 700.0 THEN 0.0::DOUBLE ELSE cum END, CASE WHEN cum >= 700.0 THEN max_it ELSE since + max_it END, cum >= 700.0
FROM (SELECT m.run, m.n, f.cum + m.u AS cum, f.since, m.max_it FROM f JOIN m ON m.run = f.run AND m.n = f.n + 1) q)
SELECT run, iteration, round(max_it, 4) + 0.0 AS max_it, round(min_it, 4) + 0.0 AS min_it, round(sum_it, 4) + 0.0 AS sum_it, round(since, 4) + 0.0 AS lb_interval_time, dec AS decision FROM f JOIN m USING (run, n)"""
)
def event_time_decisions(spark, d):
    """Three runs' events, late and shuffled within the watermark, through windows and timers."""
    seconds = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    rows = spark.read.parquet(f"{d}/events.parquet").select(
        F.expr(f"(user_id div 4) % {RUNS}").alias("run"), (F.col("user_id") % traces.RANKS).cast("int").alias("rank"), F.timestamp_seconds(seconds).alias("ts"), "value"
    )
    return rounded(late.replay(rows, 700.0), ["run", "iteration", "decision"], ["max_it", "min_it", "sum_it", "lb_interval_time"])


# Files as data sources


@query(
    "SELECT CASE WHEN l_linenumber % 7 <> 0 THEN l_quantity END AS x, l_extendedprice AS y, CASE WHEN l_linenumber % 5 <> 0 THEN l_discount END AS z, "
    "l_linenumber % 7 = 0 AS malformed, count(*) AS n FROM lineitem WHERE l_extendedprice >= 20000 GROUP BY ALL"
)
def particle_files(spark, d):
    """Lines written from a table, some too short, too long or malformed, read back in ranges with a filter in the reader."""
    fields = [F.col(c).cast("string") for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")]
    first = F.when(F.col("l_linenumber") % 7 == 0, F.lit("n/a")).otherwise(fields[0])
    line = F.when(F.col("l_linenumber") % 5 == 0, F.concat_ws(",", first, fields[1])).otherwise(F.concat_ws(",", first, *fields[1:]))
    folder = f"{shared_folder(spark)}/lines-{uuid4()}"
    spark.read.parquet(f"{d}/lineitem.parquet").select(line.alias("value")).write.text(folder)
    files.register(spark)
    rows = spark.read.format("particles").option("splitBytes", 1 << 18).load(folder).where("y >= 20000")
    return rows.groupBy("x", "y", "z", F.col("malformed").isNotNull().alias("malformed")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {P}, a AS (SELECT *, ((((cx + cy + cz) % 4) + 4) % 4)::INT AS part, (gid % 5)::INT AS frame FROM c) {sql_rounded('frame', 'x y z', 'a', 9)}")
def written_frames(spark, d):
    """Particle frames committed in two phases and read back."""
    parted = particles(spark, d).select((F.col("gid") % 5).cast("int").alias("frame"), *POSITION, partitions.by_grid(RC, 4).alias("part"))
    folder = f"{shared_folder(spark)}/frames-{uuid4()}"
    files.register(spark)
    parted.write.format("frames").mode("append").save(folder)
    return rounded(spark.read.format("particles").option("header", "true").load(folder), ["frame"], [*POSITION], 9)


@query(f"WITH {TR} SELECT run, row_number() OVER (PARTITION BY run ORDER BY iteration)::BIGINT AS line, round(max_it, 6) + 0.0 AS time FROM s")
def written_series(spark, d):
    """Each run's series of times as text, in order over its part files, read back with line numbers."""
    own = run_stats(spark, d).select(F.concat(F.lit("time-"), F.col("run")).alias("metric"), "iteration", F.round("max_it", 6).alias("value"))
    folder = f"{shared_folder(spark)}/series-{uuid4()}"
    files.register(spark)
    own.repartitionByRange("metric", "iteration").sortWithinPartitions("metric", "iteration").select("metric", "value").write.format("frames").option("kind", "series").mode("append").save(folder)
    read = spark.read.text(folder).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("id"))
    own = read.select(F.regexp_extract("file", r"metric=time-(\d+)", 1).cast("bigint").alias("run"), F.struct(F.regexp_extract("file", r"part-(\d+)", 1).cast("int"), "at", "id").alias("place"), F.col("value").cast("double").alias("time"))
    rows = blocked(own, ["run"], ["place"])
    return scan(rows, ["run"], ["place"], {"line": ("count", F.lit(1))}).select("run", "line", "time")


# Parts of equal load along a curve


def _hilbert_sql(cells: str, name: str, bits: int, origin: int) -> str:
    """CTEs that end in ``name``: the rows of ``cells`` (distinct ``cx, cy, cz``) with their ``code``."""
    low = "((1::BIGINT << k) - 1)"
    swapped = lambda q: f"CASE WHEN ({q} >> k) & 1 = 1 THEN xor(x, {low}) ELSE xor(x, xor(x, {q}) & {low}) END AS x, CASE WHEN ({q} >> k) & 1 = 1 THEN {q} ELSE xor({q}, xor(x, {q}) & {low}) END AS {q}"
    start = ", ".join(f"least(greatest(c{q} + {origin}, 0), {2**bits - 1}) AS {q}" for q in "xyz")
    digits = " + ".join(f"(((g{q} >> {b}) & 1) << {3 * b + 2 - i})" for b in range(bits) for i, q in enumerate("xyz"))
    terms = [f"(((z >> {k}) & 1) * {2**k - 1})" for k in range(1, bits)]
    turn = terms[0]
    for term in terms[1:]:
        turn = f"xor({turn}, {term})"
    return f"""{name}_r AS (SELECT cx, cy, cz, {bits - 1} AS k, {start} FROM {cells} UNION ALL
SELECT cx, cy, cz, k - 1, x, y, z FROM (SELECT cx, cy, cz, k, y, {swapped("z")} FROM (SELECT cx, cy, cz, k, z, {swapped("y")} FROM
 (SELECT cx, cy, cz, k, CASE WHEN (x >> k) & 1 = 1 THEN xor(x, {low}) ELSE x END AS x, y, z FROM {name}_r WHERE k >= 1) q1) q2) q3),
{name}_g AS (SELECT cx, cy, cz, x, xor(y, x) AS y, xor(z, xor(y, x)) AS z FROM {name}_r WHERE k = 0),
{name}_t AS (SELECT cx, cy, cz, xor(x, {turn}) AS gx, xor(y, {turn}) AS gy, xor(z, {turn}) AS gz FROM {name}_g),
{name} AS (SELECT cx, cy, cz, {digits} AS code FROM {name}_t)"""


_STENCIL = "h AS (SELECT cx, cy, cz, count(*) AS n FROM c GROUP BY ALL), o(u) AS (VALUES (-1), (0), (1)), sp AS (SELECT cx + i.u AS cx, cy + j.u AS cy, cz + k.u AS cz, n FROM h, o i, o j, o k), tt AS (SELECT cx, cy, cz, sum(n)::BIGINT AS total FROM sp GROUP BY ALL), w AS (SELECT cx, cy, cz, n * total AS load FROM h JOIN tt USING (cx, cy, cz))"
BITS, ORIGIN = 5, 16
_HILBERT = f"""{P}, {_STENCIL}, {_hilbert_sql("w", "hc", BITS, ORIGIN)},
b AS (SELECT w.*, code, sum(load) OVER (ORDER BY code) - load AS before, sum(load) OVER () AS whole FROM w JOIN hc USING (cx, cy, cz)),
pt AS (SELECT *, least(before * 7 // whole, 6)::INT AS part FROM b)"""


def _loads(spark, d):
    own = celled(spark, d)
    return own, stencil.cell_interactions(own).select("cx", "cy", "cz", F.col("interactions").alias("load"))


@query(f"WITH RECURSIVE {P}, {_STENCIL}, {_hilbert_sql('w', 'hc', BITS, ORIGIN)} SELECT cx, cy, cz, code::BIGINT AS code FROM hc")
def hilbert_cells(spark, d):
    return curves.coded_cells(_loads(spark, d)[1], ORIGIN, BITS).select("cx", "cy", "cz", "code")


@query(f"WITH RECURSIVE {_HILBERT} SELECT gid, part FROM c JOIN pt USING (cx, cy, cz)")
def part_hilbert(spark, d):
    """Seven parts of equal interactions."""
    return curves.by_hilbert(*_loads(spark, d), 7, ORIGIN, BITS).select("gid", "part")


@query(f"WITH RECURSIVE {_HILBERT} SELECT part, sum(load)::BIGINT AS load, count(*) AS cells FROM pt GROUP BY part")
def hilbert_loads(spark, d):
    loads = curves.coded_cells(_loads(spark, d)[1], ORIGIN, BITS)
    return curves.equal_loads(loads, 7).groupBy("part").agg(F.sum("load").alias("load"), F.count(F.lit(1)).alias("cells"))


FRAMES, STRIDE, SEGMENT_PARTS = 6, 0.5, 4


@query(
    f"""WITH RECURSIVE {P}, fr AS (SELECT k::INT AS frame, {", ".join(f"floor(({q} + v{q} * (k * {STRIDE}::DOUBLE)) / 0.1::DOUBLE)::BIGINT AS c{q}" for q in "xyz")} FROM p, range({FRAMES}) AS g(k)),
u AS (SELECT DISTINCT cx, cy, cz FROM fr), {_hilbert_sql("u", "hc", 6, 32)},
hf AS (SELECT frame, code, count(*) AS n FROM fr JOIN hc USING (cx, cy, cz) GROUP BY ALL),
mk AS (SELECT frame AS lb_frame, code, least((sum(n) OVER (PARTITION BY frame ORDER BY code) - n) * {SEGMENT_PARTS} // sum(n) OVER (PARTITION BY frame), {SEGMENT_PARTS - 1}) AS part FROM hf),
st AS (SELECT lb_frame, part, min(code) AS code FROM mk GROUP BY ALL),
lk AS (SELECT st.lb_frame, hf.frame, hf.code, any_value(hf.n) AS n, coalesce(max(st.part) FILTER (st.code <= hf.code), 0) AS part FROM hf JOIN st ON st.lb_frame <= hf.frame GROUP BY st.lb_frame, hf.frame, hf.code),
pa AS (SELECT lb_frame, frame, part, sum(n) AS n FROM lk GROUP BY ALL)
SELECT lb_frame, frame, max(n)::BIGINT AS cost FROM pa GROUP BY ALL"""
)
def measured_segments(spark, d):
    """The largest part of each frame under the partition made at each earlier one, particles drifting freely."""
    moved = spatial.with_cells(curves.drifted(particles(spark, d), FRAMES, STRIDE), RC)
    cells = stencil.histogram(moved, keys=("frame",))
    coded = curves.coded_cells(cells, 32, 6).groupBy("frame", "code").agg(F.sum("n").alias("n"))
    return curves.segment_loads(coded, SEGMENT_PARTS)


# Points beyond a ball


def _beyond_sql(dims: int) -> str:
    if dims == 2:
        return f"q AS (SELECT gid, sqrt(1 - 2 * ln({_u('0')})) AS r FROM g)"
    # Newton steps on the logarithm of the chance to be beyond, from the plane's answer; the error function by its series.
    erfc = "(1 - 1.1283791670955126::DOUBLE * sqrt((1 + 2 * t) / 2) * list_sum(list_transform(range(0, 140), lambda n: exp(n * ln((1 + 2 * t) / 2) - (1 + 2 * t) / 2 - lgamma(n + 1.5) + lgamma(1.5)))))"
    flat = "sqrt((1 + 2 * t) * 2 / pi()) * exp(-(1 + 2 * t) / 2)"
    return f"""s0 AS (SELECT 0.0::DOUBLE AS t), b0 AS (SELECT {erfc} + {flat} AS whole FROM s0),
nw AS (SELECT gid, 0 AS k, -ln({_u("0")}) AS t, ln(whole) + ln({_u("0")}) AS goal FROM g, b0 UNION ALL
SELECT gid, k + 1, greatest(0.0, t + (ln(b) - goal) * b / f), goal FROM (SELECT *, {erfc} + {flat} AS b, {flat} AS f FROM nw WHERE k < 12) q),
q AS (SELECT gid, sqrt(1 + 2 * t) AS r FROM nw WHERE k = 12)"""


for _dims in (2, 3):
    _turn, _rise = f"2 * pi() * {_u('1')}", f"(2 * {_u('2')} - 1)"
    _at = {"x": f"r * cos({_turn})", "y": f"r * sin({_turn})"} if _dims == 2 else {"x": f"r * sqrt(1 - {_rise} * {_rise}) * cos({_turn})", "y": f"r * sqrt(1 - {_rise} * {_rise}) * sin({_turn})", "z": f"r * {_rise}"}

    @query(
        f"WITH RECURSIVE g AS (SELECT vec_id AS gid FROM embeddings), {_beyond_sql(_dims)} SELECT gid, "
        + ", ".join(f"round({c} + {m}, 5) + 0.0 AS {n}" for (n, c), m in zip(_at.items(), (1, 2, 3), strict=False))
        + " FROM q",
        f"gen_beyond_{_dims}d",
    )
    def _beyond(spark, d, dims=_dims):
        ids = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("gid"))
        return rounded(sources.beyond_ball(ids, 2.0, (1.0, 2.0, 3.0)[:dims], _draw), ["gid"], list(POSITION[:dims]), 5)
