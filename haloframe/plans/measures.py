"""Further registered queries and their SQL: arrays, boxes and cells, forces and walls, generators, text forms, series."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from haloframe.functions import vectors as V
from haloframe.operators import metrics, partitions, physics, spatial, stencil
from haloframe.plans import catalogue as C
from haloframe.plans.catalogue import COST, DT, FRAME, PARTS, RC, SIG, P, T, celled, particles, r, rounded, sql_rounded, stats
from haloframe.sources import particles as sources
from haloframe.sources import sinks, traces
from haloframe.sources.particles import POSITION

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str, name: str | None = None):
    def register(function):
        key = name or function.__name__
        QUERIES[key], ORACLES[key] = function, sql
        return function

    return register


def embeddings(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("gid"), F.col("embedding").cast("array<double>").alias("v"))


_E = "e AS (SELECT vec_id AS gid, embedding::DOUBLE[] AS v FROM embeddings)"


# Lines of text


@query(
    "SELECT l_orderkey, l_linenumber, l_quantity AS x, l_extendedprice AS y, CASE WHEN l_linenumber % 5 <> 0 THEN l_discount END AS z FROM lineitem"
)
def csv_parse(spark, d):
    """Reals read back from lines of text, too many or too few of them in a line."""
    fields = [F.col(c).cast("string") for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")]
    line = F.when(F.col("l_linenumber") % 5 == 0, F.concat_ws(",", *fields[:2])).otherwise(F.concat_ws(",", *fields))
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", line.alias("value"))
    return rows.select("l_orderkey", "l_linenumber", *sources.parse_line(F.col("value")))


_GRID = f"{P}, a AS (SELECT *, ((((cx + cy + cz) % 4) + 4) % 4)::INT AS part FROM c)"


@query(
    f"WITH {_GRID} SELECT part AS frame, 'x coord,y coord,z coord ,rank' AS line, 1::BIGINT AS n FROM a GROUP BY part "
    "UNION ALL SELECT part, printf('%.6f,%.6f,%.6f,%d', x, y, z, part), count(*) FROM a GROUP BY ALL"
)
def frame_lines(spark, d):
    parted = particles(spark, d).withColumn("part", partitions.by_grid(RC, PARTS))
    return sinks.frame_lines(parted, frame="part").groupBy("frame", "line").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {P} SELECT gid, printf('%.3f;%.3f;%.3f', x, y, z) AS line FROM p")
def formatted_lines(spark, d):
    return particles(spark, d).select("gid", V.formatted([F.col(q) for q in POSITION], ";", 3).alias("line"))


@query("SELECT o_orderkey, printf('%08d|%.2f|%-10s|', o_orderkey, o_totalprice, o_orderstatus) AS line FROM orders")
def printf_lines(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.format_string("%08d|%.2f|%-10s|", "o_orderkey", "o_totalprice", "o_orderstatus").alias("line"))


@query("SELECT event_id, strftime(ts, '%d-%m-%Y-%H-%M-%S') AS day FROM events")
def date_lines(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", F.date_format("ts", "dd-MM-yyyy-HH-mm-ss").alias("day"))


# Generators; draws are made of the rows' own ids


def _draw(k):
    """A draw of (0, 1) that SQL can repeat: three rounds of a multiplicative generator."""
    number = (F.col("gid") * 48271 + k * 69621 + 1) % 2147483647
    return ((number * 48271 % 2147483647) * 48271 % 2147483647 + 0.5) / F.lit(2147483647.0)


def _u(k: str) -> str:
    return f"(((((gid * 48271 + ({k}) * 69621 + 1) % 2147483647) * 48271 % 2147483647) * 48271 % 2147483647 + 0.5::DOUBLE) / 2147483647.0::DOUBLE)"


_G = "g AS (SELECT vec_id AS gid FROM embeddings)"
_AT = {
    "x": f"sin(acos(2 * {_u('1')} - 1)) * sin(2 * pi() * {_u('2')})",
    "y": f"sin(acos(2 * {_u('1')} - 1)) * cos(2 * pi() * {_u('2')})",
    "z": f"cos(acos(2 * {_u('1')} - 1))",
}


def _ids(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("gid"))


for _dims in ("xy", "xyz"):
    _between = f"cbrt({_u('0')} * (8.0::DOUBLE - 0.125::DOUBLE) + 0.125::DOUBLE)"

    @query(f"WITH {_G} SELECT gid, {', '.join(f'round({_between} * {_AT[q]}, 6) + 0.0 AS {q}' for q in _dims)} FROM g", f"gen_ball_{len(_dims)}d")
    def _ball(spark, d, dims=tuple(_dims)):
        return rounded(sources.in_ball(_ids(spark, d), 2.0, 0.5, dims, _draw), ["gid"], list(dims), 6)

    @query(f"WITH {_G} SELECT gid, {', '.join(f'round(3.0::DOUBLE * {_AT[q]}, 6) + 0.0 AS {q}' for q in _dims)} FROM g", f"gen_sphere_{len(_dims)}d")
    def _sphere(spark, d, dims=tuple(_dims)):
        return rounded(sources.on_sphere(_ids(spark, d), 3.0, dims, _draw), ["gid"], list(dims), 6)

    _tries = 12
    _normal = {q: f"(sqrt(-2 * ln({_u(f't * 8 + {2 * k}')})) * cos(2 * pi() * {_u(f't * 8 + {2 * k + 1}')}) * 1.0::DOUBLE)" for k, q in enumerate(_dims)}
    _r2 = " + ".join(f"{q} * {q}" for q in _dims)

    @query(
        f"WITH {_G}, n AS (SELECT gid, t, {', '.join(f'{v} AS {q}' for q, v in _normal.items())} FROM g, range(1, {_tries + 1}) AS q(t)),"
        f" o AS (SELECT *, {_r2} AS r2, row_number() OVER (PARTITION BY gid ORDER BY ({_r2} > 1)::INT DESC, CASE WHEN {_r2} > 1 THEN t ELSE -t END) AS k FROM n)"
        f" SELECT gid, {', '.join(f'round(CASE WHEN r2 > 1 THEN {q} ELSE {q} * 1.000001 / sqrt(r2) END + {m}, 6) + 0.0 AS {q}' for q, m in zip(_dims, (1, 2, 3), strict=False))} FROM o WHERE k = 1",
        f"gen_outside_{len(_dims)}d",
    )
    def _outside(spark, d, dims=tuple(_dims), tries=_tries):
        return rounded(sources.outside_ball(_ids(spark, d), 2.0, (1.0, 2.0, 3.0)[: len(dims)], _draw, tries), ["gid"], list(dims), 6)


# Forces and walls with parameters


def _after(acc: dict[str, str], clamp: bool) -> str:
    new = {q: f"(v{q} + ({a}) * {DT}::DOUBLE / 2)" for q, a in acc.items()}
    v = {q: f"CASE WHEN abs({n} * {DT}::DOUBLE) >= {RC}::DOUBLE OR isnan({n}) THEN {0.5 * RC / DT!r}::DOUBLE ELSE {n} END" if clamp else n for q, n in new.items()}
    return ", ".join(f"{q} AS o{q}, {e} AS v{q}" for q, e in v.items())


_PULL = {q: f"-4.0::DOUBLE * {q} - 50.0::DOUBLE * v{q}" for q in "xyz"}


def _pull():
    return {q: F.lit(-4.0) * F.col(q) - F.lit(50.0) * F.col(f"v{q}") for q in POSITION}


@query(
    f"WITH {P}, k AS (SELECT gid, {_after(_PULL, True)} FROM p), m AS (SELECT gid, {', '.join(f'v{q}, o{q} + v{q} * {DT}::DOUBLE AS {q}' for q in 'xyz')} FROM k) "
    + sql_rounded("gid", "x y z vx vy vz", "m", 6)
)
def leapfrog1(spark, d):
    return rounded(physics.kick_drift(particles(spark, d), RC, DT, acceleration=_pull()), ["gid"], ["x", "y", "z", "vx", "vy", "vz"], 6)


@query(f"WITH {P}, k AS (SELECT gid, {_after(_PULL, False)} FROM p) {sql_rounded('gid', 'vx vy vz', 'k', 6)}")
def leapfrog2(spark, d):
    return rounded(physics.kick(particles(spark, d), DT, _pull()), ["gid"], ["vx", "vy", "vz"], 6)


@query(
    f"WITH {P}, {C._forces('xyz', 1.0, f'c a JOIN c b ON {C._near("xyz")}')} SELECT gid, "
    + ", ".join(f"round(coalesce(f{q}, 0) - 0.5::DOUBLE * {q}, 4) + 0.0 AS f{q}" for q in "xyz")
    + ", coalesce(n, 0) + 1 AS interactions FROM p LEFT JOIN f USING (gid)"
)
def lj_force_unary(spark, d):
    """Pair forces on top of a pull towards the centre."""
    own = celled(spark, d)
    pull = {q: F.lit(-0.5) * F.col(q) for q in POSITION}
    return rounded(spatial.force_sums(own, own, 1.0, SIG, unary=pull), ["gid", "interactions"], ["fx", "fy", "fz"])


_WALLS = ", ".join(f"CASE WHEN {q} < -0.1::DOUBLE THEN 2 * -0.1::DOUBLE - {q} ELSE {q} END AS {q}, CASE WHEN {q} < -0.1::DOUBLE THEN -v{q} ELSE v{q} END AS v{q}" for q in "xyz")
_HIGH = _WALLS.replace("< -0.1::DOUBLE", "> 0.1::DOUBLE").replace("2 * -0.1::DOUBLE", "2 * 0.1::DOUBLE")


@query(
    f"""WITH {P}, b0 AS (SELECT gid, {_WALLS} FROM p), b1 AS (SELECT gid, {_HIGH} FROM b0),
o AS (SELECT gid, x - 0.1::DOUBLE AS x, y + 0.05::DOUBLE AS y, z AS z, vx, vy, vz FROM p),
u AS (SELECT *, sqrt(vx * vx + vy * vy + vz * vz) AS sp, x * x + y * y + z * z - 0.2::DOUBLE * 0.2::DOUBLE AS gap FROM o),
h AS (SELECT *, (x * vx + y * vy + z * vz) / nullif(sp, 0) AS half FROM u),
q AS (SELECT *, coalesce(gap > 0 AND half * half - gap >= 0, false) AS hit, sqrt(greatest(half * half - gap, 0)) AS root FROM h),
t AS (SELECT *, CASE WHEN abs(-half + root) <= abs(-half - root) THEN -half + root ELSE -half - root END AS t FROM q),
n AS (SELECT *, {", ".join(f"-({q} + t * v{q} / nullif(sp, 0)) / 0.2 AS n{q}" for q in "xyz")} FROM t),
m AS (SELECT *, {" + ".join(f"({q} + n{q} * 0.2) * n{q}" for q in "xyz")} AS depth, {" + ".join(f"v{q} * n{q}" for q in "xyz")} AS along FROM n)
SELECT 'box' AS kind, gid, {", ".join(f"round({q}, 5) + 0.0 AS {q}, round(v{q}, 5) + 0.0 AS v{q}" for q in "xyz")} FROM b1 UNION ALL
SELECT 'sphere', gid, {", ".join(f"round(CASE WHEN hit THEN {q} - 2 * depth * n{q} ELSE {q} END + {s}, 5) + 0.0, round(CASE WHEN hit THEN v{q} - 2 * along * n{q} ELSE v{q} END, 5) + 0.0" for q, s in (("x", "0.1::DOUBLE"), ("y", "-0.05::DOUBLE"), ("z", "0.0::DOUBLE")))} FROM m"""
)
def reflect_dispatch(spark, d):
    """Either kind of boundary, chosen by its type; the sphere has a centre of its own."""
    walls = {"box": physics.Box(-0.1, 0.1), "sphere": physics.Sphere(0.2, (0.1, -0.05, 0.0))}
    state = ["x", "vx", "y", "vy", "z", "vz"]
    parts = [rounded(physics.reflect(particles(spark, d), w).withColumn("kind", F.lit(k)), ["kind", "gid"], state, 5) for k, w in walls.items()]
    return parts[0].unionByName(parts[1])


# Boxes and cells

_RC = "0.1::DOUBLE"
_BOX = ", ".join(f"floor(min({q}) / {_RC}) * {_RC} - {_RC} AS {q}min, ceil(max({q}) / {_RC}) * {_RC} + {_RC} AS {q}max" for q in "xyz")
_BOXED = f"{P}, b AS (SELECT {_BOX} FROM p)"
_COUNTED = f"{_BOXED}, k AS (SELECT *, {', '.join(f'ceil(greatest({q}max - {q}min, 0) / {_RC})::BIGINT AS n{q}' for q in 'xyz')} FROM b)"


@query(f"WITH {_COUNTED} SELECT nx, ny, nz, nx * ny * nz AS cells FROM k")
def box_cells(spark, d):
    return spatial.box_cells(spatial.bounding_box(particles(spark, d), RC), RC).select("nx", "ny", "nz", "cells")


@query(
    f"WITH {P}, near AS (SELECT {_BOX} FROM p WHERE x < 0), s AS (SELECT {', '.join(f'min({q}) AS p{q}min, max({q}) AS p{q}max' for q in 'xyz')} FROM p WHERE x >= 0), w AS (SELECT "
    + ", ".join(f"floor(least({q}min, p{q}min) / {_RC}) * {_RC} - {_RC} AS {q}min, ceil(greatest({q}max, p{q}max) / {_RC}) * {_RC} + {_RC} AS {q}max" for q in "xyz")
    + f" FROM near, s) {sql_rounded('1 AS one', 'xmin xmax ymin ymax zmin zmax', 'w', 6)}"
)
def extended_box(spark, d):
    own = particles(spark, d)
    box = spatial.extend_box(spatial.bounding_box(own.where("x < 0"), RC), own.where("x >= 0"), RC)
    return rounded(box.withColumn("one", F.lit(1)), ["one"], [f"{q}{n}" for q in POSITION for n in ("min", "max")], 6)


_MEASURES = "xcentre ycentre zcentre xwidth ywidth zwidth least_width largest_width"


@query(
    f"WITH {_BOXED}, w AS (SELECT {', '.join(f'({q}min + {q}max) / 2 AS {q}centre, greatest({q}max - {q}min, 0) AS {q}width' for q in 'xyz')} FROM b),"
    f" m AS (SELECT *, least(xwidth, ywidth, zwidth) AS least_width, greatest(xwidth, ywidth, zwidth) AS largest_width FROM w) {sql_rounded('1 AS one', _MEASURES, 'm', 6)}"
)
def box_measures(spark, d):
    box = spatial.box_measures(spatial.bounding_box(particles(spark, d), RC))
    return rounded(box.withColumn("one", F.lit(1)), ["one"], _MEASURES.split(), 6)


_LINEAR = f"""{_COUNTED}, i AS (SELECT gid, nx, ny, xmin, ymin, zmin, {', '.join(f'({q} - {q}min) / {_RC} AS q{q}, floor(({q} - {q}min) / {_RC})::BIGINT AS i{q}' for q in 'xyz')} FROM p, k)"""


@query(
    f"WITH {_LINEAR} SELECT gid, ix + nx * iy + nx * ny * iz AS linear, trunc(qx)::BIGINT + nx * trunc(qy)::BIGINT + nx * ny * iz AS truncated, ix, iy, iz, "
    + ", ".join(f"round({q}min + i{q} * {_RC}, 6) + 0.0 AS {q}start" for q in "xyz")
    + " FROM i"
)
def linear_cells(spark, d):
    """Cell numbers within the snapped box, the cells they stand for, and where those start."""
    own = spatial.linear_cells(particles(spark, d), RC)
    back = [c.cast("bigint").alias(f"i{q}") for q, c in zip(POSITION, spatial.cell_of_number(F.col("linear"), F.col("nx"), F.col("ny")), strict=True)]
    return own.select("gid", "linear", "truncated", *back, *[r(f"{q}start", 6).alias(f"{q}start") for q in POSITION])


@query(f"WITH {P}, o(u) AS (VALUES (-1), (0), (1)), k AS (SELECT DISTINCT cx, cy, cz FROM c), n AS (SELECT k.cx, k.cy, k.cz, count(*) AS filled FROM k, o a, o b, o e JOIN k m ON m.cx = k.cx + a.u AND m.cy = k.cy + b.u AND m.cz = k.cz + e.u GROUP BY ALL) SELECT cx, cy, cz, filled, 27 AS cells FROM n")
def neighbour_cells(spark, d):
    """Of the 3**N cells around each filled cell, those that are filled."""
    own = celled(spark, d).select("cx", "cy", "cz").distinct()
    around = own.toDF("ax", "ay", "az")
    for q in POSITION:
        around = around.withColumn(f"c{q}", F.explode(F.sequence(F.col(f"a{q}") - 1, F.col(f"a{q}") + 1)))
    found = around.join(own, ["cx", "cy", "cz"]).groupBy("ax", "ay", "az").agg(F.count(F.lit(1)).alias("filled"))
    return found.select(F.col("ax").alias("cx"), F.col("ay").alias("cy"), F.col("az").alias("cz"), "filled", F.lit(3 ** len(POSITION)).alias("cells"))


_PO = """p AS (SELECT o_orderkey AS gid, ((o_orderkey * 7919) % 10007) / 10007.0::DOUBLE AS x,
 ((o_custkey * 104729 + o_orderkey * 31) % 10009) / 10009.0::DOUBLE AS y, ((o_orderkey * 15485863 + o_custkey * 17) % 10037) / 10037.0::DOUBLE AS z FROM orders),
c AS (SELECT *, floor(x / 0.03125::DOUBLE)::BIGINT AS cx, floor(y / 0.03125::DOUBLE)::BIGINT AS cy, floor(z / 0.03125::DOUBLE)::BIGINT AS cz FROM p)"""


@query(f"WITH {_PO}, o(u) AS (VALUES (-1), (0), (1)), a AS (SELECT gid, cx + i.u AS cx, cy + j.u AS cy, cz + k.u AS cz FROM c, o i, o j, o k) SELECT count(*) AS pairs FROM a JOIN c USING (cx, cy, cz) WHERE a.gid <> c.gid")
def orders_pair_count(spark, d):
    return stencil.pair_count(spatial.with_cells(sources.from_orders(spark, d), 0.03125)).select("pairs")


# Row numbers, parts


@query(f"WITH {_GRID} SELECT gid, part, row_number() OVER (PARTITION BY part ORDER BY gid) - 1 AS lid FROM a")
def local_ids(spark, d):
    own = particles(spark, d).select("gid", partitions.by_grid(RC, PARTS).alias("part"), *POSITION)
    return spatial.local_ids(own).select("gid", "part", "lid")


@query(f"{C._MOVES}, e AS (SELECT src AS part, sum(n)::BIGINT AS exports FROM x GROUP BY src), k AS (SELECT part, count(*) AS n FROM a GROUP BY part) SELECT part, n, coalesce(exports, 0) AS exports FROM k LEFT JOIN e USING (part)")
def part_counts(spark, d):
    """Rows of each part, and those that leave it for another partition."""
    own = particles(spark, d).withColumn("part", partitions.by_grid(RC, PARTS)).groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    leaving = C.migrate_matrix(spark, d).groupBy(F.col("src").alias("part")).agg(F.sum("n").alias("exports"))
    return own.join(leaving, "part", "left").select("part", "n", F.coalesce("exports", F.lit(0)).alias("exports"))


@query(f"WITH {_GRID}, n AS (SELECT part, count(*) AS k FROM a GROUP BY part) SELECT sum(k)::BIGINT AS total, max(k) AS largest, count(*) AS parts, round(sum(k) / 4.0::DOUBLE / max(k), 6) + 0.0 AS efficiency, max(k) <= 1.1::DOUBLE * sum(k) / 4 AS balanced FROM n")
def initial_partition(spark, d):
    """What a run starts from: rows, the largest part, the efficiency of the counts, and whether no part is a tenth over its share."""
    counts = particles(spark, d).groupBy(partitions.by_grid(RC, PARTS).alias("part")).agg(F.count(F.lit(1)).alias("k"))
    efficiency = r(F.sum("k") / F.lit(float(PARTS)) / F.max("k"), 6).alias("efficiency")
    return counts.agg(F.sum("k").alias("total"), F.max("k").alias("largest"), F.count(F.lit(1)).alias("parts"), efficiency, (F.max("k") <= F.lit(1.1) * F.sum("k") / PARTS).alias("balanced"))


@query(f"SELECT max(neighbours) AS most FROM ({C.ORACLES['neighbor_ranks']})")
def most_neighbours(spark, d):
    return C.neighbor_ranks(spark, d).agg(F.max("neighbours").alias("most"))


# Arrays

_PARTS6 = "a AS (SELECT gid, v[1:6] AS a, v[7:12] AS b, v[13] AS s FROM e)"


def _vectors(spark, d):
    return embeddings(spark, d).select("gid", F.slice("v", 1, 6).alias("a"), F.slice("v", 7, 6).alias("b"), F.element_at("v", 13).alias("s"))


@query(
    f"WITH {_E}, {_PARTS6}, u AS (SELECT gid, unnest(range(1, 7)) AS place, a, b, s FROM a), w AS (SELECT gid, place - 1 AS place, a[place] + b[place] AS plus, a[place] - b[place] AS minus, a[place] * b[place] AS times, a[place] * s AS scaled, a[place] / nullif(s, 0) AS divided, abs(a[place]) AS absolute,"
    f" a[place] / nullif(sqrt(list_sum(list_transform(a, lambda q: q * q))), 0) AS unit FROM u) {sql_rounded('gid, place', 'plus minus times scaled divided absolute unit', 'w', 6)}"
)
def vec_arith(spark, d):
    a, b, s = F.col("a"), F.col("b"), F.col("s")
    made = {"plus": V.plus(a, b), "minus": V.minus(a, b), "times": V.times(a, b), "scaled": V.scaled(a, s), "divided": V.divided(a, s), "absolute": V.absolute(a), "unit": V.normalize(a)}
    zipped = _vectors(spark, d).select("gid", F.posexplode(F.arrays_zip(*[c.alias(k) for k, c in made.items()])).alias("place", "q"))
    return rounded(zipped.select("gid", F.col("place").cast("bigint").alias("place"), "q.*"), ["gid", "place"], list(made), 6)


@query(
    f"WITH {_E}, {_PARTS6} SELECT gid, a = b AS same, a = list_reverse(list_reverse(a)) AS equal_itself, list_bool_and(list_transform(range(1, 7), lambda k: a[k] <= b[k])) AS at_most,"
    f" list_bool_and(list_transform(range(1, 7), lambda k: abs(a[k] - b[k]) <= 0.3)) AS close, CASE WHEN s > 0 THEN a[1] ELSE b[1] END AS chosen FROM a"
)
def vec_compare(spark, d):
    a, b = F.col("a"), F.col("b")
    return _vectors(spark, d).select(
        "gid", (a == b).alias("same"), (a == F.reverse(F.reverse("a"))).alias("equal_itself"), V.all_at_most(a, b).alias("at_most"), V.almost_equal(a, b, 0.3).alias("close"),
        V.select_if(F.col("s") > 0, F.get(a, F.lit(0)), F.get(b, F.lit(0))).alias("chosen"),
    )


@query(
    f"WITH {_E} SELECT gid, list_position(v, list_min(v))::BIGINT - 1 AS least, list_position(list_transform(v, lambda q: abs(q)), list_min(list_transform(v, lambda q: abs(q))))::BIGINT - 1 AS nearest,"
    " round(coalesce(list_sum(list_filter(v, lambda q: q > 0.3)) / nullif(len(list_filter(v, lambda q: q > 0.3)), 0), 0), 6) + 0.0 AS mean FROM e"
)
def argmin_mean(spark, d):
    v = F.col("v")
    large = F.filter(v, lambda q: q > 0.3)
    return embeddings(spark, d).select("gid", V.argmin(v).alias("least"), V.argmin(v, lambda q: F.abs(q)).alias("nearest"), r(V.mean(large), 6).alias("mean"))


@query(f"WITH {_E}, u AS (SELECT gid, unnest(range(1, 7)) AS place, v FROM e) SELECT gid, place - 1 AS place, v[place] AS a, CASE WHEN place <= 4 THEN v[place + 20] END AS b FROM u")
def zip_unequal(spark, d):
    """The second array is shorter: pairs are as many as the first has elements."""
    own = embeddings(spark, d).select("gid", V.zipped(F.slice("v", 1, 6), F.slice("v", 21, 4)).alias("ab"))
    return own.select("gid", F.posexplode("ab").alias("place", "q")).select("gid", F.col("place").cast("bigint").alias("place"), "q.a", "q.b")


@query(f"WITH {_E}, f AS (SELECT gid, flatten([v[1:9], [], v[10:]]) AS w FROM e) SELECT gid, unnest(range(len(w))) AS place, unnest(w) AS value FROM f")
def flatten_whole(spark, d):
    lists = F.flatten(F.array(F.slice("v", 1, 9), F.array().cast("array<double>"), F.slice("v", F.lit(10), F.size("v"))))
    return embeddings(spark, d).select("gid", F.posexplode(lists).alias("place", "value")).withColumn("place", F.col("place").cast("bigint"))


@query(f"WITH {_E}, s AS (SELECT gid, unnest(range(65)) AS place, v FROM e) SELECT gid, place, round(coalesce(list_sum(v[1:place]), 0), 5) + 0.0 AS value FROM s")
def scan_left_values(spark, d):
    own = embeddings(spark, d).select("gid", F.posexplode(V.scan_left(F.col("v"), F.lit(0.0))).alias("place", "value"))
    return own.select("gid", F.col("place").cast("bigint").alias("place"), r("value", 5).alias("value"))


@query(f"WITH {P} SELECT gid, unnest(range(3)) AS place, unnest(CASE WHEN gid % 2 = 0 THEN [x, y, z] ELSE [x, y, 0.0::DOUBLE] END) AS value FROM p")
def in_three(spark, d):
    own = particles(spark, d).select("gid", V.in_three(F.col("x"), F.col("y"), F.when(F.col("gid") % 2 == 0, F.col("z"))).alias("a"))
    return own.select("gid", F.posexplode("a").alias("place", "value")).withColumn("place", F.col("place").cast("bigint"))


@query(
    f"WITH {P}, q AS (SELECT gid, x, y, z, y * y - 4 * x * z AS d FROM p), w AS (SELECT gid, CASE WHEN y > 0 THEN 2 * z / (-y - sqrt(d)) ELSE (-y + sqrt(d)) / (2 * x) END AS first,"
    " CASE WHEN y < 0 THEN 2 * z / (-y + sqrt(d)) ELSE (-y - sqrt(d)) / (2 * x) END AS second FROM q WHERE x <> 0 AND d >= 0) SELECT gid, round(first, 4) + 0.0 AS first, round(second, 4) + 0.0 AS second FROM w"
)
def both_roots(spark, d):
    own = particles(spark, d).select("gid", V.quadratic_roots(F.col("x"), F.col("y"), F.col("z")).alias("s")).where("size(s) = 2")
    return own.select("gid", r(F.get("s", F.lit(0))).alias("first"), r(F.get("s", F.lit(1))).alias("second"))


@query("SELECT vec_id AS gid, CASE WHEN vec_id % 5 = 0 THEN 3.4028234663852886e38::DOUBLE WHEN vec_id % 5 = 1 THEN -3.4028234663852886e38::DOUBLE ELSE (embedding[1]::DOUBLE / 3)::FLOAT::DOUBLE END AS value FROM embeddings")
def narrowed(spark, d):
    wide = F.when(F.col("gid") % 5 == 0, float("inf")).when(F.col("gid") % 5 == 1, float("-inf")).otherwise(F.get("v", F.lit(0)) / 3)
    return embeddings(spark, d).select("gid", V.narrowed(wide).cast("double").alias("value"))


# Series of a trace


@query(f"WITH {T} SELECT iteration, round((1 + sum(coalesce(efficiency, 0)) OVER (ORDER BY iteration)) / (1 + row_number() OVER (ORDER BY iteration)), 6) + 0.0 AS value FROM s")
def running_eff_initial(spark, d):
    """The mean of all efficiencies so far, the initial one (1) included."""
    before = metrics.ordered()
    own = stats(spark, d).select("run", "iteration", F.coalesce("efficiency", F.lit(0.0)).alias("e"))
    return own.select("iteration", r((1 + F.sum("e").over(before)) / (1 + F.count(F.lit(1)).over(before)), 6).alias("value"))


@query(f"WITH {T}, k AS (SELECT iteration, CASE WHEN (iteration + 1) % 10 = 0 THEN sum_it / 10 END AS cost FROM s) SELECT iteration, round(coalesce(last_value(cost IGNORE NULLS) OVER (ORDER BY iteration), 0), 4) + 0.0 AS cost FROM k")
def last_lb_cost(spark, d):
    """The cost of the last rebalancing so far, here a tenth of its iteration's work; 0 before the first."""
    own = stats(spark, d).withColumn("cost", F.when((F.col("iteration") + 1) % FRAME == 0, F.col("sum_it") / 10))
    return own.select("iteration", r(F.coalesce(F.last("cost", ignorenulls=True).over(metrics.ordered()), F.lit(0.0))).alias("cost"))


@query(f"WITH {T}, f AS (SELECT iteration // 10 AS frame, sum(max_it) AS own FROM s GROUP BY 1), o AS (SELECT frame, coalesce(sum(own) OVER (ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM f) SELECT iteration, round(start + sum(max_it) OVER (PARTITION BY frame ORDER BY iteration), 4) + 0.0 AS value FROM s JOIN o ON iteration // 10 = frame")
def path_history(spark, d):
    """Cumulative time along a path of frames: each starts from the end of the one before."""
    own = stats(spark, d).withColumn("frame", F.expr(f"iteration div {FRAME}"))
    ends = own.groupBy("run", "frame").agg(F.sum("max_it").alias("own"))
    before = Window.partitionBy("run").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select("run", "frame", F.coalesce(F.sum("own").over(before), F.lit(0.0)).alias("start"))
    within = Window.partitionBy("run", "frame").orderBy("iteration")
    return own.join(starts, ["run", "frame"]).select("iteration", r(F.col("start") + F.sum("max_it").over(within)).alias("value"))


@query(f"WITH {T}, q AS (SELECT DISTINCT (floor(epoch(ts))::BIGINT - 1704067200) // 21600 AS iteration FROM events WHERE value > 99) SELECT iteration, q.iteration IS NOT NULL AS decision FROM l LEFT JOIN q USING (iteration)")
def crit_scenario(spark, d):
    """Decisions read from a scenario table: iterations with a very large event."""
    bucket = F.expr(f"timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', ts) div {traces.BUCKET_SECONDS}")
    scenario = spark.read.parquet(f"{d}/events.parquet").where("value > 99").select(bucket.alias("iteration")).distinct()
    return metrics.reproduce(stats(spark, d), scenario)


_RUNS = """e AS (SELECT (user_id // 4) % 3 AS run, (floor(epoch(ts))::BIGINT - 1704067200) // 21600 AS iteration, (user_id % 4)::INT AS rank, value FROM events),
t AS (SELECT run, iteration, rank, round(sum(value), 6) AS it_time FROM e GROUP BY ALL),
s AS (SELECT run, iteration, max(it_time) AS max_it, sum(it_time) AS sum_it FROM t GROUP BY ALL),
l AS (SELECT run, iteration, row_number() OVER w AS k, coalesce(lag(max_it) OVER w, 0) - coalesce(lag(sum_it) OVER w, 0) / 4.0::DOUBLE AS u FROM s WINDOW w AS (PARTITION BY run ORDER BY iteration))"""


@query(
    f"""WITH RECURSIVE {_RUNS}, f AS (SELECT DISTINCT run, 0::BIGINT AS k, -1::BIGINT AS iteration, 0.0::DOUBLE AS cum, false AS dec FROM l UNION ALL
SELECT run, k, iteration, CASE WHEN cum >= 700.0 THEN 0.0::DOUBLE ELSE cum END, cum >= 700.0 FROM (SELECT l.run, l.k, l.iteration, f.cum + l.u AS cum FROM f JOIN l ON l.run = f.run AND l.k = f.k + 1))
SELECT run, iteration FROM f WHERE dec"""
)
def crit_menon_runs(spark, d):
    """The cumulative criterion over three runs at once, each folded on its own."""
    trace = traces.from_events(spark, d, runs=3)
    return metrics.fold(metrics.lagged(metrics.iteration_stats(trace, keys=("run", "iteration"))), "menon", 700.0)


_TWELVE = ["imbalance", "cum_imbalance", "van_cum_imbalance", "time", "cum_time", "efficiency", "lb_it", "lb_cost", "interactions", "numofneighbors", "flbperf", "fseqtime"]


@query(
    f"""WITH {T}, n AS (SELECT iteration, count(*)::DOUBLE AS interactions, count(DISTINCT rank)::DOUBLE AS numofneighbors FROM e GROUP BY 1),
e1 AS (SELECT *, sum(((iteration + 1) % 10 = 0)::INT) OVER (ORDER BY iteration) AS epoch FROM s),
e2 AS (SELECT *, first(imbalance_time) OVER (PARTITION BY epoch ORDER BY iteration) AS base FROM e1),
w AS (SELECT iteration, imbalance, sum(greatest(0.0, imbalance_time - base)) OVER k AS cum_imbalance, sum(imbalance_time) OVER k AS van_cum_imbalance, max_it AS time,
 sum(max_it) OVER (ORDER BY iteration) AS cum_time, efficiency, CASE WHEN (iteration + 1) % 10 = 0 THEN iteration::DOUBLE END AS lb_it, CASE WHEN (iteration + 1) % 10 = 0 THEN 2000.0::DOUBLE END AS lb_cost,
 interactions, numofneighbors, CASE WHEN iteration % 10 = 9 THEN sum(max_it) OVER (PARTITION BY iteration // 10) END AS flbperf, CASE WHEN iteration % 10 = 9 THEN sum(sum_it) OVER (PARTITION BY iteration // 10) END AS fseqtime
 FROM e2 JOIN n USING (iteration) WINDOW k AS (PARTITION BY epoch ORDER BY iteration))
UNPIVOT (SELECT iteration, {", ".join(f"round({c}, 4) + 0.0 AS {c}" for c in _TWELVE)} FROM w) ON {", ".join(_TWELVE)} INTO NAME metric VALUE value"""
)
def metric_series(spark, d):
    """All twelve series of a run in long form; those of rebalancings and frames only where there is one."""
    own = metrics.epochs(stats(spark, d), FRAME)
    frame = Window.partitionBy("run", F.expr(f"iteration div {FRAME}"))
    last = F.col("iteration") % FRAME == FRAME - 1
    bucket = F.expr(f"timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', ts) div {traces.BUCKET_SECONDS}").alias("iteration")
    seen = spark.read.parquet(f"{d}/events.parquet").groupBy(bucket).agg(F.count(F.lit(1)).cast("double").alias("interactions"), F.count_distinct(F.col("user_id") % traces.RANKS).cast("double").alias("numofneighbors"))
    wide = own.join(seen, "iteration").select(
        "iteration", "imbalance", "cum_imbalance", "van_cum_imbalance", F.col("max_it").alias("time"), F.sum("max_it").over(metrics.ordered()).alias("cum_time"), "efficiency",
        F.when(F.col("lb"), F.col("iteration").cast("double")).alias("lb_it"), F.when(F.col("lb"), F.lit(COST)).alias("lb_cost"), "interactions", "numofneighbors",
        F.when(last, F.sum("max_it").over(frame)).alias("flbperf"), F.when(last, F.sum("sum_it").over(frame)).alias("fseqtime"),
    )
    return rounded(wide, ["iteration"], _TWELVE).unpivot("iteration", _TWELVE, "metric", "value").where("value IS NOT NULL")


@query(f"WITH {T}, w AS (SELECT iteration, max_it, sum_it / 8.0::DOUBLE AS avg_it, max_it - sum_it / 8.0::DOUBLE AS imbalance_time FROM s) {sql_rounded('iteration', 'max_it avg_it imbalance_time', 'w', 6)}")
def iter_stats_ranks(spark, d):
    """Eight ranks, four of them without any work: the mean is over all of them."""
    return rounded(metrics.iteration_stats(traces.from_events(spark, d), ranks=8), ["iteration"], ["max_it", "avg_it", "imbalance_time"], 6)


@query(f"WITH {T} SELECT 'time' AS metric, iteration, printf('%.3f', max_it) AS line FROM s UNION ALL SELECT 'interactions', iteration, printf('%.3f', count(*)::DOUBLE) FROM e GROUP BY iteration")
def series_text(spark, d):
    """The lines of two series' text files."""
    own = stats(spark, d).select(F.lit("time").alias("metric"), "iteration", F.col("max_it").alias("value"))
    bucket = F.expr(f"timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', ts) div {traces.BUCKET_SECONDS}").alias("iteration")
    seen = spark.read.parquet(f"{d}/events.parquet").groupBy(bucket).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return sinks.series_lines(own.unionByName(seen.select(F.lit("interactions").alias("metric"), "iteration", "value")), 3)
