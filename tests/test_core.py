"""Hand cases and invariants of the particle and schedule operators, and each query against its SQL."""

from itertools import product

import duckdb
import pytest
from pyspark.sql import functions as F

from haloframe.operators import partitions, physics, search, spatial
from haloframe.plans import catalogue, measures
from haloframe.sources import particles, sinks

SF = "/root/testdata/sf0.001"


def frame(spark, points):
    return spark.createDataFrame([(i, *map(float, p), 0.0, 0.0, 0.0) for i, p in enumerate(points)], "gid long, x double, y double, z double, vx double, vy double, vz double")


def forces(spark, points, rc=0.1):
    own = spatial.with_cells(frame(spark, points), rc)
    return {r["gid"]: r for r in spatial.pair_forces(own, own, 1.0, 0.05).collect()}


def test_pair_is_antisymmetric_and_counted(spark):
    got = forces(spark, [(0.01, 0, 0), (0.07, 0, 0)])
    assert got[0]["fx"] == -got[1]["fx"] != 0
    assert sum(r["interactions"] for r in got.values()) == 4


def test_coincident_and_isolated(spark):
    got = forces(spark, [(0, 0, 0), (0, 0, 0), (5, 5, 5)])
    assert got[0]["fx"] == 0 and got[0]["interactions"] == 2
    assert got[2]["fx"] == 0 and got[2]["interactions"] == 1


def test_cells_bound_what_interacts(spark):
    got = forces(spark, [(-0.01, 0, 0), (0.19, 0, 0), (0.05, 0, 0)])
    assert (got[0]["interactions"], got[1]["interactions"], got[2]["interactions"]) == (2, 2, 3)


@pytest.mark.parametrize("bounce, x, v", [(1.0, 0.8, -1.0), (0.5, 0.9, -0.5), (0.0, 1.0, 0.0)])
def test_reflection(spark, bounce, x, v):
    row = spark.createDataFrame([(0, 1.2, 1.0)], "gid long, x double, vx double")
    got = physics.reflect_box(row, 0.0, 1.0, bounce, ("x",)).first()
    assert got["x"] == pytest.approx(x) and got["vx"] == pytest.approx(v)


def test_clamp_loses_the_sign(spark):
    row = spark.range(1).select(physics.clamped(F.lit(-2 * 0.1 / 0.05), 0.1, 0.05).alias("v")).first()
    assert row["v"] == pytest.approx(0.5 * 0.1 / 0.05)


def test_best_schedule_against_brute_force():
    frames = list(range(7))
    costs = {(i, j): 3.0 + (j - i) ** 2 for i in frames for j in frames if i <= j}

    def cost(chosen):
        at, total = 0, 0.0
        for f in frames:
            if f in chosen:
                at, total = f, total + (4.0 if f else 0.0)
            total += costs[at, f]
        return total

    least = min(cost({0, *(f for f, on in zip(frames[1:], picks, strict=True) if on)}) for picks in product([0, 1], repeat=6))
    assert search.best_schedule(costs, frames, 4.0)[0] == pytest.approx(least)


def test_sinks(spark, tmp_path):
    rows = frame(spark, [(0, 1, 2), (3, 4, 5)]).withColumn("frame", F.lit(7)).withColumn("part", F.lit(1))
    sinks.write_frames(rows, f"{tmp_path}/frames")
    lines = [x for f in sorted((tmp_path / "frames" / "frame=7").glob("*.csv")) for x in f.read_text().splitlines()]
    assert lines[0] == "x coord,y coord,z coord ,rank" and {"0.0,1.0,2.0,1", "3.0,4.0,5.0,1"} < set(lines)
    series = spark.createDataFrame([(i, m, i / 2) for i in range(20) for m in ("time", "imbalance")], "iteration long, metric string, value double")
    sinks.write_series(series, f"{tmp_path}/series")
    read = [x for f in sorted((tmp_path / "series" / "metric=time").glob("*.txt")) for x in f.read_text().split()]
    assert read == [str(i / 2) for i in range(20)]


@pytest.mark.parametrize("centre", [(1.0, 2.0, 3.0), (0.0, 0.0)])
def test_outside_the_ball(spark, centre):
    rows = particles.outside_ball(spark.range(500).withColumnRenamed("id", "gid"), 2.0, centre).collect()
    assert len(rows) == 500
    assert all(sum((r[c] - m) ** 2 for c, m in zip("xyz", centre)) > 1.0 for r in rows)  # noqa: B905


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in ("embeddings", "events", "part", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES | measures.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    got = (catalogue.QUERIES | measures.QUERIES)[name](spark, SF)
    names = sorted(got.columns)
    want = duck.execute((catalogue.ORACLES | measures.ORACLES)[name]).df()
    assert names == sorted(want.columns)
    plain = lambda rows: sorted(tuple("-" if v is None or v != v else str(float(v)) if isinstance(v, (int, float)) else str(v) for v in r) for r in rows)
    assert plain(got.select(*names).collect()) == plain(want[names].astype(object).itertuples(index=False, name=None))


def test_csv_file(spark, tmp_path):
    (tmp_path / "particles.in").write_text("1.5,2,3e-1,9\n-1,0.25\n")
    assert sorted(map(tuple, particles.read_csv(spark, f"{tmp_path}/particles.in").collect())) == [(-1.0, 0.25, None), (1.5, 2.0, 0.3)]


def test_generators(spark):
    ids = spark.range(400).withColumnRenamed("id", "gid")
    square = lambda r: sum(v * v for k, v in r.asDict().items() if k != "gid")
    assert all(0.5**2 <= square(r) <= 4 for r in particles.in_ball(ids, 2.0, 0.5).collect())
    assert all(square(r) == pytest.approx(9) for r in particles.on_sphere(ids, 3.0).collect())
    flat = particles.on_sphere(ids, 3.0, ("x", "y"))
    assert flat.columns == ["gid", "x", "y"] and all(square(r) <= 9.0001 for r in flat.collect())
    assert particles.in_ball(ids, 2.0).collect() == particles.in_ball(ids.repartition(7), 2.0).orderBy("gid").collect()
    never = particles.outside_ball(ids, 2.0, (0.0, 0.0), lambda k: F.lit(0.5) + 0 * F.col("gid"), 2).collect()
    assert len(never) == 400 and all(square(r) > 1 for r in never)


def test_dispatch_and_unary_force(spark):
    row = frame(spark, [(2, 0, 0)]).withColumn("vx", F.lit(1.0))
    assert physics.reflect(row, physics.Box(-1.0, 1.5)).first()["x"] == pytest.approx(1.0)
    assert physics.reflect(row, physics.Sphere(1.0, (0.5, 0.0, 0.0))).first()["x"] == pytest.approx(1.0)
    own = spatial.with_cells(frame(spark, [(5, 5, 5)]), 0.1)
    got = spatial.pair_forces(own, own, 1.0, 0.05, unary={"x": F.lit(2.0), "y": F.col("y"), "z": F.lit(0.0)}).first()
    assert (got["fx"], got["fy"], got["interactions"]) == (2.0, 5.0, 1)


def test_quantiles_of_histograms(spark):
    """The order statistics that percentile interpolates, found without gathering values: ties, few values, one, none."""
    rows = [(0, float(k * k % 97)) for k in range(500)] + [(1, 3.0)] * 40 + [(2, -1.5)] + [(3, float(k)) for k in range(6)]
    df = spark.createDataFrame(rows, "part int, v double")
    got = {r["part"]: r["ends"] for r in partitions.quantiles(df, "v", [0.25, 0.5, 0.75], most=4).collect()}
    want = {r["part"]: r["e"] for r in df.groupBy("part").agg(F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("e")).collect()}
    assert {k: pytest.approx(v) for k, v in want.items()} == got
