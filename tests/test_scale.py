"""Counts by stencil, split cells, indexed halos, block scans and resets, against plain forms; and what their plans hold."""

import random
import re
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from haloframe.operators import halos, resets, spatial, stencil
from haloframe.operators.scan import blocked, scan


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def crowd(spark):
    """Half of all rows in one cell, the others spread over its surroundings and beyond; some without a position."""
    rng = random.Random(5)
    rows = [(k, rng.random(), rng.random()) if k % 2 else (k, rng.uniform(-6, 6), rng.uniform(-6, 6)) for k in range(1600)]
    rows += [(2000, None, 0.5), (2001, 0.5, None), (2002, 40.0, 40.0)]
    return spatial.with_cells(spark.createDataFrame(rows, "gid long, x double, y double"), 1.0, ("x", "y")).cache()


def test_stencil_counts(spark, crowd):
    cells = Counter((r["cx"], r["cy"]) for r in crowd.collect() if r["cx"] is not None and r["cy"] is not None)
    expected = {c: (n, n * sum(cells[c[0] + i, c[1] + j] for i, j in product((-1, 0, 1), repeat=2))) for c, n in cells.items()}
    got = stencil.cell_interactions(crowd, ("x", "y"))
    assert {(r["cx"], r["cy"]): (r["n"], r["interactions"]) for r in got.collect()} == expected
    assert "Join" not in _plan(got)
    pairs = spatial.neighbour_pairs(crowd, crowd, ("x", "y")).count()
    total = stencil.pair_count(crowd, ("x", "y")).first()
    assert total["pairs"] == pairs and total["interactions"] == pairs + sum(cells.values())
    parted = crowd.withColumn("part", F.col("gid") % 3)
    parts = {r["part"]: (r["n"], r["interactions"]) for r in stencil.part_interactions(parted, ("x", "y")).collect()}
    by_pairs = {r["part"]: r["n"] for r in spatial.neighbour_pairs(crowd, crowd, ("x", "y")).groupBy((F.col("gid") % 3).alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert {p: i - n for p, (n, i) in parts.items()} == by_pairs
    assert stencil.pair_count(crowd.limit(0), ("x", "y")).first()["pairs"] == 0


def test_crowded_cells_are_split(spark, crowd):
    plain = spatial.neighbour_pairs(crowd, crowd, ("x", "y")).select("gid", "gid_s")
    split = stencil.split_pairs(crowd, crowd, ("x", "y"), share=64)
    assert split.count() == plain.count() and split.select("gid", "gid_s").exceptAll(plain).isEmpty()
    for key, value in (("spark.sql.autoBroadcastJoinThreshold", "-1"), ("spark.sql.adaptive.enabled", "false"), ("spark.sql.shuffle.partitions", "16")):
        spark.conf.set(key, value)
    try:
        own = stencil.split_pairs(crowd, crowd, ("x", "y"), share=256)
        tasks = sorted(r["count"] for r in own.groupBy(F.spark_partition_id()).count().collect())
        whole = sorted(r["count"] for r in spatial.neighbour_pairs(crowd, crowd, ("x", "y")).groupBy(F.spark_partition_id()).count().collect())
    finally:
        for key in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled"):
            spark.conf.unset(key)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(tasks) == 16 and tasks[-1] <= 3 * tasks[8]
    assert whole[-1] > 5 * whole[len(whole) // 2]
    hot = stencil.crowded(crowd, crowd, ("x", "y"), share=64).collect()
    assert 0 < len(hot) < 64 and all(r["side"] > 1 for r in hot)
    assert stencil.split_pairs(crowd.limit(0), crowd, ("x", "y")).count() == 0


@pytest.mark.parametrize("most", [halos.INDEX_ROWS, 0])
def test_halos_of_many_parts(spark, most):
    rng, halo = np.random.default_rng(7), 0.02
    points, low = rng.random((3000, 3)), rng.random((2000, 3))
    high = low + rng.random((2000, 3)) * np.where(rng.random((2000, 1)) < 0.02, 0.6, 0.03)  # a few parts are large
    points[:200] = high[:200] + halo  # at the border
    rows = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(points)] + [(9000, None, 0.1, 0.1)], "gid long, x double, y double, z double")
    boxes = spark.createDataFrame([(k, *map(float, lo), *map(float, hi)) for k, (lo, hi) in enumerate(zip(low, high, strict=True))] + [(9000, None, *[0.0] * 5)], "to int, xlo double, ylo double, zlo double, xhi double, yhi double, zhi double")
    got = halos.near_boxes(rows, boxes, halo, most=most, share=20)
    pairs = Counter((r["gid"], r["to"]) for r in got.select("gid", "to").collect())
    inside = ((points[:, None] + halo >= low) & (points[:, None] - halo <= high)).all(2)
    assert pairs == Counter({(int(i), int(j)): 1 for i, j in zip(*np.nonzero(inside), strict=True)})
    assert not re.search("NestedLoop|Cartesian", _plan(got)) and set(got.columns) == {"gid", *"xyz", *boxes.columns}
    assert halos.near_boxes(rows, boxes.limit(0), halo, most=most).count() == 0
    # Boxes of one size use few levels, however many they are.
    assert halos.file_boxes(boxes, halo).select("level").distinct().count() <= 7


@pytest.mark.parametrize("blocks", [1, 6])
@pytest.mark.parametrize("reverse", [False, True])
@pytest.mark.parametrize("inclusive", [False, True])
def test_scans(spark, blocks, reverse, inclusive):
    rng = random.Random(blocks)
    rows = [(run, i, None if rng.random() < 0.2 else float(rng.randint(-9, 9))) for run in (None, 1, 2, 3) for i in range({None: 30, 1: 200, 2: 1, 3: 7}[run])]
    df = spark.createDataFrame(rows, "run int, i long, v double")
    values = {k: (k, F.col("v")) for k in ("sum", "count", "min", "max", "last")}
    found = scan(blocked(df, ["run"], ["i"], blocks), ["run"], ["i"], values, inclusive, reverse)
    for r in found.collect():
        own = [v for run, i, v in rows if run == r["run"] and (i > r["i"] if reverse else i < r["i"]) or (inclusive and (run, i) == (r["run"], r["i"]))]
        own = [v for v in (reversed(own) if reverse else own) if v is not None]
        assert (r["sum"], r["count"], r["min"], r["max"], r["last"]) == ((sum(own), len(own), min(own), max(own), own[-1]) if own else (None, 0, None, None, None))
    assert found.count() == len(rows) and (blocks == 1 or found.select("block").distinct().count() > 3)
    windows = re.findall(r"Window \[.*", _plan(found))
    assert windows and all(re.search(r"block#", w.split("windowspecdefinition(")[1].split(" ASC")[0].split(" DESC")[0]) for w in windows)


def _fold(u, cost):
    total, fired = 0.0, []
    for k, x in enumerate(u):
        total += x
        if total >= cost:
            fired.append(k)
            total = 0.0
    return fired


def test_resets_of_odd_runs(spark):
    runs = {1: [1.0] * 20, 2: [0.0] * 5, 3: [5.0, 0.0, 0.0, 5.0, 7.0], 4: [2.5], 5: [0.5, 0.25, 0.25, 0.0, 3.0, 0.0, 1.0]}
    df = spark.createDataFrame([(run, k, x) for run, u in runs.items() for k, x in enumerate(u)] + [(6, 0, None)], "run int, iteration long, u double")
    for cost in (0.0, 1.0, 2.5, 100.0):
        got = sorted((r["run"], r["iteration"]) for r in resets.resets(df, cost, blocks=5).collect())
        assert got == sorted((run, k) for run, u in (runs | {6: [0.0]}).items() for k in _fold(u, cost))
    assert resets.resets(df.limit(0), 1.0).count() == 0


def test_resets_of_a_million_iterations(spark):
    n, cost = 1_000_000, 2_000.0
    u = F.pmod(F.xxhash64("id"), F.lit(1000)) / F.lit(256.0)  # exact in both forms
    df = spark.range(n).select(F.lit(1).alias("run"), F.col("id").alias("iteration"), u.alias("u"))
    pointers = resets.next_resets(df, cost, blocks=12)
    assert sorted(r["count"] for r in pointers.groupBy(F.spark_partition_id()).count().collect())[-1] < n // 4
    got = sorted(r["iteration"] for r in resets.chain(pointers).collect())
    assert got == _fold([r["u"] for r in df.orderBy("iteration").select("u").toLocalIterator()], cost)
