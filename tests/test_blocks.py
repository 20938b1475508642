"""Pairs and forces by blocks, against the plain join: split cells, odd rows, and how evenly they are dealt out."""

import random

import pytest
from pyspark.sql import functions as F

from haloframe.functions.vectors import lj_coefficient
from haloframe.operators import blocks, physics, spatial
from haloframe.plans import catalogue

DIMS, SIG = ("x", "y"), 0.05


@pytest.fixture(scope="module")
def crowd(spark):
    """Half of all rows in one cell, two at one place, some without a position or an id, one far off."""
    rng = random.Random(9)
    rows = [(k, rng.random(), rng.random()) if k % 2 else (k, rng.uniform(-6, 6), rng.uniform(-6, 6)) for k in range(1600)]
    rows += [(1998, 0.25, 0.5), (1999, 0.25, 0.5), (2000, None, 0.5), (2001, 0.5, None), (2002, 40.0, 40.0), (None, 0.5, 0.5), (2003, float("nan"), 0.5)]
    return spatial.with_cells(spark.createDataFrame(rows, "gid long, x double, y double"), 1.0, DIMS).cache()


def _plain(receivers, sources):
    pairs = spatial.neighbour_pairs(receivers, sources, DIMS)
    apart = {d: F.col(d) - F.col(f"{d}_s") for d in DIMS}
    k = lj_coefficient(apart["x"] * apart["x"] + apart["y"] * apart["y"], 1.0, SIG)
    return {r["gid"]: r for r in pairs.groupBy("gid").agg(*[F.sum(k * apart[d]).alias(f"f{d}") for d in DIMS], F.count(F.lit(1)).alias("interactions")).collect()}


def _same(got, want):
    assert {g for g, r in got.items() if r["interactions"]} == set(want)
    for g, r in want.items():
        assert got[g]["interactions"] == r["interactions"]
        for f in ("fx", "fy"):
            assert got[g][f] == pytest.approx(0.0 if r[f] is None else r[f], rel=1e-9, abs=1e-7, nan_ok=True)


@pytest.mark.parametrize("block, at_once", [(blocks.BLOCK, blocks.AT_ONCE), (40, blocks.AT_ONCE), (40, 64), (3, 1 << 20)])
def test_forces_by_blocks(spark, crowd, monkeypatch, block, at_once):
    monkeypatch.setattr(blocks, "AT_ONCE", at_once)
    sums = blocks.force_parts(crowd, crowd, 1.0, SIG, DIMS, block).groupBy("gid").agg(F.sum("fx").alias("fx"), F.sum("fy").alias("fy"), F.sum("interactions").alias("interactions"))
    _same({r["gid"]: r for r in sums.collect()}, _plain(crowd, crowd))


def test_sources_that_lost_their_position(spark, crowd):
    """Sources in a cell but without a position are counted and push nothing; receivers and sources differ in their cells."""
    lost = crowd.withColumn("x", F.when(F.col("gid") % 5 == 0, None).otherwise(F.col("x"))).withColumn("cx", F.col("cx") + 1)
    sums = blocks.force_parts(crowd, lost, 1.0, SIG, DIMS, 100).groupBy("gid").agg(F.sum("fx").alias("fx"), F.sum("fy").alias("fy"), F.sum("interactions").alias("interactions"))
    _same({r["gid"]: r for r in sums.collect()}, _plain(crowd, lost))
    assert blocks.force_parts(crowd.limit(0), crowd, 1.0, SIG, DIMS).count() == 0


@pytest.mark.parametrize("block", [blocks.ROWS_BLOCK, 5])
def test_pairs_by_blocks(spark, crowd, block):
    plain = spatial.neighbour_pairs(crowd, crowd, DIMS).select("gid", "gid_s")
    got = blocks.id_pairs(crowd, crowd, DIMS, block)
    assert got.count() == plain.count() and got.exceptAll(plain).isEmpty()


def test_names_as_ids(spark, crowd):
    named = crowd.withColumn("gid", F.concat(F.lit("p"), F.col("gid")))
    sums = blocks.force_parts(named, named, 1.0, SIG, DIMS, 50).groupBy("gid").agg(F.sum("interactions").alias("n"))
    assert {r["gid"]: r["n"] for r in sums.collect() if r["n"]} == {f"p{g}": r["interactions"] for g, r in _plain(crowd, crowd).items()}


@pytest.mark.parametrize("of", ["pairs", "forces"])
def test_a_crowded_cell_is_dealt_out(spark, crowd, of, monkeypatch):
    """No task makes many more pairs than the others; the plain join put over half of all pairs into one."""
    for key, value in (("spark.sql.autoBroadcastJoinThreshold", "-1"), ("spark.sql.adaptive.enabled", "false"), ("spark.sql.shuffle.partitions", "16")):
        spark.conf.set(key, value)
    try:
        if of == "pairs":
            monkeypatch.setattr(blocks.id_pairs, "__defaults__", (*blocks.id_pairs.__defaults__[:-1], 24))
            monkeypatch.setattr(catalogue, "celled", lambda *_: crowd.withColumn("z", F.lit(0.0)).withColumn("cz", F.lit(0).cast("bigint")))
            made = catalogue.QUERIES["pair_list"](spark, "").groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n"))
        else:
            made = blocks.force_parts(crowd, crowd, 1.0, SIG, DIMS, 24).groupBy(F.spark_partition_id()).agg(F.sum("interactions").alias("n"))
        tasks = sorted(r["n"] for r in made.collect())
    finally:
        for key in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled"):
            spark.conf.unset(key)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(tasks) == 16 and tasks[-1] <= 3 * tasks[8]


def test_a_crowded_cell_is_filed_by_many_tasks(spark, crowd):
    """A cell's rows are filed block by block; before, the join that counts them brought all of them to one task."""
    for key, value in (("spark.sql.autoBroadcastJoinThreshold", "-1"), ("spark.sql.adaptive.enabled", "false"), ("spark.sql.shuffle.partitions", "16")):
        spark.conf.set(key, value)
    try:
        filed = blocks.blocks(crowd, F.col("gid"), DIMS, 24).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for key in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled"):
            spark.conf.unset(key)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    here = [r for r in filed if (r["cx"], r["cy"]) == (0, 0)]
    tasks = {t: sum(len(r["held"]) for r in here if r["task"] == t) for t in {r["task"] for r in here}}
    assert sum(tasks.values()) > 800 and max(tasks.values()) < sum(tasks.values()) / 3 and len(tasks) > 8
    assert sorted(g for r in filed for g in r["held"]) == sorted(r["gid"] for r in crowd.where("gid IS NOT NULL AND cx IS NOT NULL AND cy IS NOT NULL").collect())


def test_more_pairs_make_more_tasks(spark, crowd, monkeypatch):
    """A task's pairs do not grow with all pairs; before, the session's number of tasks was the most."""
    monkeypatch.setattr(blocks, "PAIRS_A_TASK", 20_000, raising=False)
    sums = blocks.force_parts(crowd, crowd, 1.0, SIG, DIMS, 24).groupBy(F.spark_partition_id()).agg(F.sum("interactions").alias("n")).collect()
    pairs = spatial.neighbour_pairs(crowd, crowd, DIMS).count()
    assert sum(r["n"] for r in sums) == pairs > 600_000 and max(r["n"] for r in sums) < 60_000
    assert blocks.tasks_for(crowd, crowd, DIMS) * 20_000 >= pairs and blocks.tasks_for(crowd.limit(0), crowd, DIMS) == 0


def test_more_rows_make_more_tasks(spark, crowd, monkeypatch):
    """A task of the pair list makes fewer pairs than one of forces, and of few ids; before, it made as many, of blocks from everywhere."""
    monkeypatch.setattr(blocks, "ROWS_A_TASK", 20_000, raising=False)
    plain = spatial.neighbour_pairs(crowd, crowd, DIMS).select("gid", "gid_s")
    got, held = blocks.id_pairs(crowd, crowd, DIMS, 4), []
    assert got.count() == plain.count() > 600_000 and got.exceptAll(plain).isEmpty()
    for together in (8, 1):
        monkeypatch.setattr(blocks, "TOGETHER", together, raising=False)
        tasks = blocks.id_pairs(crowd, crowd, DIMS, 4).groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("gid_s").alias("ids")).collect()
        assert max(r["n"] for r in tasks) < 60_000
        held.append(sum(r["ids"] for r in tasks))
    assert held[0] < held[1] / 3


@pytest.mark.parametrize("block", [blocks.BLOCK, 40, 3])
def test_two_blocks_meet_once(spark, crowd, block):
    """Each pair of different rows comes once, in one order or as one that stands for both, so little over half of them are made."""
    near = blocks.block_pairs(crowd, crowd, F.col("gid"), DIMS, block, once=True).cache()
    made = near.select(F.explode("mine").alias("gid"), "theirs", "twice").select("gid", F.explode("theirs").alias("gid_s"), "twice")
    both = made.select("gid", "gid_s").unionByName(made.where("twice").select(F.col("gid_s").alias("gid"), F.col("gid").alias("gid_s"))).where("gid <> gid_s")
    plain = spatial.neighbour_pairs(crowd, crowd, DIMS).select("gid", "gid_s")
    assert both.count() == plain.count() and both.exceptAll(plain).isEmpty()
    if block == 40:
        assert made.count() < 0.6 * plain.count()


def test_both_orders_of_odd_rows(spark, crowd):
    """An id that two cells hold meets itself in neither order, and lost positions push neither side."""
    lost = crowd.withColumn("x", F.when(F.col("gid") % 5 == 0, None).otherwise(F.col("x")))
    lost = lost.unionByName(lost.where("gid % 7 = 1").withColumn("cx", F.col("cx") + 1)).cache()
    apart = lost.select("*")  # another DataFrame: every order is made
    for block in (100, 7):
        sums = [blocks.force_parts(lost, s, 1.0, SIG, DIMS, block).groupBy("gid").agg(F.sum("fx").alias("fx"), F.sum("fy").alias("fy"), F.sum("interactions").alias("interactions")) for s in (lost, apart)]
        _same({r["gid"]: r for r in sums[0].collect()}, {r["gid"]: r for r in sums[1].collect() if r["interactions"]})
        _same({r["gid"]: r for r in sums[0].collect()}, _plain(lost, lost))


@pytest.mark.parametrize("block", [blocks.BLOCK, 40, 7])
def test_rows_that_stayed_meet_once(spark, crowd, block):
    """A part of the rows left its cell: the others are the same on both sides, so their blocks meet once."""
    here = crowd.withColumn("stayed", F.when(F.col("gid") % 9 == 0, None).otherwise(F.col("gid") % 5 != 0)).withColumn("x", F.when(F.col("gid") % 11 == 0, None).otherwise(F.col("x")))
    there = here.withColumn("cx", F.when(F.col("stayed"), F.col("cx")).otherwise(F.col("cx") + F.col("gid") % 3 - 1)).cache()
    sums = blocks.force_parts(here, there, 1.0, SIG, DIMS, block, same="stayed").groupBy("gid").agg(F.sum("fx").alias("fx"), F.sum("fy").alias("fy"), F.sum("interactions").alias("interactions"))
    _same({r["gid"]: r for r in sums.collect()}, _plain(here, there))
    if block == 40:
        made = blocks.block_pairs(here, there, F.col("gid"), DIMS, block, once="stayed").agg(F.sum(F.size("mine") * F.size("theirs")), F.sum(F.when(F.col("twice"), 1))).first()
        assert made[1] and made[0] < 0.8 * spatial.neighbour_pairs(here, there, DIMS).count()


def test_a_step_makes_fewer_pairs(spark):
    """A step hands on which particles stayed; before, every pair was made in both orders."""
    rng = random.Random(4)
    rows = [(k, *[rng.uniform(0, 0.2) for _ in range(3)], *[rng.uniform(-0.1, 0.1) for _ in range(3)]) for k in range(600)]
    own = spark.createDataFrame(rows, "gid long, x double, y double, z double, vx double, vy double, vz double")
    made, plain = [], blocks.block_pairs

    def counted(receivers, sources, held, dims, block, **how):
        made.append((plain(receivers, sources, held, dims, 20, **how), receivers, sources))
        return made[-1][0]

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(blocks, "block_pairs", counted)
        stepped = physics.step(own, **catalogue.STEP)
        assert stepped.columns == [*own.columns, "fx", "fy", "fz", "interactions"] and stepped.count() == 600
    ((near, receivers, sources),) = made
    assert near.agg(F.sum(F.size("mine") * F.size("theirs"))).first()[0] < 0.8 * spatial.neighbour_pairs(receivers, sources).count()
