"""Hilbert codes, equal loads, measured segments and points beyond a ball."""

import math
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from haloframe.operators import curves
from haloframe.sources import particles as sources


@pytest.mark.parametrize("dims,bits", [(2, 1), (2, 4), (3, 1), (3, 3)])
def test_neighbours_on_the_curve_are_neighbours_in_space(spark, dims, bits):
    names = [f"c{d}" for d in "xyz"[:dims]]
    cells = spark.createDataFrame(list(product(range(2**bits), repeat=dims)), ", ".join(f"{n} long" for n in names))
    at = {r["code"]: tuple(r[n] for n in names) for r in curves.coded_cells(cells, 0, bits, tuple("xyz"[:dims])).collect()}
    assert sorted(at) == list(range(2 ** (bits * dims)))
    assert all(sum(abs(a - b) for a, b in zip(at[k], at[k + 1], strict=True)) == 1 for k in range(len(at) - 1))


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_no_part_is_over_its_share_by_more_than_a_cell(spark, parts):
    rng = np.random.default_rng(3)
    loads = [int(x) for x in (rng.pareto(1.2, 400) * 10)] + [0, 0, 5_000]
    rows = spark.createDataFrame([(7 * k, x) for k, x in enumerate(loads)], "code long, load long")
    got = sorted(tuple(r) for r in curves.equal_loads(rows, parts).collect())
    assert [(c, x) for c, x, _ in got] == [(7 * k, x) for k, x in enumerate(loads)] and [p for *_, p in got] == sorted(p for *_, p in got)
    for part in range(parts):
        own = [x for _, x, p in got if p == part]
        assert sum(own) <= sum(loads) / parts + max(own, default=0)
    assert curves.equal_loads(rows.limit(0), parts).count() == 0
    assert {r["part"] for r in curves.equal_loads(rows.withColumn("load", F.lit(0)), parts).collect()} == {0}


def test_segments_follow_the_partition_of_their_frame(spark):
    rng = np.random.default_rng(4)
    hist = {(f, int(c)): int(n) for f in range(5) for c, n in zip(rng.choice(60, 25, replace=False) + 5 * f, rng.integers(1, 50, 25), strict=True)}
    got = {(r["lb_frame"], r["frame"]): r["cost"] for r in curves.segment_loads(spark.createDataFrame([(f, c, n) for (f, c), n in hist.items()], "frame int, code long, n long"), 4).collect()}
    expected = {}
    for i in range(5):
        own, before, starts = sorted((c, n) for (f, c), n in hist.items() if f == i), 0, {}
        for c, n in own:
            starts.setdefault(min(3, before * 4 // sum(x for _, x in own)), c)
            before += n
        for k in range(i, 5):
            held = [0] * 4
            for (f, c), n in hist.items():
                if f == k:
                    held[max((p for p, s in starts.items() if s <= c), default=0)] += n
            expected[i, k] = max(held)
    assert got == expected


@pytest.mark.parametrize("dims", [2, 3])
def test_points_beyond_a_ball(spark, dims):
    n, size, centre = 40_000, 4.0, (1.0, -2.0, 3.0)[:dims]
    rows = sources.beyond_ball(spark.range(n).withColumnRenamed("id", "gid"), size, centre).collect()
    at = np.array([[r[d] for d in "xyz"[:dims]] for r in rows]) - centre
    r = np.sqrt((at**2).sum(1)) / (size / 2)
    assert len(rows) == n and r.min() >= 1.0
    beyond = (lambda x: math.exp(-x * x / 2)) if dims == 2 else (lambda x: math.erfc(x / math.sqrt(2)) + math.sqrt(2 / math.pi) * x * math.exp(-x * x / 2))
    steps = np.sort(r)
    cdf = np.array([1 - beyond(x) / beyond(1.0) for x in steps])
    assert np.abs(cdf - (np.arange(n) + 0.5) / n).max() < 1.63 / math.sqrt(n)  # Kolmogorov-Smirnov at 1 %
    assert np.abs((at / np.sqrt((at**2).sum(1))[:, None]).mean(0)).max() < 4 / math.sqrt(n)


def test_radii_are_exact_at_the_ends(spark):
    us = [1 - 1e-12, 0.999, 0.5, 1e-3, 1e-9, 2.0**-53]
    got = [x["r"] for x in spark.createDataFrame([(u,) for u in us], "u double").select(sources.radius_beyond(F.col("u"), 3).alias("r")).collect()]
    beyond = lambda x: math.erfc(x / math.sqrt(2)) + math.sqrt(2 / math.pi) * x * math.exp(-x * x / 2)
    assert all(abs(math.log(beyond(r) / beyond(1.0)) - math.log(u)) < 1e-8 * (1 - math.log(u)) for r, u in zip(got, us, strict=True))
