"""Queries over whole tables and whole arrays, and what their expressions give at the edges."""

import pytest
from pyspark.sql import functions as F

from haloframe.functions import vectors as V
from haloframe.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_quadratic_of_small_and_no_curvature(spark):
    rows = [(0, 1.0, -3.0, 2.0), (1, 0.0, 2.0, -1.0), (2, 0.0, 0.0, 1.0), (3, 1e-12, 1.0, -3.0), (4, 1.0, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "gid long, a double, b double, c double").select("gid", V.quadratic_roots(F.col("a"), F.col("b"), F.col("c")).alias("s"))
    got = {r["gid"]: r["s"] for r in df.collect()}
    assert got[0] == [2.0, 1.0] and got[1] == [0.5] and got[2] == got[4] == []
    assert got[3] == [pytest.approx(3.0, abs=1e-9), pytest.approx(-1e12)]


def test_scan_of_long_arrays(spark):
    df = spark.createDataFrame([(0, [1.0] * 20000), (1, []), (2, None), (3, [1.0, None, 2.0])], "gid long, v array<double>")
    got = {r["gid"]: r["s"] for r in df.select("gid", V.scan_left(F.col("v"), F.lit(0.0)).alias("s")).collect()}
    assert got[0] == [float(k) for k in range(20001)] and got[1] == [0.0] and got[2] is None and got[3] == [0.0, 1.0, None, None]


def test_whole_tables_are_read(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    for name in ("quadratic_whole", "scan_left_whole", "zip_unzip_whole"):
        assert catalogue.QUERIES[name](spark, SF).count() == rows
    assert catalogue.QUERIES["pair_list"](spark, SF).count() == catalogue.QUERIES["pair_count_3d"](spark, SF).first()["pairs"]
