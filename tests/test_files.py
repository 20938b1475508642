"""The particle reader and the frame writer: ranges, filters, malformed lines, two-phase commits."""

import os
from collections import Counter

import pyarrow.fs as fs
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql.functions import udf

from haloframe.sources import files


@pytest.fixture(scope="module", autouse=True)
def known(spark):
    files.register(spark)
    yield
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def _write(folder, texts):
    for name, text in texts.items():
        os.makedirs(os.path.dirname(f"{folder}/{name}"), exist_ok=True)
        with open(f"{folder}/{name}", "wb") as file:
            file.write(text)


@pytest.mark.parametrize("split", [1, 2, 7, 64, 1 << 20])
def test_lines_across_splits(spark, tmp_path, split):
    lines = [b"1,2,3", b"4.5,-1e-3,nan,9", b"", b"7,8", b"x,1,2", b"1_0,2,3", "9,é,1".encode(), b" 5 ,6,7"]
    _write(tmp_path, {"a.csv": b"\n".join(lines), "sub/b.csv": b"\r\n".join(lines) + b"\r\n", "_skip/c.csv": b"1,1,1\n", "empty.csv": b""})
    got = Counter(str(tuple(r)) for r in spark.read.format("particles").option("splitBytes", split).load(str(tmp_path)).collect())
    nan = float("nan")
    once = [(1.0, 2.0, 3.0, None), (4.5, -0.001, nan, None), (None, None, None, ""), (7.0, 8.0, None, None), (None, 1.0, 2.0, "x,1,2"), (None, 2.0, 3.0, "1_0,2,3"), (9.0, None, 1.0, "9,é,1"), (5.0, 6.0, 7.0, None)]
    assert got == Counter({str((*r, None)): 2 for r in once})


def test_filters_and_pruning(spark, tmp_path):
    _write(tmp_path, {f"frame={k}/part": b"".join(f"{k},{j},nan\n".encode() for j in range(5)) for k in range(6)})
    rows = spark.read.format("particles").load(str(tmp_path))
    some = rows.where("frame IN (1, 4) AND y >= 3 AND x < 4.5")
    assert sorted((r["frame"], r["x"], r["y"]) for r in some.collect()) == [(1, 1.0, 3.0), (1, 1.0, 4.0), (4, 4.0, 3.0), (4, 4.0, 4.0)]
    assert rows.where("z > 5").count() == 30 and rows.where("z < 5").count() == 0 and rows.where("frame = 9").count() == 0
    reader = files.LineReader({"path": str(tmp_path), "splitBytes": "10"}, ("x", "y", "z"))
    left = list(reader.pushFilters([files.api.EqualTo(("frame",), 3), files.api.StringContains(("malformed",), "x"), files.api.EqualTo(("x",), float("nan"))]))
    assert len(left) == 2 and {p.frame for p in reader.partitions()} == {3} and len(reader.partitions()) == 4


def test_frames_are_read_back(spark, tmp_path):
    rows = spark.range(200).select((F.col("id") % 3).cast("int").alias("frame"), *[(F.col("id") * m + 0.5).alias(d) for d, m in (("x", 1), ("y", 2), ("z", 3))], (F.col("id") % 4).cast("int").alias("part"))
    for mode, times in (("append", 1), ("append", 2), ("overwrite", 1)):
        rows.repartition(5).write.format("frames").mode(mode).save(str(tmp_path))
        read = spark.read.format("particles").option("header", "true").load(str(tmp_path))
        assert read.count() == 200 * times and read.where("malformed IS NOT NULL").count() == 0
        assert {r["frame"]: (r["n"], r["x"]) for r in read.groupBy("frame").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("x")).collect()} == {
            r["frame"]: (r["n"] * times, r["x"] * times) for r in rows.groupBy("frame").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("x")).collect()
        }
    assert sorted(os.listdir(tmp_path)) == ["frame=0", "frame=1", "frame=2"]
    with open(f"{tmp_path}/frame=0/{sorted(os.listdir(f'{tmp_path}/frame=0'))[0]}") as file:
        assert file.readline() == "x coord,y coord,z coord ,rank\n"


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    @udf("double")
    def breaks(k):
        if k == 37:
            raise ValueError("no such particle")
        return float(k)

    rows = spark.range(0, 40, 1, 4).select(F.lit(1).alias("frame"), *[breaks("id").alias(d) for d in "xyz"], F.lit(0).alias("part"))
    with pytest.raises(Exception, match="no such particle"):
        rows.write.format("frames").mode("append").save(f"{tmp_path}/out")
    assert not os.path.exists(f"{tmp_path}/out") or os.listdir(f"{tmp_path}/out") == []


def test_a_task_that_ran_twice_counts_once(tmp_path):
    writer = files.FrameWriter({"path": str(tmp_path), "kind": "series"}, ["metric", "value"], False)
    rows = [Row(metric="time", value=k) for k in range(3)]
    lost, kept = writer.write(iter(rows)), writer.write(iter(rows))
    assert set(lost.files) != set(kept.files)
    writer.commit([kept, None])
    names = [f.path for f in fs.LocalFileSystem().get_file_info(fs.FileSelector(str(tmp_path), recursive=True)) if f.type == fs.FileType.File]
    assert len(names) == 1
    with open(names[0]) as file:
        assert file.read() == "0\n1\n2\n"


def test_series_stand_in_order(spark, tmp_path):
    own = spark.range(1000).select(F.lit("time").alias("metric"), F.col("id").alias("iteration"), (F.col("id") * 2).alias("value"))
    own.repartitionByRange(6, "metric", "iteration").sortWithinPartitions("metric", "iteration").select("metric", "value").write.format("frames").option("kind", "series").mode("append").save(str(tmp_path))
    text = ""
    for name in sorted(os.listdir(f"{tmp_path}/metric=time")):
        with open(f"{tmp_path}/metric=time/{name}") as file:
            text += file.read()
    assert text.split() == [str(2 * k) for k in range(1000)] and len(os.listdir(f"{tmp_path}/metric=time")) > 1


def test_lines_are_parsed_at_once(monkeypatch):
    """Each line as ``parse`` reads it, bit by bit; lines of plain numbers do not go through it."""
    odd = ["", "7,8", "x,1,2", "1_0,2,3", " 5 ,6,7", "nan,-inf,1e400", "1e5,-2E-3,+4", ".5,5.,-0", "n/a,2", "1,2,", "é,١,3", "1\r2,3,4", "0x1,1,1", "1,2,3\n"]
    plain = ["1,2,3", "0.1,1e-3,-0.30000000000000004,9,x", "123456789012345678901234567890,2.2250738585072011e-30,9007199254740993", "4.35,-0.0"]
    lines = odd + plain
    values, bad = files.parsed(files.pa.array(lines), 3)
    want = [files.parse(line, 3) for line in lines]
    assert [(repr([v[k].as_py() for v in values]), bool(bad[k])) for k in range(len(lines))] == [(repr(row), b) for row, b in want]
    monkeypatch.setattr(files, "parse", None)
    assert not files.parsed(files.pa.array(plain), 3)[1].any()
    assert len(files.parsed(files.pa.array([], "string"), 3)[1]) == 0


def test_many_ranges_make_few_tasks(tmp_path):
    """A task each cost most of the time; every line is still read once."""
    _write(tmp_path, {f"frame={f}/part": b"".join(f"{f},{j},1\n".encode() for j in range(500)) for f in range(3)})
    reader = files.LineReader({"path": str(tmp_path), "splitBytes": "8"}, ("x", "y", "z"))
    tasks = reader.partitions()
    assert 64 <= len(tasks) < 128
    got = Counter((r["frame"], r["x"], r["y"]) for p in tasks for b in reader.read(p) for r in b.to_pylist())
    assert got == Counter({(f, float(f), float(j)): 1 for f in range(3) for j in range(500)})
