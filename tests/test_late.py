"""Decisions over late and unordered rows, by Structured Streaming."""

from collections import defaultdict
from datetime import UTC, datetime

from haloframe.streaming import late

HOUR = 3600
SCHEMA = "run bigint, rank int, ts timestamp, value double"


def _expected(rows, cost, ranks=4):
    times = defaultdict(lambda: defaultdict(float))
    for run, rank, hour, value in rows:
        times[run, int(hour // 6)][rank] += value
    out, state = [], {}
    for (run, iteration), by_rank in sorted(times.items()):
        cum, pending, since = state.get(run, (0.0, 0.0, 0.0))
        own = list(by_rank.values())
        cum += pending
        fires = cum >= cost
        cum, since = (0.0, max(own)) if fires else (cum, since + max(own))
        state[run] = (cum, max(own) - sum(own) / ranks, since)
        out.append((run, iteration, max(own), min(own), sum(own), since, fires))
    return out


def _write(spark, folder, batch):
    at = lambda hour: datetime.fromtimestamp(late.EPOCH + hour * HOUR, UTC)
    rows = [(run, rank, None if hour is None else at(hour), value) for run, rank, hour, value in batch]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_late_rows(spark, tmp_path):
    """Rows shuffled within the delay count, one beyond it does not; what the watermark has not passed stays open."""
    first = [(1, 0, 1, 8.0), (1, 1, 9, 4.0), (2, 3, 2, 1.0), (1, 2, 3, 2.0), (2, 0, 13, 6.0)]
    second = [(1, 0, 7, 9.0), (1, 0, 2, 1.0), (2, 1, 8, 5.0), (1, 3, 20, 3.0), (2, 0, 25, 2.0), (None, 0, 20, 1.0), (1, 0, None, 1.0)]
    too_late = (1, 1, 0, 100.0)
    third, fourth = [(1, 2, 26, 7.0), (2, 2, 19, 4.0), (1, 0, 37, 1.0), (2, 1, 60, 1.0)], [too_late]
    folder = str(tmp_path / "in")
    for batch in (first, second, third, fourth):
        _write(spark, folder, batch)
    got = sorted(tuple(r) for r in late.run_stream(spark, folder, SCHEMA, 5.0, "12 hours").collect())
    rows = [r for r in first + second + third if r[0] is not None and r[2] is not None and r != too_late]
    assert got == [r for r in _expected(rows, 5.0) if r[1] < 8]  # the last watermark, hour 48, is the end of iteration 7
    assert any(r[-1] for r in got) and {r[0] for r in got} == {1, 2}


def test_arrival_is_shuffled_within_the_delay(spark, tmp_path):
    rows = spark.range(300).selectExpr("id % 2 AS run", "int(id % 3) AS rank", f"timestamp_seconds({late.EPOCH} + id * 900) AS ts", "double(id % 17) AS value")
    got = sorted(tuple(r) for r in late.replay(rows, 30.0, batches=3, late=40_000, delay="12 hours").collect())
    assert got == _expected([(k % 2, k % 3, k * 900 / HOUR, float(k % 17)) for k in range(300)], 30.0)
    assert late.replay(rows, 30.0, batches=3, late=40_000).count() == len(got)
    late.arrive(rows, str(tmp_path / "seen"), 3, 40_000)
    files = [[r["ts"] for r in spark.read.parquet(f).collect()] for f in sorted(spark.read.parquet(str(tmp_path / "seen")).inputFiles())]
    assert len(files) == 4 and any(min(a) < max(b) and min(b) < max(a) for a in files for b in files if a is not b)
