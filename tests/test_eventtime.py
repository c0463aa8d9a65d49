import random
from collections import defaultdict
from datetime import datetime, timedelta, timezone

import pytest

from palimpsa.streaming import eventtime

SCHEMA = "who string, at timestamp, v double"


def start(n):
    return datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=n)


def streamed(spark, tmp_path, batches, made):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{i:03d}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    query = made(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination()
    states = [s.numRowsTotal for p in query.recentProgress for s in p.stateOperators]
    return spark.read.parquet(f"{tmp_path}/out").collect(), states


@pytest.fixture
def rows():
    r = random.Random(1)
    return [(r.choice("ab"), start(i * 20 + r.randrange(-50, 50)), float(i % 5)) for i in range(240)]


def tumbling(rows, length, slide):
    sums = defaultdict(lambda: [0, 0.0])
    for who, at, v in rows:
        t = int((at - start(0)).total_seconds())
        s = t - t % slide
        while s > t - length:
            sums[who, s][0] += 1
            sums[who, s][1] += v
            s -= slide
    return {k: tuple(v) for k, v in sums.items()}


@pytest.mark.parametrize(("length", "slide"), [(300, 300), (300, 100)])
def test_windows_equal_the_batch(spark, tmp_path, rows, length, slide):
    batches = [rows[i : i + 60] for i in range(0, 240, 60)]
    # A far row moves the watermark on, so that all windows are closed.
    batches += [[("a", start(50_000), 0.0)], [("b", start(50_001), 0.0)]]
    found, states = streamed(spark, tmp_path, batches, lambda s: eventtime.windows(s, "who", "at", "v", "120 seconds", length, slide))
    assert not [r for r in found if r.kind == "late"]
    got = {(r.key, int((r.start.replace(tzinfo=timezone.utc) - start(0)).total_seconds())): (r.n, r.total) for r in found}
    assert len(got) == len(found) and got == tumbling(rows, length, slide)
    # What waits are the windows of the delay and of a batch, not of the whole stream.
    assert max(states) < 4 * (60 * 20 + 120 + length) / slide + 40 and states[-1] <= 4 * length / slide + 4


def test_late_rows_are_passed_on(spark, tmp_path, rows):
    late = [("a", start(10), 1.0), ("b", start(700), 2.0)]
    batches = [rows[:120], [("a", start(9000), 0.0)], [*late, ("a", start(9001), 0.0)], [("b", start(50_000), 0.0)], [("b", start(50_001), 0.0)]]
    found, _ = streamed(spark, tmp_path, batches, lambda s: eventtime.windows(s, "who", "at", "v", "0 seconds", 300))
    assert sorted((r.key, r.total) for r in found if r.kind == "late") == [("a", 1.0), ("b", 2.0)]
    assert sum(r.n for r in found if r.kind == "window") == 120 + 2


def test_sessions_merge(spark, tmp_path):
    at = [0, 50, 200, 130, 95, 1000, 1100, 1050]
    batches = [[("a", start(t), 1.0)] for t in at] + [[("a", start(50_000), 0.0)], [("b", start(50_001), 0.0)]]
    found, _ = streamed(spark, tmp_path, batches, lambda s: eventtime.sessions(s, "who", "at", "v", "5000 seconds", 60))
    got = sorted((int((r.start.replace(tzinfo=timezone.utc) - start(0)).total_seconds()), int((r.stop - r.start).total_seconds()), r.n) for r in found if r.n)
    assert got == [(0, 190, 4), (200, 60, 1), (1000, 160, 3)]


def test_gate_holds_back(spark, tmp_path):
    schema = "project string, n long, v string"
    batches = [[("p", 1, "a"), ("p", 3, "c"), ("q", 2, "x")], [("p", 2, "b"), ("p", 3, "again"), ("p", 6, "f")], [("q", 1, "w"), ("p", 1, "old"), ("p", 4, "d")]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    eventtime.run_to_end(lambda s: eventtime.gated(s, "project", "n", "v"), stream, f"{tmp_path}/out", f"{tmp_path}/cp")
    got = sorted((r.project, r.seq, r.payload) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [("p", 1, "a"), ("p", 2, "b"), ("p", 3, "again"), ("p", 4, "d"), ("q", 1, "w"), ("q", 2, "x")]


def test_state_is_called_a_few_times(spark, tmp_path):
    """Sessions of a key are one value with one timer, and waiting events are runs, not an entry each."""
    batches = [[(w, start(k * 1000), 1.0) for k in range(300) for w in "ab"], [("a", start(900_000), 0.0)], [("b", start(900_001), 0.0)]]
    found, states = streamed(spark, tmp_path, batches, lambda s: eventtime.sessions(s, "who", "at", "v", "5000 seconds", 60))
    assert sum(r.n for r in found) == 600 and len(found) == 600 and max(states) <= 3 * 4
    schema = "project string, n long, v string"
    n = list(range(2, 9001))
    random.Random(2).shuffle(n)
    for i, rows in enumerate([[("p", k, str(k)) for k in n[:5000]], [("p", k, str(k)) for k in n[5000:]], [("p", 1, "1")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/gate/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/gate")
    query = eventtime.gated(stream, "project", "n", "v").writeStream.format("parquet").option("path", f"{tmp_path}/g").option("checkpointLocation", f"{tmp_path}/gcp").trigger(availableNow=True).start()
    query.awaitTermination()
    assert max(s.numRowsTotal for p in query.recentProgress for s in p.stateOperators) < 20
    assert sorted((r.seq, r.payload) for r in spark.read.parquet(f"{tmp_path}/g").collect()) == [(k, str(k)) for k in range(1, 9001)]
