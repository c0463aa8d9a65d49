import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from palimpsa.sources import generations
from palimpsa.sources.generations import Generations, Invalid, Written, _Writer

KEYS = {"nodes": ["id"], "edges": ["edge"]}


@pytest.fixture
def graph(spark):
    nodes = spark.range(500).select("id", F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"), F.array("id").alias("tags"))
    edges = spark.range(800).select(F.col("id").alias("edge"), (F.col("id") % 500).alias("src"), (F.col("id") * 7 % 500).alias("dst"))
    return {"nodes": nodes, "edges": edges}


REFERENCES = {("edges", "src"): ("nodes", "id"), ("edges", "dst"): ("nodes", "id")}


def test_load_validate_switch(spark, tmp_path, graph):
    store = Generations(spark, str(tmp_path), KEYS, buckets=8)
    first = store.load(graph)
    assert store.current() is None
    with pytest.raises(Invalid):
        store.switch(first)
    store.validate(first, graph, REFERENCES)
    store.switch(first)
    assert store.read("nodes").count() == 500 and store.read("edges").exceptAll(graph["edges"]).isEmpty()
    changes = spark.createDataFrame([(3, "new", [1], False, 5), (3, "old", [2], False, 4), (9000, "added", None, False, 1), (4, None, None, True, 2), (77777, None, None, True, 3)], "id long, name string, tags array<long>, deleted boolean, seq int")
    second = store.apply({"nodes": changes}, "deleted", "seq")
    files = lambda g, t: {f[1] for f in store.manifest(g)["tables"][t]["files"]}
    assert files(first, "edges") == files(second, "edges") and files(first, "nodes") & files(second, "nodes")
    want = graph["nodes"].filter("id not in (3, 4)").union(spark.createDataFrame([(3, "new", [1]), (9000, "added", None)], "id long, name string, tags array<long>"))
    with pytest.raises(Invalid, match="edges.src"):
        store.validate(second, {"nodes": want, "edges": graph["edges"]}, REFERENCES)
    assert store.current() == first and {r.name for r in store.read("nodes").filter("id = 3").collect()} == {"n3"}
    third = store.apply({"edges": graph["edges"].filter("src = 4 or dst = 4").withColumns({"deleted": F.lit(True), "seq": F.lit(1)})}, "deleted", "seq", base=second)
    store.validate(third, {"nodes": want, "edges": graph["edges"].filter("src <> 4 and dst <> 4")}, REFERENCES)
    with pytest.raises(Invalid, match="current"):
        store.switch(third, instead_of=second)
    store.switch(third, instead_of=first)
    assert sorted(r.id for r in store.read("nodes").filter("id in (3, 4, 9000)").collect()) == [3, 9000]
    store.roll_back()
    assert store.current() == first and store.read("nodes").count() == 500
    store.switch(third)
    assert store.clean(keep=1) > 0 and store.read("nodes").count() == 500 and store.read("edges").count() == 796


def test_a_lost_row_or_changed_value_is_found(spark, tmp_path, graph):
    store = Generations(spark, str(tmp_path), KEYS, buckets=8)
    made = store.load(graph)
    for wrong in (graph["nodes"].filter("id <> 17"), graph["nodes"].withColumn("name", F.when(F.col("id") == 17, "x").otherwise(F.col("name"))), graph["nodes"].union(graph["nodes"].filter("id = 17"))):
        with pytest.raises(Invalid, match="differ"):
            store.validate(made, {"nodes": wrong})
        assert [r.table for r in store.differences(made, {"nodes": wrong}).collect()] == ["nodes"]


def test_a_failed_write_leaves_the_current_generation(spark, tmp_path, graph):
    store = Generations(spark, str(tmp_path), KEYS, buckets=8)
    first = store.load(graph)
    store.validate(first, graph)
    store.switch(first)
    boom = graph["nodes"].withColumn("name", F.when(F.col("id") == 444, F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("name")))
    with pytest.raises(Exception, match="lost"):
        store.load({"nodes": boom})
    assert store.current() == first and store.read("nodes").count() == 500
    store.clean()
    used = {f[1] for f in store.manifest(first)["tables"]["nodes"]["files"]}
    assert {f for f in os.listdir(tmp_path / "nodes") if not f.endswith(".crc")} == used


def test_attempts_have_files_of_their_own(tmp_path):
    batch = pa.RecordBatch.from_pydict({"id": [1, 2, 3], generations.BUCKET: pa.array([0, 0, 5], pa.int32())})
    writer = _Writer({"path": str(tmp_path / "t"), "manifest": str(tmp_path / "m")})
    killed, done = writer.write(iter([batch])), writer.write(iter([batch, batch.slice(2)]))
    assert not {f[1] for f in killed.files} & {f[1] for f in done.files} and [f[2] for f in done.files] == [2, 2]
    writer.commit([done, None, Written([])])
    writer.abort([killed])
    assert set(os.listdir(tmp_path / "t")) == {f[1] for f in done.files}


def test_batches_share_a_row_group(tmp_path):
    batch = pa.RecordBatch.from_pydict({"id": [1, 2, 3], generations.BUCKET: pa.array([0, 0, 5], pa.int32())})
    done = _Writer({"path": str(tmp_path / "t"), "manifest": str(tmp_path / "m")}).write(iter([batch.slice(0, 2)] * 4 + [batch.slice(2)]))
    files = [pq.ParquetFile(tmp_path / "t" / name) for _, name, _ in done.files]
    assert [(f.metadata.num_row_groups, f.read().to_pydict()["id"]) for f in files] == [(1, [1, 2] * 4), (1, [3])]


@pytest.mark.parametrize("tasks", [None, 3])
def test_changes_meet_old_rows_in_one_dealing(spark, tmp_path, tasks):
    store = Generations(spark, str(tmp_path), {"t": ["a", "b"]}, buckets=8, tasks=tasks)
    old = spark.createDataFrame([(1, 1, "x"), (1, 1, "y"), (1, 2, "z"), (2, None, "u"), (3, 3, "v")], "a int, b int, v string")
    changes = spark.createDataFrame([(1, 1, "new", False, 2), (1, 1, "older", True, 1), (2, None, "w", None, 1), (3, 3, None, True, 1), (4, 4, None, True, 1)], "a int, b int, v string, gone boolean, seq int")
    first = store.load({"t": old})
    second = store.apply({"t": changes}, "gone", "seq", base=first)
    want = [(1, 1, "new"), (1, 2, "z"), (2, None, "u"), (2, None, "w")]
    assert sorted(map(tuple, store.read("t", second).collect()), key=str) == sorted(want, key=str)
    store.validate(second, {"t": spark.createDataFrame(want, "a int, b int, v string")})
    last = spark.createDataFrame([(1, 1, "new", False)], "a int, b int, v string, gone boolean")
    plan = store._merged(old, last, "t", "gone")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_digests_add_whole_hashes(spark, tmp_path):
    store = Generations(spark, str(tmp_path), {"t": ["a"]}, buckets=2)
    rows = spark.range(1000).select((F.col("id") % 300).alias("a"), "id")
    exact = rows.select(store.bucket("t").alias("bucket"), F.xxhash64("a", "id").cast("decimal(38,0)").alias("h")).groupBy("bucket").agg(F.count("h").alias("n"), F.sum("h").alias("total"))
    assert sorted(map(tuple, store.digests("t", rows).collect())) == sorted(map(tuple, exact.collect()))
