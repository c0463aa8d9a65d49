"""What grows with the input: sides that are joined or sent to the driver, parts that are made few, chunks that are held."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palimpsa.operators import documents, evidence, extras, identity, ontology, shapes
from palimpsa.plans import catalogue, context, model, resolution  # noqa: F401
from palimpsa.plans import evidence as evidence_plans  # noqa: F401

PATH = "/root/testdata/sf0.001"


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_recall_is_grouped_without_a_join(spark):
    gold = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (2, 3), (3, None)], "q int, i int")
    found = spark.createDataFrame([(1, 1), (1, 1), (1, 9), (3, None), (4, 1)], "q int, i int")
    out = extras.evidence_recall(gold, found, "q", "i")
    assert out.first()[0] == pytest.approx(0.5 / 3, abs=1e-6) and "Join" not in plan(out)


def test_as_of_join_deals_its_questions_once(spark):
    rows = spark.createDataFrame([("a", "2024-01-05 00:00:00", 1), ("a", "2024-02-07 00:00:00", 2)], "k string, t string, n int")
    rows = rows.selectExpr("k", "cast(t as timestamp_ntz) t", "n")
    asked = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-03-03 00:00:00"), ("a", "2024-02-01 00:00:00"), ("a", None), ("b", "2024-03-03 00:00:00")], "k string, at string")
    out = evidence.as_of_join(asked.selectExpr("k", "cast(at as timestamp_ntz) at"), rows, ["k"], "at", "t", ["n"])
    assert "Join" not in plan(out)
    assert sorted((r.k, str(r["at"]), r.found and r.found.n) for r in out.collect()) == sorted(
        [("a", "2024-01-01 00:00:00", None), ("a", "2024-02-01 00:00:00", 1), ("a", "2024-03-03 00:00:00", 2), ("a", "None", None), ("b", "2024-03-03 00:00:00", None)], key=str
    )


def test_both_sides_of_an_as_of_join_are_dealt_once(spark):
    left = spark.range(9).selectExpr("id", "cast(id % 3 as int) k", "timestamp_ntz'2024-01-05 00:00:00' at")
    right = spark.range(9).selectExpr("id n", "id % 4 k", "timestamp_ntz'2024-01-02 00:00:00' t")
    out = evidence.as_of_join(left, right, ["k"], "at", "t", ["n"])
    same = evidence.as_of_join(left.withColumn("k", left.k.cast("long")), right, ["k"], "at", "t", ["n"])
    for frame in (out, same, same.groupBy("k").count()):  # what follows by the key is not dealt again
        assert plan(frame).count("Exchange") == 1
    assert out.schema["k"].dataType.simpleString() == "int" and {r.found.n for r in out.collect()} == {5, 6, 8}


@pytest.mark.parametrize("name", ["evidence_occurrences", "answer_validity", "source_context", "conflict_reads"])
def test_decisions_are_not_dealt_with_the_questions(spark, name):
    """They were read twelve times and dealt anew for each slice of time."""
    told = plan(catalogue.QUERIES[name](spark, PATH))
    assert told.count("lineitem.parquet") <= 4 and told.count("- Window [") <= 7


def test_decisions_are_dealt_once_by_their_assertion(spark):
    log = model.decisions(spark, PATH)
    assert plan(log.groupBy("assertion_id").max("decision_version")).count("Exchange") == 1
    assert log.columns == ["assertion_id", "decision_version", "created_at", "to_status", "l_partkey", "l_suppkey"]


def test_supports_without_a_source_do_not_meet_in_one_task(spark):
    left = spark.range(400).selectExpr("id", "if(id % 10 = 0, id % 4, null) k", "timestamp_ntz'2024-01-05 00:00:00' at")
    right = spark.range(9).selectExpr("id n", "if(id < 8, id % 4, null) k", "timestamp_ntz'2024-01-02 00:00:00' t")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = evidence.as_of_join(left, right, ["k"], "at", "t", ["n"], keyless=True).select("*", F.spark_partition_id().alias("part")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(rows) == 400 and all((r.found and r.found.n) == (None if r.k is None else r.k + 4) for r in rows)
    assert len({r.part for r in rows if r.k is None}) == 4
    assert "apart" in plan(catalogue.QUERIES["conflict_reads"](spark, PATH))


def test_values_are_dealt_once_into_all_parts(spark):
    rows = spark.createDataFrame([(1, 1, 1, 5), (1, 2, 3, 9)], "o int, v int, s int, t int")
    assert "REPARTITION_BY_NUM" in plan(identity.held_values(rows, ["o"], "v", "s", "t"))


def test_contexts_are_dealt_into_all_parts(spark):
    assert "REPARTITION_BY_NUM" in plan(catalogue.QUERIES["applicability_contexts"](spark, PATH))


def test_shapes_are_dealt_by_subject(spark):
    facts = spark.createDataFrame([("s", "p", "v", None, None)], "subject string, predicate string, value string, start timestamp_ntz, stop timestamp_ntz")
    types = spark.createDataFrame([("s", "c", None, None)], "subject string, class string, start timestamp_ntz, stop timestamp_ntz")
    assert "REPARTITION_BY_NUM" in plan(shapes.violations(facts, types, [shapes.Shape("x", "c", "p", most=0)]))


def test_levels_send_no_side_through_the_driver(spark, monkeypatch):
    plans, cut = [], ontology.cut
    monkeypatch.setattr(ontology, "cut", lambda f: plans.append(plan(f)) or cut(f))
    out = ontology.topological(spark.createDataFrame([(1, 2), (2, 3)], "a int, b int"), "a", "b")
    assert sorted(map(tuple, out.collect())) == [(1, 0), (2, 1), (3, 2)]
    assert any("Join" in p for p in plans) and not any("Broadcast" in p for p in plans)


@pytest.mark.parametrize("strategy", ["paragraph", "structural"])
def test_chunks_leave_before_a_batch_is_done(monkeypatch, strategy):
    texts = ["# a\n" + "word. " * 900, None, "", "1. x\n" + "y; " * 700]
    batch = pa.RecordBatch.from_arrays([pa.array([7, 8, 9, 5]), pa.array(texts)], names=["id", "text"])
    whole = pa.Table.from_batches(documents.chunked(iter([batch]), strategy, 300, 30)).to_pylist()
    assert [(r["id"], r["ordinal"], r["start"], r["stop"]) for r in whole] == [(i, n, a, b) for i, t in zip([7, 8, 9, 5], texts) for n, (a, b) in enumerate(documents.cut_points(t or "", 300, 30, strategy))]
    monkeypatch.setattr(documents, "OUTPUT", 1000)
    parts = list(documents.chunked(iter([batch]), strategy, 300, 30))
    assert len(parts) > 5 and all(sum(map(len, p.column(4).to_pylist())) < 1300 for p in parts)
    assert pa.Table.from_batches(parts).to_pylist() == whole


@pytest.mark.parametrize("name", ["block_chunks", "markdown_blocks"])
def test_parts_are_dealt_before_texts_are_made(spark, name):
    assert "REPARTITION_BY_NUM" in plan(catalogue.QUERIES[name](spark, PATH))


def test_labels_are_not_broadcast(spark):
    out = catalogue.QUERIES["label_lookups"](spark, PATH)
    assert "Broadcast" not in plan(out) and "SortMergeJoin" in plan(out)
