from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from palimpsa.functions import cursors, native
from palimpsa.operators import governance, patterns
from palimpsa.sources import snapshots


@pytest.mark.parametrize(
    ("op", "value", "expected"),
    [
        ("eq", 2.5, False), ("ne", 2.5, True), ("gt", 2.5, ("gte", 3)), ("gte", 2.5, ("gte", 3)), ("lt", 2.5, ("lte", 2)), ("lte", 3, ("lte", 3)),
        ("gt", 2**63 - 1, False), ("gt", -(2**70), True), ("lt", 2**70, True), ("lte", -(2**70), False), ("eq", 10**30, False), ("eq", 7.0, ("eq", 7)),
    ],
)
def test_integer_bounds(op, value, expected):
    assert native.int64_bound(op, value) == expected


def test_native_leaf(spark):
    rows = spark.createDataFrame([(1,), (3,), (None,)], "n long")
    count = lambda *a: rows.filter(native.int64_leaf(F.col("n"), *a)).count()
    assert (count("gt", 2.5), count("ne", 2.5), count("lt", 2**70), count("eq", 1)) == (1, 2, 2, 1)
    assert native.double_exact(2**53) and not native.double_exact(2**53 + 1) and not native.double_exact(Decimal("0.1000000000000000055"))
    assert native.like_literal("a%_\\") == "a\\%\\_\\\\"


def test_cursors():
    c = cursors.encode({"kind": "a"}, ["x", 3], b"key")
    assert cursors.decode({"kind": "a"}, c, b"key") == ["x", 3]
    for scope, text, key in (({"kind": "b"}, c, b"key"), ({"kind": "a"}, c, b"other"), ({"kind": "a"}, "%%%", None)):
        with pytest.raises(ValueError):
            cursors.decode(scope, text, key)


def test_snapshots(spark, tmp_path):
    one = spark.createDataFrame([(1, "a"), (2, None)], "id int, t string")
    snapshots.export({"one": one, "two": one.limit(0)}, str(tmp_path / "s"))
    found = snapshots.restore(spark, str(tmp_path / "s"), {"one", "two"})
    assert sorted(map(tuple, found["one"].collect())) == [(1, "a"), (2, None)] and found["two"].count() == 0
    with pytest.raises(ValueError):
        snapshots.restore(spark, str(tmp_path / "s"), {"one"})
    state = spark.createDataFrame([(1, 1, "old"), (2, 1, "x")], "id int, seq int, v string")
    changed = spark.createDataFrame([(1, 2, "new")], "id int, seq int, v string")
    assert {r.id: r.v for r in snapshots.upsert_by_key(state, changed, ["id"], "seq").collect()} == {1: "new", 2: "x"}


def test_writes_and_transitions(spark):
    current = spark.createDataFrame([("a", 2)], "id string, version int")
    changes = spark.createDataFrame([("a", 2), ("a", 1), ("b", 0), ("c", 1)], "id string, expected_version int")
    assert sorted((r.id, r.expected_version) for r in governance.stale_writes(changes, current, "id").collect()) == [("a", 1), ("c", 1)]
    log = spark.createDataFrame([("x", 1, "accepted"), ("x", 2, "superseded"), ("y", 1, "rejected"), ("y", 2, "accepted"), ("z", 1, "contradicting"), ("z", 2, "pending")], "id string, seq int, status string")
    assert [r.id for r in governance.illegal_transitions(log, "id", "seq", "status").orderBy("id").collect()] == ["y", "z"]
    with pytest.raises(ValueError):
        governance.undo_parity(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "operation int, reversal_of int"), 8)


def test_merge_and_undo(spark):
    entities = spark.createDataFrame([("a",), ("b",)], "id string")
    facts = spark.createDataFrame([("1", "b", "c"), ("2", "a", "b"), ("3", "a", "c")], "edge string, src string, dst string")
    rows = {r.id: (r.action, r.src, r.dst) for r in governance.merge_entity(entities, facts, "a", "b").collect()}
    assert rows == {"b": ("tombstone", None, None), "1": ("upsert", "a", "c"), "2": ("tombstone", "a", "a")}
    ledger = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, None), (5, 4)], "operation int, reversal_of int")
    assert {r.operation: r.active for r in governance.undo_parity(ledger).collect()} == {1: True, 2: False, 3: True, 4: False, 5: True}


def test_shapes_and_diff(spark):
    rows = spark.createDataFrame([("s", "age", "x"), ("s", "age", "4"), ("t", "age", "5"), ("u", "name", "n")], "s string, p string, v string")
    shape = {"predicate": "age", "min_count": 1, "max_count": 1, "datatype": r"^\d+$", "one_of": ["4", "5"]}
    found = {tuple(r) for r in governance.shape_violations(rows, "s", "p", "v", [shape]).collect()}
    assert found == {("s", "age", "max_count"), ("u", "age", "min_count"), ("s", "age", "one_of"), ("s", "age", "datatype")}
    diff = governance.triple_diff(rows, rows.filter("s <> 'u'").union(rows.filter("s = 't'")))
    assert sorted((r.s, r.change) for r in diff.collect()) == [("t", "added"), ("u", "removed")]


def test_texts_and_boxes(spark):
    docs = spark.createDataFrame([(1, "newer new York NEW york citys"), (2, None)], "id int, t string")
    found = patterns.dictionary_matches(docs, "id", "t", spark.createDataFrame([("new",), ("new york",), ("city",)], "name string")).collect()
    assert [(r.start, r.stop) for r in found] == [(6, 14), (15, 23)]
    boxes = spark.createDataFrame([("p", 1, 0, 0, 300, 10), ("p", 2, 2, 0, 300, 10), ("p", 3, 400, 0, 500, 10), ("q", 4, 0, 0, 300, 10)], "g string, id int, x0 int, y0 int, x1 int, y1 int")
    assert [tuple(r) for r in governance.box_duplicates(boxes, ["g"]).collect()] == [("p", 1, 2)]
    names = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    surfaces = spark.createDataFrame([("a", "x"), ("b", "x"), ("b", "y")], "surface string, term string")
    assert {r.name: (r.term, r.ambiguous) for r in governance.term_resolution(names, surfaces).collect()} == {"a": ("x", False), "b": (None, True), "c": (None, False)}
    windows = spark.createDataFrame([(1, 0, 0, 10), (1, 1, 8, 18)], "d int, ordinal int, start int, stop int")
    spans = spark.createDataFrame([(1, "s", 5, 12)], "d int, span string, start int, stop int")
    assert sorted((r.ordinal, r.start, r.stop) for r in governance.mapped_spans(windows, spans, "d").collect()) == [(0, 5, 10), (1, 0, 4)]
