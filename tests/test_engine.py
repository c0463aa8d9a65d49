import pytest
from pyspark.sql import functions as F

from palimpsa.engine import Engine, Scope


@pytest.fixture(scope="module")
def engine(spark):
    rows = [
        ("a", "entity", "T", "Alpha beta beta", None, None, 1, "2024-01-01", None, "2020-01-01", None, '{"n": 1}', "specific", ["x"]),
        ("b", "entity", "T", "beta", None, None, 1, "2024-01-01", "2024-02-01", None, None, '{"n": 2}', "all", []),
        ("b", "entity", "T", "beta two", None, None, 2, "2024-02-01", None, None, None, '{"n": 3}', "all", []),
        ("c", "entity", "T", " ALPHA BETA BETA", None, None, 1, "2024-01-01", None, "2020-01-01", "2021-01-01", '{"n": 4}', "unknown", []),
        ("r", "relation", "R", "", "a", "b", 1, "2024-01-01", None, None, None, "{}", "all", []),
        ("s", "relation", "R", "", "a", "c", 1, "2024-01-01", None, None, None, "{}", "all", []),
    ]
    names = "id kind type text src dst version r s f u metadata platform_mode platform_values".split()
    kinds = ["string"] * 6 + ["int"] + ["string"] * 6 + ["array<string>"]
    frame = spark.createDataFrame(rows, ", ".join(map(" ".join, zip(names, kinds))))
    times = {"recorded_at": "r", "superseded_at": "s", "valid_from": "f", "valid_until": "u"}
    return Engine(frame.withColumns({k: F.to_timestamp(v) for k, v in times.items()}).drop("r", "s", "f", "u"))


def ids(frame):
    return sorted((r.id, r.version) for r in frame.collect())


def test_scopes(engine):
    assert ids(engine.qualified(Scope())) == [("a", 1), ("b", 2), ("c", 1), ("r", 1), ("s", 1)]
    assert ids(engine.qualified(Scope(valid_at="2022-01-01"))) == [("a", 1), ("b", 2), ("r", 1)]
    assert ids(engine.qualified(Scope(known_at="2024-01-15", kinds=("entity",)))) == [("a", 1), ("b", 1), ("c", 1)]
    assert ids(engine.qualified(Scope(platforms=("x",)))) == [("a", 1), ("b", 2), ("r", 1)]
    n = {"or": [{"field": "n", "op": "gte", "value": 3}, {"field": "kind", "op": "eq", "value": "relation"}]}
    assert ids(engine.qualified(Scope(filters=n))) == [("b", 2), ("c", 1)]


def test_reads(engine, spark):
    assert [r.version for r in engine.history("b").collect()] == [1, 2]
    assert [r.id for r in engine.search(Scope(), "beta").collect()] == ["a", "c", "b"]
    assert {(r.type, r.name): r.n for r in engine.duplicates(Scope()).collect()} == {("T", "alpha beta beta"): 2}
    assert {r.kind: r.n for r in engine.counts(Scope()).collect()} == {"entity": 3, "relation": 2}
    assert {r.path: r.records for r in engine.facets(Scope()).collect()} == {"n": 3}
    found, cut = engine.neighbourhood(Scope(), spark.createDataFrame([("b",)], "node string"), 2)
    assert {r.node for r in found.collect()} == {"a", "b", "c"} and not cut
    rows, cursor = engine.page(Scope(), 2)
    more, end = engine.page(Scope(), 5, cursor)
    assert [r.id for r in rows + more] == ["a", "b", "c", "r", "s"] and end is None
    with pytest.raises(ValueError):
        engine.page(Scope(kinds=("entity",)), 2, cursor)


def test_rankings(engine, spark, tmp_path):
    vectors = spark.createDataFrame([("a", 1, [1.0, 0.0]), ("b", 1, [0.0, 1.0]), ("b", 2, [0.6, 0.8]), ("c", 1, [0.0, -1.0])], "id string, version int, vector array<double>")
    assert [r.id for r in engine.keyword(Scope(), "two").collect()] == ["b"]
    # The old version of b is nearer, and out of scope; c is below the least score.
    found = [(r.id, round(r.score, 3)) for r in engine.semantic(Scope(), vectors, [0.0, 1.0]).collect()]
    assert found == [("b", 0.8)]
    assert [(r.id, r.score) for r in engine.semantic(Scope(known_at="2024-01-15"), vectors, [0.0, 1.0]).collect()] == [("b", 1.0)]
    index = engine.index_texts(str(tmp_path / "index"))
    assert [r.id for r in engine.keyword(Scope(), "two", index=index).collect()] == ["b"]
    assert [r.id for r in engine.keyword(Scope(), "zzz", index=index).collect()] == []
    with_index = engine.hybrid(Scope(), "beta", vectors, [1.0, 0.0], 3, index=index).collect()
    assert [r.id for r in with_index] == [r.id for r in engine.hybrid(Scope(), "beta", vectors, [1.0, 0.0], 3).collect()]
    rows = engine.hybrid(Scope(), "beta", vectors, [1.0, 0.0], 3).collect()
    assert {r.id for r in rows} == {"a", "b", "c"} and rows[0].backends == 2 and all(r.text for r in rows)
    typed = engine.hybrid(Scope(), "two", vectors, [1.0, 0.0], 5, types=("T",)).collect()
    assert {r.id: r.backends for r in typed} == {"a": 2, "b": 3, "c": 1} and typed[0].id == "b"


def test_graph_and_governance_reads(engine, spark):
    assert [r.edge for r in engine.explore(Scope(), "two").collect()] == ["r"]
    nodes, edges, cut = engine.graph_view(Scope(), spark.createDataFrame([("b",)], "node string"), 2)
    assert {r.node for r in nodes.collect()} == {"a", "b", "c"} and sorted(r.edge for r in edges.collect()) == ["r", "s"] and not cut
    assert engine.graph_view(Scope(), spark.createDataFrame([("b",)], "node string"), 2, max_edges=1)[2]
    found = engine.select(Scope(), [("?x", "R", "?y"), ("?y", "rdf:type", "T")]).collect()
    assert sorted((r.x, r.y) for r in found) == [("a", "b"), ("a", "c")]
    with pytest.raises(ValueError):
        engine.select(Scope(), [("?x", "R", "?y"), ("?z", "R", "?u")])
    assert [r.id for r in engine.resolve(Scope(), "alpha beta beta").collect()] == ["a", "c"]
    assert {r.id: r.action for r in engine.merge_preview(Scope(), "a", "b").collect()} == {"b": "tombstone", "r": "tombstone"}
    assert {r.kind: r.n for r in engine.dashboard(Scope()).collect()} == {"entity": 3, "relation": 2}
    assert {r.kind: r.total for r in engine.manifest(Scope()).collect()} == {"entity": 3, "relation": 2}
    assert engine.graph_rows(Scope()).count() == 5


def test_conflicts_need_a_common_scope(spark):
    from datetime import datetime

    from palimpsa.operators import resolve

    at = lambda d: datetime(2024, 1, d)
    rows = [("o", "1", ["x"], at(1), None), ("o", "2", ["y"], at(1), None), ("p", "1", ["x"], at(1), at(5)), ("p", "2", None, at(4), None), ("q", "1", [], at(1), at(2)), ("q", "2", ["x"], at(2), None)]
    frame = spark.createDataFrame(rows, "o string, v string, scope array<string>, s timestamp, t timestamp")
    found = resolve.conflicts_in_contexts(frame, ["o"], "scope", "v", "s", "t").collect()
    assert [(r.o, r.context, r.at, r["values"]) for r in found] == [("p", "x", at(4), 2)]
