import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from palimpsa.functions import cursors, filters
from palimpsa.operators import sessions
from palimpsa.sources import shredded


def test_keys_order_numbers():
    r = random.Random(1)
    numbers = [0, -0.0, 1, -1, 0.1, 10, 9.99, -9.99, 1e300, -1e300, 1e-300, Decimal("123456789012345678901234567890.5"), Decimal("-0.00010"), Decimal("1E+400")] + [Decimal(r.randrange(-(10**6), 10**6)) / 10 ** r.randrange(9) for _ in range(300)]
    exact = lambda x: Decimal(repr(x)) if isinstance(x, float) else Decimal(x)
    ordered = sorted(numbers, key=exact)
    keys = [shredded.sort_key(n) for n in ordered]
    assert keys == sorted(keys) and all((a == b) == (exact(x) == exact(y)) for a, b, x, y in zip(keys, keys[1:], ordered, ordered[1:], strict=False))


VALUES = [0, 1, -1, 7, 7.0, 7.5, -2.25, 12345678901, "a", "7", "", "zz", True, False, None, [1, "a"], {"b": 1}]


def test_equals_the_evaluator_and_pushes_down(spark, tmp_path):
    r = random.Random(3)
    rows = [(i, json.dumps({k: r.choice(VALUES) for k in ("a", "b-c") if r.random() < 0.8} | {"n": {"x": r.choice(VALUES)}})) for i in range(300)] + [(900, None), (901, "no json"), (902, "[]"), (903, '{"a": 9007199254740993.5}')]
    frame = spark.createDataFrame(rows, "i int, props string")
    fields = ["a", "metadata.n.x"]
    shredded.store(frame, "props", fields, f"{tmp_path}/t", order_by="a")
    stored = spark.read.parquet(f"{tmp_path}/t")
    leaves = [{"field": f, "op": op, "value": v} for f in ("a", "n.x", "b-c", "metadata.a") for op in ("eq", "ne") for v in VALUES]
    leaves += [{"field": f, "op": op, "value": v} for f in ("a", "n.x") for op in ("gt", "gte", "lt", "lte") for v in (0, 7, -1.5, "a", "7")]
    leaves += [{"field": "a", "op": "in", "value": v} for v in ([], [7, "a"], [1], ["zz"], [True, 7], [None])] + [{"field": "a", "op": "exists", "value": v} for v in (True, False)]
    leaves += [{"field": "a", "op": "contains", "value": v} for v in ("a", 1)] + [{"and": [leaves[0], {"or": [leaves[40], leaves[90]]}]}]

    def of(text):
        try:
            value = json.loads(text, parse_float=Decimal) if text else {}
        except ValueError:
            value = {}
        return value if isinstance(value, dict) else {}

    tests = stored.select("i", *[F.coalesce(shredded.to_column(x, "props", fields), F.lit(False)).alias(f"t{n}") for n, x in enumerate(leaves)]).collect()
    given = {i: of(t) for i, t in rows}
    for row in tests:
        for n, leaf in enumerate(leaves):
            assert row[f"t{n}"] == filters.evaluate(leaf, {"metadata": given[row.i]}), (row.i, leaf, given[row.i])
    plan = stored.filter(shredded.to_column({"and": [{"field": "a", "op": "gte", "value": 5}, {"field": "a", "op": "lt", "value": 9}]}, "props", fields))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(m_a__key,2500015)" in plan and "LessThan(m_a__key,2500019)" in plan and "parse_json" not in plan


def test_sessions(spark):
    entities = spark.createDataFrame([(f"n{i}", f"t{i}") for i in range(9)], "id string, text string")
    relations = spark.createDataFrame([(f"e{i}", f"n{i}", f"n{(i + 1) % 9}") for i in range(9)], "edge string, src string, dst string")
    outbox = spark.createDataFrame([(i,) for i in range(1, 5)], "seq long")
    session = sessions.opened(entities, relations, sessions.watermark(outbox, "seq"), {"types": ["t"]}, owner="me")
    read = lambda kind, cursor=None, at=4, limit=4, **k: sessions.page(session, kind, entities, relations, at, cursor, limit, **{"owner": "me"} | k)
    got, cursor = [], None
    while True:
        page = read("connected", cursor)
        assert {e.id for e in page["entities"]} == {x for r in page["records"] for x in (r.src, r.dst)} and page["total"] == 9
        got += [r.edge for r in page["records"]]
        cursor = page["next_cursor"]
        if cursor is None:
            break
    assert got == [f"e{i}" for i in range(9)]  # no gap and no repeat
    first = read("relations")["next_cursor"]
    with pytest.raises(sessions.Stale):
        read("relations", first, at=5)
    for wrong in (first[:-4] + "AAAA", "x", cursors.encode(session.bound("relations"), ["e1"])):
        with pytest.raises(ValueError, match="cursor"):
            read("relations", wrong)
    with pytest.raises(ValueError, match="another"):
        read("entities", first)
    with pytest.raises(PermissionError):
        read("entities", owner="you")
    with pytest.raises(ValueError, match="page"):
        read("connected", limit=501)
    with pytest.raises(ValueError, match="manifest"):
        sessions.page(session, "connected", entities.filter("id <> 'n3'"), relations, 4, owner="me")
    ended = sessions.opened(entities, relations, 4, {}, seconds=0)
    with pytest.raises(ValueError, match="ended"):
        sessions.page(ended, "entities", entities, relations, 4)


def test_shredding_finds_each_type_once(spark):
    plan = shredded.shredded(spark.createDataFrame([(1, "{}")], "i int, props string"), "props", ["a", "b"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1 and plan.count("schemaOfVariant") == 2


def test_whole_numbers_have_the_same_keys(spark):
    numbers = [0, 7, -7, 10, -10, 1200, -1200, 10**17, 10**18 - 1, -(10**17) + 1, 10**18, -(10**17), 2**63 - 1, -(2**63), 10**25]
    rows = spark.createDataFrame([(i, json.dumps({"a": n})) for i, n in enumerate(numbers)], "i int, props string")
    assert {r.i: r.m_a__key for r in shredded.shredded(rows, "props", ["a"]).collect()} == {i: shredded.sort_key(n) for i, n in enumerate(numbers)}


def test_rows_are_dealt_before_they_are_shredded(spark, tmp_path, monkeypatch):
    seen = []
    monkeypatch.setattr(shredded, "shredded", lambda rows, *a: seen.append(rows.rdd.getNumPartitions()) or rows.selectExpr("*", "1 m_a__type", "1 m_a__key", "1 m_a__text"))
    shredded.store(spark.createDataFrame([(1, "{}")], "i int, props string").coalesce(1), "props", ["a"], f"{tmp_path}/t", order_by="a")
    assert seen == [4]
