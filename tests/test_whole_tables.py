"""Queries over whole tables against brute force in Python."""

from datetime import timedelta

import pyarrow.parquet as pq
import pytest

from palimpsa.plans import catalogue, more  # noqa: F401

PATH = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def t():
    return lambda name: pq.read_table(f"{PATH}/{name}.parquet").to_pylist()


@pytest.fixture(scope="module")
def edges(t):
    out = {(f"{x}:{r[x[0] + k]}", f"{y}:{r[x[0] + v]}") for x, y, k, v in (
        ("supplier", "nation", "_suppkey", "_nationkey"), ("customer", "nation", "_custkey", "_nationkey"), ("nation", "region", "_nationkey", "_regionkey")
    ) for r in t(x)}
    return out | {(f"supplier:{r['l_suppkey']}", f"part:{r['l_partkey']}") for r in t("lineitem")}


def run(spark, name):
    rows = [tuple(r) for r in catalogue.QUERIES[name](spark, PATH).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_provenance_trace(spark, t):
    orders = {r["o_orderkey"]: r["o_custkey"] for r in t("orders")}
    expected = {(f"order:{o}", f"customer:{c}", "cites") for o, c in orders.items()}
    expected |= {(f"order:{r['l_orderkey']}", f"part:{r['l_partkey']}", "used") for r in t("lineitem") if r["l_orderkey"] in orders}
    assert run(spark, "provenance_trace") == expected


def test_timeline_validation(spark, t):
    own = {}
    for r in t("lineitem"):
        own.setdefault(r["l_suppkey"], []).append((r["l_shipdate"], r["l_shipdate"] + timedelta(90), r["l_partkey"]))
    expected = set()
    for s, rows in own.items():
        for at in {x for r in rows for x in r[:2]}:
            held = len({p for a, b, p in rows if a <= at < b})
            if held > 5:
                expected.add((s, at, held))
    assert run(spark, "timeline_validation") == expected


def test_projection_fan_out(spark, t):
    count = lambda n: 0 if not n else max(0, -(-(n - 1800) // 1600)) + 1
    assert run(spark, "projection_fan_out") == {(r["doc_id"], i) for r in t("documents") for i in range(count(len(r["text"])))}


def test_hierarchy_cycles(spark, t):
    up = {r["p_partkey"]: (r["p_partkey"] * 7 + 3) % 50 for r in t("part")}
    expected = set()
    for start in up:
        at, seen = up[start], set()
        while at in up and at not in seen and at != start:
            seen.add(at)
            at = up[at]
        if at == start:
            expected.add((start,))
    assert run(spark, "hierarchy_cycles") == expected


def test_graph_queries(spark, edges):
    after, both = {}, {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
        both.setdefault(a, set()).add(b)
        both.setdefault(b, set()).add(a)
    assert run(spark, "incident_entities") == {(x,) for e in edges for x in e}
    hops, level = {"nation:1": 0}, ["nation:1"]
    for hop in (1, 2, 3):
        level = [x for x in {b for a in level for b in both[a]} if x not in hops]
        hops |= dict.fromkeys(level, hop)
    assert run(spark, "bfs_hops") == set(hops.items())
    expected, paths = set(), [(a,) for a in after]
    for hop in (1, 2, 3):
        paths = [(*p, b) for p in paths for b in after.get(p[-1], ()) if b not in p]
        expected |= {(p[0], p[-1], ">".join(p), hop) for p in paths}
    assert run(spark, "reasoning_paths") == expected


def test_keyword_rerank_has_no_pool_limit(spark, tmp_path):
    rows = [(i, [1.0, 0.0] if i in (0, 1900) else [1.0, 1.0 + i / 1000], 1 if i else 0) for i in range(2000)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = catalogue.QUERIES["keyword_rerank"](spark, str(tmp_path)).collect()
    assert len(found) == 10 and (found[0]["vec_id"], found[0]["rank"]) == (1900, 1)
