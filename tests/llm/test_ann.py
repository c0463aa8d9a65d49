import numpy as np
import pyarrow.dataset as ds
import pytest

from palimpsa.llm import ann
from palimpsa.llm.queries import op8_ann


def brute(ids, x, k=10, every=100):
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), float(d[j])) for j in order]
    return out


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall(spark, sf):
    t = ds.dataset(f"/root/testdata/{sf}/embeddings.parquet").to_table()
    ids, x = t["vec_id"].to_numpy(), np.stack(t["embedding"].to_pylist()).astype(float)
    expected = brute(ids, x)
    rows = op8_ann(spark, f"/root/testdata/{sf}").collect()
    found = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(found) == set(expected) and all(len(v) == 10 for v in found.values())
    scores = {(q, v): s for q, e in found.items() for v, s in e}
    at = {int(i): n for n, i in enumerate(ids)}
    for (q, v), s in scores.items():
        assert s == pytest.approx(float(np.sqrt(((x[at[q]] - x[at[v]]) ** 2).sum())), abs=1e-12)
    hits = sum(len({v for v, _ in found[q]} & {v for v, _ in expected[q]}) for q in expected)
    assert hits / (10 * len(expected)) >= 0.95


def test_graph_search_finds_near_centroids():
    rng = np.random.default_rng(1)
    graph = ann.Graph.build(rng.normal(size=(700, 16)))
    q = rng.normal(size=(50, 16))
    ids, dist = graph.search(q, 5)
    exact = np.argsort(ann._squares(q, graph.centroids), axis=1)[:, :5]
    assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(ids, exact)]) > 0.9
    assert all(len(set(r)) == 5 for r in ids) and (np.diff(dist, axis=1) >= 0).all()


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(ann, "LIST_LIMIT", 3)
    nan, inf = float("nan"), float("inf")
    good = [(i, [float(i % 5), 1.0]) for i in range(0, 40)]
    rows = [*good, *good[:3], (100, [2.0, 1.0]), (100, [2.0, 1.0]), (200, None), (300, [0.0, 0.0]), (400, [nan, 1.0])]
    rows += [(500, [inf, 1.0]), (600, [None, 1.0]), (700, []), (800, [1.0]), (None, [1.0, 1.0])]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, ids string")
    found = {}
    for r in sorted(ann.search(frame).collect(), key=lambda r: r["rank"]):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    ids = np.array([*range(40), 100])
    assert found == brute(ids, np.array([[float(i % 5) if i < 40 else 2.0, 1.0] for i in ids]))
    assert ann.search(frame.limit(0)).count() == 0
    one = frame.filter("vec_id = 0").limit(1)
    assert ann.search(one).count() == 0


def test_split_and_pruned_lists_and_the_exact_way(spark, monkeypatch):
    monkeypatch.setattr(ann, "LIST_LIMIT", 15)  # every list is dealt over tasks
    monkeypatch.setattr(ann, "PROBES", 64)  # of 178 lists
    path = "/root/testdata/sf0.1/embeddings.parquet"
    t = ds.dataset(path).to_table()
    ids, x = t["vec_id"].to_numpy(), np.stack(t["embedding"].to_pylist()).astype(float)
    expected = brute(ids, x)
    for exact in (False, True):
        found = {}
        for r in sorted(ann.search(spark.read.parquet(path), exact=exact).collect(), key=lambda r: r["rank"]):
            found.setdefault(r.query_id, []).append(r.vec_id)
        hits = sum(len(set(found[q]) & {v for v, _ in e}) for q, e in expected.items())
        assert hits / (10 * len(expected)) >= (1.0 if exact else 0.9)
    assert ann.search(spark.read.parquet(path).limit(0), exact=True).count() == 0
