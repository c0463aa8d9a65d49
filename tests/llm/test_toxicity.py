import random
import zlib

import numpy as np

from palimpsa.llm import toxicity
from palimpsa.llm.queries import op6_toxicity


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{path}/labels.parquet").collect()}
    rows = op6_toxicity(spark, path).collect()
    assert len(rows) == 10_000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    toxic = [p for y, p in held if y]
    clean = [p for y, p in held if not y]
    assert sum(toxic) / len(toxic) > 0.9 and sum(clean) / len(clean) < 0.005


def test_labels_of_the_held_out_fold_are_not_used(spark):
    path = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    held = ~toxicity.training_fold("doc_id", 3)
    from pyspark.sql import functions as F

    flipped = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, flipped)
    assert a.words == b.words and np.allclose(a.weights, b.weights)


def test_label_model_recovers_rates():
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.3
    rates = np.array([[0.05, 0.1, 0.02], [0.7, 0.6, 0.9]])
    votes = (rng.random((4000, 3)) < rates[y.astype(int)]).astype(float)
    post, found, _ = toxicity.label_model(votes, votes.mean(axis=1))
    assert np.abs(found - rates).max() < 0.06 and ((post > 0.5) == y).mean() > 0.93


def test_odd_rows(spark):
    rng = random.Random(1)
    rows, gold = [], []
    for i in range(300):
        bad = i % 3 == 0
        words = [rng.choice("alpha beta gamma delta".split()) for _ in range(30)] + ["vilest"] * bad
        rows.append((i, " ".join(words), 0.5))
        gold.append((i, int(bad)))
    rows += [(1000, None, 0.5), (1001, "", 0.5), (None, "vilest", 0.5), (1002, "vilest " * 50_000, 0.5), (1002, "vilest " * 50_000, 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame(gold + [(None, 1), (5, None)], "doc_id long, toxic int")
    found = toxicity.scores(docs, labels).collect()
    by = {r.doc_id: r.predicted for r in found}
    assert len(found) == 305 and all(by[i] == y for i, y in gold)
    assert (by[1000], by[1001], by[None], by[1002]) == (0, 0, 1, 1)
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 202
    assert {r.score for r in toxicity.scores(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.scores(docs.limit(0), labels).count() == 0


def test_scores_against_a_plain_recomputation(spark):
    """Hits, features and probability of every document, from the fitted voters and weights alone."""
    import math

    path = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    assert model.n
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in op6_toxicity(spark, path).collect():
        hits, words = [0] * model.n, texts[r.doc_id].encode().split()
        for raw in words:
            w = raw.decode().lower()
            while w and not w[0].isalnum():
                w = w[1:]
            while w and not w[-1].isalnum():
                w = w[:-1]
            own = [model.words[w]] if w in model.words else [model.beginnings[w[:k]] for k in range(4, 9) if len(w) >= k and w[:k] in model.beginnings]
            if own:
                hits[own[0]] += 1
        for v in model.beginnings.values():
            if hits[v] < 2 or hits[v] < 0.005 * len(words):
                hits[v] = 0
        total = sum(hits)
        x = [1, *[math.log1p(h) for h in hits], math.log1p(total), total > 0, total > 1, 100 * total / max(len(words), 100)]
        z = sum(a * b for a, b in zip(x, model.weights, strict=True))
        assert abs(r.score - 1 / (1 + math.exp(-max(-30, min(30, z))))) < 1e-9


def test_an_id_of_many_rows_is_one_labelled_text(spark):
    docs = spark.createDataFrame([(7, f"text {i % 7}") for i in range(500)] + [(0, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(7, 1), (7, 0), (0, 0)], "doc_id long, toxic int")
    sample = toxicity.labelled_sample(docs, labels, "doc_id", "text", 100).collect()
    assert [(r.doc_id, bytes(r.text), r.toxic) for r in sorted(sample)] == [(0, b"", 0), (7, b"text 0", 1)]
