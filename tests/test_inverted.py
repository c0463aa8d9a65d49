import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from palimpsa.operators import inverted, ranking


def brute(docs, queries, k, allowed=None):
    split = {i: re.findall(r"[^\W]+", (t or "").lower()) for i, t in docs}
    n, average = len(split), sum(map(len, split.values())) / len(split)
    counts = {i: Counter(t) for i, t in split.items()}
    df = Counter(t for c in counts.values() for t in c)
    out = {}
    for q, text in queries:
        scores = {}
        for i, c in counts.items():
            if allowed is not None and i not in allowed:
                continue
            s = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * len(split[i]) / average)) for t in set(re.findall(r"[^\W]+", (text or "").lower())) if t in c)
            if s:
                scores[i] = s
        best = sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k]
        if best:
            out[q] = [(i, round(s, 6)) for i, s in best]
    return out


def corpus(seed, count):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    return [(i * 3, " ".join(r.choices(words, weights, k=r.randrange(1, 120)))) for i in range(count)] + [(-1, None), (-2, ""), (-5, "w0 " * 3000)]


@pytest.mark.parametrize(("shard", "group", "block"), [(8192, 1024, 128), (300, 7, 4), (50, 1024, 16)])
def test_equals_scoring_all(spark, tmp_path, monkeypatch, shard, group, block):
    for name, value in (("SHARD_DOCS", shard), ("QUERY_GROUP", group), ("BLOCK", block)):
        monkeypatch.setattr(inverted, name, value)
    r = random.Random(5)
    docs = corpus(1, 900)
    queries = [(q, " ".join(f"w{min(int(r.paretovariate(0.4)), 450)}" for _ in range(r.randrange(1, 30)))) for q in range(40)] + [(90, None), (91, "nothing known")]
    frame = spark.createDataFrame(docs, "d long, t string")
    inverted.build(frame, "d", "t", f"{tmp_path}/index")
    index = spark.read.parquet(f"{tmp_path}/index")
    if shard < 8192:  # the term that most documents have is in every shard, and nowhere in one list
        lists = index.filter("term = 'w0'").select(F.size("docs").alias("n")).collect()
        assert len(lists) == inverted.shard_count(spark, len(docs)) and max(x.n for x in lists) < 2 * shard
    found = inverted.search(index, spark.createDataFrame(queries, "q int, t string"), "q", "t", 10)
    top = ranking.top(found.withColumn("s", F.round("score", 9)), "s", "id", 10, ["query_id"])
    got = {}
    for x in top.orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x.id, round(x.score, 6)))
    assert got == brute(docs, queries, 10)
    allowed = {i for i, _ in docs if i % 4 == 0 or i < 0}
    some = inverted.search(index, spark.createDataFrame(queries, "q int, t string"), "q", "t", 10, spark.createDataFrame([(i,) for i in [*allowed, 10**9]], "d long"))
    got = {}
    for x in ranking.top(some.withColumn("s", F.round("score", 9)), "s", "id", 10, ["query_id"]).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x.id, round(x.score, 6)))
    assert got == brute(docs, queries, 10, allowed)


def test_few_blocks_are_read(spark, tmp_path):
    import numpy as np
    import pyarrow as pa

    n = 4000
    schema = pa.schema([("shard", pa.int32()), ("term", pa.string()), ("ids", pa.list_(pa.int64())), *[(c, pa.list_(pa.int32())) for c in ("docs", "counts", "lengths", "most", "least")]])
    terms = [["common", *(["rare"] * (i % 1000 == 0))] for i in range(n)]
    table = inverted._postings(pa.table({"id": pa.array(range(n)), "terms": terms, "shard": pa.array([0] * n, pa.int32())}), schema)
    shard = inverted._Shard(table, 1.001)
    touched = []
    share = shard.share
    shard.share = lambda c, d: (touched.append(len(c)), share(c, d))[1]
    at, score = shard.best([("common", 0.001), ("rare", 7.0)], 3)
    assert shard.ids.take(pa.array(at)).to_pylist() == [0, 1000, 2000] and np.all(score > 4)
    assert sum(touched) < 100  # of 4000 postings of the common term


def test_empty(spark, tmp_path):
    docs = spark.createDataFrame([], "d long, t string")
    inverted.build(docs, "d", "t", f"{tmp_path}/index")
    queries = spark.createDataFrame([(1, "a")], "q int, t string")
    assert inverted.search(spark.read.parquet(f"{tmp_path}/index"), queries, "q", "t", 3).count() == 0
