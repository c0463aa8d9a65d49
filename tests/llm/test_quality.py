import random

import duckdb
import pytest
from pyspark.sql import functions as F

from palimpsa.llm import quality
from palimpsa.llm.queries import op3_quality


def rows_of(spark, texts):
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, quality_words int")
    return docs, {r.doc_id: r for r in quality.report(docs).collect()}


def test_query_matches_sql(spark):
    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{path}/documents.parquet'")
    expected = con.execute(quality.SQL).fetchall()
    assert sorted(map(tuple, op3_quality(spark, path).collect())) == sorted(expected)


def test_odd_texts(spark):
    good = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    texts = [None, "", " \n\t", "a b c a b c", good, good.upper(), good + "\nx y\nx y", "a b c", "w " * 20000]
    docs, found = rows_of(spark, texts)
    assert [found[i].n_words for i in range(9)] == [0, 0, 0, 6, 60, 60, 64, 2, 20000]
    assert [found[i].kept for i in range(9)] == [False] * 4 + [True, False, True, False, False]
    assert (found[3].n_repeat_words, found[6].n_dup_lines, found[8].n_repeat_words) == (6, 1, 20000)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {4, 6}
    assert quality.report(docs.limit(0)).count() == 0


@pytest.mark.parametrize("bits", [24, 62, 6])
def test_repeated_words_are_exact_when_hashes_clash_or_texts_are_long(spark, monkeypatch, bits):
    """62 position bits leave two of the hash; six hold fewer positions than the texts have."""
    monkeypatch.setattr(quality, "POSITION_BITS", bits)
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefg"[: 1 + i % 7]) for _ in range(rng.randrange(150))) for i in range(120)]
    _, found = rows_of(spark, texts)
    for i, t in enumerate(texts):
        w = t.split()
        grams = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
        hit = {j + k for j, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
        assert found[i].n_repeat_words == len(hit)


def test_cascade_orders_by_rejection_per_cost(spark):
    docs = spark.createDataFrame([(i, "### " * 60 if i % 2 else "plain words " * 40) for i in range(40)], "doc_id long, text string")
    never = quality.Rule("never", lambda text, words, n: F.length(text) < 0)
    order = quality.plan_cascade(docs, rules=(never, *quality.RULES))
    assert order[-1].rejected == 0 and order[0].rejected > 0
    assert {m.rule.name for m in order} == {"never", *(r.name for r in quality.RULES)} and all(m.seconds > 0 for m in order)


def test_costs_tell_a_heavy_rule_from_a_light_one(spark):
    docs = spark.createDataFrame([(i, f"some words {i} " * 400) for i in range(400)], "doc_id long, text string")
    light = quality.Rule("light", lambda text, words, n: n < 0)
    heavy = quality.Rule("heavy", lambda text, words, n: F.size(F.array_distinct(F.transform(words, lambda w: F.sha2(w, 512)))) < 0)
    seconds = {m.rule.name: m.seconds for m in quality.plan_cascade(docs, rules=(light, heavy))}
    assert seconds["heavy"] > 3 * seconds["light"] and seconds["heavy"] > 0.05


def test_order_is_greedy_on_what_is_left():
    rules = [quality.Rule(n, None) for n in "abc"]
    # b rejects most a second; a only rejects what b does; c adds one that no other has.
    left = [([True, True, False], 6), ([False, True, False], 2), ([False, False, True], 1), ([False, False, False], 11)]
    order = quality.greedy_order(rules, [1.0, 1.0, 2.0], left)
    assert [(m.rule.name, m.rejected) for m in order] == [("b", 8 / 20), ("c", 1 / 12), ("a", 0.0)]
    assert [m.rule.name for m in quality.greedy_order(rules, [1.0, 20.0, 2.0], left)] == ["a", "c", "b"]
