import random
import tracemalloc

import pytest

from palimpsa.operators import patterns


def brute(text, names):
    return sorted((i, i + len(n), n) for n in set(names) if n for i in range(len(text)) if text.startswith(n, i))


def texts(seed, count):
    r = random.Random(seed)
    return [(i, "".join(r.choice("ab é") for _ in range(r.randrange(40)))) for i in range(count)] + [(count, None), (count + 1, "")]


@pytest.mark.parametrize("chars", [2_000_000, 8])
def test_hits_and_choices(spark, monkeypatch, chars):
    monkeypatch.setattr(patterns, "PART_CHARS", chars)  # one automaton, or many that texts are dealt to
    r = random.Random(1)
    names = ["".join(r.choice("ab é") for _ in range(r.randrange(1, 5))) for _ in range(25)] + ["", None, "a", "ab", "aba"]
    rows = texts(2, 80)
    frame = spark.createDataFrame(rows, "i int, t string")
    known = spark.createDataFrame([(n,) for n in names], "name string")
    found = patterns.hits(frame, "i", "t", known)
    got = {x.id: [tuple(h) for h in x.hits] for x in found.collect()}
    want = {i: brute(t or "", [n for n in names if n]) for i, t in rows}
    assert got == {i: h for i, h in want.items() if h}
    free = {x.id: [tuple(h) for h in x.hits] for x in patterns.uncovered(found).collect()}
    for i, h in got.items():
        assert free[i] == [a for a in h if not any(b[0] <= a[0] and b[1] >= a[1] and b != a for b in h)]
    for x in patterns.apart(found).collect():
        spans = [tuple(h) for h in x.hits]
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
        assert all(any(a[0] < b[1] and b[0] < a[1] and b[1] - b[0] >= a[1] - a[0] for b in spans) for a in got[x.id])
    assert patterns.hits(frame, "i", "t", known.limit(0)).count() == 0


def test_long_texts_against_many_names(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(4, 10)))
    names = sorted({f"{word()} {word()}" for _ in range(100_000)})
    planted = r.sample(names, 500)
    text = " ".join(x for n in planted for x in (n, *(word() for _ in range(38))))
    assert len(text.split()) >= 20_000
    known = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id int, name string")
    questions = spark.createDataFrame([(1, text), (2, text.upper()), (3, "nothing")], "question int, text string")
    got = patterns.mentioned(questions, known).collect()
    assert {x.name for x in got if x.question == 1} >= set(planted) and {x.question for x in got} == {1, 2}
    assert all(text[x.start - 1 :].startswith(x.name) for x in got if x.question == 1)


def test_memory_is_linear_in_the_text():
    hits = lambda n: [{"start": i, "stop": i + 5, "name": "abcde"} for i in range(0, n, 5)]
    peaks = []
    for n in (20_000, 200_000):
        own = hits(n)
        tracemalloc.start()
        assert len(patterns._uncovered(own)) == len(patterns._apart(own)) == n // 5
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 15 * peaks[0]


def test_expansion(spark):
    surfaces = spark.createDataFrame([("合作方", "Partner"), ("方", "Side"), ("合作", "Work"), ("甲方", "A")], "form string, class string")
    ancestors = spark.createDataFrame([("Supplier", "Partner"), ("Partner", "Agent"), ("Work", "Act")], "class string, ancestor string")
    queries = spark.createDataFrame([(1, "合作方有哪些"), (2, "方"), (3, None), (4, "合作甲方")], "i int, t string")
    got = {x.i: (x.terms, x.subclasses) for x in patterns.expanded(queries, "i", "t", surfaces, ancestors).collect()}
    assert got == {1: (["Partner"], ["Supplier"]), 4: (["A", "Work"], [])}
