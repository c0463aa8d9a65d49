import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from palimpsa.llm import hmm
from palimpsa.llm.queries import op10_hmm

PATH = "/root/testdata/sf0.01"


def random_model(states, symbols, seed=1):
    rng = np.random.default_rng(seed)
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    return hmm.Model(norm(rng.random(states), 0), norm(rng.random((states, states)), 1), norm(rng.random((symbols, states)), 0))


def brute(model, seq):
    """Likelihood and expected counts from all state paths."""
    k = len(model.start)
    total, starts, moves, emits = 0.0, np.zeros(k), np.zeros((k, k)), np.zeros(model.emits.shape)
    for path in itertools.product(range(k), repeat=len(seq)):
        p = model.start[path[0]] * model.emits[seq[0], path[0]]
        for a, b, x in zip(path, path[1:], seq[1:]):
            p *= model.moves[a, b] * model.emits[x, b]
        total += p
        starts[path[0]] += p
        for a, b in zip(path, path[1:]):
            moves[a, b] += p
        for x, a in zip(seq, path):
            emits[x, a] += p
    return total, starts / total, moves / total, emits / total


def test_forward_and_expected_counts_against_all_paths():
    model = random_model(3, 5)
    seqs = [np.array(s) for s in ([0, 1, 2, 3], [4], [2, 2, 1, 0, 4, 3], [1, 1])]
    each = [brute(model, s) for s in seqs]
    assert np.allclose(hmm.forward_log10(model, seqs), [math.log10(x[0]) for x in each])
    starts, moves, emits, total = hmm.expected_counts(model, seqs)
    for i, found in ((1, starts), (2, moves), (3, emits)):
        assert np.allclose(found, sum(x[i] for x in each), atol=1e-5)
    assert total == pytest.approx(sum(math.log10(x[0]) for x in each), rel=1e-5)


@pytest.mark.parametrize("span", [1, 2, 4])
def test_spans_of_a_text_give_the_counts_of_the_whole(span, monkeypatch):
    monkeypatch.setattr(hmm, "SPAN", span)
    model = random_model(3, 5, 4)
    seqs = [np.array(s) for s in ([0, 1, 2, 3, 4, 0, 0, 2, 1], [4], [2, 2, 1, 0], [1, 1, 3, 3, 0])]
    each = [brute(model, s) for s in seqs]
    *found, total = hmm.expected_counts(model, seqs)
    for i in (1, 2, 3):
        assert np.allclose(found[i - 1], sum(x[i] for x in each), atol=1e-4)
    assert total == pytest.approx(sum(math.log10(x[0]) for x in each), rel=1e-5)


def test_a_long_text_against_an_uncut_recursion(monkeypatch):
    model = random_model(4, 50, 5)
    seqs = [np.random.default_rng(n).integers(0, 50, n) for n in (5000, 513, 512, 1, 1024)]
    cut = hmm.expected_counts(model, seqs)
    monkeypatch.setattr(hmm, "SPAN", 10**6)
    for a, b in zip(cut, hmm.expected_counts(model, seqs), strict=True):
        assert np.allclose(a, b, rtol=2e-3, atol=1e-2)


def test_a_table_with_one_repeated_id_is_trained_on(spark):
    docs = spark.createDataFrame([(4, f"aa bb {'cc dd ' * n}") for n in range(40)], "doc_id long, text string")
    assert zlib.crc32(b"4") % 5 != 1
    for r in hmm.scores(docs).collect():
        assert not r.held_out and r.score > r.base_score


def test_rounds_do_not_lower_the_likelihood():
    rng = np.random.default_rng(2)
    seqs = [rng.integers(0, 6, 30) if i % 2 else rng.integers(3, 9, 30) for i in range(40)]
    counts = np.bincount(np.concatenate(seqs), minlength=9).astype(float)
    model, last = hmm.fresh_model(counts, 2), -1e9
    for _ in range(15):
        *found, total = hmm.expected_counts(model, seqs)
        assert total >= last - 0.5
        model, last = hmm.maximise(*found, counts), total


@pytest.fixture(scope="module")
def rows(spark):
    return op10_hmm(spark, PATH).collect()


def test_base_columns(rows):
    texts = {r["doc_id"]: r["text"] for r in pq.read_table(f"{PATH}/documents.parquet").to_pylist()}
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d in texts}
    tokens = {d: [*t.encode().lower().split(), b""] for d, t in texts.items()}
    c = Counter(w for d, ws in tokens.items() if not held[d] for w in ws)
    n, v = sum(c.values()), len(c)
    assert len(rows) == len(texts)
    for r in rows:
        ws = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[r.doc_id], len(ws), n)
        assert r.n_known == sum(c[w] > 0 for w in ws)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws))


def test_held_out_texts_are_likelier_than_under_the_base(rows):
    held = [r for r in rows if r.held_out]
    gain = sum(r.score - r.base_score for r in held) / sum(r.n_tokens for r in held)
    assert gain > 0.1 and all(r.score < 0 for r in rows)


def test_score_is_the_sum_of_all_paths(spark, monkeypatch):
    monkeypatch.setattr(hmm, "OWN", 4)
    monkeypatch.setattr(hmm, "HEAD", 6)
    monkeypatch.setattr(hmm, "STATES", 2)
    monkeypatch.setattr(hmm.fresh_model, "__defaults__", (2,))
    texts = ["a b a c", "a d e", "b b f g", "a", "h a i", "c c b a", None, "", "a b", "c a"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(0, "a b a c", 1), (None, "z", 2)], "doc_id long, text string, row int")
    kept = {}
    original = hmm.train_model
    monkeypatch.setattr(hmm, "train_model", lambda *a: kept.setdefault("model", original(*a)))
    found = hmm.scores(docs).collect()
    assert len(found) == 12 and len({r.score for r in found if r.doc_id == 0}) == 1
    assert {r.score for r in found if r.doc_id == 6} == {r.score for r in found if r.doc_id == 7}
    data = [(r.doc_id, r.text) for r in docs.collect()]
    trained = [t for d, t in data if d is not None and zlib.crc32(str(d).encode()) % 5 != 1]
    c = Counter(w for t in trained for w in [*(t or "").encode().split(), b""])
    level = lambda n: math.floor(math.log2(n) * 16)
    fits = [n for n in set(c.values()) if sum(level(m) >= level(n) for m in c.values()) <= 6]
    ranked = [b""] + [w for w, n in sorted(c.items(), key=lambda x: (-x[1], x[0])) if w and n in fits]
    own = ranked[:4]
    group = lambda w: hmm.shared_symbol(w)
    for r, (d, t) in zip(sorted(found, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens)), sorted(data, key=lambda x: (x[0] is None, x[0] or 0)), strict=True):
        words = [*(t or "").encode().split(), b""]
        expected, seq = 0.0, []
        for w in words:
            if w in own:
                seq.append(own.index(w))
            else:
                rest = [x for x in c if x not in own and group(x) == group(w)]
                expected += math.log10((c[w] + 0.5) / (sum(c[x] for x in rest) + 0.5 * (len(rest) + 1)))
                seq.append(4 + group(w))
        expected += math.log10(brute(kept["model"], seq)[0])
        assert r.score == pytest.approx(expected)
    assert hmm.scores(docs.limit(0)).count() == 0


def test_the_end_is_counted_when_its_size_class_does_not_fit(spark, monkeypatch):
    monkeypatch.setattr(hmm, "HEAD", 3)
    text = "a b c d e f"  # all counts, that of the end too, are equal: no class fits
    docs = spark.createDataFrame([(i, text) for i in range(6)], "doc_id long, text string")
    trained = sum(zlib.crc32(str(i).encode()) % 5 != 1 for i in range(6))
    n, v = 7 * trained, 7
    for r in hmm.scores(docs).collect():
        assert r.n_known == r.n_tokens == 7
        assert r.base_score == pytest.approx(7 * math.log10((trained + 0.5) / (n + 0.5 * (v + 1))))


def test_the_start_learns_from_all_texts(spark):
    n = 2500
    words = [b"w%d" % i for i in range(n)]
    train = spark.createDataFrame([(i, bytearray(b" ".join([w] * 10))) for i, w in enumerate(words)], "doc_id long, text binary")
    counts = np.concatenate([[n], np.full(n, 10), np.zeros(hmm.SHARED)]).astype(float)
    model = hmm.train_model(train, [b"", *words], counts, rounds=0)
    mass = model.emits[1 : n + 1].sum(axis=1)
    assert mass.min() > 0.02 * mass.max()  # a word that no step has seen has the share of the prior, some thousandths
