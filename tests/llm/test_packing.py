import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from palimpsa.llm import packing, tokens
from palimpsa.llm.queries import op7_packing

PATH = "/root/testdata/sf0.001"


def whole_ids(text):
    t = Tokenizer.from_file(tokens.tokenizer_path("word_bpe_49k.json"))
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def check_cover(rows, size):
    seqs = defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    last = max(seqs, default=-1)
    assert sorted(seqs) == list(range(last + 1))
    for s, parts in seqs.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at == size or (s == last and at <= size)


def test_query(spark):
    rows = op7_packing(spark, PATH).collect()
    check_cover(rows, 2048)
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    for d in pq.read_table(f"{PATH}/documents.parquet").to_pylist():
        ids, at = whole_ids(d["text"]), 0
        for r in sorted(by[d["doc_id"]], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)


def test_windows_hold_the_mixture(spark):
    rows = op7_packing(spark, PATH).collect()
    total, parts, full = defaultdict(int), defaultdict(int), max(r.sequence_id for r in rows)
    for r in rows:
        total[r.source] += r.length
        parts[r.sequence_id, r.source] += r.length
    n = sum(total.values())
    for (s, source), length in parts.items():
        if s < full:
            assert abs(length - 2048 * total[source] / n) <= 2 or total[source] / n < 1 / 32


@pytest.mark.parametrize("weights", [None, [5, 1, 0, 2], [1, 1, 1, 1]])
def test_schedule_against_simulation(weights):
    rng = random.Random(1)
    totals = [1000, 37, 512, 0]
    plan = packing.phases(totals, weights)
    assert sum(p.length for p in plan) == sum(totals)
    taken = set()
    for q, total in enumerate(totals):
        x = 0
        while x < total:
            n = min(total - x, rng.randrange(1, 90))
            at = 0
            for start, length, seq, offset in packing.pieces(plan, q, x, n, 64):
                assert start == at and length > 0 and offset + length <= 64
                spots = {(seq, offset + k) for k in range(length)}
                assert not spots & taken
                taken |= spots
                at += length
            assert at == n
            x += n
    assert taken == {(i // 64, i % 64) for i in range(sum(totals))}
    if weights == [5, 1, 0, 2]:  # the first windows follow the weights
        got = sum(length for _, length, s, _ in packing.pieces(plan, 0, 0, 200, 64) if s == 0)
        assert abs(got - 64 * 5 / 6) <= 1


def test_small_sources_keep_their_weights(spark, tmp_path):
    """Sources of a thousandth of the tokens, with large, equal and small weights, and some without."""
    sizes = {"big": 3000, "tiny": 20, "late": 50, **{f"s{i}": 12 for i in range(80)}}
    weights = {"big": 1.0, "tiny": 3.0, **{f"s{i}": 0.01 for i in range(80)}}
    rows = [(n, f"{s} some words {n} " * 5, s) for n, s in enumerate(s for s, k in sizes.items() for _ in range(k))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    found = packing.pack(docs, f"{tmp_path}/p", tokens.tokenizer_path("word_bpe_49k.json"), 1, weights, size=256).collect()
    check_cover(found, 256)
    part, last = defaultdict(int), {}
    for r in found:
        part[r.sequence_id, r.source] += r.length
        last[r.source] = max(last.get(r.source, 0), r.sequence_id)
    total = 1 + 3 + 0.8
    assert abs(part[0, "tiny"] - 256 * 3 / total) <= 2 and abs(part[0, "big"] - 256 / total) <= 2
    small = sum(n for (s, source), n in part.items() if s == 0 and source.startswith("s"))
    assert abs(small - 256 * 0.8 / total) <= 2
    assert len({source for (s, source), n in part.items() if s < 60 and source.startswith("s")}) > 40
    assert min(s for s, source in part if source == "late") >= max(x for s, x in last.items() if s != "late")


def test_queues_of_almost_no_tokens(spark, tmp_path):
    """Half the bytes are white space, so a source with a queue has a few tokens in all."""
    rows = [(i, " " * 4000, "blank") for i in range(3)] + [(i, "words " * 200, f"src{i % 2}") for i in range(3, 90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = packing.pack(docs, f"{tmp_path}/p", tokens.tokenizer_path("word_bpe_49k.json"), 1, size=64).collect()
    check_cover(found, 64)
    assert sum(r.length for r in found if r.source == "blank") == 3


def test_odd_rows(spark, tmp_path):
    rows = [(1, None, "a"), (2, "", None), (None, "some text", "b"), (3, "same", "a"), (3, "same", "a"), (4, "word " * 9000, "a")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, part int, ids int")
    found = packing.pack(docs, f"{tmp_path}/p", tokens.tokenizer_path("word_bpe_49k.json"), 1).collect()
    check_cover(found, 2048)
    assert sum(r.length for r in found) == sum(len(whole_ids(t)) for _, t, _ in rows)
    made = packing.sequences(spark.createDataFrame(found), 0).collect()
    assert all(len(r.tokens) == 2048 for r in made)
    assert packing.packed(docs.limit(0)).count() == 0
    again = packing.pack(docs, f"{tmp_path}/q", tokens.tokenizer_path("word_bpe_49k.json"), 1, {"a": 1.0, "none such": 2.0}).collect()
    check_cover(again, 2048)
