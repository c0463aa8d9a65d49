import hashlib
import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from palimpsa.llm import suffix
from palimpsa.llm.queries import op5_repeats

PATH = "/root/testdata/sf0.001"


def brute(docs, width=50):
    first = {}
    big = 1 << 62
    for d, t in docs:
        for i in range(len(t) - width + 1):
            w = t[i : i + width]
            first[w] = min(first.get(w, big), big if d is None else d)
    out = []
    for d, t in docs:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - width + 1):
            if first[t[i : i + width]] < (big if d is None else d):
                gone[i : i + width] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((d, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def key(r):
    return (r[0] is None, r[0] or 0, *r[1:])


def test_query(spark):
    docs = [(r["doc_id"], (r["text"] or "").encode()) for r in pq.read_table(f"{PATH}/documents.parquet").to_pylist()]
    assert sorted(map(tuple, op5_repeats(spark, PATH).collect())) == sorted(brute(docs))


@pytest.mark.parametrize(("block", "shard", "span", "hot"), [(3 << 20, 2 << 20, 8 << 20, 50_000), (4000, 900, 3000, 6), (900, 300, 500, 2)])
def test_against_brute_force(spark, tmp_path, monkeypatch, block, shard, span, hot):
    for name, value in (("BLOCK_BYTES", block), ("SHARD_BYTES", shard), ("RANGE_BYTES", span), ("HOT", hot)):
        monkeypatch.setattr(suffix, name, value)
    rng = random.Random(block)
    word = lambda: "".join(rng.choice("abcdeé\0") for _ in range(rng.randrange(1, 7)))
    passages = [" ".join(word() for _ in range(rng.randrange(8, 40))) for _ in range(12)]
    docs = []
    for i in range(90):
        parts = [" ".join(word() for _ in range(rng.randrange(0, 40))) for _ in range(3)]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            a = rng.randrange(0, 20)
            parts.insert(rng.randrange(3), p[a : a + rng.randrange(30, 300)])
        docs.append((rng.choice([i, i, i % 7, None]), " ".join(parts)))
    docs += [(3, None), (4, ""), (60, "ab" * 4000), (61, "ba" * 3000), (62, "x" * 49), (63, "x" * 50), (64, "x" * 51), docs[0]]
    frame = spark.createDataFrame([(d, t, 1, "c") for d, t in docs], "doc_id long, text string, dedup_id int, dedup_kept string")
    frame.coalesce(3).write.parquet(f"{tmp_path}/t")
    found = suffix.report(spark.read.parquet(f"{tmp_path}/t")).collect()
    assert sorted(map(tuple, found), key=key) == sorted(brute([(d, (t or "").encode()) for d, t in docs]), key=key)
    kept = suffix.without_repeats(spark.read.parquet(f"{tmp_path}/t"), f"{tmp_path}/w")
    assert kept.columns == frame.columns and kept.count() == len(docs)
    assert suffix.report(frame.limit(0)).count() == 0


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(1)
    for data in (rng.integers(97, 99, 3000, dtype=np.uint8), np.full(500, 97, np.uint8), rng.integers(0, 256, 10, dtype=np.uint8)):
        order = suffix.suffix_array(data)
        raw = data.tobytes()
        cut = [raw[i:] for i in order]
        assert sorted(order.tolist()) == list(range(len(data))) and cut == sorted(cut)
        lcp = suffix.common_prefixes(data, order, 50, lanes=7)
        for k in range(1, len(order)):
            a, b, n = cut[k - 1], cut[k], 0
            while n < min(len(a), len(b), 50) and a[n] == b[n]:
                n += 1
            assert lcp[k] == n


def test_shards_agree_with_one_array(monkeypatch):
    rng = random.Random(5)
    parts = ["".join(rng.choice("ab") for _ in range(rng.randrange(50, 58))).encode() for _ in range(300)]
    owners = np.array([rng.randrange(60) for _ in parts])
    whole = suffix.earlier_windows(parts, owners)
    monkeypatch.setattr(suffix, "SHARD_BYTES", 700)
    assert all((a == b).all() for a, b in zip(whole, suffix.earlier_windows(parts, owners), strict=True))


def test_only_broken_characters_go(spark, tmp_path):
    """A cut within a character takes that one; U+FFFD and U+FDD0 of the text stay."""
    same = "é" * 40 + "x" * 30
    texts = ["a" + same, "\ufffd\ufdd0z" + same + "\ufffd\ufdd0b\ufdd0", "\ufffd"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.text for r in suffix.without_repeats(docs, f"file://{tmp_path}/s").collect()}
    assert found == {0: texts[0], 1: "\ufffd\ufdd0z\ufffd\ufdd0b\ufdd0", 2: "\ufffd"}
