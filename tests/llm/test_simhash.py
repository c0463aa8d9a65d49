import random
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash

from palimpsa.llm import simhash
from palimpsa.llm.queries import op1_simhash
from palimpsa.operators.components import connected_components


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    parent = {d: d for d in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = list(fps)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: root(d) for d in ids}


def test_query_matches_brute_force(spark):
    path = "/root/testdata/sf0.001"
    rows = pq.read_table(f"{path}/documents.parquet").to_pylist()
    fps = {r["doc_id"]: brute_fingerprint(r["text"]) for r in rows}
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in op1_simhash(spark, path).collect()}
    comps = brute_components(fps)
    assert found == {d: (f"{fps[d]:016x}", comps[d]) for d in fps}


@pytest.mark.parametrize("limit", [4096, 3])
def test_links_are_exact_also_in_split_buckets(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "BUCKET_LIMIT", limit)
    rng = random.Random(1)
    base = rng.getrandbits(64)
    fps = {}
    for i in range(150):
        x = base if i % 3 else rng.getrandbits(64)
        for _ in range(rng.randrange(9)):
            x ^= 1 << rng.randrange(64)
        fps.setdefault(x, i)
    rows = [(n, [simhash._signed(x)]) for x, n in fps.items()]
    nodes = spark.createDataFrame(rows, "node long, fp array<bigint>")
    found = {r.node: r.component for r in connected_components(simhash.exact_links(nodes), "a", "b").collect()}
    expected = brute_components({n: x for x, n in fps.items()})
    assert {n: found.get(n, n) for n in expected} == expected


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \t\n", "y"), (4, "One two", "y"), (4, "One two", "y"), (None, "one TWO", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    found = [(r.doc_id, r.fp, r.component_id) for r in simhash.near_duplicates(docs).collect()]
    fp = simhash._signed(brute_fingerprint("one two"))
    assert Counter(found) == Counter([(1, 0, 1), (2, 0, 1), (3, 0, 1), (4, fp, 4), (4, fp, 4), (None, fp, 4)])
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_very_long_text_and_clashing_columns(spark):
    rng = random.Random(8)
    words = [f"w{rng.randrange(3000)}" for _ in range(300_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:150_000])), (3, " ".join([*words, "end"])), (4, "short")]
    docs = spark.createDataFrame([(*r, 5, 6, 7) for r in rows], "doc_id long, text string, component_id long, node long, text_hash long")
    found = {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(docs).collect()}
    fps = {i: brute_fingerprint(t) for i, t in rows}
    expected = brute_components(fps)
    assert found == {i: (fps[i], expected[i]) for i in fps} and found[3][1] == 1


@pytest.mark.parametrize("limit", [4096, 2])
def test_wide_fingerprints_find_near_copies(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "BUCKET_LIMIT", limit)
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(500)]
    rows = []
    for g in range(6):
        words = [rng.choice(vocab) for _ in range(300)]
        for c in range(4):
            own = list(words)
            for _ in range(c):
                own[rng.randrange(300)] = "changed"
            rows.append((g * 10 + c, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates_wide(docs).collect()}
    assert found == {d: d - d % 10 for d, _ in rows}


@pytest.mark.parametrize("limit", [4096, 60])
def test_wide_links_are_exact_in_a_family_of_unlike_documents(spark, monkeypatch, limit):
    """All members pass a test on a part of the bits, few pairs the one on all of them."""
    monkeypatch.setattr(simhash, "BUCKET_LIMIT", limit)
    rng = random.Random(3)
    flipped = lambda x, n: x ^ sum(1 << b for b in rng.sample(range(768), n))
    base = rng.getrandbits(768)
    fps = []
    for _ in range(60):
        one = flipped(base, 85)
        fps += [one, flipped(one, 115)]
    fps += [flipped(base, 85) for _ in range(180)]
    words = lambda x, size: [x >> i & (1 << size) - 1 for i in range(0, 768, size)]
    bands = [words(x, 16) for x in fps]
    links = {
        (i, j)
        for i in range(len(fps))
        for j in range(i)
        if (fps[i] ^ fps[j]).bit_count() <= 127 and any(a == b for a, b in zip(bands[i], bands[j], strict=True))
    }
    assert len(links) >= 50
    rows = [(n, [simhash._signed(w) for w in words(x, 64)]) for n, x in enumerate(fps)]
    nodes = spark.createDataFrame(rows, "node long, fp array<bigint>")
    expected = spark.createDataFrame(sorted(links), "a long, b long")
    part = lambda frame: {r.node: r.component for r in connected_components(frame, "a", "b").collect()}
    assert part(simhash.band_links(nodes, 12, 127)) == part(expected)


def test_long_text_lanes():
    text = b"a b c " * 3000
    got = int(simhash.fingerprint_block([text, b"", text], 3, 1)[0, 0])
    assert got == brute_fingerprint(text.decode())
    assert simhash.fingerprint_block([text], 3, 2).dtype == np.uint64
