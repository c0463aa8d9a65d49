import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa

from palimpsa.llm import periodic


def brute(doc, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if doc is not None and n:
        h = zlib.crc32(str(doc).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = []
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            s, e = i, j + p
            if j > i and e - s >= max(6, 4 * p) and not any(all(w[k] == w[k + q] for k in range(s, e - q)) for q in range(1, p)):
                runs.append((s, e - s, p))
            i = max(j, i + 1) if j > i else i + 1
    runs.sort(key=lambda r: (r[0], r[2]))
    gone = {k for s, length, p in runs for k in range(s + p, s + length)}
    b = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    listed = "".join(f"{s},{length},{p}\n" for s, length, p in runs)
    kept = " ".join(x for k, x in enumerate(w) if k not in gone)
    return (doc, len(runs), *b, 1000 * b[1] // b[2] if runs else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def texts(seed, count):
    r = random.Random(seed)
    out = []
    for _ in range(count):
        letters = "abcdefghijklmnopqrstuvwxyz"[: r.choice([1, 2, 3, 26])]
        words = [r.choice(letters) for _ in range(r.randrange(60))]
        if r.random() < 0.4:
            words = words[:10] + words * r.randrange(1, 8)
        gap = r.choice([" ", "\n", "\t \x0b", "\x0c\r"])
        out.append((r.choice([None, r.randrange(10**6), r.randrange(50)]), r.choice(["", " "]) + gap.join(words) + r.choice(["", "\n"])))
    return out


def test_equals_brute_force(spark):
    rows = [*texts(1, 150), (1, None), (2, ""), (3, " \t "), (4, "é x " * 9), (4, "é x " * 9), (5, "w\x1cw w\x1cw w\x1cw w\x1cw w\x1cw w\x1cw")]
    docs = spark.createDataFrame([(*r, "mine", 3) for r in rows], "doc_id long, text string, start string, n_runs int").repartition(3)
    got = sorted((tuple(r) for r in periodic.periodic_runs(docs, plant=True).collect()), key=repr)
    assert got == sorted((brute(*r) for r in rows), key=repr)
    assert sum(r[1] > 0 for r in got) > 50
    assert periodic.periodic_runs(docs.limit(0)).count() == 0


def test_blocks_share_arrays(monkeypatch):
    rows = texts(2, 120)
    monkeypatch.setattr(periodic, "ARRAY_WORDS", 200)  # many arrays for one block
    got = periodic.block_rows([r[0] for r in rows], pa.array([r[1].encode() for r in rows], pa.binary()))
    assert [tuple(r.values()) for r in got.to_pylist()] == [brute(*r) for r in rows]


def test_very_long_text():
    r = random.Random(3)
    head = [r.choice("abcdefg") + str(r.randrange(4000)) for _ in range(60_000)]
    words = head + head[:7000] * 5 + ["x"] * 30_000
    got = periodic.block_rows([None], pa.array([" ".join(words).encode()], pa.binary()), plant=False).to_pylist()[0]
    assert (got["n_runs"], got["start"], got["length"], got["period"]) == (2, 95_000, 30_000, 1)


def test_range_minima():
    r = np.random.default_rng(5)
    values = r.integers(0, 1000, 3000).astype(np.int32)
    low = r.integers(0, 2999, 2000)
    high = np.minimum(low + r.integers(1, 3000, 2000), 3000)
    assert periodic.Minima(values).of(low, high).tolist() == [int(values[a:b].min()) for a, b in zip(low, high, strict=True)]
