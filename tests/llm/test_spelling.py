import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb

from palimpsa.llm import spelling


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def brute(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    found = {}
    for w, n in words.items():
        own = [v for v in words if near(w, v)]
        best = min(own, key=lambda v: (-words[v], v), default=None)
        form = best if best and words[best] >= 5 * n else None
        found[w] = (form, n, len(own))
    out = set()
    for w, (form, n, n_near) in found.items():
        root = w
        while found[root][0]:
            root = found[root][0]
        out.add((w, form, root, n, n_near, words[form] if form else None))
    return out


def texts(seed):
    r = random.Random(seed)
    base = ["".join(r.choice("abcdeé") for _ in range(r.randrange(5, 9))) for _ in range(12)] + ["ÀÉÎõüß", "Straße", "÷×÷×÷×", "anagram", "gramana"]
    words = set(base)
    for w in base:
        for _ in range(6):
            i = r.randrange(len(w))
            words.add(r.choice([w[:i] + w[i + 1 :], w[:i] + r.choice("abcéÿ") + w[i:], w[:i] + r.choice("xyzè") + w[i + 1 :]]))
    words = sorted(words)
    out = []
    for doc in range(40):
        picked = [w for w in words for _ in range(r.choice([0, 0, 1, 1, 2, 2, 25 if w in base else 1]))]
        r.shuffle(picked)
        out.append((r.choice([doc, doc, None]), r.choice([" ", ", ", "1"]).join(p.upper() if r.random() < 0.1 and p.isascii() else p for p in picked)))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "mine", 1) for r in rows], "doc_id long, text string, word string, n int")


def test_equals_brute_force_and_sql(spark):
    rows = [*texts(1), (None, None), (7, ""), (8, " 123 "), (9, "kaatle " * 30 + "katle "), (9, "kaatle " * 30 + "katle "), (10, "kbcxyz " * 200 + "kbcxyzu " * 30 + "kbcxyzuv " * 5)]
    docs = frame(spark, rows)
    got = [tuple(r) for r in spelling.variants(docs).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    assert sum(r[1] is not None for r in got) > 10 and any(r[2] not in (r[0], r[1]) for r in got)
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toArrow())
    assert set(con.execute(spelling.SQL).fetchall()) == set(got)


def test_long_words_and_anagrams(spark):
    r = random.Random(4)
    long = "".join(r.choice("abcdefgh") for _ in range(4000))
    letters = list("abcdefg")
    words = {long, long[:1999] + long[2000:], long[:50] + "z" + long[51:]}
    for _ in range(600):  # one key, no two near
        r.shuffle(letters)
        words.add("".join(letters))
    counts = spark.createDataFrame([(w, 5) for w in words] + [("abcdef", 30), ("abcdefgx", 5)], "word string, n long")
    got = {x.word: x for x in spelling.variants_of(counts).collect()}
    assert got[long].n_near == 2
    every = {*words, "abcdef", "abcdefgx"}
    by_word = defaultdict(int)
    short = [w for w in every if len(w) < 100]
    for w in short:
        by_word[w] = sum(near(w, v) for v in short)
    assert all(got[w].n_near == by_word[w] for w in short) and got["abcdef"].n_near > 0


def test_empty(spark):
    assert spelling.variants(frame(spark, [(1, "x")]).limit(0)).count() == 0
    assert spelling.variants(frame(spark, [(1, None)])).count() == 0
