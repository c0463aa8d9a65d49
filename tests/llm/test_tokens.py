import base64
import hashlib
import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from palimpsa.llm import bpe, records, tokens
from palimpsa.llm.queries import op2_records, op4_bpe

ODD = st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \t\n\r\0#.'s'llAéß́\x1c\x85 　")), max_size=60)


def whole(name, special_as_text=False):
    t = Tokenizer.from_file(tokens.tokenizer_path(name))
    t.encode_special_tokens = special_as_text
    return t


@pytest.mark.parametrize("as_text", [False, True])
@pytest.mark.parametrize(("name", "dropped"), [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_pieces_give_the_ids_of_the_whole(name, dropped, as_text):
    t, enc = whole(name, as_text), tokens.PieceEncoder(tokens.tokenizer_path(name), dropped, as_text)
    special = st.sampled_from(["<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", " ", ". ", "words", "Ñandú", "ὈΔΟΣ", "страна", "中文"])

    @settings(max_examples=400, deadline=None)
    @given(st.one_of(ODD, st.lists(special, max_size=12).map("".join)))
    def check(text):
        assert enc.encode([text.encode()])[0].tolist() == t.encode(text, add_special_tokens=False).ids

    check()
    for r in pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist():
        assert enc.encode([r["text"].encode()])[0].tolist() == t.encode(r["text"], add_special_tokens=False).ids


@pytest.mark.parametrize(("name", "dropped"), [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_words_of_letters_and_both_halves_of_the_cache(name, dropped, monkeypatch):
    monkeypatch.setattr(tokens.PieceEncoder, "CACHE", 50)
    t, enc, rng = whole(name), tokens.PieceEncoder(tokens.tokenizer_path(name), dropped), random.Random(5)
    letters = [chr(c) for a, b in ((65, 91), (97, 123), (0xC0, 0xD7), (0xD8, 0xF7), (0xF8, 0x100), (0x391, 0x3A2), (0x3A3, 0x3AA), (0x3B1, 0x3CA), (0x400, 0x460), (0x4E00, 0x4E20), (0xAC00, 0xAC20)) for c in range(a, b)]
    texts = [" ".join("".join(rng.choices(letters if rng.random() < 0.5 else letters[:52], k=rng.randrange(1, 9))) for _ in range(30)) for _ in range(60)]
    for _ in range(2):
        for lo in range(0, 60, 7):
            part = texts[lo : lo + 7]
            assert [x.tolist() for x in enc.encode([x.encode() for x in part])] == [t.encode(x, add_special_tokens=False).ids for x in part]


def test_replay_equals_the_library():
    path = tokens.tokenizer_path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    lib = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = bpe.replayer(path)

    @settings(max_examples=400, deadline=None)
    @given(ODD)
    def check(text):
        ids = own.encode([text.encode()])[0]
        assert ids.tolist() == lib.encode_ordinary(text) and own.decode(ids) == text.encode()

    check()
    rng = random.Random(3)
    words = ["".join(rng.choice("abeinrst") for _ in range(rng.randrange(1, 40))) for _ in range(500)] + ["a" * 300]
    words += ['', 'abab' * 20, 'eses' * 9, '']
    assert [np.frombuffer(x, '<u4').tolist() for x in own.replay([w.encode() for w in words])] == [lib.encode_ordinary(w) for w in words]


def test_bpe_query(spark):
    path = tokens.tokenizer_path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    lib = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    expected = set()
    for r in rows:
        ids = lib.encode_ordinary(r["text"])
        expected.add((r["doc_id"], len(ids), sha(",".join(map(str, ids)).encode()), sha(r["text"].encode())))
    assert {tuple(r) for r in op4_bpe(spark, "/root/testdata/sf0.001").collect()} == expected
    odd = spark.createDataFrame([(1, None, 1), (1, None, 1), (None, "", 2)], "doc_id long, text string, n_tokens int")
    assert sorted(r.n_tokens for r in bpe.encode_and_decode(odd).collect()) == [0, 0, 0]
    assert bpe.digests(odd.limit(0)).count() == 0


def test_very_long_texts_are_encoded_whole(spark):
    """A text of many blocks, without and with places to cut, by both encoders."""
    rng = random.Random(9)
    text = " ".join("".join(rng.choices("abcdeéß.", k=rng.randrange(1, 9))) for _ in range(400_000))
    path = tokens.tokenizer_path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    lib = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = spark.createDataFrame([(1, text), (2, "word\0" * 5000), (3, "x " * 3)], "doc_id long, text string")
    for r in bpe.digests(docs).collect():
        t = {1: text, 2: "word\0" * 5000, 3: "x " * 3}[r.doc_id]
        ids = lib.encode_ordinary(t)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    ids = whole("byte_bpe_50k.json").encode(text, add_special_tokens=False).ids
    (found,) = [r for r in records.round_trip(docs).collect() if r.doc_id == 1]
    assert (found.n_tokens, found.ids_crc32) == (len(ids) + 1, zlib.crc32(np.array([*ids, 0], "<u4").tobytes()))


def test_checksums():
    assert records.crc32c([b"123456789", b"", b"a"]).tolist() == [0xE3069283, 0, 0xC1D04330]
    rng = np.random.default_rng(1)
    parts = [rng.bytes(int(n)) for n in rng.integers(0, 5000, 50)]

    def slow(data):
        c = 0xFFFFFFFF
        for b in data:
            c = (c >> 8) ^ int(records._T0[(c ^ b) & 255])
        return c ^ 0xFFFFFFFF

    assert records.crc32c(parts).tolist() == [slow(p) for p in parts]
    framed = b"".join(records.frame(parts))
    assert records.unframe(framed) == (parts, len(framed))
    broken = bytearray(framed)
    broken[len(framed) // 2] ^= 1
    with pytest.raises(ValueError):
        records.unframe(bytes(broken))


def test_records_query(spark):
    t = whole("byte_bpe_50k.json")
    rows = sorted(pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist(), key=lambda r: r["doc_id"])
    expected, start = [], 0
    for r in rows:
        ids = [*t.encode(r["text"], add_special_tokens=False).ids, 0]
        expected.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, op2_records(spark, "/root/testdata/sf0.001").collect())) == expected


def test_records_odd_rows_and_random_access(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(records, "FILE_BYTES", 40)
    texts = [(3, "some words here"), (1, None), (2, ""), (None, "x"), (1, None), (7, "long " * 500)]
    docs = spark.createDataFrame([(i, t, "y") for i, t in texts], "doc_id long, text string, file string")
    path = f"file://{tmp_path}/r"
    index = records.write_records(docs, path, tokens.tokenizer_path("byte_bpe_50k.json"), 0).collect()
    found = sorted(records.read_records(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == [None, 1, 1, 2, 3, 7] and [r.n_tokens for r in found][1:4] == [1, 1, 1]
    for r in index:
        doc_id, ids = records.read_at(path, r.file, r.offset, r.length)
        assert (doc_id, len(ids)) == (r.doc_id, r.n_tokens)
    assert records.round_trip(docs.limit(0)).count() == 0
