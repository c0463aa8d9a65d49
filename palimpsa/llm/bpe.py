"""Byte-level BPE by replaying the merges over all distinct words of a block.

All words of a block lie in one array of tokens with links to their neighbours.
An inverted index leads from a rank to the positions of the pairs that it
merges; ranks are taken in order and a merge updates only the two pairs it touches.

Defined results: null texts are empty and have no ids; bytes that are not UTF-8
are read as U+FFFD; texts of any length are encoded whole, in one block if they
are longer than a block; repeated rows, null ids and empty tables pass through; other
columns, of any name, are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from public_tokenizers import PATTERN
from pyspark.sql import DataFrame

from .common import blocks, claim, held_by, id_and_bytes
from .tokens import spaced_cuts, tokenizer_path

#: Bytes of text whose distinct words are merged together.
BLOCK_BYTES = 12 << 20
#: White space of the pattern is the Unicode property, as in the tokenizer's own regular expressions.
_SPACE = r"\p{White_Space}"


class MergeReplay:
    """Encoder and decoder for a table of ranked byte strings."""

    #: Distinct pieces whose ids are held at most.
    CACHE = 400_000

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        import regex

        self.ranks = ranks
        self.bytes_of = dict(zip(ranks.values(), ranks.keys(), strict=True))
        self.texts_of = {r: str(r) for r in self.bytes_of}
        spaced = pattern.replace(r"[^\s", f"[^{_SPACE}").replace(r"\S", rf"[^{_SPACE}]").replace(r"\s", _SPACE)
        self.words = regex.compile(spaced, regex.V1).findall
        self.cache: dict[bytes, bytes] = {}
        # All pairs of tokens that join to a token, as sorted keys.
        joined = sorted(
            (a << 32 | b, r)
            for whole, r in ranks.items()
            for k in range(1, len(whole))
            if (a := ranks.get(whole[:k])) is not None and (b := ranks.get(whole[k:])) is not None
        )
        self.keys = np.array([k for k, _ in joined], np.int64)
        self.joins = np.array([r for _, r in joined], np.int64)
        self.first_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the merges of token pairs, -1 where there is none."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.joins[at], -1)

    def replay(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word (packed, 32 bits), merged lowest rank first and leftmost first.

        All places of a rank are merged at once. Where a merge opens a pair of no
        higher rank within a word that has further places, those wait for it.
        """
        sizes = np.array([len(w) for w in words], np.int64)
        tokens = self.first_ids[np.frombuffer(b"".join(words), np.uint8)]
        n = len(tokens)
        starts = np.cumsum(sizes) - sizes
        word = np.repeat(np.arange(len(words)), sizes)
        # One slot past the end stands for no neighbour.
        tokens = np.append(tokens, -1)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        full = sizes > 0
        after[(starts + sizes - 1)[full]] = n
        before[starts[full]] = n
        after[n] = before[n] = n
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(places: np.ndarray, ranks: np.ndarray) -> None:
            if not len(places):
                return
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            heads = [0, *cuts.tolist()]
            for r, part in zip(ranks[heads].tolist(), np.split(places, cuts) if len(cuts) else [places], strict=True):
                if (held := index.get(r)) is None:
                    index[r] = [part]
                    heappush(heap, r)
                else:
                    held.append(part)

        left = np.flatnonzero(after[:n] < n)
        found = self._ranks(tokens[left], tokens[after[left]])
        enter(left[found >= 0], found[found >= 0])
        while heap:
            r = heappop(heap)
            parts = index.pop(r, None)
            if parts is None:
                continue
            i = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
            j = after[i]
            good = (tokens[i] >= 0) & (j < n)
            i, j = i[good], j[good]
            good = self._ranks(tokens[i], tokens[j]) == r
            i, j = i[good], j[good]
            if not len(i):
                continue
            if len(i) > 1:
                # Places that share a token: every second of such a run is taken.
                new_run = np.append(True, j[:-1] != i[1:])
                if not new_run.all():
                    place = np.arange(len(i))
                    take = (place - np.maximum.accumulate(np.where(new_run, place, 0))) % 2 == 0
                    i, j = i[take], j[take]
            one = np.full(len(i), r)
            right, prev = after[j], before[i]
            open_r = np.where(right < n, self._ranks(one, tokens[right]), -1)
            open_l = np.where(prev < n, self._ranks(tokens[prev], one), -1)
            same = word[i[1:]] == word[i[:-1]] if len(i) > 1 else np.zeros(0, bool)
            if same.any():
                low = ((open_r >= 0) & (open_r <= r)) | ((open_l >= 0) & (open_l <= r))
                twin = int(self._ranks(one[:1], one[:1])[0])
                bad = np.isin(word[i], word[i][low]) if not 0 <= twin <= r else np.ones(len(i), bool)
                later = np.append(False, same) & bad
                if later.any():
                    enter(i[later], one[later])
                    i, j, right, one = i[~later], j[~later], right[~later], one[~later]
            tokens[i], tokens[j] = r, -1
            after[i] = right
            inner = right < n
            before[right[inner]] = i[inner]
            prev = before[i]
            # Neighbours may have merged too, so the pairs are read anew.
            right = after[i]
            open_r = np.where(right < n, self._ranks(one, tokens[right]), -1)
            open_l = np.where(prev < n, self._ranks(tokens[prev], one), -1)
            on_r, on_l = open_r >= 0, open_l >= 0
            enter(np.concatenate([i[on_r], prev[on_l]]), np.concatenate([open_r[on_r], open_l[on_l]]))
        kept = tokens[:n] >= 0
        counts = np.add.reduceat(np.append(kept, False), np.minimum(starts, n), dtype=np.int64) if len(words) else np.zeros(0, int)
        counts = np.where(full, counts, 0)
        data, ends = tokens[:n][kept].astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _learn(self, new: set[bytes]) -> None:
        split = [(p, self.words(p.decode("utf-8", "replace"))) for p in new]
        words = list({w for _, ws in split for w in ws})
        ids = dict(zip(words, self.replay([w.encode() for w in words]), strict=True))
        for p, ws in split:
            self.cache[p] = ids[ws[0]] if len(ws) == 1 else b"".join([ids[w] for w in ws])

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text."""
        split = [[t] if b"\0" in t else spaced_cuts(t).split(b"\0") for t in texts]
        every = set().union(*split)
        known = self.cache
        new = every.difference(known)
        if len(known) + len(new) > self.CACHE:  # what these texts use stays, which holds the frequent pieces
            known = self.cache = {p: known[p] for p in every.difference(new)}
        self._learn(new)
        return [np.frombuffer(b"".join(map(known.__getitem__, pieces)), "<u4") for pieces in split]

    def decimals(self, ids: np.ndarray) -> str:
        return ",".join(map(self.texts_of.__getitem__, ids.tolist()))

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as source:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, source) if a}


@lru_cache(maxsize=2)
def replayer(path: str) -> MergeReplay:
    return MergeReplay(read_ranks(path))


held_by("bpe", replayer.cache_clear)


def encode_and_decode(
    docs: DataFrame, ranks: str = "byte_bpe_multi_50k.tiktoken", id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_tokens, ids array<int>, decoded binary`` of whole texts."""
    return _mapped(docs, ranks, id_col, text_col, digests=False)


def digests(docs: DataFrame, ranks: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of whole texts."""
    return _mapped(docs, ranks, "doc_id", "text", digests=True)


def _mapped(docs: DataFrame, ranks: str, id_col: str, text_col: str, digests: bool) -> DataFrame:
    path = tokenizer_path(ranks)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("bpe")
        bpe = replayer(path)
        for ids, texts in blocks(batches, BLOCK_BYTES):
            coded = bpe.encode(texts)
            decoded = [bpe.decode(x) for x in coded]
            columns = [pa.array(ids, pa.int64()), pa.array([len(x) for x in coded], pa.int64())]
            if digests:
                columns += [
                    pa.array([hashlib.sha256(bpe.decimals(x).encode()).hexdigest() for x in coded]),
                    pa.array([hashlib.sha256(x).hexdigest() for x in decoded]),
                ]
            else:
                columns += [
                    pa.array([x.astype(np.int32) for x in coded], pa.list_(pa.int32())),
                    pa.array(decoded, pa.binary()),
                ]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["doc_id", "n_tokens", *(["ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"])]
    kinds = ["long", "long", *(["string", "string"] if digests else ["array<int>", "binary"])]
    schema = ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True))
    return id_and_bytes(docs, id_col, text_col).mapInArrow(run, schema)
