"""Runs of periodic words by a harmonic grid.

A run of period p that holds four periods has several multiples of p in it, wherever
it begins. So for every p the pairs of places jp and (j + 1)p are asked how far the
words before and behind them agree (backward and forward longest common extension);
the extensions of one pair that agrees are the whole run. There are n / p pairs for p,
n ln n in all. Extensions come from a suffix array of word numbers, one of the
reversed words, and least common prefixes between two ranks by range minimum
queries on a table of powers of two.

A pair is not asked if its words already show that no run of four periods goes
through it: the third after it must be equal as well, and words a part of a period
further. In most documents no pair is left. Documents with pairs left, with a number of their
own between them, share a suffix array up to ``ARRAY_WORDS`` words.

Texts of a batch become numbers by Arrow (split, dictionary), which holds four bytes a
word; a block has about ``BLOCK_BYTES`` of text or one text.

Defined results: null and blank texts have no words and no runs; a null id plants
nothing; repeated rows are judged one by one; very long texts are taken whole; an
empty table gives no rows; other columns of any name are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import claim, id_and_bytes, trim

#: A run is at least so long, and holds so many periods.
LEAST_LENGTH, PERIODS = 6, 4
BLOCK_BYTES = 2 << 20
ARRAY_WORDS = 1 << 18
RESULT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def suffix_ranks(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """``(suffix array, ranks, levels)`` by doubling, where only groups that are not in order are sorted again.

    Suffixes have the same number in ``levels[k]`` exactly if their first 2**k numbers are the same.
    """
    n = len(x)
    order = np.argsort(x, kind="stable")
    head = np.append(True, x[order[1:]] != x[order[:-1]])
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))  # the place of a group's first member
    levels, step = [], 1
    todo = np.flatnonzero(~(head & np.append(head[1:], True)))
    while len(todo):
        levels.append(rank.copy())
        at = order[todo]
        # No two suffixes of a group end within the step: every document ends with a number of its own.
        key = (rank[at].astype(np.int64) << 32) | rank[np.minimum(at + step, n - 1)]
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[todo] = at
        head = np.append(True, key[1:] != key[:-1])
        rank[at] = todo[np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))]
        todo = todo[~(head & np.append(head[1:], True))]
        step *= 2
    return order, rank, levels


def common_prefixes(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """How many numbers every sorted suffix shares with the one before it; the levels give the length bit by bit."""
    n = len(order)
    out = np.zeros(n, np.int32)
    a, b = order[:-1].copy(), order[1:].copy()
    for k in range(len(levels) - 1, -1, -1):
        inside = np.flatnonzero((a < n) & (b < n))
        same = inside[levels[k][a[inside]] == levels[k][b[inside]]]
        a[same] += 1 << k
        b[same] += 1 << k
    out[1:] = a - order[:-1]
    return out


class Minima:
    """Range minima: a table of powers of two over chunks, and steps within them."""

    CHUNK = 32

    def __init__(self, values: np.ndarray) -> None:
        pad = -len(values) % self.CHUNK
        self.values = np.concatenate([values, np.full(pad + self.CHUNK, np.iinfo(np.int32).max, np.int32)])
        row = self.values.reshape(-1, self.CHUNK).min(axis=1)
        self.table = [row]
        while 2 << (len(self.table) - 1) <= len(row):
            half = 1 << (len(self.table) - 1)
            last = self.table[-1]
            self.table.append(np.minimum(last[:-half], last[half:]))

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Minima of values[low:high]; no range is empty."""
        out = np.full(len(low), np.iinfo(np.int32).max, np.int32)
        first, last = -(-low // self.CHUNK), high // self.CHUNK  # whole chunks between
        for t in range(self.CHUNK):
            for at, inside in ((low + t, low + t < np.minimum(high, first * self.CHUNK)), (high - 1 - t, high - 1 - t >= np.maximum(low, last * self.CHUNK))):
                at = np.where(inside, at, low)
                out = np.minimum(out, self.values[at])
        whole = np.flatnonzero(last > first)
        if len(whole):
            f, size = first[whole], (last - first)[whole]
            k = np.frexp(size.astype(np.float64))[1] - 1
            for level in np.unique(k):
                own = k == level
                row = self.table[level]
                out[whole[own]] = np.minimum(out[whole[own]], np.minimum(row[f[own]], row[f[own] + size[own] - (1 << int(level))]))
        return out


class Extensions:
    """Longest common extensions of places of ``x``, forward from both; ``x`` ends with a number of its own."""

    def __init__(self, x: np.ndarray) -> None:
        order, self.rank, levels = suffix_ranks(x)
        self.least = Minima(common_prefixes(order, levels))

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        ra, rb = self.rank[a].astype(np.int64), self.rank[b].astype(np.int64)
        return self.least.of(np.minimum(ra, rb) + 1, np.maximum(ra, rb) + 1)


def grid_pairs(x: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """``(p, place)`` of grid pairs (place, place + p) that may lie in a run of four periods.

    Such a run holds four multiples of p. From the first of them on, three periods are
    in it, so words at the same offset in these are equal; a few offsets are looked at.
    """
    ps, places = [], []
    for p in range(1, longest // PERIODS + 1):
        g = x[::p]
        if len(g) < PERIODS:
            break
        even = g[1:] == g[:-1]
        j = np.flatnonzero(even[:-2] & even[1:-1] & even[2:])
        if len(j):
            at = j * p
            for d in {1 % p, p // 3, p // 2, p - 1}:
                w = x[at + d]
                at = at[(w == x[at + d + p]) & (w == x[at + d + 2 * p])]
            ps.append(np.full(len(at), p))
            places.append(at)
    if not ps:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(ps), np.concatenate(places)


def runs_of(x: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rows ``(start, end, period)`` of all runs in ``x``; document i ends at ``ends[i]``, the place of its own number."""
    begins = np.append(0, ends[:-1] + 1)
    sizes = ends - begins
    p, at = grid_pairs(x, int(sizes.max(initial=0)))
    if not len(p):
        return np.zeros((0, 3), np.int64)
    owner = np.searchsorted(ends, at)
    fits = (PERIODS * p <= sizes[owner]) & (sizes[owner] >= LEAST_LENGTH) & (at + p < ends[owner])
    p, at, owner = p[fits], at[fits], owner[fits]
    found = []
    asked = np.unique(owner)
    share = (np.cumsum(sizes[asked] + 1) - 1) // ARRAY_WORDS
    for k in np.unique(share):
        docs = asked[share == k]
        # The texts of these documents, one after the other, with the places they had.
        length = sizes[docs] + 1
        new = np.append(0, np.cumsum(length)[:-1])
        y = np.concatenate([x[begins[d] : ends[d] + 1] for d in docs])
        own = np.isin(owner, docs)
        shift = (begins[docs] - new)[np.searchsorted(docs, owner[own])]
        a, q = at[own] - shift, p[own]
        _, numbers = np.unique(y, return_inverse=True)
        numbers = numbers.astype(np.int32)
        ahead = Extensions(numbers).of(a, a + q)
        # Backwards, every document has its own number in front instead of behind.
        behind = np.zeros(len(a), np.int64)
        rest = np.flatnonzero(~np.isin(a, new))
        turned = np.concatenate([numbers[:-1][::-1], numbers[-1:]])
        last = len(turned) - 2
        behind[rest] = Extensions(turned).of(last - (a[rest] - 1), last - (a[rest] + q[rest] - 1))
        s, e = a - behind, a + q + ahead
        ok = e - s >= np.maximum(LEAST_LENGTH, PERIODS * q)
        found.append(np.stack([s[ok] + shift[ok], e[ok] + shift[ok], q[ok]], axis=1))
    rows = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    if len(rows):
        rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
        rows = rows[np.append(True, (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1]))]  # the least period of a run
    return rows


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """``(all words, where each text's words begin and end)``."""
    parts = pc.ascii_split_whitespace(texts.view(pa.string()))
    counts = np.asarray(pc.list_value_length(parts))
    words = parts.flatten()
    full = np.asarray(pc.binary_length(words)) > 0
    if not full.all():
        sums = np.append(0, np.cumsum(full))
        at = np.append(0, np.cumsum(counts))
        words = words.filter(pa.array(full))
        return words, sums[at]
    return words, np.append(0, np.cumsum(counts))


def planted(ids: list, begins: np.ndarray) -> np.ndarray:
    """For every place, the place of the word that stands there once periods are planted."""
    source = np.arange(begins[-1])
    for k, doc in enumerate(ids):
        n = int(begins[k + 1] - begins[k])
        if doc is None or not n:
            continue
        h = zlib.crc32(str(doc).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            source[begins[k] + a : begins[k + 1]] = begins[k] + a + np.arange(n - a) % p
    return source


def block_rows(ids: list, texts: pa.Array, plant: bool = True) -> pa.RecordBatch:
    """The result's rows for a block of texts."""
    words, begins = words_of(texts)
    source = planted(ids, begins) if plant else np.arange(begins[-1])
    numbers = np.asarray(words.dictionary_encode().indices) if len(words) else np.zeros(0, np.int32)
    sizes = np.diff(begins)
    # Every document is followed by a number that no other place has.
    ends = np.cumsum(sizes + 1) - 1
    x = np.empty(len(numbers) + len(ids), np.int64)
    inner = np.ones(len(x), bool)
    inner[ends] = False
    x[inner] = numbers[source]
    x[ends] = len(numbers) + np.arange(len(ids))
    rows = runs_of(x, ends)
    owner = np.searchsorted(ends, rows[:, 0])
    firsts = np.append(0, ends[:-1] + 1)
    gone = np.zeros(len(x) + 1, np.int64)
    np.add.at(gone, rows[:, 0] + rows[:, 2], 1)
    np.add.at(gone, rows[:, 1], -1)
    kept = (np.cumsum(gone)[:-1] == 0)[inner]
    offsets = np.append(0, np.cumsum(kept))[begins]
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), words.take(pa.array(source[kept])))
    joined = pc.binary_join(lists, " ")
    best: dict[int, tuple] = {}
    listed: dict[int, list] = {}
    for (s, e, p), d in zip(rows.tolist(), owner.tolist(), strict=True):
        s, length = s - int(firsts[d]), e - s
        listed.setdefault(d, []).append((s, length, p))
        at = best.get(d)
        # Exact: lengths over periods are compared across.
        if at is None or (c := length * at[2] - at[1] * p) > 0 or c == 0 and (s, p) < (at[0], at[2]):
            best[d] = (s, length, p)
    none = (None, None, None)
    digests = []
    for d in range(len(ids)):
        text = "".join(f"{s},{n},{p}\n" for s, n, p in sorted(listed.get(d, []), key=lambda r: (r[0], r[2])))
        digests.append(hashlib.sha256(text.encode()).hexdigest())
    top = [best.get(d, none) for d in range(len(ids))]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()),
            pa.array([len(listed.get(d, ())) for d in range(len(ids))], pa.int64()),
            *[pa.array([t[k] for t in top], pa.int64()) for k in range(3)],
            pa.array([1000 * t[1] // t[2] if t[2] else None for t in top], pa.int64()),
            pa.array(digests),
            pa.array([hashlib.sha256(v.as_buffer()).hexdigest() for v in joined]),
        ],
        names=[c.split()[0] for c in RESULT.split(", ")],
    )


def slices(batch: pa.RecordBatch, limit: int) -> Iterator[tuple[list, pa.Array]]:
    """Ids and texts of a batch, about ``limit`` bytes at a time."""
    texts = batch.column(1)
    total = np.cumsum(np.asarray(pc.binary_length(texts)))
    low = 0
    while low < len(texts):
        before = total[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(total, before + limit, side="right")))
        yield batch.column(0).slice(low, high - low).to_pylist(), texts.slice(low, high - low)
        low = high


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: bool = False) -> DataFrame:
    """Runs of every text: their number, the one with the most periods, and digests of all and of the text without repeats.

    ``plant``: periods are put into some documents first, as the registered query has it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("periodic")
        for batch in batches:
            for ids, texts in slices(batch, BLOCK_BYTES):
                yield block_rows(ids, texts, plant)
        trim()

    return id_and_bytes(docs, id_col, text_col).mapInArrow(run, RESULT)
