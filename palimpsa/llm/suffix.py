"""Removal of long byte strings that an earlier document has, by suffix arrays.

A byte goes if it lies in a WIDTH-byte string that also starts in a document with
a smaller id. The work is dealt by content, in five steps:

1. Documents are written to the shared folder in blocks; every window of WIDTH
   bytes names its anchor, the GRAM-byte string in it with the least hash. Equal
   windows have equal anchors. A block sends the distinct hashes of its anchors,
   packed by range of hash.
2. A range finds the hashes that occur more than once and answers with bits.
3. A block sends the surroundings of such anchors, the segments that hold their
   windows, once per distinct segment with the least id that has it.
4. Per range of hash, a suffix array of the segments is refined from 8-byte
   prefixes by prefix doubling within unsorted groups (Larsson-Sadakane), common
   prefixes follow in text order (Kasai), and runs of equal windows get the least
   id of any. A range with more than SHARD_BYTES has several such shards; their
   sorted windows are merged by binary search. The answer says which windows of a
   segment an earlier document has.
5. A block puts the answers together and cuts its documents.

Anchors that occur over HOT times send each window by its own hash instead, so
what surrounds a frequent passage spreads over all ranges.

Defined results: null texts are empty; null ids count as larger than all others and
take nothing from each other; rows with equal ids take nothing from each other; an
empty table gives no rows; other columns, of any name, are kept as they are.
``docs`` must give the same rows in the same order if a task is repeated, as tables
that are read from files do.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.recovery import cut, forget, remove_path, scratch_dir
from .common import claim, held_by, small_batches, trim
from .records import _make_dir, _open

WIDTH, GRAM = 50, 24
SPAN = WIDTH - GRAM + 1  # grams that start in a window
BLOCK_BYTES = 3 << 20
#: Bytes of segments in one suffix array.
SHARD_BYTES = 1 << 20
#: Bytes of text for one range of hash.
RANGE_BYTES = 4 << 20
HOT = 50_000
_SLICE = 1 << 17  # its arrays fit a core's cache
_BASE = 0x9E3779B97F4A7C15 | 1
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Anchors are least hashes, so small numbers; times an odd number they are even again.
_SPREAD = np.uint64(0xD6E8FEB86659FD93)
_LAST_ID = np.iinfo(np.int64).max


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse modulo 2**64."""
    both = []
    for b in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        both.append(np.multiply.accumulate(p))
    return both[0], both[1]


held_by("suffix", lambda: _powers.cache_clear())


def gram_hashes(data: np.ndarray, size: int = GRAM) -> np.ndarray:
    """Mixed hashes of the strings of ``size`` bytes that start at each place; the end has the top value."""
    n = len(data)
    out = np.full(n, _TOP)
    if n < size:
        return out
    power, inverse = _powers(_SLICE + 1024) if n <= _SLICE + 1024 else _powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
    h = (sums[size:] - sums[:-size]) * inverse[: n - size + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(29)
    out[: n - size + 1] = np.minimum(np.maximum(h, np.uint64(1)), _TOP - np.uint64(1))
    return out


def _sliding(a: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum or maximum of a[i : i + width]; places past the end do not count."""
    op, fill = (np.minimum, _TOP) if least else (np.maximum, np.uint64(0))
    n, have = len(a), 1
    r = np.concatenate([a, np.full(width, fill)])
    while have * 2 <= width:
        r[:-have] = op(r[:-have], r[have:])
        have *= 2
    rest = width - have
    return op(r[:n], r[rest : n + rest])


def window_anchors(
    data: np.ndarray, ends: np.ndarray, with_anchors: bool
) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray | None]]:
    """In slices: ``(first place, gram hashes, least hash of each window or 0, is an anchor)``.

    ``ends``: where each document ends; windows lie within one.
    """
    tails = np.arange(1, WIDTH)
    for lo in range(0, len(data), _SLICE):
        hi = min(len(data), lo + _SLICE)
        a, b = max(0, lo - 2 * WIDTH), min(len(data), hi + 2 * WIDTH)
        h = gram_hashes(data[a:b])
        least = _sliding(h, SPAN, True)
        near = ends[np.searchsorted(ends, a) : np.searchsorted(ends, b + WIDTH, side="right")]
        last = (near[:, None] - tails).ravel() - a
        least[last[(last >= 0) & (last < len(least))]] = 0
        anchor = None
        if with_anchors:
            # A place is an anchor if one of the windows over it has it as least.
            back = np.concatenate([np.zeros(SPAN - 1, np.uint64), least])
            anchor = (_sliding(back, SPAN, False)[: len(h)] == h) & (h != _TOP)
            anchor = anchor[lo - a : hi - a]
        yield lo, h[lo - a : hi - a], least[lo - a : hi - a], anchor


def range_of(h: np.ndarray, ranges: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)


def _pack(h: np.ndarray) -> bytes:
    """The low 40 bits of hashes; their range tells the rest apart, as it holds some 300 000."""
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unpack(data: bytes) -> np.ndarray:
    grid = np.zeros((len(data) // 5, 8), np.uint8)
    grid[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return grid.view("<u8").ravel()


def _join(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])


def distinct_anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct anchor hashes of a block and how often each occurs."""
    found = [h[anchor] * _SPREAD for _, h, _, anchor in window_anchors(data, ends, True)]
    return np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)


def segments(
    data: np.ndarray, ends: np.ndarray, ids: np.ndarray, shared: np.ndarray, hot: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(start, length, hash)`` of the segments: runs of windows with one shared anchor, hot ones single."""
    starts, lengths, keys = [], [], []
    for lo, _, least, _ in window_anchors(data, ends, False):
        spot = np.flatnonzero(least)
        if not len(spot):
            continue
        m = least[spot]
        # Windows in a row mostly have the same anchor, which is looked up once.
        change = np.append(True, m[1:] != m[:-1])
        some = m[change] * _SPREAD
        at = np.minimum(np.searchsorted(shared, some), max(len(shared) - 1, 0))
        good = shared[at] == some if len(shared) else np.zeros(len(some), bool)
        run = np.cumsum(change) - 1
        take = good[run]
        spot, m = spot[take], some[run[take]]
        if not len(spot):
            continue
        cutting = np.append(True, (np.diff(spot) != 1) | (m[1:] != m[:-1]))
        if len(hot):
            at = np.minimum(np.searchsorted(hot, m), len(hot) - 1)
            is_hot = hot[at] == m
            cutting |= is_hot
            cutting[1:] |= is_hot[:-1]
        # Periodic texts have long runs; these are cut into lengths that two bytes can tell.
        place = np.arange(len(spot))
        cutting |= (place - np.maximum.accumulate(np.where(cutting, place, 0))) % 4096 == 0
        head = np.flatnonzero(cutting)
        runs = np.diff(np.append(head, len(spot)))
        key = m[head]
        if len(hot) and is_hot.any():
            own = is_hot[head]
            key = key.copy()
            key[own] = gram_hashes_at(data, lo + spot[head][own], WIDTH)
        starts.append(lo + spot[head])
        lengths.append(runs + WIDTH - 1)
        keys.append(key)
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(lengths), np.concatenate(keys)


def gram_hashes_at(data: np.ndarray, places: np.ndarray, size: int) -> np.ndarray:
    rows = data[places[:, None] + np.arange(size)]
    power, _ = _powers(_SLICE + 1024)
    h = ((rows.astype(np.uint64) + np.uint64(1)) * power[:size]).sum(axis=1, dtype=np.uint64)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return np.minimum(np.maximum(h, np.uint64(1)), _TOP - np.uint64(1))


def first_of_each(
    data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, owner: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """For equal segments of a block: each one's leader (least owner, then first), and which are leaders."""
    order = np.lexsort((starts, owner))
    raw, seen = data.tobytes(), {}
    leader = np.empty(len(starts), np.int64)
    for i in order.tolist():
        a = int(starts[i])
        leader[i] = seen.setdefault(raw[a : a + int(lengths[i])], i)
    return leader, np.flatnonzero(leader == np.arange(len(starts)))


# ---- suffix arrays ---------------------------------------------------------


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Places of the sorted suffixes (Larsson-Sadakane)."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key = (key << np.uint64(8)) | padded[j : n + j]
    order = np.argsort(key)
    head = np.append(True, key[order][1:] != key[order][:-1])
    rank = np.zeros(n + 1, np.int64)
    rank[n] = -1
    first = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank[order] = first
    h = 8
    while True:
        alone = head & np.append(head[1:], True)
        slots = np.flatnonzero(~alone)
        if not len(slots):
            break
        part = order[slots]
        key = (rank[part] << 32) | (rank[np.minimum(part + h, n)] + 1)
        sub = np.argsort(key)
        order[slots] = part[sub]
        key = key[sub]
        new = np.append(True, key[1:] != key[:-1])
        head[slots] = new
        first = np.maximum.accumulate(np.where(new, slots, 0))
        rank[order[slots]] = first
        h *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int, lanes: int = 4096) -> np.ndarray:
    """Length of the prefix each sorted suffix shares with the one before it, up to ``most`` (Kasai).

    The text is walked in many lanes at once; in each the length falls by one at most per step.
    """
    n = len(data)
    before = np.full(n + 1, -1, np.int64)
    before[order[1:]] = order[:-1]
    step = -(-n // lanes)
    p = np.arange(0, n, step)
    end = np.minimum(p + step, n)
    length = np.zeros(len(p), np.int64)
    out = np.zeros(n, np.int16)
    text = np.concatenate([data, np.zeros(1, np.uint8)])
    live = np.arange(len(p))
    while len(live):
        pp, ll = p[live], length[live]
        q = before[pp]
        inside = (q >= 0) & (ll < most) & (np.maximum(pp, q) + ll < n)
        same = inside & (text[np.minimum(pp + ll, n)] == text[np.minimum(q + ll, n)])
        stop = ~same
        out[pp[stop]] = ll[stop]
        length[live] = np.where(same, ll + 1, np.maximum(ll - 1, 0))
        p[live] = pp + stop
        live = live[p[live] < end[live]]
    return out[order]


def shard_windows(parts: list[bytes], owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct windows of segments: ``(group of each window, segment of it, least owner per group, a place per group)``."""
    data, ends = _join(parts)
    lengths = np.diff(np.append(0, ends))
    order = suffix_array(data)
    lcp = common_prefixes(data, order, WIDTH)
    place = np.arange(len(data))
    segment = np.repeat(np.arange(len(parts)), lengths)
    window = place + WIDTH <= ends[segment]
    group = np.cumsum(np.append(True, lcp[1:] < WIDTH)) - 1
    ok = window[order]
    found, compact = np.unique(group[ok], return_inverse=True)
    least = np.full(len(found), _LAST_ID)
    np.minimum.at(least, compact, owners[segment[order[ok]]])
    some = np.zeros(len(found), np.int64)
    some[compact] = order[ok]
    of_place = np.full(len(data), -1, np.int64)
    of_place[order[ok]] = compact
    spot = np.flatnonzero(of_place >= 0)
    return of_place[spot], segment[spot], least, some


def _window_strings(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Windows as fixed strings; a last byte keeps zeros at their ends."""
    grid = np.ones((len(places), WIDTH + 1), np.uint8)
    grid[:, :WIDTH] = data[places[:, None] + np.arange(WIDTH)]
    return grid.view(f"S{WIDTH + 1}").ravel()


def earlier_windows(parts: list[bytes], owners: np.ndarray) -> list[np.ndarray]:
    """Per segment, whether each of its windows is also in a segment of a smaller owner."""
    shards, held, size = [], [], 0
    for i, p in enumerate(parts):
        held.append(i)
        size += len(p)
        if size >= SHARD_BYTES:
            shards.append(held)
            held, size = [], 0
    if held:
        shards.append(held)
    if not shards:
        return []
    built = []
    for own in shards:
        texts = [parts[i] for i in own]
        built.append((own, *shard_windows(texts, owners[own])))
    if len(built) > 1:
        # The sorted windows of one shard after the other are looked up in, then merged with, what is known.
        strings = [_window_strings(_join([parts[i] for i in own])[0], some) for own, _, _, _, some in built]
        known, least = strings[0], built[0][3]
        for s, b in zip(strings[1:], built[1:], strict=True):
            at = np.searchsorted(known, s)
            hit = known[np.minimum(at, len(known) - 1)] == s
            least[at[hit]] = np.minimum(least[at[hit]], b[3][hit])
            known, least = np.insert(known, at[~hit], s[~hit]), np.insert(least, at[~hit], b[3][~hit])
        built = [
            (own, group, segment, least[np.searchsorted(known, s)], some)
            for s, (own, group, segment, _, some) in zip(strings, built, strict=True)
        ]
    out: list[np.ndarray] = []
    for own, group, segment, smallest, _ in built:
        flags = smallest[group] < owners[own][segment]
        counts = np.bincount(segment, minlength=len(own))
        out += np.split(flags, np.cumsum(counts)[:-1])
    return out


def answer_range(lengths: np.ndarray, hashes: np.ndarray, owners: np.ndarray, data: bytes) -> list[np.ndarray]:
    """``earlier_windows`` for all segments of a range; only anchors with several distinct segments need the arrays."""
    ends = np.cumsum(lengths).tolist()
    parts = [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]
    index: dict[bytes, int] = {}
    number = np.array([index.setdefault(p, len(index)) for p in parts], np.int64)
    least = np.full(len(index), _LAST_ID)
    np.minimum.at(least, number, owners)
    anchor = np.zeros(len(index), np.uint64)
    anchor[number] = hashes
    _, inverse, counts = np.unique(anchor, return_inverse=True, return_counts=True)
    several = np.flatnonzero(counts[inverse] > 1)
    distinct = list(index)
    found = earlier_windows([distinct[i] for i in several.tolist()], least[several])
    by = dict(zip(several.tolist(), found, strict=True))
    out = []
    for p, i, d in zip(parts, number.tolist(), owners.tolist(), strict=True):
        n = len(p) - WIDTH + 1
        out.append(np.ones(n, bool) if d > least[i] else by.get(i, np.zeros(n, bool)))
    return out


# ---- distributed steps -----------------------------------------------------


def _fresh(docs: DataFrame, name: str) -> str:
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def remove_repeats(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict]:
    """``docs`` with the columns ``kept`` (binary), ``n_bytes``, ``n_removed`` and ``n_spans``.

    Returns the frame and the names those columns got. It reads files below
    ``folder``, which the caller removes when the result is stored.
    """
    small_batches(docs.sparkSession)
    names = {k: _fresh(docs, f"dedup_{k}") for k in ("id", "kept", "n_bytes", "n_removed", "n_spans")}
    rows = docs.withColumn(names["id"], F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST_ID))).withColumn(
        names["kept"], F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    )
    total = rows.agg(F.sum(F.octet_length(names["kept"]))).first()[0] or 0
    ranges = max(4, -(-total // RANGE_BYTES))
    uri = folder if "://" in folder else ("file://" + folder if folder.startswith("/") else folder.replace("file:/", "file:///", 1))

    def store(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("suffix")
        part = TaskContext.get().partitionId()
        held, size, number = [], 0, 0

        def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            name = f"block-{part:06d}-{number:06d}.arrow"
            table = pa.Table.from_batches(held)
            _write(f"{uri}/{name}", table)
            data, ends = _join(table.column(names["kept"]).to_pylist())
            hashes, counts = distinct_anchors(data, ends)
            own = range_of(hashes, ranges).astype(np.int64)
            cuts = np.searchsorted(own, np.arange(ranges + 1))
            out = [(zlib.crc32(name.encode()) % ranges, name, b"", b"")]  # a block without anchors is known as well
            for r in np.flatnonzero(np.diff(cuts)).tolist():
                a, b = cuts[r], cuts[r + 1]
                out.append((r, name, _pack(hashes[a:b]), np.minimum(counts[a:b], 65535).astype("<u2").tobytes()))
            kinds = [pa.int64(), pa.string(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)],
                names=["range", "block", "hashes", "counts"],
            )

        for batch in batches:
            column = batch.column(batch.schema.get_field_index(names["kept"]))
            lengths = np.cumsum([len(x) if x is not None else 0 for x in column.to_pylist()])
            at = 0
            while at < batch.num_rows:
                base = int(lengths[at - 1]) if at else 0
                to = int(np.searchsorted(lengths, base + BLOCK_BYTES - size)) + 1
                to = min(max(to, at + 1), batch.num_rows)
                held.append(batch.slice(at, to - at))
                size += int(lengths[to - 1]) - base
                at = to
                if size >= BLOCK_BYTES:
                    yield block(held)
                    held, size, number = [], 0, number + 1
        if held:
            yield block(held)
        trim()

    spark = docs.sparkSession
    _make_dir(uri)
    sent = rows.mapInArrow(store, "range long, block string, hashes binary, counts binary")

    def common(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        claim("suffix")
        lists = [_unpack(x) for x in group["hashes"]]
        every = np.concatenate(lists)
        counts = np.concatenate([np.frombuffer(x, "<u2") for x in group["counts"]]).astype(np.int64)
        order = np.argsort(every)
        head = np.append(True, every[order][1:] != every[order][:-1]) if len(every) else np.zeros(0, bool)
        number = np.cumsum(head) - 1
        sums = np.bincount(number, counts[order])
        total = np.empty(len(every))
        total[order] = sums[number]
        cuts = np.cumsum([len(x) for x in lists])[:-1]
        answers = [np.packbits(np.stack([t > 1, t > HOT_NOW])).tobytes() for t in np.split(total, cuts)]
        return pd.DataFrame({"block": group["block"], "range": key[0], "bits": answers})

    HOT_NOW = HOT
    asked = cut(
        sent.repartition(int(ranges), "range")
        .groupBy("range")
        .applyInPandas(common, "block string, range long, bits binary")
        .groupBy("block")
        .agg(F.collect_list(F.struct("range", "bits")).alias("answers"))
    )
    forget(spark)
    def needed(block: str, answers: list | None) -> tuple:
        table = _read(f"{uri}/{block}")
        texts = table.column(names["kept"]).to_pylist()
        data, ends = _join(texts)
        ids = table.column(names["id"]).to_numpy()
        hashes, _ = distinct_anchors(data, ends)
        own = range_of(hashes, ranges).astype(np.int64)
        cuts = np.searchsorted(own, np.arange(ranges + 1))
        shared, hot = np.zeros(len(hashes), bool), np.zeros(len(hashes), bool)
        for r, packed in answers or []:
            if not packed:
                continue
            a, b = cuts[r], cuts[r + 1]
            both = np.unpackbits(np.frombuffer(packed, np.uint8), count=2 * (b - a)).reshape(2, -1).astype(bool)
            shared[a:b], hot[a:b] = both
        starts, lengths, keys = segments(data, ends, ids, hashes[shared], hashes[hot])
        owner = ids[np.searchsorted(ends, starts, side="right")] if len(starts) else np.zeros(0, np.int64)
        leader, leaders = first_of_each(data, starts, lengths, owner)
        return table, data, ends, starts, lengths, keys, owner, leader, leaders

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("suffix")
        for batch in batches:
            for block, answers in zip(*_pairs(batch), strict=True):
                _, data, _, starts, lengths, keys, owner, _, leaders = needed(block, answers)
                own = range_of(keys[leaders], ranges).astype(np.int64)
                order = np.argsort(own, kind="stable")
                cuts = np.searchsorted(own[order], np.arange(ranges + 1))
                raw, out = data.tobytes(), []
                for r in np.flatnonzero(np.diff(cuts)).tolist():
                    mine = leaders[order[cuts[r] : cuts[r + 1]]]
                    text = b"".join([raw[a : a + n] for a, n in zip(starts[mine].tolist(), lengths[mine].tolist(), strict=True)])
                    out.append((r, block, lengths[mine].astype("<u2").tobytes(), _pack(keys[mine]), owner[mine].tobytes(), text))
                if out:
                    kinds = [pa.int64(), pa.string(), *[pa.binary()] * 4]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)],
                        names=["range", "block", "lengths", "hashes", "owners", "text"],
                    )
        trim()

    sent_segments = asked.mapInArrow(
        send, "range long, block string, lengths binary, hashes binary, owners binary, text binary"
    ).repartition(int(ranges), "range")

    def judge(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        claim("suffix")
        lengths = [np.frombuffer(x, "<u2") for x in group["lengths"]]
        flags = answer_range(
            np.concatenate(lengths).astype(np.int64),
            np.concatenate([_unpack(x) for x in group["hashes"]]),
            np.concatenate([np.frombuffer(x, np.int64) for x in group["owners"]]),
            b"".join(group["text"]),
        )
        out, at = [], 0
        for x in lengths:
            own = flags[at : at + len(x)]
            out.append(np.packbits(np.concatenate(own)).tobytes() if own else b"")
            at += len(x)
        trim()
        return pd.DataFrame({"block": group["block"], "range": key[0], "bits": out})

    judged = sent_segments.groupBy("range").applyInPandas(judge, "block string, range long, bits binary")
    plan = asked.join(
        judged.groupBy("block").agg(F.collect_list(F.struct("range", "bits")).alias("verdicts")), "block", "left"
    )

    def finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("suffix")
        for batch in batches:
            for block, answers, verdicts in zip(*_pairs(batch), _list(batch.column(2)), strict=True):
                table, data, ends, starts, lengths, keys, _, leader, leaders = needed(block, answers)
                own = range_of(keys[leaders], ranges).astype(np.int64)
                order = np.argsort(own, kind="stable")
                cuts = np.searchsorted(own[order], np.arange(ranges + 1))
                # Other rows of a leader's segment with a larger id lose all of it.
                owner_of = np.searchsorted(ends, starts, side="right")
                ids = table.column(names["id"]).to_numpy()
                windows = np.zeros(len(data) + 1, np.int64)
                lost = ids[owner_of] > ids[owner_of[leader]] if len(starts) else np.zeros(0, bool)
                np.add.at(windows, starts[lost], 1)
                np.add.at(windows, (starts + lengths - WIDTH + 1)[lost], -1)
                hit = np.cumsum(windows)[:-1] > 0
                same = np.flatnonzero(~lost)
                verdict: dict[int, np.ndarray] = {}
                for r, packed in verdicts or []:
                    mine = leaders[order[cuts[r] : cuts[r + 1]]]
                    counts = lengths[mine] - WIDTH + 1
                    flags = np.unpackbits(np.frombuffer(packed, np.uint8), count=int(counts.sum())).astype(bool)
                    ends_of = np.cumsum(counts)
                    some = np.add.reduceat(flags, ends_of - counts, dtype=np.int64) if len(mine) else np.zeros(0, int)
                    for j in np.flatnonzero(some).tolist():
                        verdict[int(mine[j])] = flags[ends_of[j] - counts[j] : ends_of[j]]
                for i in same.tolist():
                    f = verdict.get(int(leader[i]))
                    if f is not None:
                        hit[starts[i] : starts[i] + len(f)] |= f
                spans = np.zeros(len(data) + WIDTH + 1, np.int64)
                at = np.flatnonzero(hit)
                np.add.at(spans, at, 1)
                np.add.at(spans, at + WIDTH, -1)
                gone = np.cumsum(spans)[: len(data)] > 0
                yield from _cut_rows(table, data, ends, gone, names)
        trim()

    kept = [f for f in rows.schema.fields if f.name not in (names["id"], names["kept"])]
    from pyspark.sql.types import BinaryType, LongType, StructField, StructType

    schema = StructType(
        [
            *kept,
            StructField(names["kept"], BinaryType()),
            *[StructField(names[k], LongType()) for k in ("n_bytes", "n_removed", "n_spans")],
        ]
    )
    return cut(plan).mapInArrow(finish, schema), names


def _cut_rows(table: pa.Table, data: np.ndarray, ends: np.ndarray, gone: np.ndarray, names: dict) -> Iterator[pa.RecordBatch]:
    kept, removed, spans = [], [], []
    at = 0
    for end in ends.tolist():
        g = gone[at:end]
        kept.append(data[at:end][~g].tobytes())
        removed.append(int(g.sum()))
        spans.append(int(g[:1].sum() + (g[1:] & ~g[:-1]).sum()))
        at = end
    sizes = np.diff(np.append(0, ends))
    out = table.drop_columns([names["id"], names["kept"]])
    for name, column in (
        (names["kept"], pa.array(kept, pa.binary())),
        (names["n_bytes"], pa.array(sizes, pa.int64())),
        (names["n_removed"], pa.array(removed, pa.int64())),
        (names["n_spans"], pa.array(spans, pa.int64())),
    ):
        out = out.append_column(name, column)
    yield from out.combine_chunks().to_batches()


def _pairs(batch: pa.RecordBatch) -> tuple[list, list]:
    return batch.column(0).to_pylist(), _list(batch.column(1))


def _list(column: pa.Array) -> list:
    return [None if x is None else [(e["range"], e["bits"]) for e in x] for x in column.to_pylist()]


def _write(uri: str, table: pa.Table) -> None:
    """Writes a block under a name of its own, then renames it: a repeated task writes the same."""
    from pyarrow import fs

    temporary = f"{uri}.{uuid.uuid4().hex}"
    with _open(temporary, write=True) as sink:
        with pa.ipc.new_file(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_table(table)
    system, path = fs.FileSystem.from_uri(temporary)
    system.move(path, fs.FileSystem.from_uri(uri)[1])


def _read(uri: str) -> pa.Table:
    with _open(uri) as source:
        return pa.ipc.open_file(source).read_all()


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row."""
    spark = docs.sparkSession
    folder = scratch_dir(spark, "repeats")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found, c = remove_repeats(rows, folder)
    out = cut(
        found.select(
            "doc_id",
            F.col(c["n_bytes"]).alias("n_bytes"),
            F.col(c["n_removed"]).alias("n_removed"),
            F.col(c["n_spans"]).alias("n_spans"),
            F.sha2(F.col(c["kept"]), 256).alias("kept_sha256"),
        )
    )
    remove_path(spark, folder)
    return out


def without_repeats(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated strings cut out of the texts; broken characters at the cuts go."""
    found, c = remove_repeats(docs, folder, id_col, text_col)
    whole = F.col(c["n_removed"]) == 0
    text = F.col(c["kept"]).cast("string")
    # U+FFFD of the text itself is escaped by way of a noncharacter, so only broken characters become that and go.
    for a, b in (("\ufdd0", "\ufdd0a"), ("\ufffd", "\ufdd0b")):
        text = F.replace(text, F.lit(a), F.lit(b))
    text = F.replace(F.make_valid_utf8(text), F.lit("\ufffd"), F.lit(""))
    for a, b in (("\ufdd0b", "\ufffd"), ("\ufdd0a", "\ufdd0")):
        text = F.replace(text, F.lit(a), F.lit(b))
    text = F.when(whole, F.col(text_col)).otherwise(text)
    return found.withColumn(text_col, text).select(*docs.columns)
