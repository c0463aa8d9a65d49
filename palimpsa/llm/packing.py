"""Mixture-controlled packing of documents into sequences of equal length.

Deficit round-robin serves queues of sources. A source has a queue of its own if its
share of the mixture (its weight, or its bytes where no weights are given) is 1/64
or more; others share a queue, whose weight is the sum of theirs. Its documents
are taken in the order of a virtual time, a hash of the id stretched by the bytes
a source has per weight, so that every source has its part of that queue in
expectation. Sources without a weight come last, in a queue of their own.

Round-robin serves the queues: a queue's quantum per window is its target share, and what a
window rounds off is carried to the next as its deficit. With quanta kept as
whole fractions the served amount has a closed form, floor(y A / L) for the
first y of L tokens and the cumulated amounts A of the queues, so any task can
place its documents without having seen the others, and deficits carry over
windows and partitions alike. Where target weights differ from what there is, a
queue runs dry; then a new phase begins with the weights of the remaining ones.

Defined results: null texts are empty (they hold the end id alone); null sources
have no weight and share a queue; null ids come first in a queue of one source; repeated rows are packed repeatedly;
an empty table gives no pieces; other columns, of any name, are ignored. Texts of any length
are encoded whole; their tokens go to as many sequences as they need.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.recovery import cut, remove_path, scratch_dir
from .common import bases, claim, part_count, small_batches
from .tokens import encoder, tokenizer_path

LENGTH = 2048
#: Least share of the mixture for a queue of its own, so there are 64 of these at most.
OWN_QUEUE = 1 / 64
#: Up to so many rows of part offsets (some 30 bytes each) are broadcast; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Bytes of text a task encodes.
PART_BYTES = 24 << 20


@dataclass(frozen=True)
class Phase:
    """A run of windows with constant shares."""

    start: int  # tokens of all phases before
    length: int  # its tokens
    sums: tuple[int, ...]  # tokens of queues 0..q in it, cumulated
    first: tuple[int, ...]  # tokens of each queue in the phases before

    def below(self, q: int, y: int) -> int:
        """Tokens of queues before q among the first y."""
        return y * (self.sums[q - 1] if q else 0) // self.length

    def served(self, q: int, y: int) -> int:
        return y * self.sums[q] // self.length - self.below(q, y)

    def amount(self, q: int) -> int:
        return self.sums[q] - (self.sums[q - 1] if q else 0)


def phases(totals: list[int], weights: list[float] | None = None) -> list[Phase]:
    """The schedule for queues of so many tokens; the natural mixture without weights."""
    left, out, start = list(totals), [], 0
    first = [0] * len(totals)
    target = [Fraction(w).limit_denominator(10**6) for w in weights] if weights else [Fraction(t) for t in totals]
    while any(left):
        live = [q for q, n in enumerate(left) if n]
        if not any(target[q] for q in live):  # queues without a weight come last
            target = [Fraction(n) for n in left]
        served = min(Fraction(left[q]) / target[q] for q in live if target[q])
        amounts = [min(left[q], round(target[q] * served)) if left[q] else 0 for q in range(len(left))]
        sums = np.cumsum(np.array(amounts, dtype=object)).tolist()
        out.append(Phase(start, sums[-1], tuple(sums), tuple(first)))
        start += sums[-1]
        first = [a + b for a, b in zip(first, amounts, strict=True)]
        left = [a - b for a, b in zip(left, amounts, strict=True)]
    return out


def pieces(plan: list[Phase], q: int, x: int, n: int, size: int = LENGTH) -> Iterator[tuple[int, int, int, int]]:
    """``(start, length, sequence, offset)`` of n tokens at x in queue q."""
    firsts = [p.first[q] for p in plan]
    i = bisect_right(firsts, x) - 1
    done = 0
    while done < n:
        phase = plan[i]
        own, at = phase.amount(q), x + done - phase.first[q]
        if at >= own:
            i += 1
            continue
        window = (phase.start + at * phase.length // own) // size
        edge = lambda w: min(max(w * size - phase.start, 0), phase.length)
        while phase.served(q, edge(window)) > at:
            window -= 1
        while phase.served(q, edge(window + 1)) <= at:
            window += 1
        while done < n and at < own:
            lo, hi = edge(window), edge(window + 1)
            begin, end = phase.served(q, lo), phase.served(q, hi)
            if end > at:
                take = min(n - done, end - at)
                offset = max(0, phase.start - window * size) + phase.below(q, hi) - phase.below(q, lo) + at - begin
                yield done, take, window, offset
                done += take
                at += take
            window += 1


@dataclass(frozen=True)
class Queues:
    """Queue 0 is shared, then come those of ``own`` sources, and last that of sources without a weight."""

    own: list[str]
    shared: dict[str, float]  # with weights: how far a source's virtual time is stretched, at most 1
    weights: list[float] | None

    @property
    def last(self) -> int:
        return len(self.own) + 1

    def queue(self) -> Column:
        at = F.array_position(F.array(*[F.lit(s) for s in self.own]), F.col("source")) if self.own else F.lit(0)
        other = F.lit(0)
        if self.weights:
            other = F.when(F.col("source").isin(list(self.shared)), 0).otherwise(self.last) if self.shared else F.lit(self.last)
        return F.when(F.coalesce(at, F.lit(0)) > 0, at).otherwise(other).cast("int")

    def place(self) -> Column:
        """Order within a queue."""
        mixed = F.shiftrightunsigned(F.xxhash64("doc_id"), 11)  # 53 bits
        if self.shared:
            stretch = F.create_map(*[F.lit(x) for pair in self.shared.items() for x in pair])
            mixed = F.floor(mixed * F.coalesce(stretch[F.col("source")], F.lit(1.0)))
        return F.when(F.col("queue").between(1, len(self.own)), F.col("doc_id")).otherwise(mixed)


def _queues(rows: DataFrame, weights: dict[str, float] | None) -> tuple[Queues, int]:
    """The queues of the sources, and the bytes of all."""
    sums = cut(rows.groupBy("source").agg(F.sum(F.octet_length("text") + 1).alias("n")))
    total = sums.agg(F.sum("n")).first()[0] or 0
    if weights is None:
        kept = sums.filter(F.col("source").isNotNull() & (F.col("n") >= F.lit(OWN_QUEUE * total)))
        return Queues(sorted(r["source"] for r in kept.select("source").collect()), {}, None), total
    asked = [s for s, w in weights.items() if w > 0]
    have = {r["source"]: r["n"] for r in sums.filter(F.col("source").isin(asked)).collect()}
    every = sum(weights[s] for s in have)
    own = sorted(s for s in have if weights[s] >= OWN_QUEUE * every)
    slow = {s: n / weights[s] for s, n in have.items() if s not in own}
    shared = {s: x / max(slow.values()) for s, x in slow.items()}
    return Queues(own, shared, [sum(weights[s] for s in shared), *(weights[s] for s in own), 0]), total


def _plan(amounts: list[int], weights: list[float] | None, size: int) -> tuple[list[Phase], list[tuple[int, int]]]:
    """The schedule, and for each queue the one of the schedule that it is part of and where it begins there.

    A queue with under two tokens to a window joins queue 0, behind what that holds:
    shares are rounded one after the other, which needs a token a window but for the first and the last queue.
    """
    share = lambda q: (weights[q] / (sum(weights) or 1)) if weights else amounts[q] / (sum(amounts) or 1)
    merged, at = list(amounts), [(q, 0) for q in range(len(amounts))]
    for q in range(1, len(amounts) - 1):
        if share(q) * size < 2:
            at[q], merged[0], merged[q] = (0, merged[0]), merged[0] + merged[q], 0
    return phases(merged, weights), at


def pack(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    end_id: int,
    weights: dict[str, float] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    size: int = LENGTH,
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece: ``doc_id, source, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids``.

    ``weights`` gives target shares by source; sources without one come last, and
    where a source runs dry the others of its queue, then the other queues, take its part. The
    result reads the encoded table below ``folder``, which the caller removes.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"),
    )
    queues, size_all = _queues(rows, weights)
    ordered = rows.withColumn("queue", queues.queue()).withColumn("place", queues.place())
    ordered = ordered.repartitionByRange(
        part_count(size_all, PART_BYTES), "queue", "place", F.xxhash64("text")
    ).sortWithinPartitions("queue", "place", "doc_id", "text")
    schema = "part int, queue int, at long, n long, doc_id long, source string, ids binary"

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("tokens")
        enc = encoder(tokenizer, True)
        end, part = np.array([end_id], enc.dtype), TaskContext.get().partitionId()
        sofar: dict[int, int] = {}

        def coded(rows: list) -> pa.RecordBatch:
            ids = [np.concatenate([x, end]) for x in enc.encode([r[2] for r in rows])]
            starts = []
            for r, x in zip(rows, ids, strict=True):
                starts.append(sofar.get(r[3], 0))
                sofar[r[3]] = starts[-1] + len(x)
            columns = [[part] * len(rows), [r[3] for r in rows], starts, [len(x) for x in ids], [r[0] for r in rows], [r[1] for r in rows], [x.tobytes() for x in ids]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["part", "queue", "at", "n", "doc_id", "source", "ids"])

        held, weight = [], 0
        for batch in batches:
            for r in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                held.append(r)
                weight += len(r[2])
                if weight >= 4 << 20:
                    yield coded(held)
                    held, weight = [], 0
        if held:
            yield coded(held)

    path = f"{folder}/encoded"
    ordered.select("doc_id", "source", "text", "queue").mapInArrow(encode, schema).write.parquet(path)
    table = spark.read.schema(schema).parquet(path)
    totals = cut(table.groupBy("part", "queue").agg(F.sum("n").alias("n")))
    amounts = {r["queue"]: r["n"] for r in totals.groupBy("queue").agg(F.sum("n").alias("n")).collect()}
    plan, begins = _plan([amounts.get(q, 0) for q in range(queues.last + 1)], queues.weights, size)
    offsets = bases(totals, ["queue"]).select("part", "queue", "base")
    # The rows are ordered by queue, so there is one row per part and one more per queue.
    if totals.count() <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    width = encoder(tokenizer, True).dtype

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc_id, source, q, x, n, data in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                ids = np.frombuffer(data, width).astype("<u4")
                own, begin = begins[q]
                for start, length, sequence, offset in pieces(plan, own, x + begin, n, size):
                    part = ids[start : start + length]
                    out.append((doc_id, source, start, length, zlib.crc32(part), n, sequence, offset, part.tobytes() if with_ids else None))
                if len(out) >= 20_000:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)

    placed = table.join(offsets, ["part", "queue"]).select(
        "doc_id", "source", "queue", (F.col("at") + F.col("base")).alias("x"), "n", "ids"
    )
    return placed.mapInArrow(
        place,
        "doc_id long, source string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary",
    )


_NAMES = ["doc_id", "source", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), *[pa.int64()] * 6, pa.binary()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=_NAMES
    )


def packed(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, **columns: str) -> DataFrame:
    """Pieces without their ids, kept in the shared folder when the encoded table has gone."""
    folder = scratch_dir(docs.sparkSession, "packing")
    out = cut(pack(docs, folder, tokenizer_path(tokenizer), end_id, with_ids=False, **columns).drop("ids"))
    remove_path(docs.sparkSession, folder)
    return out


def sequences(found: DataFrame, pad_id: int, size: int = LENGTH) -> DataFrame:
    """``sequence_id, tokens array<int>`` of ``size`` ids from the result of ``pack``."""

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for parts in batch.column(1).to_pylist():
                ids = np.frombuffer(b"".join(p["ids"] for p in parts), "<u4")
                rows.append(np.pad(ids, (0, size - len(ids)), constant_values=pad_id).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(rows, pa.list_(pa.int32()))], names=["sequence_id", "tokens"]
            )

    grouped = found.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return grouped.mapInArrow(join, "sequence_id long, tokens array<int>")
