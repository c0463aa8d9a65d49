"""SimHash near-duplicate detection.

Documents become fingerprints of 64 bits or more; fingerprints that share a
block of bits meet in a bucket, and members of a bucket are linked after their
Hamming distance is verified. Two block layouts exist:

* ``pigeonhole_keys``: six blocks, every three of them form a key. Up to three
  differing bits leave at least three blocks alike, so no link is lost.
* ``band_keys``: bands of a wide fingerprint, for similarities whose distance is
  too large for an exact layout.

Defined results: a null or empty text, or one without words, has fingerprint
zero and is linked like any other. Rows with a null id get a fingerprint and
the component of equal fingerprints but never name a component. Repeated rows
are kept. An empty table gives an empty result. Other columns, of any name, are
ignored. All shingles of a text of any length count; a task holds one text's hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..operators.recovery import cut
from .common import blocks, claim, id_and_bytes, trim

#: Buckets above this size are split again before any task holds them.
BUCKET_LIMIT = 4096
#: Up to so many large buckets are broadcast (20 bytes each).
LARGE_BUCKETS = 10_000
_STEP = 0x9E3779B97F4A7C15


def _mixed(h: np.ndarray, j: int) -> np.ndarray:
    """The j-th 64-bit hash that follows from one hash (0: itself)."""
    if not j:
        return h
    z = h + np.uint64((j * _STEP) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 (seed 42) of all word shingles, with lower-cased A-Z."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = partial(xxhash.xxh64_intdigest, seed=42)
    if len(words) < size:
        return np.array([digest(b" ".join(words))], np.uint64)
    grams = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    return np.fromiter(map(digest, grams), np.uint64, len(words) - size + 1)


def fingerprint_block(texts: list[bytes], size: int, words: int) -> np.ndarray:
    """Fingerprints of texts: one row of ``words`` unsigned 64-bit numbers each."""
    hashes = [shingle_hashes(t, size) for t in texts]
    counts = np.array([len(h) for h in hashes])
    out = np.zeros((len(texts), words), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    flat = np.concatenate(hashes)
    # Bits are counted in byte lanes: 255 rows at most fit a lane.
    starts = np.concatenate(([0], np.cumsum(counts[full])))
    cuts = np.concatenate([np.arange(a, b, 255) for a, b in zip(starts[:-1], starts[1:], strict=True)])
    first = np.searchsorted(cuts, starts[:-1])
    for j in range(words):
        parts = []
        for lo in range(0, len(cuts), 4096):  # bounds the unpacked bits
            own = cuts[lo : lo + 4096]
            end = cuts[lo + 4096] if lo + 4096 < len(cuts) else len(flat)
            bits = np.unpackbits(_mixed(flat[own[0] : end], j).view(np.uint8), bitorder="little")
            parts.append(np.add.reduceat(bits.view(np.uint64).reshape(-1, 8), own - own[0], axis=0))
        lanes = np.concatenate(parts).view(np.uint8)
        ones = np.add.reduceat(lanes, first, axis=0, dtype=np.int64)
        over = ones * 2 > counts[full][:, None]
        out[full, j] = np.packbits(over, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, words: int = 1
) -> DataFrame:
    """``(doc_id, fp array<bigint>, text_hash bigint)`` over whole texts; the hash is Spark's xxhash64."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("simhash")
        for ids, texts in blocks(batches):
            fps = fingerprint_block(texts, shingle, words).view(np.int64)
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(0, fps.size + 1, words), pa.int32()), pa.array(fps.ravel())
            )
            hashes = np.array([xxhash.xxh64_intdigest(t, 42) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), lists, pa.array(hashes)], names=["doc_id", "fp", "text_hash"])
        trim()

    return id_and_bytes(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp array<bigint>, text_hash long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _ranges(low: int, high: int, parts: int) -> list[tuple[int, int]]:
    edges = [low + (high - low) * i // parts for i in range(parts + 1)]
    return list(zip(edges[:-1], edges[1:], strict=True))


def _mask(ranges: list[tuple[int, int]]) -> int:
    return sum(((1 << (b - a)) - 1) << a for a, b in ranges)


def pigeonhole_masks(distance: int) -> list[int]:
    """Masks of which one at least hides all of ``distance`` differing bits."""
    own = _ranges(0, 64, 2 * distance or 1)
    return [_mask(list(c)) for c in combinations(own, max(1, len(own) - distance))]


def second_masks(first: int, distance: int, parts: int = 7) -> list[int]:
    """Masks over the bits outside ``first``, hiding ``distance`` of ``parts`` blocks."""
    free = [i for i in range(64) if not first >> i & 1]
    own = [free[a:b] for a, b in _ranges(0, len(free), parts)]
    return [first | sum(1 << i for block in c for i in block) for c in combinations(own, parts - distance)]


def _keys(masks: list[int]) -> F.Column:
    return F.array(
        *[
            F.struct(F.lit(i).alias("t"), F.col("fp")[0].bitwiseAND(F.lit(_signed(m))).alias("k"))
            for i, m in enumerate(masks)
        ]
    )


def link_bucket(fps: np.ndarray, nodes: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the bucket's links, found breadth first.

    Every pair within the distance ends up in one tree, and no more than one
    link per member is returned. Half of the words are compared first: a pair
    that differs in more bits there already can not be within the distance.
    """
    half = np.ascontiguousarray(fps[:, : max(1, fps.shape[1] // 2)])
    rest = np.arange(len(nodes))
    out = []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = np.bitwise_count(half[rest] ^ half[at]).sum(axis=1) <= distance
            if near.any() and half.shape[1] < fps.shape[1]:
                near[near] = np.bitwise_count(fps[rest[near]] ^ fps[at]).sum(axis=1) <= distance
            if near.any():
                found = rest[near]
                out += [(int(nodes[at]), int(x)) for x in nodes[found]]
                queue += found.tolist()
                rest = rest[~near]
    return out


def _linker(distance: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("simhash")
        for batch in batches:
            out = []
            for bucket in batch.column(0):
                flat = bucket.values.flatten() if len(bucket) else []
                nodes = flat[0].to_numpy(zero_copy_only=False)
                fps = flat[1].flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, words)
                out += link_bucket(fps, nodes, distance)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"]
            )

    return run


def _links_of(groups: DataFrame, distance: int, words: int, keys: list[str]) -> DataFrame:
    return (
        groups.groupBy(*keys)
        .agg(F.collect_list(F.struct("node", "fp")).alias("members"))
        .filter(F.size("members") > 1)
        .select("members")
        .mapInArrow(_linker(distance, words), "a long, b long")
    )


def exact_links(nodes: DataFrame, distance: int = 3) -> DataFrame:
    """Links ``(a, b)`` that connect all 64-bit fingerprints within ``distance``.

    ``nodes``: ``(node, fp array<bigint>)``, one row per distinct fingerprint.
    A bucket over BUCKET_LIMIT is dealt again by blocks of its remaining bits,
    which leaves at most 15 bits free, so no task holds more than 2**15 of them.
    """
    masks = pigeonhole_masks(distance)
    rows = nodes.select("node", "fp", F.explode(_keys(masks)).alias("key")).select("node", "fp", "key.t", "key.k")
    rows = cut(rows.join(rows.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), ["t", "k"]))
    small = _links_of(rows.filter(F.col("n") <= BUCKET_LIMIT), distance, 1, ["t", "k"])
    finer = F.array(*[F.array(*[F.lit(_signed(x)) for x in second_masks(m, distance)]) for m in masks])
    again = F.transform(
        F.element_at(finer, F.col("t") + 1), lambda m, i: F.struct(i.alias("t"), F.col("fp")[0].bitwiseAND(m).alias("k"))
    )
    large = rows.filter(F.col("n") > BUCKET_LIMIT)
    large = large.select("node", "fp", "t", "k", F.explode(again).alias("key"))
    large = large.select("node", "fp", "t", "k", F.col("key.t").alias("t2"), F.col("key.k").alias("k2"))
    return small.union(_links_of(large, distance, 1, ["t", "k", "t2", "k2"])).distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 3
) -> DataFrame:
    """``(doc_id, fp bigint, component_id)``: 64-bit fingerprints linked exactly."""
    fps = cut(fingerprints(docs, id_col, text_col, shingle, 1).select("doc_id", F.col("fp")[0].alias("fp")))
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("node"))
    linked = connected_components(
        exact_links(nodes.filter("node is not null").select("node", F.array("fp").alias("fp")), distance), "a", "b"
    )
    named = nodes.join(linked, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def band_links(nodes: DataFrame, words: int, distance: int) -> DataFrame:
    """Links ``(a, b)`` that connect all wide fingerprints that share a 16-bit band and are within ``distance``.

    Rows carry the whole fingerprint, so buckets are answered by the final test,
    and are shuffled once: only large buckets are counted out beforehand.
    """
    bands = F.array(
        *[
            F.struct(
                F.lit(4 * j + i).alias("t"),
                F.shiftrightunsigned(F.col("fp")[j], 16 * i).bitwiseAND(F.lit(65535)).alias("k"),
            )
            for j in range(words)
            for i in range(4)
        ]
    )
    rows = nodes.select("node", "fp", F.explode(bands).alias("key")).select("node", "fp", "key.t", "key.k")
    sizes = nodes.select(F.explode(bands).alias("key")).groupBy("key.t", "key.k").agg(F.count(F.lit(1)).alias("n"))
    # A large bucket is cut into g chunks; every pair of chunks is a tile of its own.
    large = cut(sizes.filter(F.col("n") > BUCKET_LIMIT).select("t", "k", F.ceil(F.col("n") / BUCKET_LIMIT).alias("g")))
    if large.count() <= LARGE_BUCKETS:
        large = F.broadcast(large)
    chunk = F.pmod(F.xxhash64("node"), F.col("g"))
    tiles = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("g") - 1), lambda o: F.least(chunk, o) * F.col("g") + F.greatest(chunk, o)
    )
    none = F.array(F.lit(0).cast("long"))
    dealt = rows.join(large, ["t", "k"], "left").select(
        "node", "fp", "t", "k", F.explode(F.when(F.col("g").isNull(), none).otherwise(tiles)).alias("tile")
    )
    return _links_of(dealt, distance, words, ["t", "k", "tile"])


def angular_distance(similarity: float, bits: int) -> int:
    """Differing bits of two sets with a Jaccard similarity: what is expected and a standard deviation."""
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(np.ceil(share * bits + (bits * share * (1 - share)) ** 0.5))


def near_duplicates_wide(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    similarity: float = 0.8,
    words: int = 12,
) -> DataFrame:
    """``(doc_id, text_hash, component_id, first)`` of documents whose shingle similarity is high.

    ``component_id`` is the smallest id of the group, and ``first`` is true for the
    row that it stands for: the one with that id, of several texts with that id the
    one with the smallest hash. Null ids come last. Texts that share an id are told
    from each other.

    Up to 0.8 similarity about 15 % of the bits differ, too many for an exact
    layout; 48 bands of 16 bits find 97 % of such pairs and more of closer ones.
    """
    bits = 64 * words
    fps = cut(fingerprints(docs, id_col, text_col, shingle, words))
    own = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_hash")
    nodes = cut(fps.groupBy("fp").agg(F.min(own).alias("least")))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()))  # numbers are kept, not made again
    linked = connected_components(band_links(nodes.select("node", "fp"), words, angular_distance(similarity, bits)), "a", "b")
    named = nodes.join(linked, "node", "left").select("fp", "least", F.coalesce("component", "node").alias("c"))
    leasts = named.groupBy("c").agg(F.min("least").alias("kept"))
    named = named.join(leasts, "c").select("fp", "kept")
    return fps.join(named, "fp").select(
        "doc_id", "text_hash", F.col("kept.doc_id").alias("component_id"), own.eqNullSafe(F.col("kept")).alias("first")
    )
