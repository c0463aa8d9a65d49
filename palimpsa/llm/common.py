"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: ASCII white space that separates words: space and 0x09 to 0x0D.
SPACE_CLASS = "[\\x20\\x09-\\x0D]"
WORD_CLASS = "[^\\x20\\x09-\\x0D]"


_HELD: dict[str, list[Callable[[], object]]] = {}
_OWNER = ""


def held_by(owner: str, release: Callable[[], object]) -> None:
    """Names what frees an operator's caches in a worker process."""
    _HELD.setdefault(owner, []).append(release)


def claim(owner: str) -> None:
    """A worker begins a task of ``owner``: what other operators left in it is freed.

    Workers serve many tasks; caches are worth keeping between tasks of one
    operator, not beyond.
    """
    global _OWNER
    if _OWNER != owner:
        for name, releases in _HELD.items():
            if name != owner:
                for release in releases:
                    release()
        _OWNER = owner
        trim()


def trim() -> None:
    """Gives freed memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a batch between Spark and its Python workers: texts are larger than the rows its default is made for.
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches, unless the session asks for a number of its own."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, "10000") == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def id_and_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id long, text binary)``; null texts are empty. Other columns go."""
    small_batches(docs.sparkSession)
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"),
    )


def blocks(batches: Iterable[pa.RecordBatch], limit: int = 4 << 20) -> Iterator[tuple[list, list[bytes]]]:
    """Lists of ids and texts of about ``limit`` bytes, so memory is bounded."""
    ids: list = []
    texts: list[bytes] = []
    held = 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            t = t.as_py()
            ids.append(i)
            texts.append(t)
            held += len(t)
            if held >= limit:
                yield ids, texts
                ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def fresh_names(frame: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that ``frame`` does not have."""
    taken, out = {c.lower() for c in frame.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def training_fold(id_col: str, modulus: int) -> F.Column:
    """True where crc32 of the id as text, modulo ``modulus``, is not 1."""
    return (F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus) != 1


#: Most partitions of a stage; beyond it they grow instead.
MAX_PARTS = 100_000


def part_count(size: int, each: int) -> int:
    """Partitions for ``size`` bytes at about ``each`` bytes."""
    return max(1, min(-(-size // each), MAX_PARTS))


def bases(parts: DataFrame, group: list[str], block: int = 1024) -> DataFrame:
    """``parts`` (one row per group and ``part``, with ``n``) with ``base``: the sum of n of earlier parts.

    Sums are taken within blocks of parts and then over blocks, so a task holds
    ``block`` rows, or the rows of all blocks, a thousandth of the parts.
    """
    rows = parts.withColumn("block", F.floor(F.col("part") / block))
    before = lambda *by: W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    span = (W.unboundedPreceding, -1)
    inner = before(*group, "block").orderBy("part").rowsBetween(*span)
    outer = before(*group).orderBy("block").rowsBetween(*span)
    sums = rows.groupBy(*group, "block").agg(F.sum("n").alias("of_block"))
    sums = sums.select(*group, "block", F.coalesce(F.sum("of_block").over(outer), F.lit(0)).alias("earlier"))
    rows = rows.withColumn("within", F.coalesce(F.sum("n").over(inner), F.lit(0)))
    return rows.join(sums, [*group, "block"]).withColumn("base", F.col("within") + F.col("earlier")).drop("block", "within", "earlier")
