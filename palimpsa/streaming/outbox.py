"""The outbox: per project a gap-free sequence of changes, folded to the latest state.

``fold`` and ``contiguous`` work on batches; ``materialise`` runs them as a
Structured Streaming query whose checkpoint replaces leases and acknowledgements,
and whose sink is keyed by batch, so a repeated batch writes the same files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.numbering import placed


def contiguous(events: DataFrame, project: str, seq: str, applied: int = 0) -> DataFrame:
    """Events up to the first gap after ``applied``, in each project."""
    rest = placed(events.filter(F.col(seq) > applied), project, [seq])
    return rest.filter(F.col(seq) == F.col("place") + applied).drop("place")


def fold(events: DataFrame, key: list[str], seq: str, columns: list[str], deleted: str) -> DataFrame:
    """The last state of each record; a tombstone removes it."""
    last = events.groupBy(*key).agg(F.max_by(F.struct(*columns, deleted), seq).alias("s"), F.max(seq).alias("last_seq"))
    return last.filter(~F.col(f"s.{deleted}")).select(*key, "last_seq", *[F.col(f"s.{c}").alias(c) for c in columns])


def watermarks(events: DataFrame, project: str, seq: str) -> DataFrame:
    return events.groupBy(project).agg(F.max(seq).alias("watermark"), F.count(F.lit(1)).alias("events"))


def audit(authority: DataFrame, receipts: DataFrame, key: list[str], digest: str) -> DataFrame:
    """Differences of two states: missing, stale or surplus rows."""
    a = authority.select(*key, F.col(digest).alias("wanted"))
    b = receipts.select(*key, F.col(digest).alias("have"))
    state = F.when(F.col("have").isNull(), "missing").when(F.col("wanted").isNull(), "surplus").when(F.col("have") != F.col("wanted"), "stale")
    return a.join(b, key, "full").select(*key, state.alias("state")).filter("state is not null")


def materialise(stream: DataFrame, path: str, checkpoint: str, key: list[str], seq: str) -> StreamingQuery:
    """Writes the last change of each key per batch below ``path``; processes what is there and stops."""

    def write(batch: DataFrame, batch_id: int) -> None:
        columns = [c for c in batch.columns if c not in key]
        last = batch.groupBy(*key).agg(F.max_by(F.struct(*columns), seq).alias("s")).select(*key, "s.*")
        last.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, at: str, length: str, slide: str | None = None) -> DataFrame:
    """Tumbling or sliding counts and sums; the same plan works on streams with a watermark."""
    own = F.window(at, length, slide) if slide else F.window(at, length)
    return events.groupBy(own.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
