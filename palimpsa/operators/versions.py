"""Versioned records: numbering, as-of reads, history, timeline, manifests, pages."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.temporal import known_at, valid_at


def append_versions(log: DataFrame, key: list[str], order: list[str], recorded: str) -> DataFrame:
    """Adds ``version`` and the half-open system interval ``[recorded_at, superseded_at)``."""
    own = W.partitionBy(*key).orderBy(*order)
    return log.withColumns(
        {
            "version": F.row_number().over(own),
            "recorded_at": F.col(recorded),
            "superseded_at": F.lead(recorded).over(own),
        }
    )


def as_of(records: DataFrame, known: Column | None, valid: Column | None = None, include_unknown: bool = True) -> DataFrame:
    """Rows known at one instant and valid at another; without ``known`` the current ones."""
    seen = known_at(F.col("recorded_at"), F.col("superseded_at"), known)
    return records.filter(seen & valid_at(F.col("valid_from"), F.col("valid_until"), valid, include_unknown))


def as_of_lookup(records: DataFrame, wanted: DataFrame, id_col: str, at_col: str) -> DataFrame:
    """Each wanted (id, instant) with the version known then."""
    asked = wanted.select(F.col(id_col).alias("asked_id"), F.col(at_col).alias("asked_at"))
    return asked.join(
        records,
        (F.col("asked_id") == records["id"]) & known_at(F.col("recorded_at"), F.col("superseded_at"), F.col("asked_at")),
    )


def timeline(records: DataFrame, at: Column, last: int | None = None) -> DataFrame:
    """Per instant of system time: changed, created and revised records."""
    out = records.groupBy(at.alias("at")).agg(
        F.count(F.lit(1)).alias("changed"),
        F.count_if(F.col("version") == 1).alias("created"),
        F.count_if(F.col("version") > 1).alias("revised"),
    )
    return out if last is None else out.orderBy(F.desc("at")).limit(last)


def sliced_manifest(records: DataFrame, group: str) -> DataFrame:
    """Count and digest of the ordered version ids of each group.

    Ids are digested in slices first, so no task gathers all ids of a group.
    """
    slot = F.substring(F.md5(F.col("id")), 1, 4)
    part = records.groupBy(group, slot.alias("slot")).agg(
        F.count(F.lit(1)).alias("n"),
        F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "version", "version_id"))), lambda x: x["version_id"]), "")).alias("d"),
    )
    return part.groupBy(group).agg(
        F.sum("n").alias("n"),
        F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slot", "d"))), lambda x: x["d"]), "")).alias("digest"),
    )


def version_manifest(records: DataFrame, group: str) -> DataFrame:
    """``group, total, version_digest``: MD5 of each group's version ids in id and version order, joined by commas.

    A digest of one string can only be taken in order; it is fed row by row from
    sorted partitions, so a task holds no more than a batch. ``sliced_manifest``
    is the form that scales with a group's size.
    """
    kind = dict(records.dtypes)[group]
    rows = records.select(F.col(group).alias("g"), "id", "version", F.col("version_id").cast("string").alias("v"))
    ordered = rows.repartition("g").sortWithinPartitions("g", "id", "version")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, total, digest = None, 0, None
        for pdf in batches:
            for g, v in zip(pdf["g"], pdf["v"], strict=True):
                if digest is None or g != at:
                    if digest is not None:
                        yield pd.DataFrame({"g": [at], "total": [total], "version_digest": [digest.hexdigest()]})
                    at, total, digest = g, 0, hashlib.md5()
                digest.update(("," * (total > 0) + v).encode())
                total += 1
        if digest is not None:
            yield pd.DataFrame({"g": [at], "total": [total], "version_digest": [digest.hexdigest()]})

    return ordered.mapInPandas(run, f"g {kind}, total long, version_digest string").withColumnRenamed("g", group)


def keyset_page(records: DataFrame, keys: list[str], after: tuple | None, limit: int) -> DataFrame:
    """The next ``limit`` rows in key order after a cursor."""
    if after is not None:
        past = F.lit(False)
        for i, key in enumerate(keys):
            same = F.lit(True)
            for k, v in zip(keys[:i], after, strict=False):
                same = same & (F.col(k) == F.lit(v))
            past = past | (same & (F.col(key) > F.lit(after[i])))
        records = records.filter(past)
    return records.orderBy(*keys).limit(limit)


def latest_before(events: DataFrame, key: str, order: str, until: Column) -> DataFrame:
    """As-of decision: each key's last event before an instant."""
    return events.filter(until).groupBy(key).agg(F.max_by(F.struct(*events.columns), order).alias("e")).select("e.*")


def support_intervals(events: DataFrame, key: str, order: list[str], at: str, status: str, accepted: str) -> DataFrame:
    """``[known_from, known_until)`` of accepted decisions; any later event of the key closes one."""
    own = W.partitionBy(key).orderBy(*order)
    return (
        events.withColumn("known_from", F.col(at))
        .withColumn("known_until", F.lead(at).over(own))
        .filter(F.col(status) == accepted)
        .withColumn("invalid_reason", F.when(F.col("known_until") < F.col("known_from"), F.lit("reversed interval")))
    )


def merge_intervals(rows: DataFrame, key: str | list[str], start: str, end: str) -> DataFrame:
    """Gaps and islands: overlapping or touching intervals become one."""
    keys = [key] if isinstance(key, str) else key
    own = W.partitionBy(*keys).orderBy(start, end)
    before = own.rowsBetween(W.unboundedPreceding, -1)
    marked = rows.withColumn("reach", F.max(end).over(before))
    island = F.sum(F.when(F.col("reach") >= F.col(start), 0).otherwise(1)).over(own.rowsBetween(W.unboundedPreceding, 0))
    return (
        marked.withColumn("island", island)
        .groupBy(*keys, "island")
        .agg(F.min(start).alias("start"), F.max(end).alias("stop"), F.count(F.lit(1)).alias("n"))
        .drop("island")
    )


def changes_to_restore(current: DataFrame, snapshot: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """New versions that bring back a snapshot: upserts and tombstones, nothing is erased."""
    a = current.select(F.col(key).alias("key"), F.struct(*columns).alias("now"))
    b = snapshot.select(F.col(key).alias("key"), F.struct(*columns).alias("then"))
    return (
        a.join(b, "key", "full")
        .filter(~F.col("now").eqNullSafe(F.col("then")))
        .select("key", F.when(F.col("then").isNull(), "tombstone").otherwise("upsert").alias("action"), "then")
    )
