"""Qualification by semi-joins, before anything is ranked or paged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_endpoints(facts: DataFrame, entities: DataFrame, ends: dict[str, str]) -> DataFrame:
    """Facts whose end points are all qualified; ``ends`` maps fact columns to the entity id."""
    out = facts
    for column, entity in ends.items():
        ids = entities.select(F.col(entity).alias(column)).distinct()
        out = out.join(ids, column, "left_semi")
    return out


def supported(records: DataFrame, support: DataFrame, key: str, at: Column) -> DataFrame:
    """Records with a support interval that holds the instant."""
    live = support.filter((F.col("known_from") <= at) & (F.col("known_until").isNull() | (F.col("known_until") > at)))
    return records.join(live.select(key).distinct(), key, "left_semi")


def direct_or_supported(records: DataFrame, mapped: DataFrame, support: DataFrame, key: str, at: Column) -> DataFrame:
    """Rows without any mapping count by themselves; mapped ones need live support."""
    legacy = records.join(mapped.select(key).distinct(), key, "left_anti")
    return legacy.unionByName(supported(records.join(mapped.select(key).distinct(), key, "left_semi"), support, key, at))


def incident_entities(facts: DataFrame, subject: str, object_: str) -> DataFrame:
    """Entities that a qualified fact touches."""
    return facts.select(F.col(subject).alias("id")).union(facts.select(F.col(object_).alias("id"))).filter("id is not null").distinct()


def keyword_predicate(query: str, *columns: Column) -> Column:
    """Literal, case-insensitive part of any column."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.contains(F.lower(c), F.lit(query.lower())), F.lit(False))
    return out


def in_order(records: DataFrame, ids: list, key: str) -> DataFrame:
    """Rows of a caller's list of ids, with their place in it (5000 ids at most)."""
    if len(ids) > 5000:
        raise ValueError("at most 5000 ids")
    wanted = records.sparkSession.createDataFrame(list(enumerate(ids)), f"place int, {key} {dict(records.dtypes)[key]}")
    return records.join(F.broadcast(wanted), key)
