"""Entity identity: duplicates, resolution bands, conflicting values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.temporal import overlaps
from .recovery import dealt


def duplicate_groups(entities: DataFrame, keys: list[str], id_col: str, blocked_above: int = 20) -> DataFrame:
    """Groups of several entities with equal keys; very large ones are marked, not listed."""
    return (
        entities.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"), F.min(id_col).alias("first_id"))
        .filter("n > 1")
        .withColumn("blocked", F.col("n") > blocked_above)
    )


def exact_matches(mentions: DataFrame, entities: DataFrame, name: str) -> DataFrame:
    """``mention, name, candidates, entity``: the entity if one only has the (folded) name."""
    key = lambda c: F.lower(F.trim(c))
    known = entities.groupBy(key(F.col(name)).alias("k")).agg(F.count(F.lit(1)).alias("candidates"), F.min("id").alias("entity"))
    out = mentions.withColumn("k", key(F.col(name))).join(known, "k", "left")
    return out.select(
        "mention", name, F.coalesce("candidates", F.lit(0)).cast("long").alias("candidates"), F.when(F.col("candidates") == 1, F.col("entity")).alias("entity")
    )


def band(score, review: float = 0.72, merge: float = 0.88):
    """aligned, review or separate."""
    return F.when(score >= merge, "aligned").when(score >= review, "review").otherwise("separate")


def held_values(rows: DataFrame, owner: list[str], value: str, start: str, end: str, ends_too: bool = False) -> DataFrame:
    """``owner, at, held``: distinct values that hold at each start (and end) of an owner's half-open intervals.

    Intervals of one value are merged; then a running sum over starts (+1) and
    ends (-1) counts them, so the work grows with the intervals, not their pairs.
    Rows without a start, and empty intervals, hold nowhere; without an end they hold on.
    """
    i = dealt(rows.select(*owner, F.col(value).alias("v"), F.col(start).alias("s"), F.col(end).alias("t")), *owner)
    points = i.select(*owner, F.col("s").alias("at"))
    if ends_too:
        points = points.union(i.select(*owner, F.col("t").alias("at")))
    i = i.filter(F.col("s").isNotNull() & (F.col("t").isNull() | (F.col("t") > F.col("s"))))
    own = W.partitionBy(*owner, "v").orderBy("s", F.col("t").asc_nulls_last())
    before = own.rowsBetween(W.unboundedPreceding, -1)
    reach, opened = F.max("t").over(before), F.max(F.col("t").isNull()).over(before)
    i = i.withColumn("new", F.coalesce(~opened & (reach < F.col("s")), opened.isNull()))
    i = i.withColumn("island", F.count_if("new").over(own.rowsBetween(W.unboundedPreceding, 0)))
    merged = i.groupBy(*owner, "v", "island").agg(F.min("s").alias("s"), F.when(~F.bool_or(F.col("t").isNull()), F.max("t")).alias("t"))
    steps = (
        merged.select(*owner, F.col("s").alias("at"), F.lit(1).alias("d"), F.lit(False).alias("point"))
        .union(merged.filter("t is not null").select(*owner, "t", F.lit(-1), F.lit(False)))
        .union(points.filter("at is not null").select(*owner, "at", F.lit(0), F.lit(True)))
    )
    steps = steps.groupBy(*owner, "at").agg(F.sum("d").alias("d"), F.max("point").alias("point"))
    along = W.partitionBy(*owner).orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    return steps.withColumn("held", F.sum("d").over(along)).filter("point").select(*owner, "at", "held")


def value_conflicts(rows: DataFrame, owner: list[str], value: str, start: str, end: str) -> DataFrame:
    """Owners with several values at one instant; any true overlap holds at one of the starts."""
    return held_values(rows, owner, value, start, end).filter("held > 1").withColumnRenamed("held", "values")


def candidate_conflicts(rows: DataFrame, candidates: DataFrame, owner: list[str], value: str, start: str, end: str) -> DataFrame:
    """Stored rows whose interval overlaps a candidate's and whose value differs."""
    c = candidates.select(*owner, F.col(value).alias("new_value"), F.col(start).alias("new_start"), F.col(end).alias("new_end"))
    both = rows.join(c, owner).filter(F.col(value) != F.col("new_value"))
    return both.filter(overlaps(F.col(start), F.col(end), F.col("new_start"), F.col("new_end")))


def domain_range_violations(relations: DataFrame, entities: DataFrame, rules: DataFrame) -> DataFrame:
    """Relations whose ends are of no allowed type; ``rules``: ``type, domain, range``."""
    types = entities.select("id", "type")
    typed = relations.join(types.select(F.col("id").alias("src"), F.col("type").alias("src_type")), "src", "left").join(
        types.select(F.col("id").alias("dst"), F.col("type").alias("dst_type")), "dst", "left"
    )
    ok = rules.select("type", F.col("domain").alias("src_type"), F.col("range").alias("dst_type"))
    return typed.join(ok, ["type", "src_type", "dst_type"], "left_anti")
