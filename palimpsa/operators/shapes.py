"""Shapes over facts in time: one sweep gives the intervals in which a subject breaks a rule.

A fact, a class membership, and a value that is no member of its class change a count at
their start and end. Running sums over the changes of a (subject, shape) hold between
two boundaries, so they also say what holds a microsecond before each one; no snapshot is
built. An open start is before, an open end after all others.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .recovery import dealt
from .versions import merge_intervals

FIRST, LAST = "0001-01-01 00:00:00", "9999-12-31 23:59:59"
#: Lexical forms of the datatypes (fixed values of XML Schema).
DATATYPES = {
    "string": r"(?s).*", "boolean": r"true|false|1|0", "integer": r"[+-]?[0-9]+", "decimal": r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)",
    "double": r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?|[+-]?INF|NaN", "date": r"-?[0-9]{4}-[0-9]{2}-[0-9]{2}(Z|[+-][0-9]{2}:[0-9]{2})?",
    "dateTime": r"-?[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})?",
}


@dataclass(frozen=True)
class Shape:
    """What holds for ``predicate`` of members of ``target``; unset rules do not count."""

    name: str
    target: str
    predicate: str
    least: int | None = None
    most: int | None = None
    datatype: str | None = None
    pattern: str | None = None
    one_of: tuple[str, ...] | None = None
    node_class: str | None = None

    def bad_value(self, value: Column) -> Column:
        """True for values that break a rule whatever the time is."""
        out = F.lit(False)
        if self.datatype is not None:
            out = out | ~value.rlike(f"^({DATATYPES[self.datatype]})$")
        if self.pattern is not None:
            out = out | ~value.rlike(self.pattern)
        if self.one_of is not None:
            out = out | ~value.isin(list(self.one_of))
        return out


def _bounded(rows: DataFrame) -> DataFrame:
    at = lambda c, d: F.coalesce(F.col(c).cast("timestamp_ntz"), F.lit(d).cast("timestamp_ntz")).alias(c)
    out = rows.select(*[c for c in rows.columns if c not in ("start", "stop")], at("start", FIRST), at("stop", LAST))
    return out.filter("start < stop")


def _merged(rows: DataFrame, *keys: str) -> DataFrame:
    """Intervals of equal keys that overlap or touch, as one."""
    return merge_intervals(_bounded(rows).select(*keys, "start", "stop"), list(keys), "start", "stop").select(*keys, "start", "stop")


def _deltas(rows: DataFrame, **counts: Column) -> DataFrame:
    """Two changes for each interval: its counts added at the start and taken at the end."""
    ends = F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("sign")), F.struct(F.col("stop").alias("at"), F.lit(-1).alias("sign")))
    names = ("member", "n", "bad", "wrong")
    changed = [(F.col("e.sign") * counts.get(c, F.lit(0))).alias(c) for c in names]
    return rows.withColumn("e", F.explode(ends)).select("subject", "shape", F.col("e.at").alias("at"), *changed)


def _outside_class(facts: DataFrame, types: DataFrame) -> DataFrame:
    """``subject, shape, value, start, stop``: when a value was given but no member of the class asked for."""
    given = facts.select("subject", "shape", "value", "node_class", "start", "stop")
    members = types.select(F.col("subject").alias("value"), F.col("class").alias("node_class"), "start", "stop")
    theirs = given.select("subject", "shape", "value", "node_class").distinct().join(members, ["value", "node_class"])
    every = given.withColumn("kind", F.lit("given")).unionByName(theirs.withColumn("kind", F.lit("in")))
    ends = F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("sign")), F.struct(F.col("stop").alias("at"), F.lit(-1).alias("sign")))
    each = every.withColumn("e", F.explode(ends)).groupBy("subject", "shape", "value", F.col("e.at").alias("start")).agg(
        F.sum(F.when(F.col("kind") == "given", F.col("e.sign")).otherwise(0)).alias("given"), F.sum(F.when(F.col("kind") == "in", F.col("e.sign")).otherwise(0)).alias("inside")
    )
    own = W.partitionBy("subject", "shape", "value").orderBy("start")
    so_far = own.rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = each.select("subject", "shape", "value", "start", F.lead("start").over(own).alias("stop"), F.sum("given").over(so_far).alias("given"), F.sum("inside").over(so_far).alias("inside"))
    return rows.filter("given > 0 and inside = 0 and stop is not null").select("subject", "shape", "value", "start", "stop")


def violations(facts: DataFrame, types: DataFrame, shapes: list[Shape]) -> DataFrame:
    """``subject, shape, rule, start, stop``: maximal intervals in which a member of a shape's target breaks a rule.

    ``facts``: subject, predicate, value, start, stop; ``types``: subject, class, start,
    stop. Rules are ``least``, ``most``, ``value`` (datatype, pattern, listed values) and
    ``class``. Different values count, however often they are given at a time. A null
    start or stop of the result is open.
    """
    spark = facts.sparkSession
    known = _merged(dealt(types, "subject"), "subject", "class")
    given = _merged(dealt(facts, "subject").select("subject", "predicate", F.col("value").cast("string").alias("value"), "start", "stop"), "subject", "predicate", "value")
    every, limits = None, []
    for s in shapes:
        members = known.filter(F.col("class") == s.target).withColumn("shape", F.lit(s.name))
        own = given.filter(F.col("predicate") == s.predicate).withColumn("shape", F.lit(s.name))
        part = _deltas(members, member=F.lit(1)).union(_deltas(own, n=F.lit(1), bad=s.bad_value(F.col("value")).cast("int")))
        if s.node_class is not None:
            part = part.union(_deltas(_outside_class(own.withColumn("node_class", F.lit(s.node_class)), known), wrong=F.lit(1)))
        every = part if every is None else every.union(part)
        limits.append((s.name, s.least, s.most))
    bounds = F.broadcast(spark.createDataFrame(limits, "shape string, least int, most int"))  # a row for each shape that is asked
    sums = every.groupBy("subject", "shape", "at").agg(*[F.sum(c).alias(c) for c in ("member", "n", "bad", "wrong")])
    own = W.partitionBy("subject", "shape").orderBy("at")
    so_far = own.rowsBetween(W.unboundedPreceding, W.currentRow)
    held = sums.select("subject", "shape", F.col("at").alias("start"), F.lead("at").over(own).alias("stop"), *[F.sum(c).over(so_far).alias(c) for c in ("member", "n", "bad", "wrong")])
    held = held.filter("member > 0 and stop is not null").join(bounds, "shape")
    rules = F.array(
        F.when(F.col("n") < F.col("least"), F.lit("least")), F.when(F.col("n") > F.col("most"), F.lit("most")), F.when(F.col("bad") > 0, F.lit("value")), F.when(F.col("wrong") > 0, F.lit("class"))
    )
    broken = held.select("subject", "shape", "start", "stop", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("rule"))
    out = _merged(broken, "subject", "shape", "rule")
    open_at = lambda c, d: F.when(F.col(c) != F.lit(d).cast("timestamp_ntz"), F.col(c)).alias(c)
    return out.select("subject", "shape", "rule", open_at("start", FIRST), open_at("stop", LAST))
