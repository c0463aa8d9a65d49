"""Changes to records as new versions, their checks, and shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Status changes that a decision may make (fixed values); rejected and superseded are final.
TRANSITIONS = [
    ("pending", "accepted"), ("pending", "rejected"), ("pending", "contradicting"), ("pending", "superseded"),
    ("accepted", "contradicting"), ("accepted", "rejected"), ("accepted", "superseded"),
    ("contradicting", "accepted"), ("contradicting", "rejected"), ("contradicting", "superseded"),
]


def stale_writes(changes: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Optimistic check: changes whose ``expected_version`` is not the current one (0: new)."""
    have = current.select(key, F.col("version").alias("have"))
    return changes.join(have, key, "left").filter(F.coalesce("have", F.lit(0)) != F.col("expected_version"))


def illegal_transitions(log: DataFrame, key: str, order: str, status: str, start: str = "pending") -> DataFrame:
    """Decisions that no transition allows, given the status before them."""
    own = W.partitionBy(key).orderBy(order)
    rows = log.withColumn("from_status", F.coalesce(F.lag(status).over(own), F.lit(start)))
    pairs = F.array(*[F.lit(f"{a}>{b}") for a, b in TRANSITIONS])
    return rows.filter(~F.array_contains(pairs, F.concat_ws(">", "from_status", status)))


def merge_entity(entities: DataFrame, facts: DataFrame, keep: str, drop: str) -> DataFrame:
    """New rows of a merge: a tombstone for one entity, redirected facts for the other, self links gone."""
    gone = entities.filter(F.col("id") == drop).select("id", F.lit("tombstone").alias("action"), F.lit(None).cast("string").alias("src"), F.lit(None).cast("string").alias("dst"))
    to = lambda c: F.when(F.col(c) == drop, keep).otherwise(F.col(c))
    moved = facts.filter((F.col("src") == drop) | (F.col("dst") == drop)).select(
        F.col("edge").alias("id"), F.when(to("src") == to("dst"), "tombstone").otherwise("upsert").alias("action"), to("src").alias("src"), to("dst").alias("dst")
    )
    return gone.unionByName(moved)


def undo_parity(ledger: DataFrame, most: int = 64) -> DataFrame:
    """``operation, active``: an operation is active if it is not undone by an active one.

    ``ledger``: ``operation, reversal_of``. Undoing an undo makes the first one active again.
    """
    from .recovery import cut

    state = cut(ledger.select("operation", "reversal_of", F.lit(True).alias("active")))
    for _ in range(most):
        undone = state.filter(F.col("active") & F.col("reversal_of").isNotNull()).select(F.col("reversal_of").alias("operation"), F.lit(True).alias("undone")).distinct()
        new = cut(state.drop("active").join(undone, "operation", "left").select("operation", "reversal_of", F.col("undone").isNull().alias("active")))
        same = new.join(state.select("operation", F.col("active").alias("was")), "operation").filter("active <> was").limit(1).count() == 0
        state = new
        if same:
            return state.select("operation", "active")
    raise ValueError(f"chains of more than {most} reversals, or a cycle of them")


def triple_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Added and removed triples."""
    added = after.exceptAll(before).withColumn("change", F.lit("added"))
    return added.unionByName(before.exceptAll(after).withColumn("change", F.lit("removed")))


def shape_violations(rows: DataFrame, subject: str, predicate: str, value: str, shapes: list[dict]) -> DataFrame:
    """``subject, predicate, rule``: min_count, max_count, one_of, pattern and datatype (a regular expression) rules.

    A shape applies to the subjects of its ``targets`` frame, or to all that occur.
    """
    out = None
    for shape in shapes:
        own = rows.filter(F.col(predicate) == shape["predicate"])
        targets = shape.get("targets", rows.select(subject)).select(F.col(subject).alias("subject")).distinct()
        counts = targets.join(own.groupBy(F.col(subject).alias("subject")).agg(F.count(F.lit(1)).alias("n")), "subject", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        tests = []
        if "min_count" in shape:
            tests.append(("min_count", counts.filter(F.col("n") < shape["min_count"]).select("subject")))
        if "max_count" in shape:
            tests.append(("max_count", counts.filter(F.col("n") > shape["max_count"]).select("subject")))
        text = F.col(value).cast("string")
        if "one_of" in shape:
            tests.append(("one_of", own.filter(~text.isin(shape["one_of"])).select(F.col(subject).alias("subject")).distinct()))
        for rule in ("pattern", "datatype"):
            if rule in shape:
                tests.append((rule, own.filter(~text.rlike(shape[rule])).select(F.col(subject).alias("subject")).distinct()))
        for rule, found in tests:
            part = found.select("subject", F.lit(shape["predicate"]).alias("predicate"), F.lit(rule).alias("rule"))
            out = part if out is None else out.unionByName(part)
    return out


def box_duplicates(boxes: DataFrame, group: list[str], least: float = 0.6) -> DataFrame:
    """Pairs of boxes of one group that overlap: intersection over union or containment.

    Boxes meet in cells of a grid, so only near ones are compared. ``boxes``: ``id, x0, y0, x1, y1``.
    """
    cell = 256
    at = lambda a, b: F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell))
    near = boxes.withColumn("cx", F.explode(at("x0", "x1"))).withColumn("cy", F.explode(at("y0", "y1")))
    a, b = near.alias("a"), near.alias("b")
    both = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in [*group, "cx", "cy"]] + [F.col("a.id") < F.col("b.id")])
    inter = F.greatest(F.lit(0), F.least("a.x1", "b.x1") - F.greatest("a.x0", "b.x0")) * F.greatest(F.lit(0), F.least("a.y1", "b.y1") - F.greatest("a.y0", "b.y0"))
    area = lambda s: (F.col(f"{s}.x1") - F.col(f"{s}.x0")) * (F.col(f"{s}.y1") - F.col(f"{s}.y0"))
    iou, inside = inter / (area("a") + area("b") - inter), inter / F.least(area("a"), area("b"))
    found = both.filter((iou >= least) | (inside >= 0.9))
    return found.select(*[F.col(f"a.{k}") for k in group], F.col("a.id").alias("left"), F.col("b.id").alias("right")).distinct()


def term_resolution(names: DataFrame, surfaces: DataFrame) -> DataFrame:
    """``name, term, ambiguous``: the term with a surface (IRI, label or local name), if one only has it."""
    found = names.join(surfaces.select(F.col("surface").alias("name"), "term"), "name", "left").groupBy("name")
    return found.agg(F.when(F.count_distinct("term") == 1, F.min("term")).alias("term"), (F.count_distinct("term") > 1).alias("ambiguous"))


def mapped_spans(windows: DataFrame, spans: DataFrame, doc: str) -> DataFrame:
    """Source spans of chunk windows: the part of each span that lies in a window, in window offsets."""
    w, s = windows.alias("w"), spans.alias("s")
    both = w.join(s, (F.col(f"w.{doc}") == F.col(f"s.{doc}")) & (F.col("s.start") < F.col("w.stop")) & (F.col("s.stop") > F.col("w.start")))
    return both.select(
        F.col(f"w.{doc}"), "ordinal", "span", (F.greatest("s.start", "w.start") - F.col("w.start")).alias("start"), (F.least("s.stop", "w.stop") - F.col("w.start")).alias("stop")
    )
