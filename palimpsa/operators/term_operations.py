"""Changes to an ontology as a log of operations, compiled to edits of triples.

An operation becomes edits, each of which adds or removes one triple. What was there
just before an edit is the last edit of that triple, so all conditions of a log are
checked by one window, and the state after it is the last edit of each triple.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import chain_ends, closure, on_cycles

TYPE, PARENT, DOMAIN, RANGE, DEPRECATED, REPLACED = "rdf:type", "rdfs:subClassOf", "rdfs:domain", "rdfs:range", "owl:deprecated", "dcterms:isReplacedBy"
#: By action: its predicate (None: the operation's own), whether it adds, and whether the triple must be there or not before (fixed values).
ACTIONS = {
    "create_term": (TYPE, True, "absent"), "add_parent": (PARENT, True, "absent"), "remove_parent": (PARENT, False, "present"), "add_domain": (DOMAIN, True, "absent"),
    "remove_domain": (DOMAIN, False, "present"), "add_range": (RANGE, True, "absent"), "remove_range": (RANGE, False, "present"), "add_annotation": (None, True, None),
    "remove_annotation": (None, False, "present"), "retire_term": (DEPRECATED, True, None), "restore_term": (DEPRECATED, False, "present"),
}


def compiled(operations: DataFrame) -> DataFrame:
    """``seq, s, p, o, adds, needs``: the edits of operations ``seq, action, target, predicate, value``.

    ``set_datatype`` has its old value in ``before`` (null: none) and becomes two edits.
    Unknown actions are an error.
    """
    has_before = "before" in operations.columns
    rows = operations.withColumn("before", F.col("before") if has_before else F.lit(None).cast("string"))
    edit = lambda p, o, adds, needs, met=None: F.when(F.lit(True) if met is None else met, F.struct(p.alias("p"), o.alias("o"), F.lit(adds).alias("adds"), F.lit(needs).cast("string").alias("needs")))
    known = F.lit(None)
    for action, (predicate, adds, needs) in ACTIONS.items():
        p = F.lit(predicate) if predicate else F.col("predicate")
        o = F.lit("true") if predicate == DEPRECATED else F.col("value")
        known = F.when(F.col("action") == action, F.array(edit(p, o, adds, needs))).otherwise(known)
    both = F.array(
        edit(F.lit(RANGE), F.col("before"), False, "present", F.col("before").isNotNull()), edit(F.lit(RANGE), F.col("value"), True, "absent", F.col("value").isNotNull())
    )
    edits = F.when(F.col("action") == "set_datatype", F.filter(both, lambda e: e.isNotNull())).otherwise(known)
    edits = F.coalesce(edits, F.raise_error(F.concat(F.lit("not an action: "), F.coalesce("action", F.lit("null")))).cast("array<struct<p:string,o:string,adds:boolean,needs:string>>"))
    return rows.select("seq", F.col("target").alias("s"), F.explode(edits).alias("e")).select("seq", "s", "e.p", "e.o", "e.adds", "e.needs")


def _with_base(base: DataFrame, edits: DataFrame) -> DataFrame:
    start = base.select(F.lit(None).cast("long").alias("seq"), "s", "p", "o", F.lit(True).alias("adds"), F.lit(None).cast("string").alias("needs")).distinct()
    return start.unionByName(edits.select(F.col("seq").cast("long").alias("seq"), "s", "p", "o", "adds", "needs"))


def conflicts(base: DataFrame, edits: DataFrame) -> DataFrame:
    """``seq, s, p, o, problem``: edits whose triple is not as it was reviewed, when all earlier ones have been made."""
    before = F.coalesce(F.lag("adds").over(W.partitionBy("s", "p", "o").orderBy(F.asc_nulls_first("seq"), "adds")), F.lit(False))
    rows = _with_base(base, edits).withColumn("before", before).filter("seq is not null")
    problem = F.when((F.col("needs") == "absent") & F.col("before"), "already there").when((F.col("needs") == "present") & ~F.col("before"), "not there")
    return rows.select("seq", "s", "p", "o", problem.alias("problem")).filter("problem is not null")


def applied(base: DataFrame, edits: DataFrame) -> DataFrame:
    """The triples after all edits: of each triple its last edit holds."""
    last = _with_base(base, edits).groupBy("s", "p", "o").agg(F.max_by("adds", F.struct(F.coalesce("seq", F.lit(-(1 << 62))).alias("seq"), "adds")).alias("there"))
    return last.filter("there").select("s", "p", "o")


def inverse(base: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits that lead back from ``applied(base, edits)`` to ``base``: those that changed something, turned around, last first."""
    own = W.partitionBy("s", "p", "o").orderBy(F.asc_nulls_first("seq"), "adds")
    rows = _with_base(base, edits).withColumn("before", F.coalesce(F.lag("adds").over(own), F.lit(False))).filter("seq is not null and before <> adds")
    needs = F.when(F.col("adds"), "present").otherwise("absent")
    return rows.select((-F.col("seq")).alias("seq"), "s", "p", "o", (~F.col("adds")).alias("adds"), needs.alias("needs"))


def difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """``s, p, o, adds``: the edits that make one set of triples of another."""
    a, b = before.select("s", "p", "o").distinct(), after.select("s", "p", "o").distinct()
    return b.join(a, ["s", "p", "o"], "left_anti").withColumn("adds", F.lit(True)).union(a.join(b, ["s", "p", "o"], "left_anti").withColumn("adds", F.lit(False)))


def merged_terms(triples: DataFrame, merges: DataFrame) -> DataFrame:
    """Triples after terms became others: ``merges`` has ``old, new``; chains lead to their end, cycles and forks nowhere.

    An old term keeps its own type, is deprecated and names its replacement; all else that it said or
    that named it moves, and a term is no parent of itself.
    """
    chains = chain_ends(merges.select(F.col("old").alias("src"), F.col("new").alias("dst")))
    ends = chains.filter("issue is null and target is not null").select(F.col("node").alias("old"), F.col("target").alias("final"))
    at = lambda c: ends.select(F.col("old").alias(c), F.col("final").alias(f"{c}_new"))
    rows = triples.join(at("s"), "s", "left").join(at("o"), "o", "left")
    moved = rows.select(F.coalesce("s_new", "s").alias("s"), "p", F.coalesce("o_new", "o").alias("o")).filter(~((F.col("p") == PARENT) & (F.col("s") == F.col("o"))))
    kept = triples.filter(F.col("p") == TYPE).join(ends.select(F.col("old").alias("s")), "s", "left_semi").select("s", "p", "o")
    marks = ends.select(F.col("old").alias("s"), F.explode(F.create_map(F.lit(DEPRECATED), F.lit("true"), F.lit(REPLACED), F.col("final"))).alias("p", "o"))
    return moved.select("s", "p", "o").union(kept).union(marks).distinct()


def invariants(triples: DataFrame, class_kind: str = "owl:Class") -> DataFrame:
    """``problem, term, other``: what must not be in an ontology."""
    types = triples.filter(F.col("p") == TYPE)
    classes = types.filter(F.col("o") == class_kind).select(F.col("s").alias("x")).distinct()
    retired = triples.filter((F.col("p") == DEPRECATED) & (F.col("o") == "true")).select(F.col("s").alias("x")).distinct()
    of = lambda *p: triples.filter(F.col("p").isin(*p))
    lacks = lambda rows, side: rows.join(classes.withColumnRenamed("x", side), side, "left_anti")
    named = lambda rows, problem: rows.select(F.lit(problem).alias("problem"), F.col("s").alias("term"), F.col("o").alias("other"))
    parents = of(PARENT)
    loops = on_cycles(closure(parents, "s", "o"))
    out = named(lacks(parents, "o"), "unknown parent").union(named(lacks(parents, "s"), "parent of no class")).union(named(lacks(of(DOMAIN), "o"), "unknown domain"))
    out = out.union(named(parents.join(retired.withColumnRenamed("x", "o"), "o", "left_semi").join(retired.withColumnRenamed("x", "s"), "s", "left_anti"), "retired parent"))
    out = out.union(loops.select(F.lit("cycle"), "node", F.lit(None).cast("string")))
    several = types.groupBy("s").agg(F.count_distinct("o").alias("n"), F.min("o").alias("o")).filter("n > 1")
    return out.union(named(several, "several kinds")).distinct()
