"""Triples: graph patterns, slices, entailed types, order and differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import closure
from .recovery import cut


def select_pattern(triples: DataFrame, patterns: list[tuple[str, str, str]], limit: int | None = 1000) -> DataFrame:
    """Solutions of a basic graph pattern: a column for each ``?name``; other terms are constants.

    Patterns are joined in the given order on the names they share; one that shares
    none with those before it is an error, as is a limit above 1000.
    """
    if limit is not None and not 1 <= limit <= 1000:
        raise ValueError("between 1 and 1000 rows")
    out = None
    for pattern in patterns:
        part, names = triples, {}
        for column, term in zip(("s", "p", "o"), pattern, strict=True):
            if not term.startswith("?"):
                part = part.filter(F.col(column) == term)
            elif term[1:] in names:
                part = part.filter(F.col(column) == F.col(names[term[1:]]))
            else:
                names[term[1:]] = column
        part = part.select(*[F.col(c).alias(n) for n, c in names.items()])
        if out is not None and not set(names) & set(out.columns):
            raise ValueError("patterns share a name with those before them")
        out = part if out is None else out.join(part, sorted(set(names) & set(out.columns)))
    out = out.distinct()
    return out if limit is None else out.orderBy(*out.columns).limit(limit)


def ask_pattern(triples: DataFrame, patterns: list[tuple[str, str, str]]) -> DataFrame:
    """One row: whether the pattern has a solution."""
    return select_pattern(triples, patterns, None).limit(1).agg((F.count(F.lit(1)) > 0).alias("answer"))


def entailed_types(types: DataFrame, subclasses: DataFrame) -> DataFrame:
    """``s, p, o``: own types and those of all superclasses. ``types``: id, type; ``subclasses``: child, parent."""
    up = closure(subclasses, "child", "parent").select(F.col("child").alias("type"), F.col("parent").alias("o"))
    own = types.select(F.col("id").alias("s"), F.lit("rdf:type").alias("p"), F.col("type").alias("o"))
    more = types.join(up, "type").select(F.col("id").alias("s"), F.lit("rdf:type").alias("p"), "o")
    return own.union(more).distinct()


def topological(links: DataFrame, before: str, after: str) -> DataFrame:
    """``node, level``: the length of the longest chain that leads to each node; nodes on or behind cycles have none.

    Rounds remove what has no open predecessor; there are as many as the longest chain.
    Sides are merged, not broadcast: every round would send one through the driver.
    """
    edges = cut(links.select(F.col(before).alias("a"), F.col(after).alias("b")).filter("a is not null and b is not null").distinct())
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    done, level, left = None, 0, edges
    open_nodes = cut(nodes)
    while True:
        ready = cut(open_nodes.join(left.select(F.col("b").alias("node")).distinct().hint("merge"), "node", "left_anti"))
        if not ready.limit(1).count():
            break
        part = ready.select("node", F.lit(level).alias("level"))
        done = part if done is None else done.union(part)
        open_nodes = cut(open_nodes.join(ready.hint("merge"), "node", "left_anti"))
        left = cut(left.join(ready.withColumnRenamed("node", "a").hint("merge"), "a", "left_anti"))
        level += 1
    rest = open_nodes.select("node", F.lit(None).cast("int").alias("level"))
    return rest if done is None else done.union(rest)


def constrained(violations: DataFrame, mode: str) -> DataFrame:
    """What a constraint mode makes of violations: advisory warns, review holds, strict rejects, off is silent."""
    action = {"advisory": "warn", "review": "hold", "strict": "reject"}
    if mode not in (*action, "off"):
        raise ValueError("advisory, review, strict or off")
    return violations.filter(F.lit(mode != "off")).withColumn("action", F.lit(action.get(mode)))
