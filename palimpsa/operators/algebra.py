"""Graph patterns as an algebra over solutions: tables with a column for each variable.

``?name`` is a variable, every other term a constant. Variables that two sides share
are joined; in ``optional`` and ``without`` they are bound on both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .recovery import cut

Pattern = tuple[str, str, str]
MOST_ROWS = 1000


def match(triples: DataFrame, pattern: Pattern) -> DataFrame:
    """Solutions of one pattern over ``s, p, o``."""
    names: dict[str, str] = {}
    for column, term in zip(("s", "p", "o"), pattern, strict=True):
        if not term.startswith("?"):
            triples = triples.filter(F.col(column) == term)
        elif term[1:] in names:
            triples = triples.filter(F.col(column) == F.col(names[term[1:]]))
        else:
            names[term[1:]] = column
    return triples.select(*[F.col(c).alias(n) for n, c in names.items()])


def _variables(pattern: Pattern) -> set[str]:
    return {t[1:] for t in pattern if t.startswith("?")}


def join_order(patterns: list[Pattern], sizes: dict[Pattern, int]) -> list[Pattern]:
    """The smallest pattern first, then always the smallest that shares a variable with those before it."""
    left, bound, out = sorted(patterns, key=lambda p: (sizes[p], p)), set(), []
    while left:
        following = next((p for p in left if not bound or _variables(p) & bound or not _variables(p)), None)
        if following is None:
            raise ValueError("patterns share a variable with others")
        left.remove(following)
        bound |= _variables(following)
        out.append(following)
    return out


def measured(triples: DataFrame, patterns: list[Pattern]) -> dict[Pattern, int]:
    """Rows of each pattern by its constants, all counted in one pass."""
    counts = []
    for pattern in patterns:
        met = F.lit(True)
        for column, term in zip(("s", "p", "o"), pattern, strict=True):
            if not term.startswith("?"):
                met = met & (F.col(column) == term)
        counts.append(F.count_if(met))
    return dict(zip(patterns, triples.agg(*[c.alias(f"n{i}") for i, c in enumerate(counts)]).first(), strict=True))


def conjunction(triples: DataFrame, patterns: list[Pattern]) -> DataFrame:
    """Solutions of all patterns together."""
    out = None
    for pattern in join_order(patterns, measured(triples, patterns)) if len(patterns) > 1 else patterns:
        part = match(triples, pattern)
        shared = [c for c in part.columns if out is not None and c in out.columns]
        if out is None:
            out = part
        elif shared:
            out = out.join(part, shared)
        else:  # a pattern of constants: there or not
            out = out.join(part.limit(1).select(F.lit(True).alias("there")), F.lit(True), "left_semi")
    return out


def optional(left: DataFrame, right: DataFrame) -> DataFrame:
    """Solutions of the left side, with those of the right that agree with them or without any."""
    return left.join(right, [c for c in right.columns if c in left.columns], "left")


def either(left: DataFrame, right: DataFrame) -> DataFrame:
    """Solutions of both sides; variables that one does not have are null there."""
    return left.unionByName(right, allowMissingColumns=True)


def without(left: DataFrame, right: DataFrame) -> DataFrame:
    """Solutions of the left side with which none of the right agrees; sides without a common variable do not meet."""
    shared = [c for c in right.columns if c in left.columns]
    return left.join(right.select(*shared), shared, "left_anti") if shared else left


def keep(solutions: DataFrame, condition: Column) -> DataFrame:
    """Solutions for which a condition is true; unbound variables make it false."""
    return solutions.filter(condition)


def path(triples: DataFrame, steps: list[str], least: int = 1, most: int | None = None, start: DataFrame | None = None) -> DataFrame:
    """``s, o``: nodes joined by a path of ``least`` to ``most`` steps, each of a predicate in ``steps``, ``^p`` for p backwards.

    Semi-naive: a round only goes on from what the one before has found. ``start``: ``s``,
    nodes to begin at (all by default). ``least`` 0 adds every node to itself.
    """
    ways = [(p[1:], True) if p.startswith("^") else (p, False) for p in steps]
    edges = None
    for predicate, back in ways:
        own = triples.filter(F.col("p") == predicate).select((F.col("o") if back else F.col("s")).alias("a"), (F.col("s") if back else F.col("o")).alias("b"))
        edges = own if edges is None else edges.union(own)
    edges = cut(edges.distinct())
    if start is None:
        nodes = edges.select(F.col("a").alias("s")).union(edges.select("b")).distinct()
    else:
        nodes = start.select("s").distinct()
    fresh = nodes.select("s", F.col("s").alias("o"))
    found, n = (fresh if least == 0 else None), 0
    while most is None or n < most:
        n += 1
        fresh = fresh.join(edges.withColumnRenamed("a", "o"), "o").select("s", F.col("b").alias("o")).distinct()
        # Before ``least`` steps the same pair may be met again later on.
        if found is not None and n >= least:
            fresh = fresh.join(found, ["s", "o"], "left_anti")
        fresh = cut(fresh)
        if fresh.isEmpty():
            break
        if n >= least:
            found = fresh if found is None else found.union(fresh)
    return nodes.limit(0).select("s", F.col("s").alias("o")) if found is None else found


def select(solutions: DataFrame, names: list[str], limit: int = MOST_ROWS) -> DataFrame:
    """Distinct solutions of some variables, in order, up to a limit."""
    if not 1 <= limit <= MOST_ROWS:
        raise ValueError(f"between 1 and {MOST_ROWS} rows")
    return solutions.select(*names).distinct().orderBy(*names).limit(limit)


def ask(solutions: DataFrame) -> DataFrame:
    """One row: whether there is a solution."""
    return solutions.limit(1).agg((F.count(F.lit(1)) > 0).alias("answer"))
