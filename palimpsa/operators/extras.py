"""Smaller operators: projections, rank weights, sets, paths, validation, redirects."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import windows
from .identity import held_values
from .recovery import dealt


def search_projection(docs: DataFrame, id_col: str, text_col: str, size: int = 6000, overlap: int = 400) -> DataFrame:
    """One row per text window with a stable vector id."""
    rows = docs.select(F.col(id_col), F.explode(windows(F.col(text_col), size, overlap)).alias("w"))
    key = F.concat_ws(":", F.col(id_col).cast("string"), F.col("w.ordinal").cast("string"))
    return rows.select(id_col, "w.ordinal", F.sha2(key, 256).alias("vector_id"), F.left("w.text", F.lit(160)).alias("head"))


def fingerprint(*columns: str) -> Column:
    """Hash of a row's canonical JSON."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def lifecycle(rows: DataFrame, key: str, sets: list[tuple[str, DataFrame]], otherwise: Column) -> DataFrame:
    """State of each row: the first set that has its key, else a column."""
    state = otherwise
    for name, members in reversed(sets):
        rows = rows.join(members.select(key).distinct().withColumn(f"in_{name}", F.lit(True)), key, "left")
        state = F.when(F.col(f"in_{name}"), name).otherwise(state)
    return rows.withColumn("state", state)


def evidence_recall(gold: DataFrame, found: DataFrame, question: str, item: str) -> DataFrame:
    """Mean over questions of the share of gold items found."""
    wanted = gold.select(question, item, F.lit(True).alias("gold"))
    met = found.select(question, item, F.lit(False).alias("gold")).filter(F.col(question).isNotNull() & F.col(item).isNotNull())
    # One dealing by question serves both groupings; nothing is joined.
    items = dealt(wanted.unionByName(met), question).groupBy(question, item).agg(F.bool_or("gold").alias("gold"), F.bool_or(~F.col("gold")).alias("hit"))
    each = items.filter("gold").groupBy(question).agg((F.count_if("hit") / F.count(F.lit(1))).alias("r"))
    return each.agg(F.round(F.avg("r"), 6).alias("recall"))


def keyword_weights(text: Column, query: str, most_tokens: int = 32, most_pairs: int = 64) -> Column:
    """Presence weights: phrase 10, words 1, character pairs 1 / (n + 1)."""
    low, q = F.lower(text), query.lower()
    has = lambda part, weight: F.when(F.contains(low, F.lit(part)), weight).otherwise(0.0)
    out = has(q, 10.0)
    for w in list(dict.fromkeys(q.split()))[:most_tokens]:
        out = out + has(w, 1.0)
    pairs = list(dict.fromkeys(q[i : i + 2] for i in range(len(q) - 1)))[:most_pairs]
    total = F.lit(0.0)
    for p in pairs:
        total = total + has(p, 1.0)
    return out + total / (len(pairs) + 1)


def trigram_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of padded trigrams."""

    def grams(c: Column) -> Column:
        padded = F.concat(F.lit("  "), c, F.lit(" "))
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))

    x, y = grams(a), grams(b)
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def progressive(docs: DataFrame, steps: list[Callable[[DataFrame], DataFrame]], gate: DataFrame | None, key: str) -> DataFrame:
    """Up to seven steps, each of which narrows the candidates of the one before."""
    if len(steps) > 7:
        raise ValueError("seven steps at most")
    for step in steps:
        docs = step(docs)
    return docs if gate is None else docs.join(gate, key, "left_semi")


def maximal_sets(sets: DataFrame, column: str) -> DataFrame:
    """Distinct sets that are no proper subset of another.

    A set meets the sets that have its rarest member, so a member that most sets
    have brings no pairs. The empty set stays only where there is no other.
    """
    d = sets.select(F.col(column).alias("v")).distinct()
    a = d.select("v", F.explode("v").alias("m"))
    a = a.join(a.groupBy("m").agg(F.count(F.lit(1)).alias("n")), "m").groupBy("v").agg(F.min_by("m", F.struct("n", "m")).alias("m"))
    b = d.select(F.col("v").alias("w"), F.explode("v").alias("m"))
    covered = a.join(b, "m").filter((F.size("w") > F.size("v")) & (F.size(F.array_except("v", "w")) == 0)).select("v").distinct()
    kept = d.join(covered, "v", "left_anti")
    others = kept.filter(F.size("v") > 0)
    empty = kept.filter(F.size("v") == 0).join(others.limit(1).select(F.lit(True).alias("other")), F.lit(True), "left_anti")
    return others.unionByName(empty).select(F.col("v").alias(column))


def paths(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """``seed, node, path, hops``: forward paths that visit no node twice."""
    level = seeds.select(F.col(seeds.columns[0]).alias("seed"), F.col(seeds.columns[0]).alias("node"), F.array(seeds.columns[0]).alias("trail"))
    out = None
    for n in range(1, hops + 1):
        level = level.join(edges.select(F.col("src").alias("node"), "dst"), "node").filter(~F.array_contains("trail", F.col("dst")))
        level = level.select("seed", F.col("dst").alias("node"), F.concat("trail", F.array("dst")).alias("trail"))
        rows = level.select("seed", "node", F.array_join("trail", ">").alias("path"), F.lit(n).alias("hops"))
        out = rows if out is None else out.unionByName(rows)
    return out


def tree(edges: DataFrame, root: str, depth: int, children: int) -> DataFrame:
    """``node, depth, parent``: a tree below the root with bounded children."""
    level, out = None, None
    for n in range(1, depth + 1):
        found = edges.filter(F.col("parent") == root) if level is None else edges.join(level.select(F.col("node").alias("parent")), "parent")
        placed = found.withColumn("place", F.row_number().over(W.partitionBy("parent").orderBy("node"))).filter(F.col("place") <= children)
        level = placed.select("node", F.lit(n).alias("depth"), "parent")
        out = level if out is None else out.unionByName(level)
    return out


def combined_state(rows: DataFrame, key: str, state: str) -> DataFrame:
    """One state per key: the common one, or conflict."""
    return rows.groupBy(key).agg(
        F.when(F.count_distinct(state) > 1, "conflict").otherwise(F.min(state)).alias("state"), F.count(F.lit(1)).alias("occurrences")
    )


def max_count_violations(rows: DataFrame, owner: list[str], predicate: str, most: int) -> DataFrame:
    """Owners with predicates that have more values than allowed."""
    each = rows.groupBy(*owner, predicate).agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > most)
    return each.groupBy(*owner).agg(F.count(F.lit(1)).alias("n"))


def held_at_boundaries(rows: DataFrame, owner: str, value: str, start: str, end: str) -> DataFrame:
    """Per owner and boundary instant the number of values that hold there."""
    return held_values(rows, [owner], value, start, end, ends_too=True).filter("held > 0")


def redirect(rows: DataFrame, mapping: DataFrame, column: str, name: str) -> DataFrame:
    """Ids replaced by what they were merged into."""
    m = mapping.select(F.col("old").alias(column), F.col("new"))
    return rows.join(m, column, "left").withColumn(name, F.coalesce("new", column)).drop("new")


def reclassify(rows: DataFrame, column: str, vocabulary: DataFrame, renames: DataFrame) -> DataFrame:
    """Rows with ``action``: carry a term that stays, rename one with a single successor, else unmapped."""
    have = vocabulary.select(F.col("term").alias(column)).distinct().withColumn("stays", F.lit(True))
    one = renames.join(vocabulary.select(F.col("term").alias("dst")), "dst", "left_semi").groupBy(F.col("src").alias(column)).agg(F.count_distinct("dst").alias("ways"))
    out = rows.join(have, column, "left").join(one, column, "left")
    return out.withColumn("action", F.when(F.col("stays"), "carry").when(F.col("ways") == 1, "rename").otherwise("unmapped"))
