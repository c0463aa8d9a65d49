"""Resolution of entities, applicability contexts, and conflicts within them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .identity import held_values


def key_matches(keys: DataFrame) -> DataFrame:
    """``left, right, shared, differing``: entities with a common identity key.

    ``keys``: id, scheme, value. Pairs meet through the first holder of a value
    (a star, not all pairs); ``differing`` says that another scheme's values clash.
    """
    first = keys.groupBy("scheme", "value").agg(F.min("id").alias("left"))
    stars = keys.join(first, ["scheme", "value"]).filter("id <> left").groupBy("left", F.col("id").alias("right")).agg(F.count_distinct("scheme").alias("shared"))
    one = lambda side: keys.select(F.col("id").alias(side), "scheme", F.col("value").alias(f"{side}_value"))
    clash = stars.join(one("left"), "left").join(one("right"), ["right", "scheme"]).groupBy("left", "right", "scheme")
    clash = clash.agg(F.bool_or(F.col("left_value") == F.col("right_value")).alias("same")).filter("not same").select("left", "right").distinct()
    return stars.join(clash.withColumn("differing", F.lit(True)), ["left", "right"], "left").withColumn("differing", F.coalesce("differing", F.lit(False)))


def compatible(a: str, b: str) -> F.Column:
    """Same type and identity scope, no key conflict, and a policy, a strong key or one source boundary that joins them."""
    same = lambda c: F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    joined = (F.col(f"{a}.policy") == "reference") | F.coalesce(F.col("shared") > 0, F.lit(False)) | same("source")
    return same("type") & same("scope") & ~F.coalesce(F.col("differing"), F.lit(False)) & joined


def near_names(rows: DataFrame, name: str, text: str, least: float = 0.7, most: int = 12) -> DataFrame:
    """``id, name, score`` of the entities nearest to a text by character pairs, best first."""
    from .extras import trigram_similarity

    scored = rows.withColumn("score", F.round(trigram_similarity(F.lower(name), F.lit(text.lower())), 6)).filter(F.col("score") >= least)
    return scored.orderBy(F.desc("score"), "id").limit(most).select("id", name, "score")


def merge_inputs(members: DataFrame, relations: DataFrame, most: int = 2000) -> tuple[DataFrame, bool]:
    """Entities that a merge touches: members and the other ends of their facts, ``most`` at most; and whether that was too few."""
    m = members.select("id").distinct()
    out = relations.join(m.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id"))
    back = relations.join(m.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id"))
    every = m.union(out).union(back).distinct()
    few = every.orderBy("id").limit(most + 1)
    return few.limit(most), few.count() > most


def contexts(rows: DataFrame, key: str, dimensions: dict[str, str], most: int = 256) -> DataFrame:
    """``key, context``: products of the values of the applicability dimensions (arrays; null or empty: all).

    A context is ``dimension=value`` joined by ``;``. Keys with more than ``most`` contexts are an error of the input and get the context ``too many``.
    """
    sizes, out = F.lit(1), rows
    for column in dimensions.values():
        sizes = sizes * F.greatest(F.coalesce(F.size(F.array_distinct(column)), F.lit(1)), F.lit(1))
    fits = out.filter(sizes <= most)
    tagged = lambda name: lambda v: F.concat(F.lit(f"{name}="), v)
    for i, (name, column) in enumerate(dimensions.items()):
        values = F.when(F.coalesce(F.size(column), F.lit(0)) > 0, F.array_distinct(column)).otherwise(F.array(F.lit("*")))
        fits = fits.withColumn(f"_c{i}", F.explode(F.transform(values, tagged(name))))
    named = fits.select(key, F.concat_ws(";", *[f"_c{i}" for i in range(len(dimensions))]).alias("context"))
    return named.unionByName(out.filter(sizes > most).select(key, F.lit("too many").alias("context"))).distinct()


def conflicts_in_contexts(rows: DataFrame, owner: list[str], scope: str, value: str, start: str, end: str) -> DataFrame:
    """Conflicts of values within each applicability: disjoint scopes do not conflict.

    ``scope`` is an array of values, null or empty for all. A value that holds for
    all meets every scope that the owner's rows name, and those that hold for all.
    """
    named = rows.withColumn("scope_", F.explode_outer(F.when(F.size(scope) > 0, F.col(scope))))
    own = named.filter("scope_ is not null").select(*owner, "scope_").distinct().unionByName(rows.select(*owner).distinct().withColumn("scope_", F.lit("*")))
    everywhere = named.filter("scope_ is null").drop("scope_").join(own, owner)
    both = named.filter("scope_ is not null").unionByName(everywhere.select(*named.columns))
    return held_values(both, [*owner, "scope_"], value, start, end).filter("held > 1").withColumnsRenamed({"held": "values", "scope_": "context"})


def conflict_sets(rows: DataFrame, owner: list[str], value: str) -> DataFrame:
    """``owner, members, values, conflict_id``: owners whose accepted rows differ, with a digest of the distinct values."""
    each = rows.groupBy(*owner, value).agg(F.count(F.lit(1)).alias("n"))
    out = each.groupBy(*owner).agg(F.sum("n").alias("members"), F.count(F.lit(1)).alias("values"), F.sort_array(F.collect_list(F.col(value).cast("string"))).alias("v"))
    return out.filter("values > 1").withColumn("conflict_id", F.left(F.sha2(F.array_join("v", ","), 256), F.lit(32))).drop("v")


def type_lineage(mappings: DataFrame, key: str, order: list[str], kind: str) -> DataFrame:
    """``key, first_type, changed``: the first accepted mapping fixes a type; whether later ones differ."""
    first = F.min_by(kind, F.struct(*order)).alias("first_type")
    return mappings.groupBy(key).agg(first, (F.count_distinct(kind) > 1).alias("changed"))


def fact_contexts(entities: DataFrame, facts: DataFrame, context: str) -> DataFrame:
    """``id, contexts, facts``: the contexts of the facts at each entity."""
    ends = facts.select(F.col("src").alias("id"), F.col(context)).unionByName(facts.select(F.col("dst").alias("id"), F.col(context)))
    each = ends.groupBy("id", context).agg(F.count(F.lit(1)).alias("n")).groupBy("id")
    return entities.select("id").join(each.agg(F.array_join(F.array_sort(F.collect_list(context)), ",").alias("contexts"), F.sum("n").alias("facts")), "id", "left")


def pending_structure(entities: DataFrame, relations: DataFrame, known_types: DataFrame) -> DataFrame:
    """``id, reason``: records whose own type, or the type of an end, is in no ontology."""
    unknown = entities.join(known_types.select("type").distinct(), "type", "left_anti").select("id")
    own = unknown.select("id", F.lit("own type").alias("reason"))
    ends = relations.join(unknown.withColumnRenamed("id", "src"), "src", "left_semi").select("edge").union(
        relations.join(unknown.withColumnRenamed("id", "dst"), "dst", "left_semi").select("edge")
    )
    return own.unionByName(ends.distinct().select(F.col("edge").alias("id"), F.lit("type of an end").alias("reason")))


def vocabulary(terms: DataFrame, baseline: DataFrame, least: int = 2) -> DataFrame:
    """``term, n, canonical, diagnosis`` of discovered terms: known, collision (several baseline terms), rare, variant or new.

    ``terms``: term, n; ``baseline``: label, iri. Variants of one folded form go to the most frequent spelling.
    """
    fold = lambda c: F.regexp_replace(F.lower(F.trim(c)), "[\\s_-]+", " ")
    base = baseline.groupBy(fold(F.col("label")).alias("k")).agg(F.min("iri").alias("iri"), F.count_distinct("iri").alias("ways"))
    own = W.partitionBy("k")
    out = terms.withColumn("k", fold(F.col("term"))).join(base, "k", "left")
    out = out.withColumns({"canonical": F.first("term").over(own.orderBy(F.desc("n"), "term")), "total": F.sum("n").over(own)})
    diagnosis = F.when(F.col("ways") == 1, "known").when(F.col("ways") > 1, "collision").when(F.col("total") < least, "rare")
    return out.select("term", "n", F.coalesce(F.when(F.col("ways") == 1, F.col("iri")), F.col("canonical")).alias("canonical"), F.coalesce(diagnosis, F.when(F.col("term") != F.col("canonical"), "variant"), F.lit("new")).alias("diagnosis"))


def clusters(candidates: DataFrame, priority: list[str]) -> DataFrame:
    """``type, k, members, status, unresolved``: candidates of one folded type and text, with the leading status of the list."""
    rank = F.coalesce(F.array_position(F.array(*[F.lit(p) for p in priority]), F.col("status")), F.lit(0))
    place = F.when(rank > 0, rank).otherwise(len(priority) + 1)
    key = [F.lower("type").alias("type"), F.lower(F.trim("text")).alias("k")]
    return candidates.groupBy(*key).agg(F.count(F.lit(1)).alias("members"), F.min_by("status", place).alias("status"), F.count_if(F.col("status") == "pending").alias("unresolved"))
