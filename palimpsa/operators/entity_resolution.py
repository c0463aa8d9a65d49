"""Mentions resolved to entities: strong keys, then exact names, then nearness within one source.

All of it happens within a type and an identity scope. Candidates meet by equal keys
or names; entities that are alike in everything that matters there (source, keys) count
as one row, so a common name is no product of all mentions and all entities. Vectors
are only compared within type, scope and source, block by block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entities of a block that a task compares at a time.
BLOCK_ROWS = 4096
DIGITS = 9


def _fold(c: Column) -> Column:
    return F.lower(F.trim(c))


def _conflict(a: Column, b: Column) -> Column:
    """Whether two key maps have different values of one scheme."""
    return F.exists(F.map_keys(a), lambda k: F.coalesce(F.element_at(a, k) != F.element_at(b, k), F.lit(False)))


def _shares(a: Column, b: Column) -> Column:
    return F.exists(F.map_keys(a), lambda k: F.element_at(b, k).isNotNull())


def pairs_by_key(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """``mention, id``: pairs with an equal value of a scheme, in one type and scope; only pairs without a conflict.

    ``mentions``: mention, type, scope, keys; ``entities``: id, type, scope, keys (maps from scheme to value).
    """
    each = lambda rows, name: rows.select(F.col(name), "type", "scope", F.col("keys").alias(f"{name}_keys"), F.explode("keys").alias("scheme", "value"))
    both = each(mentions, "mention").join(each(entities, "id"), ["type", "scope", "scheme", "value"])
    return both.filter(~_conflict(F.col("mention_keys"), F.col("id_keys"))).select("mention", "id").distinct()


def key_conflicts(entities: DataFrame) -> DataFrame:
    """``component, scheme, n_values``: groups of entities that equal keys join, and the schemes in which they differ.

    One aggregate per component and scheme, so no pair of holders is missed and none is built.
    """
    from .components import connected_components

    keys = entities.select("id", F.explode("keys").alias("scheme", "value"))
    first = keys.groupBy("scheme", "value").agg(F.min("id").alias("first"))
    links = keys.join(first, ["scheme", "value"]).filter("id <> first").select("id", "first")
    groups = connected_components(links, "id", "first")
    own = keys.join(groups.withColumnRenamed("node", "id"), "id")
    return own.groupBy("component", "scheme").agg(F.count_distinct("value").alias("n_values")).filter("n_values > 1")


def nearest(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """``mention, near, score``: the entity with the highest cosine in one type, scope and source, without a key conflict.

    Ties (in the first nine digits) go to the smaller id. Blocks are cut into pieces of
    BLOCK_ROWS entities, which mentions of the block are sent to.
    """
    block = ["type", "scope", "source"]
    keyed = entities.filter("vector is not null").select("id", *block, "vector", "keys")
    sizes = keyed.groupBy(*block).agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("pieces"))
    pieced = keyed.join(sizes, block).withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int")).drop("pieces")
    asked = mentions.filter("vector is not null").select("mention", *block, "vector", "keys").join(sizes, block)
    asked = asked.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).drop("pieces")
    kinds = f"mention {dict(mentions.dtypes)['mention']}, near {dict(entities.dtypes)['id']}, score double"

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(left) and len(right):
            right = right.sort_values("id").reset_index(drop=True)
            unit = lambda v: (lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300))(np.stack(v).astype(np.float64))
            e, keys = unit(right["vector"]), [dict(k) if k is not None else {} for k in right["keys"]]
            for lo in range(0, len(left), 1024):
                part = left.iloc[lo : lo + 1024]
                scores = np.round(unit(part["vector"]) @ e.T, DIGITS)
                for mention, own, row in zip(part["mention"], part["keys"], scores, strict=True):
                    own = dict(own) if own is not None else {}
                    if own:
                        row = row.copy()
                        row[[any(k in x and x[k] != v for k, v in own.items()) for x in keys]] = -2
                    at = int(row.argmax())
                    if row[at] > -2:
                        rows.append((mention, right["id"][at], float(row[at])))
        return pd.DataFrame(rows, columns=["mention", "near", "score"])

    groups = [*block, "piece"]
    named = pieced.toDF(*[c if c in ("id", "vector", "keys") else f"e_{c}" for c in pieced.columns])
    best = asked.groupBy(*groups).cogroup(named.groupBy(*[f"e_{c}" for c in groups])).applyInPandas(compare, kinds)
    return best.groupBy("mention").agg(F.min_by(F.struct("near", "score"), F.struct(-F.col("score"), F.col("near"))).alias("b")).select("mention", "b.near", "b.score")


def resolve(mentions: DataFrame, entities: DataFrame, review: float = 0.72, merge: float = 0.88) -> DataFrame:
    """``mention, outcome, entity, score, reason`` of every mention.

    ``mentions``: mention, type, scope, source, name, keys (map), vector, mode (``reference``
    or other); ``entities``: id, type, scope, source, name, aliases, keys, vector. Keys are
    those that the type's policy registers. An entity is compatible if no key conflicts
    and a reference policy, a strong key or the same source joins the two. A strong key
    comes before a name; several matches, an equal name with a conflicting key, and
    likeness under a reference policy go to review; likeness never crosses a source.
    """
    if not 0 <= review < merge <= 1:
        raise ValueError("0 <= review < merge <= 1")
    none = F.create_map().cast("map<string,string>")
    m = mentions.withColumns({"keys": F.coalesce("keys", none), "folded": _fold(F.col("name"))})
    e = entities.withColumn("keys", F.coalesce("keys", none))
    # Entities of a name that no test can tell apart are one row with their number.
    sorted_keys = F.array_sort(F.map_entries("keys"))
    names = e.select("id", "type", "scope", "source", sorted_keys.alias("k"), F.explode(F.array_distinct(F.transform(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))), _fold))).alias("folded"))
    names = names.filter("folded <> ''").groupBy("type", "scope", "source", "k", "folded").agg(F.min("id").alias("id"), F.max("id").alias("last"))
    named = m.select("mention", "type", "scope", F.col("source").alias("own"), "mode", "keys", "folded").join(names, ["type", "scope", "folded"])
    other = F.map_from_entries("k")
    clash, shared = _conflict(F.col("keys"), other), _shares(F.col("keys"), other)
    joined = F.coalesce(F.col("mode") == "reference", F.lit(False)) | shared | F.col("own").eqNullSafe(F.col("source"))
    named = named.withColumns({"clash": clash, "fits": ~clash & joined})
    by_name = named.groupBy("mention").agg(
        F.bool_or("clash").alias("name_clash"), F.min(F.when(F.col("fits"), F.col("id"))).alias("name_first"), F.max(F.when(F.col("fits"), F.col("last"))).alias("name_last")
    )
    by_key = pairs_by_key(m, e).groupBy("mention").agg(F.min("id").alias("key_first"), F.max("id").alias("key_last"))
    near = nearest(m, e)
    block = ["type", "scope", "source"]
    there = e.groupBy(*block).agg(F.collect_set(sorted_keys).alias("kinds"))
    eligible = m.join(there, block).select("mention", F.exists("kinds", lambda k: ~_conflict(F.col("keys"), F.map_from_entries(k))).alias("eligible"))
    rows = m.select("mention", "mode").join(by_name, "mention", "left").join(by_key, "mention", "left").join(near, "mention", "left").join(eligible, "mention", "left")
    strong = F.col("key_first").isNotNull()
    first, last = F.when(strong, F.col("key_first")).otherwise(F.col("name_first")), F.when(strong, F.col("key_last")).otherwise(F.col("name_last"))
    reference = F.coalesce(F.col("mode") == "reference", F.lit(False))
    reason = (
        F.when(first != last, "ambiguous_exact_identity")
        .when(strong, "strong_identity_key")
        .when(first.isNotNull(), "exact_name_or_alias")
        .when(F.col("name_clash"), "conflicting_identity_key")
        .when(~F.coalesce("eligible", F.lit(False)), "no_compatible_candidate")
        .when(F.col("score").isNull(), "no_semantic_candidate")
        .when(reference & (F.col("score") >= review), "reference_similarity_requires_review")
        .when(F.col("score") >= merge, "semantic_high_band")
        .when(F.col("score") >= review, "semantic_gray_band")
        .otherwise("semantic_low_band")
    )
    exact = reason.isin("strong_identity_key", "exact_name_or_alias")
    by_score = reason.isin("reference_similarity_requires_review", "semantic_high_band", "semantic_gray_band", "semantic_low_band")
    outcome = (
        F.when(exact | (reason == "semantic_high_band"), "aligned")
        .when(reason.isin("ambiguous_exact_identity", "conflicting_identity_key", "reference_similarity_requires_review", "semantic_gray_band"), "review")
        .otherwise("separate")
    )
    return rows.select("mention", outcome.alias("outcome"), F.when(exact, first).when(by_score, F.col("near")).alias("entity"), F.when(exact, F.lit(1.0)).when(by_score, F.col("score")).alias("score"), reason.alias("reason"))
