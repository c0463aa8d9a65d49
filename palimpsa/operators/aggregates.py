"""Directories and summaries over qualified records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def counts_by(records: DataFrame, keys: list[str], **more: Column) -> DataFrame:
    """Records per group, with further conditional counts."""
    return records.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(k) for k, c in more.items()])


def sample_groups(records: DataFrame, keys: list[str], order: list[str], shown: str, limit: int) -> DataFrame:
    """Per group its size and the first ``limit`` ids, as an ordered list joined by commas."""
    placed = records.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    few = placed.filter(F.col("place") <= limit).groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("place", F.col(shown).cast("string").alias("v")))).alias("s")
    )
    sizes = records.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    return sizes.alias("a").join(few.alias("b"), same).select(
        *[F.col(f"a.{k}") for k in keys], "n", F.array_join(F.transform("s", lambda x: x["v"]), ",").alias("samples")
    )


def top_per_group(rows: DataFrame, keys: list[str], order: list[Column | str], limit: int) -> DataFrame:
    """The first rows of each group with ``place`` and the group's size ``total``."""
    own = W.partitionBy(*keys)
    ranked = rows.withColumns({"place": F.row_number().over(own.orderBy(*order)), "total": F.count(F.lit(1)).over(own)})
    return ranked.filter(F.col("place") <= limit)


def _leaves(v: Column, path: Column | None, depth: int) -> Column:
    """``array<struct<path, value>>`` of an object's fields, objects within it opened down to ``depth``."""
    fields = F.filter(F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")), lambda e: ~F.startswith(e["key"], F.lit("_")))

    def one(e: Column) -> Column:
        name = e["key"] if path is None else F.concat_ws(".", path, e["key"])
        leaf = F.array(F.struct(name.alias("path"), F.to_json(e["value"]).alias("value")))
        inner = F.slice(leaf, 1, 0) if depth == 1 else _leaves(e["value"], name, depth - 1)
        return F.when(F.schema_of_variant(e["value"]).startswith("OBJECT"), inner).otherwise(leaf)

    return F.flatten(F.transform(fields, one))


def metadata_facets(rows: DataFrame, json_col: str, type_col: str, depth: int = 5) -> DataFrame:
    """``path, records, types, distinct_values``: what metadata fields there are.

    Equal metadata is opened once and weighed by its records; fields that begin with _ are left out.
    """
    weighed = rows.filter(F.col(json_col).isNotNull()).groupBy(F.col(type_col).alias("type"), F.col(json_col).alias("j")).agg(F.count(F.lit(1)).alias("n"))
    v = F.try_parse_json("j")
    opened = weighed.filter(F.schema_of_variant(v).startswith("OBJECT")).select("type", "n", F.explode(_leaves(v, None, depth)).alias("x"))
    return opened.groupBy(F.col("x.path").alias("path")).agg(
        F.sum("n").alias("records"),
        F.array_join(F.sort_array(F.collect_set("type")), ",").alias("types"),
        F.count_distinct("x.value").alias("distinct_values"),
    )


def usage(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Per predicate the tally of end point types and of missing ends."""
    types = entities.select("id", "type")
    a, b = types.select(F.col("id").alias("src"), F.col("type").alias("src_type")), types.select(F.col("id").alias("dst"), F.col("type").alias("dst_type"))
    return (
        relations.join(a, "src", "left")
        .join(b, "dst", "left")
        .groupBy(F.col("type").alias("predicate"), F.coalesce("src_type", F.lit("?")).alias("src_type"), F.coalesce("dst_type", F.lit("?")).alias("dst_type"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def precision_recall(gold: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Set precision, recall and F1; nothing found or wanted counts as zero."""
    a = gold.select(*keys).distinct().withColumn("g", F.lit(1))
    b = found.select(*keys).distinct().withColumn("f", F.lit(1))
    n = a.join(b, keys, "full").agg(
        F.count_if(F.col("g").isNotNull() & F.col("f").isNotNull()).alias("hit"), F.count("g").alias("gold"), F.count("f").alias("found")
    )
    ratio = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    p, r = ratio(F.col("hit"), F.col("found")), ratio(F.col("hit"), F.col("gold"))
    return n.select("hit", "gold", "found", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(ratio(2 * p * r, p + r), 6).alias("f1"))
