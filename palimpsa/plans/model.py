"""The driver's tables as records: versions, entities, relations, decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.versions import append_versions


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as versions of ``user:type`` records, with a business interval."""
    events = table(spark, sf_dir, "events")
    log = events.select(
        F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("id"),
        "event_id",
        "ts",
        "event_type",
        "value",
        "props",
    )
    rows = append_versions(log, ["id"], ["ts", "event_id"], "ts")
    day = F.date_trunc("day", F.col("ts")).cast("timestamp_ntz")
    start = F.when(F.col("event_id") % 10 != 0, day)
    end = F.when(F.col("event_id") % 4 != 0, day + F.make_dt_interval(F.col("event_id") % 7 + 1))
    return rows.withColumns({"valid_from": start, "valid_until": end, "version_id": F.concat_ws("#", "id", "version")})


VERSIONS_SQL = """
v AS (
  SELECT user_id || ':' || event_type AS id, event_id, ts, event_type, value, props,
         row_number() OVER w AS version, ts AS recorded_at, lead(ts) OVER w AS superseded_at,
         CASE WHEN event_id % 10 <> 0 THEN date_trunc('day', ts)::TIMESTAMP END AS valid_from,
         CASE WHEN event_id % 4 <> 0 THEN (date_trunc('day', ts) + to_days((event_id % 7 + 1)::INTEGER))::TIMESTAMP END AS valid_until
  FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)
)
"""


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as a decision log of their order, numbered from 1."""
    own = W.partitionBy("assertion_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    # Named before they are numbered: what follows by ``assertion_id`` is then dealt already.
    return table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "assertion_id").select(
        "assertion_id",
        F.row_number().over(own).alias("decision_version"),
        F.col("l_shipdate").alias("created_at"),
        F.when(F.col("l_linestatus") == "F", "accepted").otherwise("rejected").alias("to_status"),
        "l_partkey",
        "l_suppkey",
    )


DECISIONS_SQL = """
d AS (
  SELECT l_orderkey AS assertion_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice)::INTEGER AS decision_version, l_shipdate AS created_at,
         CASE WHEN l_linestatus = 'F' THEN 'accepted' ELSE 'rejected' END AS to_status, l_partkey, l_suppkey
  FROM lineitem
)
"""


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, suppliers, parts, nations and regions as ``id, type, text``."""
    out = None
    for name, key, text in (
        ("customer", "c_custkey", "c_name"),
        ("supplier", "s_suppkey", "s_name"),
        ("part", "p_partkey", "p_name"),
        ("nation", "n_nationkey", "n_name"),
        ("region", "r_regionkey", "r_name"),
    ):
        part = table(spark, sf_dir, name).select(
            F.concat(F.lit(f"{name}:"), F.col(key).cast("string")).alias("id"), F.lit(name).alias("type"), F.col(text).alias("text")
        )
        out = part if out is None else out.unionByName(part)
    return out


ENTITIES_SQL = """
e AS (
  SELECT 'customer:' || c_custkey AS id, 'customer' AS type, c_name AS text FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier', s_name FROM supplier
  UNION ALL SELECT 'part:' || p_partkey, 'part', p_name FROM part
  UNION ALL SELECT 'nation:' || n_nationkey, 'nation', n_name FROM nation
  UNION ALL SELECT 'region:' || r_regionkey, 'region', r_name FROM region
)
"""


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``edge, type, src, dst, valid_from`` between entities."""
    at = lambda prefix, c: F.concat(F.lit(f"{prefix}:"), F.col(c).cast("string"))
    none = F.lit(None).cast("timestamp_ntz")
    parts = [
        table(spark, sf_dir, "supplier").select(
            F.concat(F.lit("sn:"), F.col("s_suppkey").cast("string")).alias("edge"), F.lit("located_in").alias("type"),
            at("supplier", "s_suppkey").alias("src"), at("nation", "s_nationkey").alias("dst"), none.alias("valid_from"),
        ),
        table(spark, sf_dir, "customer").select(
            F.concat(F.lit("cn:"), F.col("c_custkey").cast("string")).alias("edge"), F.lit("located_in").alias("type"),
            at("customer", "c_custkey").alias("src"), at("nation", "c_nationkey").alias("dst"), none.alias("valid_from"),
        ),
        table(spark, sf_dir, "nation").select(
            F.concat(F.lit("nr:"), F.col("n_nationkey").cast("string")).alias("edge"), F.lit("part_of").alias("type"),
            at("nation", "n_nationkey").alias("src"), at("region", "n_regionkey").alias("dst"), none.alias("valid_from"),
        ),
        table(spark, sf_dir, "lineitem").select(
            F.concat_ws(":", F.lit("sp"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("edge"),
            F.lit("supplies").alias("type"), at("supplier", "l_suppkey").alias("src"), at("part", "l_partkey").alias("dst"),
            F.col("l_shipdate").alias("valid_from"),
        ),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


RELATIONS_SQL = """
r AS (
  SELECT 'sn:' || s_suppkey AS edge, 'located_in' AS type, 'supplier:' || s_suppkey AS src, 'nation:' || s_nationkey AS dst, NULL::TIMESTAMP AS valid_from FROM supplier
  UNION ALL SELECT 'cn:' || c_custkey, 'located_in', 'customer:' || c_custkey, 'nation:' || c_nationkey, NULL FROM customer
  UNION ALL SELECT 'nr:' || n_nationkey, 'part_of', 'nation:' || n_nationkey, 'region:' || n_regionkey, NULL FROM nation
  UNION ALL SELECT 'sp:' || l_orderkey || ':' || l_linenumber, 'supplies', 'supplier:' || l_suppkey, 'part:' || l_partkey, l_shipdate FROM lineitem
)
"""
