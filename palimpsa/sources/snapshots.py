"""Snapshot folders: Parquet tables behind a manifest that is written last."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def export(tables: dict[str, DataFrame], path: str) -> None:
    """Writes the tables, then the manifest with their schemas and counts."""
    spark = next(iter(tables.values())).sparkSession
    rows = []
    for name, frame in tables.items():
        frame.write.mode("overwrite").parquet(f"{path}/{name}")
        rows.append((name, frame.schema.json(), spark.read.parquet(f"{path}/{name}").count()))
    spark.createDataFrame(rows, "name string, schema string, n long").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def restore(spark: SparkSession, path: str, closed: set[str] | None = None) -> dict[str, DataFrame]:
    """The tables of a snapshot; ValueError if one is missing, changed or not allowed."""
    found = spark.read.schema("name string, schema string, n long").json(f"{path}/manifest").collect()
    if closed is not None and {r["name"] for r in found} != closed:
        raise ValueError("the snapshot has other tables")
    out = {}
    for r in found:
        schema = StructType.fromJson(json.loads(r["schema"]))
        frame = spark.read.schema(schema).parquet(f"{path}/{r['name']}")
        if frame.count() != r["n"]:
            raise ValueError(f"{r['name']} is incomplete")
        out[r["name"]] = frame
    return out


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, sha256, text``: whole text files, addressed by content."""
    rows = spark.read.format("binaryFile").load(path)
    return rows.select("path", F.sha2("content", 256).alias("sha256"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def upsert_by_key(current: DataFrame, changes: DataFrame, key: list[str], order: str) -> DataFrame:
    """The state after a batch of changes: the last row of each key wins."""
    both = current.unionByName(changes)
    rest = [c for c in both.columns if c not in key]
    return both.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("s")).select(*key, "s.*")
