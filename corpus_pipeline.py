"""The corpus pipeline: five stages over ``documents``, each by one operator.

Toxic documents go, then those that a quality rule rejects, then all but one of
every group of near copies (five-word shingles, similarity 0.8); strings that an
earlier document has are cut out of the texts; what is left is packed into
sequences. Every stage works on all rows that the one before kept, and all but
the last return the columns of ``documents``.

Rows that share an id, or have none, are told apart by their texts; of rows with
the same id and text one stays in the near-copy stage. Null texts are rejected by
quality. An empty table passes all stages. Texts of any length are worked on whole.
Further columns of any name are carried through to the last stage; names of columns
that a stage adds for itself give way to them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsa.llm import packing, quality, simhash, suffix, toxicity
from palimpsa.llm.common import fresh_names
from palimpsa.operators.recovery import cut, remove_path, scratch_dir


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicates_wide(docs, shingle=5, similarity=0.8)
    mark, first_id, first_hash = fresh_names(docs, "text_mark", "first_id", "first_hash")
    first = groups.filter("first").select(F.col("doc_id").alias(first_id), F.col("text_hash").alias(first_hash)).distinct()
    marked = docs.withColumn(mark, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")))
    kept = marked.join(first, (F.col(mark) == F.col(first_hash)) & F.col("doc_id").cast("long").eqNullSafe(F.col(first_id)), "left_semi")
    return kept.dropDuplicates(["doc_id", mark]).select(*docs.columns)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    folder = scratch_dir(spark, "repeats")
    out = suffix.without_repeats(docs, folder)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    out = cut(out)
    remove_path(spark, folder)
    return out


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality", quality_stage),
    ("near copies", near_copies_stage),
    ("repeated strings", repeats_stage),
    ("packing", packing_stage),
]
#: Fingerprints, byte spans and tokens are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    folder = scratch_dir(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        if i:
            remove_path(spark, f"{folder}/{i - 1}")
        docs = spark.read.parquet(f"{folder}/{i}")
    out = cut(docs)
    remove_path(spark, folder)
    return out
