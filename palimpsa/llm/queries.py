"""Registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, hmm, linkgraph, packing, periodic, quality, records, simhash, spelling, suffix, toxicity
from .common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.round_trip(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.report(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations"))


def op10_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.scores(table(spark, sf_dir, "documents"))


def op11_linkgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkgraph.verdicts(table(spark, sf_dir, "pages"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.periodic_runs(table(spark, sf_dir, "documents"), plant=True)


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_records": op2_records,
    "op3_quality": op3_quality,
    "op4_bpe": op4_bpe,
    "op5_repeats": op5_repeats,
    "op6_toxicity": op6_toxicity,
    "op7_packing": op7_packing,
    "op8_ann": op8_ann,
    "op9_chat": op9_chat,
    "op10_hmm": op10_hmm,
    "op11_linkgraph": op11_linkgraph,
    "op12_spelling": op12_spelling,
    "op13_periodic": op13_periodic,
}
ORACLE_SQL: dict[str, str] = {"op3_quality": quality.SQL, "op9_chat": chat.SQL, "op11_linkgraph": linkgraph.SQL, "op12_spelling": spelling.SQL}
