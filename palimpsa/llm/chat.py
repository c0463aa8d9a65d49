"""Chat formatting after collapsing cumulative snapshots.

A logged conversation is often stored again after every turn. Each turn gets a
rolling hash of its prefix; a conversation whose last hash is the hash of an
inner turn of another is a prefix of that one and goes (an anti-join), and of
equal conversations the smallest id stays. What is left is rendered.

The rolling hash is the running exclusive-or of two 64-bit hashes of (position,
role, text), so it depends on the order and needs no more than one pass.

Defined results: rows that repeat a turn entirely count once; different rows of
one turn follow one another by role and text; turns without a number come first;
null roles and texts are empty; every different row without a conversation id is a
conversation of one turn; conversations are compared by order, role and text, not by turn
numbers. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def turns_of(conversations: DataFrame) -> DataFrame:
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("own", F.when(F.col("conv_id").isNull(), F.md5(F.to_json(F.struct("turn", "role", "text")))).otherwise(""))


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """``conv_id, pos, n, h1, h2``: a row per turn, texts left behind as hashes."""
    marked = turns.select(
        "conv_id", "own", "turn", "role", F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit("second"), "text", "role").alias("b"),
        F.md5("text").alias("digest"),
    ).distinct()
    order = W.partitionBy("conv_id", "own").orderBy("turn", "role", "digest")
    placed = marked.select("conv_id", "own", "a", "b", F.row_number().over(order).alias("pos"))
    upto = W.partitionBy("conv_id", "own").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    return placed.select(
        "conv_id",
        "own",
        "pos",
        F.bit_xor(F.xxhash64("pos", "a", "b")).over(upto).alias("h1"),
        F.bit_xor(F.xxhash64("b", "pos", "a")).over(upto).alias("h2"),
        (F.lead("pos").over(W.partitionBy("conv_id", "own").orderBy("pos")).isNull()).alias("last"),
    )


def maximal(turns: DataFrame) -> DataFrame:
    """``conv_id, n_turns, n_copies`` of the conversations that are no prefix of another."""
    hashes = prefix_hashes(turns)
    whole = (
        hashes.filter("last")
        .groupBy("h1", "h2", F.col("pos").alias("n_turns"))
        .agg(F.min_by(F.struct("conv_id", "own"), F.struct(F.col("conv_id").isNull(), "conv_id", "own")).alias("first"), F.count(F.lit(1)).alias("n_copies"))
    )
    inner = hashes.filter("not last").select("h1", "h2", F.col("pos").alias("n_turns")).distinct()
    return whole.join(inner, ["h1", "h2", "n_turns"], "left_anti").select("first.conv_id", "first.own", "n_turns", "n_copies")


def harmless(text: Column) -> Column:
    """Marks of the template that occur in a text are broken up."""
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def render(conversations: DataFrame) -> DataFrame:
    """``conv_id, n_turns, n_copies, rendered`` of the maximal conversations."""
    turns = turns_of(conversations)
    kept = maximal(turns)
    turn = F.struct("turn", "role", F.md5("text").alias("digest"), "text")
    named = kept.withColumnsRenamed({"conv_id": "kept_id", "own": "kept_own"})
    rows = (
        turns.join(named, (F.col("own") == F.col("kept_own")) & F.col("conv_id").eqNullSafe(F.col("kept_id")))
        .groupBy("conv_id", "own", "n_turns", "n_copies")
        .agg(F.array_sort(F.collect_set(turn)).alias("turns"))
    )
    # array_sort has nulls last within a struct; turns without a number come first.
    first = F.filter("turns", lambda t: t["turn"].isNull())
    rest = F.filter("turns", lambda t: t["turn"].isNotNull())
    line = lambda t: F.concat(F.lit(START), harmless(t["role"]), F.lit("\n"), harmless(t["text"]), F.lit(END))
    text = F.array_join(F.transform(F.concat(first, rest), line), "\n")
    return rows.select("conv_id", "n_turns", "n_copies", text.alias("rendered"))


SQL = r"""
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         CASE WHEN conv_id IS NULL THEN coalesce(turn::VARCHAR, '-') || ':' || md5(coalesce(role, '')) || md5(coalesce(text, '')) END AS own FROM conversations
), l AS (
  SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY turn NULLS FIRST, role, md5(text)) AS ts FROM t GROUP BY conv_id, own
), inner_prefix AS (
  SELECT DISTINCT ts[1:k] AS p FROM (SELECT ts, unnest(range(1, len(ts))) AS k FROM l)
), whole AS (
  SELECT ts, min(conv_id) AS conv_id, count(*) AS n_copies FROM l GROUP BY ts
)
SELECT conv_id, len(ts)::INTEGER AS n_turns, n_copies::BIGINT AS n_copies,
       array_to_string(list_transform(ts, lambda x: '<|im_start|>' || replace(x.role, '<|', '< |') || chr(10)
                       || replace(x.text, '<|', '< |') || '<|im_end|>'), chr(10)) AS rendered
FROM whole WHERE ts NOT IN (SELECT p FROM inner_prefix)
"""
