"""Rankings over qualified rows, and their fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import cosine, occurrences, tokens

K1, B = 1.2, 0.75


def top(rows: DataFrame, score: str, tie: str, k: int, by: list[str] | None = None) -> DataFrame:
    """The k best rows (per group), with ``rank``; ties go to the smaller id."""
    order = W.partitionBy(*(by or [])).orderBy(F.desc(score), tie) if by else W.orderBy(F.desc(score), tie)
    if not by:  # the sort below the window only sees k rows
        rows = rows.orderBy(F.desc(score), tie).limit(k)
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def cosine_rank(vectors: DataFrame, vector: str, query: list[float], least: float | None = None) -> DataFrame:
    if not any(query):
        raise ValueError("a query vector can not be zero")
    scored = vectors.withColumn("score", cosine(F.col(vector), F.lit(query).cast("array<double>")))
    return scored if least is None else scored.filter(F.col("score") >= least)


def cosine_to(vectors: DataFrame, vector: str, query: DataFrame, query_vector: str) -> DataFrame:
    """Rows with the cosine to the one vector of ``query``, a single row, which is sent to all tasks."""
    one = F.broadcast(query.select(F.col(query_vector).cast("array<double>").alias("query_vector")).limit(1))
    return vectors.join(one).withColumn("score", cosine(F.col(vector), F.col("query_vector"))).drop("query_vector")


def bm25(docs: DataFrame, id_col: str, text_col: str, queries: DataFrame, query_id: str, query_text: str) -> DataFrame:
    """``query_id, id, score``: BM25 of every document that shares a term with a query.

    Postings are counted once; only those of terms that a query has are joined.
    """
    split = docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("terms"))
    stats = split.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("terms")).alias("avgdl"))
    asked = queries.select(F.col(query_id).alias("query_id"), F.explode(F.array_distinct(tokens(F.col(query_text)))).alias("term"))
    words = split.select("id", F.size("terms").alias("dl"), F.explode("terms").alias("term"))
    wanted = words.join(asked.select("term").distinct(), "term", "left_semi")
    tf = wanted.groupBy("id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = tf.join(df, "term").join(F.broadcast(stats)).select("id", "term", part.alias("s"))  # stats is one row
    return asked.join(scored, "term").groupBy("query_id", "id").agg(F.sum("s").alias("score"))


def lexical_score(text: Column, query: str) -> Column:
    """Ten times the occurrences of the phrase and one for each of its words."""
    low = F.lower(text)
    out = occurrences(low, F.lit(query.lower())) * 10
    for word in dict.fromkeys(query.lower().split()):
        out = out + occurrences(low, F.lit(word))
    return out


def rrf(rankings: list[tuple[str, DataFrame]], id_col: str, k: int, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of rankings with ``rank``; ties go to the best rank, then the id."""
    every = None
    for name, ranking in rankings:
        part = ranking.select(F.col(id_col).alias("id"), F.lit(name).alias("backend"), "rank")
        every = part if every is None else every.unionByName(part)
    first = every.groupBy("id", "backend").agg(F.min("rank").alias("rank"))
    fused = first.groupBy("id").agg(
        F.sum(1.0 / (constant + F.col("rank"))).alias("score"),
        F.min("rank").alias("best_rank"),
        F.count(F.lit(1)).alias("backends"),
    )
    return fused.orderBy(F.desc("score"), "best_rank", "id").limit(k)


def merge_best(rankings: list[DataFrame], id_col: str) -> DataFrame:
    """The highest score of each id over several rankings."""
    every = rankings[0].select(id_col, "score")
    for r in rankings[1:]:
        every = every.unionByName(r.select(id_col, "score"))
    return every.groupBy(id_col).agg(F.max("score").alias("score"))


def best_per_parent(hits: DataFrame, parent: str, score: str, child: str) -> DataFrame:
    """The best hit of every parent."""
    return hits.groupBy(parent).agg(F.max_by(child, F.struct(F.col(score), -F.col(child))).alias(child), F.max(score).alias(score), F.count(F.lit(1)).alias("hits"))


def protected_merge(direct: DataFrame, extra: DataFrame, id_col: str, k: int) -> DataFrame:
    """k rows, of which max(1, k // 3) places are kept for extras; direct rows come first."""
    kept = max(1, k // 3)
    fresh = extra.join(direct.select(id_col), id_col, "left_anti").orderBy("rank").limit(kept)
    a = direct.filter(F.col("rank") <= k).select(id_col, "rank", F.lit(0).alias("group"))
    both = a.unionByName(fresh.select(id_col, "rank", F.lit(1).alias("group")))  # some k rows
    room = k - F.count_if(F.col("group") == 1).over(W.partitionBy(F.lit(0)))
    return both.withColumn("room", room).filter((F.col("group") == 1) | (F.col("rank") <= F.col("room"))).drop("room")
