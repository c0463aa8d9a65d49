"""An inverted index that is stored and searched in shards of documents.

A shard holds the postings of a few thousand documents: for each term the documents in
order, how often they have it, and their lengths. A frequent term has a list in every
shard, so no list is long. Every ``BLOCK`` postings have an upper bound of what they can
add to a score (their highest count and least length).

A search sends the terms of a group of queries to the shards, and each shard gives its
best k: terms are added in order of what they can add at most; once documents that were
not seen yet can not reach the k best, only candidates are followed up, and blocks
that can not lift them are skipped. The result is that of scoring every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from .ranking import K1, B

BLOCK = 128
#: Documents of a shard at most, and at least where there are not many.
SHARD_DOCS, LEAST_DOCS = 8192, 512
#: Queries that a shard answers at a time.
QUERY_GROUP = 1024
#: Scores are compared as rounded to so many digits; bounds allow for it.
DIGITS, SLACK = 9, 1e-8


def shard_count(spark: SparkSession, n: int) -> int:
    return max(-(-n // SHARD_DOCS), min(spark.sparkContext.defaultParallelism, -(-n // LEAST_DOCS)), 1)


def _postings(table: pa.Table, schema: pa.Schema) -> pa.Table:
    """Rows of the index of a shard: one for its documents, then one for each term."""
    table = table.sort_by("id").combine_chunks()
    shard = table.column("shard")[0].as_py()
    lists = table.column("terms").combine_chunks()
    sizes = np.asarray(lists.value_lengths())
    words = lists.flatten().dictionary_encode()
    codes = np.asarray(words.indices).astype(np.int64)
    of = np.repeat(np.arange(len(sizes)), sizes)
    keys, counts = np.unique(codes * len(sizes) + of, return_counts=True)
    term, doc = keys // len(sizes), keys % len(sizes)
    starts = np.searchsorted(term, np.arange(len(words.dictionary) + 1))
    offsets = pa.array(starts, pa.int32())
    as_lists = lambda values: pa.ListArray.from_arrays(offsets, pa.array(values, pa.int32()))
    length = sizes[doc]
    blocks = [np.arange(a, b, BLOCK) for a, b in zip(starts[:-1], starts[1:], strict=True)]
    at = np.concatenate(blocks) if blocks else np.zeros(0, np.int64)
    per_term = pa.array(np.append(0, np.cumsum([len(b) for b in blocks])), pa.int32())
    bound = lambda values, op: pa.ListArray.from_arrays(per_term, pa.array(op.reduceat(values, at) if len(at) else values, pa.int32()))
    n = len(words.dictionary)
    of_terms = {
        "shard": pa.array([shard] * n, pa.int32()), "term": words.dictionary, "ids": pa.nulls(n, schema.field("ids").type), "docs": as_lists(doc), "counts": as_lists(counts),
        "lengths": as_lists(length), "most": bound(counts, np.maximum), "least": bound(length, np.minimum),
    }
    of_docs = {name: pa.nulls(1, schema.field(name).type) for name in schema.names}
    of_docs["shard"] = pa.array([shard], pa.int32())
    of_docs["ids"] = pa.array([table.column("id").to_pylist()], schema.field("ids").type)
    of_docs["lengths"] = pa.array([sizes], pa.list_(pa.int32()))
    batches = [pa.table([d[name].cast(schema.field(name).type) for name in schema.names], schema=schema) for d in (of_docs, of_terms)]
    return pa.concat_tables(batches)


def build(docs: DataFrame, id_col: str, text_col: str, path: str) -> None:
    """Writes the index of whole texts; ids are unique. Null texts have no terms but count as documents."""
    kind = dict(docs.dtypes)[id_col]
    shards = shard_count(docs.sparkSession, docs.count())
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # Texts are dealt once, before they become terms; with more partitions than shards few hold two of them.
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")).repartition(4 * shards, "shard")
    rows = rows.select("id", F.coalesce(tokens(F.col("text")), F.array().cast("array<string>")).alias("terms"), "shard")
    ids = pa.list_(_arrow_type(rows, "id"))
    ints = pa.list_(pa.int32())
    schema = pa.schema([("shard", pa.int32()), ("term", pa.string()), ("ids", ids), ("docs", ints), ("counts", ints), ("lengths", ints), ("most", ints), ("least", ints)])
    ddl = f"shard int, term string, ids array<{kind}>, docs array<int>, counts array<int>, lengths array<int>, most array<int>, least array<int>"
    made = rows.groupBy("shard").applyInArrow(lambda table: _postings(table, schema), ddl)
    made.write.parquet(path)


def _arrow_type(rows: DataFrame, column: str) -> pa.DataType:
    return rows.select(column).limit(0).toArrow().schema.field(0).type


class _Shard:
    """The postings of some terms in a shard, with what they add to a score."""

    def __init__(self, table: pa.Table, average: float) -> None:
        table = table.combine_chunks()
        terms = table.column("term").to_pylist()
        one = lambda name: table.column(name).chunk(0)
        self.ids = one("ids")[terms.index(None)].values
        self.n, self.average = len(self.ids), average
        open_ = one("open")[terms.index(None)].values if "open" in table.column_names else None
        self.open = None if open_ is None else open_.to_numpy(zero_copy_only=False)
        self.at = {t: i for i, t in enumerate(terms) if t is not None}
        lists = {c: one(c) for c in ("docs", "counts", "lengths", "most", "least")}
        self.offsets = {c: x.offsets.to_numpy() for c, x in lists.items()}
        self.values = {c: x.values.to_numpy() for c, x in lists.items()}

    def lists(self, term: str) -> tuple[np.ndarray, ...] | None:
        """Documents, counts, lengths, and the bounds of the blocks of a term."""
        i = self.at.get(term)
        if i is None:
            return None
        return tuple(self.values[c][self.offsets[c][i] : self.offsets[c][i + 1]] for c in self.values)

    def share(self, counts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return counts * (K1 + 1) / (counts + K1 * (1 - B + B * lengths / self.average))

    def best(self, asked: list[tuple[str, float]], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents of the shard and scores of the k best."""
        own = []
        for term, idf in asked:
            if (found := self.lists(term)) is not None:
                docs, counts, lengths, most, least = found
                bounds = idf * self.share(most, least)
                own.append((bounds.max(), idf, docs, counts, lengths, bounds))
        own.sort(key=lambda x: -x[0])
        rest = np.append(np.cumsum([x[0] for x in own][::-1])[::-1], 0.0)  # what this term and later ones add at most
        score, reached, i = np.zeros(self.n), -1.0, 0
        seen = lambda: score if self.open is None else np.where(self.open, score, -1.0)
        while i < len(own) and rest[i] + SLACK >= reached:
            _, idf, docs, counts, lengths, _ = own[i]
            score[docs] += idf * self.share(counts, lengths)
            if self.n > k:
                reached = np.partition(seen(), self.n - k)[self.n - k]
            i += 1
        left = np.flatnonzero((seen() > 0) & (score + rest[i] + SLACK >= reached))
        if i < len(own):
            places = [np.searchsorted(x[2], left) for x in own[i:]]
            bound = score[left].copy()
            for x, p in zip(own[i:], places, strict=True):
                bound += np.append(x[5], 0.0)[p // BLOCK]
            keep = bound + SLACK >= reached
            left = left[keep]
            for (_, idf, docs, counts, lengths, _), p in zip(own[i:], places, strict=True):
                p = p[keep]
                there = np.flatnonzero(p < len(docs))
                there = there[docs[p[there]] == left[there]]
                score[left[there]] += idf * self.share(counts[p[there]], lengths[p[there]])
        order = np.lexsort((left, -np.round(score[left], DIGITS)))[:k]
        return left[order], score[left[order]]


def _marked(docs: DataFrame, allowed: DataFrame) -> DataFrame:
    """Rows of shards' documents with ``open``: which of them are allowed."""
    each = docs.select("shard", F.posexplode("ids").alias("at", "id"))
    known = allowed.select(F.col(allowed.columns[0]).alias("id")).distinct().withColumn("there", F.lit(True))
    marks = each.join(known, "id", "left").groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("there", F.lit(False)).alias("there")))).alias("m"))
    return docs.join(marks.select("shard", F.transform("m", lambda x: x["there"]).alias("open")), "shard")


def search(index: DataFrame, queries: DataFrame, query_id: str, query_text: str, k: int, allowed: DataFrame | None = None) -> DataFrame:
    """``query_id, id, score``: of each query the k best documents by BM25 that share a term with it.

    ``index`` is what ``build`` wrote. Ties (in the first nine digits) go to the smaller id.
    ``allowed`` (ids in its first column) leaves others out before the best are taken; how
    rare a term is stays that of the whole index.
    """
    about = index.filter("term is null").select(F.inline(F.arrays_zip("ids", "lengths")))
    n, average = about.agg(F.count(F.lit(1)), F.avg("lengths")).first()
    query_kind, id_kind = dict(queries.dtypes)[query_id], index.schema["ids"].dataType.elementType.simpleString()
    schema = f"query_id {query_kind}, id {id_kind}, score double"
    if not n:
        return queries.sparkSession.createDataFrame([], schema)
    asked = queries.select(F.col(query_id).alias("query_id"), F.explode(F.array_distinct(tokens(F.col(query_text)))).alias("term"))
    groups = max(1, -(-queries.count() // QUERY_GROUP))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int"))
    lists = index.join(asked.select("term", "part").distinct(), "term")
    found = index.filter("term is not null").groupBy("term").agg(F.sum(F.size("docs")).alias("df"))
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    shards = index.filter("term is null").select("shard")
    # Every shard answers every group of queries: shards times groups rows, each a task's work.
    own = shards.select("shard", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"))
    weighed = asked.join(found, "term").select("query_id", "term", "part", idf.alias("idf")).join(own, "part")
    weighed = weighed.toDF(*[f"q_{c}" for c in weighed.columns])  # both sides have columns of one table
    docs = index.filter("term is null")
    if allowed is not None:
        docs = _marked(docs, allowed)
        lists = lists.withColumn("open", F.lit(None).cast("array<boolean>"))
    docs = docs.join(own, "shard").select(*lists.columns)
    out_schema = pa.schema([("query_id", _arrow_type(asked, "query_id")), ("id", _arrow_type(index.select(F.get("ids", F.lit(0)).alias("id")), "id")), ("score", pa.float64())])

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return out_schema.empty_table()
        shard = _Shard(left, average)
        wanted: dict = {}
        for q, term, weight in zip(*(right.column(c).to_pylist() for c in ("q_query_id", "q_term", "q_idf")), strict=True):
            wanted.setdefault(q, []).append((term, weight))
        queries_, ids, scores = [], [], []
        for q, terms in wanted.items():
            at, score = shard.best(terms, k)
            queries_ += [q] * len(at)
            ids.append(shard.ids.take(pa.array(at)))
            scores.append(score)
        return pa.table([pa.array(queries_, out_schema.field(0).type), pa.concat_arrays(ids).cast(out_schema.field(1).type), pa.array(np.concatenate(scores))], schema=out_schema)

    both = lists.unionByName(docs).groupBy("shard", "part").cogroup(weighed.groupBy("q_shard", "q_part"))
    return both.applyInArrow(answer, schema)
