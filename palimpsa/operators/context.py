"""Scopes, source context and reading views of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import bigrams
from .numbering import placed


def reference_scan(rows: DataFrame, text: str, order: str, needle: str, limit: int = 1001) -> DataFrame:
    """Rows whose text has the needle, whatever their business time: a bigram test, then the text itself."""
    pairs = [needle[i : i + 2] for i in range(len(needle) - 1)]
    may = F.lit(True)
    for p in dict.fromkeys(pairs):
        may = may & F.array_contains("bigrams", p)
    found = rows.withColumn("bigrams", bigrams(F.col(text))).filter(may) if pairs else rows
    return found.filter(F.contains(F.col(text), F.lit(needle))).orderBy(order).limit(limit).select(*rows.columns)


def ontology_scope(records: DataFrame, column: str, mode: str, ids: list | None = None, known: DataFrame | None = None) -> DataFrame:
    """``ids``: records of these ontologies; ``unknown``: of none in ``known``; ``all``."""
    if mode == "all":
        return records
    if mode == "ids":
        return records.filter(F.col(column).isin(ids or []))
    return records.join(known.select(F.col(known.columns[0]).alias(column)).distinct(), column, "left_anti")


def visible(read_visible: Column, quarantined: Column) -> Column:
    return F.coalesce(read_visible, F.lit(False)) & ~F.coalesce(quarantined, F.lit(False))


def processing_state(status: Column, ready: list, failed: list) -> Column:
    """ready, failed or (any other or no status) processing."""
    return F.when(status.isin(ready), "ready").when(status.isin(failed), "failed").otherwise("processing")


def compact_rows(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """One narrow row per graph record: ``id, kind, type, text (160 characters), subject, object``."""
    none = F.lit(None).cast("string")
    a = entities.select("id", F.lit("entity").alias("kind"), "type", F.left("text", F.lit(160)).alias("text"), none.alias("subject"), none.alias("object"))
    b = relations.select(F.col("edge").alias("id"), F.lit("relation").alias("kind"), "type", none.alias("text"), F.col("src").alias("subject"), F.col("dst").alias("object"))
    return a.unionByName(b)


def heading(title: Column, file: Column, most: int = 300) -> Column:
    """Heading of a chunk: title, and the file in brackets if it is another."""
    with_file = F.when((file != "") & (file != title), F.concat(title, F.lit("（"), file, F.lit("）")))
    return F.left(F.coalesce(with_file, title, file), F.lit(most))


def column_issues(row: dict[str, tuple[Column, int]]) -> Column:
    """Names of text columns that are over their capacity in bytes, joined by commas."""
    return F.array_join(F.array_compact(F.array(*[F.when(F.octet_length(c) > n, F.lit(k)) for k, (c, n) in row.items()])), ",")


def passage(text: Column, term: Column, around: int = 200, most: int = 6000) -> Column:
    """The text from ``around`` characters before the first occurrence on; from the start if there is none."""
    at = F.position(F.lower(term), F.lower(text))
    return F.substring(text, F.greatest(at - around, F.lit(1)), F.least(F.char_length(term) + 2 * around, F.lit(most)))


def public(records: DataFrame) -> DataFrame:
    """Without internal columns, whose names begin with _."""
    return records.select(*[c for c in records.columns if not c.startswith("_")])


def with_parents(chunks: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    """Chunks whose document is in scope."""
    return chunks.join(documents.select(key).distinct(), key, "left_semi")


def labelled(rows: DataFrame, labels: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """Adds the label (one per id) of each id column; ids without one keep a null.

    Labels have no bound, so they are merged and never broadcast; rows then leave a join in order of its ids, and
    equal labels, which lie together, are packed well on their way to the next one.
    """
    one = labels.groupBy("id").agg(F.min("text").alias("label")).hint("merge")
    for column, name in pairs.items():
        rows = rows.join(one.select(F.col("id").alias(column), F.col("label").alias(name)), column, "left")
    return rows


def with_contexts(groups: DataFrame, rows: DataFrame, key: str, order: list, shown: str, most: int) -> DataFrame:
    """Each group's members counted, with the first ``most`` of them as a list; groups without members keep zero."""
    own = W.partitionBy(key)
    placed = rows.withColumns({"place": F.row_number().over(own.orderBy(*order)), "total": F.count(F.lit(1)).over(own)}).filter(F.col("place") <= most)
    lists = placed.groupBy(key).agg(F.max("total").alias("total"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.col(shown).cast("string").alias("v")))), lambda x: x["v"]), ",").alias("contexts"))
    return groups.join(lists, key, "left").withColumns({"total": F.coalesce("total", F.lit(0)), "contexts": F.coalesce("contexts", F.lit(""))})


def stable_id(*parts: Column, length: int = 32) -> Column:
    """Prefix of a SHA-256 over the parts."""
    return F.left(F.sha2(F.concat_ws("\x1f", *[p.cast("string") for p in parts]), 256), F.lit(length))


def focused(locations: DataFrame, matches: DataFrame, key: str) -> DataFrame:
    """The part of each source location that a match of its chunk covers, by offsets in the chunk."""
    m = matches.select(key, F.col("start").alias("m_start"), F.col("stop").alias("m_stop"))
    both = locations.join(m, key).filter((F.col("start") < F.col("m_stop")) & (F.col("stop") > F.col("m_start")))
    return both.select(*[c for c in locations.columns if c not in ("start", "stop")], F.greatest("start", "m_start").alias("start"), F.least("stop", "m_stop").alias("stop"))


def quality_gate(boxes: DataFrame, key: str, score: str, text: str, least_mean: float, low: float, most_low: float, least_chars: int) -> DataFrame:
    """Per asset the mean confidence, share of low ones, characters, and whether all three pass."""
    out = boxes.groupBy(key).agg(
        F.avg(score).alias("mean"), (F.count_if(F.col(score) < low) / F.count(F.lit(1))).alias("low_ratio"), F.sum(F.char_length(text)).alias("chars")
    )
    return out.withColumn("passed", (F.col("mean") >= least_mean) & (F.col("low_ratio") <= most_low) & (F.col("chars") >= least_chars))


def numbered(log: DataFrame, project: str, order: list[str], last: DataFrame | None = None) -> DataFrame:
    """New changes with the next sequence numbers of their project, without gaps.

    Numbers continue after ``last`` (project, seq). A project's changes are spread over tasks.
    """
    out = placed(log, project, order, "n")
    if last is None:
        return out.withColumnRenamed("n", "seq")
    out = out.join(last.select(project, F.col("seq").alias("before")), project, "left")
    return out.withColumn("seq", F.coalesce("before", F.lit(0)) + F.col("n")).drop("before", "n")


def expired_generations(generations: DataFrame, project: str, now: Column, days: int = 7) -> DataFrame:
    """Retired generations that are past the rollback window; the active one and its last predecessor stay."""
    own = W.partitionBy(project).orderBy(F.desc("generation"))
    rows = generations.withColumn("age", F.row_number().over(own))
    return rows.filter((F.col("age") > 2) & (F.col("retired_at") <= now - F.make_dt_interval(F.lit(days)))).drop("age")


def caught_up(snapshot: DataFrame, changes: DataFrame, key: list[str], seq: str, gone: str, upto: int | None = None) -> DataFrame:
    """State of a rebuild: the snapshot (with ``seq`` of its rows) folded with later changes up to a watermark; tombstones go."""
    later = changes if upto is None else changes.filter(F.col(seq) <= upto)
    every = snapshot.withColumn(gone, F.lit(False)).unionByName(later)
    newest = every.groupBy(*key).agg(F.max_by(F.struct(*every.columns), F.col(seq)).alias("r")).select("r.*")
    return newest.filter(~F.col(gone)).drop(gone)
