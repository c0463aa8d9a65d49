"""Occurrences of many names in many texts, by an automaton that reads a text once.

Names are dealt to parts by their first two characters, and a part has an automaton of
its own (Aho-Corasick). A text is sent to the parts whose beginnings it holds: with few
names that is one part, and nothing is shuffled. Rows of a part come together, so a
task holds one automaton, and texts of a part that most texts hold are spread by a
salt. Memory of a task is linear in a part's names and in the text at hand.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .recovery import scratch_dir

#: Characters of names in one automaton.
PART_CHARS = 2_000_000
HITS = "array<struct<start:int,stop:int,name:string>>"
_WORD = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")


@lru_cache(maxsize=1)
def _automaton(uri: str):
    import ahocorasick

    made = ahocorasick.Automaton()
    fs, path = pafs.FileSystem.from_uri(uri if ":" in uri else f"file://{uri}")
    for f in fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)):
        if os.path.basename(f.path).startswith("part-"):
            with pq.ParquetFile(fs.open_input_file(f.path)) as file:
                for batch in file.iter_batches(columns=["name"]):
                    for name in batch.column(0).to_pylist():
                        made.add_word(name, name)
    if len(made):
        made.make_automaton()
    return made


def all_hits(text: str, found: Iterable[tuple[int, str]]) -> list[tuple[int, int, str]]:
    return [(end + 1 - len(name), end + 1, name) for end, name in found]


def _scan(folder: str, edges: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for part, text in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                text = text.as_py() or ""
                automaton = _automaton(f"{folder}/part={part}")
                hits = all_hits(text, automaton.iter(text)) if len(automaton) and text else []
                if edges:
                    hits = [h for h in hits if at_edges(text, *h)]
                out.append([{"start": a, "stop": b, "name": n} for a, b, n in hits])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("name", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["id", "hits"])

    return run


def at_edges(text: str, start: int, stop: int, name: str) -> bool:
    """Names that begin or end with an ASCII letter or digit stand at the edge of a word there."""
    before = start == 0 or name[0] not in _WORD or text[start - 1] not in _WORD
    return before and (stop == len(text) or name[-1] not in _WORD or text[stop] not in _WORD)


def hits(texts: DataFrame, id_col: str, text_col: str, names: DataFrame, edges: bool = False) -> DataFrame:
    """``id, hits``: all occurrences of each text, ordered by place; texts without any are left out.

    ``names`` has ``name``; both sides are compared as they are. Ids are unique. Null and
    empty names and texts meet nothing.
    """
    spark = texts.sparkSession
    folder = scratch_dir(spark, "names")
    known = names.select(F.col("name").cast("string").alias("name")).filter("name <> ''").distinct()
    size = known.agg(F.coalesce(F.sum(F.char_length("name")), F.lit(0)).alias("n")).first()["n"]
    parts = max(1, -(-size // PART_CHARS))
    head = lambda c: F.pmod(F.xxhash64(F.substring(c, 1, 2)), F.lit(parts)).cast("int")
    known.withColumn("part", head("name")).repartition(parts, "part").write.partitionBy("part").parquet(folder)
    kind = dict(texts.dtypes)[id_col]
    rows = texts.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter("text <> ''")
    schema = f"id {kind}, hits {HITS}"
    if parts == 1:
        found = rows.select("id", F.lit(0).alias("part"), "text").mapInArrow(_scan(folder, edges), schema)
        return found.filter(F.size("hits") > 0).select("id", F.array_sort("hits").alias("hits"))
    places = F.sequence(F.lit(1), F.char_length("text"))
    own = F.array_distinct(F.flatten(F.transform(places, lambda i: F.array(_head_of(i, 2, parts), _head_of(i, 1, parts)))))
    dealt = rows.select("id", F.explode(own).alias("part"), "text").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(16)))
    dealt = dealt.repartition("part", "salt").sortWithinPartitions("part").select("id", "part", "text")
    found = dealt.mapInArrow(_scan(folder, edges), schema).filter(F.size("hits") > 0)
    return found.groupBy("id").agg(F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"))


def _head_of(at: Column, size: int, parts: int) -> Column:
    return F.pmod(F.xxhash64(F.substring("text", at, F.lit(size))), F.lit(parts)).cast("int")


def _chosen(found: DataFrame, choose: Callable[[list[dict]], list[dict]]) -> DataFrame:
    """``id, hits`` with the hits of each text that are chosen, given in order of place."""
    kind = dict(found.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(choose, batch.column(1).to_pylist()), batch.schema.field(1).type)], names=["id", "hits"])

    return found.mapInArrow(run, f"id {kind}, hits {HITS}")


def _uncovered(own: list[dict]) -> list[dict]:
    reach, out = 0, []
    for h, after in zip(own, [*own[1:], None], strict=True):
        # At one place the longest comes last; a hit that ends within an earlier one is a part of it.
        if (after is None or after["start"] > h["start"]) and h["stop"] > reach:
            reach = h["stop"]
            out.append(h)
    return out


def _apart(own: list[dict]) -> list[dict]:
    taken: set[int] = set()
    out = []
    for h in sorted(own, key=lambda h: (h["start"] - h["stop"], h["start"], h["name"])):
        # Hits that were kept are no shorter, so one that overlaps this one covers an end of it.
        if h["start"] not in taken and h["stop"] - 1 not in taken:
            taken.update(range(h["start"], h["stop"]))
            out.append(h)
    return sorted(out, key=lambda h: h["start"])


def uncovered(found: DataFrame) -> DataFrame:
    """``id, hits``: hits that no longer hit of the text covers."""
    return _chosen(found, _uncovered)


def apart(found: DataFrame) -> DataFrame:
    """``id, hits``: hits that do not overlap; longer ones first, then earlier ones."""
    return _chosen(found, _apart)


def mentioned(questions: DataFrame, names: DataFrame) -> DataFrame:
    """``question, id, name, start``: names in each question that no longer name there covers; the longest per id.

    ``questions``: question, text; ``names``: id, name. Case does not count.
    """
    low = questions.select("question", F.lower("text").alias("low"))
    known = names.select("id", F.lower("name").alias("name")).filter("name <> ''").distinct()
    found = uncovered(hits(low, "question", "low", known)).select(F.col("id").alias("question"), F.explode("hits").alias("h"))
    found = found.groupBy("question", "h.name").agg(F.min("h.start").alias("start"))
    best = F.min_by(F.struct("name", "start"), F.struct(-F.char_length("name"), F.col("name"), F.col("start")))
    return found.join(known, "name").groupBy("question", "id").agg(best.alias("b")).select("question", "id", "b.name", (F.col("b.start") + 1).alias("start"))


def terms_in(queries: DataFrame, id_col: str, text_col: str, terms: DataFrame) -> DataFrame:
    """``id, term``: the vocabulary terms that occur in each query, in any case."""
    known = terms.select("term", F.lower("term").alias("name")).filter("name <> ''").distinct()
    low = queries.select(F.col(id_col), F.lower(text_col).alias("low"))
    found = hits(low, id_col, "low", known).select(F.col("id").alias(id_col), F.explode(F.array_distinct(F.transform("hits", lambda h: h["name"]))).alias("name"))
    return found.join(known, "name").select(id_col, "term").distinct()


def dictionary_matches(docs: DataFrame, id_col: str, text_col: str, terms: DataFrame) -> DataFrame:
    """``id, start, stop, term``: longest matches of a vocabulary that do not overlap, at the edges of words; ``terms``: name."""
    fold = F.translate  # only ASCII letters: offsets stay those of the text
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    low = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), fold(F.col(text_col), upper, lower).alias("low"))
    known = terms.select(fold(F.col("name"), upper, lower).alias("name"))
    found = apart(hits(low, "id", "low", known, edges=True)).select(F.col("id").alias("k"), F.explode("hits").alias("h"))
    rows = low.join(found, F.col("id") == F.col("k"))
    return rows.select("id", "h.start", "h.stop", F.substring("text", F.col("h.start") + 1, F.col("h.stop") - F.col("h.start")).alias("term"))


def expanded(queries: DataFrame, id_col: str, text_col: str, surfaces: DataFrame, ancestors: DataFrame, most: int = 8, least: int = 2) -> DataFrame:
    """``id, terms, subclasses``: classes that a query names, and what lies below them.

    ``surfaces``: form, class; ``ancestors``: class, ancestor (closed). Forms shorter than
    ``least`` do not count, nor those that are a part of a longer form in the query; the
    ``most`` classes with the longest forms stay.
    """
    known = surfaces.select(F.lower("form").alias("name"), "class").filter(F.char_length("form") >= least).distinct()
    low = queries.select(F.col(id_col).alias("q"), F.lower(F.trim(text_col)).alias("low"))
    forms = hits(low, "q", "low", known).select(F.col("id").alias("q"), F.array_distinct(F.transform("hits", lambda h: h["name"])).alias("forms"))
    whole = F.filter("forms", lambda f: ~F.exists("forms", lambda g: (F.char_length(g) > F.char_length(f)) & F.contains(g, f)))
    each = forms.select("q", F.explode(whole).alias("name")).join(known, "name").groupBy("q", "class").agg(F.max(F.char_length("name")).alias("size"))
    ordered = each.groupBy("q").agg(F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("size"), "class"))).alias("c"))
    terms = ordered.select("q", F.array_sort(F.transform(F.slice("c", 1, most), lambda x: x["class"])).alias("terms"))
    below = terms.select("q", "terms", F.explode("terms").alias("ancestor")).join(ancestors, "ancestor").filter(~F.array_contains("terms", F.col("class")))
    below = below.groupBy("q").agg(F.array_sort(F.collect_set("class")).alias("subclasses"))
    out = terms.join(below, "q", "left")
    return out.select(F.col("q").alias(id_col), "terms", F.coalesce("subclasses", F.array().cast("array<string>")).alias("subclasses"))
