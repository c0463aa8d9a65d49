"""Slices of a stored ontology for a table of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import closure
from .patterns import hits


def ontology_slices(questions: DataFrame, id_col: str, text_col: str, terms: DataFrame, labels: DataFrame, subclasses: DataFrame, contracts: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """``question, term, surface, reasons``: the terms that each question needs, and why.

    ``terms``: term, is_class; ``labels``: term, label; ``subclasses``: child, parent;
    ``contracts``: property, end (``domain`` or ``range``), class. A term is taken because a label
    of it is in the text (``lexical``, the longest is the surface), as an ``ancestor`` or
    ``child`` of a class that is, as a property of a taken class or itself taken
    (``property_contract``), or as an end of such a property (``property_domain``,
    ``property_range``). A question that takes nothing gets the ``roots`` (``configured_root``).
    Names that ``terms`` does not have are left out, and what is only reached by them.
    """
    known = terms.select("term").distinct()
    names = labels.join(known, "term", "left_semi").select("term", F.lower("label").alias("name")).filter("name <> ''").distinct()
    low = questions.select(F.col(id_col).alias("question"), F.lower(F.col(text_col)).alias("low"))
    found = hits(low, "question", "low", names).select(F.col("id").alias("question"), F.explode(F.array_distinct(F.transform("hits", lambda h: h["name"]))).alias("name"))
    lexical = found.join(names, "name").groupBy("question", "term").agg(F.min_by("name", F.struct(-F.char_length("name"), F.col("name"))).alias("surface"))
    whole = subclasses.join(known.withColumnRenamed("term", "child"), "child", "left_semi").join(known.withColumnRenamed("term", "parent"), "parent", "left_semi")
    closed = closure(whole, "child", "parent").filter("child <> parent")
    hit = lexical.select("question", "term").join(terms.filter("is_class").select("term").distinct(), "term", "left_semi")
    above = hit.join(closed, F.col("term") == F.col("child")).select("question", F.col("parent").alias("term"), F.lit("ancestor").alias("reason"))
    below = hit.join(closed, F.col("term") == F.col("parent")).select("question", F.col("child").alias("term"), F.lit("child").alias("reason"))
    taken = lexical.select("question", "term", F.lit("lexical").alias("reason")).union(above).union(below).distinct()
    selected = taken.select("question", "term").distinct()
    ends = contracts.join(known.withColumnRenamed("term", "property"), "property", "left_semi").select("property", "end", "class").distinct()
    mentioned = selected.join(ends.withColumnRenamed("class", "term"), "term").select("question", "property")
    themselves = selected.join(ends.select("property").distinct(), F.col("term") == F.col("property")).select("question", "property")
    used = mentioned.union(themselves).distinct()
    contract = used.select("question", F.col("property").alias("term"), F.lit("property_contract").alias("reason"))
    of_ends = used.join(ends, "property").select("question", F.col("class").alias("term"), F.concat(F.lit("property_"), F.col("end")).alias("reason"))
    every = taken.union(contract).union(of_ends.join(known, "term", "left_semi").select("question", "term", "reason"))
    if roots is not None:
        rest = low.select("question").join(selected.select("question").distinct(), "question", "left_anti")
        # A few roots for each question without terms.
        root_rows = roots.join(known, "term", "left_semi").agg(F.collect_set("term").alias("r"))
        every = every.union(rest.join(F.broadcast(root_rows)).select("question", F.explode("r").alias("term"), F.lit("configured_root").alias("reason")))
    out = every.groupBy("question", "term").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))
    return out.join(lexical, ["question", "term"], "left").select("question", "term", "surface", "reasons")
