"""Stored generations over the driver's tables: loaded, changed, validated, switched, read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.recovery import scratch_dir
from ..sources.generations import Generations
from . import model
from .catalogue import query
from .model import table


@query(
    "generation_upserts",
    """WITH l AS (SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2)
    SELECT user_id, event_type, event_id, value FROM l WHERE event_id % 9 <> 0""",
)
def generation_upserts(spark, sf):
    key = ["user_id", "event_type"]
    events = table(spark, sf, "events").select(*key, "event_id", "value", (F.col("event_id") % 9 == 0).alias("gone"))
    last = lambda rows: rows.groupBy(*key).agg(F.max_by(F.struct("event_id", "value", "gone"), "event_id").alias("r")).select(*key, "r.*").filter("not gone").drop("gone")
    later = F.col("event_id") % 3 == 0  # a third of the log comes after the snapshot, in another order than its numbers
    cut = events.groupBy(*key).agg(F.max(F.when(~later, F.col("event_id"))).alias("upto"))
    changes = events.filter(later).join(cut, key).filter("upto is null or event_id > upto").drop("upto")
    store = Generations(spark, scratch_dir(spark, "generations"), {"records": key})
    first = store.load({"records": last(events.filter(~later))})
    store.validate(first, {"records": last(events.filter(~later))})
    store.switch(first)
    second = store.apply({"records": changes.withColumn("seq", F.col("event_id"))}, "gone", "seq")
    store.validate(second, {"records": last(events)})
    store.switch(second, instead_of=first)
    return store.read("records")


@query(
    "graph_generation",
    f"""WITH {model.ENTITIES_SQL}, {model.RELATIONS_SQL} SELECT edge, r.type, src, dst, a.text AS src_text, b.text AS dst_text FROM r JOIN e a ON a.id = src JOIN e b ON b.id = dst
    WHERE r.type <> 'part_of' AND a.type <> 'customer'""",
)
def graph_generation(spark, sf):
    nodes = model.entities(spark, sf)
    edges = model.relations(spark, sf).select("edge", "type", "src", "dst")
    store = Generations(spark, scratch_dir(spark, "graph"), {"nodes": ["id"], "edges": ["edge"]})
    first = store.load({"nodes": nodes, "edges": edges})
    gone = F.col("type") == "customer"
    no_edge = (F.col("type") == "part_of") | F.col("src").startswith("customer:")
    changed = {
        "nodes": nodes.filter(gone).withColumns({"gone": F.lit(True), "seq": F.lit(1)}),
        "edges": edges.filter(no_edge).withColumns({"gone": F.lit(True), "seq": F.lit(1)}),
    }
    second = store.apply(changed, "gone", "seq", base=first)
    references = {("edges", "src"): ("nodes", "id"), ("edges", "dst"): ("nodes", "id")}
    store.validate(second, {"nodes": nodes.filter(~gone), "edges": edges.filter(~no_edge)}, references)
    store.switch(second)
    names = store.read("nodes")
    ends = lambda side: names.select(F.col("id").alias(side), F.col("text").alias(f"{side}_text"))
    return store.read("edges").join(ends("src"), "src").join(ends("dst"), "dst").select("edge", "type", "src", "dst", "src_text", "dst_text")


@query(
    "artifact_store",
    """WITH a AS (SELECT doc_id, lang, source, n_chars, lang = 'en' AS revised FROM documents),
    p AS (SELECT doc_id, revised, '{"lang":"' || lang || '","source":"' || source || '","n_chars":' || n_chars || CASE WHEN revised THEN ',"revision":2}' ELSE '}' END AS payload FROM a)
    SELECT doc_id, CASE WHEN revised THEN 2 ELSE 1 END AS version, payload, sha256(payload) AS digest FROM p WHERE doc_id % 10 <> 3""",
)
def artifact_store(spark, sf):
    docs = table(spark, sf, "documents")
    payload = F.to_json(F.struct("lang", "source", "n_chars"))
    rows = lambda d, version, body: d.select("doc_id", F.lit(version).alias("version"), body.alias("payload"), F.sha2(body, 256).alias("digest"))
    store = Generations(spark, scratch_dir(spark, "artifacts"), {"artifacts": ["doc_id"]})
    base = rows(docs, 1, payload)
    first = store.load({"artifacts": base})
    store.validate(first, {"artifacts": base})
    store.switch(first)
    newer = rows(docs.filter("lang = 'en'"), 2, F.to_json(F.struct("lang", "source", "n_chars", F.lit(2).alias("revision"))))
    removed = F.col("doc_id") % 10 == 3
    changes = newer.withColumns({"gone": F.lit(False), "seq": F.lit(1)}).unionByName(base.filter(removed).withColumns({"gone": F.lit(True), "seq": F.lit(2)}))
    second = store.apply({"artifacts": changes}, "gone", "seq")
    store.validate(second, {"artifacts": base.join(newer.select("doc_id"), "doc_id", "left_anti").unionByName(newer).filter(~removed)})
    store.switch(second, instead_of=first)
    return store.read("artifacts")
