"""Registered queries: scopes, source context, reading views, graph sessions, governance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import temporal, text
from ..operators import context, dates, documents, extras, governance, graph, patterns, qualify, ranking
from ..operators.recovery import dealt
from . import model
from .catalogue import KNOWN, VALID, instant, query
from .model import table

_WINDOWS = "unnest(range(0, (CASE WHEN length(text) = 0 THEN 0 ELSE greatest(0, ceil((length(text) - 1800) / 1600.0)) + 1 END)::BIGINT)) t(i)"


@query("reference_scan", "SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'old wid') ORDER BY p_partkey LIMIT 1001")
def reference_scan(spark, sf):
    return context.reference_scan(table(spark, sf, "part").select("p_partkey", "p_name"), "p_name", "p_partkey", "old wid")


@query("document_chunks", f"SELECT doc_id, i::INTEGER AS ordinal, i * 1600 AS start FROM documents, {_WINDOWS} WHERE source IS NOT NULL")
def document_chunks(spark, sf):
    live = table(spark, sf, "documents").filter("source is not null")
    return documents.fixed_chunks(live, "doc_id", "text").select("doc_id", "ordinal", F.col("start").cast("long").alias("start"))


@query("version_id_stream", f"WITH {model.VERSIONS_SQL} SELECT id || '#' || version AS version_id FROM v WHERE recorded_at <= TIMESTAMP '{KNOWN}' AND (superseded_at IS NULL OR superseded_at > TIMESTAMP '{KNOWN}')")
def version_id_stream(spark, sf):
    rows = model.versions(spark, sf)
    return rows.filter(temporal.known_at(F.col("recorded_at"), F.col("superseded_at"), instant(KNOWN))).select("version_id")


@query("source_artifacts", f"WITH {model.VERSIONS_SQL} SELECT id, version::INTEGER AS version FROM v WHERE recorded_at <= TIMESTAMP '{KNOWN}'")
def source_artifacts(spark, sf):
    """Superseded versions count as well: what was recorded by then."""
    return model.versions(spark, sf).filter(F.col("recorded_at") <= instant(KNOWN)).select("id", "version")


@query("ontology_scope_ids", "SELECT p_partkey FROM part WHERE p_type IN ('ECONOMY', 'PROMO')")
def ontology_scope_ids(spark, sf):
    return context.ontology_scope(table(spark, sf, "part"), "p_type", "ids", ["ECONOMY", "PROMO"]).select("p_partkey")


@query("ontology_scope_unknown", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey = c_nationkey AND n_regionkey < 3)")
def ontology_scope_unknown(spark, sf):
    known = table(spark, sf, "nation").filter("n_regionkey < 3").select("n_nationkey")
    return context.ontology_scope(table(spark, sf, "customer"), "c_nationkey", "unknown", known=known).select("c_custkey")


@query("visible_records", "SELECT s_suppkey FROM supplier WHERE s_acctbal > 0 AND NOT s_acctbal > 9000")
def visible_records(spark, sf):
    return table(spark, sf, "supplier").filter(context.visible(F.col("s_acctbal") > 0, F.col("s_acctbal") > 9000)).select("s_suppkey")


@query("processing_states", "SELECT CASE o_orderstatus WHEN 'F' THEN 'ready' WHEN 'P' THEN 'failed' ELSE 'processing' END AS state, count(*) AS n FROM orders GROUP BY 1")
def processing_states(spark, sf):
    state = context.processing_state(F.col("o_orderstatus"), ["F"], ["P"])
    return table(spark, sf, "orders").groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query("type_filter", f"WITH {model.ENTITIES_SQL} SELECT id FROM e WHERE type IN ('nation', 'part')")
def type_filter(spark, sf):
    return model.entities(spark, sf).filter(F.col("type").isin("nation", "part")).select("id")


@query(
    "compact_graph_rows",
    f"""WITH {model.ENTITIES_SQL}, {model.RELATIONS_SQL} SELECT id, 'entity' AS kind, type, left(text, 160) AS text, NULL AS subject, NULL AS object FROM e
    UNION ALL SELECT edge, 'relation', type, NULL, src, dst FROM r""",
)
def compact_graph_rows(spark, sf):
    return context.compact_rows(model.entities(spark, sf), model.relations(spark, sf))


@query("chunk_headings", "SELECT page_id, left(CASE WHEN url <> '' AND url <> split_part(url, '/', 3) THEN split_part(url, '/', 3) || '（' || url || '）' ELSE split_part(url, '/', 3) END, 300) AS heading FROM pages")
def chunk_headings(spark, sf):
    return table(spark, sf, "pages").select("page_id", context.heading(F.split_part("url", F.lit("/"), F.lit(3)), F.col("url")).alias("heading"))


@query("column_issues", "SELECT doc_id, concat_ws(',', CASE WHEN strlen(text) > 6000 THEN 'text' END, CASE WHEN strlen(source) > 4 THEN 'source' END) AS issues FROM documents WHERE strlen(text) > 6000 OR strlen(source) > 4")
def column_issues(spark, sf):
    issues = context.column_issues({"text": (F.col("text"), 6000), "source": (F.col("source"), 4)})
    return table(spark, sf, "documents").select("doc_id", issues.alias("issues")).filter("issues <> ''")


@query("literal_passage", "SELECT doc_id, substring(text, greatest(instr(lower(text), 'the') - 200, 1), 403) AS passage FROM documents WHERE contains(lower(text), 'the')")
def literal_passage(spark, sf):
    rows = table(spark, sf, "documents").filter(F.contains(F.lower("text"), F.lit("the")))
    return rows.select("doc_id", context.passage(F.col("text"), F.lit("the")).alias("passage"))


@query("public_records", "SELECT vec_id, label FROM embeddings")
def public_records(spark, sf):
    return context.public(table(spark, sf, "embeddings").withColumnRenamed("embedding", "_embedding"))


@query("nested_parents", f"SELECT doc_id, i::INTEGER AS ordinal FROM documents, {_WINDOWS} WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def nested_parents(spark, sf):
    chunks = documents.fixed_chunks(table(spark, sf, "documents"), "doc_id", "text").select("doc_id", "ordinal")
    return context.with_parents(chunks, table(spark, sf, "labels").filter("quality = 1"), "doc_id")


@query("label_lookups", f"WITH {model.ENTITIES_SQL}, {model.RELATIONS_SQL} SELECT r.edge, a.text AS src_label, b.text AS dst_label FROM r LEFT JOIN e a ON a.id = r.src LEFT JOIN e b ON b.id = r.dst")
def label_lookups(spark, sf):
    out = context.labelled(model.relations(spark, sf), model.entities(spark, sf), {"src": "src_label", "dst": "dst_label"})
    return out.select("edge", "src_label", "dst_label")


_NAMES_SQL = "n AS (SELECT DISTINCT lower(split_part(p_name, ' ', 1)) AS id, lower(split_part(p_name, ' ', 1)) AS name FROM part UNION SELECT lower(p_name), lower(p_name) FROM part UNION SELECT 'thing', 'widget' FROM part UNION SELECT 'the', 'the' FROM part)"


@query(
    "mentioned_entities",
    f"""WITH {_NAMES_SQL}, q AS (SELECT 'p' || p_partkey AS question, lower(p_brand || ' ' || p_name) AS low FROM part UNION ALL SELECT 'b' || item_id, lower(text) FROM benchmark),
    h AS (SELECT question, id, name, i AS start, i + length(name) AS stop FROM q, n, unnest(range(1, length(low) + 1)) t(i) WHERE contains(low, name) AND substring(low, i, length(name)) = name),
    f AS (SELECT * FROM h a WHERE NOT EXISTS (SELECT 1 FROM h b WHERE b.question = a.question AND b.start <= a.start AND b.stop >= a.stop AND b.stop - b.start > a.stop - a.start))
    SELECT question, id, name, start::INTEGER AS start FROM f QUALIFY row_number() OVER (PARTITION BY question, id ORDER BY length(name) DESC, name, start) = 1""",
)
def mentioned_entities(spark, sf):
    part = table(spark, sf, "part")
    first = F.lower(F.split_part("p_name", F.lit(" "), F.lit(1)))
    names = part.select(first.alias("id"), first.alias("name")).union(part.select(F.lower("p_name"), F.lower("p_name")))
    names = names.union(part.select(F.lit("thing"), F.lit("widget"))).union(part.select(F.lit("the"), F.lit("the"))).distinct()
    at = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    questions = part.select(at("p", "p_partkey").alias("question"), F.concat_ws(" ", "p_brand", "p_name").alias("text"))
    return patterns.mentioned(questions.union(table(spark, sf, "benchmark").select(at("b", "item_id"), "text")), names)


@query(
    "duplicate_contexts",
    """WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
    SELECT c_custkey AS o_custkey, coalesce(max(n), 0)::BIGINT AS total, coalesce(string_agg(o_orderkey::VARCHAR, ',' ORDER BY k), '') AS contexts FROM customer LEFT JOIN r ON o_custkey = c_custkey AND k <= 3 GROUP BY 1""",
)
def duplicate_contexts(spark, sf):
    groups = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"))
    return context.with_contexts(groups, table(spark, sf, "orders"), "o_custkey", ["o_orderkey"], "o_orderkey", 3)


@query(
    "candidate_lineage",
    """SELECT l_orderkey, l_linenumber, o_custkey, n_name, r_name FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS k FROM lineitem)
    JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE k = 1""",
)
def candidate_lineage(spark, sf):
    from pyspark.sql import Window as W

    first = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"))
    lines = table(spark, sf, "lineitem").withColumn("k", first).filter("k = 1")
    out = lines.join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    out = out.join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return out.select("l_orderkey", "l_linenumber", "o_custkey", "n_name", "r_name")


@query("source_directory", "SELECT source, CASE WHEN n_chars = 0 THEN 'failed' WHEN quality IS NULL THEN 'processing' ELSE 'ready' END AS state, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2")
def source_directory(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    state = F.when(F.col("n_chars") == 0, "failed").when(F.col("quality").isNull(), "processing").otherwise("ready")
    return rows.groupBy("source", state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query("assertion_batch", "SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id) AS total FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 200")
def assertion_batch(spark, sf):
    from ..operators.aggregates import top_per_group

    return top_per_group(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], 200).select("user_id", "event_id", "total")


@query("page_with_total", "SELECT o_orderkey, count(*) OVER () AS total FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 50")
def page_with_total(spark, sf):
    """A page of 50 and the number of all rows: the count is an aggregate of its own, not a window over all rows."""
    rows = table(spark, sf, "orders").filter("o_orderstatus = 'F'")
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.select("o_orderkey").orderBy("o_orderkey").limit(50).join(F.broadcast(total))  # one row


@query("project_directory", "SELECT n_name AS project, count(DISTINCT c_custkey) AS records, count(o_orderkey) AS facts FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def project_directory(spark, sf):
    facts = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("f"))
    each = table(spark, sf, "customer").join(facts, "c_custkey", "left").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("records"), F.sum("f").alias("facts"))
    rows = table(spark, sf, "nation").join(each, "n_nationkey", "left")
    return rows.select(F.col("n_name").alias("project"), F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("facts", F.lit(0)).alias("facts"))


@query(
    "ocr_quality_gate",
    """SELECT user_id, round(avg(value), 6) AS mean, round(count(*) FILTER (WHERE value < 20) / count(*), 6) AS low_ratio, sum(length(event_type))::BIGINT AS chars,
    avg(value) >= 90 AND count(*) FILTER (WHERE value < 20) / count(*) <= 0.2 AND sum(length(event_type)) >= 60 AS passed FROM events GROUP BY 1""",
)
def ocr_quality_gate(spark, sf):
    out = context.quality_gate(table(spark, sf, "events"), "user_id", "value", "event_type", 90, 20, 0.2, 60)
    return out.withColumns({"mean": F.round("mean", 6), "low_ratio": F.round("low_ratio", 6)})


@query("expected_state_digest", "SELECT n_regionkey, sha256(string_agg(n_nationkey || '=' || n_name, ',' ORDER BY n_nationkey)) AS digest FROM nation GROUP BY 1")
def expected_state_digest(spark, sf):
    pair = F.struct("n_nationkey", F.concat_ws("=", F.col("n_nationkey").cast("string"), "n_name").alias("v"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(pair)), lambda x: x["v"]), ",")
    return table(spark, sf, "nation").groupBy("n_regionkey").agg(F.sha2(joined, 256).alias("digest"))


@query("linked_record_keys", f"WITH {model.RELATIONS_SQL} SELECT src AS key FROM r WHERE type = 'part_of' UNION SELECT dst FROM r WHERE type = 'part_of' UNION SELECT edge FROM r WHERE type = 'part_of'")
def linked_record_keys(spark, sf):
    rows = model.relations(spark, sf).filter("type = 'part_of'")
    return rows.select(F.explode(F.array("src", "dst", "edge")).alias("key")).distinct()


@query("nfc_terms", "SELECT doc_id, nfc_normalize(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS term FROM documents")
def nfc_terms(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.nfc_term(F.col("text")).alias("term"))


_IRI = f"(regexp_matches(iri, '{text.HTTP_IRI}') OR regexp_matches(iri, '{text.URN_IRI}')) AND NOT regexp_matches(iri, '{text.NOT_IN_IRI}')"


@query(
    "local_names",
    f"""WITH u AS (SELECT page_id, url, CASE page_id % 4 WHEN 0 THEN 'urn:page:' || page_id WHEN 1 THEN url WHEN 2 THEN url || '#a#b' ELSE 'mailto:' || url END AS iri FROM pages)
    SELECT page_id, {_IRI} AS valid, regexp_extract(url, '([^/#?]*)(?:[?][^/#]*)?$', 1) AS local_name FROM u""",
)
def local_names(spark, sf):
    url, k = F.col("url"), F.col("page_id") % 4
    iri = F.when(k == 0, F.concat(F.lit("urn:page:"), F.col("page_id").cast("string"))).when(k == 1, url).when(k == 2, F.concat(url, F.lit("#a#b"))).otherwise(F.concat(F.lit("mailto:"), url))
    return table(spark, sf, "pages").select("page_id", text.is_iri(iri).alias("valid"), text.local_name(url).alias("local_name"))


@query("epoch_parts", "SELECT event_id, epoch_us(ts) // 1000 AS ms, epoch_us(ts)::BIGINT AS us FROM events")
def epoch_parts(spark, sf):
    at = F.col("ts").cast("timestamp")
    return table(spark, sf, "events").select("event_id", F.unix_millis(at).alias("ms"), F.unix_micros(at).alias("us"))


@query(
    "strict_iso_epoch",
    """WITH x AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN strftime(o_orderdate, '%d/%m/%Y') ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') END AS s, o_orderdate FROM orders)
    SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 2 THEN epoch(o_orderdate)::BIGINT END AS seconds FROM x""",
)
def strict_iso_epoch(spark, sf):
    style = lambda f: F.date_format("o_orderdate", f)
    k = F.col("o_orderkey") % 4
    s = F.when(k == 0, style("yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 1, style("yyyy-MM-dd")).when(k == 2, style("dd/MM/yyyy")).otherwise(style("yyyy-MM-dd'T'HH:mm:ss"))
    return table(spark, sf, "orders").select("o_orderkey", F.unix_seconds(temporal.iso_instant(s)).alias("seconds"))


# ---- rankings over scopes --------------------------------------------------


@query("global_rank", "WITH b AS (SELECT label, max(embedding[1]) AS score, arg_max(vec_id, (embedding[1], -vec_id)) AS vec_id FROM embeddings GROUP BY 1) SELECT label, vec_id, row_number() OVER (ORDER BY score DESC, vec_id)::INTEGER AS rank FROM b QUALIFY rank <= 50")
def global_rank(spark, sf):
    """The best of every version first, then one ranking over all, to a depth of min(1000, max(50, 5 k))."""
    rows = table(spark, sf, "embeddings").withColumn("score", F.col("embedding")[0])
    best = ranking.best_per_parent(rows, "label", "score", "vec_id")
    return ranking.top(best, "score", "vec_id", min(1000, max(50, 5 * 10))).select("label", "vec_id", "rank")


@query("type_channel", f"WITH {model.ENTITIES_SQL} SELECT id FROM e WHERE type IN ('supplier', 'nation') ORDER BY id LIMIT 200")
def type_channel(spark, sf):
    return model.entities(spark, sf).filter(F.col("type").isin("supplier", "nation")).select("id").orderBy("id").limit(200)


@query(
    "hit_hydration",
    f"""WITH {model.VERSIONS_SQL}, h AS (SELECT id, version, value AS score FROM v WHERE event_type = 'click'), c AS (SELECT * FROM v WHERE superseded_at IS NULL AND (valid_until IS NULL OR valid_until > TIMESTAMP '{VALID}'))
    SELECT c.id, c.version::INTEGER AS version, h.score FROM h JOIN c ON c.id = h.id AND c.version = h.version QUALIFY row_number() OVER (PARTITION BY c.id ORDER BY h.score DESC, c.version) = 1""",
)
def hit_hydration(spark, sf):
    """Hits of an index count only if their very version is in scope now; the best hit of an id stays."""
    rows = model.versions(spark, sf)
    hits = rows.filter("event_type = 'click'").select("id", "version", F.col("value").alias("score"))
    scope = rows.filter(F.col("superseded_at").isNull() & (F.col("valid_until").isNull() | (F.col("valid_until") > instant(VALID)))).select("id", "version")
    return hits.join(scope, ["id", "version"]).groupBy("id").agg(F.min_by(F.struct("version", "score"), F.struct(-F.col("score"), "version")).alias("b")).select("id", "b.*")


@query(
    "reference_candidates",
    """WITH t AS (SELECT unnest(['the', 'of', 'and', 'que', 'en']) AS term), s AS (SELECT source, doc_id, count(*) FILTER (WHERE contains(lower(text), term)) AS score FROM documents, t GROUP BY 1, 2)
    SELECT source, doc_id, score::INTEGER AS score FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) <= 500""",
)
def reference_candidates(spark, sf):
    score = F.lit(0)
    for term in ("the", "of", "and", "que", "en"):
        score = score + F.contains(F.lower("text"), F.lit(term)).cast("int")
    rows = table(spark, sf, "documents").select("source", "doc_id", score.alias("score")).filter("score > 0")
    return ranking.top(rows, "score", "doc_id", 500, ["source"]).select("source", "doc_id", "score")


@query(
    "protected_merge",
    "WITH d AS (SELECT vec_id, row_number() OVER (ORDER BY embedding[1] DESC, vec_id) AS k FROM embeddings QUALIFY k <= 12), x AS (SELECT vec_id, row_number() OVER (ORDER BY embedding[2] DESC, vec_id) AS k FROM embeddings QUALIFY k <= 12), f AS (SELECT * FROM x WHERE vec_id NOT IN (SELECT vec_id FROM d) ORDER BY k LIMIT 4) SELECT vec_id, 0 AS \"group\" FROM d WHERE k <= 12 - (SELECT count(*) FROM f) UNION ALL SELECT vec_id, 1 FROM f",
)
def protected_merge(spark, sf):
    rows = table(spark, sf, "embeddings")
    by = lambda i: ranking.top(rows.withColumn("score", F.col("embedding")[i]), "score", "vec_id", 12)
    return ranking.protected_merge(by(0), by(1), "vec_id", 12).select("vec_id", "group")


# ---- graph sessions --------------------------------------------------------


@query(
    "linked_explore",
    f"""WITH {model.ENTITIES_SQL}, {model.RELATIONS_SQL}, s AS (SELECT id FROM e WHERE contains(text, 'cold')), f AS (SELECT id FROM e WHERE type IN ('supplier', 'nation', 'part'))
    SELECT DISTINCT edge, src, dst FROM r WHERE (src IN (SELECT id FROM s) OR dst IN (SELECT id FROM s)) AND src IN (SELECT id FROM f) AND dst IN (SELECT id FROM f)""",
)
def linked_explore(spark, sf):
    """Relations at the text hits, between entities of the asked types."""
    every = model.entities(spark, sf)
    hits = every.filter(F.contains("text", F.lit("cold"))).select("id")
    return graph.around(model.relations(spark, sf).select("edge", "src", "dst"), hits, every.filter(F.col("type").isin("supplier", "nation", "part")).select("id"))


@query("session_manifest", f"WITH {model.ENTITIES_SQL}, {model.RELATIONS_SQL} SELECT 'entity' AS kind, count(*) AS total, max(id) AS last FROM e UNION ALL SELECT 'relation', count(*), max(edge) FROM r")
def session_manifest(spark, sf):
    return context.compact_rows(model.entities(spark, sf), model.relations(spark, sf)).groupBy("kind").agg(F.count(F.lit(1)).alias("total"), F.max("id").alias("last"))


@query("session_connected_page", f"WITH {model.RELATIONS_SQL} SELECT edge, src, dst FROM r WHERE (src = 'supplier:1' OR dst = 'supplier:1') AND edge > 'sp:1' ORDER BY edge LIMIT 100")
def session_connected_page(spark, sf):
    from ..operators.versions import keyset_page

    rows = model.relations(spark, sf).select("edge", "src", "dst").filter("src = 'supplier:1' or dst = 'supplier:1'")
    return keyset_page(rows, ["edge"], ("sp:1",), 100)


@query(
    "neighbourhood_edges",
    f"""WITH {model.RELATIONS_SQL}, b AS (SELECT src AS a, dst AS b FROM r UNION SELECT dst, src FROM r), n AS (SELECT 'region:1' AS id UNION SELECT b FROM b WHERE a = 'region:1' UNION SELECT y.b FROM b x JOIN b y ON y.a = x.b WHERE x.a = 'region:1')
    SELECT edge, src, dst FROM r WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)""",
)
def neighbourhood_edges(spark, sf):
    edges = model.relations(spark, sf).select("edge", "src", "dst")
    seeds = spark.createDataFrame([("region:1",)], "node string")
    return graph.neighbourhood(edges, seeds, 2, 10**9, 10**9)[1]


# ---- governance ------------------------------------------------------------


@query("stale_writes", f"WITH {model.VERSIONS_SQL} SELECT c.id, c.version::INTEGER AS expected_version FROM v c JOIN v n ON n.id = c.id AND n.superseded_at IS NULL WHERE c.version <> n.version")
def stale_writes(spark, sf):
    rows = model.versions(spark, sf)
    changes = rows.select("id", F.col("version").alias("expected_version"))
    return governance.stale_writes(changes, rows.filter("superseded_at is null"), "id").select("id", "expected_version")


@query(
    "illegal_transitions",
    f"WITH {model.DECISIONS_SQL}, x AS (SELECT *, coalesce(lag(to_status) OVER (PARTITION BY assertion_id ORDER BY decision_version), 'pending') AS from_status FROM d) SELECT assertion_id, decision_version, from_status, to_status FROM x WHERE (from_status, to_status) NOT IN (('pending', 'accepted'), ('pending', 'rejected'), ('accepted', 'rejected'))",
)
def illegal_transitions(spark, sf):
    out = governance.illegal_transitions(model.decisions(spark, sf), "assertion_id", "decision_version", "to_status")
    return out.select("assertion_id", "decision_version", "from_status", "to_status")


@query(
    "merge_entity",
    f"""WITH {model.RELATIONS_SQL} SELECT 'nation:2' AS id, 'tombstone' AS action, NULL AS src, NULL AS dst
    UNION ALL SELECT edge, 'upsert', CASE WHEN src = 'nation:2' THEN 'nation:1' ELSE src END, CASE WHEN dst = 'nation:2' THEN 'nation:1' ELSE dst END FROM r WHERE src = 'nation:2' OR dst = 'nation:2'""",
)
def merge_entity(spark, sf):
    return governance.merge_entity(model.entities(spark, sf), model.relations(spark, sf), "nation:1", "nation:2")


@query("undo_parity", "WITH l AS (SELECT o_orderkey AS operation, o_orderkey + 1 AS undone_by FROM orders), g AS (SELECT operation FROM l WHERE operation % 5 = 4), m AS (SELECT max(o_orderkey) AS top FROM orders) SELECT operation, ((least((operation // 5) * 5 + 4, top) - operation) % 2 = 0) AS active FROM l, m")
def undo_parity(spark, sf):
    """Chains of five operations, each but the first undoing the one before it."""
    k = F.col("o_orderkey")
    return governance.undo_parity(table(spark, sf, "orders").select(k.alias("operation"), F.when(k % 5 != 0, k - 1).alias("reversal_of")))


@query(
    "shape_violations",
    f"""WITH {model.RELATIONS_SQL}, t AS (SELECT id, count(edge) AS n FROM (SELECT 'supplier:' || s_suppkey AS id FROM supplier) LEFT JOIN r ON src = id AND type = 'supplies' GROUP BY 1)
    SELECT id AS subject, 'supplies' AS predicate, 'min_count' AS rule FROM t WHERE n < 60 UNION ALL SELECT id, 'supplies', 'max_count' FROM t WHERE n > 600
    UNION ALL SELECT DISTINCT src, 'part_of', 'one_of' FROM r WHERE type = 'part_of' AND dst NOT IN ('region:0', 'region:1')""",
)
def shape_violations(spark, sf):
    targets = table(spark, sf, "supplier").select(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("src"))
    shapes = [{"predicate": "supplies", "min_count": 60, "max_count": 600, "targets": targets}, {"predicate": "part_of", "one_of": ["region:0", "region:1"]}]
    return governance.shape_violations(model.relations(spark, sf), "src", "type", "dst", shapes)


@query("dictionary_matches", "SELECT p_partkey AS id, length(p_name) - length('widget') AS start, length(p_name) AS stop, 'widget' AS term FROM part WHERE ends_with(p_name, ' widget')")
def dictionary_matches(spark, sf):
    out = patterns.dictionary_matches(table(spark, sf, "part"), "p_partkey", "p_name", spark.createDataFrame([("widget",), ("wid",)], "name string"))
    return out.select("id", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), "term")


@query(
    "box_duplicates",
    """WITH b AS (SELECT o_custkey AS g, o_orderkey AS id, (o_totalprice / 100)::INTEGER AS x0, (o_totalprice / 100)::INTEGER + 400 AS x1, month(o_orderdate) * 10 AS y0, month(o_orderdate) * 10 + 100 AS y1 FROM orders),
    p AS (SELECT a.g, a.id AS "left", b.id AS "right", greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS i FROM b a JOIN b ON a.g = b.g AND a.id < b.id)
    SELECT g, "left", "right" FROM p WHERE i / (80000 - i) >= 0.6 OR i / 40000 >= 0.9""",
)
def box_duplicates(spark, sf):
    x, y = F.rint(F.col("o_totalprice") / 100).cast("int"), F.month("o_orderdate") * 10
    boxes = table(spark, sf, "orders").select(F.col("o_custkey").alias("g"), F.col("o_orderkey").alias("id"), x.alias("x0"), (x + 400).alias("x1"), y.alias("y0"), (y + 100).alias("y1"))
    return governance.box_duplicates(boxes, ["g"])


@query("term_resolution", "WITH s AS (SELECT p_name AS name, p_brand AS term FROM part) SELECT name, CASE WHEN count(DISTINCT term) = 1 THEN min(term) END AS term, count(DISTINCT term) > 1 AS ambiguous FROM s GROUP BY 1")
def term_resolution(spark, sf):
    part = table(spark, sf, "part")
    return governance.term_resolution(part.select(F.col("p_name").alias("name")).distinct(), part.select(F.col("p_name").alias("surface"), F.col("p_brand").alias("term")))


@query(
    "mapped_spans",
    """WITH d AS (SELECT doc_id, length(text) AS n FROM documents WHERE length(text) > 0), w AS (SELECT doc_id, i AS ordinal, i * 700 AS a, least(i * 700 + 1000, n) AS b FROM d, unnest(range(0, (greatest(0, ceil((n - 1000) / 700.0)) + 1)::BIGINT)) t(i)),
    s AS (SELECT doc_id, i AS span, i * 450 AS a, least(i * 450 + 450, n) AS b FROM d, unnest(range(0, (greatest(0, ceil((n - 450) / 450.0)) + 1)::BIGINT)) t(i))
    SELECT w.doc_id, ordinal::INTEGER AS ordinal, span::INTEGER AS span, greatest(s.a, w.a) - w.a AS start, least(s.b, w.b) - w.a AS stop FROM w JOIN s ON s.doc_id = w.doc_id AND s.a < w.b AND s.b > w.a""",
)
def mapped_spans(spark, sf):
    docs = table(spark, sf, "documents")
    windows = documents.fixed_chunks(docs, "doc_id", "text", 1000, 300).select("doc_id", "ordinal", "start", "stop")
    spans = documents.fixed_chunks(docs, "doc_id", "text", 450, 0).select("doc_id", F.col("ordinal").alias("span"), "start", "stop")
    out = governance.mapped_spans(windows, spans, "doc_id")
    return out.select("doc_id", "ordinal", "span", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"))


@query("triple_diff", "SELECT c_custkey, c_mktsegment, 'added' AS change FROM customer WHERE c_acctbal < 0 UNION ALL SELECT c_custkey, c_mktsegment, 'removed' FROM customer WHERE c_acctbal > 9000")
def triple_diff(spark, sf):
    rows = table(spark, sf, "customer")
    pick = lambda c: rows.filter(c).select("c_custkey", "c_mktsegment")
    return governance.triple_diff(pick("c_acctbal >= 0"), pick("c_acctbal <= 9000"))


@query(
    "document_dates",
    """SELECT o_orderkey AS id, 'published_at' AS field, o_orderdate - INTERVAL 8 HOUR AS value, 'extracted' AS status FROM orders
    UNION ALL SELECT o_orderkey, 'valid_until', o_orderdate + INTERVAL 16 HOUR, 'extracted' FROM orders
    UNION ALL SELECT o_orderkey, 'valid_from', CASE o_orderkey % 3 WHEN 0 THEN o_orderdate - INTERVAL 30 DAY END, CASE o_orderkey % 3 WHEN 0 THEN 'manual' ELSE 'review' END FROM orders WHERE o_orderkey % 3 < 2
    UNION ALL SELECT o_orderkey, 'revised_at', o_orderdate - INTERVAL 8 HOUR, 'extracted' FROM orders WHERE o_orderkey % 2 = 1""",
)
def document_dates(spark, sf):
    # Lines that begin with a quotation or with code say what follows it; every third document has a date set by hand.
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    key = F.col("o_orderkey")
    body = F.concat(
        F.lit("# 规则\n发布日期："), day, F.lit("\n\n“旧稿”本规则有效至"), day, F.lit("。“本规则自2001年1月1日起失效。”\n"),
        F.when(key % 3 == 1, F.lit("本规则自2001年1月1日起施行。本规则自2002年1月1日起施行。\n")).otherwise(F.lit("")),
        F.when(key % 2 == 1, F.concat(F.lit("`v2`本规则于"), day, F.lit("修订。\n"))).otherwise(F.lit("    本规则于2003年1月1日修订。\n")),
    )
    by_hand = F.when(key % 3 == 0, F.expr("o_orderdate - INTERVAL 30 DAY"))
    rows = table(spark, sf, "orders").withColumn("body", body).withColumn("by_hand", by_hand)
    return dates.dated(rows, "o_orderkey", "body", given={"valid_from": "by_hand"}).select("id", "field", "value", "status")


@query("markdown_blocks", "SELECT p_partkey AS id, 0 AS ordinal, 'heading' AS kind, p_brand AS path, p_brand AS text FROM part UNION ALL SELECT p_partkey, 1, 'paragraph', p_brand, p_name FROM part UNION ALL SELECT p_partkey, 2, 'table', p_brand, '|a|' || chr(10) || '|-|' FROM part")
def markdown_blocks(spark, sf):
    body = F.concat(F.lit("# "), "p_brand", F.lit("\n\n"), "p_name", F.lit("\n\n|a|\n|-|\n"))
    parts = dealt(table(spark, sf, "part").select("p_partkey", "p_brand", "p_name"), "p_partkey")
    return documents.marked_blocks(parts.withColumn("body", body), "p_partkey", "body").select("id", "ordinal", "kind", "path", "text")


_BLOCK_CHUNKS = """
WITH lines AS (SELECT p_partkey, p_brand, p_size, length(p_brand) + length(p_name) + 6 AS base, i, (i - 1) // 7 AS piece,
        lpad(i::VARCHAR, 2, '0') || ' | ' || lpad(p_partkey::VARCHAR, 8, '0') AS line FROM part, unnest(range(1, p_size + 1)) t(i))
SELECT p_partkey AS id, 0 AS ordinal, 'prose' AS kind, 0 AS start, p_brand AS path, '# ' || p_brand || chr(10) || chr(10) || p_name AS chunk FROM part
UNION ALL
SELECT p_partkey, (1 + piece)::INTEGER, 'table', (base + CASE WHEN p_size > 7 THEN 10 + 98 * piece ELSE 0 END)::INTEGER, p_brand,
    'ln | part' || chr(10) || string_agg(line, chr(10) ORDER BY i) FROM lines GROUP BY p_partkey, p_brand, p_size, base, piece
"""


@query("block_chunks", _BLOCK_CHUNKS)
def block_chunks(spark, sf):
    """A table of p_size rows under a paragraph; seven rows fit a chunk beside the header."""
    row = lambda i: F.concat(F.lit("|"), F.lpad(i.cast("string"), 2, "0"), F.lit("|"), F.lpad(F.col("p_partkey").cast("string"), 8, "0"), F.lit("|"))
    lines = F.array_join(F.transform(F.sequence(F.lit(1), F.col("p_size")), row), "\n")
    body = F.concat(F.lit("# "), "p_brand", F.lit("\n\n"), "p_name", F.lit("\n\n|ln|part|\n|-|-|\n"), lines)
    # Files are split by their bytes, and a part's bytes are few beside its text: parts are dealt before texts are made.
    parts = dealt(table(spark, sf, "part").select("p_partkey", "p_brand", "p_name", "p_size"), "p_partkey")
    rows = documents.block_chunks(parts.withColumn("body", body), "p_partkey", "body", 120, 20)
    return rows.select("id", "ordinal", "kind", "start", "path", "chunk")


# ---- outbox ----------------------------------------------------------------


@query("outbox_append", "SELECT event_type AS project, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) + length(event_type) AS seq FROM events")
def outbox_append(spark, sf):
    log = table(spark, sf, "events").select(F.col("event_type").alias("project"), "event_id", "ts")
    last = log.select("project").distinct().withColumn("seq", F.char_length("project").cast("long"))
    return context.numbered(log, "project", ["ts", "event_id"], last).select("project", "event_id", "seq")


@query("generation_cleanup", "WITH g AS (SELECT o_custkey AS project, o_orderkey AS generation, o_orderdate AS retired_at, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS age FROM orders) SELECT project, generation FROM g WHERE age > 2 AND retired_at <= TIMESTAMP '1998-01-01' - INTERVAL 7 DAY")
def generation_cleanup(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("generation"), F.col("o_orderdate").alias("retired_at"))
    return context.expired_generations(rows, "project", instant("1998-01-01 00:00:00")).select("project", "generation")


@query("rebuild_catch_up", "WITH c AS (SELECT user_id, max(event_id) AS seq, arg_max(event_type, event_id) AS t FROM events GROUP BY 1) SELECT user_id, seq FROM c WHERE t <> 'error'")
def rebuild_catch_up(spark, sf):
    """A snapshot of the first half of the log, folded with all changes; tombstones are errors."""
    log = table(spark, sf, "events").select("user_id", F.col("event_id").alias("seq"), F.col("event_type").alias("t"))
    half = log.agg((F.max("seq") / 2).cast("long").alias("half"))
    early = log.join(F.broadcast(half)).filter("seq <= half").drop("half")  # one row
    snapshot = context.caught_up(early.limit(0), early.withColumn("gone", F.col("t") == "error"), ["user_id"], "seq", "gone")
    return context.caught_up(snapshot, log.withColumn("gone", F.col("t") == "error"), ["user_id"], "seq", "gone").select("user_id", "seq")


@query("stable_chunk_ids", f"SELECT doc_id, i::INTEGER AS ordinal, left(sha256(doc_id || chr(31) || i), 32) AS chunk_id FROM documents, {_WINDOWS}")
def stable_chunk_ids(spark, sf):
    chunks = documents.fixed_chunks(table(spark, sf, "documents"), "doc_id", "text")
    return chunks.select("doc_id", "ordinal", context.stable_id(F.col("doc_id"), F.col("ordinal")).alias("chunk_id"))


@query(
    "focused_locations",
    """WITH l AS (SELECT o_orderkey AS k, 10 AS a, 10 + (o_totalprice / 1000)::INTEGER AS b FROM orders), m AS (SELECT l_orderkey AS k, (l_quantity * 4)::INTEGER AS a, (l_quantity * 4)::INTEGER + 20 AS b FROM lineitem)
    SELECT l.k, greatest(l.a, m.a) AS start, least(l.b, m.b) AS stop FROM l JOIN m ON m.k = l.k AND l.a < m.b AND l.b > m.a""",
)
def focused_locations(spark, sf):
    a = F.lit(10)
    locations = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), a.alias("start"), (a + F.rint(F.col("o_totalprice") / 1000).cast("int")).alias("stop"))
    q = F.rint(F.col("l_quantity") * 4).cast("int")
    return context.focused(locations, table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), q.alias("start"), (q + 20).alias("stop")), "k")


@query("direct_or_supported", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) OR EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'F' AND l_shipdate <= TIMESTAMP '1998-01-01')")
def direct_or_supported(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_shipdate").alias("known_from"), "l_linestatus", F.lit(None).cast("timestamp_ntz").alias("known_until"))
    return qualify.direct_or_supported(table(spark, sf, "orders").select("o_orderkey"), lines, lines.filter("l_linestatus = 'F'"), "o_orderkey", instant("1998-01-01 00:00:00"))


@query("row_fingerprints", "SELECT n_nationkey, sha256('{\"n_name\":\"' || n_name || '\",\"n_regionkey\":' || n_regionkey || '}') AS fingerprint FROM nation")
def row_fingerprints(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", extras.fingerprint("n_name", "n_regionkey").alias("fingerprint"))


@query("redacted_texts")
def redacted_texts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.redacted(F.col("text")).alias("text"))


@query("sequence_similarity")
def sequence_similarity(spark, sf):
    """Boxes of one asset whose texts are alike: part names of one brand."""
    part = table(spark, sf, "part").select("p_brand", "p_name").distinct()
    near = part.join(part.withColumnRenamed("p_name", "other"), "p_brand").filter("p_name < other")
    return near.filter(text.sequence_ratio(F.col("p_name"), F.col("other")) >= 0.85)
