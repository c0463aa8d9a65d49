"""One registered query per operator, with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import applicability, filters, temporal, text
from ..operators import aggregates, documents, graph, identity, inverted, qualify, ranking, versions
from ..operators.recovery import scratch_dir
from ..streaming import outbox
from . import model
from .model import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

KNOWN, VALID = "2024-01-15 00:00:00", "2024-01-12 00:00:00"
DECIDED = "1998-01-01 00:00:00"


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def instant(at: str):
    return F.lit(at).cast("timestamp_ntz")


# ---- scans and versions ----------------------------------------------------


@query(
    "bitemporal_as_of",
    f"""WITH {model.VERSIONS_SQL} SELECT id, version::INTEGER AS version, value, valid_from, valid_until FROM v
    WHERE recorded_at <= TIMESTAMP '{KNOWN}' AND (superseded_at IS NULL OR superseded_at > TIMESTAMP '{KNOWN}')
      AND (valid_from IS NULL OR valid_from <= TIMESTAMP '{VALID}') AND (valid_until IS NULL OR valid_until > TIMESTAMP '{VALID}')""",
)
def bitemporal_as_of(spark, sf):
    rows = versions.as_of(model.versions(spark, sf), instant(KNOWN), instant(VALID))
    return rows.select("id", "version", "value", "valid_from", "valid_until")


@query(
    "current_versions",
    f"WITH {model.VERSIONS_SQL} SELECT id, version::INTEGER AS version, value, recorded_at FROM v WHERE superseded_at IS NULL",
)
def current_versions(spark, sf):
    return versions.as_of(model.versions(spark, sf), None).select("id", "version", "value", "recorded_at")


@query(
    "record_history",
    f"WITH {model.VERSIONS_SQL} SELECT id, version::INTEGER AS version, recorded_at, superseded_at FROM v WHERE id LIKE '%:click'",
)
def record_history(spark, sf):
    return model.versions(spark, sf).filter(F.col("id").endswith(":click")).select("id", "version", "recorded_at", "superseded_at")


@query(
    "records_at_knowledge_time",
    f"""WITH {model.VERSIONS_SQL}, a AS (SELECT user_id || ':view' AS asked_id, min(ts) + INTERVAL 5 DAY AS asked_at FROM events GROUP BY user_id)
    SELECT asked_id, asked_at, version::INTEGER AS version, value FROM a JOIN v ON v.id = a.asked_id
      AND recorded_at <= asked_at AND (superseded_at IS NULL OR superseded_at > asked_at)""",
)
def records_at_knowledge_time(spark, sf):
    wanted = table(spark, sf, "events").groupBy("user_id").agg((F.min("ts") + F.expr("interval 5 days")).alias("asked"))
    wanted = wanted.select(F.concat(F.col("user_id").cast("string"), F.lit(":view")).alias("w"), "asked")
    return versions.as_of_lookup(model.versions(spark, sf), wanted, "w", "asked").select("asked_id", "asked_at", "version", "value")


@query(
    "timeline_events",
    f"""WITH {model.VERSIONS_SQL} SELECT date_trunc('day', recorded_at)::TIMESTAMP AS at, count(*) AS changed,
    count(*) FILTER (WHERE version = 1) AS created, count(*) FILTER (WHERE version > 1) AS revised FROM v GROUP BY 1""",
)
def timeline_events(spark, sf):
    return versions.timeline(model.versions(spark, sf), F.date_trunc("day", "recorded_at").cast("timestamp_ntz"))


@query(
    "version_manifest_digest",
    f"""WITH {model.VERSIONS_SQL}, p AS (SELECT event_type, substr(md5(id), 1, 4) AS slot, count(*) AS n,
      md5(string_agg(id || '#' || version, '' ORDER BY id, version)) AS d FROM v GROUP BY 1, 2)
    SELECT event_type, sum(n)::BIGINT AS n, md5(string_agg(d, '' ORDER BY slot)) AS digest FROM p GROUP BY 1""",
)
def version_manifest_digest(spark, sf):
    return versions.sliced_manifest(model.versions(spark, sf), "event_type")


@query(
    "version_manifest",
    f"""WITH {model.VERSIONS_SQL} SELECT event_type, count(*) AS total, md5(string_agg(id || '#' || version, ',' ORDER BY id, version)) AS version_digest FROM v GROUP BY 1""",
)
def version_manifest(spark, sf):
    return versions.version_manifest(model.versions(spark, sf), "event_type")


@query(
    "keyset_page",
    """SELECT o_orderdate, o_orderkey, o_totalprice FROM orders WHERE (o_orderdate, o_orderkey) > (TIMESTAMP '1997-06-01', 100)
    ORDER BY o_orderdate, o_orderkey LIMIT 201""",
)
def keyset_page(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderdate", "o_orderkey", "o_totalprice")
    import datetime

    return versions.keyset_page(rows, ["o_orderdate", "o_orderkey"], (datetime.datetime(1997, 6, 1), 100), 201)


@query(
    "restore_changes",
    f"""WITH {model.VERSIONS_SQL}, n AS (SELECT id, value FROM v WHERE superseded_at IS NULL), t AS (SELECT id, value FROM v
      WHERE recorded_at <= TIMESTAMP '{KNOWN}' AND (superseded_at IS NULL OR superseded_at > TIMESTAMP '{KNOWN}'))
    SELECT coalesce(n.id, t.id) AS key, CASE WHEN t.id IS NULL THEN 'tombstone' ELSE 'upsert' END AS action, t.value AS value
    FROM n FULL JOIN t ON n.id = t.id WHERE n.value IS DISTINCT FROM t.value OR n.id IS NULL OR t.id IS NULL""",
)
def restore_changes(spark, sf):
    rows = model.versions(spark, sf)
    found = versions.changes_to_restore(versions.as_of(rows, None), versions.as_of(rows, instant(KNOWN)), "id", ["value"])
    return found.select("key", "action", F.col("then.value").alias("value"))


# ---- filters and scopes ----------------------------------------------------

_FILTERS = {
    "range": {"and": [{"field": "k", "op": "gte", "value": 20}, {"field": "k", "op": "lt", "value": 60}]},
    "in": {"or": [{"field": "k", "op": "in", "value": [1, 2, 3]}, {"field": "type", "op": "eq", "value": "error"}]},
    "ne": {"and": [{"field": "k", "op": "ne", "value": 7}, {"field": "missing", "op": "exists", "value": False}]},
    "missing": {"or": [{"field": "missing", "op": "ne", "value": 1}, {"field": "k", "op": "eq", "value": 50.0}]},
}
_FILTER_SQL = {
    "range": "(props->>'$.k')::INTEGER >= 20 AND (props->>'$.k')::INTEGER < 60",
    "in": "(props->>'$.k')::INTEGER IN (1, 2, 3) OR event_type = 'error'",
    "ne": "(props->>'$.k')::INTEGER <> 7",
    "missing": "(props->>'$.k')::INTEGER = 50",
}
for _name, _ast in _FILTERS.items():

    @query(f"filter_ast_{_name}", f"SELECT event_id, event_type, props FROM events WHERE {_FILTER_SQL[_name]}")
    def _filtered(spark, sf, ast=_ast):
        rows = table(spark, sf, "events").select("event_id", "event_type", "props")
        return rows.filter(filters.to_column(ast, F.try_parse_json("props"), {"type": F.col("event_type")}))


_SCOPE = {"platforms": {"mode": "specific", "values": ["BUILDING", "MACHINERY"]}}


@query(
    "scope_applicability",
    "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 5 = 0 OR (c_custkey % 5 <> 1 AND c_mktsegment IN ('BUILDING', 'MACHINERY'))",
)
def scope_applicability(spark, sf):
    mode = F.when(F.col("c_custkey") % 5 == 0, "all").when(F.col("c_custkey") % 5 == 1, "unknown").otherwise("specific")
    rows = table(spark, sf, "customer")
    met = applicability.scope_matches({"platforms": (mode, F.array("c_mktsegment"))}, _SCOPE)
    return rows.filter(met).select("c_custkey", "c_mktsegment")


@query(
    "platform_groups",
    """WITH c AS (SELECT *, CASE c_custkey % 5 WHEN 0 THEN 'all' WHEN 1 THEN 'unknown' ELSE 'specific' END AS mode FROM customer),
    g AS (SELECT CASE mode WHEN 'specific' THEN c_mktsegment ELSE mode END AS grp, c_custkey, c_acctbal FROM c)
    SELECT grp, c_custkey, c_acctbal, row_number() OVER (PARTITION BY grp ORDER BY c_acctbal DESC, c_custkey)::INTEGER AS rank FROM g
    QUALIFY rank <= 5""",
)
def platform_groups(spark, sf):
    mode = F.when(F.col("c_custkey") % 5 == 0, "all").when(F.col("c_custkey") % 5 == 1, "unknown").otherwise("specific")
    rows = table(spark, sf, "customer").withColumn("grp", F.when(mode == "specific", F.col("c_mktsegment")).otherwise(mode))
    return ranking.top(rows, "c_acctbal", "c_custkey", 5, ["grp"]).select("grp", "c_custkey", "c_acctbal", "rank")


@query(
    "temporal_status",
    f"""WITH {model.VERSIONS_SQL} SELECT CASE WHEN valid_from >= valid_until THEN 'conflict' WHEN valid_until <= TIMESTAMP '{VALID}' THEN 'expired'
      WHEN valid_from > TIMESTAMP '{VALID}' THEN 'not_yet_effective' WHEN valid_from IS NOT NULL THEN 'effective' ELSE 'unknown' END AS status,
      count(*) AS n FROM v GROUP BY 1""",
)
def temporal_status(spark, sf):
    status = temporal.temporal_status(F.col("valid_from"), F.col("valid_until"), instant(VALID))
    return model.versions(spark, sf).groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


# ---- joins -----------------------------------------------------------------


@query(
    "qualified_relations",
    f"""WITH {model.RELATIONS_SQL}, q AS (SELECT 'supplier:' || s_suppkey AS id FROM supplier WHERE s_acctbal > 0
      UNION SELECT 'part:' || p_partkey FROM part WHERE p_size > 25)
    SELECT edge, src, dst FROM r WHERE type = 'supplies' AND src IN (SELECT id FROM q) AND dst IN (SELECT id FROM q)""",
)
def qualified_relations(spark, sf):
    s = table(spark, sf, "supplier").filter("s_acctbal > 0").select(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("id"))
    p = table(spark, sf, "part").filter("p_size > 25").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"))
    rows = model.relations(spark, sf).filter("type = 'supplies'")
    return qualify.with_endpoints(rows, s.union(p), {"src": "id", "dst": "id"}).select("edge", "src", "dst")


@query(
    "source_support",
    f"""WITH {model.DECISIONS_SQL}, s AS (SELECT assertion_id, to_status, created_at AS known_from,
      lead(created_at) OVER (PARTITION BY assertion_id ORDER BY decision_version) AS known_until FROM d)
    SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT assertion_id FROM d)
      OR o_orderkey IN (SELECT assertion_id FROM s WHERE to_status = 'accepted' AND known_from <= TIMESTAMP '{DECIDED}'
        AND (known_until IS NULL OR known_until > TIMESTAMP '{DECIDED}'))""",
)
def source_support(spark, sf):
    log = model.decisions(spark, sf)
    support = versions.support_intervals(log, "assertion_id", ["decision_version"], "created_at", "to_status", "accepted")
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("assertion_id"))
    found = qualify.direct_or_supported(rows, log.select("assertion_id"), support, "assertion_id", instant(DECIDED))
    return found.select(F.col("assertion_id").alias("o_orderkey"))


@query(
    "support_intervals",
    f"""WITH {model.DECISIONS_SQL}, s AS (SELECT *, lead(created_at) OVER (PARTITION BY assertion_id ORDER BY decision_version) AS known_until FROM d)
    SELECT assertion_id, decision_version, created_at AS known_from, known_until,
      CASE WHEN known_until < created_at THEN 'reversed interval' END AS invalid_reason FROM s WHERE to_status = 'accepted'""",
)
def support_intervals(spark, sf):
    log = model.decisions(spark, sf)
    out = versions.support_intervals(log, "assertion_id", ["decision_version"], "created_at", "to_status", "accepted")
    return out.select("assertion_id", "decision_version", "known_from", "known_until", "invalid_reason")


@query(
    "as_of_decision",
    f"""WITH {model.DECISIONS_SQL} SELECT assertion_id, decision_version, to_status FROM d WHERE created_at <= TIMESTAMP '{DECIDED}'
    QUALIFY row_number() OVER (PARTITION BY assertion_id ORDER BY decision_version DESC) = 1""",
)
def as_of_decision(spark, sf):
    log = model.decisions(spark, sf).select("assertion_id", "decision_version", "created_at", "to_status")
    found = versions.latest_before(log, "assertion_id", "decision_version", F.col("created_at") <= instant(DECIDED))
    return found.select("assertion_id", "decision_version", "to_status")


@query(
    "incident_entities",
    f"WITH {model.RELATIONS_SQL} SELECT src AS id FROM r UNION SELECT dst FROM r",
)
def incident_entities(spark, sf):
    return qualify.incident_entities(model.relations(spark, sf), "src", "dst")


@query(
    "neighbor_chunks",
    """WITH c AS (SELECT doc_id, i AS ordinal FROM documents, unnest(range(0, (CASE WHEN length(text) = 0 THEN 0 ELSE greatest(0, ceil((length(text) - 300) / 250.0)) + 1 END)::BIGINT)) t(i)),
    h AS (SELECT doc_id, ordinal AS centre FROM c WHERE ordinal = 2)
    SELECT c.doc_id, c.ordinal::INTEGER AS ordinal, (c.ordinal - h.centre)::INTEGER AS "offset" FROM c JOIN h USING (doc_id) WHERE abs(c.ordinal - h.centre) <= 1""",
)
def neighbor_chunks(spark, sf):
    rows = documents.fixed_chunks(table(spark, sf, "documents"), "doc_id", "text", 300, 50).select("doc_id", "ordinal")
    hits = rows.filter("ordinal = 2")
    return documents.neighbours(rows, "doc_id", ["ordinal"], hits, ["doc_id", "ordinal"], 1).select("doc_id", "ordinal", "offset")


# ---- aggregations ----------------------------------------------------------


@query("dashboard_counts", f"WITH {model.ENTITIES_SQL} SELECT type, count(*) AS n, count(*) FILTER (WHERE text LIKE '%1%') AS with_one FROM e GROUP BY type")
def dashboard_counts(spark, sf):
    return aggregates.counts_by(model.entities(spark, sf), ["type"], with_one=F.col("text").contains("1"))


@query(
    "reclassify_groups",
    """WITH g AS (SELECT p_type, p_brand, p_partkey, row_number() OVER (PARTITION BY p_type, p_brand ORDER BY p_partkey) AS place FROM part)
    SELECT p_type, p_brand, count(*) AS n, string_agg(p_partkey::VARCHAR, ',' ORDER BY place) FILTER (WHERE place <= 20) AS samples FROM g GROUP BY 1, 2""",
)
def reclassify_groups(spark, sf):
    return aggregates.sample_groups(table(spark, sf, "part"), ["p_type", "p_brand"], ["p_partkey"], "p_partkey", 20)


@query(
    "source_derivatives",
    """SELECT l_suppkey, l_returnflag, l_orderkey, l_linenumber, (row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey))::INTEGER AS place,
    count(*) OVER (PARTITION BY l_suppkey, l_returnflag) AS total FROM lineitem QUALIFY place <= 10""",
)
def source_derivatives(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_suppkey", "l_returnflag", "l_orderkey", "l_linenumber", "l_partkey")
    return aggregates.top_per_group(rows, ["l_suppkey", "l_returnflag"], ["l_orderkey", "l_linenumber", "l_partkey"], 10).drop("l_partkey")


@query(
    "metadata_facets",
    """SELECT 'k' AS path, count(*) AS records, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types,
    count(DISTINCT props->>'$.k') AS distinct_values FROM events WHERE props->>'$.k' IS NOT NULL""",
)
def metadata_facets(spark, sf):
    return aggregates.metadata_facets(table(spark, sf, "events"), "props", "event_type")


@query("metadata_groups", "SELECT props->>'$.k' AS k, count(*) AS n FROM events GROUP BY 1")
def metadata_groups(spark, sf):
    whole = F.to_json(F.try_parse_json("props"))
    rows = table(spark, sf, "events").groupBy(whole.alias("m")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.get_json_object("m", "$.k").alias("k"), "n")


@query("duplicate_groups", "SELECT p_name, p_brand, count(*) AS n, min(p_partkey) AS first_id, count(*) > 20 AS blocked FROM part GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_groups(spark, sf):
    return identity.duplicate_groups(table(spark, sf, "part"), ["p_name", "p_brand"], "p_partkey")


@query(
    "fact_support_counts",
    "SELECT l_suppkey, count(DISTINCT l_orderkey) AS assertions, count(DISTINCT l_partkey) AS documents FROM lineitem GROUP BY 1",
)
def fact_support_counts(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        F.count_distinct("l_orderkey").alias("assertions"), F.count_distinct("l_partkey").alias("documents")
    )


@query(
    "relation_usage",
    f"""WITH {model.RELATIONS_SQL}, {model.ENTITIES_SQL} SELECT r.type AS predicate, coalesce(a.type, '?') AS src_type, coalesce(b.type, '?') AS dst_type, count(*) AS n
    FROM r LEFT JOIN e a ON a.id = r.src LEFT JOIN e b ON b.id = r.dst GROUP BY 1, 2, 3""",
)
def relation_usage(spark, sf):
    return aggregates.usage(model.relations(spark, sf), model.entities(spark, sf))


@query(
    "term_impact",
    f"""WITH {model.RELATIONS_SQL}, {model.ENTITIES_SQL} SELECT 'direct' AS how, count(*) AS n FROM e WHERE type = 'nation'
    UNION ALL SELECT 'linked', count(*) FROM r WHERE src IN (SELECT id FROM e WHERE type = 'nation') OR dst IN (SELECT id FROM e WHERE type = 'nation')""",
)
def term_impact(spark, sf):
    own = model.entities(spark, sf).filter("type = 'nation'")
    rel = model.relations(spark, sf)
    linked = rel.join(own.select(F.col("id").alias("src")), "src", "left_semi").select("edge").union(
        rel.join(own.select(F.col("id").alias("dst")), "dst", "left_semi").select("edge")
    ).distinct()
    return own.agg(F.count(F.lit(1)).alias("n")).select(F.lit("direct").alias("how"), "n").union(
        linked.agg(F.count(F.lit(1)).alias("n")).select(F.lit("linked"), "n")
    )


@query(
    "structure_pending",
    f"WITH {model.RELATIONS_SQL} SELECT type, count(*) AS n FROM r WHERE dst NOT IN (SELECT 'part:' || p_partkey FROM part WHERE p_size <= 40) AND type = 'supplies' GROUP BY 1",
)
def structure_pending(spark, sf):
    known = table(spark, sf, "part").filter("p_size <= 40").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("dst"))
    rows = model.relations(spark, sf).filter("type = 'supplies'").join(known, "dst", "left_anti")
    return rows.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "evaluation_prf",
    """WITH g AS (SELECT doc_id FROM labels WHERE quality = 1), f AS (SELECT doc_id FROM documents WHERE n_chars > 300 AND doc_id IN (SELECT doc_id FROM labels)),
    n AS (SELECT (SELECT count(*) FROM g WHERE doc_id IN (SELECT doc_id FROM f)) AS hit, (SELECT count(*) FROM g) AS gold, (SELECT count(*) FROM f) AS found)
    SELECT hit, gold, found, round(hit / found, 6) AS precision, round(hit / gold, 6) AS recall,
      round(2 * (hit / found) * (hit / gold) / (hit / found + hit / gold), 6) AS f1 FROM n""",
)
def evaluation_prf(spark, sf):
    labels = table(spark, sf, "labels")
    found = table(spark, sf, "documents").filter("n_chars > 300").join(labels.select("doc_id"), "doc_id", "left_semi")
    return aggregates.precision_recall(labels.filter("quality = 1"), found, ["doc_id"])


@query(
    "ingest_error_ratio",
    "SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE event_type = 'error') >= 5 AND count(*) FILTER (WHERE event_type = 'error') >= 0.6 * count(*) AS paused FROM events GROUP BY 1",
)
def ingest_error_ratio(spark, sf):
    rows = aggregates.counts_by(table(spark, sf, "events"), ["user_id"], errors=F.col("event_type") == "error")
    return rows.withColumn("paused", (F.col("errors") >= 5) & (F.col("errors") >= 0.6 * F.col("n")))


# ---- rankings --------------------------------------------------------------


@query(
    "keyword_predicate",
    "SELECT doc_id, source FROM documents WHERE contains(lower(text), 'the of') OR contains(lower(source), 'the of')",
)
def keyword_predicate(spark, sf):
    rows = table(spark, sf, "documents")
    return rows.filter(qualify.keyword_predicate("THE of", F.col("text"), F.col("source"))).select("doc_id", "source")


def _occurs(c: str, w: str) -> str:
    return f"((length({c}) - length(replace({c}, '{w}', ''))) / {len(w)})::BIGINT"


@query(
    "lexical_rank",
    f"""WITH s AS (SELECT doc_id, ({_occurs('lower(text)', 'in the')} * 10 + {_occurs('lower(text)', 'in')} + {_occurs('lower(text)', 'the')})::BIGINT AS score FROM documents)
    SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s WHERE score > 0 QUALIFY rank <= 50""",
)
def lexical_rank(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", ranking.lexical_score(F.col("text"), "in the").alias("score"))
    return ranking.top(rows.filter("score > 0"), "score", "doc_id", 50)


_COS = "list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0))"


@query(
    "cosine_topk",
    f"SELECT vec_id, round({_COS}, 6) AS score, row_number() OVER (ORDER BY {_COS} DESC, vec_id)::INTEGER AS rank FROM embeddings QUALIFY rank <= 20",
)
def cosine_topk(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding")
    out = ranking.top(ranking.cosine_to(rows, "embedding", rows.filter("vec_id = 0"), "embedding"), "score", "vec_id", 20)
    return out.select("vec_id", F.round("score", 6).alias("score"), "rank")


@query("cosine_min_score", f"SELECT vec_id, label FROM embeddings WHERE {_COS} >= 0.2")
def cosine_min_score(spark, sf):
    rows = table(spark, sf, "embeddings")
    return ranking.cosine_to(rows, "embedding", rows.filter("vec_id = 0"), "embedding").filter("score >= 0.2").select("vec_id", "label")


@query(
    "bm25_topk",
    r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM documents),
    l AS (SELECT doc_id, len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS dl FROM documents), s AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM l),
    q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM benchmark),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
    b AS (SELECT q.item_id, tf.doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
      FROM q JOIN tf USING (term) JOIN df USING (term) JOIN l ON l.doc_id = tf.doc_id, s GROUP BY 1, 2)
    SELECT item_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id)::INTEGER AS rank FROM b QUALIFY rank <= 10""",
)
def bm25_topk(spark, sf):
    folder = scratch_dir(spark, "index")
    inverted.build(table(spark, sf, "documents"), "doc_id", "text", folder)
    found = inverted.search(spark.read.parquet(folder), table(spark, sf, "benchmark"), "item_id", "text", 10)
    out = ranking.top(found.withColumn("order_score", F.round("score", inverted.DIGITS)), "order_score", "id", 10, ["query_id"])
    return out.select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


_RANKED = {"keyword": "l_quantity", "semantic": "l_extendedprice"}


@query(
    "rrf_hybrid",
    """WITH p AS (SELECT p_partkey, sum(l_quantity) AS a, round(avg(l_extendedprice), 6) AS b FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size > 10 GROUP BY 1),
    r AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY a DESC, p_partkey) AS rank FROM p QUALIFY rank <= 100
      UNION ALL SELECT p_partkey, row_number() OVER (ORDER BY b DESC, p_partkey) AS rank FROM p QUALIFY rank <= 100)
    SELECT id, round(sum(1.0 / (60 + rank)), 6) AS score, min(rank)::INTEGER AS best_rank, count(*) AS backends FROM r GROUP BY id
    ORDER BY sum(1.0 / (60 + rank)) DESC, best_rank, id LIMIT 50""",
)
def rrf_hybrid(spark, sf):
    kept = table(spark, sf, "part").filter("p_size > 10").select(F.col("p_partkey").alias("l_partkey"))
    rows = table(spark, sf, "lineitem").join(kept, "l_partkey", "left_semi").groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.sum("l_quantity").alias("a"), F.round(F.avg("l_extendedprice"), 6).alias("b")
    )
    lists = [(name, ranking.top(rows, c, "p_partkey", 100)) for name, c in (("keyword", "a"), ("semantic", "b"))]
    return ranking.rrf(lists, "p_partkey", 50).withColumn("score", F.round("score", 6))


@query(
    "channel_quotas",
    "SELECT p_type, p_partkey, p_retailprice, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey)::INTEGER AS rank FROM part QUALIFY rank <= 7",
)
def channel_quotas(spark, sf):
    return ranking.top(table(spark, sf, "part"), "p_retailprice", "p_partkey", 7, ["p_type"]).select("p_type", "p_partkey", "p_retailprice", "rank")


@query(
    "best_hit_per_parent",
    "SELECT l_orderkey, arg_max(l_linenumber, struct_pack(a := l_extendedprice, b := -l_linenumber)) AS l_linenumber, max(l_extendedprice) AS l_extendedprice, count(*) AS hits FROM lineitem GROUP BY 1",
)
def best_hit_per_parent(spark, sf):
    return ranking.best_per_parent(table(spark, sf, "lineitem"), "l_orderkey", "l_extendedprice", "l_linenumber")


@query(
    "keyword_merge",
    "SELECT l_partkey, max(score) AS score FROM (SELECT l_partkey, l_quantity AS score FROM lineitem UNION ALL SELECT p_partkey, p_size::DOUBLE FROM part) GROUP BY 1",
)
def keyword_merge(spark, sf):
    a = table(spark, sf, "lineitem").select("l_partkey", F.col("l_quantity").alias("score"))
    b = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").cast("double").alias("score"))
    return ranking.merge_best([a, b], "l_partkey")


@query(
    "bigram_hash_embedding",
    """WITH b AS (SELECT DISTINCT doc_id, substring(text, i::INTEGER, 2) AS g FROM documents, unnest(range(1, length(text))) t(i))
    SELECT doc_id, (('0x' || substr(sha256(g), 1, 8))::BIGINT % 256) AS bucket, count(*) AS n FROM b GROUP BY 1, 2""",
)
def bigram_hash_embedding(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.explode(text.bigrams(F.col("text"))).alias("g"))
    return rows.groupBy("doc_id", text.hash_bucket(F.col("g")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


# ---- graph and ontology ----------------------------------------------------


@query(
    "bfs_hops",
    f"""WITH RECURSIVE {model.RELATIONS_SQL}, b AS (SELECT src AS a, dst AS b FROM r UNION SELECT dst, src FROM r),
    w AS (SELECT 'nation:1' AS node, 0 AS hop UNION SELECT b.b, w.hop + 1 FROM w JOIN b ON b.a = w.node WHERE w.hop < 3)
    SELECT node, min(hop)::INTEGER AS hop FROM w GROUP BY node""",
)
def bfs_hops(spark, sf):
    edges = model.relations(spark, sf).select("edge", "src", "dst")
    seeds = spark.createDataFrame([("nation:1",)], "node string")
    return graph.bounded_search(edges, seeds, 3, 10**9, 10**9)[0].select("node", "hop")


@query(
    "class_closure",
    f"""WITH RECURSIVE {model.RELATIONS_SQL}, w AS (SELECT src AS child, dst AS parent, 1 AS depth FROM r WHERE type <> 'supplies'
      UNION SELECT w.child, r.dst, depth + 1 FROM w JOIN r ON r.src = w.parent AND r.type <> 'supplies')
    SELECT child, parent, min(depth)::INTEGER AS depth FROM w GROUP BY 1, 2""",
)
def class_closure(spark, sf):
    return graph.closure(model.relations(spark, sf).filter("type <> 'supplies'"), "src", "dst")


@query(
    "replacement_chain",
    """WITH RECURSIVE l AS (SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey > 3),
    w AS (SELECT src AS node, dst AS target, 1 AS steps FROM l UNION ALL SELECT node, l.dst, steps + 1 FROM w JOIN l ON l.src = w.target)
    SELECT node, arg_max(target, steps) AS target, max(steps) AS steps, NULL::VARCHAR AS issue FROM w GROUP BY node""",
)
def replacement_chain(spark, sf):
    links = table(spark, sf, "part").filter("p_partkey > 3").select(F.col("p_partkey").alias("src"), F.expr("p_partkey div 2").alias("dst"))
    return graph.chain_ends(links)


@query(
    "domain_range_violations",
    f"""WITH {model.RELATIONS_SQL}, {model.ENTITIES_SQL} SELECT r.edge, r.type, a.type AS src_type, b.type AS dst_type FROM r LEFT JOIN e a ON a.id = r.src LEFT JOIN e b ON b.id = r.dst
    WHERE (r.type, a.type, b.type) NOT IN (('located_in', 'supplier', 'nation'), ('part_of', 'nation', 'region'), ('supplies', 'supplier', 'part'))""",
)
def domain_range_violations(spark, sf):
    rules = spark.createDataFrame(
        [("located_in", "supplier", "nation"), ("part_of", "nation", "region"), ("supplies", "supplier", "part")], "type string, domain string, range string"
    )
    found = identity.domain_range_violations(model.relations(spark, sf), model.entities(spark, sf), rules)
    return found.select("edge", "type", "src_type", "dst_type")


# ---- identity --------------------------------------------------------------


@query(
    "entity_resolution_exact",
    """WITH m AS (SELECT DISTINCT upper(p_name) AS p_name FROM part), k AS (SELECT lower(trim(p_name)) AS k, count(*) AS c, min('part:' || p_partkey) AS entity FROM part GROUP BY 1)
    SELECT m.p_name AS mention, m.p_name, coalesce(c, 0)::BIGINT AS candidates, CASE WHEN c = 1 THEN entity END AS entity FROM m LEFT JOIN k ON k.k = lower(trim(m.p_name))""",
)
def entity_resolution_exact(spark, sf):
    parts = table(spark, sf, "part").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"), "p_name")
    mentions = parts.select(F.upper("p_name").alias("p_name")).distinct().withColumn("mention", F.col("p_name"))
    return identity.exact_matches(mentions, parts, "p_name")


@query(
    "semantic_bands",
    f"SELECT vec_id, CASE WHEN {_COS} >= 0.88 THEN 'aligned' WHEN {_COS} >= 0.1 THEN 'review' ELSE 'separate' END AS band FROM embeddings",
)
def semantic_bands(spark, sf):
    rows = table(spark, sf, "embeddings")
    scored = ranking.cosine_to(rows, "embedding", rows.filter("vec_id = 0"), "embedding")
    return scored.select("vec_id", identity.band(F.col("score"), 0.1, 0.88).alias("band"))


@query(
    "attribute_conflicts",
    """WITH i AS (SELECT l_suppkey, l_partkey, l_quantity AS value, l_shipdate AS s, l_shipdate + to_days(l_linenumber * 60) AS t FROM lineitem)
    SELECT a.l_suppkey, a.l_partkey, a.s AS at, count(DISTINCT b.value) AS values FROM (SELECT DISTINCT l_suppkey, l_partkey, s FROM i) a
    JOIN i b ON a.l_suppkey = b.l_suppkey AND a.l_partkey = b.l_partkey AND b.s <= a.s AND b.t > a.s GROUP BY 1, 2, 3 HAVING count(DISTINCT b.value) > 1""",
)
def attribute_conflicts(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        "l_suppkey", "l_partkey", F.col("l_quantity").alias("value"), F.col("l_shipdate").alias("s"),
        (F.col("l_shipdate") + F.make_dt_interval(F.col("l_linenumber") * 60)).alias("t"),
    )
    return identity.value_conflicts(rows, ["l_suppkey", "l_partkey"], "value", "s", "t")


# ---- sets, documents, streams ----------------------------------------------


@query("endpoints_without_entity", "SELECT DISTINCT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def endpoints_without_entity(spark, sf):
    return table(spark, sf, "orders").select("o_custkey").subtract(table(spark, sf, "customer").filter("c_acctbal > 0").select("c_custkey"))


@query(
    "chunk_fixed",
    """SELECT doc_id, i::INTEGER AS ordinal, (i * 1600)::INTEGER AS start, least(i * 1600 + 1800, length(text))::INTEGER AS stop, substring(text, (i * 1600 + 1)::INTEGER, 1800) AS chunk
    FROM documents, unnest(range(0, (CASE WHEN length(text) = 0 THEN 0 ELSE greatest(0, ceil((length(text) - 1800) / 1600.0)) + 1 END)::BIGINT)) t(i)""",
)
def chunk_fixed(spark, sf):
    return documents.fixed_chunks(table(spark, sf, "documents"), "doc_id", "text")


@query("chunk_paragraph")
def chunk_paragraph(spark, sf):
    return documents.chunks(table(spark, sf, "documents"), "doc_id", "text", "paragraph")


@query("chunk_structural")
def chunk_structural(spark, sf):
    return documents.chunks(table(spark, sf, "documents"), "doc_id", "text", "structural")


@query("html_text")
def html_text(spark, sf):
    return documents.html_blocks(table(spark, sf, "pages"), "page_id", "html")


@query(
    "merge_intervals",
    """WITH i AS (SELECT user_id, ts AS s, ts + INTERVAL 6 HOUR AS t FROM events), m AS (SELECT *, max(t) OVER (PARTITION BY user_id ORDER BY s, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
    g AS (SELECT *, sum(CASE WHEN reach >= s THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY s, t ROWS UNBOUNDED PRECEDING) AS island FROM m)
    SELECT user_id, min(s) AS start, max(t) AS stop, count(*) AS n FROM g GROUP BY user_id, island""",
)
def merge_intervals(spark, sf):
    rows = table(spark, sf, "events").select("user_id", F.col("ts").alias("s"), (F.col("ts") + F.expr("interval 6 hours")).alias("t"))
    return versions.merge_intervals(rows, "user_id", "s", "t")


def _outbox(spark, sf):
    own = W.partitionBy("event_type").orderBy("event_id")
    rows = table(spark, sf, "events").withColumn("seq", F.row_number().over(own))
    return rows.filter(~((F.col("seq") > 500) & (F.col("seq") % 97 == 0)))


_OUTBOX_SQL = """o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS seq FROM events) WHERE NOT (seq > 500 AND seq % 97 = 0))"""


@query(
    "outbox_contiguous",
    f"""WITH {_OUTBOX_SQL}, c AS (SELECT event_type, seq, event_id, row_number() OVER (PARTITION BY event_type ORDER BY seq) AS place FROM o)
    SELECT event_type, seq::INTEGER AS seq, event_id FROM c WHERE seq = place""",
)
def outbox_contiguous(spark, sf):
    return outbox.contiguous(_outbox(spark, sf), "event_type", "seq").select("event_type", "seq", "event_id")


@query(
    "outbox_fold",
    f"""WITH {_OUTBOX_SQL}, l AS (SELECT user_id, event_type, max(seq)::INTEGER AS last_seq, arg_max(value, seq) AS value, arg_max(event_id % 9 = 0, seq) AS gone FROM o GROUP BY 1, 2)
    SELECT user_id, event_type, last_seq, value FROM l WHERE NOT gone""",
)
def outbox_fold(spark, sf):
    rows = _outbox(spark, sf).withColumn("gone", F.col("event_id") % 9 == 0)
    return outbox.fold(rows, ["user_id", "event_type"], "seq", ["value"], "gone")


@query("outbox_watermark", f"WITH {_OUTBOX_SQL} SELECT event_type, max(seq)::INTEGER AS watermark, count(*) AS events FROM o GROUP BY 1")
def outbox_watermark(spark, sf):
    return outbox.watermarks(_outbox(spark, sf), "event_type", "seq")


@query(
    "audit_diff",
    """WITH a AS (SELECT user_id, md5(string_agg(event_id::VARCHAR, ',' ORDER BY event_id)) AS d FROM events GROUP BY 1),
    b AS (SELECT user_id, md5(string_agg(event_id::VARCHAR, ',' ORDER BY event_id)) AS d FROM events WHERE event_id % 400 <> 0 AND user_id % 11 <> 0 GROUP BY 1)
    SELECT user_id, CASE WHEN b.d IS NULL THEN 'missing' ELSE 'stale' END AS state FROM a LEFT JOIN b USING (user_id) WHERE b.d IS DISTINCT FROM a.d""",
)
def audit_diff(spark, sf):
    def state(rows):
        ids = F.transform(F.sort_array(F.collect_list("event_id")), lambda x: x.cast("string"))
        return rows.groupBy("user_id").agg(F.md5(F.array_join(ids, ",")).alias("d"))

    rows = table(spark, sf, "events")
    return outbox.audit(state(rows), state(rows.filter("event_id % 400 <> 0 AND user_id % 11 <> 0")), ["user_id"], "d")


@query(
    "tumbling_windows",
    "SELECT time_bucket(INTERVAL 1 HOUR, ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
)
def tumbling_windows(spark, sf):
    out = outbox.windowed(table(spark, sf, "events"), "ts", "1 hour")
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
