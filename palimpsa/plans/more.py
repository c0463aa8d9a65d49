"""Further registered queries: projections, identity, validation, provenance, windows."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from ..operators import aggregates, documents, extras, graph, patterns, ranking
from . import model
from .catalogue import _COS, query
from .model import table


@query(
    "distinct_applicability_values",
    "SELECT 'platforms' AS dimension, c_mktsegment AS value FROM customer WHERE c_custkey % 5 > 1 GROUP BY 2",
)
def distinct_applicability_values(spark, sf):
    rows = table(spark, sf, "customer").filter("c_custkey % 5 > 1").select(F.array("c_mktsegment").alias("v"))
    return rows.select(F.lit("platforms").alias("dimension"), F.explode("v").alias("value")).distinct()


@query(
    "versions_in_caller_order",
    "SELECT o_orderkey, o_orderstatus, p::INTEGER AS place FROM orders JOIN (SELECT unnest([30, 7, 12, 999999999]) AS k, unnest([0, 1, 2, 3]) AS p) ON k = o_orderkey",
)
def versions_in_caller_order(spark, sf):
    from ..operators.qualify import in_order

    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return in_order(rows, [30, 7, 12, 999999999], "o_orderkey").select("o_orderkey", "o_orderstatus", "place")


@query(
    "search_projection",
    """SELECT doc_id, i::INTEGER AS ordinal, sha256(doc_id || ':' || i) AS vector_id, left(substring(text, (i * 5600 + 1)::INTEGER, 6000), 160) AS head
    FROM documents, unnest(range(0, (CASE WHEN length(text) = 0 THEN 0 ELSE greatest(0, ceil((length(text) - 6000) / 5600.0)) + 1 END)::BIGINT)) t(i)""",
)
def search_projection(spark, sf):
    return extras.search_projection(table(spark, sf, "documents"), "doc_id", "text")


@query("match_explanation", "SELECT doc_id, contains(lower(text), 'worthless') AS body, contains(lower(source), 'src3') AS source_hit, CASE WHEN contains(lower(text), 'worthless') THEN substring(text, greatest(1, instr(lower(text), 'worthless') - 60), 260) END AS snippet FROM documents WHERE contains(lower(text), 'worthless') OR contains(lower(source), 'src3')")
def match_explanation(spark, sf):
    body, own = F.contains(F.lower("text"), F.lit("worthless")), F.contains(F.lower("source"), F.lit("src3"))
    rows = table(spark, sf, "documents").filter(body | own)
    return rows.select("doc_id", body.alias("body"), own.alias("source_hit"), text.snippet(F.col("text"), F.lit("worthless")).alias("snippet"))


@query("attribute_preview", "SELECT doc_id, left(text, 200) AS preview, length(text)::INTEGER AS length, length(text) > 200 AS truncated FROM documents")
def attribute_preview(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.left("text", F.lit(200)).alias("preview"), F.char_length("text").alias("length"), (F.char_length("text") > 200).alias("truncated"))


@query("content_addressed_sources", "SELECT sha256(text) AS sha, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def content_addressed_sources(spark, sf):
    return table(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("sha")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


@query(
    "parsed_documents",
    "SELECT count(*) AS n FROM (SELECT doc_id FROM documents WHERE length(text) > 1800 UNION SELECT doc_id FROM labels WHERE quality = 1)",
)
def parsed_documents(spark, sf):
    a = table(spark, sf, "documents").filter(F.char_length("text") > 1800).select("doc_id")
    return a.union(table(spark, sf, "labels").filter("quality = 1").select("doc_id")).distinct().agg(F.count(F.lit(1)).alias("n"))


@query(
    "attribute_values_page",
    "SELECT l_suppkey, l_returnflag, count(*) AS n, count(DISTINCT l_partkey) AS documents, count(DISTINCT l_orderkey) AS assertions FROM lineitem GROUP BY 1, 2",
)
def attribute_values_page(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("l_partkey").alias("documents"), F.count_distinct("l_orderkey").alias("assertions")
    )


@query(
    "candidate_lifecycle",
    """SELECT p_partkey, CASE WHEN p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') THEN 'materialized'
      WHEN p_partkey IN (SELECT l_partkey FROM lineitem) THEN 'published' WHEN p_size > 25 THEN 'included' ELSE 'pending' END AS state FROM part""",
)
def candidate_lifecycle(spark, sf):
    lines = table(spark, sf, "lineitem")
    sets = [("materialized", lines.filter("l_returnflag = 'R'")), ("published", lines)]
    rows = table(spark, sf, "part")
    return extras.lifecycle(rows, "p_partkey", [(n, s.select(F.col("l_partkey").alias("p_partkey"))) for n, s in sets], F.when(F.col("p_size") > 25, "included").otherwise("pending")).select("p_partkey", "state")


@query(
    "candidate_summary",
    "WITH g AS (SELECT p_type, p_name, row_number() OVER (PARTITION BY p_type ORDER BY p_name) AS place FROM (SELECT DISTINCT p_type, p_name FROM part)) SELECT p_type, count(*) AS n, string_agg(p_name, ',' ORDER BY place) FILTER (WHERE place <= 3) AS samples FROM g GROUP BY 1",
)
def candidate_summary(spark, sf):
    rows = table(spark, sf, "part").select("p_type", "p_name").distinct()
    return aggregates.sample_groups(rows, ["p_type"], ["p_name"], "p_name", 3)


@query(
    "evidence_recall",
    """WITH g AS (SELECT l_orderkey, list(DISTINCT l_partkey) AS gold FROM lineitem GROUP BY 1), f AS (SELECT l_orderkey, list(DISTINCT l_partkey) AS found FROM lineitem WHERE l_quantity > 10 GROUP BY 1)
    SELECT round(avg(len(list_intersect(gold, coalesce(found, []))) / len(gold)), 6) AS recall FROM g LEFT JOIN f USING (l_orderkey)""",
)
def evidence_recall(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    found = table(spark, sf, "lineitem").filter("l_quantity > 10").select("l_orderkey", "l_partkey")
    return extras.evidence_recall(lines, found, "l_orderkey", "l_partkey")


@query(
    "weighted_keyword_rank",
    """WITH s AS (SELECT doc_id, (CASE WHEN contains(lower(text), 'in the') THEN 10 ELSE 0 END + CASE WHEN contains(lower(text), 'in') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'the') THEN 1 ELSE 0 END
      + (CASE WHEN contains(lower(text), 'in') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'n ') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), ' t') THEN 1 ELSE 0 END
        + CASE WHEN contains(lower(text), 'th') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'he') THEN 1 ELSE 0 END) / 6.0)::DOUBLE AS s FROM documents)
    SELECT doc_id, round(s, 6) AS score, row_number() OVER (ORDER BY round(s, 6) DESC, doc_id)::INTEGER AS rank FROM s WHERE s > 0 QUALIFY rank <= 40""",
)
def weighted_keyword_rank(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.round(extras.keyword_weights(F.col("text"), "in the"), 6).alias("score"))
    return ranking.top(rows.filter("score > 0"), "score", "doc_id", 40)


@query(
    "trigram_similarity",
    """WITH n AS (SELECT DISTINCT p_name FROM part), t AS (SELECT DISTINCT p_name, substring('  ' || p_name || ' ', i::INTEGER, 3) AS g FROM n, unnest(range(1, length(p_name) + 2)) u(i)),
    q AS (SELECT DISTINCT substring('  red ring ', i::INTEGER, 3) AS g FROM unnest(range(1, 10)) u(i)), c AS (SELECT p_name, count(*) AS n FROM t GROUP BY 1),
    b AS (SELECT p_name, count(*) AS m FROM t JOIN q USING (g) GROUP BY 1)
    SELECT p_name, round(m / (n + (SELECT count(*) FROM q) - m), 6) AS similarity FROM b JOIN c USING (p_name)""",
)
def trigram_similarity(spark, sf):
    names = table(spark, sf, "part").select("p_name").distinct()
    return names.select("p_name", F.round(extras.trigram_similarity(F.col("p_name"), F.lit("red ring")), 6).alias("similarity")).filter("similarity > 0")


@query(
    "keyword_rerank",
    f"WITH pool AS (SELECT vec_id, embedding FROM embeddings WHERE label IN (1, 2, 3)) SELECT vec_id, round({_COS}, 6) AS score, row_number() OVER (ORDER BY {_COS} DESC, vec_id)::INTEGER AS rank FROM pool QUALIFY rank <= 10",
)
def keyword_rerank(spark, sf):
    rows = table(spark, sf, "embeddings")
    hits = rows.filter("label in (1, 2, 3)")
    out = ranking.top(ranking.cosine_to(hits, "embedding", rows.filter("vec_id = 0"), "embedding"), "score", "vec_id", 10)
    return out.select("vec_id", F.round("score", 6).alias("score"), "rank")


@query(
    "progressive_search",
    "SELECT doc_id FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'of') AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
)
def progressive_search(spark, sf):
    steps = [lambda d: d.filter(F.contains(F.lower("text"), F.lit("the"))), lambda d: d.filter(F.contains(F.lower("text"), F.lit("of")))]
    gate = table(spark, sf, "labels").filter("quality = 1").select("doc_id")
    return extras.progressive(table(spark, sf, "documents"), steps, gate, "doc_id").select("doc_id")


@query(
    "maximal_sets",
    """WITH s AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS v FROM orders GROUP BY 1), d AS (SELECT DISTINCT v FROM s)
    SELECT array_to_string(a.v, ',') AS members FROM d a WHERE NOT EXISTS (SELECT 1 FROM d b WHERE len(b.v) > len(a.v) AND list_has_all(b.v, a.v))""",
)
def maximal_sets(spark, sf):
    sets = table(spark, sf, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_set("o_orderpriority")).alias("v"))
    return extras.maximal_sets(sets, "v").select(F.array_join("v", ",").alias("members"))


@query(
    "reasoning_paths",
    f"""WITH RECURSIVE {model.RELATIONS_SQL}, e AS (SELECT DISTINCT src, dst FROM r), w AS (SELECT src AS seed, dst AS node, src || '>' || dst AS path, 1 AS hops FROM e
      UNION ALL SELECT seed, e.dst, path || '>' || e.dst, hops + 1 FROM w JOIN e ON e.src = w.node WHERE hops < 3 AND NOT contains('>' || path || '>', '>' || e.dst || '>'))
    SELECT seed, node, path, hops::INTEGER AS hops FROM w""",
)
def reasoning_paths(spark, sf):
    edges = model.relations(spark, sf).select("src", "dst").distinct()
    return extras.paths(edges, model.entities(spark, sf).select("id"), 3)


@query(
    "mindmap_tree",
    f"""WITH {model.RELATIONS_SQL}, a AS (SELECT src AS node, 1 AS depth, row_number() OVER (ORDER BY src) AS place FROM r WHERE dst = 'region:1' AND type = 'part_of'),
    b AS (SELECT r.src AS node, 2 AS depth, r.dst AS parent, row_number() OVER (PARTITION BY r.dst ORDER BY r.src) AS place FROM r JOIN a ON r.dst = a.node AND a.place <= 40 WHERE r.type = 'located_in')
    SELECT node, depth::INTEGER AS depth, 'region:1' AS parent FROM a WHERE place <= 40 UNION ALL SELECT node, depth, parent FROM b WHERE place <= 40""",
)
def mindmap_tree(spark, sf):
    edges = model.relations(spark, sf).select(F.col("dst").alias("parent"), F.col("src").alias("node")).distinct()
    return extras.tree(edges, "region:1", 5, 40)


@query(
    "provenance_trace",
    """WITH x AS (SELECT o_orderkey, o_custkey FROM orders) SELECT DISTINCT 'order:' || o_orderkey AS src, 'part:' || l_partkey AS dst, 'used' AS relation FROM x JOIN lineitem ON l_orderkey = o_orderkey
    UNION SELECT 'order:' || o_orderkey, 'customer:' || o_custkey, 'cites' FROM x""",
)
def provenance_trace(spark, sf):
    x = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    used = x.join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("src"), F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("dst"), F.lit("used").alias("relation"))
    cites = x.select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("src"), F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("dst"), F.lit("cites").alias("relation"))
    return used.union(cites).distinct()


@query(
    "evidence_eligibility",
    f"""WITH {model.DECISIONS_SQL}, l AS (SELECT assertion_id, l_partkey, to_status FROM d WHERE created_at <= TIMESTAMP '1998-01-01' QUALIFY row_number() OVER (PARTITION BY assertion_id ORDER BY decision_version DESC) = 1)
    SELECT l_partkey, CASE WHEN count(DISTINCT to_status) > 1 THEN 'conflict' ELSE min(to_status) END AS state, count(*) AS occurrences FROM l GROUP BY 1""",
)
def evidence_eligibility(spark, sf):
    from ..operators.versions import latest_before

    log = model.decisions(spark, sf)
    last = latest_before(log, "assertion_id", "decision_version", F.col("created_at") <= F.lit("1998-01-01 00:00:00").cast("timestamp_ntz"))
    return extras.combined_state(last, "l_partkey", "to_status")


@query(
    "ontology_query_expansion",
    """SELECT item_id, p_type AS term FROM benchmark, (SELECT DISTINCT p_type FROM part) WHERE contains(lower(text), lower(p_type))
    UNION SELECT item_id, n_name FROM benchmark, nation WHERE contains(lower(text), lower(n_name))""",
)
def ontology_query_expansion(spark, sf):
    terms = table(spark, sf, "part").select(F.col("p_type").alias("term")).union(table(spark, sf, "nation").select("n_name")).distinct()
    return patterns.terms_in(table(spark, sf, "benchmark"), "item_id", "text", terms)


@query(
    "query_expansion",
    """WITH t AS (SELECT DISTINCT p_type AS class FROM part), f AS (SELECT class, class AS form FROM t UNION SELECT 'thing', left(lower(p_brand), 5) FROM part UNION SELECT 'colour', split_part(p_name, ' ', 1) FROM part),
    anc AS (SELECT class, 'thing' AS ancestor FROM t UNION ALL SELECT 'colour', 'thing' UNION ALL SELECT p_brand || '/' || p_size, 'colour' FROM (SELECT DISTINCT p_brand, p_size FROM part WHERE p_size < 4)),
    q AS (SELECT p_partkey AS q, lower(trim(p_name || ' of ' || p_brand || ' in ' || p_type)) AS low FROM part),
    m AS (SELECT DISTINCT q, lower(form) AS form, class FROM q, f WHERE length(form) >= 2 AND contains(low, lower(form))),
    k AS (SELECT * FROM m a WHERE NOT EXISTS (SELECT 1 FROM m b WHERE b.q = a.q AND length(b.form) > length(a.form) AND contains(b.form, a.form))),
    s AS (SELECT q, class, max(length(form)) AS size FROM k GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY size DESC, class) AS n FROM s),
    terms AS (SELECT q, list(class ORDER BY class) AS terms FROM r WHERE n <= 8 GROUP BY q),
    below AS (SELECT q, list(DISTINCT anc.class ORDER BY anc.class) AS subclasses FROM terms JOIN anc ON list_contains(terms, ancestor) WHERE NOT list_contains(terms, anc.class) GROUP BY q)
    SELECT q AS p_partkey, array_to_string(terms, ',') AS terms, coalesce(array_to_string(subclasses, ','), '') AS subclasses FROM terms LEFT JOIN below USING (q)""",
)
def query_expansion(spark, sf):
    part = table(spark, sf, "part")
    types = part.select(F.col("p_type").alias("class")).distinct()
    forms = types.select(F.col("class").alias("form"), "class")
    forms = forms.union(part.select(F.left(F.lower("p_brand"), F.lit(5)), F.lit("thing"))).union(part.select(F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit("colour"))).distinct()
    lines = part.filter("p_size < 4").select(F.concat_ws("/", "p_brand", "p_size").alias("class"), F.lit("colour").alias("ancestor")).distinct()
    ancestors = types.select("class", F.lit("thing").alias("ancestor")).union(spark.sql("select 'colour', 'thing'")).union(lines)
    questions = part.select("p_partkey", F.concat("p_name", F.lit(" of "), "p_brand", F.lit(" in "), "p_type").alias("text"))
    out = patterns.expanded(questions, "p_partkey", "text", forms, ancestors)
    return out.select("p_partkey", F.array_join("terms", ",").alias("terms"), F.array_join("subclasses", ",").alias("subclasses"))


@query(
    "cardinality_violations",
    "SELECT l_orderkey AS owner, count(*) AS n FROM (SELECT l_orderkey, l_linenumber, count(*) AS c FROM lineitem GROUP BY 1, 2) WHERE c > 1 GROUP BY 1",
)
def cardinality_violations(spark, sf):
    return extras.max_count_violations(table(spark, sf, "lineitem"), ["l_orderkey"], "l_linenumber", 1).select(F.col("l_orderkey").alias("owner"), "n")


@query(
    "timeline_validation",
    """WITH i AS (SELECT l_suppkey, l_partkey, l_shipdate AS s, l_shipdate + INTERVAL 90 DAY AS t FROM lineitem), p AS (SELECT DISTINCT l_suppkey, s AS "at" FROM i UNION SELECT DISTINCT l_suppkey, t FROM i)
    SELECT p.l_suppkey, p."at", count(DISTINCT l_partkey) AS held FROM p JOIN i ON i.l_suppkey = p.l_suppkey AND i.s <= p."at" AND i.t > p."at" GROUP BY 1, 2 HAVING count(DISTINCT l_partkey) > 5""",
)
def timeline_validation(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey", F.col("l_shipdate").alias("s"), (F.col("l_shipdate") + F.expr("interval 90 days")).alias("t"))
    return extras.held_at_boundaries(rows, "l_suppkey", "l_partkey", "s", "t").filter("held > 5")


@query("relation_key_ids", "SELECT DISTINCT sha256('[\"located_in\",\"customer:' || c_custkey || '\",\"nation:' || c_nationkey || '\"]') AS relation_key FROM customer")
def relation_key_ids(spark, sf):
    rows = model.relations(spark, sf).filter(F.col("edge").startswith("cn:"))
    return rows.select(F.sha2(F.to_json(F.array("type", "src", "dst")), 256).alias("relation_key")).distinct()


@query(
    "reconcile_relations",
    "SELECT l_suppkey // 3 AS subject, l_partkey // 2 AS object, l_shipdate, count(*) AS merged FROM lineitem GROUP BY 1, 2, 3",
)
def reconcile_relations(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey", "l_shipdate")
    a = lines.select(F.col("l_suppkey").alias("old")).distinct().select("old", F.expr("old div 3").alias("new"))
    b = lines.select(F.col("l_partkey").alias("old")).distinct().select("old", F.expr("old div 2").alias("new"))
    return extras.redirect(lines, a, "l_suppkey", "subject").transform(lambda d: extras.redirect(d, b, "l_partkey", "object")).groupBy("subject", "object", "l_shipdate").agg(F.count(F.lit(1)).alias("merged"))


@query(
    "reclassify_plan",
    "SELECT p_type, CASE WHEN p_type IN ('STANDARD', 'SMALL') THEN 'carry' WHEN p_type = 'MEDIUM' THEN 'rename' ELSE 'unmapped' END AS action, count(*) AS n FROM part GROUP BY 1, 2",
)
def reclassify_plan(spark, sf):
    old = table(spark, sf, "part")
    new = spark.createDataFrame([("STANDARD",), ("SMALL",), ("REGULAR",)], "term string")
    renames = spark.createDataFrame([("MEDIUM", "REGULAR")], "src string, dst string")
    return extras.reclassify(old, "p_type", new, renames).groupBy("p_type", "action").agg(F.count(F.lit(1)).alias("n"))


@query(
    "session_windows",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""",
)
def session_windows(spark, sf):
    out = table(spark, sf, "events").groupBy("user_id", F.session_window("ts", "2 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query(
    "sliding_windows",
    "SELECT (time_bucket(INTERVAL 1 HOUR, ts) - to_hours(k::INTEGER))::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events, unnest(range(0, 4)) t(k) GROUP BY 1, 2",
)
def sliding_windows(spark, sf):
    from ..streaming.outbox import windowed

    out = windowed(table(spark, sf, "events"), "ts", "4 hours", "1 hour")
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    "projection_fan_out",
    "SELECT doc_id, i::INTEGER AS ordinal FROM documents, unnest(range(0, (CASE WHEN length(text) = 0 THEN 0 ELSE greatest(0, ceil((length(text) - 1800) / 1600.0)) + 1 END)::BIGINT)) t(i)",
)
def projection_fan_out(spark, sf):
    return documents.fixed_chunks(table(spark, sf, "documents"), "doc_id", "text").select("doc_id", "ordinal")


@query(
    "hierarchy_cycles",
    "WITH RECURSIVE l AS (SELECT p_partkey AS c, (p_partkey * 7 + 3) % 50 AS p FROM part), w AS (SELECT c, p FROM l UNION SELECT w.c, l.p FROM w JOIN l ON l.c = w.p) SELECT DISTINCT c AS node FROM w WHERE c = p",
)
def hierarchy_cycles(spark, sf):
    edges = table(spark, sf, "part").select(F.col("p_partkey").alias("c"), F.expr("(p_partkey * 7 + 3) % 50").alias("p"))
    return graph.on_cycles(graph.closure(edges, "c", "p"))


@query(
    "source_scope_inheritance",
    "SELECT s_suppkey, coalesce(CASE WHEN s_acctbal > 0 THEN 'own' END, n_name) AS scope FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey",
)
def source_scope_inheritance(spark, sf):
    rows = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return rows.select("s_suppkey", F.coalesce(F.when(F.col("s_acctbal") > 0, "own"), F.col("n_name")).alias("scope"))


@query(
    "turn_adjacency",
    "SELECT conv_id, turn, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM conversations",
)
def turn_adjacency(spark, sf):
    own = W.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", F.lead("role").over(own).alias("next_role"))
