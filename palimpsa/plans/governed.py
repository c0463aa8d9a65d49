"""Shapes in time, operations on an ontology, metadata in typed columns, graph sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sessions, shapes, term_operations
from ..operators.recovery import scratch_dir
from ..sources import shredded
from . import model
from .catalogue import _FILTER_SQL, _FILTERS, query
from .model import table

_SHAPES = [
    shapes.Shape("load", "vendor", "supplies", most=3),
    shapes.Shape("idle", "vendor", "supplies", least=1),
    shapes.Shape("kind", "vendor", "supplies", pattern="^part:[0-9]*[0-7]$"),
    shapes.Shape("known", "vendor", "supplies", node_class="listed"),
]


@query(
    "shape_timeline",
    """WITH f AS (SELECT DISTINCT 'supplier:' || l_suppkey AS subject, 'part:' || l_partkey AS value, l_shipdate AS s, l_shipdate + INTERVAL 9 DAY AS t FROM lineitem WHERE l_suppkey % 5 = 0),
    v AS (SELECT 'supplier:' || s_suppkey AS subject, TIMESTAMP '1996-01-01' AS s, CASE WHEN s_suppkey % 2 = 0 THEN TIMESTAMP '2000-01-01' ELSE TIMESTAMP '9999-12-31 23:59:59' END AS t FROM supplier WHERE s_suppkey % 5 = 0),
    l AS (SELECT 'part:' || p_partkey AS value, TIMESTAMP '0001-01-01' AS s, TIMESTAMP '1998-01-01' AS t FROM part WHERE p_size > 5),
    b AS (SELECT subject, s AS "at" FROM f UNION SELECT subject, t FROM f UNION SELECT subject, s FROM v UNION SELECT subject, t FROM v UNION SELECT subject, TIMESTAMP '1998-01-01' FROM v),
    seg AS (SELECT subject, "at" AS s, lead("at") OVER (PARTITION BY subject ORDER BY "at") AS t FROM b),
    inside AS (SELECT seg.* FROM seg JOIN v ON v.subject = seg.subject AND v.s <= seg.s AND seg.s < v.t WHERE seg.t IS NOT NULL),
    c AS (SELECT i.subject, i.s, i.t, count(DISTINCT f.value) AS n, count(*) FILTER (f.value LIKE '%8' OR f.value LIKE '%9') AS bad,
            count(*) FILTER (f.value IS NOT NULL AND NOT EXISTS (SELECT 1 FROM l WHERE l.value = f.value AND l.s <= i.s AND i.s < l.t)) AS wrong
          FROM inside i LEFT JOIN f ON f.subject = i.subject AND f.s <= i.s AND i.s < f.t GROUP BY 1, 2, 3),
    r AS (SELECT subject, 'load' AS shape, 'most' AS rule, s, t FROM c WHERE n > 3 UNION ALL SELECT subject, 'idle', 'least', s, t FROM c WHERE n < 1
      UNION ALL SELECT subject, 'kind', 'value', s, t FROM c WHERE bad > 0 UNION ALL SELECT subject, 'known', 'class', s, t FROM c WHERE wrong > 0),
    m AS (SELECT *, CASE WHEN s <= lag(t) OVER w THEN 0 ELSE 1 END AS new FROM r WINDOW w AS (PARTITION BY subject, shape, rule ORDER BY s)),
    g AS (SELECT *, sum(new) OVER (PARTITION BY subject, shape, rule ORDER BY s) AS k FROM m)
    SELECT subject, shape, rule, min(s) AS start, nullif(max(t), TIMESTAMP '9999-12-31 23:59:59') AS stop FROM g GROUP BY subject, shape, rule, k""",
)
def shape_timeline(spark, sf):
    fifth = lambda c: F.col(c) % 5 == 0
    at = lambda d: F.lit(d).cast("timestamp_ntz")
    day = F.col("l_shipdate").cast("timestamp_ntz")
    facts = table(spark, sf, "lineitem").filter(fifth("l_suppkey")).select(
        F.concat(F.lit("supplier:"), F.col("l_suppkey").cast("string")).alias("subject"), F.lit("supplies").alias("predicate"), F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("value"),
        day.alias("start"), (day + F.make_dt_interval(F.lit(9))).alias("stop"),
    )
    vendors = table(spark, sf, "supplier").filter(fifth("s_suppkey")).select(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("subject"), F.lit("vendor").alias("class"), at("1996-01-01").alias("start"), F.when(F.col("s_suppkey") % 2 == 0, at("2000-01-01")).alias("stop"))
    listed = table(spark, sf, "part").filter("p_size > 5").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")), F.lit("listed"), at(None), at("1998-01-01"))
    return shapes.violations(facts, vendors.union(listed), _SHAPES)


#: Events as operations of their user's term; the kind of event and its number say which.
_EDITS_SQL = """
base AS (SELECT DISTINCT 'c' || user_id AS s, 'rdf:type' AS p, 'owl:Class' AS o FROM events WHERE user_id % 3 = 0 UNION SELECT DISTINCT 'c' || user_id, 'rdfs:subClassOf', 'c' || (user_id // 2) FROM events WHERE user_id % 4 = 0),
x AS (SELECT event_id AS seq, 'c' || user_id AS s, event_id % 7 AS k, event_id // 7 % 4 AS v, 'c' || (user_id // (2 + event_id % 2)) AS up FROM events),
e AS (SELECT seq, s, 'rdf:type' AS p, 'owl:Class' AS o, true AS adds, 'absent' AS needs FROM x WHERE k = 0
  UNION ALL SELECT seq, s, 'rdfs:subClassOf', up, k = 1, CASE k WHEN 1 THEN 'absent' ELSE 'present' END FROM x WHERE k IN (1, 2)
  UNION ALL SELECT seq, s, 'note', 'n' || v, k = 3, CASE k WHEN 4 THEN 'present' END FROM x WHERE k IN (3, 4)
  UNION ALL SELECT seq, s, 'owl:deprecated', 'true', true, NULL FROM x WHERE k = 5
  UNION ALL SELECT seq, s, 'rdfs:range', 'xsd:' || (v + 1), false, 'present' FROM x WHERE k = 6 AND v > 0 UNION ALL SELECT seq, s, 'rdfs:range', 'xsd:' || v, true, 'absent' FROM x WHERE k = 6),
every AS (SELECT NULL::BIGINT AS seq, s, p, o, true AS adds, NULL::VARCHAR AS needs FROM base UNION ALL SELECT * FROM e)
"""


def _edits(spark, sf):
    events = table(spark, sf, "events")
    term = lambda c: F.concat(F.lit("c"), c.cast("string"))
    user, k, v = F.col("user_id"), F.col("event_id") % 7, F.floor(F.col("event_id") / 7) % 4
    kinds = events.filter(user % 3 == 0).select(term(user).alias("s"), F.lit("rdf:type").alias("p"), F.lit("owl:Class").alias("o"))
    parents = events.filter(user % 4 == 0).select(term(user), F.lit("rdfs:subClassOf"), term(F.floor(user / 2)))
    actions = ["create_term", "add_parent", "remove_parent", "add_annotation", "remove_annotation", "retire_term", "set_datatype"]
    action = F.get(F.array(*[F.lit(a) for a in actions]), k.cast("int"))
    up = term(F.floor(user / (2 + F.col("event_id") % 2)))
    value = F.when(k == 0, "owl:Class").when(k.isin(1, 2), up).when(k.isin(3, 4), F.concat(F.lit("n"), v.cast("string"))).when(k == 6, F.concat(F.lit("xsd:"), v.cast("string")))
    before = F.when((k == 6) & (v > 0), F.concat(F.lit("xsd:"), (v + 1).cast("string")))
    operations = events.select(F.col("event_id").alias("seq"), action.alias("action"), term(user).alias("target"), F.lit("note").alias("predicate"), value.alias("value"), before.alias("before"))
    return kinds.union(parents).distinct(), term_operations.compiled(operations)


@query(
    "operation_conflicts",
    f"""WITH {_EDITS_SQL}, b AS (SELECT *, coalesce(lag(adds) OVER (PARTITION BY s, p, o ORDER BY seq NULLS FIRST, adds), false) AS was FROM every)
    SELECT seq, s, p, o, CASE needs WHEN 'absent' THEN 'already there' ELSE 'not there' END AS problem FROM b WHERE seq IS NOT NULL AND (needs = 'absent' AND was OR needs = 'present' AND NOT was)""",
)
def operation_conflicts(spark, sf):
    return term_operations.conflicts(*_edits(spark, sf))


@query(
    "operations_applied",
    f"WITH {_EDITS_SQL} SELECT s, p, o FROM (SELECT s, p, o, arg_max(adds, (coalesce(seq, -1), adds)) AS there FROM every GROUP BY s, p, o) WHERE there",
)
def operations_applied(spark, sf):
    return term_operations.applied(*_edits(spark, sf))


@query("operations_undone", f"WITH {_EDITS_SQL} SELECT * FROM base")
def operations_undone(spark, sf):
    """The operations and then their inverse, which leads back to the start."""
    base, edits = _edits(spark, sf)
    return term_operations.applied(term_operations.applied(base, edits), term_operations.inverse(base, edits))


@query(
    "ontology_invariants",
    f"""WITH RECURSIVE {_EDITS_SQL}, c AS (SELECT s AS x FROM base WHERE p = 'rdf:type'), up AS (SELECT s, o FROM base WHERE p = 'rdfs:subClassOf'), anc AS (SELECT s, o FROM up UNION SELECT anc.s, up.o FROM anc JOIN up ON up.s = anc.o)
    SELECT 'unknown parent' AS problem, s AS term, o AS other FROM up WHERE o NOT IN (SELECT x FROM c) UNION SELECT 'parent of no class', s, o FROM up WHERE s NOT IN (SELECT x FROM c)
    UNION SELECT 'cycle', s, NULL FROM anc WHERE s = o""",
)
def ontology_invariants(spark, sf):
    return term_operations.invariants(_edits(spark, sf)[0])


@query(
    "merged_terms",
    """WITH m AS (SELECT DISTINCT 'c' || user_id AS old, 'c' || (user_id // 2) AS new FROM events WHERE user_id % 8 = 4), t AS (SELECT DISTINCT 'c' || user_id AS s, 'rdf:type' AS p, 'owl:Class' AS o FROM events
      UNION SELECT DISTINCT 'c' || user_id, 'rdfs:subClassOf', 'c' || (user_id // 2) FROM events WHERE user_id > 1),
    r AS (SELECT coalesce(a.new, s) AS s, p, coalesce(b.new, o) AS o FROM t LEFT JOIN m a ON a.old = s LEFT JOIN m b ON b.old = o)
    SELECT * FROM r WHERE NOT (p = 'rdfs:subClassOf' AND s = o) UNION SELECT s, p, o FROM t WHERE p = 'rdf:type' AND s IN (SELECT old FROM m)
    UNION SELECT old, 'owl:deprecated', 'true' FROM m UNION SELECT old, 'dcterms:isReplacedBy', new FROM m""",
)
def merged_terms(spark, sf):
    users = table(spark, sf, "events").select("user_id").distinct()
    term = lambda c: F.concat(F.lit("c"), c.cast("string"))
    up = term(F.floor(F.col("user_id") / 2))
    own = term(F.col("user_id"))
    triples = users.select(own.alias("s"), F.lit("rdf:type").alias("p"), F.lit("owl:Class").alias("o")).union(users.filter("user_id > 1").select(own, F.lit("rdfs:subClassOf"), up))
    return term_operations.merged_terms(triples, users.filter("user_id % 8 = 4").select(own.alias("old"), up.alias("new")))


_SHREDDED = ["k", "missing"]
for _name, _ast in _FILTERS.items():

    @query(f"shredded_filter_{_name}", f"SELECT event_id, event_type, props FROM events WHERE {_FILTER_SQL[_name]}")
    def _stored_filter(spark, sf, ast=_ast):
        folder = scratch_dir(spark, "shredded")
        shredded.store(table(spark, sf, "events").select("event_id", "event_type", "props"), "props", _SHREDDED, folder, order_by="k")
        rows = spark.read.parquet(folder)
        return rows.filter(shredded.to_column(ast, "props", _SHREDDED, {"type": F.col("event_type")})).select("event_id", "event_type", "props")


@query(
    "session_pages",
    f"WITH {model.ENTITIES_SQL}, {model.RELATIONS_SQL} SELECT edge, src, dst, a.text AS src_text, b.text AS dst_text FROM r JOIN e a ON a.id = src JOIN e b ON b.id = dst WHERE r.type <> 'supplies' ORDER BY edge LIMIT 150",
)
def session_pages(spark, sf):
    """Three connected pages of a session, put together."""
    entities = model.entities(spark, sf).select("id", "text")
    relations = model.relations(spark, sf).filter("type <> 'supplies'").select("edge", "src", "dst")
    at = sessions.watermark(table(spark, sf, "events"), "event_id")
    session = sessions.opened(entities, relations, at, {"types": ["located_in", "part_of"]})
    cursor, rows = None, []
    for _ in range(3):
        found = sessions.page(session, "connected", entities, relations, at, cursor, 50)
        names = {e["id"]: e["text"] for e in found["entities"]}
        rows += [(r["edge"], r["src"], r["dst"], names[r["src"]], names[r["dst"]]) for r in found["records"]]
        cursor = found["next_cursor"]
        if cursor is None:
            break
    return spark.createDataFrame(rows, "edge string, src string, dst string, src_text string, dst_text string")
