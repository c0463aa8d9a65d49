"""Registered queries: entity resolution, applicability contexts, conflicts, ontology."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import algebra, entity_resolution, identity, ontology, resolve, slices
from ..operators.recovery import dealt
from . import model
from .catalogue import query
from .model import table


def _keys(spark, sf):
    customer = table(spark, sf, "customer")
    one = lambda scheme, v: customer.select(F.col("c_custkey").alias("id"), F.lit(scheme).alias("scheme"), v.cast("string").alias("value"))
    return one("phone", F.floor(F.col("c_acctbal"))).unionByName(one("segment", F.col("c_mktsegment")).filter("id % 2 = 0"))


_KEYS_SQL = "k AS (SELECT c_custkey AS id, 'phone' AS scheme, floor(c_acctbal)::BIGINT::VARCHAR AS value FROM customer UNION ALL SELECT c_custkey, 'segment', c_mktsegment FROM customer WHERE c_custkey % 2 = 0)"
_STARS_SQL = f"""{_KEYS_SQL}, f AS (SELECT scheme, value, min(id) AS "left" FROM k GROUP BY 1, 2), s AS (SELECT "left", id AS "right", count(DISTINCT scheme) AS shared FROM k JOIN f USING (scheme, value) WHERE id <> "left" GROUP BY 1, 2),
    c AS (SELECT DISTINCT "left", "right" FROM (SELECT "left", "right", a.scheme, bool_or(a.value = b.value) AS same FROM s JOIN k a ON a.id = "left" JOIN k b ON b.id = "right" AND b.scheme = a.scheme GROUP BY 1, 2, 3) WHERE NOT same),
    m AS (SELECT s.*, c."left" IS NOT NULL AS differing FROM s LEFT JOIN c USING ("left", "right"))"""


@query("identity_key_matches", f'WITH {_STARS_SQL} SELECT "left", "right", shared, differing FROM m')
def identity_key_matches(spark, sf):
    return resolve.key_matches(_keys(spark, sf))


@query(
    "compatible_pairs",
    f"""WITH {_STARS_SQL} SELECT "left", "right" FROM m JOIN customer a ON a.c_custkey = "left" JOIN customer b ON b.c_custkey = "right"
    WHERE a.c_mktsegment = b.c_mktsegment AND NOT differing""",
)
def compatible_pairs(spark, sf):
    e = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("type"), F.lit("p").alias("scope"), F.lit("strict").alias("policy"), F.col("c_nationkey").alias("source"))
    pairs = resolve.key_matches(_keys(spark, sf))
    both = pairs.join(e.alias("a"), F.col("left") == F.col("a.id")).join(e.alias("b"), F.col("right") == F.col("b.id"))
    return both.filter(resolve.compatible("a", "b")).select("left", "right")


#: Vectors with odd numbers are mentions, those with even ones entities; names, keys and sources follow from the numbers.
_RESOLVE_SQL = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS vector, (label % 3)::VARCHAR AS type, (vec_id % 4 // 2)::VARCHAR AS scope, 's' || vec_id % 5 AS source, 'name ' || vec_id % 331 AS name,
         CASE WHEN vec_id % 12 = 0 THEN 'name ' || (vec_id + 1) % 331 END AS alias,
         CASE WHEN vec_id % 7 < 3 THEN (vec_id % 173)::VARCHAR END AS tax, CASE WHEN vec_id % 11 < 3 THEN (vec_id % 59)::VARCHAR END AS reg,
         CASE WHEN label % 3 = 1 THEN 'reference' ELSE 'default' END AS mode FROM embeddings
), m AS (SELECT * FROM v WHERE vec_id % 2 = 1), e AS (SELECT * FROM v WHERE vec_id % 2 = 0), p AS (
  SELECT m.vec_id AS mention, e.vec_id AS id, m.mode, coalesce(m.tax <> e.tax, false) OR coalesce(m.reg <> e.reg, false) AS clash, coalesce(m.tax = e.tax, false) OR coalesce(m.reg = e.reg, false) AS equal,
         m.source = e.source AS same, m.name = e.name OR coalesce(m.name = e.alias, false) AS named, round(list_cosine_similarity(m.vector, e.vector), 9) AS score
  FROM m JOIN e USING (type, scope)
), c AS (
  SELECT *, NOT clash AND (mode = 'reference' OR equal OR same) AS fits FROM p
), g AS (
  SELECT mention, count(*) FILTER (fits AND equal) AS n_strong, min(id) FILTER (fits AND equal) AS strong, count(*) FILTER (fits AND named) AS n_named, min(id) FILTER (fits AND named) AS name_id,
         bool_or(named AND clash) AS name_clash, arg_min(id, (-score, id)) FILTER (fits AND same) AS near, max(score) FILTER (fits AND same) AS score FROM c GROUP BY mention
), r AS (
  SELECT m.vec_id AS mention, mode, g.* EXCLUDE mention, CASE WHEN n_strong > 1 OR n_strong = 0 AND n_named > 1 THEN 'ambiguous_exact_identity' WHEN n_strong = 1 THEN 'strong_identity_key' WHEN n_named = 1 THEN 'exact_name_or_alias'
    WHEN name_clash THEN 'conflicting_identity_key' WHEN near IS NULL THEN 'no_compatible_candidate' WHEN mode = 'reference' AND score >= {review} THEN 'reference_similarity_requires_review'
    WHEN score >= {merge} THEN 'semantic_high_band' WHEN score >= {review} THEN 'semantic_gray_band' ELSE 'semantic_low_band' END AS reason
  FROM m LEFT JOIN g ON g.mention = m.vec_id
)
SELECT mention, reason, CASE WHEN reason IN ('strong_identity_key', 'exact_name_or_alias', 'semantic_high_band') THEN 'aligned'
    WHEN reason IN ('ambiguous_exact_identity', 'conflicting_identity_key', 'reference_similarity_requires_review', 'semantic_gray_band') THEN 'review' ELSE 'separate' END AS outcome,
  CASE reason WHEN 'strong_identity_key' THEN strong WHEN 'exact_name_or_alias' THEN name_id ELSE CASE WHEN reason LIKE 'semantic%' OR reason LIKE 'reference%' THEN near END END AS entity,
  CASE WHEN reason IN ('strong_identity_key', 'exact_name_or_alias') THEN 1.0::DOUBLE WHEN reason LIKE 'semantic%' OR reason LIKE 'reference%' THEN round(score, 6) END AS score FROM r
"""


def _identities(spark, sf):
    v = F.col("vec_id")
    key = lambda name, met, value: F.when(met, F.struct(F.lit(name).alias("k"), value.cast("string").alias("v")))
    pairs = F.filter(F.array(key("tax", v % 7 < 3, v % 173), key("reg", v % 11 < 3, v % 59)), lambda x: x.isNotNull())
    rows = table(spark, sf, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("vector"), (F.col("label") % 3).cast("string").alias("type"), F.floor(v % 4 / 2).cast("string").alias("scope"),
        F.concat(F.lit("s"), (v % 5).cast("string")).alias("source"), F.concat(F.lit("name "), (v % 331).cast("string")).alias("name"),
        F.when(v % 12 == 0, F.array(F.concat(F.lit("Name "), ((v + 1) % 331).cast("string")))).alias("aliases"), F.map_from_entries(pairs).alias("keys"),
        F.when(F.col("label") % 3 == 1, "reference").otherwise("default").alias("mode"),
    )
    return rows.filter(v % 2 == 1).withColumnRenamed("vec_id", "mention"), rows.filter(v % 2 == 0).withColumnRenamed("vec_id", "id")


#: Vectors of the tables are far apart, so the bands of the query are low.
_REVIEW, _MERGE = 0.3, 0.4


@query("three_stage_resolution", _RESOLVE_SQL.format(review=_REVIEW, merge=_MERGE))
def three_stage_resolution(spark, sf):
    return entity_resolution.resolve(*_identities(spark, sf), _REVIEW, _MERGE).withColumn("score", F.round("score", 6))


@query(
    "identity_conflicts",
    """WITH RECURSIVE k AS (SELECT vec_id AS id, 'tax' AS scheme, vec_id % 173 AS value FROM embeddings WHERE vec_id % 7 < 3 UNION ALL SELECT vec_id, 'reg', vec_id % 59 FROM embeddings WHERE vec_id % 11 < 3),
    f AS (SELECT scheme, value, min(id) AS f FROM k GROUP BY 1, 2), l AS (SELECT DISTINCT id AS a, f AS b FROM k JOIN f USING (scheme, value) WHERE id <> f), b AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
    w AS (SELECT a AS id, a AS root FROM b UNION SELECT b.b, w.root FROM w JOIN b ON b.a = w.id), c AS (SELECT id, min(root) AS component FROM w GROUP BY 1)
    SELECT component, scheme, count(DISTINCT value) AS n_values FROM k JOIN c USING (id) GROUP BY 1, 2 HAVING count(DISTINCT value) > 1""",
)
def identity_conflicts(spark, sf):
    mentions, entities = _identities(spark, sf)
    return entity_resolution.key_conflicts(mentions.withColumnRenamed("mention", "id").select("id", "keys").union(entities.select("id", "keys")))


@query("near_names")
def near_names(spark, sf):
    return resolve.near_names(model.entities(spark, sf).filter("type = 'part'"), "text", "Cold Widgets")


@query("merge_inputs", f"WITH {model.RELATIONS_SQL} SELECT 'nation:1' AS id UNION SELECT 'nation:2' UNION SELECT src FROM r WHERE dst IN ('nation:1', 'nation:2') UNION SELECT dst FROM r WHERE src IN ('nation:1', 'nation:2') ORDER BY 1 LIMIT 2000")
def merge_inputs(spark, sf):
    members = spark.createDataFrame([("nation:1",), ("nation:2",)], "id string")
    return resolve.merge_inputs(members, model.relations(spark, sf))[0]


@query(
    "applicability_contexts",
    """WITH s AS (SELECT l_orderkey, list(DISTINCT l_returnflag) AS p, list(DISTINCT l_linestatus) FILTER (WHERE l_quantity > 25) AS b FROM lineitem GROUP BY 1)
    SELECT DISTINCT l_orderkey, 'platforms=' || x || ';businesses=' || y AS context FROM s, unnest(p) t(x), unnest(coalesce(b, ['*'])) u(y)""",
)
def applicability_contexts(spark, sf):
    lines = dealt(table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", "l_quantity", "l_linestatus"), "l_orderkey")
    rows = lines.groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("p"), F.collect_set(F.when(F.col("l_quantity") > 25, F.col("l_linestatus"))).alias("b"))
    return resolve.contexts(rows, "l_orderkey", {"platforms": "p", "businesses": "b"})


@query(
    "conflicts_in_contexts",
    """WITH i AS (SELECT l_suppkey, l_quantity AS value, l_shipdate AS s, l_shipdate + INTERVAL 20 DAY AS t, CASE WHEN l_linenumber > 1 THEN l_returnflag END AS scope FROM lineitem),
    c AS (SELECT DISTINCT l_suppkey, scope AS context FROM i WHERE scope IS NOT NULL UNION SELECT DISTINCT l_suppkey, '*' FROM i), x AS (SELECT i.l_suppkey, context, value, s, t FROM i JOIN c ON c.l_suppkey = i.l_suppkey AND (scope IS NULL OR scope = context))
    SELECT a.l_suppkey, a.context, a.s AS at, count(DISTINCT b.value) AS values FROM (SELECT DISTINCT l_suppkey, context, s FROM x) a JOIN x b ON a.l_suppkey = b.l_suppkey AND a.context = b.context AND b.s <= a.s AND b.t > a.s GROUP BY 1, 2, 3 HAVING count(DISTINCT b.value) > 1""",
)
def conflicts_in_contexts(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        "l_suppkey", F.col("l_quantity").alias("value"), F.col("l_shipdate").alias("s"), (F.col("l_shipdate") + F.expr("interval 20 days")).alias("t"),
        F.when(F.col("l_linenumber") > 1, F.array("l_returnflag")).alias("scope"),
    )
    return resolve.conflicts_in_contexts(rows, ["l_suppkey"], "scope", "value", "s", "t")


@query("conflict_sets", "SELECT l_partkey, l_suppkey, count(*) AS members, count(DISTINCT l_returnflag) AS values, left(sha256(array_to_string(list_sort(list(DISTINCT l_returnflag)), ',')), 32) AS conflict_id FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_returnflag) > 1")
def conflict_sets(spark, sf):
    return resolve.conflict_sets(table(spark, sf, "lineitem"), ["l_partkey", "l_suppkey"], "l_returnflag")


@query("type_lineage", "SELECT l_partkey, arg_min(l_returnflag, (l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_extendedprice)) AS first_type, count(DISTINCT l_returnflag) > 1 AS changed FROM lineitem GROUP BY 1")
def type_lineage(spark, sf):
    return resolve.type_lineage(table(spark, sf, "lineitem"), "l_partkey", ["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"], "l_returnflag")


@query(
    "fact_contexts",
    f"""WITH {model.ENTITIES_SQL}, {model.RELATIONS_SQL}, x AS (SELECT src AS id, type AS c FROM r UNION ALL SELECT dst, type FROM r)
    SELECT e.id, string_agg(DISTINCT c, ',' ORDER BY c) AS contexts, CASE WHEN count(c) > 0 THEN count(c) END AS facts FROM e LEFT JOIN x ON x.id = e.id GROUP BY 1""",
)
def fact_contexts(spark, sf):
    return resolve.fact_contexts(model.entities(spark, sf), model.relations(spark, sf), "type")


@query(
    "pending_structure",
    f"""WITH {model.ENTITIES_SQL}, {model.RELATIONS_SQL}, u AS (SELECT id FROM e WHERE type NOT IN ('supplier', 'part', 'region'))
    SELECT id, 'own type' AS reason FROM u UNION ALL SELECT edge, 'type of an end' FROM r WHERE src IN (SELECT id FROM u) OR dst IN (SELECT id FROM u)""",
)
def pending_structure(spark, sf):
    known = spark.createDataFrame([("supplier",), ("part",), ("region",)], "type string")
    return resolve.pending_structure(model.entities(spark, sf), model.relations(spark, sf), known)


@query(
    "discovery_vocabulary",
    """WITH t AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END AS term, count(*) AS n FROM part GROUP BY 1), f AS (SELECT *, regexp_replace(lower(trim(term)), '[\\s_-]+', ' ', 'g') AS k FROM t),
    b AS (SELECT regexp_replace(lower(trim(p_name)), '[\\s_-]+', ' ', 'g') AS k, min(p_type) AS iri, count(DISTINCT p_type) AS ways FROM part WHERE p_size < 3 GROUP BY 1),
    x AS (SELECT f.*, iri, ways, first_value(term) OVER (PARTITION BY f.k ORDER BY n DESC, term) AS c, sum(n) OVER (PARTITION BY f.k) AS total FROM f LEFT JOIN b ON b.k = f.k)
    SELECT term, n, CASE WHEN ways = 1 THEN iri ELSE c END AS canonical, CASE WHEN ways = 1 THEN 'known' WHEN ways > 1 THEN 'collision' WHEN total < 40 THEN 'rare' WHEN term <> c THEN 'variant' ELSE 'new' END AS diagnosis FROM x""",
)
def discovery_vocabulary(spark, sf):
    part = table(spark, sf, "part")
    terms = part.groupBy(F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("term")).agg(F.count(F.lit(1)).alias("n"))
    return resolve.vocabulary(terms, part.filter("p_size < 3").select(F.col("p_name").alias("label"), F.col("p_type").alias("iri")), 40)


@query("candidate_clusters", "SELECT lower(o_orderpriority) AS type, o_custkey::VARCHAR AS k, count(*) AS members, CASE min(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END) WHEN 1 THEN 'accepted' WHEN 2 THEN 'pending' ELSE 'rejected' END AS status, count(*) FILTER (WHERE o_orderstatus = 'O') AS unresolved FROM orders GROUP BY 1, 2")
def candidate_clusters(spark, sf):
    status = F.when(F.col("o_orderstatus") == "F", "accepted").when(F.col("o_orderstatus") == "O", "pending").otherwise("rejected")
    rows = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("type"), F.col("o_custkey").cast("string").alias("text"), status.alias("status"))
    return resolve.clusters(rows, ["accepted", "pending", "rejected"])


@query("candidate_conflicts", "SELECT a.l_orderkey, a.l_linenumber, a.l_quantity AS value FROM lineitem a JOIN orders o ON o.o_orderkey = a.l_orderkey WHERE a.l_quantity <> 10 AND a.l_shipdate < o.o_orderdate + INTERVAL 900 DAY AND o.o_orderdate < a.l_shipdate + INTERVAL 30 DAY")
def candidate_conflicts(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("value"), F.col("l_shipdate").alias("s"), (F.col("l_shipdate") + F.expr("interval 30 days")).alias("t"))
    new = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(10.0).alias("value"), F.col("o_orderdate").alias("s"), (F.col("o_orderdate") + F.expr("interval 900 days")).alias("t"))
    return identity.candidate_conflicts(rows, new, ["l_orderkey"], "value", "s", "t").select("l_orderkey", "l_linenumber", "value")


# ---- ontology --------------------------------------------------------------


def _triples(spark, sf):
    r = model.relations(spark, sf).select(F.col("src").alias("s"), F.col("type").alias("p"), F.col("dst").alias("o"))
    e = model.entities(spark, sf).select(F.col("id").alias("s"), F.lit("rdf:type").alias("p"), F.col("type").alias("o"))
    return r.union(e)


@query(
    "pattern_select",
    f"WITH {model.RELATIONS_SQL} SELECT DISTINCT a.src AS x, a.dst AS n, b.dst AS r FROM r a JOIN r b ON b.src = a.dst AND b.type = 'part_of' WHERE a.type = 'located_in' AND a.src LIKE 'supplier:%' ORDER BY n, r, x LIMIT 1000",
)
def pattern_select(spark, sf):
    out = ontology.select_pattern(_triples(spark, sf), [("?n", "part_of", "?r"), ("?x", "located_in", "?n"), ("?x", "rdf:type", "supplier")], None)
    return out.orderBy("n", "r", "x").limit(1000)


@query(
    "pattern_ask",
    f"""WITH {model.RELATIONS_SQL} SELECT 'supplied part of a supplier in a nation' AS question, EXISTS (SELECT 1 FROM r a JOIN r b ON b.src = a.src WHERE a.type = 'supplies' AND b.type = 'located_in') AS answer
    UNION ALL SELECT 'region in a nation', EXISTS (SELECT 1 FROM r a JOIN r b ON b.src = a.dst WHERE a.type = 'part_of' AND b.type = 'located_in')
    UNION ALL SELECT 'supplier of part:0', EXISTS (SELECT 1 FROM r WHERE type = 'supplies' AND dst = 'part:0') UNION ALL SELECT 'supplier of part:-1', EXISTS (SELECT 1 FROM r WHERE type = 'supplies' AND dst = 'part:-1')""",
)
def pattern_ask(spark, sf):
    asked = {
        "supplied part of a supplier in a nation": [("?x", "supplies", "?p"), ("?x", "located_in", "?n")], "region in a nation": [("?n", "part_of", "?r"), ("?r", "located_in", "?y")],
        "supplier of part:0": [("?x", "supplies", "part:0")], "supplier of part:-1": [("?x", "supplies", "part:-1")],
    }
    out = None
    for question, patterns in asked.items():
        row = algebra.ask(algebra.conjunction(_triples(spark, sf), patterns)).select(F.lit(question).alias("question"), "answer")
        out = row if out is None else out.union(row)
    return out


@query(
    "pattern_optional",
    f"""WITH {model.RELATIONS_SQL}, big AS (SELECT DISTINCT src, dst FROM r JOIN part ON dst = 'part:' || p_partkey WHERE type = 'supplies' AND p_name = 'small ring')
    SELECT a.src AS x, a.dst AS n, big.dst AS p FROM r a LEFT JOIN big ON big.src = a.src WHERE a.type = 'located_in' AND a.src LIKE 'supplier:%'""",
)
def pattern_optional(spark, sf):
    triples = _triples(spark, sf).union(model.entities(spark, sf).select("id", F.lit("label"), "text"))
    suppliers = algebra.conjunction(triples, [("?x", "located_in", "?n"), ("?x", "rdf:type", "supplier")])
    parts = algebra.conjunction(triples, [("?x", "supplies", "?p"), ("?p", "label", "small ring")]).distinct()
    return algebra.optional(suppliers, parts)


@query(
    "pattern_either_without",
    f"""WITH {model.RELATIONS_SQL}, u AS (SELECT src AS x, dst AS n, NULL AS r FROM r WHERE type = 'located_in' UNION ALL SELECT src, NULL, dst FROM r WHERE type = 'part_of')
    SELECT x, n, r FROM u WHERE (n <> 'nation:3' OR r IS NOT NULL) AND x NOT IN (SELECT src FROM r WHERE type = 'supplies' AND dst LIKE 'part:%7')""",
)
def pattern_either_without(spark, sf):
    triples = _triples(spark, sf)
    both = algebra.either(algebra.match(triples, ("?x", "located_in", "?n")), algebra.match(triples, ("?x", "part_of", "?r")))
    kept = algebra.keep(both, (F.col("n") != "nation:3") | F.col("r").isNotNull())
    return algebra.without(kept, algebra.keep(algebra.match(triples, ("?x", "supplies", "?p")), F.col("p").endswith("7")))


@query(
    "property_paths",
    f"""WITH RECURSIVE {model.RELATIONS_SQL}, step AS (SELECT DISTINCT src AS a, dst AS b FROM r WHERE type IN ('located_in', 'part_of')), back AS (SELECT DISTINCT dst AS a, src AS b FROM r WHERE type = 'part_of'),
    up AS (SELECT a AS s, b AS o FROM step UNION SELECT up.s, step.b FROM up JOIN step ON step.a = up.o), around AS (SELECT a.a AS s, b.b AS o FROM (SELECT src AS a, dst AS b FROM r WHERE type = 'part_of') a JOIN back b ON b.a = a.b)
    SELECT DISTINCT 'up' AS way, s, o FROM up UNION ALL SELECT DISTINCT 'neighbour', s, o FROM around""",
)
def property_paths(spark, sf):
    triples = _triples(spark, sf)
    up = algebra.path(triples, ["located_in", "part_of"])
    # Nations of one region: up and down again.
    out = algebra.path(triples, ["part_of"], most=1).withColumnRenamed("o", "r").join(algebra.path(triples, ["^part_of"], most=1).withColumnRenamed("s", "r"), "r")
    return up.select(F.lit("up").alias("way"), "s", "o").union(out.select(F.lit("neighbour"), "s", "o").distinct())


_CLASSES = [("agent", "thing"), ("supplier", "agent"), ("customer", "agent"), ("place", "thing"), ("nation", "place"), ("region", "place"), ("part", "thing")]
_CLASSES_SQL = "h AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _CLASSES) + ") t(child, parent)), u AS (SELECT child, parent FROM h UNION SELECT u.child, h.parent FROM u JOIN h ON h.child = u.parent)"


@query("entailed_types", f"WITH RECURSIVE {model.ENTITIES_SQL}, {_CLASSES_SQL} SELECT id AS s, 'rdf:type' AS p, type AS o FROM e UNION SELECT id, 'rdf:type', parent FROM e JOIN u ON child = type")
def entailed_types(spark, sf):
    return ontology.entailed_types(model.entities(spark, sf), spark.createDataFrame(_CLASSES, "child string, parent string"))


#: An ontology from the tables: nations below regions below the world, nouns of parts below things, properties from nations to nouns.
_ONTOLOGY_SQL = """
noun AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS t FROM part), cls AS (SELECT n_name AS t FROM nation UNION SELECT r_name FROM region UNION SELECT 'world' UNION SELECT 'thing' UNION SELECT t FROM noun),
prop AS (SELECT 'exports ' || n_name AS p, n_name AS d, t AS r FROM nation, noun WHERE n_nationkey % 5 = length(t) % 5),
trm AS (SELECT t, true AS c FROM cls UNION SELECT p, false FROM prop),
sub AS (SELECT n_name AS child, r_name AS parent FROM nation JOIN region ON r_regionkey = n_regionkey UNION SELECT r_name, 'world' FROM region UNION SELECT t, 'thing' FROM noun UNION SELECT t, 'unlisted' FROM noun)
"""


@query(
    "ontology_slice",
    f"""WITH RECURSIVE {_ONTOLOGY_SQL}, q AS (SELECT c_custkey AS question, lower(CASE WHEN c_custkey % 7 = 0 THEN 'nothing' ELSE 'what ' || CASE WHEN c_custkey % 2 = 0 THEN n_name || ' sells' ELSE r_name END || ' and ' || p_name END) AS low
      FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey JOIN part ON p_partkey = c_custkey % 20),
    anc AS (SELECT child, parent FROM sub WHERE parent <> 'unlisted' UNION SELECT anc.child, sub.parent FROM anc JOIN sub ON sub.child = anc.parent WHERE sub.parent <> 'unlisted'),
    lex AS (SELECT question, t, c FROM q JOIN trm ON contains(low, lower(t))),
    taken AS (SELECT question, t, 'lexical' AS why FROM lex UNION SELECT question, parent, 'ancestor' FROM lex JOIN anc ON child = t WHERE c UNION SELECT question, child, 'child' FROM lex JOIN anc ON parent = t WHERE c),
    sel AS (SELECT DISTINCT question, t FROM taken), used AS (SELECT DISTINCT question, p, d, r FROM sel JOIN prop ON t = p OR t = d OR t = r),
    used_all AS (SELECT DISTINCT u.question, prop.p, prop.d, prop.r FROM (SELECT DISTINCT question, p FROM used) u JOIN prop USING (p)),
    every AS (SELECT * FROM taken UNION SELECT question, p, 'property_contract' FROM used_all UNION SELECT question, d, 'property_domain' FROM used_all UNION SELECT question, r, 'property_range' FROM used_all
      UNION SELECT question, 'world', 'configured_root' FROM q WHERE question NOT IN (SELECT question FROM sel))
    SELECT question, t AS term, CASE WHEN bool_or(why = 'lexical') THEN lower(t) END AS surface, string_agg(why, ',' ORDER BY why) AS reasons FROM every GROUP BY question, t""",
)
def ontology_slice(spark, sf):
    nation, region, part, customer = (table(spark, sf, t) for t in ("nation", "region", "part", "customer"))
    noun = part.select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("t")).distinct()
    classes = nation.select(F.col("n_name").alias("t")).union(region.select("r_name")).union(spark.sql("select explode(array('world', 'thing'))")).union(noun).distinct()
    owns = nation.join(noun, F.col("n_nationkey") % 5 == F.length("t") % 5).select(F.concat(F.lit("exports "), "n_name").alias("property"), "n_name", "t")
    contracts = owns.select("property", F.lit("domain").alias("end"), F.col("n_name").alias("class")).union(owns.select("property", F.lit("range"), "t")).distinct()
    terms = classes.select(F.col("t").alias("term"), F.lit(True).alias("is_class")).union(owns.select("property", F.lit(False)).distinct())
    of_region = F.col("n_regionkey") == F.col("r_regionkey")
    subclasses = nation.join(region, of_region).select(F.col("n_name").alias("child"), F.col("r_name").alias("parent")).union(region.select("r_name", F.lit("world")))
    subclasses = subclasses.union(noun.select("t", F.lit("thing"))).union(noun.select("t", F.lit("unlisted")))
    who = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, of_region).join(part, F.col("c_custkey") % 20 == F.col("p_partkey"))
    place = F.when(F.col("c_custkey") % 2 == 0, F.concat("n_name", F.lit(" sells"))).otherwise(F.col("r_name"))
    text = F.when(F.col("c_custkey") % 7 == 0, "nothing").otherwise(F.concat(F.lit("What "), place, F.lit(" and "), "p_name"))
    roots = spark.createDataFrame([("world",)], "term string")
    out = slices.ontology_slices(who.select("c_custkey", text.alias("text")), "c_custkey", "text", terms, terms.select("term", F.col("term").alias("label")), subclasses, contracts, roots)
    return out.withColumn("reasons", F.array_join("reasons", ","))


@query("topological_levels", "SELECT p_partkey AS node, length(bin(p_partkey)) - 1 AS level FROM part WHERE p_partkey > 0")
def topological_levels(spark, sf):
    """Each part follows the one with half its number."""
    k = F.col("p_partkey")
    out = ontology.topological(table(spark, sf, "part").filter(k > 1).select(F.floor(k / 2).alias("a"), k.alias("b")), "a", "b")
    return out.select("node", F.col("level").cast("long").alias("level"))


@query("constraint_mode", f"WITH {model.RELATIONS_SQL} SELECT edge, 'hold' AS action FROM r WHERE type = 'supplies' AND valid_from < TIMESTAMP '1996-01-01'")
def constraint_mode(spark, sf):
    broken = model.relations(spark, sf).filter("type = 'supplies' and valid_from < timestamp_ntz'1996-01-01'").select("edge")
    return ontology.constrained(broken, "review")


@query(
    "entity_guided_expansion",
    f"""WITH RECURSIVE {model.ENTITIES_SQL}, {_CLASSES_SQL}, m AS (SELECT id, type FROM e WHERE contains(lower('compare cold widget in region nation_1'), lower(text)))
    SELECT type AS term, count(*) AS entities FROM m GROUP BY 1 UNION ALL SELECT parent, count(*) FROM m JOIN u ON child = type GROUP BY 1""",
)
def entity_guided_expansion(spark, sf):
    """Types of the entities that a question names, and their superclasses, with how many entities speak for them."""
    named = model.entities(spark, sf).filter(F.contains(F.lit("compare cold widget in region nation_1"), F.lower("text")))
    types = ontology.entailed_types(named, spark.createDataFrame(_CLASSES, "child string, parent string"))
    return types.groupBy(F.col("o").alias("term")).agg(F.count(F.lit(1)).alias("entities"))
