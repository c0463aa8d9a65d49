"""Evidence as of an instant, over orders (assertions), line items (decisions) and customers (records)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import evidence
from . import model
from .catalogue import query
from .model import table

#: Every customer is read once, at an instant of its own; orders are assertions about it, decided by their line items.
_SQL = f"""
WITH {model.DECISIONS_SQL}, reads AS (
  SELECT c_custkey AS read, c_custkey AS record, TIMESTAMP '1996-01-01' + to_days((c_custkey * 37 % 2000)::INTEGER) AS known_at,
         TIMESTAMP '1996-01-11' + to_days((c_custkey * 37 % 2000)::INTEGER) AS valid_at FROM customer
), mappings AS (
  SELECT o_custkey AS record, assertion_id AS assertion, decision_version AS event, created_at
  FROM d JOIN orders ON o_orderkey = assertion_id WHERE to_status = 'accepted' AND decision_version % 2 = 1
), running AS (
  SELECT DISTINCT assertion_id, created_at, max(decision_version) OVER (PARTITION BY assertion_id ORDER BY created_at) AS last_version FROM d
), asked AS (
  SELECT r.*, m.assertion, m.event FROM reads r JOIN mappings m USING (record) WHERE m.created_at <= r.known_at
), standing AS (
  SELECT a.* FROM asked a ASOF JOIN running s ON s.assertion_id = a.assertion AND a.known_at >= s.created_at WHERE s.last_version = a.event
), chunked AS (
  SELECT s.*, d.l_partkey AS chunk, o_custkey AS document, o_orderdate FROM standing s JOIN d ON d.assertion_id = s.assertion AND d.decision_version = 1
  JOIN orders ON o_orderkey = s.assertion WHERE o_orderdate <= s.known_at
), docs AS (
  SELECT o_custkey AS document, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version, o_orderdate AS recorded_at,
         lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS superseded_at, o_orderkey % 9 = 0 AS deleted,
         CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate - INTERVAL 20 DAY END AS valid_from,
         CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate + to_days((o_orderkey % 400)::INTEGER) END AS valid_until FROM orders
), lasting AS (
  SELECT DISTINCT document, recorded_at, max(version) OVER (PARTITION BY document ORDER BY recorded_at) AS version FROM docs
), governed AS (
  SELECT c.*, g.valid_from, g.valid_until, p.p_size FROM chunked c ASOF JOIN lasting l ON l.document = c.document AND c.known_at >= l.recorded_at
  JOIN docs g ON g.document = l.document AND g.version = l.version JOIN part p ON p.p_partkey = c.chunk
  WHERE NOT g.deleted AND coalesce(g.superseded_at > c.known_at, true)
), states AS (
  SELECT *, CASE WHEN valid_from >= valid_until THEN 'conflict' WHEN valid_until <= valid_at THEN 'expired' WHEN valid_from > valid_at THEN 'not_yet_effective'
         WHEN valid_from IS NOT NULL THEN 'effective' ELSE 'unknown' END AS a,
         CASE WHEN p_size > 45 THEN 'expired' WHEN p_size > 3 THEN 'effective' ELSE 'unknown' END AS b FROM governed
), occ AS (
  SELECT read, record, assertion, chunk, document, CASE WHEN a = 'effective' THEN b WHEN b = 'effective' OR a = b THEN a ELSE 'conflict' END AS status FROM states
)
"""


def _inputs(spark, sf) -> tuple[DataFrame, ...]:
    log = model.decisions(spark, sf)
    orders = table(spark, sf, "orders")
    day = lambda n: F.make_dt_interval(n.cast("int"))
    at = lambda d: F.lit(d).cast("timestamp_ntz") + day(F.col("c_custkey") * 37 % 2000)
    reads = table(spark, sf, "customer").select(F.col("c_custkey").alias("read"), F.col("c_custkey").alias("record"), at("1996-01-01 00:00:00").alias("known_at"), at("1996-01-11 00:00:00").alias("valid_at"))
    owned = log.join(orders, F.col("assertion_id") == F.col("o_orderkey"))
    mappings = owned.filter("to_status = 'accepted' and decision_version % 2 = 1").select(
        F.col("o_custkey").alias("record"), F.col("assertion_id").alias("assertion"), F.col("decision_version").alias("event"), F.col("created_at").cast("timestamp_ntz").alias("created_at")
    )
    events = log.select(
        F.col("decision_version").alias("event"), F.col("assertion_id").alias("assertion"), "decision_version", F.col("created_at").cast("timestamp_ntz").alias("created_at"), "to_status",
        F.lit(None).cast("long").alias("record"),
    )
    # The chunk of an assertion is the part of its order's first line.
    first = owned.filter("decision_version = 1").withColumnsRenamed({"assertion_id": "assertion", "l_partkey": "chunk", "o_custkey": "document"})
    assertions = first.select("assertion", "chunk", "document", F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"))
    old, new = F.lit("1990-01-01 00:00:00").cast("timestamp_ntz"), F.lit("1990-02-01 00:00:00").cast("timestamp_ntz")
    part = table(spark, sf, "part").select(
        F.col("p_partkey").alias("chunk"), old.alias("recorded_at"), F.when(F.col("p_size") > 3, old).alias("valid_from"), F.when(F.col("p_size") > 45, new).alias("valid_until")
    )
    chunks = first.select("chunk", "document").distinct().join(part, "chunk")
    key = F.col("o_orderkey")
    versions = orders.withColumn("at", F.col("o_orderdate").cast("timestamp_ntz"))
    own = W.partitionBy("o_custkey").orderBy("at", "o_orderkey")
    documents = versions.select(
        F.col("o_custkey").alias("document"), F.row_number().over(own).alias("version"), F.col("at").alias("recorded_at"), F.lead("at").over(own).alias("superseded_at"),
        (key % 9 == 0).alias("deleted"), F.when(key % 5 != 0, F.col("at") - F.make_dt_interval(F.lit(20))).alias("valid_from"), F.when(key % 4 == 0, F.col("at") + day(key % 400)).alias("valid_until"),
    )
    return reads, mappings, events, assertions, chunks, documents


@query("source_context", f"{_SQL} SELECT DISTINCT read, record, chunk FROM occ")
def source_context(spark, sf):
    return evidence.source_context(*_inputs(spark, sf))


@query("evidence_occurrences", f"{_SQL} SELECT read, record, assertion, chunk, document, status FROM occ")
def evidence_occurrences(spark, sf):
    return evidence.occurrences(*_inputs(spark, sf))


@query(
    "answer_validity",
    f"""{_SQL}, own AS (
      SELECT read, record, CASE WHEN f >= u THEN 'conflict' WHEN u <= valid_at THEN 'expired' WHEN f > valid_at THEN 'not_yet_effective' WHEN f IS NOT NULL THEN 'effective' ELSE 'unknown' END AS own
      FROM (SELECT r.*, CASE WHEN c_custkey % 7 <> 0 THEN TIMESTAMP '1995-01-01' + to_days((c_custkey % 1500)::INTEGER) END AS f,
                   CASE WHEN c_custkey % 3 = 0 THEN TIMESTAMP '1999-01-01' END AS u FROM reads r JOIN customer ON c_custkey = record)
    ), counts AS (
      SELECT read, count(*) AS n, count(*) FILTER (status = 'effective') AS e, count(*) FILTER (status = 'unknown') AS k, min(status) AS least, max(status) AS most FROM occ GROUP BY read
    ), judged AS (
      SELECT own.read, own.record, coalesce(n, 0) AS n, coalesce(e, 0) AS e, coalesce(k, 0) AS k,
             CASE WHEN own IN ('effective', 'unknown') AND coalesce(e, 0) = 0 AND (own = 'effective' OR coalesce(n, 0) > 0)
                  THEN CASE WHEN n IS NULL THEN 'unknown' WHEN least = most THEN least ELSE 'conflict' END ELSE own END AS status
      FROM own LEFT JOIN counts ON counts.read = own.read
    )
    SELECT read, record, status, CASE WHEN status = 'effective' THEN 'effective_basis' ELSE 'reference' END AS usage,
           (CASE status WHEN 'effective' THEN e WHEN 'unknown' THEN e + k ELSE n END)::BIGINT AS n_allowed FROM judged""",
)
def answer_validity(spark, sf):
    reads, *rest = _inputs(spark, sf)
    key = F.col("c_custkey")
    start = F.when(key % 7 != 0, F.lit("1995-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval((key % 1500).cast("int")))
    records = table(spark, sf, "customer").select(key.alias("record"), start.alias("valid_from"), F.when(key % 3 == 0, F.lit("1999-01-01 00:00:00").cast("timestamp_ntz")).alias("valid_until"))
    return evidence.answer_validity(reads, records, evidence.occurrences(reads, *rest))


@query(
    "conflict_reads",
    f"""{_SQL}, parts AS (
      SELECT l_partkey AS set, min(l_shipdate) + INTERVAL 400 DAY AS created_at FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size > 20 GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1
    ), sets AS (
      SELECT *, CASE WHEN set % 3 = 0 THEN created_at + INTERVAL 500 DAY END AS resolved_at, TIMESTAMP '1996-06-01' + to_days((set * 13 % 1500)::INTEGER) AS known_at FROM parts
    ), members AS (
      SELECT DISTINCT l_partkey AS set, l_returnflag AS record, l_orderkey AS assertion FROM lineitem WHERE l_partkey IN (SELECT set FROM sets)
    ), asked2 AS (
      SELECT s.set, s.known_at, m.record, m.assertion FROM sets s JOIN members m USING (set) WHERE created_at <= known_at AND (resolved_at IS NULL OR resolved_at > known_at)
    ), decided AS (
      SELECT a.*, coalesce(d.to_status = 'accepted', false) AS contradicting FROM asked2 a ASOF LEFT JOIN running s ON s.assertion_id = a.assertion AND a.known_at >= s.created_at
      LEFT JOIN d ON d.assertion_id = s.assertion_id AND d.decision_version = s.last_version
    ), sourced AS (
      SELECT x.*, CASE WHEN o_orderkey % 11 <> 0 THEN o_custkey END AS document FROM decided x JOIN orders ON o_orderkey = assertion
    ), judged2 AS (
      SELECT x.*, g.version IS NOT NULL AND NOT g.deleted AND coalesce(g.superseded_at > x.known_at, true) AS there FROM sourced x
      ASOF LEFT JOIN lasting l ON l.document = x.document AND x.known_at >= l.recorded_at LEFT JOIN docs g ON g.document = l.document AND g.version = l.version
    )
    SELECT set AS read, set, count(DISTINCT record) AS members, count(*) AS supports, count(*) FILTER (contradicting AND (document IS NULL OR there)) AS active_supports FROM judged2 GROUP BY set""",
)
def conflict_reads(spark, sf):
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "part").filter("p_size > 20").select(F.col("p_partkey").alias("l_partkey")), "l_partkey")
    own = lines.groupBy(F.col("l_partkey").alias("set")).agg(F.min("l_shipdate").cast("timestamp_ntz").alias("first"), F.count_distinct("l_returnflag").alias("n")).filter("n > 1")
    later = lambda c, days: F.col(c) + F.make_dt_interval(F.lit(days))
    sets = own.select("set", F.col("set").alias("entity"), later("first", 400).alias("created_at"))
    sets = sets.withColumn("resolved_at", F.when(F.col("set") % 3 == 0, later("created_at", 500)))
    at = F.lit("1996-06-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval((F.col("set") * 13 % 1500).cast("int"))
    reads = own.select(F.col("set").alias("read"), F.col("set").alias("entity"), at.alias("known_at"))
    members = lines.select(F.col("l_partkey").alias("set"), F.col("l_returnflag").alias("record"), F.col("l_orderkey").alias("assertion"))
    events = model.decisions(spark, sf).select(
        F.col("assertion_id").alias("assertion"), "decision_version", F.col("created_at").cast("timestamp_ntz").alias("created_at"), F.when(F.col("to_status") == "accepted", "contradicting").otherwise("rejected").alias("to_status")
    )
    key = F.col("o_orderkey")
    assertions = table(spark, sf, "orders").select(key.alias("assertion"), F.when(key % 11 != 0, F.col("o_custkey")).alias("document"))
    return evidence.conflict_reads(reads, sets, members, events, assertions, _inputs(spark, sf)[-1])
