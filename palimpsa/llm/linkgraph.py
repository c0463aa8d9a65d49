"""URL filters whose rules are carried over a graph of hosts.

Rules name a host and a path. What no rule decides is decided by host: hosts with
allowed pages are trusted seeds and hosts with blocked pages are blocked seeds,
each by the share of such pages among its own. Trust is a personalised PageRank
along host edges, and distrust one against them. A host is blocked if its distrust
is larger than its trust and reaches a share of what a host with nothing but blocked
pages has of its own.

Host edges are hyperlinks between different hosts, and the steps between a page's host
and its parent domains, in both directions, down to names of two labels. An edge counts
once however often it is there. Scores are whole numbers (a seed of full share has
UNIT) and divisions round down, so a result does not depend on the order of sums.

Everything is DataFrame operations. Pages of one host are counted with partial
aggregation, edges are read from the pages once, and every round is a join on the
hosts' scores, of one row a host, so that Spark can split a hub's edges.

Defined results: a null url and one without ``://`` have an empty host and path, fit no
rule and are allowed; null html has no links; hosts over 253 characters (no domain
name is longer) have no parents; repeated rows and null ids are kept as they are, and
count as pages; an empty table gives no rows; other columns are ignored. Very long
pages are searched for links whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.recovery import cut


@dataclass(frozen=True)
class Rule:
    """Fits ``host`` and its subdomains where the url's path starts with ``/`` and ``path``."""

    verdict: str
    host: str
    path: str = ""

    @property
    def text(self) -> str:
        return f"{self.host}/{self.path}"


#: The rules of the registered query (fixed values).
RULES = (
    Rule("allow", "com"),
    Rule("block", "example.com", "en/"),
    Rule("allow", "www.example.com", "en/"),
    Rule("block", "net", "es/"),
    Rule("block", "net", "fr/"),
)
#: Rules are written into one expression, so they are few. More are refused.
MOST_RULES = 1000
#: The score of a seed whose pages are all of its kind.
UNIT = 1_000_000
#: Of a score, what goes along the edges and what stays with the seed, in twentieths.
ALONG, OWN, WHOLE = 17, 3, 20
ROUNDS = 10
#: Lineage is cut after so many rounds.
ROUNDS_A_CUT = 5
#: A blocked host's distrust reaches this part of OWN / WHOLE * UNIT at least.
LEAST_SHARE = 2
MOST_HOST = 253

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = "(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = "[hH][rR][eE][fF][\\x20\\x09-\\x0D]*=[\\x20\\x09-\\x0D]*[\"']?(?:[hH][tT][tT][pP][sS]?:)?//([^/?#\"'<>\\x20\\x09-\\x0D]+)"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path, empty where there are none."""
    whole = F.coalesce(url.cast("string"), F.lit(""))
    return ascii_lower(F.regexp_extract(whole, PARTS, 1)), F.regexp_extract(whole, PARTS, 2)


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """``struct(rule, verdict)`` of the longest rule that fits; null if none does."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    fits = [
        F.when(((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(f"/{r.path}"), F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict")))
        for r in sorted(rules, key=lambda r: (-len(r.text), r.text))
    ]
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


def judged(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``page_id, host, path, rule, by_rule`` of every page."""
    host, path = url_parts(F.col("url"))
    rows = pages.select(F.col("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    return rows.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("by_rule"))


def links(pages: DataFrame) -> DataFrame:
    """``(src, dst)``: distinct hyperlinks between different hosts."""
    host, _ = url_parts(F.col("url"))
    found = F.array_distinct(F.regexp_extract_all(F.coalesce(F.col("html").cast("string"), F.lit("")), F.lit(LINK), 1))
    rows = pages.select(host.alias("src"), F.explode(found).alias("dst")).select("src", ascii_lower(F.col("dst")).alias("dst"))
    return rows.filter("src <> '' and src <> dst").distinct()


def domain_steps(hosts: DataFrame) -> DataFrame:
    """``(src, dst)``: each name and its parent of two labels or more, in both directions."""
    labels = F.split(F.when(F.length("host") <= MOST_HOST, F.col("host")).otherwise(""), "\\.")
    name = lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    steps = F.when(F.size(labels) > 2, F.transform(F.sequence(F.lit(1), F.size(labels) - 2), lambda i: F.struct(name(i).alias("u"), name(i + 1).alias("v"))))
    up = hosts.select(F.explode(steps).alias("step")).select("step.u", "step.v").distinct()
    both = F.array(F.struct(F.col("u").alias("src"), F.col("v").alias("dst")), F.struct(F.col("v").alias("src"), F.col("u").alias("dst")))
    return up.select(F.explode(both).alias("e")).select("e.src", "e.dst").filter("src <> dst")


def seeds(rows: DataFrame) -> DataFrame:
    """``(host, trusted, blocked)``: the share of a host's pages with each verdict by rule, in units."""
    count = lambda verdict: F.sum(F.when(F.col("by_rule") == verdict, 1).otherwise(0))
    sums = rows.filter("host <> ''").groupBy("host").agg(F.count(F.lit(1)).alias("n"), count("allow").alias("a"), count("block").alias("b"))
    return sums.select("host", F.expr(f"{UNIT} * a div n").alias("trusted"), F.expr(f"{UNIT} * b div n").alias("blocked"))


def propagate(edges: DataFrame, seed: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``(host, trust, distrust)`` of all hosts with a seed or an edge.

    ``edges``: distinct ``(src, dst)``; ``seed``: ``(host, trusted, blocked)``, a row a host.
    Both walks are taken in one: distrust (kind 1) goes along the edges turned around.
    """
    turned = F.array(
        F.struct(F.lit(0).alias("kind"), F.col("src").alias("at"), F.col("dst").alias("to")),
        F.struct(F.lit(1).alias("kind"), F.col("dst").alias("at"), F.col("src").alias("to")),
    )
    ways = edges.select(F.explode(turned).alias("w")).select("w.kind", "w.at", "w.to")
    degree = ways.groupBy("kind", "at").agg(F.count(F.lit(1)).alias("degree"))
    kinds = F.array(F.struct(F.lit(0).alias("kind"), F.col("trusted").alias("seed")), F.struct(F.lit(1).alias("kind"), F.col("blocked").alias("seed")))
    sources = seed.select("host", F.explode(kinds).alias("s")).select(F.col("s.kind").alias("kind"), F.col("host").alias("at"), F.col("s.seed").alias("seed")).filter("seed > 0")
    ways = cut(ways)
    degree = cut(degree)
    own = cut(sources.select("kind", "at", F.expr(f"{OWN} * seed div {WHOLE}").alias("score")))
    scores = sources.select("kind", "at", F.col("seed").alias("score"))
    for i in range(rounds):
        given = scores.join(degree, ["kind", "at"]).select("kind", "at", F.expr(f"{ALONG} * score div ({WHOLE} * degree)").alias("score")).filter("score > 0")
        moved = given.join(ways, ["kind", "at"]).select("kind", F.col("to").alias("at"), "score")
        scores = own.unionByName(moved).groupBy("kind", "at").agg(F.sum("score").alias("score"))
        if i % ROUNDS_A_CUT == ROUNDS_A_CUT - 1 or i == rounds - 1:
            scores = cut(scores)
    of = lambda kind: F.coalesce(F.max(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0))
    return scores.groupBy(F.col("at").alias("host")).agg(of(0).alias("trust"), of(1).alias("distrust"))


def blocked_host(trust: Column, distrust: Column) -> Column:
    return (distrust > trust) & (distrust * (LEAST_SHARE * WHOLE) >= OWN * UNIT)


def verdicts(pages: DataFrame, rules: tuple[Rule, ...] = RULES, rounds: int = ROUNDS) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every page."""
    rows = judged(pages, rules)
    seed = cut(seeds(rows))
    scores = propagate(links(pages).union(domain_steps(seed.select("host"))).distinct(), seed, rounds)
    bad = scores.filter(blocked_host(F.col("trust"), F.col("distrust"))).select(F.col("host").alias("bad"))
    # A hot host has one row on the right, so its pages can be split among tasks.
    out = rows.join(bad, (F.col("host") == F.col("bad")) & F.col("by_rule").isNull(), "left")
    by_method = F.when(F.col("bad").isNotNull(), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_method).alias("verdict"))


def _sql(rules: tuple[Rule, ...], rounds: int) -> str:
    """DuckDB SQL of ``verdicts``: the rounds one after the other."""
    lower = f"translate({{}}, '{UPPER}', '{LOWER}')"
    fits = " ".join(
        f"WHEN (host = '{r.host}' OR host LIKE '%.{r.host}') AND starts_with(path, '/{r.path}') THEN '{r.text}={r.verdict}'"
        for r in sorted(rules, key=lambda r: (-len(r.text), r.text))
    )
    link = LINK.replace("'", "''")
    steps = "\n".join(
        f""", s{i + 1} AS MATERIALIZED (
  SELECT kind, node, sum(score)::BIGINT AS score FROM (
    SELECT kind, node, {OWN} * seed // {WHOLE} AS score FROM sources UNION ALL
    SELECT w.kind, w.dst, {ALONG} * s.score // ({WHOLE} * d.degree) FROM s{i} s JOIN degree d USING (kind, node) JOIN ways w USING (kind, node)
  ) GROUP BY kind, node)"""
        for i in range(rounds)
    )
    return f"""
WITH parts AS (
  SELECT page_id, coalesce(html, '') AS html, {lower.format(f"regexp_extract(coalesce(url, ''), '{PARTS}', 1)")} AS host,
         regexp_extract(coalesce(url, ''), '{PARTS}', 2) AS path FROM pages
), fitted AS (
  SELECT *, CASE {fits} END AS fit FROM parts
), rows_ AS (
  SELECT page_id, host, path, html, split_part(fit, '=', 1) AS rule, split_part(fit, '=', 2) AS by_rule FROM fitted
), seed AS (
  SELECT host, {UNIT} * (count(*) FILTER (by_rule = 'allow')) // count(*) AS trusted,
         {UNIT} * (count(*) FILTER (by_rule = 'block')) // count(*) AS blocked FROM rows_ WHERE host <> '' GROUP BY host
), found AS (
  SELECT host AS src, {lower.format("dst")} AS dst FROM (SELECT host, unnest(regexp_extract_all(html, '{link}', 1)) AS dst FROM rows_ WHERE host <> '')
), up AS (
  SELECT list_aggregate(l[i:], 'string_agg', '.') AS u, list_aggregate(l[i + 1:], 'string_agg', '.') AS v FROM (
    SELECT l, unnest(range(1, len(l) - 1)) AS i FROM (SELECT string_split(host, '.') AS l FROM seed WHERE length(host) <= {MOST_HOST}) WHERE len(l) > 2)
), edges AS (
  SELECT src, dst FROM found WHERE src <> dst UNION SELECT u, v FROM up WHERE u <> v UNION SELECT v, u FROM up WHERE u <> v
), ways AS MATERIALIZED (
  SELECT 0 AS kind, src AS node, dst FROM edges UNION ALL SELECT 1, dst, src FROM edges
), degree AS MATERIALIZED (
  SELECT kind, node, count(*) AS degree FROM ways GROUP BY kind, node
), sources AS MATERIALIZED (
  SELECT 0 AS kind, host AS node, trusted AS seed FROM seed WHERE trusted > 0 UNION ALL SELECT 1, host, blocked FROM seed WHERE blocked > 0
), s0 AS (SELECT kind, node, seed AS score FROM sources)
{steps}, scores AS (
  SELECT node AS host, coalesce(max(score) FILTER (kind = 0), 0) AS trust, coalesce(max(score) FILTER (kind = 1), 0) AS distrust FROM s{rounds} GROUP BY node
)
SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN distrust > trust AND distrust * {LEAST_SHARE * WHOLE} >= {OWN * UNIT} THEN 'block' ELSE 'allow' END) AS verdict
FROM rows_ LEFT JOIN scores USING (host)
"""


SQL = _sql(RULES, ROUNDS)
