"""One object over a record table: scoped reads, rankings, graph and summaries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import applicability, cursors, filters
from .operators import aggregates, context, graph, identity, inverted, ontology, qualify, ranking, resolve, versions


def _version_id() -> Column:
    return F.concat_ws("#", "id", "version")


@dataclass(frozen=True)
class Scope:
    """What a read may see: instants, kinds, a metadata filter and an applicability."""

    known_at: str | None = None
    valid_at: str | None = None
    include_unknown: bool = True
    kinds: tuple[str, ...] = ()
    filters: dict | None = None
    platforms: tuple[str, ...] = ()


@dataclass(frozen=True)
class Engine:
    """``records``: ``id, kind, type, text, src, dst, version, recorded_at, superseded_at, valid_from,
    valid_until, metadata (JSON), platform_mode, platform_values``."""

    records: DataFrame

    def qualified(self, scope: Scope) -> DataFrame:
        """Rows in scope; relations only between entities in scope."""
        at = lambda t: None if t is None else F.lit(t).cast("timestamp")
        rows = versions.as_of(self.records, at(scope.known_at), at(scope.valid_at), scope.include_unknown)
        if scope.kinds:
            rows = rows.filter(F.col("kind").isin(*scope.kinds, "entity"))
        if scope.filters:
            rows = rows.filter(filters.to_column(scope.filters, F.try_parse_json("metadata"), {k: F.col(k) for k in ("id", "kind", "type")}))
        if scope.platforms:
            asked = {"mode": "specific", "values": list(scope.platforms)}
            rows = rows.filter(applicability.dimension_matches(F.col("platform_mode"), F.col("platform_values"), asked))
        ends = rows.filter("kind = 'entity'").select("id")
        relations = qualify.with_endpoints(rows.filter("kind = 'relation'"), ends, {"src": "id", "dst": "id"})
        out = rows.filter("kind <> 'relation'").unionByName(relations.select(*rows.columns))
        return out.filter(F.col("kind").isin(*scope.kinds)) if scope.kinds else out

    def history(self, record_id: str) -> DataFrame:
        return self.records.filter(F.col("id") == record_id).orderBy("version")

    def page(self, scope: Scope, limit: int, cursor: str | None = None) -> tuple[list, str | None]:
        """Rows in id order and the cursor of the next page."""
        after = tuple(cursors.decode(vars(scope), cursor)) if cursor else None
        rows = versions.keyset_page(self.qualified(scope), ["id", "version"], after, limit + 1).collect()
        more = len(rows) > limit
        return rows[:limit], cursors.encode(vars(scope), [rows[limit - 1]["id"], rows[limit - 1]["version"]]) if more else None

    def search(self, scope: Scope, query: str, k: int = 10) -> DataFrame:
        rows = self.qualified(scope).withColumn("score", ranking.lexical_score(F.col("text"), query))
        return ranking.top(rows.filter("score > 0"), "score", "id", k)

    def index_texts(self, path: str) -> DataFrame:
        """Stores an inverted index of all versions' texts, for ``keyword`` and ``hybrid``; it stays right for any scope."""
        inverted.build(self.records.select(_version_id().alias("version_id"), "text"), "version_id", "text", path)
        return self.records.sparkSession.read.parquet(path)

    def keyword(self, scope: Scope, query: str, k: int = 10, index: DataFrame | None = None) -> DataFrame:
        """BM25 over the best text of each record: ``id, score, rank``, scores above zero only.

        With an ``index`` no text is read; only versions in scope are ranked, by how rare terms are in the index.
        """
        asked = self.records.sparkSession.createDataFrame([(0, query)], "query int, query_text string")
        if index is not None:
            live = self.qualified(scope).select(_version_id().alias("version_id"), F.col("id").alias("record"))
            found = inverted.search(index, asked, "query", "query_text", k, live).join(live.withColumnRenamed("version_id", "id"), "id")
            return ranking.top(found.groupBy(F.col("record").alias("id")).agg(F.max("score").alias("score")), "score", "id", k)
        scored = ranking.bm25(self.qualified(scope), "id", "text", asked, "query", "query_text").filter("score > 0")
        return ranking.top(scored.groupBy("id").agg(F.max("score").alias("score")), "score", "id", k)

    def semantic(self, scope: Scope, vectors: DataFrame, vector: list[float], k: int = 10, least: float = 0.35) -> DataFrame:
        """Cosine over ``vectors`` (``id, version, vector``): hits count only for versions in scope; the best of an id stays."""
        scored = ranking.cosine_rank(vectors, "vector", vector, least)
        live = self.qualified(scope).select("id", "version")
        hits = scored.join(live, ["id", "version"]).groupBy("id").agg(F.max("score").alias("score"))
        return ranking.top(hits, "score", "id", k)

    def hybrid(
        self,
        scope: Scope,
        query: str,
        vectors: DataFrame,
        vector: list[float],
        k: int = 10,
        types: tuple[str, ...] = (),
        constant: int = 60,
        index: DataFrame | None = None,
    ) -> DataFrame:
        """Fused ranking of the keyword and semantic channels, each to a depth of min(1000, max(50, 5 k)), with the records.

        With ``types``, entities of these types are a third channel, in the order of their ids.
        """
        depth = min(1000, max(50, 5 * k))
        channels = [("keyword", self.keyword(scope, query, depth, index)), ("semantic", self.semantic(scope, vectors, vector, depth))]
        if types:
            own = self.qualified(scope).filter(F.col("kind") == "entity").filter(F.col("type").isin(*types)).withColumn("score", F.lit(0.0))
            channels.append(("type", ranking.top(own.select("id", "score").distinct(), "score", "id", depth)))
        fused = ranking.rrf(channels, "id", k, constant)  # k rows
        return self.qualified(scope).join(F.broadcast(fused), "id").orderBy(F.desc("score"), "best_rank", "id")

    def dashboard(self, scope: Scope) -> DataFrame:
        return aggregates.counts_by(self.qualified(scope), ["kind"], unknown_start=F.col("valid_from").isNull())

    def explore(self, scope: Scope, query: str, types: tuple[str, ...] = ()) -> DataFrame:
        """Relations at the entities whose text has the query, between entities of the types."""
        rows = self.qualified(scope)
        entities = rows.filter("kind = 'entity'")
        hits = entities.filter(qualify.keyword_predicate(query, F.col("text"))).select("id")
        allowed = entities.filter(F.col("type").isin(*types)) if types else entities
        return graph.around(rows.filter("kind = 'relation'").select(F.col("id").alias("edge"), "src", "dst"), hits, allowed.select("id"))

    def select(self, scope: Scope, patterns: list[tuple[str, str, str]], limit: int = 1000) -> DataFrame:
        """Solutions of a graph pattern over the triples in scope."""
        rows = self.qualified(scope)
        types = rows.filter("kind = 'entity'").select(F.col("id").alias("s"), F.lit("rdf:type").alias("p"), F.col("type").alias("o"))
        facts = rows.filter("kind = 'relation'").select(F.col("src").alias("s"), F.col("type").alias("p"), F.col("dst").alias("o"))
        return ontology.select_pattern(types.union(facts), patterns, limit)

    def resolve(self, scope: Scope, name: str, least: float = 0.7, most: int = 12) -> DataFrame:
        return resolve.near_names(self.qualified(scope).filter("kind = 'entity'"), "text", name, least, most)

    def merge_preview(self, scope: Scope, keep: str, drop: str) -> DataFrame:
        """What a merge would write: a tombstone and redirected relations."""
        from .operators import governance

        rows = self.qualified(scope)
        facts = rows.filter("kind = 'relation'").select(F.col("id").alias("edge"), "src", "dst")
        return governance.merge_entity(rows.filter("kind = 'entity'"), facts, keep, drop)

    def conflicts(self, scope: Scope, value: str = "text") -> DataFrame:
        """Attributes (``src``, ``type``) with several values at one instant, within the platforms that they share."""
        rows = self.qualified(scope).filter("kind = 'attribute'")
        return resolve.conflicts_in_contexts(rows, ["src", "type"], "platform_values", value, "valid_from", "valid_until")

    def manifest(self, scope: Scope) -> DataFrame:
        rows = self.qualified(scope)
        return versions.version_manifest(rows.withColumn("version_id", F.concat_ws("#", "id", "version")), "kind")

    def graph_rows(self, scope: Scope) -> DataFrame:
        rows = self.qualified(scope)
        relations = rows.filter("kind = 'relation'").select(F.col("id").alias("edge"), "type", "src", "dst")
        return context.compact_rows(rows.filter("kind = 'entity'"), relations)

    def counts(self, scope: Scope) -> DataFrame:
        return aggregates.counts_by(self.qualified(scope), ["kind", "type"], unknown_start=F.col("valid_from").isNull())

    def facets(self, scope: Scope) -> DataFrame:
        return aggregates.metadata_facets(self.qualified(scope), "metadata", "type")

    def timeline(self, step: Column | None = None) -> DataFrame:
        return versions.timeline(self.records, F.col("recorded_at") if step is None else step)

    def neighbourhood(self, scope: Scope, seeds: DataFrame, hops: int, **budgets: int) -> tuple[DataFrame, bool]:
        edges = self.qualified(scope).filter("kind = 'relation'").select(F.col("id").alias("edge"), "src", "dst")
        return graph.bounded_search(edges, seeds, hops, **budgets)

    def graph_view(self, scope: Scope, seeds: DataFrame, hops: int, **budgets: int) -> tuple[DataFrame, DataFrame, bool]:
        """Nodes, all edges between them, and whether a budget cut them short."""
        edges = self.qualified(scope).filter("kind = 'relation'").select(F.col("id").alias("edge"), "src", "dst")
        return graph.neighbourhood(edges, seeds, hops, **budgets)

    def duplicates(self, scope: Scope) -> DataFrame:
        named = self.qualified(scope).filter("kind = 'entity'").withColumn("name", F.lower(F.trim("text")))
        return identity.duplicate_groups(named, ["type", "name"], "id")
