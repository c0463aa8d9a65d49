"""Approximate nearest neighbours with balanced posting lists.

* Equal vectors become one entry with their K + 1 smallest ids, which is all a
  top-K answer can need.
* Centroids: a bounded sample is halved at the median along its main direction
  until there are 4 sqrt(n) parts (MAX_CLUSTERS at most), so lists are balanced.
* A neighbour graph over the centroids is kept in memory and searched best first.
* Boundary vectors are replicated to all of their nearest centroids within a
  distance ratio; a query reads the lists whose centroids are within a ratio of the
  nearest one's distance.
* Lists longer than LIST_LIMIT are dealt over several tasks, queries with them.
* ``exact`` leaves lists and pruning out: queries meet all vectors, in blocks of LIST_LIMIT.

The sample only places the centroids: every vector is in the index.

Defined results: rows with a null id or a vector that is null, empty, zero, of
another length than most, or with a null or non-finite component take no part;
repeated rows count once; ties go to smaller ids; an empty table gives no rows;
other columns are ignored.

Past MAX_CLUSTERS lists grow with the table, and so does what a query reads; none of it is left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.recovery import cut

MAX_CLUSTERS = 16_384
SAMPLE_PER_CLUSTER = 8
#: Neighbours of a centroid in the graph; width of a search.
DEGREE, BEAM = 24, 64
#: Lists a vector is put into at most, and how much farther than the nearest they may be.
REPLICAS, REPLICA_RATIO = 6, 1.15
#: Lists a query reads at most, at least, and the ratio beyond which others are pruned.
PROBES, LEAST_PROBES, PROBE_RATIO = 128, 32, 1.6
LIST_LIMIT = 20_000


def bisect_clusters(x: np.ndarray, n: int) -> np.ndarray:
    """Centroids of n parts of x, of equal size within one row per halving."""
    rng = np.random.default_rng(3)
    parts = [np.arange(len(x))]
    while len(parts) < n:
        parts.sort(key=len)
        biggest = parts.pop()
        if len(biggest) < 2:
            parts.append(biggest)
            break
        own = x[biggest] - x[biggest].mean(axis=0)
        axis = rng.normal(size=x.shape[1])
        for _ in range(8):
            axis = own.T @ (own @ axis)
            axis /= np.linalg.norm(axis) + 1e-30
        order = np.argsort(own @ axis, kind="stable")
        half = len(order) // 2
        parts += [biggest[order[:half]], biggest[order[half:]]]
    return np.stack([x[p].mean(axis=0) for p in parts])


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a**2).sum(axis=1)[:, None] - 2 * a @ b.T + (b**2).sum(axis=1)[None, :], 0)


@dataclass
class Graph:
    """Neighbour graph of centroids with best-first search for many queries at once."""

    centroids: np.ndarray
    edges: np.ndarray
    entries: np.ndarray

    @staticmethod
    def build(centroids: np.ndarray) -> Graph:
        n = len(centroids)
        degree = min(DEGREE, n - 1)
        edges = np.zeros((n, degree + 2), np.int64)
        for lo in range(0, n, 1024):
            d = _squares(centroids[lo : lo + 1024], centroids)
            d[np.arange(len(d)), np.arange(lo, lo + len(d))] = np.inf
            edges[lo : lo + 1024, :degree] = np.argsort(d, axis=1, kind="stable")[:, :degree]
        # A ring and long steps keep the graph connected.
        edges[:, degree] = (np.arange(n) + 1) % n
        edges[:, degree + 1] = np.random.default_rng(5).permutation(n)
        return Graph(centroids, edges, np.unique(np.linspace(0, n - 1, min(n, 64)).astype(np.int64)))

    def search(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the k nearest centroids found, nearest first."""
        n, beam = len(self.centroids), max(min(BEAM, len(self.centroids)), k)
        seen = np.zeros((len(q), n + 1), bool)
        rows = np.arange(len(q))[:, None]
        ids = np.full((len(q), beam), n)
        dist = np.full((len(q), beam), np.inf)
        done = np.zeros((len(q), beam), bool)

        def add(new: np.ndarray) -> None:
            nonlocal ids, dist, done
            fresh = ~seen[rows, new]
            seen[rows, new] = True
            d = ((self.centroids[new] - q[:, None, :]) ** 2).sum(axis=2)
            d = np.where(fresh, d, np.inf)
            both_d = np.concatenate([dist, d], axis=1)
            best = np.argsort(both_d, axis=1, kind="stable")[:, :beam]
            dist = np.take_along_axis(both_d, best, axis=1)
            ids = np.take_along_axis(np.concatenate([ids, np.where(fresh, new, n)], axis=1), best, axis=1)
            done = np.take_along_axis(np.concatenate([done, np.zeros(new.shape, bool)], axis=1), best, axis=1)

        add(np.repeat(self.entries[None, :], len(q), axis=0))
        while True:
            open_d = np.where(done, np.inf, dist)
            at = np.argmin(open_d, axis=1)
            live = np.isfinite(open_d[np.arange(len(q)), at])
            if not live.any():
                break
            done[np.arange(len(q)), at] = True
            here = np.where(live, ids[np.arange(len(q)), at], 0)
            # A node that is expanded twice adds nothing, as all of its neighbours are seen.
            new = self.edges[here]
            first = np.sort(new, axis=1)
            first[:, 1:][first[:, 1:] == first[:, :-1]] = n
            fresh = np.where(first == n, self.entries[0], first)
            add_mask = (first != n) & live[:, None]
            add(np.where(add_mask, fresh, self.entries[0]))
        return ids[:, :k], np.sqrt(dist[:, :k])


def valid_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, v array<double>`` of the rows that take part, once each."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = rows.filter(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0)
    )
    most = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    return rows.filter(F.size("v") == (most["d"] if most else 0)).distinct()


def entries_of(rows: DataFrame, k: int) -> DataFrame:
    """``v, ids``: every distinct vector with its k + 1 smallest ids."""
    order = W.partitionBy("v").orderBy("vec_id")
    few = rows.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1)
    return few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def build_graph(entries: DataFrame, max_clusters: int = MAX_CLUSTERS) -> Graph | None:
    n = entries.count()
    if not n:
        return None
    clusters = max(1, min(max_clusters, int(4 * n**0.5), n))
    want = SAMPLE_PER_CLUSTER * clusters
    part = entries.filter(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) <= int(min(1.0, want / n) * (1 << 30)))
    sample = np.array([r["v"] for r in part.select("v").collect()], float)
    if not len(sample):
        sample = np.array([entries.first()["v"]], float)
    return Graph.build(bisect_clusters(sample[np.lexsort(sample.T)], clusters))


def _chosen(graph: Graph, most: int, ratio: float, least: int = 1):
    """For batches of rows: each vector's ``least`` nearest centroids, and others within the ratio."""

    def run(batches):
        for pdf in batches:
            for lo in range(0, len(pdf), 512):
                part = pdf.iloc[lo : lo + 512]
                ids, dist = graph.search(np.stack(part["v"].to_numpy()).astype(float), min(most, len(graph.centroids)))
                keep = (dist <= ratio * dist[:, :1] + 1e-12) | (np.arange(dist.shape[1]) < least)
                keep &= np.isfinite(dist)
                row, col = np.nonzero(keep)
                out = part.iloc[row].copy()
                out.insert(0, "cluster", ids[row, col].astype("int64"))
                yield out

    return run


def _nearest(k: int):
    """Cogroup of one list's part and the queries that read it."""

    def run(found: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(found) or not len(asked):
            return pd.DataFrame({n: pd.Series([], dtype=t) for n, t in (("query_id", "int64"), ("score", "float64"), ("ids", object))})
        x = np.stack(found["v"].to_numpy()).astype(float)
        first = np.array([i[0] for i in found["ids"]])
        out = []
        for lo in range(0, len(asked), 256):
            part = asked.iloc[lo : lo + 256]
            q = np.stack(part["v"].to_numpy()).astype(float)
            near = _squares(q, x)
            if len(x) > k + 1:
                bound = np.partition(near, k, axis=1)[:, k]
            else:
                bound = near.max(axis=1)
            slack = 1e-9 * (1 + (q**2).sum(axis=1) + bound)
            for i, query in enumerate(part["query_id"].to_numpy()):
                some = np.flatnonzero(near[i] <= bound[i] + slack[i])
                exact = np.sqrt(((x[some] - q[i]) ** 2).sum(axis=1))
                best = np.lexsort((first[some], exact))[: k + 1]
                out.append(pd.DataFrame({"query_id": query, "score": exact[best], "ids": found["ids"].to_numpy()[some[best]]}))
        return pd.concat(out)

    return run


def search(
    vectors: DataFrame,
    k: int = 10,
    every: int = 100,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    max_clusters: int = MAX_CLUSTERS,
    exact: bool = False,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest other rows of the rows whose id is divisible by ``every``.

    ``exact``: the true ones, for any size of table, at the cost of reading all of it for each query.
    """
    spark = vectors.sparkSession
    rows = cut(valid_vectors(vectors, id_col, vector_col))
    entries = cut(entries_of(rows, k))
    graph = None if exact else build_graph(entries, max_clusters)
    if graph is None and (not exact or entries.isEmpty()):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    one_list = F.lit(0).cast("long").alias("cluster")
    if exact:
        lists = entries.select(one_list, "v", "ids").toDF("cluster", "v", "ids")  # the queries have columns of the same table
    else:
        lists = cut(entries.mapInPandas(_chosen(graph, REPLICAS, REPLICA_RATIO), "cluster long, v array<double>, ids array<long>"))
    sizes = lists.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / LIST_LIMIT).alias("parts"))
    # MAX_CLUSTERS bounds the rows of sizes.
    dealt = lists.join(F.broadcast(sizes), "cluster").withColumn("part", F.pmod(F.xxhash64("v"), F.col("parts")))
    asked = rows.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "v")
    if exact:
        asked = asked.select(one_list, "query_id", "v")
    else:
        asked = asked.mapInPandas(_chosen(graph, PROBES, PROBE_RATIO, LEAST_PROBES), "cluster long, query_id long, v array<double>")
    asked = asked.join(F.broadcast(sizes), "cluster").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    found = (
        dealt.select("cluster", "part", "v", "ids")
        .groupBy("cluster", "part")
        .cogroup(asked.select("cluster", "part", "query_id", "v").groupBy("cluster", "part"))
        .applyInPandas(_nearest(k), "query_id long, score double, ids array<long>")
    )
    each = found.select("query_id", "score", F.explode("ids").alias("vec_id")).filter("vec_id <> query_id")
    each = each.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return each.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)
