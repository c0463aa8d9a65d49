"""Graph operators over edge tables: bounded search, closures, chains, cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .recovery import cut, scratch_dir


#: A frontier up to so many nodes is sent to all tasks; larger ones are joined by a shuffle.
SMALL_FRONTIER = 100_000


def stored_steps(edges: DataFrame, direction: str = "both") -> DataFrame:
    """``edge, a, b`` of a search's steps from a to b, written once to the shared folder and read from there."""
    forward = F.struct(F.col("src").alias("a"), F.col("dst").alias("b"))
    backward = F.struct(F.col("dst").alias("a"), F.col("src").alias("b"))
    ways = {"forward": [forward], "backward": [backward], "both": [forward, backward]}[direction]
    folder = scratch_dir(edges.sparkSession, "steps")
    # Dealt by edge, every file has its share, whatever the edges were read from and however many one node has.
    dealt = edges.select("edge", "src", "dst").repartition("edge")
    dealt.select("edge", F.explode(F.array(*ways)).alias("s")).select("edge", "s.a", "s.b").write.parquet(folder)
    return edges.sparkSession.read.parquet(folder)


def bounded_search(
    edges: DataFrame,
    seeds: DataFrame,
    hops: int,
    max_nodes: int = 10_000,
    max_edges: int = 10_000,
    direction: str = "both",
    steps: DataFrame | None = None,
) -> tuple[DataFrame, bool]:
    """Nodes within ``hops`` of the seeds: ``node, hop, via, parent``, and whether a budget cut it short.

    ``edges``: ``edge, src, dst``; ``seeds``: ``node``; ``steps``: what ``stored_steps``
    gave for them, to be used by several searches. Per level nodes are taken in
    the order of edge ids, and the first path to a node stays. Levels are written and
    read; their sizes decide how the next join is done. In both directions what lies
    behind the last two levels has no way to the next one, so only these are left out of it.
    """
    spark = edges.sparkSession
    steps = stored_steps(edges, direction) if steps is None else steps
    none = F.lit(None)
    kind = dict(edges.dtypes)
    folder = scratch_dir(spark, "levels")

    def stored(rows: DataFrame, name: str) -> tuple[DataFrame, int]:
        rows.write.parquet(f"{folder}/{name}")
        rows = spark.read.parquet(f"{folder}/{name}")
        return rows, rows.count()

    start = seeds.select("node").distinct()
    if start.count() > max_nodes:
        start = start.orderBy("node").limit(max_nodes)
    first = start.select("node", F.lit(0).alias("hop"), none.cast(kind["edge"]).alias("via"), none.cast(kind["src"]).alias("parent"))
    level, n = stored(first, "0")
    levels, sizes = [level], [n]
    nodes_left, edges_left = max_nodes - n, max_edges
    truncated = False
    sent = lambda rows, n: F.broadcast(rows) if n <= SMALL_FRONTIER else rows
    for hop in range(1, hops + 1):
        before = levels[-2:] if direction == "both" else levels
        known, n_known = before[0], sum(sizes[-len(before) :])
        for x in before[1:]:
            known = known.unionByName(x)
        frontier = levels[-1].select(F.col("node").alias("a"))
        found = (
            steps.join(sent(frontier, sizes[-1]), "a", "left_semi")
            .join(sent(known.select(F.col("node").alias("b")), n_known), "b", "left_anti")
            .groupBy("b")
            .agg(F.min(F.struct("edge", "a")).alias("first"))
            .select(F.col("b").alias("node"), F.lit(hop).alias("hop"), F.col("first.edge").alias("via"), F.col("first.a").alias("parent"))
        )
        room = max(0, min(nodes_left, edges_left))
        found, n = stored(found, str(hop))
        if n > room:
            truncated = True
            found, n = stored(found.orderBy("via", "node").limit(room), f"{hop}-cut")
        if not n:
            break
        levels.append(found)
        sizes.append(n)
        nodes_left, edges_left = nodes_left - n, edges_left - n
    seen = levels[0]
    for x in levels[1:]:
        seen = seen.unionByName(x)
    return seen, truncated


def closure(edges: DataFrame, child: str, parent: str, most: int = 100) -> DataFrame:
    """``child, parent, depth``: all ancestors with the least depth, by doubling path lengths."""
    paths = edges.select(F.col(child).alias("child"), F.col(parent).alias("parent"), F.lit(1).alias("depth")).distinct()
    paths = cut(paths)
    size = paths.count()
    for _ in range(most):
        left = paths.select("child", F.col("parent").alias("mid"), F.col("depth").alias("d1"))
        right = paths.select(F.col("child").alias("mid"), "parent", F.col("depth").alias("d2"))
        longer = left.join(right, "mid").select("child", "parent", (F.col("d1") + F.col("d2")).alias("depth"))
        new = cut(paths.unionByName(longer).groupBy("child", "parent").agg(F.min("depth").alias("depth")))
        now = new.count()
        paths = new
        if now == size:
            return paths
        size = now
    raise ValueError(f"not settled after {most} rounds")


def on_cycles(closed: DataFrame) -> DataFrame:
    """Nodes that are their own ancestor."""
    return closed.filter("child = parent").select(F.col("child").alias("node")).distinct()


def chain_ends(links: DataFrame) -> DataFrame:
    """``node, target, steps, issue``: the end of each replacement chain by pointer jumping.

    ``target`` is null where ``issue`` says cycle (the chain runs into one) or
    ambiguous (a node on it has several successors). A chain of n nodes is at its
    end after log2(n) rounds; what still moves then is on its way round a cycle.
    """
    unique = links.groupBy("src").agg(F.count_distinct("dst").alias("n"), F.min("dst").alias("dst"))
    state = cut(
        unique.select(
            F.col("src").alias("node"), F.when(F.col("n") == 1, F.col("dst")).alias("target"), F.lit(1).cast("long").alias("steps"),
            F.when(F.col("n") > 1, "ambiguous").alias("issue"),
        )
    )
    for _ in range(state.count().bit_length() + 1):
        after = state.select(F.col("node").alias("target"), F.col("target").alias("t2"), F.col("steps").alias("s2"), F.col("issue").alias("i2"), F.lit(True).alias("more"))
        moved = state.join(after, "target", "left")
        state = cut(
            moved.select(
                "node",
                F.when(F.col("more"), F.col("t2")).otherwise(F.col("target")).alias("target"),
                F.when(F.col("more"), F.col("steps") + F.col("s2")).otherwise(F.col("steps")).alias("steps"),
                F.coalesce("issue", "i2").alias("issue"),
            )
        )
    moving = state.join(state.select(F.col("node").alias("target"), F.lit(True).alias("more")), "target", "left")
    cyclic = F.col("issue").isNull() & F.coalesce("more", F.lit(False))
    return moving.select(
        "node",
        F.when(~cyclic, F.col("target")).alias("target"),
        F.when(~cyclic & F.col("issue").isNull(), F.col("steps")).alias("steps"),
        F.when(cyclic, "cycle").otherwise(F.col("issue")).alias("issue"),
    )


def around(edges: DataFrame, seeds: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """Edges with an end in ``seeds`` (``id``), both ends of which are in ``allowed``."""
    if allowed is not None:
        for end in ("src", "dst"):
            edges = edges.join(allowed.select(F.col("id").alias(end)).distinct(), end, "left_semi")
    ids = seeds.select("id").distinct().withColumn("hit", F.lit(True))
    for end in ("src", "dst"):
        edges = edges.join(ids.withColumnsRenamed({"id": end, "hit": f"{end}_hit"}), end, "left")
    return edges.filter("src_hit or dst_hit").select("edge", "src", "dst").distinct()


def neighbourhood(
    edges: DataFrame, seeds: DataFrame, hops: int, max_nodes: int = 500, max_edges: int = 1000, direction: str = "both"
) -> tuple[DataFrame, DataFrame, bool]:
    """Nodes as of ``bounded_search``, all edges between them in the order of their ids, and whether a budget cut either short.

    Edges that led to a node come first, so that what is cut off are edges beside the tree.
    """
    nodes, truncated = bounded_search(edges, seeds, hops, max_nodes, max_edges, direction)
    found = edges.select("edge", "src", "dst")
    for end in ("src", "dst"):
        found = found.join(nodes.select(F.col("node").alias(end)).distinct(), end, "left_semi")
    tree = nodes.filter("via is not null").select(F.col("via").alias("edge"), F.lit(0).alias("place"))
    found = cut(found.join(tree, "edge", "left").select("edge", "src", "dst", F.coalesce("place", F.lit(1)).alias("place")))
    if found.count() > max_edges:
        found, truncated = found.orderBy("place", "edge").limit(max_edges), True
    return nodes, found.drop("place"), truncated
