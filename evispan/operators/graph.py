"""Directed multigraph of assertions (``edge_id, src, predicate, dst``): lookups, bounded walks, ranking of evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def degrees(edges: DataFrame) -> DataFrame:
    """Out- and in-degree of every node; parallel edges count."""
    both = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(edges.select(F.col("dst").alias("node"), F.lit(0), F.lit(1)))
    return both.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def adjacency(edges: DataFrame, direction: str = "both", predicates: tuple[str, ...] = ()) -> DataFrame:
    """``node, edge_id, next``, of the wanted predicates and directions only, filtered before anything else."""
    if direction not in ("outgoing", "incoming", "both"):
        raise ValueError(direction)
    e = edges.where(F.col("predicate").isin(*predicates)) if predicates else edges
    out = e.select(F.col("src").alias("node"), "edge_id", F.col("dst").alias("next"))
    back = e.select(F.col("dst").alias("node"), "edge_id", F.col("src").alias("next"))
    return out if direction == "outgoing" else back if direction == "incoming" else out.unionAll(back).distinct()


def nearest_neighbors(adj: DataFrame, max_neighbors: int, max_edges: int) -> DataFrame:
    """Of each node the first ``max_neighbors`` neighbours by id (itself not counted), of each the first ``max_edges`` edges; the first limit is
    applied before the shuffle, so a hub never meets the paths with all its edges."""
    own = adj.where(F.col("node") != F.col("next")).withColumn("nr", F.dense_rank().over(Window.partitionBy("node").orderBy("next"))).where(F.col("nr") <= max_neighbors)
    return own.withColumn("er", F.row_number().over(Window.partitionBy("node", "next").orderBy("edge_id"))).where(F.col("er") <= max_edges).select("node", "edge_id", "next")


def extend(paths: DataFrame, adj: DataFrame, max_neighbors: int = 16, max_edges: int = 4) -> DataFrame:
    """Paths (``path_id, nodes, edges``) one step on: neighbours not on the path, the first ``max_neighbors`` by id, and of each the
    first ``max_edges`` edges. ``limited`` tells which paths had more neighbours."""
    end = F.element_at("nodes", -1)
    rows = paths.withColumn("node", end).join(adj, "node").where(~F.array_contains("nodes", F.col("next")))
    rows = rows.withColumn("nr", F.dense_rank().over(Window.partitionBy("path_id").orderBy("next"))).withColumn("er", F.row_number().over(Window.partitionBy("path_id", "next").orderBy("edge_id")))
    rows = rows.withColumn("limited", F.max("nr").over(Window.partitionBy("path_id")) > max_neighbors)
    return rows.where((F.col("nr") <= max_neighbors) & (F.col("er") <= max_edges)).select("path_id", F.col("nr").alias("neighbor_rank"), F.col("er").alias("edge_rank"), "limited", F.concat("nodes", F.array("next")).alias("nodes"), F.concat("edges", F.array("edge_id")).alias("edges"))


def walk(seeds: DataFrame, edges: DataFrame, max_hops: int = 2, max_paths: int = 256, max_seeds: int = 16, query: str = "query_id", **caps) -> DataFrame:
    """Breadth-first paths from each query's seeds (``query, node``), at most ``max_paths`` admitted in order: seeds by id, then by
    parent, neighbour and edge. ``query, hops, admitted, nodes, edges``. More than ``max_seeds`` seeds are an error, never cut.

    A level's paths are numbered by a window, so the cap is a filter; at most two hops, so the levels are unrolled.
    """
    if not 0 <= max_hops <= 2 or max_paths < max_seeds:
        raise ValueError("0 to 2 hops, and at least as many paths as seeds")
    adj = adjacency(edges, caps.pop("direction", "both"), caps.pop("predicates", ()))
    # a path's other nodes may be among the first neighbours, so as many more are kept
    adj = nearest_neighbors(adj, caps.get("max_neighbors", 16) + max_hops, caps.get("max_edges", 4))
    w = Window.partitionBy(query)
    level = seeds.distinct().withColumn("n", F.count("*").over(w)).withColumn("order", F.row_number().over(w.orderBy("node")).cast("long"))
    level = level.withColumn("node", F.when(F.col("n") > max_seeds, F.raise_error(F.lit("too many seeds")).cast(seeds.schema["node"].dataType)).otherwise(F.col("node")))
    level = level.select(query, "order", F.array("node").alias("nodes"), F.array().cast(f"array<{edges.schema['edge_id'].dataType.simpleString()}>").alias("edges"))
    out = level.select(query, F.lit(0).alias("hops"), F.col("order").alias("admitted"), "nodes", "edges")
    for hop in range(1, max_hops + 1):
        taken = out.groupBy(query).agg(F.max("admitted").alias("taken"))
        paths = level.withColumn("path_id", F.struct(F.col(query).alias("q"), F.col("order").alias("o")))
        nxt = extend(paths.select("path_id", "nodes", "edges"), adj, **caps)
        nxt = nxt.select(F.col("path_id.q").alias(query), F.col("path_id.o").alias("parent"), "neighbor_rank", "edge_rank", "nodes", "edges").join(taken, query)
        place = F.row_number().over(w.orderBy("parent", "neighbor_rank", "edge_rank")) + F.col("taken")
        level = nxt.withColumn("order", place).where(F.col("order") <= max_paths).select(query, "order", "nodes", "edges")
        out = out.unionAll(level.select(query, F.lit(hop).alias("hops"), F.col("order").alias("admitted"), "nodes", "edges"))
    return out


def rank_evidence(paths: DataFrame, evidence: DataFrame, mentions: DataFrame, k: int = 10, query: str = "query_id") -> DataFrame:
    """Chunks reached: those of every edge (``edge_id, chunk_id``) of a path and the mentions (``node, chunk_id``) of its last node. Ranked by
    number of seeds that reach them, fewest hops, id; the score is ordinal (total less place)."""
    seed = F.element_at("nodes", 1).alias("seed")
    by_edge = paths.select(query, "hops", seed, F.explode("edges").alias("edge_id")).join(evidence, "edge_id")
    by_node = paths.select(query, "hops", seed, F.element_at("nodes", -1).alias("node")).join(mentions, "node")
    found = by_edge.select(query, "hops", "seed", "chunk_id").unionAll(by_node.select(query, "hops", "seed", "chunk_id"))
    found = found.groupBy(query, "chunk_id").agg(F.count_distinct("seed").alias("groups"), F.min("hops").alias("min_hops"))
    w = Window.partitionBy(query)
    ranked = found.withColumn("rank", F.row_number().over(w.orderBy(F.desc("groups"), "min_hops", "chunk_id"))).withColumn("score", (F.count("*").over(w) - F.col("rank") + 1).cast("double"))
    return ranked.where(F.col("rank") <= k)


def valid_paths(paths: DataFrame, edges: DataFrame, direction: str = "outgoing") -> DataFrame:
    """``path_id, valid``: one more node than edges, and every edge joins its two nodes in the wanted direction."""
    steps = paths.select("path_id", F.posexplode("edges").alias("i", "edge_id"), "nodes").withColumn("a", F.element_at("nodes", F.col("i") + 1)).withColumn("b", F.try_element_at("nodes", F.col("i") + 2))
    on = (F.col("a") == F.col("src")) & (F.col("b") == F.col("dst"))
    back = (F.col("b") == F.col("src")) & (F.col("a") == F.col("dst"))
    ok = {"outgoing": on, "incoming": back, "both": on | back}[direction]
    checked = steps.join(edges, "edge_id", "left").groupBy("path_id").agg(F.bool_and(F.coalesce(ok, F.lit(False))).alias("ok"))
    return paths.join(checked, "path_id", "left").select("path_id", ((F.size("nodes") == F.size("edges") + 1) & F.coalesce("ok", F.lit(True))).alias("valid"))
