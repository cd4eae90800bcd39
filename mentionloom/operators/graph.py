"""Weighted graphs as edge tables (src, dst, w) and neighbourhoods around seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of every edge; pairs given in both orders add up first."""
    both = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "w")
    return both_ways(both.groupBy("src", "dst").agg(F.sum("w").alias("w")))


def both_ways(one: DataFrame) -> DataFrame:
    """Every edge and its reverse; loops once."""
    # Turned round row by row: a union would count the edges twice.
    there, back = F.struct("src", "dst", "w"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    return one.select(F.explode(F.when(F.col("src") != F.col("dst"), F.array(there, back)).otherwise(F.array(there))).alias("arc")).select("arc.*")


def undirected_max(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, with the larger weight of the two."""
    one = edges.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.max("w").alias("w"))
    return one.unionByName(reverse(one.filter("src <> dst")))


def without_loops(edges: DataFrame) -> DataFrame:
    return edges.filter("src <> dst")


def without_zero(edges: DataFrame) -> DataFrame:
    return edges.filter("w <> 0")


def degrees(edges: DataFrame) -> DataFrame:
    """node, in_degree, out_degree: distinct neighbours on either side."""
    ends = edges.select(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(edges.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    return ends.groupBy("node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()


def neighbours(edges: DataFrame, seeds: DataFrame, out: bool = True) -> DataFrame:
    """Neighbours of seeds (node) with weights: node, neighbour, w."""
    near = edges.select(F.col("src").alias("node"), F.col("dst").alias("neighbour"), "w") if out else edges.select(F.col("dst").alias("node"), F.col("src").alias("neighbour"), "w")
    return near.join(seeds.select("node").distinct(), "node", "left_semi")


def neighbour_lists(edges: DataFrame, degree: DataFrame, least: int, chunk: int = 4096, of: DataFrame | None = None) -> DataFrame:
    """Both sides of every arc, packed: node, far, w, kind (arrays; kind 1: far has an in-degree of at least ``least``, 2: the arc leads to node).

    A node has a row for every ``chunk`` neighbours or so, so a hub's list has no bound but its rows do.
    of: the nodes (node) whose lists are wanted; others drop out first.
    """
    into = edges.select(F.col("dst").alias("node"), F.col("src").alias("far"), F.col("w").cast("double").alias("w"), F.lit(2).alias("side"))
    out = edges.select(F.col("src").alias("node"), F.col("dst").alias("far"), F.col("w").cast("double").alias("w"), F.lit(0).alias("side"))
    both = into.unionByName(out) if of is None else into.unionByName(out).join(of, "node", "left_semi")
    large = degree.filter(F.col("in_degree") >= least).select(F.col("node").alias("far"), F.lit(1).alias("large"))
    size = both.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / chunk).alias("parts"))
    kind = (F.col("side") + F.coalesce("large", F.lit(0))).cast("tinyint").alias("kind")
    rows = both.join(large, "far", "left").join(size, "node").select("node", F.pmod(F.xxhash64("far", "side"), "parts").alias("part"), F.struct("far", "w", kind).alias("near"))
    packed = rows.groupBy("node", "part").agg(F.collect_list("near").alias("near"))
    return packed.select("node", "near.far", "near.w", "near.kind")


def adjacency_sets(edges: DataFrame) -> DataFrame:
    """node and its sorted distinct neighbours."""
    return edges.groupBy(F.col("src").alias("node")).agg(F.sort_array(F.collect_set("dst")).alias("neighbours"))


def graph_size(edges: DataFrame) -> DataFrame:
    """One row: num_nodes, num_arcs."""
    return nodes(edges).agg(F.count(F.lit(1)).alias("num_nodes")).crossJoin(edges.agg(F.count(F.lit(1)).alias("num_arcs")))  # one row each


def _hop(edges: DataFrame, degree: DataFrame, frontier: DataFrame, first: DataFrame, keys: list[str], out: bool, least: int) -> DataFrame:
    """Neighbours with in-degree of at least ``least``; a first seed with none gets all of its neighbours."""
    near, far = ("src", "dst") if out else ("dst", "src")
    step = frontier.join(edges.select(F.col(near).alias("node"), F.col(far).alias("next")), "node")
    large = degree.filter(F.col("in_degree") >= least).select(F.col("node").alias("next"))
    kept = step.join(large, "next", "left_semi")
    lonely = first.join(kept.select(*keys, "node").distinct(), [*keys, "node"], "left_anti")
    fallback = step.join(lonely, [*keys, "node"], "left_semi")
    return kept.select(*keys, F.col("next").alias("node")).unionByName(fallback.select(*keys, F.col("next").alias("node"))).distinct()


def expand(edges: DataFrame, seeds: DataFrame, level: int = 1, least: int = 600, directed: bool = False, keys: list[str] | None = None, degree: DataFrame | None = None) -> DataFrame:
    """Seeds and what they reach over ``level`` hops: keys, node.

    A hop follows in-links, and out-links too if the graph is directed.  Neighbours
    below the in-degree limit are left out, unless a seed has no other in that
    direction.  keys names columns (a document, say) that keep expansions apart.
    """
    keys = keys or []
    degree = degrees(edges) if degree is None else degree
    first = seeds.select(*keys, "node").distinct()
    reached = frontier = first
    for _ in range(level):
        found = _hop(edges, degree, frontier, first, keys, False, least)
        if directed:
            found = found.unionByName(_hop(edges, degree, frontier, first, keys, True, least)).distinct()
        frontier = found.join(reached, [*keys, "node"], "left_anti")
        reached = reached.unionByName(frontier)
    return reached


def subgraph(edges: DataFrame, seeds: DataFrame, reached: DataFrame, directed: bool = False, keys: list[str] | None = None) -> DataFrame:
    """Edges between a seed and a reached node, no loops: keys, src, dst, w.

    Each arc comes once.  In an undirected graph the arcs stand in both directions,
    as they do in ``edges``.
    """
    keys = keys or []
    first, all_ = seeds.select(*keys, "node").distinct(), reached.select(*keys, "node").distinct()
    arcs = without_loops(edges)

    def side(one: str, other: str) -> DataFrame:
        found = arcs.join(first.withColumnRenamed("node", one), one)
        return found.join(all_.withColumnRenamed("node", other), [*keys, other], "left_semi").select(*keys, "src", "dst", "w")

    return side("src", "dst").unionByName(side("dst", "src")).groupBy(*keys, "src", "dst").agg(F.max("w").alias("w"))


def connected_entities(candidates: DataFrame, graph_nodes: DataFrame) -> DataFrame:
    """Candidates that the graph has."""
    return candidates.join(graph_nodes.select(F.col("node").alias("entity")), "entity", "left_semi")
