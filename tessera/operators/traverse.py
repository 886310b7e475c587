"""Traversals: one join a hop, each hop's frontier written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.policy import DIAGNOSTIC, TESTS, TraversalPolicy
from tessera.runtime import materialize
from tessera.schemas import CLOSURE_TYPES, IMPACT_TYPES

#: A closure that is longer than this is an error rather than cut short.
MOST_HOPS = 64


def followed(edges: DataFrame, types: tuple[str, ...] | None = IMPACT_TYPES, policy: TraversalPolicy = DIAGNOSTIC) -> DataFrame:
    """(src, dst) that a traversal may use, not distinct: every hop reduces what it reaches anyway, and to do so here would shuffle all edges."""
    kept = edges.filter(policy.allows())
    if types is not None:
        kept = kept.filter(F.col("type").isin(*types))
    return kept.select("src", "dst")


def inbound(links: DataFrame, seeds: DataFrame, max_depth: int | None = 3) -> DataFrame:
    """(node, depth): everything that reaches a seed over links (src, dst) in at most max_depth hops; seeds are at 0.

    seeds has a column node. Without max_depth the closure is complete. A node's
    depth is its least. Null seeds and null ends of links are passed over.
    """
    links = materialize(links.dropna(subset=["src", "dst"]), "links")
    frontier = materialize(seeds.select("node").dropna().distinct().withColumn("depth", F.lit(0)), "frontier")
    visited = frontier
    limit = max_depth if max_depth is not None else MOST_HOPS
    for depth in range(1, limit + 1):
        step = links.join(frontier.select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node")).distinct()
        step = step.join(visited.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth))
        if depth == max_depth:
            return visited.unionByName(step)  # the last and largest hop need not be written
        frontier = materialize(step, "frontier")
        if frontier.isEmpty():
            return visited
        visited = visited.unionByName(frontier)
    if max_depth is None and not links.join(frontier.select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node")).join(visited, "node", "left_anti").isEmpty():
        raise RuntimeError(f"closure not complete after {MOST_HOPS} hops")
    return visited


def inbound_each(links: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """(seed, node, depth) for every seed by itself, all in the same joins."""
    links = materialize(links.dropna(subset=["src", "dst"]), "links")
    frontier = materialize(seeds.select(F.col("node").alias("seed"), "node").dropna().distinct().withColumn("depth", F.lit(0)), "frontier")
    visited = frontier
    for depth in range(1, max_depth + 1):
        step = links.join(frontier.select("seed", F.col("node").alias("dst")), "dst").select("seed", F.col("src").alias("node")).distinct()
        step = step.join(visited.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("depth", F.lit(depth))
        if depth == max_depth:
            return visited.unionByName(step)
        frontier = materialize(step, "frontier")
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return visited


def reach_counts(links: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """(seed, depth, nodes): how many nodes inbound_each finds for each seed at each depth, which are not listed for it.

    The seeds are numbered and a node holds those that reach it in an array: what is shuffled is a row for each link and not for each
    pair of seed and node, and pairs are counted in the task that has the node.
    """
    links = materialize(links.dropna(subset=["src", "dst"]), "links")
    numbered = materialize(seeds.select("node").dropna().distinct().withColumn("k", F.row_number().over(Window.orderBy("node"))), "seeds")
    frontier = known = numbered.select("node", F.array("k").alias("ks"))
    counts = numbered.select("k", F.lit(0).alias("depth"), F.lit(1).cast("long").alias("nodes"))
    none = F.lit(None).cast("array<int>")
    for depth in range(1, max_depth + 1):
        came = links.join(frontier.withColumnRenamed("node", "dst"), "dst").select(F.col("src").alias("node"), "ks", none.alias("had"))
        met = came.unionByName(known.select("node", none.alias("ks"), F.col("ks").alias("had"))).groupBy("node").agg(F.flatten(F.collect_list("ks")).alias("ks"), F.flatten(F.collect_list("had")).alias("had"))
        step = met.select("node", F.array_except("ks", "had").alias("ks")).filter(F.size("ks") > 0)  # of what is excepted each value stays once
        if depth < max_depth:
            step = frontier = materialize(step, "frontier")
            known = known.unionByName(frontier)
        counts = counts.unionByName(step.select(F.explode("ks").alias("k")).groupBy("k").agg(F.count("*").alias("nodes")).select("k", F.lit(depth).alias("depth"), "nodes"))
    return counts.join(numbered.withColumnRenamed("node", "seed"), "k").select("seed", "depth", "nodes")


def best_product(edges: DataFrame, seeds: DataFrame, floor: float, max_depth: int) -> DataFrame:
    """(seed, node, product): the greatest product of confidences on a path of at most max_depth hops to the seed, not below floor.

    A node's seeds with their products are an array: a hop shuffles a row for each link, and pairs of seed and node are reduced in the task that has the node.
    """
    links = materialize(edges.dropna(subset=["src", "dst", "confidence"]).select("src", "dst", "confidence"), "links")
    best = frontier = materialize(seeds.select(F.col("node").alias("seed"), "node").dropna().distinct().select("node", F.array(F.struct("seed", F.lit(1.0).alias("product"))).alias("at")), "best")
    for depth in range(1, max_depth + 1):
        tops = frontier.select(F.col("node").alias("dst"), "at", F.array_max(F.col("at.product")).alias("top"))
        # with a floor above 0 all products are positive, and where the greatest falls under it all do
        met = links.join(tops, "dst").filter(F.col("top") * F.col("confidence") >= floor if floor > 0 else F.lit(True))
        kept = F.filter(F.transform("at", lambda x: F.struct(x["seed"].alias("seed"), (x["product"] * F.col("confidence")).alias("product"))), lambda x: x["product"] >= floor)
        came = met.select(F.col("src").alias("node"), kept.alias("at"), F.lit(True).alias("new"))
        both = came.unionByName(best.select("node", "at", F.lit(False).alias("new"))).repartition("node").select("node", "new", F.explode("at").alias("x")).select("node", "new", "x.*")
        if depth == max_depth:
            return both.groupBy("node", "seed").agg(F.max("product").alias("product")).select("seed", "node", "product")
        reached = both.groupBy("node", "seed").agg(F.max(F.when(F.col("new"), F.col("product"))).alias("product"), F.max(F.when(~F.col("new"), F.col("product"))).alias("known"))
        better = F.when(F.col("known").isNull() | (F.col("product") > F.col("known")), F.struct("seed", "product"))
        step = materialize(reached.groupBy("node").agg(F.collect_list(better).alias("frontier"), F.collect_list(F.struct("seed", F.greatest("product", "known").alias("product"))).alias("at")), "best")
        frontier, best = step.filter(F.size("frontier") > 0).select("node", F.col("frontier").alias("at")), step.select("node", "at")
        if frontier.isEmpty():
            break
    return best.select("node", F.explode("at").alias("x")).select("x.seed", "node", "x.product")


def seeds_of(symbols: DataFrame, query: str) -> DataFrame:
    """(node): symbols whose name, qualified name, id or file is the query, without case; if none, those whose name or qualified name contains it or whose file ends with it.

    The query is trimmed; an empty one matches nothing.
    """
    q = query.strip().lower()
    low = {c: F.lower(c) for c in ("name", "qualified_name", "id", "file_path")}
    exact = (low["name"] == q) | (low["qualified_name"] == q) | (low["id"] == q) | (low["file_path"] == q)
    loose = low["name"].contains(q) | low["qualified_name"].contains(q) | low["file_path"].endswith(q)
    tier = F.when(exact, 0).when(loose, 1)
    ranked = symbols.select(F.col("id").alias("node"), tier.alias("tier")).filter("tier IS NOT NULL")
    if not q:
        return ranked.limit(0).select("node")
    best = ranked.agg(F.min("tier").alias("tier"))
    return ranked.join(F.broadcast(best), "tier").select("node")  # a single row is broadcast


def impact(symbols: DataFrame, edges: DataFrame, query: str, max_depth: int = 3, policy: TraversalPolicy = DIAGNOSTIC) -> DataFrame:
    """The symbols within max_depth (3 where not positive) inbound hops of the query's, with depth, without those themselves."""
    reached = inbound(followed(edges, IMPACT_TYPES, policy), seeds_of(symbols, query), max_depth if max_depth > 0 else 3)
    return symbols.join(reached.filter("depth > 0").withColumnRenamed("node", "id"), "id").orderBy("file_path", "span.start", "id")


def tests_for(symbols: DataFrame, edges: DataFrame, query: str, is_test, policy: TraversalPolicy = TESTS) -> DataFrame:
    """Test symbols that cover the query's symbols.

    Sources of ``tests`` edges into the unbounded inbound closure over CLOSURE_TYPES under the policy; the policy
    does not hold for the ``tests`` edges. Where there are none, test symbols whose path, name or signature
    contains the query; all of them for an empty query.
    """
    q = query.strip().lower()
    if q:
        low = {c: F.lower(c) for c in ("name", "qualified_name", "id", "file_path")}
        exact = (low["name"] == q) | (low["qualified_name"] == q) | (low["id"] == q) | (low["file_path"] == q)
        covered = covering(edges, symbols.filter(exact).select(F.col("id").alias("node")), policy)
        found = symbols.join(covered.withColumnRenamed("node", "id"), "id", "left_semi")
        if not found.isEmpty():
            return found.orderBy("file_path", "span.start", "id")
    text = F.lower(F.concat_ws(" ", "file_path", "name", "qualified_name", "signature"))
    return symbols.filter(is_test).filter(text.contains(q)).orderBy("file_path", "span.start", "id")


def covering(edges: DataFrame, seeds: DataFrame, policy: TraversalPolicy = TESTS, max_depth: int | None = None) -> DataFrame:
    """(node): sources of tests edges into the closure of seeds."""
    reached = inbound(followed(edges, CLOSURE_TYPES, policy), seeds, max_depth)
    return edges.filter("type = 'tests'").join(reached.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node")).distinct()


def skipped_in_closure(edges: DataFrame, seeds: DataFrame, policy: TraversalPolicy = TESTS) -> DataFrame:
    """(reason, skipped): edges into the closure that the policy turned away."""
    reached = inbound(followed(edges, CLOSURE_TYPES, policy), seeds, None)
    return policy.skipped(edges.filter(F.col("type").isin(*CLOSURE_TYPES)).join(reached.select(F.col("node").alias("dst")), "dst", "left_semi"))
