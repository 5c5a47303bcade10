"""Connected components of an edge table, for the operators that group rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_PARTS, discard, join_groups, split_join, written


def connected_components(edges: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(node, component) for every node of ``edges`` (src, dst); component is its smallest node.

    Smallest labels spread along edges and labels then jump to their label's
    label, so long chains halve at every round.  Minima are combined before the
    shuffle, each round is written to the shared folder, and only one count per
    round reaches the driver.  ``labels`` carries on from earlier components.
    Rows with a null end are no edges; self-loops only name their node.
    """
    both = edges.where("src IS NOT NULL AND dst IS NOT NULL")
    both = written(both.select("src", "dst").unionByName(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "cc-edges")
    now = both.groupBy(F.col("src").alias("node")).agg(F.min(F.least("src", "dst")).alias("component"))
    if labels is not None:
        now = now.unionByName(labels).groupBy("node").agg(F.min("component").alias("component"))
    now = written(now, "cc-labels")
    floor = max(both.count() // HOT_PARTS, now.count() // HOT_PARTS, 1000)
    # the at most HOT_PARTS nodes of so many edges and, in each round, labels of so many nodes meet their rows by broadcast
    hubs = written(both.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > floor).select("node"), "cc-hubs")
    while not now.isEmpty():
        few = F.broadcast(now.join(F.broadcast(hubs), "node", "left_semi"))
        seen = split_join(both, "src", F.broadcast(hubs.withColumnRenamed("node", "src")), now.withColumnRenamed("node", "src"), few.withColumnRenamed("node", "src"), "inner")
        seen = seen.groupBy(F.col("dst").alias("node")).agg(F.min("component").alias("near"))
        # a label's holder hears of what its own members have heard
        up = now.join(seen, "node").where("near < component").groupBy(F.col("component").alias("node")).agg(F.min("near").alias("near"))
        heard = seen.unionByName(up).groupBy("node").agg(F.min("near").alias("near"))
        spread = now.join(heard, "node", "left").select("node", F.least("component", "near").alias("step"), F.col("component").alias("was"))
        spread = written(spread, "cc-spread")
        roots = spread.select(F.col("node").alias("step"), F.col("step").alias("jump"))
        held = F.broadcast(spread.groupBy("step").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > floor).select("step"))
        new = split_join(spread, "step", held, roots, F.broadcast(roots.join(held, "step", "left_semi")), "left")
        new = written(new.select("node", F.least("step", "jump").alias("component"), "was"), "cc-labels")
        done = new.where("component <> was").isEmpty()
        discard(spread, now)
        now = new.select("node", "component")
        now._tessera_scratch = new._tessera_scratch
        if done:
            break
    discard(both, hubs)
    return now


def merged(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Components once ``edges`` are added: only the graph of old components is searched."""
    of = lambda end: labels.select(F.col("node").alias(end), F.col("component").alias(f"{end}_was"))
    between = edges.join(of("src"), "src", "left").join(of("dst"), "dst", "left")
    between = written(between.select("src", "dst", F.coalesce("src_was", "src").alias("a"), F.coalesce("dst_was", "dst").alias("b")), "cc-between")
    joined = connected_components(between.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    nodes = between.select(F.col("src").alias("node"), F.col("a").alias("component")).unionByName(between.select(F.col("dst").alias("node"), F.col("b").alias("component")))
    nodes = nodes.unionByName(labels).distinct()
    nodes = written(nodes, "cc-nodes")
    held = nodes.groupBy("component").agg(F.count(F.lit(1)).alias("members"))
    new = written(held.join(joined.select(F.col("node").alias("component"), F.col("component").alias("into")), "component"), "cc-into")
    out = written(join_groups(nodes, new, "component", "members", "left").select("node", F.coalesce("into", "component").alias("component")), "cc-labels")
    discard(between, nodes, new)
    return out
