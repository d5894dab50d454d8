"""Many paths: all shortest ones with their number, all simple ones, and routing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.operators.relational import Dealt, Steps
from kinweave.operators.traverse import BROADCAST_ROWS, in_reach
from kinweave.plans.lineage import cut, cut_and_count


def _levels(edges: DataFrame, pairs: DataFrame, levels: int, backward: DataFrame | Dealt | None) -> tuple[DataFrame, DataFrame]:
    """``source, node, distance, paths`` of what the sources of the pairs (source, target)
    reach, and ``source, target, distance, paths`` of the pairs.

    A level adds up the numbers of paths to each node's predecessors. A source
    goes on only while a target of it is open; of many pairs, only sources with a
    target in reach set out.
    """
    asked = in_reach(edges, pairs, levels, backward)
    steps = Steps(edges)
    one = F.lit(1).cast("bigint").alias("paths")
    frontier, rows = cut_and_count(asked.select("source", F.col("source").alias("node"), F.lit(0).alias("distance"), one).distinct())
    seen = frontier
    ends = F.col("node").alias("target")
    met = cut(asked.join(frontier.select("source", ends, "distance", "paths"), ["source", "target"]))
    for level in range(1, int(levels) + 1):
        still = asked.join(met, ["source", "target"], "left_anti").select("source").distinct()
        frontier, rows = cut_and_count(frontier.join(still, "source", "left_semi"))
        if not rows:
            break
        reached = steps.join(frontier, rows <= BROADCAST_ROWS)
        found = reached.groupBy("source", F.col("next").alias("node")).agg(F.lit(level).alias("distance"), F.sum("paths").alias("paths"))
        frontier = cut(found.join(seen.select("source", "node"), ["source", "node"], "left_anti"))
        seen = seen.unionByName(frontier)
        met = met.unionByName(cut(asked.join(frontier.select("source", ends, "distance", "paths"), ["source", "target"])))
    return seen, met


def count_shortest_paths(edges: DataFrame, pairs: DataFrame, levels: int, backward: DataFrame | Dealt | None = None) -> DataFrame:
    """``source, target, distance, paths`` of the pairs in reach: how many shortest paths
    each has. A number that doesn't fit a long is an error."""
    return _levels(edges, pairs, levels, backward)[1]


def all_shortest_paths(edges: DataFrame, pairs: DataFrame, levels: int, backward: DataFrame | Dealt | None = None) -> DataFrame:
    """``source, target, distance, path``, a row for each shortest path of each pair in reach.

    The search forward leaves every node's distance from the source; paths are
    then put together from their ends, along edges that lead one level down.
    So no path is begun that doesn't arrive, and a pair costs as many rows as it
    has paths.
    """
    seen, met = _levels(edges, pairs, levels, backward)
    back = Steps(edges if backward is None else backward, backward=True)
    open_, rows = cut_and_count(met.select("source", "target", "distance", F.col("target").alias("node"), F.array("target").alias("path")))
    level = seen.select("source", F.col("node").alias("next"), F.col("distance").alias("at"))
    out, done = None, 0
    while rows:
        whole = open_.filter(F.col("distance") == done).select("source", "target", "distance", "path")
        out = whole if out is None else out.unionByName(whole)
        going, rows = cut_and_count(open_.filter(F.col("distance") > done))
        if rows:
            done += 1
            further = back.join(going, rows <= BROADCAST_ROWS).join(level, ["source", "next"]).filter(F.col("at") == F.col("distance") - F.lit(done))
            open_ = cut(further.select("source", "target", "distance", F.col("next").alias("node"), F.concat(F.array("next"), "path").alias("path")))
    return out if out is not None else open_.select("source", "target", "distance", "path")


def _distances_to(back: Steps, targets: DataFrame, levels: int) -> DataFrame:
    """``target, node, distance, via`` of what reaches each target: ``via`` is the smallest
    of the nodes after it that are one step nearer, null at the target itself.

    Levels are complete, so an entry is final when it is made, and a level only
    looks at what the last one has found.
    """
    kind = back.frame.schema["node"].dataType
    start = targets.select("target", F.col("target").alias("node"), F.lit(0).alias("distance"), F.lit(None).cast(kind).alias("via")).distinct()
    frontier, rows = cut_and_count(start)
    seen = frontier
    for level in range(1, int(levels) + 1):
        if not rows:
            break
        reached = back.join(frontier.select("target", "node"), rows <= BROADCAST_ROWS)
        found = reached.groupBy("target", F.col("next").alias("node")).agg(F.lit(level).alias("distance"), F.min("node").alias("via"))
        frontier, rows = cut_and_count(found.join(seen.select("target", "node"), ["target", "node"], "left_anti"))
        seen = seen.unionByName(frontier)
    return seen


def routing_table(edges: DataFrame, targets: DataFrame, levels: int, backward: DataFrame | Dealt | None = None) -> DataFrame:
    """``here, there, via, len``: of every key within ``levels`` of each target (column
    ``target``) the next hop of a shortest path there and its length."""
    found = _distances_to(Steps(edges if backward is None else backward, backward=True), targets, levels)
    return found.filter("distance > 0").select(F.col("node").alias("here"), F.col("target").alias("there"), "via", F.col("distance").alias("len"))


def follow_routes(routes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``source, target, path`` of the pairs, by walking the routing table hop by hop; pairs without a route have no row."""
    table = routes.select(F.col("here").alias("node"), F.col("there").alias("target"), "via")
    asked = pairs.select("source", "target").distinct()
    going, rows = cut_and_count(asked.filter("source <> target").select("source", "target", F.col("source").alias("node"), F.array("source").alias("path")))
    out = asked.filter("source = target").select("source", "target", F.array("source").alias("path"))
    while rows:
        on = going.join(table, ["target", "node"]).select("source", "target", F.col("via").alias("node"), F.concat("path", F.array("via")).alias("path"))
        on = cut(on)
        out = out.unionByName(on.filter("node = target").select("source", "target", "path"))
        going, rows = cut_and_count(on.filter("node <> target"))
    return out


def simple_paths(edges: DataFrame, pairs: DataFrame, most: int, backward: DataFrame | Dealt | None = None) -> DataFrame:
    """``source, target, path``, a row for each path without a repeated key and with at most
    ``most`` edges. A key has none to itself.

    Of many pairs, those out of reach are left out first. Then come distances to
    the targets; a path goes on only to keys from which
    its target is near enough. The result can be exponential in ``most``.
    """
    asked = in_reach(edges, pairs.filter("source <> target"), most, backward)
    targets = asked.select("target").distinct()
    near = _distances_to(Steps(edges if backward is None else backward, backward=True), targets, most)
    near = cut(near.select("target", F.col("node").alias("next"), F.col("distance").alias("left")))
    reach = near.withColumnRenamed("next", "source").filter(F.col("left") <= most).select("source", "target")
    going, rows = cut_and_count(asked.join(reach, ["source", "target"]).select("source", "target", F.col("source").alias("node"), F.array("source").alias("path")))
    steps, out = Steps(edges), asked.limit(0).withColumn("path", F.array("source"))
    for used in range(1, int(most) + 1):
        if not rows:
            break
        on = steps.join(going, rows <= BROADCAST_ROWS).filter(~F.array_contains("path", F.col("next")))
        on = on.join(near, ["target", "next"]).filter(F.col("left") <= most - used)
        on = cut(on.select("source", "target", F.col("next").alias("node"), F.concat("path", F.array("next")).alias("path")))
        out = out.unionByName(on.filter("node = target").select("source", "target", "path"))
        going, rows = cut_and_count(on.filter("node <> target"))
    return out
