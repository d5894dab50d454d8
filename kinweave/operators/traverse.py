"""Level-by-level traversal: the one loop that every graph search uses.

A level is one distributed step: expand the frontier along the edges, reduce
per (source, node), drop what was seen. Its plan is cut each level. A frontier
is broadcast only if its counted rows are below BROADCAST_ROWS; a larger one is
joined by a shuffle, the edges of hot nodes spread over salts, in as many
partitions as the rows that come of it need.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.operators.relational import DST, SRC, Dealt, Steps
from kinweave.plans.lineage import cut, cut_and_count, partitions_for

BROADCAST_ROWS = 20_000


def reachable_levels(max_depth: float) -> int:
    """How far a two-ended search of this depth reaches: each end goes half the
    depth, rounded down, and a direct edge is always found."""
    return max(1, 2 * math.floor(max_depth / 2))


def _rows_ahead(steps: Steps, frontier: DataFrame, rows: int) -> int:
    """The rows of the next level before they are reduced; a frontier that is broadcast isn't counted."""
    return 0 if rows <= BROADCAST_ROWS else steps.rows_of(frontier)


def breadth_first(
    edges: DataFrame,
    seeds: DataFrame,
    levels: int,
    with_path: bool = False,
) -> DataFrame:
    """``source, node, distance[, path]`` of all nodes within ``levels`` of each source.

    ``seeds`` has ``source``. ``path`` is the smallest of the shortest paths,
    compared key by key. The loop ends early at an empty level.
    """
    steps = Steps(edges)
    start = seeds.select("source", F.col("source").alias("node"), F.lit(0).alias("distance")).distinct()
    if with_path:
        start = start.withColumn("path", F.array("node"))
    frontier, rows = cut_and_count(start)
    seen, seen_rows = frontier, rows
    for level in range(1, int(levels) + 1):
        known = seen.select("source", "node")
        best = [F.min(F.concat("path", F.array("next"))).alias("path")] if with_path else []
        with partitions_for(edges.sparkSession, seen_rows + _rows_ahead(steps, frontier, rows)) as wider:
            reached = steps.join(frontier, rows <= BROADCAST_ROWS, wider)
            found = reached.groupBy("source", F.col("next").alias("node")).agg(F.lit(level).alias("distance"), *best)
            frontier, rows = cut_and_count(found.join(known, ["source", "node"], "left_anti"))
        if not rows:
            break
        seen, seen_rows = seen.unionByName(frontier), seen_rows + rows
    return seen


def single(edges: DataFrame, source, levels: int, **more) -> DataFrame:
    kind = edges.schema[SRC].dataType.simpleString()
    seeds = edges.sparkSession.range(1).select(F.lit(source).cast(kind).alias("source"))
    return breadth_first(edges, seeds, levels, **more)


class _Side:
    """One end of a two-sided search: the frontiers of its origins, what they have seen, and how far they are.

    A backward side walks the edges from their ends; its paths lead from a node to the origin.
    """

    def __init__(self, edges: DataFrame | Dealt, origins: DataFrame, backward: bool, with_path: bool):
        self.steps = Steps(edges, backward)
        self.backward, self.with_path, self.level = backward, with_path, 0
        start = origins.select("origin", F.col("origin").alias("node")).distinct()
        if with_path:
            start = start.withColumn("path", F.array("node"))
        self.frontier, self.rows = cut_and_count(start)
        self.seen, self.seen_rows = self.frontier.select("origin", "node"), self.rows

    def expand(self) -> None:
        with partitions_for(self.seen.sparkSession, self.seen_rows + _rows_ahead(self.steps, self.frontier, self.rows)) as wider:
            reached = self.steps.join(self.frontier, self.rows <= BROADCAST_ROWS, wider)
            if self.with_path:
                one = F.array("next")
                best = F.min(F.concat(one, "path") if self.backward else F.concat("path", one)).alias("path")
                found = reached.groupBy("origin", F.col("next").alias("node")).agg(best)
            else:
                found = reached.select("origin", F.col("next").alias("node")).distinct()
            self.frontier, self.rows = cut_and_count(found.join(self.seen, ["origin", "node"], "left_anti"))
        self.seen, self.seen_rows = self.seen.unionByName(self.frontier.select("origin", "node")), self.seen_rows + self.rows
        self.level += 1

    def keep(self, origins: DataFrame) -> None:
        """Goes on with some origins only."""
        self.frontier, self.rows = cut_and_count(self.frontier.join(origins.distinct(), "origin", "left_semi"))


def _cheaper_end(pairs: DataFrame, there: DataFrame, here: DataFrame) -> str:
    """The end, source or target, at which fewer rows come of putting its edge beside the ``pairs``."""

    def rows(edge: DataFrame, end: str) -> int:
        asked, nodes = pairs.groupBy(end).agg(F.count(F.lit(1)).alias("pairs")), edge.groupBy(end).agg(F.count(F.lit(1)).alias("nodes"))
        return nodes.join(asked, end).agg(F.sum(F.col("nodes") * F.col("pairs"))).first()[0] or 0

    return "source" if rows(there, "source") <= rows(here, "target") else "target"


def _meeting(pairs: DataFrame, there: DataFrame, here: DataFrame) -> DataFrame:
    """The ``pairs`` beside each node that both the edge of their source and that of their target hold.

    Pairs are first put beside one of the edges. A pair then has as many rows as
    its origin has nodes there, so a source with very many targets multiplies
    its whole edge; the end that makes fewer rows, by count, comes first.
    """
    if _cheaper_end(pairs, there, here) == "source":
        return pairs.join(there, "source").join(here, ["target", "node"])
    return pairs.join(here, "target").join(there, ["source", "node"])


def shortest_pairs(edges: DataFrame, pairs: DataFrame, max_depth: float, with_path: bool = False, backward: DataFrame | Dealt | None = None) -> DataFrame:
    """``source, target, distance[, path]`` of the ``pairs`` (source, target) in reach; others have no row.

    Both ends of all pairs are searched, each time the side with fewer nodes at
    its edge: two searches of half the depth see far fewer nodes than one of the
    whole. Levels are complete, so the first nodes that both edges of a pair
    hold lie on its shortest paths. Of several, the smallest path is returned:
    all meeting nodes are equally far from the source, so their smallest halves
    make it. Origins without an open pair are left out of later levels.

    ``backward`` is a copy of the edges that is dealt out by their ends. Of many
    pairs, those in reach are found first, and only these carry paths along.
    """
    asked, n = cut_and_count(pairs.select("source", "target").distinct())
    if with_path and n > BROADCAST_ROWS:
        asked = cut(shortest_pairs(edges, asked, max_depth, backward=backward).select("source", "target"))
    path = lambda c: [F.array(c).alias("path")] if with_path else []
    out = asked.filter("source = target").select("source", "target", F.lit(0).alias("distance"), *path("source"))
    open_ = asked.filter("source <> target")
    ahead = _Side(edges, open_.select(F.col("source").alias("origin")), False, with_path)
    back = _Side(edges if backward is None else backward, open_.select(F.col("target").alias("origin")), True, with_path)
    while ahead.rows and back.rows and ahead.level + back.level < reachable_levels(max_depth):
        side = ahead if ahead.rows <= back.rows else back
        side.expand()
        if not side.rows:
            break
        there = ahead.frontier.withColumnRenamed("origin", "source")
        here = back.frontier.withColumnsRenamed({"origin": "target", "path": "rest"})
        met = _meeting(open_, there, here)
        distance = F.lit(ahead.level + back.level).alias("distance")
        whole = [F.min(F.concat("path", F.slice("rest", F.lit(2), F.size("rest")))).alias("path")] if with_path else []
        met, n = cut_and_count(met.groupBy("source", "target").agg(F.any_value(distance).alias("distance"), *whole))
        if n:
            out = out.unionByName(met)
            open_, left = cut_and_count(open_.join(met, ["source", "target"], "left_anti"))
            if not left:
                break
            ahead.keep(open_.select(F.col("source").alias("origin")))
            back.keep(open_.select(F.col("target").alias("origin")))
    return out


def in_reach(edges: DataFrame, pairs: DataFrame, levels: int, backward: DataFrame | Dealt | None = None) -> DataFrame:
    """Of many ``pairs``, those with a path of at most ``levels`` edges; few are all returned.

    A two-sided search is far cheaper than what is then done for each pair in
    reach. It ends at even depths, so it goes one further if ``levels`` is odd.
    """
    asked, n = cut_and_count(pairs.select("source", "target").distinct())
    if n <= BROADCAST_ROWS:
        return asked
    levels = int(levels)
    near = shortest_pairs(edges, asked, levels + levels % 2, backward=backward)
    return cut(near.filter(F.col("distance") <= levels).select("source", "target"))


def shortest(edges: DataFrame, source, target, max_depth: float, with_path: bool = False, backward: DataFrame | Dealt | None = None) -> dict | None:
    """``{"distance": d, "path": [...]}`` of one pair (no path unless asked for), or None if out of reach."""
    if source == target:
        return {"distance": 0, "path": [source]} if with_path else {"distance": 0}
    kind = edges.schema[SRC].dataType
    pair = edges.sparkSession.range(1).select(F.lit(source).cast(kind).alias("source"), F.lit(target).cast(kind).alias("target"))
    row = shortest_pairs(edges, pair, max_depth, with_path, backward).first()
    if row is None:
        return None
    return {"distance": row["distance"]} | ({"path": list(row["path"])} if with_path else {})


def within(edges: DataFrame, sources: DataFrame, k: int) -> DataFrame:
    """``source, node, distance`` of nodes 1..k hops away; no rows if k < 1."""
    return breadth_first(edges, sources, k).filter("distance > 0")


def distances_to(edges: DataFrame, source, targets: DataFrame, max_depth: float) -> DataFrame:
    """``target, distance`` for a table of targets by one search; null if not reached."""
    reach = single(edges, source, reachable_levels(max_depth)).select(F.col("node").alias("target"), "distance")
    return targets.join(reach, "target", "left")


def relax(edges: DataFrame, distances: DataFrame, changed: DataFrame, max_depth: int) -> DataFrame:
    """Distances after edges of the ``changed`` keys came in.

    Only inserts and lowers: a distance that lost its last shortest path stays
    (``refresh`` sees to these). At most ``max_depth + 2`` rounds, each along the
    keys the last one updated. Rounds write what they change; the whole table is
    put together once.
    """
    frontier = changed.select("pubkey").distinct().join(distances, "pubkey")
    return _spread(edges, distances, frontier, distances.limit(0), max_depth)


def _spread(edges: DataFrame, distances: DataFrame, frontier: DataFrame, updates: DataFrame, max_depth: int) -> DataFrame:
    """``distances`` with ``updates`` and all that follows from the distances of the ``frontier``'s keys."""
    steps = Steps(edges)
    frontier, rows = cut_and_count(frontier)
    updates = cut(updates)
    for _ in range(int(max_depth) + 2):
        if not rows:
            break
        reached = steps.join(frontier.select(F.col("pubkey").alias("node"), "distance"), rows <= BROADCAST_ROWS)
        offers = reached.filter(F.col("distance") + 1 <= max_depth).groupBy(F.col("next").alias("pubkey")).agg((F.min("distance") + 1).alias("offer"))
        old = distances.withColumnRenamed("distance", "old")
        newer = updates.withColumnRenamed("distance", "newer")
        better = offers.join(old, "pubkey", "left").join(newer, "pubkey", "left").filter("coalesce(newer, old) is null or offer < coalesce(newer, old)")
        frontier, rows = cut_and_count(better.select("pubkey", F.col("offer").alias("distance")))
        if rows:
            updates = cut(updates.join(frontier, "pubkey", "left_anti").unionByName(frontier))
    return distances.join(updates, "pubkey", "left_anti").unionByName(updates)


def changes(before: DataFrame, after: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges that were lost and those that were gained, as (follower, followed)."""
    old, new = before.select(SRC, DST), after.select(SRC, DST)
    return old.join(new, [SRC, DST], "left_anti"), new.join(old, [SRC, DST], "left_anti")


def orphans(edges: DataFrame, distances: DataFrame, lost: DataFrame, backward: DataFrame | Dealt | None = None) -> DataFrame:
    """``pubkey, distance`` of the keys none of whose shortest paths is left, with their old distances.

    ``edges`` are those after the removal of the ``lost`` ones. By level: a key
    is looked at if it lost an edge of a shortest path or one of its parents
    before it is an orphan, and is one if no follower a level nearer remains
    that isn't. Only the edges of keys that are looked at are read.
    """
    ahead, back = Steps(edges), Steps(edges if backward is None else backward, backward=True)
    near = distances.withColumnsRenamed({"pubkey": SRC, "distance": "near"})
    far = distances.withColumnsRenamed({"pubkey": DST, "distance": "far"})
    hit = lost.select(SRC, DST).join(near, SRC).join(far, DST).filter("far = near + 1")
    hit = cut(hit.select(F.col(DST).alias("node"), F.col("far").alias("distance")).distinct())
    levels = sorted(r[0] for r in hit.select("distance").distinct().collect())  # no more than the depth of the table
    found = distances.limit(0).select(F.col("pubkey").alias("node"), "distance")
    if not levels:
        return found.withColumnRenamed("node", "pubkey")
    parents = distances.withColumnsRenamed({"pubkey": "next", "distance": "near"})
    level, passed_on = levels[0], None
    while level <= levels[-1] or passed_on is not None:
        now = hit.filter(F.col("distance") == level)
        now = now if passed_on is None else now.unionByName(passed_on).distinct()
        now, rows = cut_and_count(now)
        passed_on = None
        if rows:
            there = back.join(now, rows <= BROADCAST_ROWS).join(parents, "next").filter("near = distance - 1")
            saved = there.join(found.select(F.col("node").alias("next")), "next", "left_anti").select("node").distinct()
            gone, rows = cut_and_count(now.join(saved, "node", "left_anti"))
            if rows:
                found = cut(found.unionByName(gone))
                after = ahead.join(gone.select("node"), rows <= BROADCAST_ROWS).select(F.col("next").alias("node")).distinct()
                passed_on = after.join(distances.withColumnRenamed("pubkey", "node"), "node").filter(F.col("distance") == level + 1)
        level += 1
    return found.withColumnRenamed("node", "pubkey")


def refresh(
    edges: DataFrame, distances: DataFrame, lost: DataFrame, gained: DataFrame, max_depth: int, backward: DataFrame | Dealt | None = None
) -> DataFrame:
    """Root distances after edges were ``lost`` and ``gained``; equal to a rebuild over ``edges``, those after.

    Keys that lost all their shortest paths are set free (``orphans``) and get
    the best offer of the others that follow them; gained edges make offers too;
    what gets better is passed on. The rest of the table isn't looked at.
    """
    free = cut(orphans(edges, distances, lost, backward))
    kept = distances.join(free.select("pubkey"), "pubkey", "left_anti")
    known = kept.withColumnsRenamed({"pubkey": "next"})
    back = Steps(edges if backward is None else backward, backward=True)
    few = free.count() <= BROADCAST_ROWS
    again = back.join(free.select(F.col("pubkey").alias("node")), few).join(known, "next").select(F.col("node").alias("pubkey"), "distance")
    new = gained.select(F.col(SRC).alias("next"), F.col(DST).alias("pubkey")).join(known, "next").select("pubkey", "distance")
    offers = again.unionByName(new).groupBy("pubkey").agg((F.min("distance") + 1).alias("distance")).filter(F.col("distance") <= max_depth)
    better = offers.join(kept.withColumnRenamed("distance", "old"), "pubkey", "left").filter("old is null or distance < old").drop("old")
    start = cut(better)
    return _spread(edges, kept, start, start, max_depth)


def root_distances(edges: DataFrame, root, max_depth: int) -> DataFrame:
    """``pubkey, distance`` from the root, which has 0 even if it is in no edge."""
    return single(edges, root, max_depth).select(F.col("node").alias("pubkey"), "distance")


def root_within(distances: DataFrame, k: int) -> DataFrame:
    """Keys 1..k hops from the root, by its table."""
    return distances.filter((F.col("distance") <= k) & (F.col("distance") > 0))


def root_lookup(distances: DataFrame, targets: DataFrame) -> DataFrame:
    """``target, distance`` for a table of targets by the root's table; null if it doesn't have them."""
    return targets.join(distances.withColumnRenamed("pubkey", "target"), "target", "left")


def distribution(distances: DataFrame) -> DataFrame:
    return distances.filter("distance > 0").groupBy("distance").agg(F.count(F.lit(1)).alias("count")).orderBy("distance")
