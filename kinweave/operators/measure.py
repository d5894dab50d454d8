"""Measures of the whole graph: PageRank, clustering, weakly connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from kinweave.operators.relational import DST, SALTS, SRC, degrees
from kinweave.plans.lineage import cut, cut_and_count, fixed_plans, partitions_for, unsized
from kinweave.plans.skew import HOT_SHARE, join_per_key

DAMPING, TOLERANCE = 0.85, 1e-6
MOST_ROUNDS = 200


def pagerank(edges: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """``pubkey, rank`` of every key of the edges; the ranks add up to 1.

    A key gives its rank in equal shares to the keys that it follows, one that
    follows none gives it to all. Rounds end when the ranks' changes add up to
    less than ``tolerance``; the change and the rank of keys that follow none are
    observed while a round is written, so a round is one job.

    Edges are made once and dealt out by follower as one list per key, so a round
    sorts and joins keys, not edges; ranks are made where the next round needs
    them, so a round shuffles the followed keys' sums only. The edges of the at
    most HOT_SHARE keys that follow very many are spread evenly instead, and get
    these keys' shares by broadcast.
    """
    spark = edges.sparkSession
    steps, links = cut_and_count(edges.select(SRC, DST))
    with partitions_for(spark, links):
        with fixed_plans(spark):
            nodes, n = cut_and_count(degrees(steps).select(F.col("pubkey").alias("node"), "out_degree"))
        if not n:
            return nodes.select(F.col("node").alias("pubkey"), F.lit(0.0).alias("rank"))
        hot, n_hot = cut_and_count(nodes.filter((F.col("out_degree") * HOT_SHARE > links) & (F.col("out_degree") > SALTS)).select("node"))
        steps = steps.select(F.col(SRC).alias("node"), F.col(DST).alias("next"))
        partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
        spread = cut(steps.join(F.broadcast(hot), "node", "left_semi").repartition(partitions)) if n_hot else None
        cold = steps.join(F.broadcast(hot), "node", "left_anti") if n_hot else steps
        with fixed_plans(spark):
            dealt = cut(cold.groupBy("node").agg(F.collect_list("next").alias("nexts")))
        ranks = nodes.withColumn("rank", F.lit(1.0 / n))
        idle = ranks.filter("out_degree = 0").agg(F.sum("rank")).first()[0] or 0.0
        for _ in range(most_rounds):
            shares = ranks.filter("out_degree > 0").select("node", (F.col("rank") / F.col("out_degree")).alias("share"))
            given = dealt.join(shares.hint("shuffle_hash"), "node").select(F.explode("nexts").alias("next"), "share")
            if n_hot:
                few = shares.join(F.broadcast(hot), "node", "left_semi")
                given = given.unionByName(spread.join(F.broadcast(few), "node").select("next", "share"))
            got = given.groupBy(F.col("next").alias("node")).agg(F.sum("share").alias("got"))
            all_get = (1 - damping) / n + damping * idle / n
            moved = ranks.join(got.hint("shuffle_hash"), "node", "left").select(
                "node", "out_degree", (F.lit(all_get) + F.lit(damping) * F.coalesce("got", F.lit(0.0))).alias("rank"), F.col("rank").alias("old")
            )
            seen = Observation()
            unused = F.sum(F.when(F.col("out_degree") == 0, F.col("rank")))
            with fixed_plans(spark):
                moved = cut(moved.observe(seen, F.sum(F.abs(F.col("rank") - F.col("old"))).alias("change"), unused.alias("idle")))
            ranks, idle = moved.drop("old"), seen.get["idle"] or 0.0
            if seen.get["change"] < tolerance:
                break
    return ranks.select(F.col("node").alias("pubkey"), "rank")


def undirected(edges: DataFrame) -> DataFrame:
    """``a, b`` with a < b: each pair of different keys of which one follows the other, once."""
    return edges.filter(F.col(SRC) != F.col(DST)).select(F.least(SRC, DST).alias("a"), F.greatest(SRC, DST).alias("b")).distinct()


def triangles(edges: DataFrame) -> DataFrame:
    """``pubkey, neighbours, triangles`` of every key that has a neighbour; directions don't count.

    Pairs are turned from the end with fewer neighbours to the other. Then no
    key has more than the root of twice the pairs leading away from it, so
    joining these with each other squares no hub; every triangle is found once,
    at the corner with the fewest neighbours.
    """
    pairs, total = cut_and_count(undirected(edges))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node"))
    degree = cut(ends.groupBy("node").agg(F.count(F.lit(1)).alias("n")))
    for end in "ab":
        own = degree.withColumnsRenamed({"node": end, "n": f"n_{end}"})
        pairs = join_per_key(pairs, own, end, f"n_{end}", total)
    up = F.struct("n_a", "a") < F.struct("n_b", "b")
    low, high = F.struct(F.col("n_a").alias("n"), F.col("a").alias("node")), F.struct(F.col("n_b").alias("n"), F.col("b").alias("node"))
    turned = cut(pairs.select(F.when(up, low).otherwise(high).alias("x"), F.when(up, high).otherwise(low).alias("y")))
    arms = turned.select(F.col("x.node").alias("x"), "y")
    two = arms.join(arms.withColumnRenamed("y", "z"), "x").filter("y < z").select("x", F.col("y.node").alias("y"), F.col("z.node").alias("z"))
    closed = two.join(turned.select(F.col("x.node").alias("y"), F.col("y.node").alias("z")).hint("merge"), ["y", "z"])
    corners = closed.select(F.explode(F.array("x", "y", "z")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("t"))
    found = degree.join(corners, "node", "left")
    return found.select(F.col("node").alias("pubkey"), F.col("n").alias("neighbours"), F.coalesce("t", F.lit(0)).cast("bigint").alias("triangles"))


def clustering_coefficient(edges: DataFrame) -> DataFrame:
    """``pubkey, coefficient`` of every key: the share of its pairs of neighbours that are
    neighbours themselves, 0 for fewer than two neighbours. Directions and self-follows don't count."""
    n = F.col("neighbours")
    share = F.when(n > 1, 2.0 * F.col("triangles") / (n * (n - 1))).otherwise(0.0)
    found = triangles(edges).select("pubkey", share.alias("coefficient"))
    alone = edges.filter(F.col(SRC) == F.col(DST)).select(F.col(SRC).alias("pubkey")).distinct().join(found, "pubkey", "left_anti")
    return found.unionByName(alone.withColumn("coefficient", F.lit(0.0)))


def weak_components(edges: DataFrame) -> DataFrame:
    """``pubkey, component`` of every key: the smallest key that is connected with it, whatever the directions.

    Each round every key picks, of itself and its neighbours, the one with the
    least hash of this round, and pairs are replaced by the pairs of what their
    ends picked. On any graph a constant share of the keys is expected to go in
    each round, so there are about as many rounds as the logarithm of their
    number, each over fewer pairs than the one before. The picks are put
    together backwards, from the last and smallest round.
    """
    pairs, rows = cut_and_count(undirected(edges))
    picks: list[DataFrame] = []
    while rows:
        sides = pairs.select(F.explode(F.array(
            F.struct(F.col("a").alias("node"), F.col("b").alias("near")), F.struct(F.col("b").alias("node"), F.col("a").alias("near")),
        )).alias("e")).select("e.node", "e.near")
        order = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(len(picks))), F.col(c))  # noqa: B023, E731
        least = sides.groupBy("node").agg(F.min_by("near", order("near")).alias("near"), F.count(F.lit(1)).alias("n"))
        own_pick = F.when(order("near") < order("node"), F.col("near")).otherwise(F.col("node")).alias("picked")
        seen = Observation()
        picked = cut(least.select("node", own_pick, "n").observe(seen, F.max("n").alias("most")))
        picks.append(picked.select("node", "picked"))
        for end in "ab":
            own = picked.select(F.col("node").alias(end), F.col("picked").alias(f"to_{end}"), F.col("n").alias(f"n_{end}"))
            pairs = join_per_key(pairs, own, end, f"n_{end}", rows, seen.get["most"])
        left = pairs.filter("to_a <> to_b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct()
        pairs, rows = cut_and_count(left)
        pairs = unsized(pairs)
    keys = edges.select(F.explode(F.array(SRC, DST)).alias("pubkey")).distinct()
    if not picks:
        return keys.select("pubkey", F.col("pubkey").alias("component"))
    final = picks[-1]
    for picked in reversed(picks[:-1]):
        further = final.select(F.col("picked").alias("final"), F.col("node").alias("picked"))
        final = cut(picked.join(further, "picked", "left").select("node", F.coalesce("final", "picked").alias("picked")))
    named = final.groupBy("picked").agg(F.min("node").alias("component"), F.count(F.lit(1)).alias("n"))
    found = join_per_key(final, cut(named), "picked", "n", final.count()).select(F.col("node").alias("pubkey"), "component")
    return found.unionByName(keys.join(found, "pubkey", "left_anti").select("pubkey", F.col("pubkey").alias("component")))
