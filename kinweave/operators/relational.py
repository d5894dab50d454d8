"""Lookups, joins and aggregates on edges, each as one declarative plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.plans.lineage import cut, cut_and_count, cut_by

SRC, DST = "follower_pubkey", "followed_pubkey"
#: A node counts as hot if more than one in HOT_SHARE of the edges leave it, so there are at most HOT_SHARE.
HOT_SHARE = 1000
SALTS = 64


class Dealt:
    """A copy of the edges for searches, dealt out by one end once, hot keys and all.

    ``cold`` is dealt by the key. The edges of hot keys are in ``hot``, dealt by key
    and a salt of the other end, so no partition holds a celebrity's followers;
    ``keys`` are these at most HOT_SHARE keys, None if there is none; ``counts`` are the edges of each key."""

    def __init__(self, edges: DataFrame, backward: bool = False):
        near, far = (DST, SRC) if backward else (SRC, DST)
        steps = edges.select(F.col(near).alias("node"), F.col(far).alias("next"))
        self.counts, self.keys, n_hot = _hot_nodes(steps)
        self.backward, self.hot = backward, None
        if not n_hot:
            self.keys, self.cold = None, cut_by(steps, "node")
            return
        few = F.broadcast(self.keys)
        self.cold = cut_by(steps.join(few, "node", "left_anti"), "node")
        self.hot = cut_by(steps.join(few, "node", "left_semi").withColumn("salt", _salt()), "node", "salt")


def _salt():
    return F.pmod(F.xxhash64("next"), F.lit(SALTS)).cast("int")


def _hot_nodes(steps: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """The steps of each node as ``node, n``, the hot nodes and their number."""
    counts = cut(steps.groupBy("node").agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts, *cut_and_count(counts.filter(F.col("n") * HOT_SHARE > total).filter(F.col("n") > SALTS).select("node"))


class Steps:
    """Edges as steps from ``node`` to ``next``, forward or backward, to be joined with rows at nodes."""

    def __init__(self, edges: DataFrame | Dealt, backward: bool = False):
        self.dealt = edges if isinstance(edges, Dealt) else None
        if self.dealt:
            if self.dealt.backward != backward:
                raise ValueError("the edges are dealt out by their other end")
            self.frame = self.dealt.cold if self.dealt.hot is None else self.dealt.cold.unionByName(self.dealt.hot.drop("salt"))
        else:
            near, far = (DST, SRC) if backward else (SRC, DST)
            self.frame = edges.select(F.col(near).alias("node"), F.col(far).alias("next"))
        self._counts: DataFrame | None = self.dealt.counts if self.dealt else None
        self._hot: DataFrame | None = None
        self._hot_rows = 0

    def hot(self) -> DataFrame:
        """The at most HOT_SHARE hot nodes, found once, when first needed."""
        if self._hot is None:
            self._counts, self._hot, self._hot_rows = _hot_nodes(self.frame)
        return self._hot

    def rows_of(self, rows: DataFrame) -> int:
        """How many rows ``join`` makes of these, by count."""
        if self._counts is None:
            self.hot()
        here = rows.groupBy("node").agg(F.count(F.lit(1)).alias("here"))
        return here.join(self._counts, "node").agg(F.sum(F.col("here") * F.col("n"))).first()[0] or 0

    def join(self, rows: DataFrame, small: bool, wider: int | None = None) -> DataFrame:
        """``rows`` with ``next``, a row for each step from their ``node``.

        Small rows are broadcast, and edges stay where they are. Others are
        joined by a shuffle on the node, except at hot nodes: the steps of these
        are dealt out by a salt of their ends and the rows there repeated for
        each salt, so no node's steps meet in one task. Edges that are ``Dealt``
        stay where they are then too, unless the rows need ``wider`` partitions.
        """
        deal = lambda df, *by: df.repartition(wider, *by) if wider else df
        if small:
            return self.frame.join(F.broadcast(rows), "node")
        if self.dealt:
            cold = deal(self.dealt.cold, "node")
            if self.dealt.hot is None:
                return cold.join(rows, "node")
            return self._salted(cold, deal(self.dealt.hot, "node", "salt"), rows, F.broadcast(self.dealt.keys))
        hot = F.broadcast(self.hot())
        if not self._hot_rows:
            return deal(self.frame, "node").join(rows, "node")
        salted = self.frame.join(hot, "node", "left_semi").withColumn("salt", _salt())
        return self._salted(deal(self.frame.join(hot, "node", "left_anti"), "node"), deal(salted, "node", "salt"), rows, hot)

    def _salted(self, cold: DataFrame, salted: DataFrame, rows: DataFrame, hot: DataFrame) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
        there = rows.join(hot, "node", "left_semi").select("*", every)
        return cold.join(rows, "node").unionByName(salted.join(there.hint("merge"), ["node", "salt"]).drop("salt"))


def graph_stats(edges: DataFrame) -> DataFrame:
    return edges.agg(
        F.count(F.lit(1)).alias("total_follows"),
        F.countDistinct(SRC).alias("unique_followers"),
        F.countDistinct(DST).alias("unique_followed"),
    )


def degrees(edges: DataFrame) -> DataFrame:
    """``pubkey, out_degree, in_degree`` of every key; a self-follow counts in both."""
    ends = edges.select(F.explode(F.array(
        F.struct(F.col(SRC).alias("pubkey"), F.lit(1).alias("o"), F.lit(0).alias("i")),
        F.struct(F.col(DST).alias("pubkey"), F.lit(0).alias("o"), F.lit(1).alias("i")),
    )).alias("e"))
    return ends.groupBy("e.pubkey").agg(F.sum("e.o").alias("out_degree"), F.sum("e.i").alias("in_degree"))


def degree_of(edges: DataFrame, pubkey) -> DataFrame:
    return edges.filter((F.col(SRC) == pubkey) | (F.col(DST) == pubkey)).agg(
        F.count_if(F.col(SRC) == pubkey).alias("out_degree"), F.count_if(F.col(DST) == pubkey).alias("in_degree")
    )


def all_pubkeys(edges: DataFrame) -> DataFrame:
    """Distinct end points, in one scan of the edges."""
    ends = edges.select(F.explode(F.array(SRC, DST)).alias("pubkey"))
    return ends.filter(F.col("pubkey").isNotNull() & (F.col("pubkey").cast("string") != "")).distinct()


def exists(edges: DataFrame, pubkey) -> bool:
    return not edges.filter((F.col(SRC) == pubkey) | (F.col(DST) == pubkey)).isEmpty()


def both_exist(edges: DataFrame, a, b) -> bool:
    touched = edges.filter(F.col(SRC).isin(a, b) | F.col(DST).isin(a, b)).agg(
        F.max((F.col(SRC) == a) | (F.col(DST) == a)).alias("a"), F.max((F.col(SRC) == b) | (F.col(DST) == b)).alias("b")
    )
    row = touched.first()
    return bool(row["a"]) and bool(row["b"])


def probe_exists(edges: DataFrame, probes: DataFrame) -> DataFrame:
    """``pubkey, found`` for a table of keys."""
    found = all_pubkeys(edges).withColumn("found", F.lit(True))
    return probes.join(found, "pubkey", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def direct_follow(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """``a, b, follows`` for a table of pairs."""
    pairs_of = edges.select(F.col(SRC).alias("a"), F.col(DST).alias("b"), F.lit(True).alias("follows"))
    return pairs.join(pairs_of, ["a", "b"], "left").withColumn("follows", F.coalesce("follows", F.lit(False)))


def follows(edges: DataFrame, a, b) -> bool:
    return not edges.filter((F.col(SRC) == a) & (F.col(DST) == b)).isEmpty()


def are_mutual(edges: DataFrame, a, b) -> bool:
    """Both directions in one filtered scan; of a key with itself, whether it follows itself."""
    there, back = (F.col(SRC) == a) & (F.col(DST) == b), (F.col(SRC) == b) & (F.col(DST) == a)
    row = edges.filter(there | back).agg(F.max(there).alias("there"), F.max(back).alias("back")).first()
    return bool(row["there"]) and bool(row["back"])


def mutual_follows(edges: DataFrame) -> DataFrame:
    """All pairs ``a < b`` that follow each other: pairs are put in order and
    counted, which needs one shuffle and no self-join."""
    ordered = edges.filter(F.col(SRC) != F.col(DST)).select(
        F.least(SRC, DST).alias("a"), F.greatest(SRC, DST).alias("b"), (F.col(SRC) < F.col(DST)).alias("up")
    )
    both = ordered.groupBy("a", "b").agg(F.max("up").alias("up"), F.max(~F.col("up")).alias("down"))
    return both.filter("up and down").select("a", "b")


def following(edges: DataFrame, pubkey) -> DataFrame:
    return edges.filter(F.col(SRC) == pubkey).select(F.col(DST).alias("pubkey")).distinct().orderBy("pubkey")


def followers(edges: DataFrame, pubkey) -> DataFrame:
    return edges.filter(F.col(DST) == pubkey).select(F.col(SRC).alias("pubkey")).distinct().orderBy("pubkey")


def two_hop(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """``source, target, via`` with the number of keys between, for a table of
    sources; the two ends may be the same key. A source has as many rows as keys
    it reaches, so the result of very many sources is large."""
    first = edges.select(F.col(SRC).alias("source"), F.col(DST).alias("node")).join(sources.select("source").distinct(), "source", "left_semi")
    reached = Steps(edges).join(first, False)
    return reached.groupBy("source", F.col("next").alias("target")).agg(F.count(F.lit(1)).alias("via"))


def two_hop_pairs(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """``source, target, mid`` for the ``pairs`` that some key stands between, and the smallest such key.

    Both ends are fixed, so a pair costs as many rows as its source follows; the
    edges of a source that follows very many are dealt out by salts (``Steps``).
    The second join is on whole edges, of which none is there twice."""
    asked = pairs.select("source", "target").distinct()
    first = Steps(edges).join(asked.select("target", F.col("source").alias("node")), False)
    first = first.select(F.col("node").alias("source"), "target", F.col("next").alias("mid"))
    last = edges.select(F.col(SRC).alias("mid"), F.col(DST).alias("target"))
    between = first.join(last, ["mid", "target"])
    return between.groupBy("source", "target").agg(F.min("mid").alias("mid"))


def pairs_exist(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """``a, b, found_a, found_b`` for a table of pairs."""
    known = all_pubkeys(edges)
    one, two = (known.select(F.col("pubkey").alias(c), F.lit(True).alias(f"found_{c}")) for c in "ab")
    out = pairs.join(one, "a", "left").join(two, "b", "left")
    return out.select("a", "b", *[F.coalesce(f"found_{c}", F.lit(False)).alias(f"found_{c}") for c in "ab"])
