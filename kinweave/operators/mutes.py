"""Mute lists: a second table of replaceable lists beside the follows, read by distance from a root."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.operators.ingest import replace_lists_strictly
from kinweave.operators.relational import DST, SRC
from kinweave.plans.lineage import cut
from kinweave.plans.skew import join_per_key

MUTE_LIST_KIND = 10000
#: What a muting edge's columns are called.
MUTER, MUTED = "muter_pubkey", "muted_pubkey"


def replace_mutes(mutes: DataFrame, events: DataFrame) -> DataFrame:
    """The lists of the events' authors, one event each, where they are newer than the
    stored ones; an empty list clears. Nobody mutes themselves."""
    to_follows, back = {MUTER: SRC, MUTED: DST}, {SRC: MUTER, DST: MUTED}
    return replace_lists_strictly(mutes.withColumnsRenamed(to_follows), events).filter(F.col(SRC) != F.col(DST)).withColumnsRenamed(back)


def counts_by_distance(follows: DataFrame, mutes: DataFrame, distances: DataFrame) -> DataFrame:
    """``pubkey, distance, followers, muters``: of every key that is followed or muted, how
    many at each distance from the root do so. Followers and muters out of the
    root's reach count at no distance and are left out, self-follows and self-mutes too.

    One aggregate over both tables; the distance of authors is joined once.
    """
    by_author = lambda edges, author, to, kind: edges.filter(F.col(author) != F.col(to)).select(
        F.col(author).alias("author"), F.col(to).alias("pubkey"), F.lit(kind == "f").cast("int").alias("f"), F.lit(kind == "m").cast("int").alias("m")
    )
    both = by_author(follows, SRC, DST, "f").unionByName(by_author(mutes, MUTER, MUTED, "m"))
    lists = both.groupBy("author").agg(F.count(F.lit(1)).alias("n"))
    near = distances.select(F.col("pubkey").alias("author"), "distance")
    known = cut(lists.join(near, "author"))
    total = known.agg(F.sum("n")).first()[0] or 0
    found = join_per_key(both.join(known.select("author"), "author", "left_semi"), known, "author", "n", total)
    return found.groupBy("pubkey", "distance").agg(F.sum("f").alias("followers"), F.sum("m").alias("muters"))


def overmuted(counts: DataFrame, threshold: float = 1.0) -> DataFrame:
    """``pubkey, distance, followers, muters`` of the keys with more muters, times ``threshold``,
    than followers, both at the least distance at which there are any."""
    nearest = counts.groupBy("pubkey").agg(F.min_by(F.struct("distance", "followers", "muters"), "distance").alias("c"))
    return nearest.select("pubkey", "c.*").filter(F.col("muters") * F.lit(threshold) > F.col("followers"))


def muted_without_followers(follows: DataFrame, mutes: DataFrame) -> DataFrame:
    """``pubkey`` of the keys that somebody mutes and nobody follows."""
    muted = mutes.select(F.col(MUTED).alias("pubkey")).distinct()
    return muted.join(follows.select(F.col(DST).alias("pubkey")).distinct(), "pubkey", "left_anti")


def without(edges: DataFrame, keys: DataFrame) -> DataFrame:
    """Follows or mutes less every edge from or to one of the ``keys`` (column ``pubkey``)."""
    for end in edges.columns[:2]:
        edges = edges.join(keys.select(F.col("pubkey").alias(end)), end, "left_anti").select(*edges.columns)
    return edges
