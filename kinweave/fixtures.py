"""A follow graph derived from the order tables, for queries and tests.

One event per order: its customer follows a key for every line item. The same
graph can be stated in SQL, which is what ``kinweave.queries`` checks against.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.operators import ingest as ing
from kinweave.plans.lineage import cut_by


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_events(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """``pubkey, created_at, ord``: author, time and input order of each event, and ``more`` columns of the orders."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("bigint").alias("pubkey"),
        F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', o_orderdate)").cast("bigint").alias("created_at"),
        F.col("o_orderkey").cast("bigint").alias("ord"),
        *more,
    )


def edges_of(spark: SparkSession, sf_dir: str, kept: DataFrame) -> DataFrame:
    """Distinct edges of kept events, the keys as integers.

    The kept events, one for each author, are the hashed side of the join, so
    no task sorts the line items of all orders.
    """
    customers = table(spark, sf_dir, "customer").count()
    items = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("bigint").alias("ord"),
        ((F.col("l_partkey") * 31 + F.col("l_suppkey") * 17) % customers).cast("bigint").alias("followed_pubkey"),
    )
    return (
        kept.hint("shuffle_hash").join(items, "ord")
        .select(F.col("pubkey").alias("follower_pubkey"), "followed_pubkey", "created_at")
        .groupBy("follower_pubkey", "followed_pubkey")
        .agg(F.first("created_at").alias("created_at"))
    )


def follow_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges_of(spark, sf_dir, ing.latest_per_author(order_events(spark, sf_dir)))


def cached_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph cut once by follower, for searches that join it at every level."""
    return cut_by(follow_edges(spark, sf_dir), "follower_pubkey")


def mute_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mute lists of the same authors: orders of priority 1-URGENT are events of kind
    10000, the newest counts, and their line items name the muted keys by another rule."""
    urgent = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").cast("bigint").alias("ord"))
    kept = ing.latest_per_author(order_events(spark, sf_dir).join(urgent, "ord", "left_semi").select("pubkey", "created_at", "ord"))
    customers = table(spark, sf_dir, "customer").count()
    items = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("bigint").alias("ord"),
        ((F.col("l_partkey") * 13 + F.col("l_suppkey") * 7) % customers).cast("bigint").alias("muted_pubkey"),
    )
    named = kept.join(items, "ord").select(F.col("pubkey").alias("muter_pubkey"), "muted_pubkey", "created_at")
    return named.groupBy("muter_pubkey", "muted_pubkey").agg(F.first("created_at").alias("created_at"))


def event_objects(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """The tags form of the same events, hashed keys, for the parser.

    Followed keys are gathered as integers and hashed where they are tagged.
    """
    customers = table(spark, sf_dir, "customer").count()
    key = lambda c: F.sha2(F.concat(F.lit("u"), c.cast("string")), 256)
    followed = ((F.col("l_partkey") * 31 + F.col("l_suppkey") * 17) % customers).cast("bigint")
    lists = (
        table(spark, sf_dir, "lineitem")
        .select(F.col("l_orderkey").cast("bigint").alias("ord"), followed.alias("followed"))
        .groupBy("ord")
        .agg(F.collect_list("followed").alias("followed"))
    )
    events = order_events(spark, sf_dir, *more).join(lists, "ord", "left")
    empty = F.array().cast("array<array<string>>")
    tags = F.transform("followed", lambda k: F.array(F.lit("p"), F.upper(key(k))))
    return events.select(
        key(F.col("pubkey")).alias("pubkey"), "created_at", F.lit(3).alias("kind"), F.coalesce(tags, empty).alias("tags"), "ord", *more
    )
