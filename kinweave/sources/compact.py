"""A small form of a graph's edges on disk: dense ids and adjacency as differences.

``keys`` has each key and its id, from 0 without gaps, in the order of the keys.
``lists`` has, for each follower and block of BLOCK followed ids, the ids in order as
differences, so most are small numbers, which Parquet packs. A block bounds a
row's size, whatever the number of keys that somebody follows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinweave.operators.relational import DST, SRC
from kinweave.plans.lineage import cut
from kinweave.plans.skew import join_per_key

BLOCK = 1 << 16


def dense_ids(edges: DataFrame) -> DataFrame:
    """``key, id``: keys are sorted by range in parallel; each range's number of keys, one row
    for each partition, gives the ids that it begins with."""
    keys = edges.select(F.explode(F.array(SRC, DST)).alias("key")).filter("key is not null").distinct()
    ranged = cut(keys.repartitionByRange("key").sortWithinPartitions("key").select("key", F.monotonically_increasing_id().alias("at")))
    part = F.shiftright("at", 33)
    sizes = sorted((r["part"], r["n"]) for r in ranged.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    begins, total = [], 0
    for number, n in sizes:
        begins.append((number, total))
        total += n
    if not begins:
        return ranged.select("key", F.col("at").alias("id"))
    first = edges.sparkSession.createDataFrame(begins, "part bigint, first bigint")
    within = F.col("at") - F.shiftleft(part, 33)
    return ranged.withColumn("part", part).join(F.broadcast(first), "part").select("key", (F.col("first") + within).alias("id"))


def write_compact(edges: DataFrame, path: str) -> None:
    """Writes the edges, with ``created_at`` once for each list, under ``path``, which must be new."""
    ids = cut(dense_ids(edges))
    pairs, total = edges.select(SRC, DST, "created_at"), edges.count()
    for end in (SRC, DST):
        counts = edges.groupBy(F.col(end).alias("key")).agg(F.count(F.lit(1)).alias("n"))
        own = cut(counts.join(ids, "key").select(F.col("key").alias(end), F.col("id").alias(f"id_{end}"), F.col("n").alias(f"n_{end}")))
        pairs = join_per_key(pairs, own, end, f"n_{end}", total)
    follower, followed = F.col(f"id_{SRC}").alias("follower"), F.col(f"id_{DST}").alias("followed")
    block = F.floor(F.col("followed") / BLOCK).alias("block")
    lists = pairs.select(follower, followed, "created_at").select("*", block).groupBy("follower", "block").agg(
        F.array_sort(F.collect_set("followed")).alias("ids"), F.max("created_at").alias("created_at")
    )
    steps = F.transform("ids", lambda x, i: (x - F.when(i == 0, F.col("block") * BLOCK).otherwise(F.get("ids", i - 1))).cast("int"))
    ids.sortWithinPartitions("id").write.option("compression", "zstd").parquet(f"{path}/keys")
    rows = lists.select("follower", "block", steps.alias("steps"), "created_at").repartitionByRange("follower").sortWithinPartitions("follower", "block")
    rows.write.option("compression", "zstd").parquet(f"{path}/lists")


def read_compact(spark: SparkSession, path: str) -> DataFrame:
    """The edges again: ``follower_pubkey, followed_pubkey, created_at``."""
    lists, ids = spark.read.parquet(f"{path}/lists"), spark.read.parquet(f"{path}/keys")
    start = F.struct((F.col("block") * BLOCK).alias("at"), F.array().cast("array<bigint>").alias("ids"))
    added = lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["ids"], F.array(a["at"] + x)).alias("ids"))
    rows = lists.select("follower", "created_at", F.explode(F.aggregate("steps", start, added, lambda a: a["ids"])).alias("followed"))
    total = rows.count()
    for name, end in (("follower", SRC), ("followed", DST)):
        counts = rows.groupBy(name).agg(F.count(F.lit(1)).alias(f"n_{name}"))
        own = cut(counts.join(ids.select(F.col("id").alias(name), F.col("key").alias(end)), name))
        rows = join_per_key(rows, own, name, f"n_{name}", total)
    return rows.select(SRC, DST, "created_at")
