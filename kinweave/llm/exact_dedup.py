"""Exact deduplication by skew-safe combining.

Equal texts are found in three combining steps: within each task (the map side
of the first aggregate), within salted digest groups, and over the salts. The
text itself is part of every grouping key, so each step compares full content;
the digest only spreads rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import columns_only, stored

SALTS = 16
#: A text with more than one row in HOT_SHARE counts as hot, so there are at
#: most HOT_SHARE hot texts whatever the input's size.
HOT_SHARE = 1000


def sha256_bytes(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _keyed(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return columns_only(docs, id_col, text_col).select(
        F.col(id_col).alias("_id"), text.alias("_text"), digest(text).alias("_digest")
    )


def combine(keyed: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row per distinct text: ``_digest, _text, keep_id, group_size``."""
    local_then_salted = (
        keyed.withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(salts)).cast("int"))
        .groupBy("_digest", "_salt", "_text")
        .agg(F.max("_id").alias("_best"), F.count(F.lit(1)).alias("_n"))
    )
    return local_then_salted.groupBy("_digest", "_text").agg(
        F.max("_best").alias("keep_id"), F.sum("_n").alias("group_size")
    )


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = SALTS,
    digest: Callable[[Column], Column] = sha256_bytes,
) -> DataFrame:
    """For every row its text's class: ``id, keep_id, group_size, kept``.

    The row with the largest id of each group of identical texts stays. A null
    text counts as empty, empty texts are equal to each other, and texts of any
    length are compared whole. Rows that repeat an id and a text are counted
    each and share one decision; a null id never wins over another and is kept
    only if its group has no other. An empty table gives an empty result. Only
    the two named columns are read, so extra columns can't clash.

    The first two shuffles carry texts; what follows carries digests. Members
    of hot texts find their class through a broadcast of at most ``HOT_SHARE``
    rows, the rest through a join on the digest. Should two texts ever share a
    digest, the rows of that digest are joined on the text as well.
    """
    spark = docs.sparkSession
    keyed = _keyed(docs, id_col, text_col, digest)
    # What is written is small: no text, but enough to tell a shared digest.
    winners = stored(combine(keyed, salts).drop("_text"), "dedup")
    total = winners.agg(F.sum("group_size")).first()[0] or 0
    shared = winners.groupBy("_digest").count().filter("count > 1").select("_digest")
    slim = keyed.select("_id", "_digest")
    parts = []
    if not shared.isEmpty():
        shared = stored(shared, "dedup-shared")
        rows = keyed.join(shared, "_digest", "left_semi")
        parts.append(rows.join(combine(rows, salts), ["_digest", "_text"]))
        slim = slim.join(shared, "_digest", "left_anti")
        winners = winners.join(shared, "_digest", "left_anti")
    is_hot = F.col("group_size") * HOT_SHARE > F.lit(total)
    hot = winners.filter(is_hot).withColumnsRenamed({"keep_id": "_hot_id", "group_size": "_hot_n"})
    tried = slim.join(F.broadcast(hot), "_digest", "left")
    parts.append(
        tried.filter("_hot_n is not null").select(
            "_id", F.col("_hot_id").alias("keep_id"), F.col("_hot_n").alias("group_size"), "_digest"
        )
    )
    parts.append(
        tried.filter("_hot_n is null")
        .select("_id", "_digest")
        .join(winners.filter(~is_hot), "_digest")
        .select("_id", "keep_id", "group_size", "_digest")
    )
    out = None
    for part in parts:
        part = part.select("_id", "keep_id", "group_size", "_digest")
        out = part if out is None else out.unionByName(part)
    return out.select(
        F.col("_id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("_digest").alias("digest"),
    )
