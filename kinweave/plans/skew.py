"""Joins that survive a key with a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key counts as hot if more than one in HOT_SHARE of the rows have it, so
#: there are at most HOT_SHARE hot keys in an input of any size.
HOT_SHARE = 1000


def join_per_key(rows: DataFrame, per_key: DataFrame, key: str, count: str, total: int, most: int | None = None) -> DataFrame:
    """Left join of many ``rows`` with small rows, one ``per_key``, safe from hot keys.

    ``count`` is how many of the ``total`` rows have the key. The at most
    HOT_SHARE rows of hot keys are broadcast, so hot rows aren't shuffled; the
    rest is joined by a shuffle on the key. If ``most``, the largest count, is
    known and no key is hot, that is all.
    """
    if most is not None and most * HOT_SHARE <= total:
        return rows.join(per_key, key, "left")
    names = [c for c in per_key.columns if c != key]
    is_hot = F.col(count) * HOT_SHARE > F.lit(total)
    hot = per_key.filter(is_hot).withColumnsRenamed({n: f"_hot_{n}" for n in names})
    tried = rows.join(F.broadcast(hot), key, "left")
    found = tried.filter(f"_hot_{count} is not null").withColumnsRenamed({f"_hot_{n}": n for n in names})
    rest = tried.filter(f"_hot_{count} is null").drop(*[f"_hot_{n}" for n in names])
    return found.unionByName(rest.join(per_key.filter(~is_hot), key, "left"))
