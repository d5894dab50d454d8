"""Centroid clustering by plain Lloyd rounds over integer vectors.

The centroids, ``k * dims`` integers, are broadcast in each round. Tasks hold
them against their vectors in NumPy and give back one row of sums per centroid
and task, which a ``groupBy`` merges, so ``k`` rows reach the driver. All sums
are of integers: the order of rows and tasks changes nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.llm.common import stored

SCALE = 1024
#: Larger components are an error: the squared distance of two vectors of 64
#: components within it fits a long with room to spare.
LARGEST = 131_072.0


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, dims: int, scale: int = SCALE) -> DataFrame:
    """``_id, _q`` of the vectors with ``dims`` components, none null or non-finite.

    ``_id`` is the id as text (Python workers would turn integers beside nulls
    into floats), ``_q`` the components as ``floor(scale * x)``."""
    x = F.col(f"`{vec_col}`").cast("array<double>")
    usable = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    large = F.raise_error(F.lit(f"a component is beyond {LARGEST:g}, so distances may not fit a long"))
    whole = F.transform(x, lambda c: F.when(F.abs(c) <= LARGEST, F.floor(c * F.lit(float(scale)))).otherwise(large.cast("bigint")))
    kept = df.filter(F.coalesce((F.size(x) == dims) & usable, F.lit(False)))
    return kept.select(F.col(f"`{id_col}`").cast("string").alias("_id"), whole.alias("_q"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors whose ids have the smallest digests; vectors without an id come
    last, and rows that share an id in the order of their components."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("_id")), 256)
    rows = vectors.select(digest.alias("d"), "_q").orderBy(F.asc_nulls_last("d"), "_q").limit(k).collect()
    return np.array([r["_q"] for r in rows], np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, the smallest number of several, and the squared distance."""
    far = np.stack([((x - c) ** 2).sum(axis=1) for c in centroids])
    cluster = far.argmin(axis=0)
    return cluster, far[cluster, np.arange(len(x))]


def _summed(centroids):
    """A function of a task's batches: one row per centroid that has vectors."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = centroids.value
        n, far, total = np.zeros(len(c), np.int64), np.zeros(len(c), np.int64), np.zeros(c.shape, np.int64)
        for batch in batches:
            if not len(batch):
                continue
            x = np.stack(batch["_q"].to_list())
            cluster, distance = nearest(x, c)
            n += np.bincount(cluster, minlength=len(c))
            np.add.at(far, cluster, distance)
            for i in np.unique(cluster):
                total[i] += x[cluster == i].sum(axis=0)
        seen = np.flatnonzero(n)
        about = pd.DataFrame({"cluster": seen.astype(np.int32), "n": n[seen], "far": far[seen]})
        yield about.join(pd.DataFrame(total[seen], columns=[f"s{i}" for i in range(c.shape[1])]))

    return sums


def _round(vectors: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The centroids after a round, and the distances of each one's vectors before it, summed."""
    sums = [f"s{i}" for i in range(centroids.shape[1])]
    names = ["n", "far", *sums]
    schema = T.StructType([T.StructField("cluster", T.IntegerType()), *[T.StructField(s, T.LongType()) for s in names]])
    sent = vectors.sparkSession.sparkContext.broadcast(centroids)
    parts = vectors.select("_q").mapInPandas(_summed(sent), schema)
    rows = parts.groupBy("cluster").agg(*[F.sum(s).alias(s) for s in names]).collect()
    sent.unpersist()
    moved, inertia = centroids.copy(), np.zeros(len(centroids), np.int64)
    for r in rows:
        inertia[r["cluster"]] = r["far"]
        moved[r["cluster"]] = [r[s] // r["n"] for s in sums]
    return moved, inertia


def _labelled(centroids, inertia: np.ndarray):
    c = centroids
    digests = np.array([hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in c.tolist()], object)
    whole = int(inertia.sum())

    def labels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                cluster, distance = nearest(np.stack(batch["_q"].to_list()), c)
                yield pd.DataFrame({
                    "_id": batch["_id"], "cluster": cluster.astype(np.int32), "distance": distance,
                    "cluster_inertia": inertia[cluster], "inertia": whole, "centroid_sha256": digests[cluster],
                })

    return labels


def lloyd(
    df: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, dims: int = 64, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """``id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of each usable vector.

    Vectors without ``dims`` finite components get no row, among them null and
    empty ones; a component beyond LARGEST is an error. Rows that share an id
    or a vector count each; with fewer than ``k`` vectors there are as many
    centroids, and an empty table gives an empty result. Of equally near
    centroids the smallest number wins, and a centroid that lost its vectors
    stays where it is. Only the two named columns are read.
    """
    kind = df.schema[id_col].dataType
    vectors = stored(integer_vectors(df, id_col, vec_col, dims), "vectors")
    centroids = first_centroids(vectors, k, seed)
    schema = "_id string, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    if not len(centroids):
        found = df.sparkSession.createDataFrame([], schema)
    else:
        for _ in range(rounds):
            centroids, _ = _round(vectors, centroids)
        _, inertia = _round(vectors, centroids)
        found = vectors.mapInPandas(_labelled(centroids, inertia), schema)
    return found.select(F.col("_id").cast(kind).alias(id_col), *found.columns[1:])
