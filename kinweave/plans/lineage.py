"""Cutting lineage in iterative plans.

Each level of a traversal would otherwise carry the plan of all levels before
it. What is cut goes to the checkpoint folder that all executors share, so a
lost executor costs a re-read, not the traversal.
"""

from __future__ import annotations

import tempfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The session's shared folder. Where none is set, a local one is made if all
    tasks run in this process; on a cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not root and not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(root or tempfile.mkdtemp(prefix="kinweave-"))
    return root or context._jsc.sc().getCheckpointDir().get()


#: Rows that a shuffle partition of a counted step gets at most, on average: some hundred MB of a task's memory.
ROWS_PER_PARTITION = 2_000_000


def cut(df: DataFrame) -> DataFrame:
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def unsized(df: DataFrame) -> DataFrame:
    """A cut frame without the size that Spark has guessed for it.

    A checkpoint keeps its plan's guess, which is a product for a join. A loop
    that joins its own results thus multiplies the guess's digits each round
    until planning takes longer than any job. Loops of that kind use this.
    """
    spark = df.sparkSession
    return DataFrame(spark._jsparkSession.createDataFrame(df._jdf.toJavaRDD(), df._jdf.schema()), spark)


def cut_and_count(df: DataFrame) -> tuple[DataFrame, int]:
    """The cut frame and its rows, in one job."""
    seen = Observation()
    out = cut(df.observe(seen, F.count(F.lit(1)).alias("rows")))
    return out, int(seen.get["rows"])


@contextmanager
def fixed_plans(spark: SparkSession):
    """Within it plans are made without adaptive execution: an adaptive plan doesn't
    say how its result is partitioned. The session's setting is put back."""
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


@contextmanager
def partitions_for(spark: SparkSession, rows: int):
    """Within it a step over ``rows`` rows has a shuffle partition for each ROWS_PER_PARTITION of
    them, so a task's memory doesn't grow with the input. Yields their number, or None
    where the session's is enough and nothing changes; its settings are put back."""
    partitions = -(-rows // ROWS_PER_PARTITION)
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = [spark.conf.get(name) for name in names]
    if partitions <= int(before[0]):
        yield None
        return
    try:
        for name, value in zip(names, (str(partitions), "false"), strict=True):
            spark.conf.set(name, value)
        yield partitions
    finally:
        for name, value in zip(names, before, strict=True):
            spark.conf.set(name, value)


def cut_by(df: DataFrame, *keys: str) -> DataFrame:
    """The cut frame, hash-partitioned by the ``keys``, for joins at every level of a search.

    The frame is first made by an adaptive plan and then dealt out by a fixed
    one. Joins on the keys with as many shuffle partitions leave it where it is.
    """
    made = cut(df)
    with fixed_plans(df.sparkSession):
        return cut(made.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys))
