"""Helpers shared by the operators: tables, scratch folders, ASCII lower-casing."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.plans.lineage import shared_root

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders that this process has made, in order.
MADE: list[str] = []


def scratch(spark: SparkSession, purpose: str) -> str:
    """A new path in the folder that the driver and all executors share.

    The folder is the session's ``spark.checkpoint.dir``. Where that is unset, a
    local folder is made if all tasks run in this process (tests, a laptop);
    on a cluster that is an error.
    """
    MADE.append(f"{shared_root(spark).rstrip('/')}/kinweave-{purpose}-{uuid.uuid4().hex}")
    return MADE[-1]


def remove_made(spark: SparkSession, since: int, keep: int = 0) -> None:
    """Removes the folders made after the first ``since``, but for the last ``keep``.

    Results that read them must have been written or used by then."""
    gone = MADE[since : len(MADE) - keep]
    for path in gone:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        MADE.remove(path)


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the shared folder once and read back: its lineage ends
    there, and a lost executor loses nothing that other stages need."""
    path = scratch(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of an Arrow batch, so a batch of long texts fits a worker's memory.
BATCH_ROWS = 256


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, after lowering its session's Arrow batches to BATCH_ROWS rows.

    The setting is read when the plan runs, so it stays lowered."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = int(df.sparkSession.conf.get(name))
    if rows <= 0 or rows > BATCH_ROWS:
        df.sparkSession.conf.set(name, str(BATCH_ROWS))
    return df


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(text, UPPER, LOWER)


def columns_only(df: DataFrame, *names: str) -> DataFrame:
    """Just the named columns, so that extra ones can't clash with the operator's."""
    return df.select(*[F.col(f"`{n}`") for n in names])


#: A key counts as hot if more than one in HOT_SHARE of the rows have it, so
#: there are at most HOT_SHARE hot keys in an input of any size.
HOT_SHARE = 1000


def join_per_key(rows: DataFrame, per_key: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Left join of many ``rows`` with small rows, one ``per_key``, safe from hot keys.

    ``count`` is how many of the ``total`` rows have the key. The at most
    HOT_SHARE rows of hot keys are broadcast, so hot rows aren't shuffled; the
    rest is joined by a shuffle on the key.
    """
    names = [c for c in per_key.columns if c != key]
    is_hot = F.col(count) * HOT_SHARE > F.lit(total)
    hot = per_key.filter(is_hot).withColumnsRenamed({n: f"_hot_{n}" for n in names})
    tried = rows.join(F.broadcast(hot), key, "left")
    found = tried.filter(f"_hot_{count} is not null").withColumnsRenamed({f"_hot_{n}": n for n in names})
    rest = tried.filter(f"_hot_{count} is null").drop(*[f"_hot_{n}" for n in names])
    return found.unionByName(rest.join(per_key.filter(~is_hot), key, "left"))
