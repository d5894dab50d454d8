import os
import random
import time

import pytest
from pyspark.sql import functions as F

from kinweave.operators import ingest as ing
from kinweave.sources.store import SnapshotStore, Taken


def edges(spark, rows):
    return spark.createDataFrame([(a, b, 1) for a, b in rows], "follower_pubkey string, followed_pubkey string, created_at bigint")


def replace(store, spark, rows):
    new = edges(spark, rows)
    store.update("follows", new.select("follower_pubkey"), lambda old: ing.replace_lists(old, new), {"n": str(len(rows))})


def plain(df):
    return {(r[0], r[1]) for r in df.select("follower_pubkey", "followed_pubkey").collect()}


def test_one_author_writes_one_bucket(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"), buckets=8)
    rows = [(f"a{i}", f"b{j}") for i in range(40) for j in range(3)]
    replace(store, spark, rows)
    before = dict(store._folders["follows"])
    assert len(before) > 4
    replace(store, spark, [("a7", "z")])
    after = store._folders["follows"]
    assert sum(before[b] != after[b] for b in after) == 1 and before.keys() == after.keys()
    assert plain(store.table("follows")) == {r for r in rows if r[0] != "a7"} | {("a7", "z")}
    # A bucket that loses its last row has no folder any more.
    store.update("follows", edges(spark, [(f"a{i}", "") for i in range(40)]).select("follower_pubkey"), lambda old: old.limit(0), {})
    assert store._folders["follows"] == {} and store.has("follows") and store.table("follows").count() == 0


def test_writers_that_race_lose_nothing(spark, tmp_path):
    path = str(tmp_path / "s")
    one, two = SnapshotStore(spark, path, buckets=4), SnapshotStore(spark, path)
    replace(one, spark, [("a", "b")])
    # Two hasn't seen the commit, and repeats its change on the new state.
    replace(two, spark, [("c", "d")])
    replace(one, spark, [("a", "e")])
    two.commit({}, {"x": "y"})
    one.refresh()
    assert two.buckets == 4 and one.metadata["x"] == "y" and plain(one.table("follows")) == plain(two.table("follows")) == {("a", "e"), ("c", "d")}
    with pytest.raises(Taken):
        stale = SnapshotStore(spark, path)
        stale._version -= 1
        stale._publish(stale._folders, stale.metadata)
    assert len(list((tmp_path / "s").glob("manifest-*"))) == 4 and not list((tmp_path / "s").glob("_part*"))


def test_vacuum_keeps_what_manifests_name(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"), buckets=2)
    for i in range(4):
        replace(store, spark, [("a", f"b{i}"), (f"c{i}", "d")])
    want = plain(store.table("follows"))
    assert not [x for x in store.vacuum() if not x.startswith("manifest")]  # all folders are young
    left = len(list((tmp_path / "s").glob("follows-*")))
    assert len(store.vacuum(older_than=-10)) > 0 and len(list((tmp_path / "s").glob("follows-*"))) < left
    again = SnapshotStore(spark, str(tmp_path / "s"))
    assert plain(again.table("follows")) == plain(store.table("follows")) == want


def test_vacuum_leaves_what_reads_and_commits_under_way_need(spark, tmp_path):
    path = tmp_path / "s"
    store = SnapshotStore(spark, str(path), buckets=4)
    replace(store, spark, [(f"a{i}", "b") for i in range(20)])
    reader = SnapshotStore(spark, str(path))
    late = SnapshotStore(spark, str(path))
    for i in range(3):
        replace(store, spark, [("a1", f"c{i}")])
    # All were replaced just now, whatever the age of their files.
    hours_ago = time.time() - 7200
    for folder in path.glob("follows-*"):
        os.utime(folder, (hours_ago, hours_ago))
    assert store.vacuum() == []
    assert plain(reader.table("follows")) == {(f"a{i}", "b") for i in range(20)}
    # Replaced long ago: of the first folder only the bucket goes that is no longer named.
    gone = store.vacuum(older_than=-10)
    assert sum(x.startswith("manifest-") for x in gone) == 3 and sum("/bucket=" in x for x in gone) == 1
    now = {(f"a{i}", "b") for i in range(20) if i != 1} | {("a1", "c2")}
    assert plain(SnapshotStore(spark, str(path)).table("follows")) == now
    # The number after a stale writer's own is free again, but isn't taken.
    with pytest.raises(Taken):
        late._publish(late._folders, late.metadata)
    late.commit({}, {"late": "yes"})
    store.refresh()
    assert store.metadata["late"] == "yes" and plain(store.table("follows")) == now
    assert len(SnapshotStore(spark, str(path))._manifests()) == 2


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.mark.parametrize("key", ["follower_pubkey", "followed_pubkey"])
def test_a_level_shuffles_no_edges(spark, tmp_path, key):
    store = SnapshotStore(spark, str(tmp_path / "s"), buckets=4)
    r = random.Random(1)
    replace(store, spark, [(f"a{r.randrange(50)}", f"a{r.randrange(50)}") for _ in range(300)])
    dealt = store.dealt("follows", key)
    rows = spark.range(1000).select(F.concat(F.lit("a"), F.col("id") % 50).alias(key), "id").hint("merge")
    assert exchanges(dealt.join(rows, key)) == 1 and exchanges(store.table("follows").join(rows, key)) == 2
    assert store.dealt("follows", key) is dealt
    replace(store, spark, [("a1", "a2")])
    assert store.dealt("follows", key) is not dealt


def test_write_tasks_follow_the_rows(spark, tmp_path):
    """One author with most rows is written by several tasks, and small buckets don't get a file each per task."""
    store = SnapshotStore(spark, str(tmp_path / "s"), buckets=4)
    conf = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "64k")
    try:
        rows = spark.range(40_000).select(F.lit("hub").alias("follower_pubkey"), F.sha2(F.col("id").cast("string"), 256).alias("followed_pubkey"), F.lit(1).cast("bigint").alias("created_at"))
        store.update("follows", rows.select("follower_pubkey").limit(1), lambda old: rows, {})
    finally:
        spark.conf.set(conf, before)
    assert len(list((tmp_path / "s").glob("follows-*/bucket=*/*.parquet"))) > 3 and store.table("follows").count() == 40_000
