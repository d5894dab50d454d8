"""Root distances after removals: equal to a rebuild, and only what lost its path is touched."""

import random

import pytest

from kinweave.operators import traverse as trav
from tests.test_traverse import SCHEMA, plain_bfs


def frame(spark, rows):
    return spark.createDataFrame(sorted(rows), SCHEMA)


def distances(edges, depth):
    return {k: d for k, (d, _) in plain_bfs(sorted(edges), 0).items() if d <= depth}


@pytest.mark.parametrize("seed", range(2))
def test_refresh_equals_a_rebuild(spark, seed):
    r = random.Random(seed)
    depth = r.choice([3, 4, 6])
    edges = {(r.randrange(30), r.randrange(30)) for _ in range(r.choice([45, 70]))} | {(0, 1), (0, 2)}
    before = frame(spark, edges)
    table = trav.root_distances(before, 0, depth).cache()
    for _ in range(2):
        gone = set(r.sample(sorted(edges), 14))
        new = {(r.randrange(30), r.randrange(30)) for _ in range(r.choice([0, 3, 10]))}
        after = (edges - gone) | new
        df = frame(spark, after)
        lost, gained = trav.changes(before, df)
        assert {tuple(x) for x in lost.collect()} == edges - after and {tuple(x) for x in gained.collect()} == after - edges
        got = trav.refresh(df, table, lost, gained, depth)
        assert {x["pubkey"]: x["distance"] for x in got.collect()} == distances(after, depth)
        # Orphans are those whose distance, without what was gained, isn't what it was.
        old, less = distances(edges, depth), distances(edges - gone, 99)
        free = trav.orphans(frame(spark, edges - gone), table, frame(spark, gone), frame(spark, edges - gone))
        assert {x["pubkey"]: x["distance"] for x in free.collect()} == {k: d for k, d in old.items() if less.get(k) != d}
        edges, before, table = after, df, got.cache()


def test_only_the_keys_that_lost_their_path_are_looked_at(spark, monkeypatch):
    """A tree of 2,000 keys loses an edge near its leaves: 3 keys are set free, no more edges than theirs are read."""
    edges = {(i, 2 * i + k) for i in range(1000) for k in (1, 2)}
    table = trav.root_distances(frame(spark, edges), 0, 20).cache()
    sizes, counted = [], trav.cut_and_count
    monkeypatch.setattr(trav, "cut_and_count", lambda df: sizes.append(counted(df)) or sizes[-1])
    after = frame(spark, edges - {(249, 500)})
    got = trav.refresh(after, table, frame(spark, {(249, 500)}), frame(spark, {(1, 2)}).limit(0), 20)
    assert {x["pubkey"]: x["distance"] for x in got.collect()} == distances(edges - {(249, 500)}, 20)
    assert max(n for _, n in sizes) <= 4


def test_nothing_changed(spark):
    edges = {(0, 1), (1, 2)}
    table = trav.root_distances(frame(spark, edges), 0, 6)
    none = frame(spark, edges).limit(0)
    got = trav.refresh(frame(spark, edges), table, none, none, 6)
    assert {x["pubkey"]: x["distance"] for x in got.collect()} == {0: 0, 1: 1, 2: 2}
    # An edge that no shortest path used, and one to a key out of the table.
    got = trav.refresh(frame(spark, edges), table, frame(spark, {(2, 1), (9, 0), (7, 8)}), none, 6)
    assert {x["pubkey"]: x["distance"] for x in got.collect()} == {0: 0, 1: 1, 2: 2}
