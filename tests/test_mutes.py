"""Mute lists beside the follows: ingestion, counts by distance, the overmute rule, removal."""

import pytest

from kinweave.analyzer import SocialGraphAnalyzer
from kinweave.operators import mutes as mut
from kinweave.operators import traverse as trav
from tests.graphs import ALICE, BOB, EDA, FOX, SUE, TOM, event


def mutes(author, keys, at=1000):
    return event(author, keys, at, kind=10000)


@pytest.fixture(params=["memory", "folder"])
def graph(spark, tmp_path, request):
    path = ":memory:" if request.param == "memory" else str(tmp_path / "g")
    with SocialGraphAnalyzer.create(path, spark=spark, strict=True) as g:
        yield g


def test_lists_of_both_kinds(graph):
    g = graph
    g.ingest_lists([event(EDA, [FOX, SUE]), mutes(EDA, [BOB, EDA, "x"]), event(FOX, [TOM, BOB]), mutes(SUE, [TOM]), mutes(FOX, [BOB]), {"kind": 1}, None])
    assert g.get_muted_by(EDA) == [BOB] and sorted(g.get_muters(BOB)) == sorted([EDA, FOX]) and g.get_stats().total_follows == 4
    # Only newer lists count, whatever their kind, and an empty one clears.
    g.ingest_lists([mutes(EDA, [TOM], 999), mutes(SUE, [], 1001), event(EDA, [TOM], 999)])
    assert g.get_muted_by(EDA) == [BOB] and g.get_muters(TOM) == [] and g.get_following(EDA) == sorted([FOX, SUE])
    g.set_root_pubkey(EDA)
    # Eda and Fox mute Bob; Fox follows him. Eda is nearer.
    assert g.get_mute_stats(BOB) == {0: (0, 1), 1: (1, 1)} and g.is_overmuted(BOB) and not g.is_overmuted(TOM)
    assert {tuple(r) for r in g.mute_counts().filter(f"pubkey = '{BOB}'").collect()} == {(BOB, 0, 0, 1), (BOB, 1, 1, 1)}
    # Lists of the overmuted and of strangers are ignored on request.
    g.ingest_lists([event(BOB, [SUE]), event(ALICE, [SUE]), event(TOM, [SUE])], known_authors_only=True, overmute_threshold=1)
    assert sorted(g.get_followers(SUE)) == sorted([EDA, TOM])
    assert g.get_shortest_distance(EDA, TOM) == 2


def test_removal_of_muted_keys_that_nobody_follows(graph):
    g = graph
    g.ingest_lists([event(EDA, [FOX]), event(BOB, [EDA, TOM]), mutes(FOX, [BOB, SUE]), mutes(BOB, [FOX]), event(ALICE, [SUE])])
    g.set_root_pubkey(BOB)
    assert g.get_shortest_distance(BOB, FOX) == 2
    assert g.remove_muted_not_followed() == 1  # Bob; Sue has a follower
    assert {(r[0], r[1]) for r in g.follows.select("follower_pubkey", "followed_pubkey").collect()} == {(EDA, FOX), (ALICE, SUE)}
    assert g.get_muters(SUE) == [FOX] and g.get_muters(BOB) == g.get_muted_by(BOB) == []
    assert g.get_shortest_distance(BOB, FOX) is None and g.remove_muted_not_followed() == 0


def test_strict_ingests_follow_up_without_a_rebuild(graph, monkeypatch):
    g = graph
    g.ingest_events([event(EDA, [FOX, SUE]), event(FOX, [TOM]), event(SUE, [TOM]), event(TOM, [BOB])])
    g.set_root_pubkey(EDA)
    monkeypatch.setattr(trav, "root_distances", lambda *_: pytest.fail("rebuilt"))
    far = lambda: {k: g.get_shortest_distance(EDA, k) for k in (FOX, SUE, TOM, BOB, ALICE)}
    g.ingest_events([event(FOX, [ALICE], 1001)])
    assert far() == {FOX: 1, SUE: 1, TOM: 2, BOB: 3, ALICE: 2}
    g.ingest_events([event(SUE, [], 1001), event(ALICE, [BOB])])
    assert far() == {FOX: 1, SUE: 1, TOM: None, BOB: 3, ALICE: 2}
    g.ingest_events([event(EDA, [BOB, TOM], 1001)])
    assert far() == {FOX: None, SUE: None, TOM: 1, BOB: 1, ALICE: None}


def test_frames_equal_lists(graph):
    g = graph
    g.ingest_events([event(EDA, [FOX, SUE]), event(FOX, [TOM])])
    g.set_root_pubkey(EDA)
    keys = lambda what, *a: sorted(r["pubkey"] for r in g.frame(what, *a).collect())
    assert keys("all_unique_pubkeys") == sorted(g.get_all_unique_pubkeys()) and keys("users_at_distance", 1) == sorted([FOX, SUE])
    assert keys("users_within_distance", EDA, 2) == sorted([FOX, SUE, TOM]) and keys("following", EDA) == sorted([FOX, SUE]) and keys("followers", TOM) == [FOX]
    with pytest.raises(ValueError, match="no list"):
        g.frame("x")


def test_the_nearest_distance_decides(spark):
    rows = [("a", 1, 3, 3), ("a", 2, 0, 9), ("b", 2, 1, 2), ("b", 3, 9, 0), ("c", 1, 0, 0)]
    counts = spark.createDataFrame(rows[:4], "pubkey string, distance int, followers bigint, muters bigint")
    assert {r["pubkey"] for r in mut.overmuted(counts).collect()} == {"b"} and {r["pubkey"] for r in mut.overmuted(counts, 1.5).collect()} == {"a", "b"}
    assert {r["pubkey"] for r in mut.overmuted(counts, 0.4).collect()} == set()
