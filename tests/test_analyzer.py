import pytest

from kinweave.analyzer import Degree, GraphStats, SocialGraphAnalyzer, SocialPath
from tests.graphs import (
    EDA, ALICE, BOB, CHAIN, COMPLEX, FOX, L1A, L1B, L2A, L2B, L3A, L3B, ROOT, TOM, SUE, event,
)


@pytest.fixture
def open_graph(spark):
    made = []

    def make(events=(), **more):
        out = SocialGraphAnalyzer.create(spark=spark, **more)
        out.ingest_events(events)
        made.append(out)
        return out

    yield make
    for x in made:
        x.close()


def test_chain(open_graph):
    g = open_graph(CHAIN)
    assert g.get_stats() == GraphStats(2, 2, 2)
    assert g.get_shortest_path(EDA, SUE) == SocialPath([EDA, FOX, SUE], 2)
    assert g.get_shortest_path(EDA, SUE, 1) is None and g.get_shortest_path(EDA, FOX, 1).distance == 1
    assert g.get_shortest_path(EDA, EDA) == SocialPath([EDA], 0) == g.get_shortest_path(EDA.upper(), EDA)
    assert g.get_shortest_path(SUE, EDA) is None and g.get_shortest_path(EDA, BOB) is None
    assert g.get_shortest_path(BOB, BOB).distance == 0
    assert g.get_shortest_distance(EDA, SUE) == 2 and g.get_shortest_distance(BOB, EDA) is None
    assert g.get_users_within_distance(EDA, 1) == [FOX]
    assert g.get_users_within_distance(EDA, 2) == [FOX, SUE]
    assert g.get_users_within_distance(BOB, 0) == [] and g.get_users_within_distance(BOB, 2) is None
    assert g.is_direct_follow(EDA, FOX.upper()) and not g.is_direct_follow(FOX, EDA)
    assert not g.are_mutual_follows(EDA, FOX)
    assert g.pubkey_exists(EDA) and not g.pubkey_exists(EDA.upper()) and not g.pubkey_exists("not a key")
    assert g.get_following(EDA) == [FOX] and g.get_followers(SUE) == [FOX]
    with pytest.raises(ValueError, match="Invalid pubkey format"):
        g.get_shortest_path("bad", EDA)


def test_complex(open_graph):
    g = open_graph(COMPLEX)
    assert g.get_shortest_distances_batch(EDA, [FOX, SUE, TOM, BOB, EDA, TOM.upper()]) == {
        FOX: 1, SUE: 1, TOM: 2, BOB: None, EDA: 0, TOM.upper(): 2,
    }
    assert g.get_shortest_distances_batch(BOB, [BOB, "bad"]) == {BOB: None, "bad": None}
    with pytest.raises(ValueError, match="Invalid pubkey"):
        g.get_shortest_distances_batch(EDA, ["bad"])
    assert g.get_shortest_distances_batch(EDA, []) == {}
    assert sorted(g.get_users_within_distance(EDA, 3)) == sorted([FOX, SUE, TOM])
    assert sorted(g.get_all_unique_pubkeys()) == sorted([EDA, FOX, SUE, TOM])
    assert g.are_mutual_follows(EDA, SUE) and g.get_pubkey_degree(EDA) == Degree(2, 2)
    assert g.get_pubkey_degree(BOB) == Degree(0, 0)


def test_empty_graph(open_graph):
    g = open_graph()
    assert g.get_stats() == GraphStats(0, 0, 0) and g.get_all_unique_pubkeys() == []
    assert g.get_shortest_path(EDA, BOB) is None and g.get_users_within_distance(EDA, 2) is None


def test_replacement_and_cycles(open_graph):
    g = open_graph([event(EDA, [FOX], 1000)])
    g.ingest_event(event(EDA, [SUE, EDA], 2000))
    assert g.get_stats().total_follows == 2 and g.get_shortest_path(EDA, FOX) is None
    assert g.is_direct_follow(EDA, EDA) and g.get_shortest_distance(EDA, EDA) == 0
    assert g.are_mutual_follows(EDA, EDA)


def test_lifecycle(spark):
    g = SocialGraphAnalyzer.connect(spark, max_depth=4)
    assert g.get_max_depth() == 4
    g.set_max_depth(None)
    assert g.get_max_depth() == 6
    for bad, kind in (("x", TypeError), (0, ValueError), (True, TypeError)):
        with pytest.raises(kind, match="maxDepth must be"):
            g.set_max_depth(bad)
    for call in (lambda: g.get_users_at_distance(1), g.get_distance_distribution, g.rebuild_root_distances):
        with pytest.raises(ValueError, match="Root pubkey must be set"):
            call()
    with g:
        assert not g.is_closed()
    g.close()
    assert g.is_closed() and g.get_max_depth() == 6 and g.get_root_pubkey() is None
    for call in (lambda: g.ingest_events([]), g.get_stats, lambda: g.get_shortest_path(EDA, BOB), lambda: g.set_root_pubkey(EDA)):
        with pytest.raises(RuntimeError, match="Analyzer has been closed"):
            call()
    assert spark.range(1).count() == 1  # the caller's session goes on


def test_bad_event_changes_nothing(open_graph):
    g = open_graph(CHAIN)
    with pytest.raises(ValueError):
        g.ingest_events([event(EDA, [BOB], 9000), event(BOB, [], kind=1)])
    assert g.get_stats() == GraphStats(2, 2, 2)


def test_root_layers_and_delta(open_graph):
    g = open_graph([event(ROOT, [L1A, L1B]), event(L1A, [L2A]), event(L1B, [L2B]), event(L2A, [L3A]), event(L2B, [L3B])])
    g.set_root_pubkey(ROOT.upper())
    assert g.get_root_pubkey() == ROOT
    assert g.get_distance_distribution() == {1: 2, 2: 2, 3: 2}
    assert sorted(g.get_users_at_distance(2)) == sorted([L2A, L2B]) and g.get_users_at_distance(0) == [ROOT]
    assert g.get_shortest_distance(ROOT, L3A, 1) == 3  # the table's depth counts, not the call's
    assert g.get_shortest_distances_batch(ROOT, [L3A, L3A.upper(), EDA]) == {L3A: 3, L3A.upper(): None, EDA: None}
    assert sorted(g.get_users_within_distance(ROOT, 1)) == sorted([L1A, L1B])
    g.ingest_event(event(ROOT, [L3B], 2000))
    # Shorter now; what lost its path keeps its distance until a rebuild.
    assert g.get_shortest_distance(ROOT, L3B) == 1 and g.get_shortest_distance(ROOT, L1A) == 1
    g.rebuild_root_distances()
    assert g.get_shortest_distance(ROOT, L1A) is None and g.get_distance_distribution() == {1: 1}


def test_delta_propagates_and_bad_author_invalidates(open_graph):
    g = open_graph(root_pubkey=ROOT)
    assert g.get_users_at_distance(0) == [ROOT] and g.get_distance_distribution() == {}
    g.ingest_events([event(ROOT, [L1A]), event(L1A, [L2A])])
    g.ingest_events([event(L2A, [L3A]), event(L3A, [L3B])])
    assert g.get_shortest_distance(ROOT, L3B) == 4
    g.ingest_events([event("not a key", [L1A]), event(L1B, [L2B])])
    assert g.get_shortest_distance(ROOT, L3B) == 4 and g.get_stats().total_follows == 6
    g.drop_root_distances()
    assert g.get_root_pubkey() is None


def test_snapshots_persist(spark, tmp_path):
    path = str(tmp_path / "graph")
    with SocialGraphAnalyzer.create(path, spark=spark, root_pubkey=EDA) as g:
        g.ingest_events(CHAIN)
    with SocialGraphAnalyzer.create(path, spark=spark) as g:
        assert g.get_stats() == GraphStats(2, 2, 2)
        built = g._store.metadata["root_built_at"]
        g.set_root_pubkey(EDA)
        assert g._store.metadata["root_built_at"] == built  # reused
        assert g.get_shortest_distance(EDA, SUE) == 2
        g.ingest_event(event(BOB, [ALICE]))
        g.drop_root_distances()
    with SocialGraphAnalyzer.create(path, spark=spark) as g:
        assert g.get_stats().total_follows == 3 and g._store.metadata["root_pubkey"] == "" and not g._store.has("root_distances")


def test_two_open_analyzers_see_each_other(spark, tmp_path):
    path = str(tmp_path / "graph")
    with SocialGraphAnalyzer.create(path, spark=spark) as one, SocialGraphAnalyzer.create(path, spark=spark) as two:
        one.ingest_events(CHAIN)
        assert two.get_stats() == GraphStats(2, 2, 2) and two.get_shortest_distance(EDA, SUE) == 2
        two.ingest_event(event(BOB, [ALICE]))
        one.ingest_event(event(ALICE, [BOB]))
        two.ingest_event(event(SUE, [BOB]))
        for g in (one, two):
            assert g.get_stats().total_follows == 5 and g.get_shortest_distance(EDA, ALICE, 4) == 4 and g.are_mutual_follows(ALICE, BOB)
        one.set_root_pubkey(EDA)
        two.set_root_pubkey(EDA)
        assert one.get_users_at_distance(2) == two.get_users_at_distance(2) == [SUE]
        two.drop_root_distances()
        assert one.get_users_at_distance(1) == [FOX]  # built again
        two.set_root_pubkey(BOB)
        assert two.get_users_at_distance(1) == [ALICE] and one.get_users_at_distance(1) == [FOX]


def test_stream_of_events(spark, tmp_path):
    import json

    from kinweave.plans import EVENTS
    from kinweave.streaming import ingest_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps(e) for e in CHAIN))
    g = SocialGraphAnalyzer.create(spark=spark)
    stream = spark.readStream.schema(EVENTS).json(str(tmp_path / "in"))
    query = ingest_stream(g, stream).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert g.get_stats() == GraphStats(2, 2, 2)


def test_stream_vacuums_as_it_goes(spark, tmp_path, monkeypatch):
    import json
    import os

    from kinweave.plans import EVENTS
    from kinweave.streaming import ingest_stream

    (tmp_path / "in").mkdir()
    for i in range(4):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps(event(EDA, [FOX, SUE][: 1 + i % 2], at=1000 + i)))
        os.utime(tmp_path / "in" / f"{i}.json", (1_000_000 + i, 1_000_000 + i))
    g = SocialGraphAnalyzer.create(str(tmp_path / "g"), spark=spark)
    plain = g.vacuum
    monkeypatch.setattr(g, "vacuum", lambda: plain(older_than=-10))
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = ingest_stream(g, stream, vacuum_every=2).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.lastProgress["batchId"] == 3
    assert len(list((tmp_path / "g").glob("manifest-*"))) == 1 and g.get_stats() == GraphStats(2, 1, 2)
