"""Path patterns, merging and the compact form."""

import random

import pytest
from pyspark.sql import functions as F

from kinweave.analyzer import SocialGraphAnalyzer
from kinweave.operators import ingest as ing
from kinweave.operators.patterns import Step, match
from kinweave.sources import compact
from tests.graphs import ALICE, BOB, EDA, FOX, SUE, TOM, event
from tests.test_traverse import SCHEMA


def plain_match(edges, pattern):
    nodes = {k for e in edges for k in e}
    kinds = {"out": set(edges), "in": {(b, a) for a, b in edges}}
    kinds["any"], kinds["mutual"] = kinds["out"] | kinds["in"], kinds["out"] & kinds["in"]
    rows = {(k, k): 0 for k in nodes}
    for kind, low, high in pattern:
        level, out = rows, dict(rows) if low == 0 else {}
        for length in range(1, (high or 60) + 1):
            on = {}
            for (s, x), h in level.items():
                for a, b in kinds[kind]:
                    if a == x:
                        on[s, b] = min(h + 1, on.get((s, b), h + 1))
            level = on
            if length >= low:
                for k, h in level.items():
                    out[k] = min(h, out.get(k, h))
        rows = out
    return rows


@pytest.mark.parametrize("pattern", [[("out", 1, 1), ("in", 1, 1)], [("any", 0, 2), ("mutual", 1, 1)], [("out", 2, 3)], [("out", 1, None)], [("in", 0, None), ("out", 1, 1)]])
def test_patterns_equal_walks(spark, pattern):
    r = random.Random(4)
    edges = {(r.randrange(14), r.randrange(14)) for _ in range(26)} | {(1, 2), (2, 1), (3, 3)}
    rows = match(spark.createDataFrame(sorted(edges), SCHEMA), [Step(*p) for p in pattern]).collect()
    assert {(x["source"], x["target"]): x["hops"] for x in rows} == plain_match(edges, pattern) and len(rows) > 0


def test_conditions_starts_and_bad_steps(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (2, 4), (5, 2)], SCHEMA)
    starts = spark.createDataFrame([(1,), (1,), (9,)], "source bigint")
    got = match(df, [Step("out", where=F.col("node") < 3), Step("out", where=F.col("node") != 4)], starts).collect()
    assert [tuple(x) for x in got] == [(1, 3, 2)]
    for bad in ({"kind": "up"}, {"low": -1}, {"low": 3, "high": 2}, {"low": 0, "high": 0}):
        with pytest.raises(ValueError, match="step"):
            Step(**bad)


@pytest.mark.parametrize("folder", [False, True])
def test_merged_graphs_equal_ingestion_of_both(spark, tmp_path, folder):
    paths = [str(tmp_path / x) if folder else ":memory:" for x in "ab"]
    with SocialGraphAnalyzer.create(paths[0], spark=spark, strict=True) as a, SocialGraphAnalyzer.create(paths[1], spark=spark, strict=True) as b:
        a.ingest_lists([event(EDA, [FOX], 10), event(FOX, [SUE], 10), event(TOM, [BOB], 10), event(EDA, [BOB], 10, kind=10000)])
        b.ingest_lists([event(EDA, [SUE], 11), event(FOX, [BOB], 9), event(TOM, [ALICE], 10), event(BOB, [EDA], 1), event(EDA, [TOM, FOX], 11, kind=10000)])
        a.set_root_pubkey(EDA)
        assert a.get_shortest_distance(EDA, FOX) == 1
        assert a.merge(b) == 3  # follows of Eda and Bob, mutes of Eda
        assert {(r[0], r[1], r[2]) for r in a.follows.collect()} == {(EDA, SUE, 11), (FOX, SUE, 10), (TOM, BOB, 10), (BOB, EDA, 1)}
        assert a.get_muted_by(EDA) == sorted([TOM, FOX]) and a.merge(b) == 0
        assert a.get_shortest_distance(EDA, FOX) is None and a.get_shortest_distance(EDA, SUE) == 1


def test_merge_keeps_ours_of_equally_new_lists(spark):
    of = lambda rows: spark.createDataFrame(rows, "follower_pubkey string, followed_pubkey string, created_at bigint")
    ours, theirs = of([("a", "x", 1), ("b", "x", 2), ("b", "y", 2)]), of([("a", "y", 1), ("b", "z", 3), ("c", "x", 0)])
    assert {tuple(r) for r in ing.merge(ours, theirs).collect()} == {("a", "x", 1), ("b", "z", 3), ("c", "x", 0)}


def test_compact_form_gives_the_graph_back(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(compact, "BLOCK", 50)
    r = random.Random(6)
    rows = {(f"{r.randrange(300):064x}", f"{r.randrange(300):064x}") for _ in range(900)} | {("0" * 64, f"{i:064x}") for i in range(300)}
    edges = spark.createDataFrame([(a, b, 1000 + int(a, 16)) for a, b in sorted(rows)], "follower_pubkey string, followed_pubkey string, created_at bigint")
    path = str(tmp_path / "g")
    compact.write_compact(edges.repartition(5), path)
    assert {tuple(x) for x in compact.read_compact(spark, path).collect()} == {tuple(x) for x in edges.collect()}
    ids = spark.read.parquet(f"{path}/keys").orderBy("key").collect()
    assert [x["id"] for x in ids] == list(range(len({k for e in rows for k in e})))
    assert spark.read.parquet(f"{path}/lists").agg(F.max(F.size("steps"))).first()[0] <= 50
    edges.write.parquet(str(tmp_path / "plain"))
    size = lambda p: sum(f.stat().st_size for f in p.rglob("*.parquet"))
    assert size(tmp_path / "g") < 0.8 * size(tmp_path / "plain")


def test_compact_form_of_no_edges(spark, tmp_path):
    none = spark.createDataFrame([], "follower_pubkey string, followed_pubkey string, created_at bigint")
    compact.write_compact(none, str(tmp_path / "g"))
    assert compact.read_compact(spark, str(tmp_path / "g")).count() == 0
