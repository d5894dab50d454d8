"""All shortest paths, simple paths and routing tables against plain searches."""

import random

import pytest

from kinweave.operators import paths, traverse
from tests.test_traverse import SCHEMA, plain_bfs


def plain_simple(edges, source, target, most):
    near = {}
    for a, b in sorted(set(edges)):
        near.setdefault(a, []).append(b)
    out, stack = [], [[source]]
    while stack:
        p = stack.pop()
        for b in near.get(p[-1], []):
            if b == target and source != target:
                out.append([*p, b])
            elif b not in p and len(p) < most:
                stack.append([*p, b])
    return sorted(out)


@pytest.fixture(scope="module")
def graph(spark):
    r = random.Random(21)
    edges = sorted({(r.randrange(25), r.randrange(25)) for _ in range(70)} | {(50, 51), (51, 52), (50, 53), (53, 52), (52, 54), (3, 3)})
    pairs = [(r.randrange(25), r.randrange(25)) for _ in range(50)] + [(50, 54), (54, 50), (50, 50), (99, 1), (1, 99)]
    return edges, spark.createDataFrame(edges, SCHEMA).cache(), sorted(set(pairs))


def asked(spark, pairs):
    return spark.createDataFrame([*pairs, pairs[0]], "source bigint, target bigint")


@pytest.mark.parametrize("levels", [0, 2, 6])
def test_all_shortest_paths_and_their_number(spark, graph, levels):
    edges, df, pairs = graph
    want = {}
    for s, t in pairs:
        d = plain_bfs(edges, s).get(t, (None,))[0]
        if d is not None and d <= levels and (d or any(s in e for e in edges) or s == t):
            want[s, t] = [[s]] if s == t else [p for p in plain_simple(edges, s, t, d) if len(p) == d + 1]
    found = paths.all_shortest_paths(df, asked(spark, pairs), levels).collect()
    got = {}
    for r in found:
        got.setdefault((r["source"], r["target"]), []).append(list(r["path"]))
        assert r["distance"] == len(r["path"]) - 1
    assert {k: sorted(v) for k, v in got.items()} == want
    counted = paths.count_shortest_paths(df, asked(spark, pairs), levels).collect()
    assert {(r["source"], r["target"]): (r["distance"], r["paths"]) for r in counted} == {k: (len(v[0]) - 1, len(v)) for k, v in want.items()}
    if levels == 6:
        assert want[50, 54] == [[50, 51, 52, 54], [50, 53, 52, 54]] and max(map(len, want.values())) > 2


def test_numbers_of_paths_grow_without_being_walked(spark):
    """Nine diamonds in a row: 512 shortest paths, counted by sums."""
    edges = [e for i in range(9) for e in ((3 * i, 3 * i + 1), (3 * i, 3 * i + 2), (3 * i + 1, 3 * i + 3), (3 * i + 2, 3 * i + 3))]
    df = spark.createDataFrame(edges, SCHEMA)
    row = paths.count_shortest_paths(df, spark.createDataFrame([(0, 27)], "source bigint, target bigint"), 50).first()
    assert (row["distance"], row["paths"]) == (18, 2**9)


@pytest.mark.parametrize("most", [1, 4])
def test_simple_paths_equal_an_enumeration(spark, graph, most):
    edges, df, pairs = graph
    want = {(s, t, tuple(p)) for s, t in pairs for p in plain_simple(edges, s, t, most)}
    found = paths.simple_paths(df, asked(spark, pairs), most).collect()
    assert {(r["source"], r["target"], tuple(r["path"])) for r in found} == want and len(found) == len(want) > most


def test_paths_that_cannot_arrive_are_not_begun(spark, monkeypatch):
    """A hub before the target leads to 500 dead ends; none of them enters the frontier."""
    edges = [(0, 1), (1, 2), (2, 3)] + [(1, 100 + i) for i in range(500)] + [(100 + i, 700 + i) for i in range(500)]
    sizes, counted = [], paths.cut_and_count
    monkeypatch.setattr(paths, "cut_and_count", lambda df: sizes.append(counted(df)) or sizes[-1])
    df = spark.createDataFrame(edges, SCHEMA)
    found = paths.simple_paths(df, spark.createDataFrame([(0, 3)], "source bigint, target bigint"), 5).collect()
    assert [list(r["path"]) for r in found] == [[0, 1, 2, 3]] and max(n for _, n in sizes) < 10


def test_every_hop_shortens_the_way(spark, graph):
    edges, df, pairs = graph
    targets = spark.createDataFrame([(t,) for t in range(25)] + [(54,), (99,), (3,)], "target bigint")
    rows = paths.routing_table(df, targets, 5).collect()
    far = {s: plain_bfs(edges, s) for s in {a for e in edges for a in e}}
    want = {(s, t): far[s][t][0] for s in far for t in [*range(25), 54] if t in far[s] and 0 < far[s][t][0] <= 5}
    table = {(r["here"], r["there"]): (r["via"], r["len"]) for r in rows}
    assert {k: v[1] for k, v in table.items()} == want and len(rows) == len(table)
    for (here, there), (via, length) in table.items():
        assert (here, via) in edges and far[via][there][0] == length - 1
        assert via == min(b for a, b in edges if a == here and there in far[b] and far[b][there][0] == length - 1)
    walked = {(r["source"], r["target"]): list(r["path"]) for r in paths.follow_routes(paths.routing_table(df, targets, 5), asked(spark, pairs)).collect()}
    for s, t in pairs:
        full = far.get(s, {}).get(t)
        if s == t:
            assert walked[s, t] == [s]
        elif full and full[0] <= 5 and (t < 25 or t == 54):
            assert walked[s, t][0] == s and walked[s, t][-1] == t and len(walked[s, t]) == full[0] + 1
        else:
            assert (s, t) not in walked


@pytest.mark.parametrize("levels", [3, 4])
def test_only_pairs_in_reach_set_out(spark, graph, monkeypatch, levels):
    """Of many pairs (here: more than none), those out of reach are left out by a two-sided search; the results stay."""
    edges, df, pairs = graph
    monkeypatch.setattr(traverse, "BROADCAST_ROWS", 0)
    near = {(r["source"], r["target"]) for r in traverse.in_reach(df, asked(spark, pairs), levels).collect()}
    far = {s: plain_bfs(edges, s) for s, _ in pairs}
    assert near == {(s, t) for s, t in pairs if t in far[s] and far[s][t][0] <= levels}
    counts = {(r["source"], r["target"]): r["distance"] for r in paths.count_shortest_paths(df, asked(spark, pairs), levels).collect()}
    assert counts == {(s, t): far[s][t][0] for s, t in near}
