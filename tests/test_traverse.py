import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from kinweave import queries as q
from kinweave.operators import relational as rel
from kinweave.operators import traverse as trav
from kinweave.plans import lineage

SCHEMA = "follower_pubkey bigint, followed_pubkey bigint"


def plain_bfs(edges, start):
    out, queue = {start: (0, [start])}, deque([start])
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
    while queue:
        level = list(queue)
        queue.clear()
        best = {}
        for n in level:
            for m in near.get(n, ()):
                if m not in out:
                    p = out[n][1] + [m]
                    best[m] = min(best.get(m, p), p)
        for m, p in best.items():
            out[m] = (len(p) - 1, p)
            queue.append(m)
    return out


@pytest.fixture(scope="module")
def graph(spark):
    r = random.Random(11)
    edges = sorted({(r.randrange(40), r.randrange(40)) for _ in range(75)})
    return edges, spark.createDataFrame(edges, SCHEMA).cache()


def test_paths_and_distances_equal_plain_search(graph):
    edges, df = graph
    want = plain_bfs(edges, 3)
    got = {r["node"]: (r["distance"], r["path"]) for r in trav.single(df, 3, 40, with_path=True).collect()}
    assert got == want


def test_two_sided_search_equals_plain_search(graph):
    edges, df = graph
    want = plain_bfs(edges, 3)
    for target in list(range(0, 40, 4)) + [99]:
        got = trav.shortest(df, 3, target, 40, with_path=True)
        assert (got and (got["distance"], got["path"])) == want.get(target)
    assert trav.shortest(df, 3, 3, 2) == {"distance": 0}


def test_many_sources(graph, spark):
    edges, df = graph
    seeds = spark.createDataFrame([(1,), (2,), (99,), (1,)], "source bigint")
    got = {(r["source"], r["node"]): r["distance"] for r in trav.within(df, seeds, 3).collect()}
    want = {(s, n): d for s in (1, 2, 99) for n, (d, _) in plain_bfs(edges, s).items() if 0 < d <= 3}
    assert got == want


@pytest.mark.parametrize("depth", [0, 1, 2, 3, 4, 5, 6])
def test_depth_contract_on_a_chain(spark, depth):
    chain = spark.createDataFrame([(i, i + 1) for i in range(6)], SCHEMA)
    for d in (1, 2, 3, 5, 6):
        row = trav.shortest(chain, 0, d, depth)
        found = d == 1 or (d == 2 and depth >= 2) or (d >= 3 and d <= 2 * (depth // 2))
        assert (row["distance"] if row else None) == (d if found else None)


def test_relax_only_lowers(spark):
    before = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], SCHEMA)
    table = trav.root_distances(before, 0, 6)
    after = spark.createDataFrame([(0, 5), (5, 3), (1, 2), (2, 3)], SCHEMA)  # 0 no longer follows 1
    changed = spark.createDataFrame([(0,), (5,)], "pubkey bigint")
    got = {r[0]: r[1] for r in trav.relax(after, table, changed, 6).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 2, 5: 1}


def test_lookups(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 3), (4, 1)], SCHEMA).cache()
    assert rel.graph_stats(df).first().asDict() == {"total_follows": 5, "unique_followers": 3, "unique_followed": 3}
    assert rel.graph_stats(df.limit(0)).first().asDict() == {"total_follows": 0, "unique_followers": 0, "unique_followed": 0}
    assert {tuple(r) for r in rel.degrees(df).collect()} == {(1, 2, 3), (2, 2, 1), (3, 0, 1), (4, 1, 0)}
    assert tuple(rel.degree_of(df, 1).first()) == (2, 3) and tuple(rel.degree_of(df, 9).first()) == (0, 0)
    assert [tuple(r) for r in rel.mutual_follows(df).collect()] == [(1, 2)]
    assert rel.are_mutual(df, 1, 2) and rel.are_mutual(df, 1, 1) and not rel.are_mutual(df, 2, 2) and not rel.are_mutual(df, 1, 4)
    assert rel.both_exist(df, 3, 4) and not rel.both_exist(df, 3, 9) and not rel.both_exist(df.limit(0), 1, 2)
    assert [r[0] for r in rel.following(df, 1).collect()] == [1, 2] and [r[0] for r in rel.followers(df, 1).collect()] == [1, 2, 4]


def test_plans_have_no_cross_join_and_push_filters(spark, tmp_path):
    spark.createDataFrame([("a", "b", 1)], "follower_pubkey string, followed_pubkey string, created_at bigint").write.parquet(str(tmp_path / "e"))
    df = spark.read.parquet(str(tmp_path / "e"))
    plan = rel.mutual_follows(df)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    plan = rel.following(df, "a")._jdf.queryExecution().toString()
    assert "EqualTo(follower_pubkey,a)" in plan and "created_at" not in plan.split("ReadSchema")[1]


def test_partitioned_edges_are_not_shuffled_again(spark):
    from kinweave.plans import cut_by

    edges = cut_by(spark.createDataFrame([(i, i + 1) for i in range(50)], SCHEMA), "follower_pubkey")
    other = spark.range(50).selectExpr("id AS follower_pubkey").hint("merge")
    plan = edges.join(other, "follower_pubkey")._jdf.queryExecution().sparkPlan().toString()
    executed = edges.join(other, "follower_pubkey")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and executed.count("Exchange hashpartitioning") == 1


def text_edges(spark, rows):
    return spark.createDataFrame(rows, "follower_pubkey string, followed_pubkey string")


def skewed(r, hub=2000, rest=8000):
    """A hub that a fifth of all edges lead to, another that as many leave."""
    out = {(f"f{i}", "hub") for i in range(hub)} | {("star", f"t{i}") for i in range(hub)} | {("hub", "star"), ("hub", "x1")}
    names = [f"f{i}" for i in range(300)] + [f"t{i}" for i in range(300)] + [f"x{i}" for i in range(400)]
    while len(out) < hub * 2 + rest:
        out.add((r.choice(names), r.choice(names)))
    return sorted(out)


@pytest.mark.parametrize("small", [True, False])
def test_hot_keys(spark, monkeypatch, small):
    rows = skewed(random.Random(4))
    edges = text_edges(spark, rows).cache()
    monkeypatch.setattr(trav, "BROADCAST_ROWS", 20_000 if small else 0)
    steps = rel.Steps(edges, backward=True)
    assert {x["node"] for x in steps.hot().collect()} == {"hub"} and {x["node"] for x in rel.Steps(edges).hot().collect()} == {"star"}
    sources = ["f1", "f2", "hub", "x1", "nobody"]
    seeds = spark.createDataFrame([(x,) for x in sources], "source string")
    got = {(x["source"], x["node"]): x["distance"] for x in trav.breadth_first(edges, seeds, 3).collect()}
    want = {(s, n): d for s in sources for n, (d, _) in plain_bfs(rows, s).items() if d <= 3}
    assert got == want
    via = {}
    follows = {}
    for a, b in rows:
        follows.setdefault(a, []).append(b)
    for a in sources:
        for m in follows.get(a, []):
            for b in follows.get(m, []):
                via[a, b] = via.get((a, b), 0) + 1
    assert {(x["source"], x["target"]): x["via"] for x in rel.two_hop(edges, seeds).collect()} == via
    pairs = [(s, t) for s in sources for t in ("t5", "hub", "star", "x2", "f1", "nobody")]
    asked = spark.createDataFrame(pairs, "source string, target string")
    found = {(x["source"], x["target"]): (x["distance"], list(x["path"])) for x in trav.shortest_pairs(edges, asked, 6, True).collect()}
    for s, t in pairs:
        full = plain_bfs(rows, s).get(t)
        assert found.get((s, t)) == ((full[0], list(full[1])) if full and full[0] <= 6 else None), (s, t)
    mids = {(x["source"], x["target"]): x["mid"] for x in rel.two_hop_pairs(edges, asked).collect()}
    for s, t in pairs:
        between = [m for m in follows.get(s, []) if t in follows.get(m, [])]
        assert mids.get((s, t)) == min(between, default=None)


def test_a_hot_key_is_spread_over_tasks(spark):
    """No task of the join gets more than a small share of the hub's edges."""
    edges = text_edges(spark, [(f"f{i}", "hub") for i in range(20_000)] + [(f"f{i}", f"x{i % 500}") for i in range(20_000)])
    steps = rel.Steps(edges, backward=True)
    rows = spark.createDataFrame([("hub", 1), ("x1", 1)], "node string, origin int")
    found = steps.join(rows, False)
    plan = found._jdf.queryExecution().toString()
    assert found.count() == 20_040 and "salt" in plan


def test_a_celebrity_is_dealt_out(spark, monkeypatch):
    """A key with a fifth of all followers: no partition holds its edges, and joins don't shuffle any."""
    edges = text_edges(spark, [(f"f{i}", "hub") for i in range(4000)] + [(f"f{i}", f"x{i % 700}") for i in range(16_000)])
    dealt = rel.Dealt(edges, backward=True)
    assert [r["node"] for r in dealt.keys.collect()] == ["hub"]
    for part in (dealt.cold, dealt.hot):
        sizes = [r["count"] for r in part.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert len(sizes) == 4 and max(sizes) < 2 * sum(sizes) / 4
    rows = spark.createDataFrame([("hub", 1), ("x1", 1), ("f1", 2)], "node string, origin int").hint("merge")
    steps = rel.Steps(dealt, True)
    found = steps.join(rows, False)
    want = 4000 + sum(i % 700 == 1 for i in range(16_000))
    assert found.count() == steps.join(rows, True).count() == want
    # One exchange of the rows for the cold edges, one for the salted ones; none of the edges.
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    monkeypatch.setattr(trav, "BROADCAST_ROWS", 0)
    asked = spark.createDataFrame([("f1", "hub"), ("f2", "x2"), ("f1", "f2"), ("hub", "f1")], "source string, target string")
    got = {(r["source"], r["target"]): r["distance"] for r in trav.shortest_pairs(edges, asked, 4, backward=dealt).collect()}
    assert got == {("f1", "hub"): 1, ("f2", "x2"): 1}
    with pytest.raises(ValueError, match="other end"):
        rel.Steps(dealt)


def test_a_source_with_many_targets_multiplies_no_edge(spark, monkeypatch):
    """Pairs used to be put beside the edge with fewer nodes, though each of them had all of these."""
    pairs = spark.createDataFrame([(0, k) for k in range(100, 300)], "source bigint, target bigint")
    there = spark.createDataFrame([(0, k) for k in range(1, 51)], "source bigint, node bigint")
    here = pairs.select("target", (F.col("target") % 50).alias("node"))
    assert trav._cheaper_end(pairs, there, here) == "target"
    swap = {"source": "target", "target": "source"}
    turned = [x.select(*[F.col(c).alias(swap.get(c, c)) for c in x.columns]) for x in (pairs, here, there)]
    assert trav._cheaper_end(*turned) == "source"
    for asked, one, two in ((pairs, there, here), turned):
        want = {(r["source"], r["target"], r["node"]) for r in asked.join(one, "source").join(two, ["target", "node"]).collect()}
        assert {(r["source"], r["target"], r["node"]) for r in trav._meeting(asked, one, two).collect()} == want and len(want) == 196


def test_one_search_serves_all_depths(spark, sf_dir, monkeypatch):
    calls, search = [], trav.shortest_pairs
    monkeypatch.setattr(trav, "shortest_pairs", lambda *a, **k: calls.append(a) or search(*a, **k))
    got = q.QUERIES["shortest_by_depth"](spark, sf_dir)
    assert len(calls) == 1
    edges, pairs = calls[0][0], calls[0][1]
    for depth in (0, 1, 3):
        want = {(r["target"], r["distance"]) for r in search(edges, pairs, depth).collect()}
        assert {(r["target"], r["distance"]) for r in got.filter(F.col("max_depth") == depth).collect()} == want


@pytest.mark.parametrize("backward", [False, True])
def test_partitions_follow_a_levels_rows(spark, monkeypatch, backward):
    """With a fixed number of partitions, a task's share of a level grew with the input."""
    made, counted = [], trav.cut_and_count

    def noted(df):
        out, rows = counted(df)
        made.append((out.rdd.getNumPartitions(), rows))
        return out, rows

    monkeypatch.setattr(trav, "cut_and_count", noted)
    monkeypatch.setattr(trav, "BROADCAST_ROWS", 10)
    monkeypatch.setattr(lineage, "ROWS_PER_PARTITION", 100)
    before = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    r = random.Random(3)
    rows = sorted({(r.randrange(60), r.randrange(60)) for _ in range(200)})
    edges = spark.createDataFrame(rows, SCHEMA).cache()
    keys = sorted({a for a, _ in rows})
    if backward:
        pairs = spark.createDataFrame([(a, b) for a in keys for b in keys], "source bigint, target bigint")
        got = {(x["source"], x["target"]): x["distance"] for x in trav.shortest_pairs(edges, pairs, 4, backward=rel.Dealt(edges, backward=True)).collect()}
        want = {(s, n): d for s in keys for n, (d, _) in plain_bfs(rows, s).items() if d <= 4 and n in keys}
    else:
        got = {(x["source"], x["node"]): x["distance"] for x in trav.within(edges, edges.selectExpr("follower_pubkey AS source"), 3).collect()}
        want = {(s, n): d for s in keys for n, (d, _) in plain_bfs(rows, s).items() if 0 < d <= 3}
        assert all(parts * 100 >= n for parts, n in made if n > 400) and max(parts for parts, _ in made) > 8, made
    assert got == want
    assert max(parts for parts, _ in made) > 4 and before == {c: spark.conf.get(c) for c in before}


def test_rows_of_a_level_are_counted(spark):
    rows = skewed(random.Random(4), 200, 800)
    edges = text_edges(spark, rows)
    at = spark.createDataFrame([(1, "star"), (2, "star"), (1, "hub"), (1, "nobody")], "source int, node string")
    for steps in (rel.Steps(edges), rel.Steps(rel.Dealt(edges))):
        assert steps.rows_of(at) == steps.join(at, False).count() == steps.join(at, False, 7).count() > 400 and steps.rows_of(at.limit(0)) == 0
        assert "hashpartitioning(node#" in (plan := steps.join(at, False, 7)._jdf.queryExecution().executedPlan().toString()) and ", 7)" in plan
