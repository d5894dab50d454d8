"""PageRank, clustering and components against plain versions, on skewed graphs and long chains."""

import random

import pytest

from kinweave.operators import measure
from kinweave.operators import relational as rel
from kinweave.plans import skew

SCHEMA = "follower_pubkey bigint, followed_pubkey bigint"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def plain_rank(edges, damping, tolerance):
    keys = sorted({k for e in edges for k in e})
    out = {k: [b for a, b in edges if a == k] for k in keys}
    rank, rounds = dict.fromkeys(keys, 1 / len(keys)), 0
    while True:
        rounds += 1
        got = dict.fromkeys(keys, 0.0)
        for k in keys:
            for b in out[k]:
                got[b] += rank[k] / len(out[k])
        idle = sum(rank[k] for k in keys if not out[k])
        new = {k: (1 - damping) / len(keys) + damping * (got[k] + idle / len(keys)) for k in keys}
        change = sum(abs(new[k] - rank[k]) for k in keys)
        rank = new
        if change < tolerance:
            return rank, rounds


@pytest.mark.parametrize("tolerance", [1e-2, 1e-6])
def test_ranks_equal_a_plain_iteration(spark, tolerance):
    r = random.Random(2)
    # A key that follows very many, one that many follow, a self-follow, keys that follow none, and a part of its own.
    edges = {(0, k) for k in range(1, 200)} | {(k, 300) for k in range(1, 80)} | {(5, 5), (900, 901), (901, 900)}
    edges |= {(r.randrange(200), r.randrange(200)) for _ in range(300)}
    want, _ = plain_rank(sorted(edges), 0.85, tolerance)
    got = {x["pubkey"]: x["rank"] for x in measure.pagerank(frame(spark, sorted(edges)), tolerance=tolerance).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want) and abs(sum(got.values()) - 1) < 1e-9


def test_rank_of_few_edges(spark):
    assert measure.pagerank(frame(spark, [(1, 2)]).limit(0)).count() == 0
    assert [x["rank"] for x in measure.pagerank(frame(spark, [(7, 7)])).collect()] == [pytest.approx(1.0)]


def test_a_round_shuffles_sums_only(spark, monkeypatch):
    """The plan of the last round: one exchange, that of the partial sums by followed key."""
    plans = []
    cut = measure.cut

    def noted(df):
        if "old" in df.columns:
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    monkeypatch.setattr(measure, "cut", noted)
    measure.pagerank(frame(spark, [(i % 40, (i * 7) % 41) for i in range(300)]), tolerance=0.1)
    assert plans and all(p.count("Exchange hashpartitioning") == 1 for p in plans), plans[-1]


def test_edges_are_made_once_and_rounds_join_keys(spark, monkeypatch):
    """The edges were made twice, for the degrees and to deal them out, and sorted anew each round."""
    made, plans, cut = spark.sparkContext.accumulator(0), [], measure.cut

    def noted(df):
        if "old" in df.columns:
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(measure, "cut", noted)
    edges = frame(spark, [(i % 40, (i * 7) % 41) for i in range(300)]).mapInArrow(count, SCHEMA)
    measure.pagerank(edges, tolerance=0.1)
    assert made.value == 300 and plans and not any("Sort" in p for p in plans), plans[-1]


def plain_clustering(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()), near.setdefault(b, set())
        if a != b:
            near[a].add(b)
            near[b].add(a)
    out = {}
    for k, n in near.items():
        t = sum(y in near[x] for x in n for y in n if x < y)
        out[k] = 2 * t / (len(n) * (len(n) - 1)) if len(n) > 1 else 0.0
    return out


def test_clustering_equals_a_count_of_pairs(spark):
    r = random.Random(5)
    edges = {(r.randrange(40), r.randrange(40)) for _ in range(260)} | {(77, 77), (78, 79), (79, 78)}
    got = {x["pubkey"]: x["coefficient"] for x in measure.clustering_coefficient(frame(spark, sorted(edges))).collect()}
    assert got == pytest.approx(plain_clustering(edges)) and got[77] == 0


def test_a_hub_is_not_squared(spark):
    """A star of 1,500 with a ring around it: pairs leading away from the hub would be a million."""
    n = 1500
    edges = [(0, k) for k in range(1, n + 1)] + [(k, k % n + 1) for k in range(1, n + 1)]
    found = measure.triangles(frame(spark, edges))
    got = {x["pubkey"]: (x["neighbours"], x["triangles"]) for x in found.collect()}
    assert got[0] == (n, n) and all(got[k] == (3, 2) for k in range(1, n + 1))
    degree = {k: v[0] for k, v in got.items()}
    away = {}
    for a, b in edges:
        low = min((degree[a], a), (degree[b], b))[1]
        away[low] = away.get(low, 0) + 1
    assert max(away.values()) <= 3


def plain_components(edges):
    up = {k: k for e in edges for k in e}

    def top(k):
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {k: top(k) for k in up}


def test_components_equal_union_find(spark):
    r = random.Random(8)
    edges = {(r.randrange(300), r.randrange(300)) for _ in range(170)} | {(1000, 1000)} | {(400, k) for k in range(401, 700)}
    got = {x["pubkey"]: x["component"] for x in measure.weak_components(frame(spark, sorted(edges))).collect()}
    assert got == plain_components(edges)
    assert measure.weak_components(frame(spark, [(3, 3)])).collect() == [(3, 3)]
    assert measure.weak_components(frame(spark, [(1, 2)]).limit(0)).count() == 0


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    """600 keys in a row: passing labels on needs as many rounds; contraction a few times the logarithm of them."""
    rounds, n = [], 600
    monkeypatch.setattr(skew, "HOT_SHARE", 1)
    counted = measure.cut_and_count
    monkeypatch.setattr(measure, "cut_and_count", lambda df: rounds.append(counted(df)) or rounds[-1])
    edges = frame(spark, [(i + 1, i) if i % 3 else (i, i + 1) for i in range(n)])
    assert {x["component"] for x in measure.weak_components(edges).collect()} == {0}
    sizes = [r for _, r in rounds]
    assert len(sizes) < 25 and sizes[-1] == 0 and all(b < a for a, b in zip(sizes, sizes[1:], strict=False))


def test_size_guesses_of_rounds_stay_short(spark, monkeypatch):
    """Guesses that are products of earlier ones grew to megabytes of digits, and planning never ended."""
    bits, made = [], measure.cut

    def cut(df):
        out = made(df)
        bits.append(out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length())
        return out

    monkeypatch.setattr(measure, "cut", cut)
    edges = frame(spark, [(i + 1, i) if i % 3 else (i, i + 1) for i in range(200)])
    assert {x["component"] for x in measure.weak_components(edges).collect()} == {0}
    assert len(bits) > 5 and max(bits) < 2000


def test_hot_keys_of_joins(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_SHARE", 4)
    rows = spark.createDataFrame([(0 if i % 2 else i, i) for i in range(100)] + [(999, -1)], "k int, i int")
    per_key = rows.filter("k <> 999").groupBy("k").count().withColumnRenamed("count", "n")
    found = skew.join_per_key(rows, per_key, "k", "n", 100)
    assert sorted((r["k"], r["i"], r["n"]) for r in found.collect()) == sorted((k, i, None if k == 999 else 51 if k == 0 else 1) for k, i in rows.collect())
    assert "BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()


def test_degrees_are_of_every_key(spark):
    assert {tuple(x) for x in rel.degrees(frame(spark, [(1, 2), (1, 3)])).collect()} == {(1, 2, 0), (2, 0, 1), (3, 0, 1)}
