import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from kinweave import fixtures as fx
from kinweave import queries as q
from tests.test_traverse import plain_bfs


def plain(rows):
    def value(v):
        return round(v, 9) if isinstance(v, float) else int(v) if hasattr(v, "__index__") and not isinstance(v, bool) else v

    return sorted((tuple(value(v) for v in r) for r in rows), key=repr)


def oracle(sf_dir, sql):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    found = con.sql(sql)
    names = [c[0] for c in found.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), plain([r[i] for i in order] for r in found.fetchall())


def same(df, sf_dir, sql):
    names = sorted(df.columns)
    assert (names, plain(df.select(*names).collect())) == oracle(sf_dir, sql)


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_query_equals_sql(spark, sf_dir, name):
    same(q.QUERIES[name](spark, sf_dir), sf_dir, q.SQL[name])


def test_entry_is_the_known_distribution(spark):
    assert {r["distance"]: r["count"] for r in entry.entry(spark).collect()} == {1: 5, 2: 16, 3: 36, 4: 55, 5: 33, 6: 2}


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(q.QUERIES) <= set(entry.queries())


def test_every_follower_is_a_source(spark, sf_dir):
    edges = [(r[0], r[1]) for r in fx.follow_edges(spark, sf_dir).select("follower_pubkey", "followed_pubkey").collect()]
    want = {(s, n, d) for s in {a for a, _ in edges} for n, (d, _) in plain_bfs(edges, s).items() if 0 < d <= 3}
    assert {(r["source"], r["node"], r["distance"]) for r in q.QUERIES["within_distance_all"](spark, sf_dir).collect()} == want


def test_paths_reach_every_level(spark, sf_dir):
    edges = [(r[0], r[1]) for r in fx.follow_edges(spark, sf_dir).select("follower_pubkey", "followed_pubkey").collect()]
    want = {n: (d, ">".join(map(str, p))) for n, (d, p) in plain_bfs(edges, q.ROOT).items() if d <= q.DEPTH}
    assert {r["target"]: (r["distance"], r["path"]) for r in q.QUERIES["shortest_path_all"](spark, sf_dir).collect()} == want
    assert max(d for d, _ in want.values()) == q.DEPTH
