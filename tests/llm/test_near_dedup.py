import random

import numpy as np
import pytest

from kinweave.llm import near_dedup as nd
from kinweave.llm.components import connected
from tests.llm.helpers import brute_components, odd_docs, shingle_set


def near_texts(r, groups=12, size=6, length=60):
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(groups):
        base = [r.choice(vocabulary) for _ in range(length)]
        for _ in range(size):
            own = list(base)
            for _ in range(r.randrange(8)):
                own[r.randrange(len(own))] = r.choice(vocabulary)
            out.append(" ".join(own))
    return out


def test_odd_rows(spark):
    df = odd_docs(spark, near_texts(random.Random(1), 3))
    texts = {r["doc_id"]: r["text"] for r in df.collect() if r["doc_id"] is not None}
    want = brute_components(texts, 2, 80)
    got = nd.near_duplicates(df, k=2).collect()
    assert len(got) == df.count()
    for row in got:
        i = row["doc_id"]
        if i is None:
            assert row["kept"] and row["component_id"] is None
        else:
            assert (row["n_shingles"], row["component_id"], row["kept"]) == (len(shingle_set(texts[i], 2)), want[i], want[i] == i)


def test_rows_that_share_an_id_keep_their_links(spark):
    r = random.Random(7)
    near = near_texts(r, 6, 4)
    rows = [(1, near[0]), (1, near[4]), (5, near[1]), (9, near[5]), (1, near[0]), (9, near[9]), (9, near[8]), (20, near[9]), (20, near[13])]
    rows += [(30 + i, t) for i, t in enumerate(near)] + [(None, near[2]), (None, "of its own"), (1, None), (1, ""), (2, "of its own")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    # Over rows, then the smallest id of the rows reached; rows without an id name nothing.
    top = brute_components({i: t for i, (_, t) in enumerate(rows)}, 2, 80)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[top[i]] = min(least.get(top[i], doc_id), doc_id)
    want = sorted((d, least[top[i]] if shingle_set(t, 2) else d, d == (least[top[i]] if shingle_set(t, 2) else d)) for i, (d, t) in enumerate(rows) if d is not None)
    got = nd.near_duplicates(df, k=2).collect()
    assert sorted((x["doc_id"], x["component_id"], x["kept"]) for x in got if x["doc_id"] is not None) == want
    assert len(got) == len(rows) and all(x["kept"] and x["component_id"] is None for x in got if x["doc_id"] is None)


@pytest.mark.parametrize("bound", ["BLOCK", "MEMBERS"])
def test_groups_equal_all_pairs(spark, monkeypatch, bound):
    """A large group of copies around the threshold, cut into many small blocks."""
    monkeypatch.setattr(nd, bound, {"BLOCK": 400, "MEMBERS": 7}[bound])
    monkeypatch.setattr(nd, "BROADCAST_IDS", 0)
    texts = dict(enumerate(near_texts(random.Random(4), 2, 45, 40) + near_texts(random.Random(5), 10, 4)))
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in nd.near_duplicates(df, k=2).collect()}
    assert got == brute_components(texts, 2, 80)


def test_empty_table(spark):
    assert nd.near_duplicates(odd_docs(spark).limit(0)).count() == 0


@pytest.mark.parametrize("k", [1, 3])
def test_shingles_are_whole_sequences_of_short_texts(k):
    assert nd.shingles("A b", 3) == {("a", "b")} and nd.shingles(None, k) == set() and nd.shingles("\t ", k) == set()


def test_posterior():
    assert nd.posterior_reaches(0, 0, 0.8) == pytest.approx(0.2)
    assert nd.posterior_reaches(16, 16, 0.8) == pytest.approx(1 - 0.8**17)
    least = nd.least_matches(0.8, 1e-7)
    assert (np.diff(least) >= 0).all() and 0 < least[-1] < 0.8 * nd.SIGNATURE
    r = np.random.default_rng(0)
    same = r.random((20_000, nd.SIGNATURE)) < 0.8
    assert nd.survives(same.astype(np.uint32), np.ones_like(same, np.uint32), least).all()


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a bigint, b bigint")
    assert {(r[0], r[1]) for r in connected(links).collect()} == {(i, 0) for i in range(61)} | {(100, 100), (101, 100)}
