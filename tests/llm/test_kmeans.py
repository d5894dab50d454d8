"""Lloyd rounds against a plain version in Python integers."""

import hashlib
import math
import random

import pytest

from kinweave.llm.kmeans import lloyd

SCHEMA = "vec_id bigint, embedding array<float>, cluster string, distance string"


def plain(rows, k, rounds, seed, dims):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: (i is None, hashlib.sha256(f"{seed}:{i}".encode()).hexdigest() if i is not None else "")
    centroids = [q for _, q in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]
    far = lambda q, c: sum((a - b) ** 2 for a, b in zip(q, c, strict=True))
    assign = lambda: [min(range(len(centroids)), key=lambda j: (far(q, centroids[j]), j)) for _, q in kept]
    for _ in range(rounds):
        to = assign()
        for j in range(len(centroids)):
            own = [q for (_, q), c in zip(kept, to, strict=True) if c == j]
            if own:
                centroids[j] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    to = assign()
    distance = [far(q, centroids[c]) for (_, q), c in zip(kept, to, strict=True)]
    own = [sum(d for d, c in zip(distance, to, strict=True) if c == j) for j in range(len(centroids))]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    out = [(i, c, d, own[c], sum(distance), digests[c]) for (i, _), c, d in zip(kept, to, distance, strict=True)]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("seed", "k", "dims", "n"), [(3, 8, 64, 60), (1, 3, 2, 90), (2, 5, 4, 4)])
def test_equals_plain_rounds(spark, seed, k, dims, n):
    r = random.Random(seed)
    # Few different values, so that many vectors are equal and many distances tie.
    rows = [(i, [r.choice([-1.5, -0.001, 0.0, 0.25, 1.0]) for _ in range(dims)]) for i in range(n)]
    rows += [(2**60 + 1, [0.1] * dims), (5, [0.5] * dims), (None, [0.5] * dims), (None, [-0.5] * dims), (7, rows[0][1]), (8, rows[0][1])]
    odd = [(100, None), (101, []), (102, [0.0] * (dims - 1)), (103, [0.0] * (dims + 1)), (104, [None] + [0.0] * (dims - 1))]
    odd += [(105, [float("nan")] * dims), (106, [float("inf")] + [0.0] * (dims - 1)), (107, [float("-inf")] * dims)]
    df = spark.createDataFrame([(i, v, "clash", "clash") for i, v in rows + odd], SCHEMA)
    got = lloyd(df.repartition(3), k=k, rounds=4, seed=seed, dims=dims)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((tuple(x) for x in got.collect()), key=repr) == plain(rows + odd, k, 4, seed, dims)


def test_empty_tables_and_large_components(spark):
    none = spark.createDataFrame([(1, None, "", ""), (2, [1.0], "", "")], SCHEMA)
    assert lloyd(none).count() == lloyd(none.limit(0)).count() == 0
    edge = [(1, [131072.0] * 64, "", ""), (2, [-131072.0] * 64, "", "")]
    got = {r["vec_id"]: r["distance"] for r in lloyd(spark.createDataFrame(edge, SCHEMA), k=1).collect()}
    assert got == {1: 64 * 2**54, 2: 64 * 2**54}
    with pytest.raises(Exception, match="131072"):
        lloyd(spark.createDataFrame([(1, [131073.0] * 64, "", "")], SCHEMA)).collect()
