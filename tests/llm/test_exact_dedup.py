import hashlib

from pyspark.sql import functions as F

from kinweave.llm.exact_dedup import exact_dedup
from tests.llm.helpers import odd_docs


def expected(rows):
    best, n = {}, {}
    for i, t in rows:
        n[t] = n.get(t, 0) + 1
        if i is not None:
            best[t] = max(best.get(t, i), i)
    return sorted(((i, best.get(t), n[t], i == best.get(t), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows), key=repr)


def result(found):
    rows = found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("h")).collect()
    return sorted(map(tuple, rows), key=repr)


def test_odd_rows(spark):
    df = odd_docs(spark)
    rows = [(r["doc_id"], r["text"] or "") for r in df.collect()]
    assert result(exact_dedup(df)) == expected(rows)
    assert exact_dedup(df.limit(0)).count() == 0


def test_shared_digest_compares_texts(spark):
    """A digest of one bit puts different texts together; the classes stay those of the texts."""
    rows = [(i, f"text {i % 7}") for i in range(60)] + [(99, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    weak = exact_dedup(df, digest=lambda t: F.unhex(F.lpad(F.pmod(F.crc32(t.cast("binary")), F.lit(2)).cast("string"), 2, "0")))
    got = sorted(tuple(r)[:4] for r in weak.collect())
    assert got == sorted(e[:4] for e in expected(rows))


def test_hot_group(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"t{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert result(exact_dedup(df)) == expected(rows)
