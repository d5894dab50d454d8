"""Registered queries against their SQL on the smallest tables, and the pipeline against brute force."""

import hashlib

import pytest

import corpus_pipeline
from kinweave.llm import queries as q
from kinweave.llm.common import MADE
from tests.llm.helpers import brute_components, odd_docs
from tests.test_queries import same


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in q.QUERIES.items() if sql))
def test_query_equals_sql(spark, sf_dir, name):
    same(q.QUERIES[name][0](spark, sf_dir), sf_dir, q.QUERIES[name][1])


def test_pipeline_equals_brute_force(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = [" ".join(r["text"].lower().split()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    left = {i: t for i, t in docs.items() if t and any(c.isalpha() for c in t)}
    best = {}
    for i, t in left.items():
        best[t] = max(best.get(t, i), i)
    left = {i: t for t, i in best.items()}
    top = brute_components(left, 5, 80)
    left = {i: t for i, t in left.items() if top[i] == i}
    left = {i: t for i, t in left.items() if not any(b in " ".join(t.lower().split()) for b in items)}
    before = len(MADE)
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert set(got) == set(left) and all(r["n_tokens"] == len(r["ids"]) > 0 for r in got.values())
    assert all(got[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest() for i, t in left.items())
    # Of what the stages wrote, only the last one's input is left.
    assert len(MADE) == before + 1 and "stage-decontaminate" in MADE[-1]
    library = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=q.MODEL_FILE)
    assert {i: r["ids"] for i, r in got.items()} == dict(zip(left, library.encode(list(left.values())), strict=True))


def test_stages_stand_odd_tables(spark, sf_dir):
    docs = odd_docs(spark, ["the quick brown fox jumps over the lazy dog"])
    for table in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, sf_dir)
            assert out.columns == corpus_pipeline.COLUMNS and out.count() <= table.count()
        assert corpus_pipeline.STAGES[-1][1](spark, table, sf_dir).count() == table.count()
    with_null = docs.union(docs.filter("doc_id is null"))
    assert corpus_pipeline.exact_duplicates(spark, with_null, sf_dir).filter("doc_id is null").count() == 2
    kept = [r["doc_id"] for r in corpus_pipeline.exact_duplicates(spark, docs, sf_dir).collect()]
    assert len(kept) == len(set(kept)) and None in kept


def test_rows_that_share_an_id_are_judged_by_their_own_text(spark, sf_dir):
    rows = [(1, "a text here", "en", "s", 1), (1, "another one", "en", "s", 1), (2, "a text here", "en", "s", 1), (3, None, "en", "s", 0), (3, "", "en", "s", 0), (4, "once", "en", "s", 1)]
    docs = spark.createDataFrame(rows + rows[-1:], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    left = [(r["doc_id"], r["text"] or "") for r in corpus_pipeline.exact_duplicates(spark, docs, sf_dir).collect()]
    assert sorted(left) == [(1, "another one"), (2, "a text here"), (3, ""), (4, "once")]
