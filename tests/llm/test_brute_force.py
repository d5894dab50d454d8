"""Registered queries that SQL can't state, against plain versions over whole tables."""

import hashlib
import html
import re

import pytest

from kinweave.llm import queries as q
from tests.llm.test_text_scans import brute_base


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def test_op1_equals_the_library(spark, sf_dir, documents):
    spm = pytest.importorskip("sentencepiece")
    library = spm.SentencePieceProcessor(model_file=q.MODEL_FILE)
    ids = dict(zip(documents, library.encode(list(documents.values())), strict=True))
    rows = q.op1_sentencepiece(spark, sf_dir).collect()
    assert {r["doc_id"]: r["ids"] for r in rows} == ids and all(r["n_tokens"] == len(r["ids"]) for r in rows)
    assert {r["doc_id"]: r["decoded_sha256"] for r in rows} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in documents.items()}


def test_op3_is_accurate_on_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = q.op3_language_id(spark, sf_dir).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(lang) and sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) > 0.98 * len(held)


def test_op5_equals_a_search_for_every_item(spark, sf_dir, documents):
    items = {r["item_id"]: " ".join(r["text"].lower().split()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    plain = {d: " ".join(t.lower().split()) for d, t in documents.items()}
    want = {(d, i) for d, t in plain.items() for i, b in items.items() if b in t}
    rows = q.op5_decontaminate(spark, sf_dir).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows if r["edits"] == 0} == want and want
    for r in rows:
        assert " ".join(documents[r["doc_id"]][r["start"] : r["end"]].lower().split()) == items[r["item_id"]] or r["edits"] > 0


def test_op6_equals_a_cut_of_the_article(spark, sf_dir):
    def plain(page):
        article = re.search(r"<article>(.*)</article>", page, re.DOTALL)[1]
        parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", article.replace("<br>", " ")))
        return "\n".join(x for x in (" ".join(html.unescape(p).split()) for p in parts) if x)

    pages = {r["page_id"]: plain(r["html"]) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = q.op6_html_text(spark, sf_dir).collect()
    assert {r["page_id"]: r["text"] for r in rows} == pages and all(r["n_chars"] == len(r["text"]) for r in rows)


def test_op7_equals_plain_searches(spark):
    sf_dir = "/root/testdata/sf0.01"  # the smallest table holds no secret
    documents = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = q.op7_secret_scan(spark, sf_dir).collect()
    want = {i: hashlib.sha256(",".join(brute_base(t)).encode()).hexdigest() for i, t in documents.items()}
    assert {r["doc_id"]: r["base_sha256"] for r in rows} == want and len(set(want.values())) > 1
