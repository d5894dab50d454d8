"""The corpus pipeline: documents in, encoded clean documents out.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written and
read again as the next stage's documents. All but the last return the columns
of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.common import MADE, remove_made, stored, table
from kinweave.llm.decontaminate import find_leaks
from kinweave.llm.exact_dedup import exact_dedup, sha256_bytes
from kinweave.llm.langid import UNDECIDED, fit, identify
from kinweave.llm.near_dedup import near_duplicates
from kinweave.llm.queries import MODEL_FILE
from kinweave.llm.sentencepiece import round_trip

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Ids of rejected documents, 8 bytes each, that are broadcast at most.
BROADCAST_IDS = 1_000_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are given a language stay; those given none (null, empty or
    without a letter) go. A low score alone rejects nothing: a network fitted on
    few labels is unsure of clean documents too.

    ``lang`` is left as it is. The network is fitted on a bounded sample of the
    stage's own labelled documents; if none is labelled, nothing can be judged
    and everything with a letter stays.
    """
    network = fit(docs)
    if network is None:
        return docs.filter(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))).select(*COLUMNS)
    found = identify(docs, network, keep=tuple(COLUMNS))
    return found.filter(F.col("lang_pred") != UNDECIDED).select(*COLUMNS)


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` less the rows with one of the ids. The ids are counted: up to
    BROADCAST_IDS go to every task, more are joined by a shuffle."""
    ids = stored(ids.select("doc_id").filter("doc_id is not null").distinct(), "rejected")
    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids.hint("merge"), "doc_id", "left_anti").select(*COLUMNS)


def _lost(decided: DataFrame) -> DataFrame:
    """Ids that no row of theirs keeps; a null id is never rejected."""
    return decided.groupBy("doc_id").agg(F.max("kept").alias("kept")).filter("not kept")


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays, once if its row is repeated.

    Rows are judged by id and text, so of rows that share an id each has its own
    fate. A null text equals an empty one. Rows without an id stay; texts of any
    length are compared whole; an empty table stays empty."""
    lost = stored(exact_dedup(docs).filter("not kept and doc_id is not null").select("doc_id", "digest").distinct(), "rejected")
    few = lost.count() <= BROADCAST_IDS
    keyed = docs.withColumn("digest", sha256_bytes(F.coalesce(F.col("text"), F.lit(""))))
    left = keyed.join(F.broadcast(lost) if few else lost.hint("merge"), ["doc_id", "digest"], "left_anti").select(*COLUMNS)
    repeated = docs.groupBy("doc_id").count().filter("count > 1 and doc_id is not null")
    if repeated.isEmpty():
        return left
    repeated = stored(repeated.select("doc_id"), "repeated")
    once = left.join(repeated, "doc_id", "left_semi").withColumn("_text", F.coalesce("text", F.lit(""))).dropDuplicates(["doc_id", "_text"])
    return _without(left, repeated).unionByName(once.select(*COLUMNS))


def near_duplicate_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by five-word shingles at 0.8, the one with the smallest id stays.

    Texts without a word and rows without an id stay; texts of any length are
    compared whole, rows that share an id each by its own text, an id goes if
    none of its rows is kept; an empty table stays empty."""
    return _without(docs, _lost(near_duplicates(docs, k=5, percent=80)))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item within its edit budget go, with all rows of their id.

    Null and empty texts hold none, texts are searched whole, rows without an
    id stay; an empty table or benchmark changes nothing."""
    return _without(docs, find_leaks(docs, table(spark, sf_dir, "benchmark")))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded_sha256``: the pieces of each document, and
    the digest of the text that they decode to.

    A row for each row: a null or empty text has no pieces and the digest of an
    empty text. Texts of any length are encoded whole; an empty table stays empty.
    """
    back = round_trip(docs, MODEL_FILE)
    return back.select("doc_id", F.size("ids").alias("n_tokens"), "ids", F.sha2("text", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_duplicates),
    ("near_dedup", near_duplicate_groups),
    ("decontaminate", benchmark_leaks),
    ("sentencepiece", sentencepiece),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents. What a stage has written besides its result is
    removed when the result stands, and the result when the next one does."""
    docs, before = table(spark, sf_dir, "documents"), len(MADE)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        remove_made(spark, before, keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The first, third and last stages have no SQL; tests hold them against brute force.
ORACLE_SQL = None
