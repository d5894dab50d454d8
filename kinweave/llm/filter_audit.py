"""How document filters interact: what each removes at each place of each order.

Two passes. The first reads the texts once and keeps a few bytes of each
document: its part, one bit for each filter that it fails, and its text's
digest. The second packs the bits of a task's documents into NumPy bitsets, one
per filter, label and part, and counts every prefix subset of filters with
AND-NOT and popcount. Counts are sums over tasks, and the orders are put
together from them: with 5 filters 32 subsets serve all 120 orders.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import bounded_batches, columns_only, join_per_key, stored

FILTERS = "ABCDE"
MARKS = b"#$%&*|"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rows of a bitset, about: a task's documents are counted in blocks of so many.
BLOCK = 1 << 16
#: A task passes its counts on when it holds those of so many parts.
MOST_PARTS = 500


def text_flags(text: str) -> int:
    """Bits 0 to 3: fails A (short), B (few distinct words), C (capitals), D (marks)."""
    raw = text.encode()
    words = raw.split()  # of bytes: space and 0x09-0x0D only
    return (
        (len(words) < 200)
        | (100 * len(set(words)) < 50 * len(words)) << 1
        | (100 * (len(raw) - len(raw.translate(None, CAPITALS))) > 3 * len(text)) << 2
        | (len(raw.translate(None, MARKS)) < len(raw)) << 3
    )


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t or "" for t in batch["_text"].to_pylist()]
        flags = pa.array([text_flags(t) for t in texts], pa.int32())
        digests = pa.array([hashlib.sha256(t.encode()).digest() for t in texts], pa.binary())
        yield pa.RecordBatch.from_arrays([batch["_id"], batch["part"], flags, digests], names=["_id", "part", "flags", "digest"])


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, flags`` of each document: bits 0 to 4 for the filters that it fails,
    bit 5 for good (quality 1), bit 6 for toxic.

    Texts count as identical if their SHA-256 digests are equal. The smallest
    id of each digest is found by an aggregate that combines in each task;
    members of hot digests get it by broadcast (``common.join_per_key``).
    """
    named = columns_only(docs, "doc_id", "lang", "text").select(
        F.col("doc_id").alias("_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.col("text").alias("_text")
    )
    kind = docs.schema["doc_id"].dataType.simpleString()
    judged = bounded_batches(named).mapInArrow(_judged, f"_id {kind}, part string, flags int, digest binary")
    judged = stored(judged, "audit")
    first = stored(judged.groupBy("digest").agg(F.min("_id").alias("first_id"), F.count(F.lit(1)).alias("copies")), "audit-first")
    total = first.agg(F.sum("copies")).first()[0] or 0
    known = join_per_key(judged, first, "digest", "copies", total)
    again = F.coalesce(F.col("_id") > F.col("first_id"), F.lit(False)).cast("int")
    known = known.select("_id", "part", (F.col("flags") + again * 16).alias("flags"))
    marks = columns_only(labels, "doc_id", "quality", "toxic").filter("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("int")).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("int")).alias("bad"),
    )
    # Rows without an id have no label; they stay out of the join, where they would meet in one task.
    labelled = known.filter("_id is not null").join(marks, "_id", "left")
    labelled = labelled.select("part", (F.col("flags") + F.coalesce("good", F.lit(0)) * 32 + F.coalesce("bad", F.lit(0)) * 64).alias("flags"))
    return labelled.unionByName(known.filter("_id is null").select("part", "flags"))


def _bits(mask: np.ndarray) -> np.ndarray:
    """A boolean array as words of 64 bits."""
    packed = np.packbits(mask)
    return np.pad(packed, (0, -len(packed) % 8)).view(np.uint64)


def _popcount(words: np.ndarray) -> int:
    return int(np.bitwise_count(words).sum())


def subset_counts(part: np.ndarray, fails: list[np.ndarray], good: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Counts of a part's bitset, a row for each subset of filters: kept by all of
    them, then for each filter what it removes of these, and the good and toxic among them."""
    n = len(fails)
    out = np.zeros((1 << n, 1 + 3 * n), np.int64)
    left = {0: part}
    for subset in range(1 << n):
        if subset:
            low = (subset & -subset).bit_length() - 1
            left[subset] = left[subset & (subset - 1)] & ~fails[low]
        out[subset, 0] = _popcount(left[subset])
        for f in range(n):
            if not subset >> f & 1:
                gone = left[subset] & fails[f]
                out[subset, 1 + 3 * f : 4 + 3 * f] = _popcount(gone), _popcount(gone & good), _popcount(gone & toxic)
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = len(FILTERS)
    held: dict[str, np.ndarray] = {}

    def passed_on():
        for part, counts in held.items():
            filters = np.tile(np.arange(n, dtype=np.int32), len(counts))
            subsets = np.repeat(np.arange(len(counts), dtype=np.int32), n)
            cells = counts[:, 1:].reshape(-1, 3)
            columns = [pa.array([part] * len(subsets)), subsets, filters, np.repeat(counts[:, 0], n), *cells.T]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in columns], names=["part", "subset", "tested", "kept", "removed", "good_lost", "toxic_lost"]
            )
        held.clear()

    def counted(parts: list, flags: list):
        f, coded = np.concatenate(flags), pa.chunked_array(parts).combine_chunks().dictionary_encode()
        names, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        fails = [_bits((f >> i & 1).astype(bool)) for i in range(n)]
        good, toxic = _bits((f >> n & 1).astype(bool)), _bits((f >> n + 1 & 1).astype(bool))
        for code, name in enumerate(names):
            held[name] = held.get(name, 0) + subset_counts(_bits(codes == code), fails, good, toxic)
            if len(held) >= MOST_PARTS:
                yield from passed_on()

    parts, flags, rows = [], [], 0
    for batch in batches:
        parts.append(batch["part"])
        flags.append(batch["flags"].to_numpy())
        rows += len(batch)
        if rows >= BLOCK:
            yield from counted(parts, flags)
            parts, flags, rows = [], [], 0
    if rows:
        yield from counted(parts, flags)
    yield from passed_on()


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per part, order of the five filters and step: ``part, filter_order, step,
    kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``.

    A part is a ``lang`` value, null as an empty one. Null texts count as empty
    and texts are read whole. A document of which an identical one with a
    smaller id exists fails E; rows that repeat an id and a text don't fail it
    by each other, and a row without an id never fails it and has no label.
    Rows count each. If ``labels`` has several rows for an id, one with quality
    1 makes it good and one with toxic 1 toxic. An empty table gives an empty
    result. Only the named columns are read.
    """
    spark, n = docs.sparkSession, len(FILTERS)
    schema = "part string, subset int, tested int, kept bigint, removed bigint, good_lost bigint, toxic_lost bigint"
    counts = failures(docs, labels).mapInArrow(_counted, schema)
    summed = stored(
        counts.groupBy("part", "subset", "tested").agg(*[F.sum(c).alias(c) for c in ("kept", "removed", "good_lost", "toxic_lost")]), "audit-counts"
    )
    # The places of all orders: 600 rows, however large the input is.
    places = [
        ("".join(FILTERS[f] for f in order), step + 1, f, sum(1 << g for g in order[:step]), sum(1 << g for g in order[: step + 1]))
        for order in permutations(range(n))
        for step, f in enumerate(order)
    ]
    at = F.broadcast(spark.createDataFrame(places, "filter_order string, step int, tested int, subset int, after int"))
    size = 1 << n
    alone = F.sum(F.when(F.expr(f"subset = {size - 1} - shiftleft(1, tested)"), F.col("removed")))
    weights = F.create_map(*[F.lit(x) for s in range(size) for x in (s, factorial(s.bit_count()) * factorial(max(0, n - 1 - s.bit_count())))])
    by_filter = summed.groupBy("part", "tested").agg(
        F.sum(F.when(F.col("subset") == 0, F.col("removed"))).alias("fails"),
        alone.alias("unique_fails"),
        F.sum(F.col("removed") * weights[F.col("subset")]).cast("bigint").alias("shapley"),
    )
    left = summed.filter("tested = 0").select("part", F.col("subset").alias("after"), F.col("kept").alias("left"))
    rows = summed.join(at, ["subset", "tested"]).join(by_filter, ["part", "tested"]).join(left, ["part", "after"])
    return rows.select(
        "part", "filter_order", "step", F.col("left").alias("kept"), "removed", (F.col("fails") - F.col("removed")).alias("redundant"),
        "unique_fails", "good_lost", "toxic_lost", "shapley",
    )
