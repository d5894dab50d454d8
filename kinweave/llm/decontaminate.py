"""Benchmark decontamination by the q-gram lemma.

A stretch of a text that is within k edits of a benchmark item of m characters
shares at least m + 1 - q(k + 1) q-grams with it, and all of them lie within k
diagonals of where the item starts. Shared q-grams are counted in overlapping
diagonal bands; bands that reach the bound are aligned with the item in a band.
The filter loses nothing within the edit budget; the alignment decides.
Items too short for the bound are cut into k + 1 pieces, of which one must stand
intact, and aligned around each place of a piece.

Texts are compared in lower case with white space runs as one space.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import bounded_batches, columns_only

Q = 8
#: Edits per character of the item.
EDIT_RATE = 0.1
#: The benchmark is matched in blocks of so many characters, so what goes to
#: every task is bounded whatever the benchmark's size.
BLOCK_CHARS = 2_000_000
#: Odd multipliers of the three doublings; the high bits of the sum are used.
_POWERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]
#: Bits of a q-gram's hash that the first, rough test looks at.
BITS = 22


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def grams(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each window of Q = 8 characters, by doubling."""
    if len(data) < Q:
        return np.zeros(0, np.uint64)
    h, n = data.astype(np.uint64), 1
    for power in _POWERS:
        h = h[:-n] * power + h[n:]
        n *= 2
    return h


def budget(m: int, rate: float) -> int:
    """Allowed edits of an item of m characters: its share."""
    return max(0, min(int(m * rate), m - 1))


def pieces(clean: str, k: int) -> list[tuple[int, str]]:
    """Place and text of k + 1 pieces; k edits leave at least one of them as it is."""
    ends = [len(clean) * i // (k + 1) for i in range(k + 2)]
    return [(a, clean[a:b]) for a, b in zip(ends, ends[1:])]


def banded(item: np.ndarray, text: np.ndarray, k: int) -> tuple[int, int, int] | None:
    """Least edits of ``item`` against a stretch of ``text``, its start and end; None if over k.

    Row by row over a band of diagonals; a stretch may start and end anywhere
    in the text, which the caller has cut to the band's reach.
    """
    m, n = len(item), len(text)
    far = k + 1
    row, start = np.zeros(n + 1, np.int32), np.arange(n + 1, dtype=np.int32)
    places = np.arange(n + 1, dtype=np.int32)
    slack = n - m + k
    for i in range(1, m + 1):
        lo, hi = max(0, i - k), min(n, i + max(slack, 0) + k)
        new, origin = np.full(n + 1, far, np.int32), np.zeros(n + 1, np.int32)
        new[lo : hi + 1] = row[lo : hi + 1] + 1
        origin[lo : hi + 1] = start[lo : hi + 1]
        a = max(lo, 1)
        diagonal = row[a - 1 : hi] + (text[a - 1 : hi] != item[i - 1])
        better = diagonal < new[a : hi + 1]
        new[a : hi + 1] = np.where(better, diagonal, new[a : hi + 1])
        origin[a : hi + 1] = np.where(better, start[a - 1 : hi], origin[a : hi + 1])
        # Insertions: the best earlier cell of the row plus the distance to it.
        lead = new - places
        reach = np.minimum.accumulate(lead)
        from_ = np.maximum.accumulate(np.where(lead == reach, places, 0))
        moved = reach + places < new
        origin = np.where(moved, origin[from_], origin)
        row, start = np.minimum(np.where(moved, reach + places, new), far), origin
        if row.min() > k:
            return None
    end = int(row.argmin())
    return (int(row[end]), int(start[end]), end) if row[end] <= k else None


def apart(places: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Of places that overlap, the one with fewest edits."""
    taken: list[tuple[int, int, int, int]] = []
    for place in sorted(places):
        if all(place[2] <= a or place[1] >= b for _, a, b, _ in taken):
            taken.append(place)
    return taken


class Index:
    """The q-grams of a block of benchmark items and where they stand."""

    def __init__(self, items: list[tuple[int, str]], rate: float = EDIT_RATE):
        self.items, self.short = [], []
        hashes, owners, places = [], [], []
        for item_id, text in items:
            clean = normal(text or "")
            if not clean:
                continue
            k = budget(len(clean), rate)
            if len(clean) + 1 - Q * (k + 1) < 1:
                self.short.append((item_id, clean, k, pieces(clean, k)))
                continue
            g = grams(codes(clean))
            owner = len(self.items)
            self.items.append((item_id, clean, k, len(clean) + 1 - Q * (k + 1)))
            hashes.append(g)
            owners.append(np.full(len(g), owner))
            places.append(np.arange(len(g)))
        if not hashes:
            hashes, owners, places = [np.zeros(0, np.uint64)], [np.zeros(0, int)], [np.zeros(0, int)]
        flat = np.concatenate(hashes)
        order = np.argsort(flat, kind="stable")
        self.owners, self.places = np.concatenate(owners)[order], np.concatenate(places)[order]
        self.hashes, self.starts, self.counts = np.unique(flat[order], return_index=True, return_counts=True)
        self.bounds = np.array([b for *_, b in self.items] or [0])
        self.sizes = np.array([2 * (2 * k + 1) for _, _, k, _ in self.items] or [1])
        self.bits = np.zeros(1 << BITS, bool)
        self.bits[self._short(self.hashes)] = True

    @staticmethod
    def _short(hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - BITS)).view(np.int64)

    def shared(self, text_grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Owner, item place and text place of every shared q-gram."""
        maybe = self.bits.take(self._short(text_grams)).nonzero()[0]
        if not len(maybe):
            return maybe, maybe, maybe
        asked = text_grams[maybe]
        low = np.minimum(np.searchsorted(self.hashes, asked), len(self.hashes) - 1)
        hit = self.hashes[low] == asked
        maybe, low = maybe[hit], low[hit]
        n = self.counts[low]
        at = np.repeat(self.starts[low] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return self.owners[at], self.places[at], np.repeat(maybe, n)

    def regions(self, text_grams: np.ndarray) -> list[tuple[int, int, int]]:
        """Owner, first diagonal and count of the bands that reach their owner's bound."""
        owner, place, where = self.shared(text_grams)
        enough = np.bincount(owner, minlength=len(self.bounds)) >= self.bounds
        left = enough[owner]
        if not left.any():
            return []
        owner, place, where = owner[left], place[left], where[left]
        diagonal, size, out = where - place, self.sizes[owner], []
        # Any 2k + 1 neighbouring diagonals lie in one of two interleaved rows of bands.
        for shift in (np.zeros_like(size), size // 2):
            band = (diagonal + shift) // size
            key = owner * (1 << 32) + (band + (1 << 31))
            keys, inverse, n = np.unique(key, return_inverse=True, return_counts=True)
            for i in np.flatnonzero(n >= self.bounds[keys >> 32]):
                own = inverse == i
                o, distinct = int(keys[i] >> 32), len(np.unique(place[own]))
                if distinct >= self.bounds[o]:
                    first = int((keys[i] & 0xFFFFFFFF) - (1 << 31)) * int(self.sizes[o])
                    out.append((o, first - int(shift[own][0]), distinct))
        return out

    @staticmethod
    def _short_places(text: str, item_id: int, clean: str, k: int, parts: list[tuple[int, str]]) -> list[tuple[int, int, int, int, int]]:
        """Places of an item that is too short for the q-gram bound: it is aligned around every piece that stands intact."""
        starts: dict[int, int] = {}
        for offset, part in parts:
            at = text.find(part)
            while at >= 0:
                starts[at - offset] = starts.get(at - offset, 0) + 1
                at = text.find(part, at + 1)
        item, places = codes(clean), []
        for start, n in starts.items():
            if n == len(parts):
                places.append((0, start, start + len(clean), n))
                continue
            lo = max(0, start - k)
            aligned = banded(item, codes(text[lo : start + len(clean) + k]), k)
            if aligned:
                places.append((aligned[0], lo + aligned[1], lo + aligned[2], n))
        return [(item_id, start, end, edits, n) for edits, start, end, n in apart(places)]

    def search(self, text: str) -> list[tuple[int, int, int, int, int]]:
        """``item_id, start, end, edits, shared`` by place in the normal text."""
        found = []
        for item_id, clean, k, parts in self.short:
            found += self._short_places(text, item_id, clean, k, parts)
        data = codes(text)
        best: dict[int, list[tuple[int, int, int, int]]] = {}
        for o, first, n in self.regions(grams(data)):
            item_id, clean, k, _ = self.items[o]
            lo, hi = max(0, first - k), min(len(data), first + 2 * (2 * k + 1) + len(clean) + k)
            exact = text.find(clean, lo, hi)
            aligned = (0, exact - lo, exact - lo + len(clean)) if exact >= 0 else banded(codes(clean), data[lo:hi], k)
            if aligned:
                best.setdefault(o, []).append((aligned[0], lo + aligned[1], lo + aligned[2], n))
        for o, places in best.items():
            found += [(self.items[o][0], start, end, edits, n) for edits, start, end, n in apart(places)]
        return sorted(found, key=lambda x: (x[1], x[0] is not None, x[0] or 0))


def original_places(text: str) -> np.ndarray:
    """For each character of the normal text, and its end, the place in the text itself."""
    out, lowered = [], []
    for i, c in enumerate(text):
        for x in c.lower():
            lowered.append(x)
            out.append(i)
    spaced, at, last = [], [], " "
    for c, i in zip(lowered, out, strict=True):
        c = " " if c.isspace() else c
        if c != " " or last != " ":
            spaced.append(c)
            at.append(i)
        last = c
    return np.array([*at, (at[-1] + 1) if at else 0])


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size, in order of their ids."""
    rows = columns_only(benchmark, id_col, text_col).filter(F.col(text_col).isNotNull()).orderBy(id_col, text_col)
    block, size = [], 0
    for row in rows.toLocalIterator():
        if block and size + len(row[1]) > block_chars:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += len(row[1])
    if block:
        yield block


SCHEMA = "item_id bigint, start bigint, end bigint, edits bigint, shared_qgrams bigint"


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    rate: float = EDIT_RATE,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """``id, item_id, start, end, edits, shared_qgrams``: every stretch of every
    whole text that is within the edit budget of a benchmark item.

    Places count the text's characters, the end excluded. Null and empty texts
    and items match nothing. For an item too short for the q-gram bound
    ``shared_qgrams`` counts the pieces that stand in place. Repeated rows are reported each. Stretches of one item that overlap
    count once, the one with fewest edits. Extra columns aren't read; an empty
    table on either side gives an empty result.
    """
    spark = docs.sparkSession
    named = bounded_batches(columns_only(docs, id_col, text_col))
    schema = f"`{id_col}` {named.dtypes[0][1]}, {SCHEMA}"
    out = None
    for block in benchmark_blocks(benchmark, item_col, "text", block_chars):
        index = spark.sparkContext.broadcast(cloudpickle.dumps(Index(block, rate)))
        part = named.mapInArrow(_searcher(index, id_col), schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def _searcher(index, id_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(index.value)
        for batch in batches:
            rows, ids = [], []
            for at, text in enumerate(batch.column(1).to_pylist()):
                if not text:
                    continue
                for item_id, start, end, edits, n in own.search(normal(text)):
                    if not rows or ids[-1] != at:
                        places = original_places(text)
                    rows.append((item_id, int(places[start]), int(places[end - 1]) + 1, edits, n))
                    ids.append(at)
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(ids, pa.int64())), *[pa.array(c, pa.int64()) for c in columns]],
                [id_col, "item_id", "start", "end", "edits", "shared_qgrams"],
            )

    return run
