"""Removal of byte strings that documents with smaller ids hold too.

A string counts if it has LENGTH bytes. To bring equal ones together without
shuffling them all, each window of LENGTH bytes is filed under the smallest hash
of its GRAM-byte parts, its anchor: equal windows have equal anchors, whatever
stands around them. Neighbouring windows with one anchor are a run, 18 windows
on average, and are sent as a few bytes: anchor, digest, place.

1. Runs meet by anchor. A run that a smaller document holds in the same form is
   removed at once. Where an anchor has runs of several forms, one document of
   each form is asked for the run's bytes.
2. The bytes meet by anchor again. Suffix arrays of blocks of whole groups
   (``suffix_array``) bring equal windows next to each other, and windows of
   which an equal one belongs to a smaller document are removed.
3. Each document's removals come together and its text is cut.

No step gathers a hot anchor: tasks send a form once, from their smallest
document that has it, and the bytes of an anchor with very many forms are dealt
out window by window under a hash of the window.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import bounded_batches, columns_only, stored
from kinweave.llm.suffix_array import suffix_array

LENGTH = 50
GRAM = 16
#: A run has so many windows at most; longer ones (periodic texts) are cut.
MOST_WINDOWS = 128
#: Text of a task, about, whose runs are combined before they are sent.
COMBINED_BYTES = 16 << 20
#: Text, about, whose runs meet in one group.
BUCKET_BYTES = 64 << 20
#: There are as many groups of runs as shuffle partitions, and so many at least.
LEAST_BUCKETS = 64
#: Windows, about, of an anchor's forms that meet in one group (a MB or two of bytes).
GROUP_WINDOWS = 200_000
#: A window can only be repeated if its first and its last so many bytes are.
EDGE = 40
#: Bytes of a suffix array's text, about.
BLOCK_BYTES = 1 << 17

_REMOVED = np.dtype([("at", "<u4"), ("n", "<u4")])
_WANTED = np.dtype([("anchor", "<u8"), ("at", "<u4"), ("n", "<u4"), ("parts", "<u4")])
_FOUND = "_id bigint, _key bigint, removed binary, wanted binary"
_RUNS = "bucket int, ids binary, keys binary, unit binary, at binary, n binary, rest binary, form binary"
_CUT = "_id bigint, _key bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"
_PIECES = "_id bigint, _key bigint, anchor bigint, piece binary, places binary"


def gram_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` bytes in a row, by doubling: a few passes over the text."""
    half, factor = codes.astype(np.uint64) + np.uint64(1), np.array([0x9E3779B97F4A7C15], np.uint64)
    out, done, length, left = None, 0, 1, size
    while left:
        if left & 1:
            if out is None:
                out, done = half, length
            else:
                n = len(codes) - done - length + 1
                out, done = out[:n] * factor + half[done : done + n], done + length
        left >>= 1
        if left:
            n = len(codes) - 2 * length + 1
            half, length, factor = half[:n] * factor + half[length : length + n], 2 * length, factor * factor
    out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def runs(raw: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first window and number of windows of each run of a text of ``length`` bytes or more."""
    low, reach, width = gram_hashes(np.frombuffer(raw, np.uint8), gram), 1, length - gram + 1
    while reach < width:
        step = min(reach, width - reach)
        low, reach = np.minimum(low[:-step], low[step:]), reach + step
    starts = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    sizes = np.diff(np.append(starts, len(low)))
    pieces = -(-sizes // MOST_WINDOWS)
    if (pieces > 1).any():
        within = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        ends = np.repeat(starts + sizes, pieces)
        starts = np.repeat(starts, pieces) + within * MOST_WINDOWS
        sizes = np.minimum(ends - starts, MOST_WINDOWS)
    return low[starts], starts, sizes


def _beyond_first(keys: tuple[np.ndarray, ...], owner: np.ndarray) -> np.ndarray:
    """Of entries with equal keys, those whose owner isn't the smallest one."""
    out = np.zeros(len(owner), bool)
    if len(owner):
        order = np.lexsort((owner, *reversed(keys)))
        new = np.zeros(len(order), bool)
        new[0] = True
        for k in keys:
            new[1:] |= k[order][1:] != k[order][:-1]
        first = owner[order][np.flatnonzero(new)][np.cumsum(new) - 1]
        out[order] = owner[order] > first
    return out


def _squeezed(x: np.ndarray) -> bytes:
    """Ascending or small numbers: their differences, byte by byte of all, compressed."""
    steps = np.diff(x.astype("<u4"), prepend=np.uint32(0)).astype("<u4")
    return zlib.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unsqueezed(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(raw), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").reshape(-1), dtype="<u4")


def _dealt(buckets: int, length: int, gram: int):
    """A function of a task's documents: their runs, packed by bucket."""

    def packed(bucket: int, chosen: np.ndarray, x: dict[str, np.ndarray], with_form: bool) -> list:
        units, unit = np.unique(x["unit"][chosen], return_inverse=True)
        head = [bucket, x["ids"][units].tobytes(), x["keys"][units].tobytes()]
        head += [_squeezed(unit), _squeezed(x["at"][chosen]), zlib.compress(x["n"][chosen].astype(np.uint8).tobytes(), 1)]
        return [*head, x["rest"][chosen].tobytes(), x["form"][chosen].tobytes()] if with_form else [*head, b"", b""]

    def combined(parts: dict[str, list], ids: list[int], keys: list[int]) -> Iterator[pa.RecordBatch]:
        x = {k: np.concatenate(v) for k, v in parts.items()} | {"ids": np.array(ids, "<i8"), "keys": np.array(keys, "<i8")}
        order = np.argsort(x["anchor"], kind="stable")
        same = x["anchor"][order][1:] == x["anchor"][order][:-1]
        often = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
        lost = np.zeros(len(order), bool)
        lost[often] = _beyond_first((x["anchor"][often], x["form"][often]), x["ids"][x["unit"][often]])
        high = x["anchor"] >> np.uint64(32)
        x["rest"] = (x["anchor"] & np.uint64(0xFFFFFFFF)).astype("<u4")
        # What is lost already only has to come together by document, in buckets of its own.
        home = (x["keys"] ^ x["ids"]).astype(np.uint64) % np.uint64(buckets)
        bucket = np.where(lost, home[x["unit"]] + np.uint64(buckets), high % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        at = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        rows = [packed(int(bucket[c[0]]), c, x, bucket[c[0]] < buckets) for c in np.split(order, at[1:])]
        for i in range(0, len(rows), 256):
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int32() if k == 0 else pa.binary()) for k, c in enumerate(zip(*rows[i : i + 256], strict=True))],
                names=["bucket", "ids", "keys", "unit", "at", "n", "rest", "form"],
            )

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = xxhash.xxh3_64_intdigest
        parts, seen, size = defaultdict(list), {}, 0
        for batch in batches:
            for i, key, raw in zip(*(batch[c].to_pylist() for c in ("_id", "_key", "_raw")), strict=True):
                if len(raw) < length or (i, key) in seen:
                    continue
                anchor, at, n = runs(raw, length, gram)
                ends = (at + n + (length - 1)).tolist()
                parts["form"].append(np.array([form(raw[a:b]) for a, b in zip(at.tolist(), ends, strict=True)], np.uint64))
                parts["anchor"].append(anchor)
                parts["at"].append(at)
                parts["n"].append(n)
                parts["unit"].append(np.full(len(at), len(seen)))
                seen[i, key] = None
                size += len(raw)
                if size >= COMBINED_BYTES:
                    yield from combined(parts, *zip(*seen, strict=True))
                    parts, seen, size = defaultdict(list), {}, 0
        if seen:
            yield from combined(parts, *zip(*seen, strict=True))

    return dealt


def _by_unit(ids: np.ndarray, keys: np.ndarray, unit: np.ndarray, records: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The records of each unit as bytes."""
    if not len(unit):
        return ids[:0], keys[:0], []
    order = np.argsort(unit, kind="stable")
    at = np.flatnonzero(np.diff(unit[order], prepend=-1))
    raw, size = records[order].tobytes(), records.dtype.itemsize
    ends = [*(at[1:] * size).tolist(), len(raw)]
    return ids[unit[order][at]], keys[unit[order][at]], [raw[a:b] for a, b in zip((at * size).tolist(), ends, strict=True)]


def _met(buckets: int):
    """A function of a bucket's packed runs: what is removed, and the runs whose bytes are wanted."""

    def met(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        read = lambda c, kind: [np.frombuffer(b, kind) for b in table[c].to_pylist()]
        ids, keys, unit = read("ids", "<i8"), read("keys", "<i8"), [_unsqueezed(b) for b in table["unit"].to_pylist()]
        base = np.cumsum([0, *map(len, ids)])
        ids, keys = np.concatenate(ids), np.concatenate(keys)
        order = np.lexsort((keys, ids))
        new = np.concatenate([[True], (ids[order][1:] != ids[order][:-1]) | (keys[order][1:] != keys[order][:-1])])
        known = np.empty(len(order), np.int64)
        known[order] = np.cumsum(new) - 1
        unit = known[np.concatenate([u.astype(np.int64) + b for u, b in zip(unit, base, strict=False)])]
        ids, keys = ids[order[new]], keys[order[new]]
        at = np.concatenate([_unsqueezed(b) for b in table["at"].to_pylist()])
        n = np.concatenate([np.frombuffer(zlib.decompress(b), np.uint8) for b in table["n"].to_pylist()]).astype("<u4")
        if bucket < buckets:
            # Most anchors are met once, and are done with.
            rest, form = np.concatenate(read("rest", "<u4")), np.concatenate(read("form", "<u8"))
            order = np.argsort(rest, kind="stable")
            same = rest[order][1:] == rest[order][:-1]
            often = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
            unit, at, n, rest, form = unit[often], at[often], n[often], rest[often], form[often]
        # A repeated row brings the same places again.
        _, once = np.unique(unit.astype(np.uint64) << np.uint64(32) | at, return_index=True)
        unit, at, n = unit[once], at[once], n[once]
        lost, wanted = np.ones(len(unit), bool), np.zeros(0, np.int64)
        if bucket < buckets:
            rest, form, owner = rest[once], form[once], ids[unit]
            lost = _beyond_first((rest, form), owner)
            left = np.flatnonzero(~lost)
            if len(left):
                order = left[np.lexsort((owner[left], form[left], rest[left]))]
                new = np.concatenate([[True], rest[order][1:] != rest[order][:-1]])
                fresh = new | np.concatenate([[True], form[order][1:] != form[order][:-1]])
                group, heads = np.cumsum(new) - 1, np.flatnonzero(new)
                several = np.add.reduceat(fresh.astype(np.int64), heads) > 1
                several &= np.minimum.reduceat(owner[order], heads) < np.maximum.reduceat(owner[order], heads)
                windows = np.add.reduceat(np.where(fresh, n[order], 0).astype(np.int64), heads)
                asked = several[group]
                wanted, parts = order[asked], -(-windows[group][asked] // GROUP_WINDOWS)
        gone = np.empty(int(lost.sum()), _REMOVED)
        gone["at"], gone["n"] = at[lost], n[lost]
        out = [*_by_unit(ids, keys, unit[lost], gone)]
        out.append([b""] * len(out[2]))
        if len(wanted):
            ask = np.empty(len(wanted), _WANTED)
            ask["anchor"] = np.uint64(bucket) << np.uint64(32) | rest[wanted].astype(np.uint64)
            ask["at"], ask["n"], ask["parts"] = at[wanted], n[wanted], parts
            i, k, b = _by_unit(ids, keys, unit[wanted], ask)
            out = [np.concatenate([out[0], i]), np.concatenate([out[1], k]), out[2] + [b""] * len(b), out[3] + b]
        columns = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.binary())]
        return pa.Table.from_arrays(columns, names=["_id", "_key", "removed", "wanted"])

    return met


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _pieces(length: int):
    """A function of documents and their wanted runs: the bytes, a row per form and document."""

    def rows_of(batch: pa.RecordBatch) -> Iterator[tuple]:
        split: dict[tuple[int, bytes], list[tuple[int, int, int]]] = defaultdict(list)
        for i, key, raw, blobs in zip(*(batch[c].to_pylist() for c in ("_id", "_key", "_raw", "wanted")), strict=True):
            places: dict[tuple[int, bytes], list[int]] = defaultdict(list)
            for anchor, at, n, parts in np.frombuffer(b"".join(blobs), _WANTED).tolist():
                if parts == 1:
                    places[_signed(anchor), raw[at : at + n + length - 1]].append(at)
                else:
                    for p in range(at, at + n):
                        window = raw[p : p + length]
                        salt = xxhash.xxh3_64_intdigest(window, seed=7) % parts
                        split[_signed(xxhash.xxh3_64_intdigest(f"{anchor} {salt}")), window].append((i, key, p))
            for (anchor, piece), at in places.items():
                yield i, key, anchor, piece, np.array(at, "<u4").tobytes()
        for (anchor, window), held in split.items():
            least = min(i for i, _, _ in held)
            by_unit = defaultdict(list)
            for i, key, p in held:
                by_unit[i, key].append(p)
            for (i, key), at in by_unit.items():
                # Without bytes: the windows at these places are removed.
                sent = (anchor, window) if i == least else (_signed(xxhash.xxh3_64_intdigest(f"{i} {key}")), None)
                yield i, key, *sent, np.array(at, "<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        for batch in batches:
            rows = list(rows_of(batch))
            for i in range(0, len(rows), 10_000):
                columns = zip(*rows[i : i + 10_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["_id", "_key", "anchor", "piece", "places"])

    return pieces


def _beyond_least(group: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least owner of each entry's group, and whether the group has several."""
    n = int(group.max()) + 1
    least, most = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
    np.minimum.at(least, group, owner)
    np.maximum.at(most, group, owner)
    return least[group], (least < most)[group]


def held_before(pieces: list[bytes], owners: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """Of each piece the windows of which an equal one stands in a piece with a smaller owner.

    Only windows whose first EDGE bytes occur with another owner, and whose last
    do, can be such; what they cover are spans. Equal spans are taken once, with
    their least owner, and one suffix array over all spans brings equal windows
    next to each other. A window's own bytes are compared, so it doesn't matter
    what follows them there."""
    sizes = np.array([len(p) for p in pieces])
    starts, text = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(pieces), np.uint8)
    counts = sizes - length + 1
    firsts = np.cumsum(counts) - counts
    piece = np.repeat(np.arange(len(pieces)), counts)
    offset = np.arange(counts.sum()) - firsts[piece]
    at, owner = starts[piece] + offset, owners[piece]
    edge = min(EDGE, length)
    hashes = gram_hashes(text, edge)
    kept = np.arange(len(at))
    for shift in (0, length - edge):
        if len(kept):
            _, same = np.unique(hashes[at[kept] + shift], return_inverse=True)
            kept = kept[_beyond_least(same, owner[kept])[1]]
    gone = np.zeros(len(at), bool)
    if len(kept):
        # A span: windows of a piece that follow each other.
        heads = np.flatnonzero((np.diff(at[kept], prepend=-2) > 1) | (np.diff(piece[kept], prepend=-1) != 0))
        n_windows = np.diff(np.append(heads, len(kept)))
        raw, lo = text.tobytes(), at[kept][heads]
        known: dict[bytes, int] = {}
        which = np.array([known.setdefault(raw[a : a + n + length - 1], len(known)) for a, n in zip(lo.tolist(), n_windows.tolist(), strict=True)])
        first_owner, _ = _beyond_least(which, owner[kept][heads])
        spans = list(known)
        span_owner = np.zeros(len(spans), np.int64)
        span_owner[which] = first_owner
        lost = _sorted_windows(spans, span_owner, length)
        ends = np.cumsum([len(x) for x in lost])
        flat = np.concatenate(lost)
        of = np.repeat(np.arange(len(heads)), n_windows)
        within = np.arange(len(kept)) - heads[of]
        gone[kept] = (owner[kept] > first_owner[of]) | flat[(ends - [len(x) for x in lost])[which][of] + within]
    return [offset[a:b][gone[a:b]] for a, b in zip(firsts, firsts + counts, strict=True)]


def _sorted_windows(spans: list[bytes], owners: np.ndarray, length: int) -> list[np.ndarray]:
    """For each window of each span whether an equal one belongs to a smaller owner."""
    counts = np.array([len(s) - length + 1 for s in spans])
    firsts = np.cumsum(counts) - counts
    text = b"".join(spans)
    span = np.repeat(np.arange(len(spans)), counts)
    at = np.arange(counts.sum()) - firsts[span] + (np.cumsum([len(s) for s in spans]) - [len(s) for s in spans])[span]
    number = np.full(len(text), -1)
    number[at] = np.arange(len(at))
    order = np.array(suffix_array(text))
    order = order[number[order] >= 0]
    rows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(text, np.uint8), length)[order]
    heads = np.concatenate([[0], np.flatnonzero((rows[1:] != rows[:-1]).any(axis=1)) + 1])
    which = number[order]
    owner = owners[span[which]]
    run = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(order))))
    gone = np.zeros(len(at), bool)
    gone[which] = owner > np.minimum.reduceat(owner, heads)[run]
    return np.split(gone, firsts[1:])


def _as_runs(windows: np.ndarray) -> bytes:
    windows = np.unique(windows)
    heads = np.flatnonzero(np.diff(windows, prepend=-2) > 1)
    out = np.empty(len(heads), _REMOVED)
    out["at"], out["n"] = windows[heads], np.diff(np.append(heads, len(windows)))
    return out.tobytes()


def _searched(length: int):
    """A function of pieces sorted by anchor: what is removed of each document."""

    def judged(rows: list[tuple]) -> Iterator[tuple]:
        by_piece: dict[bytes, list[tuple]] = defaultdict(list)
        removed: dict[tuple[int, int], list[np.ndarray]] = defaultdict(list)
        for i, key, piece, places in rows:
            if piece is None:
                removed[i, key].append(places)
            else:
                by_piece[piece].append((i, key, places))
        if by_piece:
            pieces = list(by_piece)
            owners = np.array([min(i for i, _, _ in by_piece[p]) for p in pieces], np.int64)
            for piece, owner, offsets in zip(pieces, owners.tolist(), held_before(pieces, owners, length), strict=True):
                for i, key, places in by_piece[piece]:
                    lost = offsets if i == owner else np.arange(len(piece) - length + 1)
                    if len(lost):
                        removed[i, key].append((places[:, None].astype(np.int64) + lost).reshape(-1))
        for (i, key), windows in removed.items():
            yield i, key, _as_runs(np.concatenate(windows))

    def sent(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        found = list(judged(rows))
        if found:
            i, key, removed = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(key, pa.int64()), pa.array(removed, pa.binary())], names=["_id", "_key", "removed"])

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, last = [], 0, None
        for batch in batches:
            for i, key, anchor, piece, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= BLOCK_BYTES and anchor != last:
                    yield from sent(rows)
                    rows, size = [], 0
                rows.append((i, key, piece, np.frombuffer(places, "<u4")))
                size, last = size + (len(piece) if piece else len(places)), anchor
        if rows:
            yield from sent(rows)

    return searched


def _cut(length: int):
    """A function of documents and their removals: the digest columns and the text that is left."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, spans, digests, kept = [], [], [], []
            for raw, blobs in zip(batch["_raw"].to_pylist(), batch["removed"].to_pylist(), strict=True):
                gone = np.frombuffer(b"".join(blobs or []), _REMOVED)
                if len(gone):
                    edges = np.zeros(len(raw) + 1, np.int64)
                    np.add.at(edges, gone["at"].astype(np.int64), 1)
                    np.add.at(edges, gone["at"].astype(np.int64) + gone["n"] + (length - 1), -1)
                    out = np.cumsum(edges[:-1]) > 0
                    removed.append(int(out.sum()))
                    spans.append(int(np.count_nonzero(out[1:] & ~out[:-1]) + out[0]))
                    raw = np.frombuffer(raw, np.uint8)[~out].tobytes()
                else:
                    removed.append(0)
                    spans.append(0)
                digests.append(hashlib.sha256(raw).hexdigest())
                kept.append(raw)
            sizes = pa.array([len(x or b"") for x in batch["_raw"].to_pylist()], pa.int64())
            columns = [batch["_id"], batch["_key"], sizes, pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["_id", "_key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return cut


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``id, n_bytes, n_removed, n_spans, kept_sha256, kept`` of every row: its text less
    each byte that a string of ``length`` bytes covers which also starts in a row
    with a smaller id. ``kept`` has the remaining bytes.

    Ids are integers. A null text counts as empty; a text shorter than
    ``length`` loses nothing; texts of any length are read whole. Rows that
    share an id are one document: neither takes from the other, each is judged
    by its own text, and repeated rows get the same result each. A row without
    an id loses nothing and takes nothing. An empty table gives an empty
    result. Only the two named columns are read. ``gram`` is at most ``length``.

    Runs are held to be equal if their anchors and 64-bit digests are; windows of
    different runs are compared byte by byte.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    named = columns_only(docs, id_col, text_col).select(F.col(id_col).cast("bigint").alias("_id"), raw.alias("_raw"))
    named = bounded_batches(named.select("_id", F.xxhash64("_raw").alias("_key"), "_raw"))
    known = named.filter("_id is not null")
    size = known.agg(F.sum(F.octet_length("_raw"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / BUCKET_BYTES))
    dealt = known.mapInArrow(_dealt(buckets, length, gram), _RUNS)
    found = stored(dealt.groupBy("bucket").applyInArrow(_met(buckets), _FOUND), "repeats")
    wanted = found.filter(F.octet_length("wanted") > 0).groupBy("_id", "_key").agg(F.collect_list("wanted").alias("wanted"))
    texts = known.groupBy("_id", "_key").agg(F.first("_raw").alias("_raw"))
    pieces = texts.join(wanted.hint("merge"), ["_id", "_key"]).select("_id", "_key", "_raw", "wanted").mapInArrow(_pieces(length), _PIECES)
    met = pieces.repartition("anchor").sortWithinPartitions("anchor")
    searched = met.mapInArrow(_searched(length), "_id bigint, _key bigint, removed binary")
    gone = found.filter(F.octet_length("removed") > 0).select("_id", "_key", "removed").unionByName(searched)
    gone = gone.groupBy("_id", "_key").agg(F.collect_list("removed").alias("removed"))
    # The texts are shuffled once: this join reads what the one before has dealt out.
    cut = texts.join(gone.hint("merge"), ["_id", "_key"], "left").select("_id", "_key", "_raw", "removed").mapInArrow(_cut(length), _CUT)
    rest = named.filter("_id is null").select("_id", "_key", "_raw", F.lit(None).cast("array<binary>").alias("removed")).mapInArrow(_cut(length), _CUT)
    rows = known.select("_id", "_key").join(cut, ["_id", "_key"]).unionByName(rest)
    return rows.select(F.col("_id").cast(kind).alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
