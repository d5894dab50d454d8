"""SentencePiece encoding and decoding by a Viterbi search that shares prefixes.

Texts are cut into marked words; the distinct words of a batch are sorted, which
lays out their trie, and the trie is walked depth-first: the forward states of a
common prefix are computed once and kept on a stack for every word below it.

Two model kinds are served. For a unigram model the forward score of a prefix is
its best sum of piece scores. For a BPE model sums of scores would give other
pieces than the model's merges, so a step from piece to piece costs nothing if
merging leaves that pair of pieces as it is, and is forbidden otherwise. A
sequence of pieces is the model's encoding exactly if all its neighbours are
such pairs, so of every prefix one path survives and the search returns it.

Models with the identity normalizer are read (no text normalisation, the marker
put before the text, spaces kept).
"""

from __future__ import annotations

import hashlib
import heapq
import re
import sys
import types
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import bounded_batches, columns_only

MARK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Bytes of a generation of words that are kept between batches, so memory doesn't
#: follow the vocabulary of the corpus; a word in use moves on to the next generation.
CACHE_BYTES = 32_000_000
#: A longer word isn't kept.
KEPT_CHARS = 64
#: Pairs of pieces that are kept, about 100 bytes each.
PAIRS = 200_000
#: A longer word doesn't go through the trie of words but is searched by itself, in parts of this length.
PART_CHARS = 4096
#: Text that is encoded together.
GROUP_BYTES = 4_000_000
_LINE = re.compile("(\n)")


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        shift += 7
        if b < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            if kind == 2:
                size, at = _varint(data, at)
            else:
                size = 4 if kind == 5 else 8
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class Model:
    """Pieces, scores and kinds of a model file."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.algorithm, self.byte_fallback = UNIGRAM, False
        self.prefix_mark, self.squeeze, self.escape, normalizer = True, True, True, b"nmt_nfkc"
        for number, value in _fields(data):
            own = dict(_fields(value)) if number in (1, 2, 3) else {}
            if number == 1:
                self.pieces.append(own[1].decode())
                self.scores.append(float(np.frombuffer(own.get(2, bytes(4)), "<f4")[0]))
                self.kinds.append(own.get(3, NORMAL))
            elif number == 2:
                self.algorithm, self.byte_fallback = own.get(3, UNIGRAM), bool(own.get(35, 0))
            elif number == 3:
                normalizer = own.get(1, b"")
                self.prefix_mark, self.squeeze, self.escape = (bool(own.get(n, 1)) for n in (3, 4, 5))
        if normalizer not in (b"identity", b"") or self.squeeze or not self.escape or not self.prefix_mark:
            raise ValueError("only models with the identity normalizer that keep and mark spaces are served")
        if self.algorithm not in (UNIGRAM, BPE) or not self.byte_fallback:
            raise ValueError("only unigram and BPE models with byte fallback are served")
        self.byte_ids = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k in (NORMAL, USER)}


class Encoder:
    def __init__(self, model: Model):
        self.model, self.ids, self.scores = model, model.ids, model.scores
        self.bpe = model.algorithm == BPE
        self.worst = min(self.scores) - 10.0
        self.cuts_lines = not any("\n" in p for p in self.ids)
        # Pieces as a trie: a node's children by character, each with its own children and its piece or -1.
        # Runs of markers are merged apart, so they aren't in it.
        self.root: dict[str, tuple[dict, int]] = {}
        for piece, k in self.ids.items():
            if len(piece) > 1 and not piece.strip(MARK):
                continue
            node = self.root
            for c in piece[:-1]:
                node = node.setdefault(c, ({}, -1))[0]
            node[piece[-1]] = (node.get(piece[-1], ({}, -1))[0], k)
        self.pairs: dict[int, bool] = {}
        self.trees: dict[str, tuple[list[tuple[str, float]], list[tuple[str, float]]] | None] = {}
        # Words' ids are kept as bytes, four for each id.
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0
        self.mark = array("i", [self.ids[MARK]]).tobytes() if MARK in self.ids else b""
        self.runs: dict[int, bytes] = {}

    def merged(self, symbols: list[str], last: list[str] | None = None) -> list[str]:
        """The model's own merging: again and again the best-scored pair, the
        leftmost of equals. ``last`` gets the two halves of the last merge."""
        n = len(symbols)
        left, right, text = list(range(-1, n - 1)), list(range(1, n + 1)), list(symbols)
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if 0 <= i and j < n and (k := self.ids.get(both := text[i] + text[j])) is not None:
                heapq.heappush(heap, (-self.scores[k], i, j, both))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if not text[i] or not text[j] or right[i] != j or text[i] + text[j] != both:
                continue
            if last is not None:
                last[:] = [text[i], text[j]]
            text[i], text[j], right[i] = both, "", right[j]
            if right[j] < n:
                left[right[j]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [t for t in text if t]

    def tree(self, piece: str) -> tuple[list[tuple[str, float]], list[tuple[str, float]]] | None:
        """The symbols at a piece's left and right end while it is merged, from
        a character to the piece, each with the cost of the merge that makes
        it; None if merging its characters gives something else."""
        if piece not in self.trees:
            if len(piece) == 1:
                self.trees[piece] = ([(piece, -np.inf)],) * 2
            else:
                halves: list[str] = []
                whole = self.merged(list(piece), halves) == [piece]
                left, right = (self.tree(halves[0]), self.tree(halves[1])) if whole else (None, None)
                own = [(piece, -self.scores[self.ids[piece]])]
                self.trees[piece] = (left[0] + own, right[1] + own) if left and right else None
        return self.trees[piece]

    def follows(self, last: int, k: int) -> bool:
        """Whether piece ``k`` may come after piece ``last`` (below 0: after nothing that merges)."""
        key = (last + 2) << 32 | k
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            a, b = self.model.pieces[last] if last >= 0 else "", self.model.pieces[k]
            known = self.pairs[key] = self.tree(b) is not None and (not a or self.stays(a, b))
        return known

    def stays(self, a: str, b: str) -> bool:
        """Whether merging leaves the pieces a, b as they are.

        Merges happen in the order of their costs. At each moment one symbol of
        a and one of b meet at the boundary; the pieces stay if no such two are
        a piece that costs less than what either is merged into within its own
        side. Of equal costs the merge further left goes first.
        """
        left, right = self.tree(a)[1], self.tree(b)[0]
        if any(x[1] > y[1] for side in (left, right) for x, y in zip(side, side[1:], strict=False)):
            return self.merged(list(a + b)) == [a, b]
        i = j = 0
        while True:
            over_left = left[i + 1][1] if i + 1 < len(left) else np.inf
            over_right = right[j + 1][1] if j + 1 < len(right) else np.inf
            k = self.ids.get(left[i][0] + right[j][0])
            if k is not None and -self.scores[k] < over_left and -self.scores[k] <= over_right:
                return False
            if over_left == over_right == np.inf:
                return True
            if over_left <= over_right:
                i += 1
            else:
                j += 1

    def _advance(self, fresh: str, at: int, lasts, begins, totals, open_) -> None:
        """Adds the forward states of the prefixes that end in ``fresh``; ``at`` is the last state's place.

        A state is its last piece (-1 at the start, -2 for a character without
        one) and where that begins, its best score, and the pieces that may
        still grow, longest first.
        """
        bpe, root, scores, worst, pairs = self.bpe, self.root, self.scores, self.worst, self.pairs
        for c in fresh:
            grown, best, begin, total = [], -2, at, 0.0 if bpe else worst + totals[at]
            for node, start in open_[at]:
                if (child := node.get(c)) is None:
                    continue
                children, k = child
                if children:
                    grown.append((children, start))
                if k < 0:
                    continue
                if not bpe:
                    if best < 0 or totals[start] + scores[k] > total:
                        best, begin, total = k, start, totals[start] + scores[k]
                elif best < 0:
                    ok = pairs.get((lasts[start] + 2) << 32 | k)
                    if ok or (ok is None and self.follows(lasts[start], k)):
                        best, begin = k, start
            if (child := root.get(c)) is not None:
                children, k = child
                if children:
                    grown.append((children, at))
                if k >= 0:
                    if not bpe:
                        if best < 0 or totals[at] + scores[k] > total:
                            best, begin, total = k, at, totals[at] + scores[k]
                    elif best < 0 and self.follows(lasts[at], k):
                        best, begin = k, at
            at += 1
            lasts.append(best)
            begins.append(begin)
            totals.append(total)
            open_.append(grown)

    def _path(self, at: int, text: str, lasts, begins) -> bytes:
        """The ids of the best way to the state at ``at``, whose first character is the first of ``text``."""
        out: list[int] = []
        while at:
            k, at = lasts[at], begins[at]
            if k >= 0:
                out.append(k)
            else:
                out.extend(self.model.byte_ids[b] for b in reversed(text[at].encode()))
        out.reverse()
        return array("i", out).tobytes()

    def encode_words(self, words: list[str], prefix: str) -> dict[str, bytes]:
        """The words' ids, each with ``prefix`` before it, by one walk through their trie."""
        states = lasts, begins, totals, open_ = [-1], [0], [0.0], [[]]
        found: dict[str, bytes] = {}
        before, base = "", len(prefix)
        for word in sorted(words):
            if len(word) > PART_CHARS:
                found[word] = self.encode_long(prefix + word)
                continue
            if len(lasts) == 1:
                fresh, at = prefix + word, 0
            else:
                shared, most = 0, min(len(word), len(before))
                while shared < most and word[shared] == before[shared]:
                    shared += 1
                at = shared + base
                for x in states:
                    del x[at + 1 :]
                fresh = word[shared:]
            self._advance(fresh, at, *states)
            found[word] = self._path(len(lasts) - 1, prefix + word, lasts, begins)
            before = word
        return found

    def encode_long(self, text: str) -> bytes:
        """The ids of one long word, its marker included, part by part.

        Every way to a later state leads through the last state or one that an
        open piece begins at. Where the ways to all these meet, what lies
        before is settled: its ids are written and its states dropped. So
        memory holds a few parts, and eight bytes for each state and each open
        list as long as the ways don't meet, as in one character repeated.
        """
        lasts, begins, totals, open_ = array("i", [-1]), array("i", [0]), [0.0], [[]]
        out, done, tried = [], 0, 0
        for first in range(0, len(text), PART_CHARS):
            self._advance(text[first : first + PART_CHARS], len(lasts) - 1, lasts, begins, totals, open_)
            end = len(lasts) - 1
            open_[:] = [None] * end + [open_[-1]]
            if self.bpe:
                totals[:] = [0.0] * (end + 1)
            if end < 2 * tried:
                continue
            heads = {end, *(start for _, start in open_[-1])}
            while len(heads) > 1:
                last = max(heads)
                heads.remove(last)
                heads.add(begins[last])
            tried, met = end, heads.pop()
            if met:
                out.append(self._path(met, text[done : done + met], lasts, begins))
                lasts, begins = lasts[met:], array("i", [b - met for b in begins[met:]])
                totals = [t - totals[met] for t in totals[met:]]
                open_ = [None] * (end - met) + [[(node, start - met) for node, start in open_[-1]]]
                done, tried = done + met, end - met
        out.append(self._path(len(lasts) - 1, text[done:], lasts, begins))
        return b"".join(out)

    def run(self, marks: int) -> bytes:
        """A run of markers, which the model merges among themselves."""
        if marks > KEPT_CHARS:
            return array("i", [self.ids[t] for t in self.merged([MARK] * marks)]).tobytes()
        if marks not in self.runs:
            self.runs[marks] = array("i", [self.ids[t] for t in self.merged([MARK] * marks)]).tobytes() if marks else b""
        return self.runs[marks]

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """The ids of marked words that are too long to be kept; those of all others
        are in the cache then. Words are cut at line breaks first if no piece of
        the model crosses one."""
        words.discard("")
        if self.held > CACHE_BYTES:
            self.older, self.cache, self.held = self.cache, {}, 0
        fresh: list[str] = []
        for w in words:
            if w not in self.cache:
                if (ids := self.older.get(w)) is None:
                    fresh.append(w)
                else:
                    self._keep(w, ids)
        lines = {w for w in fresh if "\n" in w} if self.cuts_lines else set()
        found = self.encode_words([w for w in fresh if w not in lines], MARK)
        cut = {w: _LINE.split(w) for w in lines}
        first = self.encode_words(list({p[0] for p in cut.values()}), MARK)
        later = self.encode_words(list({x for p in cut.values() for x in p[1:] if x}), "")
        for w, (head, *tail) in cut.items():
            found[w] = first[head] + b"".join([later[p] for p in tail if p])
        long: dict[str, bytes] = {}
        for w, ids in found.items():
            if len(w) > KEPT_CHARS:
                long[w] = ids
            else:
                self._keep(w, ids)
        return long

    def _keep(self, word: str, ids: bytes) -> None:
        self.cache[word] = ids
        self.held += sys.getsizeof(word) + sys.getsizeof(ids) + 100  # and its place in the table

    @staticmethod
    def cut(text: str) -> list[str]:
        """The words between markers; an empty one where markers stand together."""
        return text.replace(MARK, " ").split(" ") if text else []

    def ids_of(self, words: list[str], long: dict[str, bytes]) -> bytes:
        """The ids of a text's words, which have been learned."""
        cache = self.cache
        get = (lambda w: long[w] if len(w) > KEPT_CHARS else cache[w]) if long else cache.__getitem__
        if "" not in words:
            return b"".join(map(get, words))
        parts: list[bytes] = []
        marks = 0  # not yet written: markers that may still merge with each other
        for w in words:
            if not w:
                marks += 1
                continue
            own = get(w)
            if marks and own[:4] == self.mark:
                # A word's marker that stayed alone merges with the run before it.
                parts += (self.run(marks + 1), own[4:])
            else:
                parts += (self.run(marks), own)
            marks = 0
        parts.append(self.run(marks))
        return b"".join(parts)

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text. Texts are cut twice rather than held in words."""
        long = self.learn(set().union(*(self.cut(t) for t in texts if t)))
        return [self.ids_of(self.cut(t), long) if t else b"" for t in texts]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [np.frombuffer(x, np.int32).tolist() for x in self.encode_batch(texts)]


class Decoder:
    def __init__(self, model: Model):
        rows = zip(model.pieces, model.kinds, strict=True)
        text = {CONTROL: lambda p: b"", BYTE: lambda p: bytes([int(p[3:5], 16)]), UNKNOWN: lambda p: b" \xe2\x81\x87 "}
        self.bytes = pa.array([text.get(k, lambda p: p.replace(MARK, " ").encode())(p) for p, k in rows], pa.large_binary())

    def decode_lists(self, ids: pa.ListArray) -> list[str]:
        """A text for each list. Bytes that aren't valid UTF-8 become replacement characters; the first marker goes."""
        joined = self.bytes.take(ids.flatten())
        ends = np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        _, offsets, data = joined.buffers()
        places = np.frombuffer(offsets, np.int64)[joined.offset :] if offsets is not None else np.zeros(1, np.int64)
        view = memoryview(data or b"")
        out, at = [], int(places[0])
        for end in places[ends].tolist():
            text = str(view[at:end], "utf-8", "replace")
            out.append(text[1:] if text[:1] == " " else text)
            at = end
        return out

    def decode(self, ids: list[int]) -> str:
        return self.decode_lists(pa.array([ids], pa.list_(pa.int32())))[0]


def _tool(data: bytes, kind: type) -> Encoder | Decoder:
    """One encoder or decoder per worker process and model, kept between tasks
    in a module of the process, since functions sent by value have no own."""
    kept = sys.modules.setdefault("_kinweave_worker", types.ModuleType("_kinweave_worker")).__dict__
    key = f"{kind.__name__}-{hashlib.sha256(data).hexdigest()}"
    if key not in kept:
        kept[key] = kind(Model(data))
    return kept[key]


def _grouped(batches: Iterator[pa.RecordBatch], most: int = GROUP_BYTES) -> Iterator[list[pa.RecordBatch]]:
    """Batches together up to so many bytes: more words share the walk through their trie."""
    group: list[pa.RecordBatch] = []
    held = 0
    for batch in batches:
        group.append(batch)
        held += batch.nbytes
        if held >= most:
            yield group
            group, held = [], 0
    if group:
        yield group


def _encoded(encoder: Encoder, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.ListArray]]:
    """Ids of the rows and of their pieces, a batch at a time; the words of several batches are learned together."""
    for group in _grouped(batches):
        texts = [batch.column(1).to_pylist() for batch in group]
        rows = encoder.encode_batch([t for own in texts for t in own])
        at = 0
        for batch in group:
            own = rows[at : at + batch.num_rows]
            at += batch.num_rows
            offsets = np.zeros(len(own) + 1, np.int32)
            np.cumsum([len(x) // 4 for x in own], out=offsets[1:])
            yield batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(own), np.int32)))


def _read_model(spark, model_file: str):
    with open(model_file, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, ids`` for every row: the model's pieces of the whole text.

    A null or empty text has no pieces. Texts of any length are cut into words;
    what is kept of words between batches is bounded in bytes (CACHE_BYTES), and
    a word of any length is searched part by part in time proportional to it
    (``Encoder.encode_long``), so memory follows a batch's texts. Characters
    without a piece become bytes. Repeated rows are encoded each; null ids stay
    null; extra columns aren't read; an empty table stays empty.
    """
    data = _read_model(docs.sparkSession, model_file)
    named = bounded_batches(columns_only(docs, id_col, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, ids in _encoded(_tool(data.value, Encoder), batches):
            yield pa.RecordBatch.from_arrays([key, ids], [id_col, "ids"])

    return named.mapInArrow(run, f"`{id_col}` {named.dtypes[0][1]}, ids array<int>")


def decode(encoded: DataFrame, model_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id, ids, text``: the text of each row's pieces.

    Null and empty lists give an empty text; a piece that the model doesn't have
    is an error. Lists of any length are read whole; repeated rows are decoded
    each; null ids of rows stay null; extra columns aren't read; an empty table
    stays empty.
    """
    data = _read_model(encoded.sparkSession, model_file)
    named = bounded_batches(columns_only(encoded, id_col, ids_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _tool(data.value, Decoder)
        for batch in batches:
            texts = decoder.decode_lists(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], [id_col, "ids", "text"])

    return named.mapInArrow(run, f"`{id_col}` {named.dtypes[0][1]}, ids array<int>, text string")


def round_trip(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``decode(encode(docs))`` with both in one worker of a task, which takes less
    memory than two; the rules of both hold."""
    data = _read_model(docs.sparkSession, model_file)
    named = bounded_batches(columns_only(docs, id_col, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _tool(data.value, Decoder)
        for key, ids in _encoded(_tool(data.value, Encoder), batches):
            yield pa.RecordBatch.from_arrays([key, ids, pa.array(decoder.decode_lists(ids), pa.string())], [id_col, "ids", "text"])

    return named.mapInArrow(run, f"`{id_col}` {named.dtypes[0][1]}, ids array<int>, text string")


def expected_text(text_col: str = "text"):
    """What decoding gives back: the text, its markers read as spaces."""
    return F.replace(F.coalesce(F.col(text_col), F.lit("")), F.lit(MARK), F.lit(" "))
