"""MinHash near-deduplication with sequential Bayesian verification.

1. Every text's set of word shingles gets a signature; equal sets form a class
   that goes on as one node. A node is a class, not an id, so rows that share an
   id lose nothing.
2. Signatures are cut into bands; representatives that share a band's key are
   candidates. The members of a bucket are first compared with its smallest
   member only. Signatures are compared batch by batch, and a pair is dropped
   as soon as the posterior probability that its similarity reaches the
   threshold falls below the chosen miss probability.
3. What survives is confirmed on full sets, and links are joined to components.
4. Buckets that then hold more than one component are compared in full, in
   pairs of blocks of bounded size and members, leaving out what is in one component
   already: by signatures, then by 32-bit hashes of the full sets, which can
   only count too much. What is left is confirmed as in 3. So no pair that
   shares a bucket is passed over, and only likely links become rows.

Full sets are rebuilt from the texts of documents that are compared; no set is
stored for the others.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import bounded_batches, columns_only, join_per_key, stored
from kinweave.llm.components import connected

#: 32 bands of 4 values: a pair at the threshold of 0.8 shares no band with
#: probability (1 - 0.8 ** 4) ** 32 = 5e-8.
BANDS, ROWS = 32, 4
SIGNATURE = BANDS * ROWS
BATCH = 16
#: Probability of dropping a pair that reaches the threshold, at each batch.
MISS = 1e-7
#: Shingles of one side of a comparison, so that the two sides' sets take about 32 MB.
BLOCK = 4_000_000
#: Members of one side, so that short texts don't make a block of very many.
MEMBERS = 2000
#: Ids that go out by broadcast rather than by a shuffle, counted first.
BROADCAST_IDS = 100_000
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
_r = np.random.default_rng(20)
_MULTIPLY = _r.integers(1, 2**63, SIGNATURE, dtype=np.uint64) | np.uint64(1)
_ADD = _r.integers(0, 2**63, SIGNATURE, dtype=np.uint64)


def shingles(text: str | None, k: int) -> set[tuple[str, ...]]:
    """Distinct runs of k words; all words as one run if there are fewer; empty without words."""
    words = _WORD.findall((text or "").translate(_LOWER))
    if not words:
        return set()
    if len(words) < k:
        return {tuple(words)}
    return set(zip(*[words[i:] for i in range(k)], strict=False))


def hashed(found: set[tuple[str, ...]]) -> np.ndarray:
    """Sorted 64-bit hashes of a set of shingles; the words have no space, so joins are unambiguous."""
    h = xxhash.xxh3_64_intdigest
    out = np.fromiter((h(" ".join(s)) for s in found), np.uint64, len(found))
    out.sort()
    return out


def signature(hashes: np.ndarray) -> np.ndarray:
    """The minimum of each of the hash functions over a set, in slices that bound memory."""
    best = np.full(SIGNATURE, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048):
        x = hashes[at : at + 2048, None] * _MULTIPLY + _ADD
        x ^= x >> np.uint64(31)
        np.minimum(best, x.min(axis=0), out=best)
    return (best >> np.uint64(32)).astype(np.uint32)


def posterior_reaches(matches: int, compared: int, threshold: float) -> float:
    """P(similarity >= threshold) after so many matches, from a uniform prior:
    the beta tail, as the binomial sum it equals."""
    n = compared + 1
    log_t, log_f = math.log(threshold), math.log1p(-threshold)
    terms = (math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * log_t + (n - i) * log_f for i in range(matches + 1))
    return sum(map(math.exp, terms))


def least_matches(threshold: float, miss: float) -> np.ndarray:
    """After each batch, the fewest matches with which a pair goes on."""
    out = []
    for n in range(BATCH, SIGNATURE + 1, BATCH):
        m = 0
        while m <= n and posterior_reaches(m, n, threshold) < miss:
            m += 1
        out.append(m)
    return np.array(out)


def survives(a: np.ndarray, b: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For rows of signatures of pairs, which are not dropped at any batch."""
    alive = np.arange(len(a))
    matches = np.zeros(len(a), np.int64)
    for i, need in enumerate(least):
        at = slice(i * BATCH, (i + 1) * BATCH)
        matches += (a[alive, at] == b[alive, at]).sum(axis=1)
        keep = matches >= need
        alive, matches = alive[keep], matches[keep]
        if not len(alive):
            break
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def _sizes_allow(m: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(m, n) >= percent * np.maximum(m, n)


def _key(members: bytes) -> bytes:
    return hashlib.blake2b(members, digest_size=16).digest()


def _sign(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [hashed(shingles(t, k)) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"),
                        part.column("own"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([_key(s.tobytes()) for s in sets], pa.binary()),
                        pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    ["id", "own", "n", "set_key", "sig"],
                )

    return run


def _full_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [hashed(shingles(t, k)).tobytes() for t in part.column("text").to_pylist()]
                # Should two texts of an id share a hash, the one that isn't the node's own has another set.
                own = pa.array([_key(s) == x for s, x in zip(sets, part.column("set_key").to_pylist(), strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column("node").filter(own), pa.array(sets, pa.binary()).filter(own)], ["node", "members"])

    return run


def _drop_pairs(least: np.ndarray):
    """Pairs with both signatures: those that the posterior doesn't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                a, b = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint32).reshape(-1, SIGNATURE) for c in ("sig_a", "sig_b"))
                keep = pa.array(survives(a, b, least))
                yield pa.RecordBatch.from_arrays([part.column("a").filter(keep), part.column("b").filter(keep)], ["a", "b"])

    return run


def _shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The upper halves of the hashes of full sets, in order."""
    for batch in batches:
        short = [(np.frombuffer(x, np.uint64) >> np.uint64(32)).astype(np.uint32).tobytes() for x in batch.column("members").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(short, pa.binary())], ["node", "short"])


def _confirm(percent: int):
    """Pairs with both full sets: those that reach the threshold, counted exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist(), strict=True):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    return run


def _compare_blocks(least: np.ndarray, percent: int):
    """Two blocks of a bucket, or one with itself: pairs of different components
    that neither the posterior nor 32-bit hashes of the full sets rule out, each
    in the first band that it shares."""

    def run(table: pa.Table) -> pa.Table:
        ids, labels, n, side = (table.column(c).to_numpy() for c in ("node", "label", "n", "side"))
        band = table.column("band")[0].as_py()
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(-1, SIGNATURE)
        sets = [np.frombuffer(x, np.uint32) for x in table.column("short").to_pylist()]
        first, second = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        within = not len(second)
        if within:
            second = first
        out = []
        for i in first:
            js = second[(labels[second] != labels[i]) & (ids[second] != ids[i])]
            if within:
                js = js[ids[js] > ids[i]]
            js = js[_sizes_allow(n[js], n[i], percent)]
            if len(js):
                js = js[survives(np.broadcast_to(sig[i], (len(js), SIGNATURE)), sig[js], least)]
            if len(js) and band:
                earlier = (sig[js, : band * ROWS] == sig[i, : band * ROWS]).reshape(len(js), band, ROWS)
                js = js[~earlier.all(axis=2).any(axis=1)]
            if len(js):
                # Short hashes can only add to what two sets share, so this loses no link.
                own, others = sets[i], np.concatenate([sets[j] for j in js])
                hit = own[np.minimum(np.searchsorted(own, others), len(own) - 1)] == others
                both = np.add.reduceat(hit, np.concatenate(([0], np.cumsum([len(sets[j]) for j in js])[:-1])), dtype=np.int64)
                js = js[100 * both >= percent * (n[i] + n[js] - both)]
            out += [(min(ids[i], ids[j]), max(ids[i], ids[j])) for j in js]
        a, b = zip(*out, strict=True) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


class NearDedup:
    """One run over ``docs``; ``percent`` is the threshold in hundredths."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, k: int = 5, percent: int = 80, miss: float = MISS):
        self.k, self.percent = k, percent
        self.least = least_matches(percent / 100, miss)
        named = bounded_batches(columns_only(docs, id_col, text_col))
        # Id and text's hash find a class's text again, whatever rows share the id.
        self.texts = named.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("own"))
        self.signed = stored(
            self.texts.mapInArrow(_sign(k), "id bigint, own bigint, n bigint, set_key binary, sig binary"), "signed"
        )

    def classes(self) -> DataFrame:
        """``node, set_key, rep, own, n, copies, sig``: a row for each set, with the
        smallest id that has it, that row's text hash, and a number of its own."""
        first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "own"))).alias("first")
        out = self.signed.groupBy("set_key").agg(first, F.max("n").alias("n"), F.count(F.lit(1)).alias("copies"), F.any_value("sig").alias("sig"))
        # Numbers are given when the table is written, and stay.
        out = out.select(F.monotonically_increasing_id().alias("node"), "set_key", F.col("first.id").alias("rep"), F.col("first.own").alias("own"), "n", "copies", "sig")
        return stored(out, "classes")

    def verified(self, pairs: DataFrame, sigs: DataFrame) -> DataFrame:
        """Links among candidate pairs ``a, b``."""
        one, two = sigs.toDF("a", "sig_a"), sigs.toDF("b", "sig_b")
        with_sigs = pairs.join(one, "a").join(two, "b").select("a", "b", "sig_a", "sig_b")
        return self.confirmed(with_sigs.mapInArrow(_drop_pairs(self.least), "a bigint, b bigint"))

    def full_sets(self, nodes: DataFrame) -> DataFrame:
        """``node, members`` of the nodes, rebuilt from their texts."""
        wanted = stored(nodes.join(self.reps.select("node", "id", "own", "set_key"), "node"), "wanted")
        few = wanted.count() <= BROADCAST_IDS
        texts = self.texts.join(F.broadcast(wanted) if few else wanted, ["id", "own"])
        sets = texts.select("node", "set_key", "text").mapInArrow(_full_sets(self.k), "node bigint, members binary")
        return stored(sets.dropDuplicates(["node"]), "sets")

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        pairs = stored(pairs, "survivors")
        sets = self.full_sets(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        one, two = sets.toDF("a", "set_a"), sets.toDF("b", "set_b")
        both = pairs.join(one, "a").join(two, "b").select("a", "b", "set_a", "set_b")
        return stored(both.mapInArrow(_confirm(self.percent), "a bigint, b bigint"), "links")

    def links(self, classes: DataFrame) -> DataFrame:
        """Confirmed links ``a < b`` between nodes, enough to join every two that
        share a bucket and reach the threshold."""
        self.reps = classes.filter(F.col("rep").isNotNull() & (F.col("n") > 0)).withColumnRenamed("rep", "id")
        width = ROWS * 4
        keys = F.transform(
            F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring(F.col("sig"), i * width + 1, F.lit(width)))
        )
        bands = self.reps.select("node", "n", F.posexplode(keys).alias("band", "key"))
        sigs = self.reps.select("node", "sig")
        # Buckets of one member are dropped; the rest know their smallest member.
        heads = bands.groupBy("key").agg(F.min_by("n", "node").alias("head_n"), F.min("node").alias("head"), F.count(F.lit(1)).alias("size"))
        heads = stored(heads.filter("size > 1"), "heads")
        total = heads.agg(F.sum("size")).first()[0] or 0
        members = stored(join_per_key(bands, heads, "key", "size", total).filter("head is not null"), "buckets")
        fits = 100 * F.least("n", "head_n") >= self.percent * F.greatest("n", "head_n")
        stars = members.filter((F.col("node") != F.col("head")) & fits).select(F.col("head").alias("a"), F.col("node").alias("b"))
        links = self.verified(stars.distinct(), sigs)
        return links.unionByName(self.rest(members, links, sigs)).distinct()

    def rest(self, members: DataFrame, links: DataFrame, sigs: DataFrame) -> DataFrame:
        """Links across the components of one bucket that comparing with its head left open.

        Of a bucket, the members of its largest component are compared with the
        others, and the others among themselves. Both are cut into blocks by a
        hash; each pair of blocks is one group. A group of copies that became
        one component thus costs as many rows as it has members, not its
        square, and of the pairs compared in a block only likely links leave it.
        Of buckets with the same members the one of the first band counts.
        """
        labels = connected(links).withColumnRenamed("v", "node")
        named = members.select("key", "band", "node", "n", "size").join(labels, "node", "left")
        named = stored(named.withColumn("label", F.coalesce("label", "node")), "labelled")
        parts = named.groupBy("key", "band", "size", "label").agg(
            F.count(F.lit(1)).alias("own"), F.sum("n").alias("held"), F.bit_xor(F.xxhash64("node")).alias("same")
        )
        mixed = parts.groupBy("key", "band", "size").agg(
            F.max_by(F.struct("label", "held", "own"), F.struct("own", "label")).alias("main"), F.sum("held").alias("held"), F.sum("own").alias("all"),
            F.count(F.lit(1)).alias("labels"), F.bit_xor("same").alias("same"),
        ).filter("labels > 1 and size > 2")
        mixed = mixed.groupBy("same", "size").agg(F.min_by(F.struct("key", "main", "held", "all"), "band").alias("m"))
        blocks = lambda held, n: F.greatest(F.ceil(held / F.lit(BLOCK)), F.ceil(n / F.lit(MEMBERS))).cast("int")
        mixed = mixed.select(
            "m.key",
            F.col("m.main.label").alias("main"),
            blocks(F.col("m.main.held"), F.col("m.main.own")).alias("mains"),
            blocks(F.col("m.held") - F.col("m.main.held"), F.col("m.all") - F.col("m.main.own")).alias("others"),
        )
        is_main = F.col("label") == F.col("main")
        own = F.pmod(F.xxhash64("node"), F.when(is_main, F.col("mains")).otherwise(F.col("others"))).cast("int")
        open_ = stored(named.drop("size").join(stored(mixed, "mixed"), "key").withColumn("own", own), "open")
        sets = self.full_sets(open_.select("node").distinct()).mapInArrow(_shorten, "node bigint, short binary")
        known = stored(sigs.join(sets, "node"), "open-sets")
        upto = lambda n: F.sequence(F.lit(0), n - 1)
        pair = lambda kind, one, two, side: F.struct(
            F.lit(kind).alias("kind"), one.alias("one"), two.alias("two"), side.alias("side")
        )
        own = F.col("own")
        with_others = F.transform(upto(F.col("others")), lambda o: pair("main", own, o, F.lit(0)))
        with_mains = F.transform(upto(F.col("mains")), lambda m: pair("main", m, own, F.lit(1)))
        among = F.transform(
            upto(F.col("others")), lambda o: pair("other", F.least(own, o), F.greatest(own, o), F.when(own > o, 1).otherwise(0))
        )
        dealt = open_.select(
            "key", "band", "node", "n", "label", F.explode(F.when(is_main, with_others).otherwise(F.concat(with_mains, among))).alias("p")
        ).select("key", "band", "node", "n", "label", "p.*")
        compared = (
            dealt.join(known, "node")
            .groupBy("key", "kind", "one", "two")
            .applyInArrow(_compare_blocks(self.least, self.percent), "a bigint, b bigint")
        )
        return self.confirmed(compared.distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """``id, n_shingles, component_id, kept`` for every row.

    Ids are integers. Texts are linked where their sets of k-word shingles, ASCII letters in
    lower case, have at least ``percent`` hundredths of their union in common;
    a component's smallest id names it and is kept. A null, empty or wordless
    text has an empty set, is linked with nothing and kept. Texts are read
    whole. Equal sets are linked whatever the texts. Repeated rows are
    reported each. If rows share an id but not their text, each is in the
    component of its own text. A row with a null id is kept and named by
    nothing; other rows with its text are linked as ever, and a text that only
    such rows have is linked with no other. Extra columns aren't read; an empty
    table gives an empty result.
    """
    run = NearDedup(docs, id_col, text_col, k, percent)
    classes = run.classes()
    linked = stored(connected(run.links(classes)).withColumnRenamed("v", "node").join(classes.select("node", "rep"), "node"), "linked")
    names = stored(linked.groupBy("label").agg(F.min("rep").alias("component"), F.count(F.lit(1)).alias("nodes")), "components")
    total = names.agg(F.sum("nodes")).first()[0] or 0
    named = join_per_key(linked.select("node", "label"), names, "label", "nodes", total).select("node", "component")
    per_set = classes.select("node", "set_key", "rep", "copies").join(named, "node", "left")
    per_set = stored(per_set.select("set_key", F.coalesce("component", "rep").alias("component"), "copies"), "named")
    total = classes.agg(F.sum("copies")).first()[0] or 0
    rows = join_per_key(run.signed.select("id", "n", "set_key"), per_set, "set_key", "copies", total)
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component"))
    kept = F.col("id").eqNullSafe(component) | F.col("id").isNull()
    return rows.select(
        F.col("id").cast(dict(docs.dtypes)[id_col]).alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), component).alias("component_id"),
        kept.alias("kept"),
    )
