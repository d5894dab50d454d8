"""Secret scans with an incremental ledger of blobs.

Every text version is addressed by its SHA-256. The ledger is a folder with two
tables that only grow: which (blob, rule version) pairs have been scanned, and
what was found in them. A scan reads only the pairs it hasn't seen, and findings
are joined back to every row, copy or path that has the blob. Findings are
written before their blobs count as scanned, so a scan that fails in between is
repeated; what it had written twice counts once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.common import bounded_batches, columns_only, join_per_key, scratch, stored

#: Fixed by the query's contract: kind, pattern, letters in either case, group, least length of that group;
#: and, of our own, a pattern of a part that every kept match has, by which texts without any are passed over (None: there is none).
BASE_RULES = [
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 8,
     r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"),
    ("access", r"AKIA[A-Z0-9]+", False, 0, 16, r"AKIA[A-Z0-9]{12}"),
    ("hex", r"[0-9a-f]+", False, 0, 32, r"[0-9a-f]{32}"),
]
#: Kinds of our own: token prefixes and block heads that their issuers document.
MORE_RULES = [
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", False, 0, 40, r"gh[pousr]_"),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", False, 0, 40, r"eyJ[A-Za-z0-9_-]+\.eyJ"),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", False, 0, 1, r"-----BEGIN "),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{15,}", False, 0, 20, r"xox[abprs]-"),
]
RULES = BASE_RULES + MORE_RULES


def may_match(rules: list[tuple]) -> str | None:
    """A pattern without which a text has no finding; None if some rule has no such part."""
    parts = [r[5] for r in rules]
    return "|".join(f"(?:{p})" for p in parts) if all(parts) else None


def rule_version(rules: list[tuple]) -> str:
    return "v" + hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def spans_of(text: str, rules: list[tuple]) -> list[tuple[str, int, int]]:
    """``kind, start, end`` of the leftmost non-overlapping matches per kind, short ones dropped."""
    out = []
    for kind, pattern, any_case, group, least, *_ in rules:
        flags = re.ASCII | (re.IGNORECASE if any_case else 0)
        out += [(kind, m.start(), m.end()) for m in re.finditer(pattern, text, flags) if len(m.group(group)) >= least]
    return out


def scanner(rules: list[tuple]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (digest, kind, start, end)
                for digest, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                for kind, start, end in spans_of(text, rules)
            ]
            columns = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.string(), pa.int64(), pa.int64()), strict=True)],
                ["digest", "kind", "start", "end"],
            )

    return scan


class BlobLedger:
    """A folder with the tables ``scanned`` (digest, rules) and ``findings`` (digest, kind, start, end, rules).

    Both are appended to and never changed; rows of a rule version stand in a
    folder of their own. A folder that has a ledger is opened with what it holds.
    """

    SCANNED = "digest binary, rules string"
    FINDINGS = "digest binary, kind string, start bigint, end bigint, rules string"

    def __init__(self, spark: SparkSession, path: str | None = None, rules: list[tuple] = RULES):
        self.spark, self.rules = spark, rules
        self.path = (path or scratch(spark, "ledger")).rstrip("/")
        self.version = rule_version(rules)
        for name, schema in (("scanned", self.SCANNED), ("findings", self.FINDINGS)):
            spark.createDataFrame([], schema).write.mode("ignore").partitionBy("rules").parquet(f"{self.path}/{name}")

    def with_rules(self, rules: list[tuple]) -> BlobLedger:
        """The same ledger under other rules: all blobs are unseen for a new version."""
        return BlobLedger(self.spark, self.path, rules)

    def _table(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    @property
    def scanned(self) -> DataFrame:
        return self._table("scanned", self.SCANNED).distinct()

    @property
    def findings(self) -> DataFrame:
        return self._table("findings", self.FINDINGS).distinct()

    def _append(self, name: str, rows: DataFrame) -> None:
        rows.withColumn("rules", F.lit(self.version)).write.mode("append").partitionBy("rules").parquet(f"{self.path}/{name}")

    def unseen(self, blobs: DataFrame) -> DataFrame:
        """``blobs`` that haven't been scanned under this version."""
        return blobs.join(self._table("scanned", self.SCANNED).filter(F.col("rules") == self.version).select("digest"), "digest", "left_anti")

    def scan(self, versions: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Scans what is unseen and returns ``digest, copies`` of all blobs of ``versions``.

        A blob's text is fetched from its row with the largest id, by a join
        on ids, which no copies make uneven.
        """
        keyed = self.keyed(versions, id_col, text_col)
        blobs = stored(keyed.groupBy("digest").agg(F.max("_id").alias("_id"), F.count(F.lit(1)).alias("copies")), "blobs")
        fresh = stored(self.unseen(blobs.select("digest", "_id")), "fresh")
        if fresh.isEmpty():
            return blobs
        texts = keyed.join(fresh, (keyed["_id"].eqNullSafe(fresh["_id"])) & (keyed["digest"] == fresh["digest"])).select(
            keyed["digest"], "_text"
        )
        if (may := may_match(self.rules)) is not None:
            texts = texts.filter(F.col("_text").rlike(may))
        self._append("findings", texts.mapInArrow(scanner(self.rules), "digest binary, kind string, start bigint, end bigint").distinct())
        self._append("scanned", fresh.select("digest"))
        return blobs

    @staticmethod
    def keyed(versions: DataFrame, id_col: str, text_col: str) -> DataFrame:
        text = F.coalesce(F.col(text_col), F.lit(""))
        return bounded_batches(columns_only(versions, id_col, text_col)).select(
            F.col(id_col).alias("_id"), text.alias("_text"), F.unhex(F.sha2(text, 256)).alias("digest")
        )

    def per_blob(self) -> DataFrame:
        """``digest`` and its spans under this version, ordered by start, then by the rules' order.

        A blob's spans are bounded by its own length."""
        kinds = F.array(*[F.lit(r[0]) for r in self.rules])
        own = self._table("findings", self.FINDINGS).filter(F.col("rules") == self.version).distinct()
        span = F.struct("start", F.array_position(kinds, F.col("kind")).alias("rank"), "end", "kind")
        return own.groupBy("digest").agg(F.array_sort(F.collect_list(span)).alias("spans"))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ledger: BlobLedger | None = None) -> DataFrame:
    """``id, n_assign, n_access, n_hex, base_sha256, spans`` for every row.

    A null text counts as empty and has no spans; long texts are scanned whole.
    Repeated rows and copies are reported each from one scan of their blob;
    rows that share an id keep their own texts' findings. Extra columns aren't
    read; an empty table gives an empty result. Without a ``ledger`` a new one
    is begun in the shared folder, and every blob is unseen.
    """
    ledger = ledger or BlobLedger(docs.sparkSession)
    blobs = ledger.scan(docs, id_col, text_col)
    total = blobs.agg(F.sum("copies")).first()[0] or 0
    # Only blobs with findings are joined; all other rows get the empty result.
    per_blob = ledger.per_blob().join(blobs.select("digest", "copies"), "digest")
    rows = join_per_key(BlobLedger.keyed(docs, id_col, text_col).select("_id", "digest"), stored(per_blob, "spans"), "digest", "copies", total)
    spans = F.coalesce("spans", F.array().cast(per_blob.schema["spans"].dataType))
    base = [r[0] for r in BASE_RULES]
    text = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")
    return rows.select(
        F.col("_id").alias(id_col),
        *[count(k).alias(f"n_{k}") for k in base],
        F.sha2(text(F.filter(spans, lambda s: s["kind"].isin(*base))), 256).alias("base_sha256"),
        text(spans).alias("spans"),
    )
