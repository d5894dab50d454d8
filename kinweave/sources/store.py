"""Stores of the graph: in the session, or as Parquet snapshots in a folder.

A snapshot store never overwrites: a commit writes new folders for the buckets
of rows that it changes and then one manifest, ``manifest-<n>.json``, under a
name that must not exist yet. The highest manifest is the state. A writer that
finds its number taken reads the state again and repeats its change on it.

The manifest gets its name by one step that fails if the name exists: a hard
link on a local disk, elsewhere a rename that refuses an existing target, which
HDFS does atomically. A store on an object store without such a rename must have
one writer at a time.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.operators.relational import Dealt
from kinweave.plans.lineage import cut_by
from kinweave.plans.schema import DISTANCES, EDGES, MUTES

TABLES = {"follows": EDGES, "mutes": MUTES, "root_distances": DISTANCES}
#: A table, the keys of its first column whose rows change, and what becomes of rows in their buckets.
Change = tuple[str, DataFrame, Callable[[DataFrame], DataFrame]]
#: Buckets of a new snapshot store's tables, by a hash of their first column.
BUCKETS = 64
TRIES = 10


class _Store:
    """What both stores share: copies dealt out for searches, kept until the table changes."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._dealt: dict[tuple[str, str], tuple[object, DataFrame | Dealt]] = {}

    def dealt(self, name: str, key: str) -> DataFrame:
        """The table dealt out by ``key`` once for each of its versions, so the levels of searches don't shuffle it."""
        state = self.state_of(name)
        known = self._dealt.get((name, key))
        if known is None or known[0] != state:
            known = self._dealt[name, key] = (state, cut_by(self.table(name), key))
        return known[1]

    def dealt_back(self) -> Dealt:
        """The follows dealt out by followed key, celebrities' followers spread, once for each version."""
        state = self.state_of("follows")
        known = self._dealt.get(("follows", "back"))
        if known is None or known[0] != state:
            known = self._dealt["follows", "back"] = (state, Dealt(self.table("follows"), backward=True))
        return known[1]

    def update(self, name: str, keys: DataFrame, change: Callable[[DataFrame], DataFrame], metadata: dict[str, str]) -> None:
        """``update_all`` of one table."""
        self.update_all([(name, keys, change)], metadata)

    def close(self) -> None:
        self._dealt = {}


class MemoryStore(_Store):
    """Tables that live as long as the session."""

    def __init__(self, spark: SparkSession):
        super().__init__(spark)
        self.metadata, self._tables = {}, {}

    def refresh(self) -> None:
        """Nobody else writes here."""

    def vacuum(self, keep: int = 1, older_than: float = 3600.0) -> list[str]:
        """Nothing is left behind here."""
        return []

    def state_of(self, name: str) -> object:
        return id(self._tables.get(name))

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            return self.spark.createDataFrame([], TABLES[name])
        return self._tables[name]

    def dealt(self, name: str, key: str) -> DataFrame:
        own = name in self._tables and key == TABLES[name].names[0]
        return self._tables[name] if own else super().dealt(name, key)

    def has(self, name: str) -> bool:
        return name in self._tables

    def commit(self, tables: dict[str, DataFrame | None], metadata: dict[str, str]) -> None:
        """Replaces the given tables (None drops one) and metadata together."""
        fresh = {k: None if v is None else cut_by(v, v.columns[0]) for k, v in tables.items()}
        self._tables = {k: v for k, v in (self._tables | fresh).items() if v is not None}
        self.metadata = self.metadata | metadata

    def update_all(self, changes: list[Change], metadata: dict[str, str]) -> None:
        """Replaces each table by what its change makes of it, all together."""
        self.commit({name: change(self.table(name)) for name, _, change in changes}, metadata)

    def close(self) -> None:
        super().close()
        self._tables = {}


class Taken(RuntimeError):
    """Another writer has published the version."""


class SnapshotStore(_Store):
    """Tables as Parquet folders under ``path``, on any file system Spark writes to.

    Several stores may be open on one path; each sees the others' commits when
    it is refreshed.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        super().__init__(spark)
        self.path = path.rstrip("/")
        self._Path = spark._jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._Path(self.path).getFileSystem(self._conf)
        self._fs.mkdirs(self._Path(self.path))
        self._version, self._folders, self.metadata, self.buckets = 0, {}, {}, buckets
        self.refresh()

    # Reading

    def _manifests(self) -> list[int]:
        names = [f.getPath().getName() for f in self._fs.listStatus(self._Path(self.path))]
        return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-"))

    def refresh(self) -> None:
        """Takes on the newest state if another writer has committed one."""
        found = self._manifests()
        if found and found[-1] != self._version:
            state = self._read(found[-1])
            self._version, self._folders, self.metadata, self.buckets = found[-1], state["tables"], state["metadata"], state["buckets"]

    def _name(self, version: int) -> str:
        return f"{self.path}/manifest-{version:012d}.json"

    def _read(self, version: int) -> dict:
        stream = self._fs.open(self._Path(self._name(version)))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def state_of(self, name: str) -> object:
        return tuple(sorted(self._folders.get(name, {}).items()))

    def table(self, name: str, only: list[int] | None = None) -> DataFrame:
        """The table, or its rows in some buckets."""
        folders = [f for b, f in self._folders.get(name, {}).items() if only is None or int(b) in only]
        if not folders:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(*[f"{self.path}/{f}" for f in folders])

    def has(self, name: str) -> bool:
        return name in self._folders

    # Writing

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _write(self, name: str, rows: DataFrame) -> dict[str, str]:
        """Folders of the buckets that have rows, all in one new folder."""
        top, key = f"{name}-{uuid.uuid4().hex}", TABLES[name].names[0]
        # Rebalanced, not only dealt by bucket: tasks follow the rows, so a large bucket
        # or one author's long list is written by several tasks and small buckets share one.
        dealt = rows.select(*TABLES[name].names, self._bucket(F.col(key)).alias("bucket")).hint("rebalance", "bucket")
        # Sorted within files, so that a lookup by key skips row groups by their ranges.
        dealt.sortWithinPartitions("bucket", key).write.partitionBy("bucket").parquet(f"{self.path}/{top}")
        names = [f.getPath().getName() for f in self._fs.listStatus(self._Path(f"{self.path}/{top}"))]
        return {n.removeprefix("bucket="): f"{top}/{n}" for n in names if n.startswith("bucket=")}

    def commit(self, tables: dict[str, DataFrame | None], metadata: dict[str, str]) -> None:
        """Replaces the given tables (None drops one) and metadata together."""
        fresh = {name: None if df is None else self._write(name, df) for name, df in tables.items()}
        for _ in range(TRIES):
            folders = {k: v for k, v in (self._folders | fresh).items() if v is not None}
            try:
                return self._publish(folders, self.metadata | metadata)
            except Taken:
                self.refresh()
        raise Taken(f"other writers kept committing to {self.path}")

    def update_all(self, changes: list[Change], metadata: dict[str, str]) -> None:
        """Replaces the rows in the buckets of the keys by what the changes make of them,
        in all tables by one manifest.

        A change must leave rows of other keys as they are. Only the buckets'
        numbers reach the driver. If another writer commits meanwhile, the
        changes are made again on the new state.
        """
        touched = [[r[0] for r in keys.select(self._bucket(F.col(keys.columns[0])).alias("b")).distinct().collect()] for _, keys, _ in changes]
        for _ in range(TRIES):
            folders, made = dict(self._folders), []
            for (name, _, change), numbers in zip(changes, touched, strict=True):
                fresh = self._write(name, change(self.table(name, numbers)))
                made += fresh.values()
                folders[name] = {b: f for b, f in folders.get(name, {}).items() if int(b) not in numbers} | fresh
            try:
                return self._publish(folders, self.metadata | metadata)
            except Taken:
                for top in {f.split("/")[0] for f in made}:
                    self._fs.delete(self._Path(f"{self.path}/{top}"), True)
                self.refresh()
        raise Taken(f"other writers kept committing to {self.path}")

    def _publish(self, folders: dict, metadata: dict[str, str]) -> None:
        state = json.dumps({"tables": folders, "metadata": metadata, "buckets": self.buckets}).encode()
        part = f"{self.path}/_part-{uuid.uuid4().hex}"
        stream = self._fs.create(self._Path(part), True)
        stream.write(bytearray(state))
        stream.close()
        version = self._version + 1
        try:
            # A free number says nothing if later states are there and its own was vacuumed.
            if any(v > self._version for v in self._manifests()):
                raise Taken(f"another writer has committed to {self.path}")
            self._give_name(part, self._name(version))
        finally:
            self._fs.delete(self._Path(part), False)
        self._version, self._folders, self.metadata = version, folders, metadata

    def _give_name(self, part: str, target: str) -> None:
        if self._fs.getScheme() == "file":
            plain = lambda p: self._Path(p).toUri().getPath()
            try:
                return os.link(plain(part), plain(target))
            except FileExistsError as e:
                raise Taken(f"another writer has committed {target}") from e
        jvm = self.spark._jvm
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(self._Path(part), self._Path(target), options)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                raise Taken(f"another writer has committed {target}") from e
            raise

    def vacuum(self, keep: int = 1, older_than: float = 3600.0) -> list[str]:
        """Deletes states that were replaced more than so many seconds ago, but for
        the newest ``keep``, and files that no other state names, down to single
        buckets. Reads and commits that began within that time keep their files.
        Returns what was deleted."""
        self.refresh()
        before = (time.time() - older_than) * 1000
        files = {f.getPath().getName(): f.getModificationTime() for f in self._fs.listStatus(self._Path(self.path))}
        found = self._manifests()
        # A state is replaced when the next one is published.
        old = [v for v, after in zip(found, found[1:], strict=False) if files.get(self._name(after).rsplit("/", 1)[1], before + 1) <= before]
        gone = old[: max(0, len(found) - keep)]
        named = {f for v in found if v not in gone for t in self._read(v)["tables"].values() for f in t.values()}
        tops = {f.split("/")[0] for f in named}
        names = [self._name(v).rsplit("/", 1)[1] for v in gone]
        for name, at in files.items():
            if name.startswith("manifest-") or at > before:
                continue
            if name not in tops:
                names.append(name)
                continue
            parts = [f"{name}/{f.getPath().getName()}" for f in self._fs.listStatus(self._Path(f"{self.path}/{name}")) if f.isDirectory()]
            names += [x for x in parts if x not in named]
        for name in names:
            self._fs.delete(self._Path(f"{self.path}/{name}"), True)
        return names


def open_store(spark: SparkSession, path: str = ":memory:") -> MemoryStore | SnapshotStore:
    return MemoryStore(spark) if path == ":memory:" else SnapshotStore(spark, path)
