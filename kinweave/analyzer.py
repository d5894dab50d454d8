"""The class API: a graph in a store, with root distances kept beside it."""

from __future__ import annotations

import functools
import logging
import time
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.functions.keys import hex_key_column, is_hex_key, normalize_pubkey
from kinweave.operators import ingest as ing
from kinweave.operators import mutes as mut
from kinweave.operators import relational as rel
from kinweave.operators import traverse as trav
from kinweave.plans.lineage import cut
from kinweave.sources.events import events_from_rows, events_of_lists
from kinweave.sources.store import Change, open_store

log = logging.getLogger(__name__)
DEFAULT_DEPTH = 6


@dataclass(frozen=True)
class SocialPath:
    path: list[str]
    distance: int


@dataclass(frozen=True)
class GraphStats:
    total_follows: int
    unique_followers: int
    unique_followed: int


@dataclass(frozen=True)
class Degree:
    out_degree: int
    in_degree: int


def _open(method):
    @functools.wraps(method)
    def guarded(self, *args, **kwargs):
        if self.is_closed():
            raise RuntimeError("Analyzer has been closed")
        self._store.refresh()
        return method(self, *args, **kwargs)

    return guarded


def _now() -> str:
    return str(int(time.time() * 1000))


class SocialGraphAnalyzer:
    """Use ``create`` (own store, optionally own session) or ``connect`` (the caller's session)."""

    def __init__(self, spark: SparkSession, store, max_depth: float, owns_session: bool, strict: bool = False):
        self._spark, self._store, self._owns = spark, store, owns_session
        self._max_depth, self._strict = max_depth, strict
        self._root: str | None = None
        self._root_valid = False
        self._closed = False

    # Opening and closing

    @classmethod
    def create(
        cls,
        path: str = ":memory:",
        max_depth: float = DEFAULT_DEPTH,
        root_pubkey: str | None = None,
        spark: SparkSession | None = None,
        strict: bool = False,
    ) -> SocialGraphAnalyzer:
        owns = spark is None and SparkSession.getActiveSession() is None
        spark = spark or SparkSession.builder.getOrCreate()
        out = cls(spark, open_store(spark, path), max_depth, owns, strict)
        if root_pubkey:
            out.set_root_pubkey(root_pubkey)
        return out

    @classmethod
    def connect(cls, spark: SparkSession, max_depth: float = DEFAULT_DEPTH, root_pubkey: str | None = None, store=None):
        out = cls(spark, store or open_store(spark), max_depth, False)
        if root_pubkey:
            out.set_root_pubkey(root_pubkey)
        return out

    def close(self) -> None:
        if self._closed:
            return
        self._closed = True
        self._store.close()
        if self._owns:
            self._spark.stop()

    def is_closed(self) -> bool:
        return self._closed

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()

    # Depth

    def get_max_depth(self) -> float:
        return self._max_depth

    def set_max_depth(self, depth: float | None = None) -> None:
        """Root distances that are there stay as they were built."""
        if depth is None:
            depth = DEFAULT_DEPTH
        if isinstance(depth, bool) or not isinstance(depth, int | float):
            raise TypeError("maxDepth must be a number")
        if depth < 1:
            raise ValueError("maxDepth must be at least 1")
        self._max_depth = depth

    # Ingestion

    @property
    def follows(self) -> DataFrame:
        return self._store.table("follows")

    @_open
    def ingest_event(self, event: Mapping) -> None:
        self.ingest_events([event])

    @_open
    def ingest_events(self, events: Iterable[Mapping]) -> None:
        events = list(events)
        if not events:
            return
        self._ingest(events_from_rows(self._spark, events))

    @_open
    def ingest_frame(self, events: DataFrame, order: str) -> None:
        """Events of a DataFrame; ``order`` names the column that decides between equally new lists."""
        ing.validate(events, order)
        if not events.isEmpty():
            self._ingest(events, order)

    @_open
    def ingest_lists(self, events: Iterable[Mapping], known_authors_only: bool = False, overmute_threshold: float | None = None) -> None:
        """Follow lists (kind 3) and mute lists (kind 10000), both tables in one commit; other kinds are passed over.

        Of mute lists only newer ones count. On request events are ignored whose
        author has no distance from the root, or is overmuted at the threshold.
        """
        rows = cut(events_of_lists(self._spark, events, (ing.FOLLOW_LIST_KIND, mut.MUTE_LIST_KIND)))
        if known_authors_only:
            rows = rows.join(self._distances().select("pubkey"), "pubkey", "left_semi")
        if overmute_threshold is not None:
            rows = rows.join(mut.overmuted(self.mute_counts(), overmute_threshold).select("pubkey"), "pubkey", "left_anti")
        rows = cut(rows)
        if not rows.isEmpty():
            silent = cut(ing.latest_per_author(rows.filter(F.col("kind") == mut.MUTE_LIST_KIND)))
            mutes = ("mutes", silent.select("pubkey"), lambda old: mut.replace_mutes(old, silent))
            self._ingest(rows.filter(F.col("kind") == ing.FOLLOW_LIST_KIND), more=[mutes])

    @_open
    def vacuum(self, keep: int = 1, older_than: float = 3600.0) -> list[str]:
        """Deletes what was replaced more than so many seconds ago, but for the newest ``keep`` states."""
        return self._store.vacuum(keep, older_than)

    def _ingest(self, events: DataFrame, order: str = "ord", more: list[Change] | None = None) -> None:
        began = time.time()
        kept = cut(ing.latest_per_author(events, order))
        if self._strict:
            authors, change = kept.select(F.col("pubkey").alias("follower_pubkey")), lambda old: ing.replace_lists_strictly(old, kept)
        else:
            fresh = cut(ing.follows_of(kept))
            authors, change = fresh.select("follower_pubkey").distinct(), lambda old: ing.replace_lists(old, fresh)
        log.info("Ingesting the lists of %d authors", kept.count())
        before = self._lists_of(authors)
        # Only the lists of these authors change, so a store may leave the rest as it is.
        self._store.update_all([("follows", authors, change), *(more or [])], {"graph_updated_at": _now()})
        log.info("Ingested in %.1f s", time.time() - began)
        if self._root and self._root_valid:
            try:
                if self._strict:
                    self._follow_up(*trav.changes(before, self._lists_of(authors)))
                else:
                    self._delta(events.select("pubkey").distinct())
            except Exception:  # noqa: BLE001  the ingest itself stands
                log.exception("Delta update failed, marking root table as invalid")
                self._root_valid = False

    @_open
    def merge(self, other: SocialGraphAnalyzer) -> int:
        """Takes on the other graph's follow and mute lists that are newer than this one's,
        in one commit; returns how many. Only the buckets of their authors are written."""
        changes, n, before = [], 0, None
        for name in ("follows", "mutes"):
            fresh = cut(ing.newer_lists(self._store.table(name), other._store.table(name)))
            authors = cut(fresh.select(fresh.columns[0]).distinct())
            n += authors.count()
            before = self._lists_of(authors) if name == "follows" else before
            changes.append((name, authors, lambda old, fresh=fresh: ing.merge(old, fresh)))
        if n:
            self._store.update_all(changes, {"graph_updated_at": _now()})
            if self._root and self._root_valid:
                self._follow_up(*trav.changes(before, self._lists_of(changes[0][1])))
        return n

    def _lists_of(self, authors: DataFrame) -> DataFrame:
        """The authors' edges as they are now; they stay readable after a commit."""
        return self.follows.join(authors, "follower_pubkey", "left_semi")

    def _follow_up(self, lost: DataFrame, gained: DataFrame) -> None:
        """Root distances as a rebuild would give, from what changed."""
        ours = self._store.has("root_distances") and self._store.metadata.get("root_pubkey") == self._root
        if not ours:
            return self._build_root()
        depth = int(float(self._store.metadata.get("root_depth") or DEFAULT_DEPTH))
        table = trav.refresh(self._ahead(), self._store.table("root_distances"), cut(lost), cut(gained), depth)
        self._store.commit({"root_distances": table}, {"root_built_at": _now()})

    def _delta(self, authors: DataFrame) -> None:
        bad = authors.filter(~F.coalesce(hex_key_column(F.col("pubkey")), F.lit(False))).first()
        if bad is not None:
            raise ValueError(f"Invalid pubkey format: {bad['pubkey']}")
        depth = int(float(self._store.metadata.get("root_depth") or DEFAULT_DEPTH))
        changed = authors.select(F.lower("pubkey").alias("pubkey"))
        table = trav.relax(self._ahead(), self._store.table("root_distances"), changed, depth)
        self._store.commit({"root_distances": table}, {"root_built_at": _now()})

    def _ahead(self) -> DataFrame:
        """The edges dealt out by follower, for searches."""
        return self._store.dealt("follows", "follower_pubkey")

    def _back(self) -> rel.Dealt:
        """The edges dealt out by followed key, for searches from their ends."""
        return self._store.dealt_back()

    # Root distances

    def _build_root(self) -> None:
        table = trav.root_distances(self._ahead(), self._root, int(self._max_depth))
        about = {"root_pubkey": self._root, "root_depth": str(self._max_depth), "root_built_at": _now()}
        self._store.commit({"root_distances": table}, about)
        self._root_valid = True

    def _root_table(self) -> DataFrame:
        # Another analyzer may have dropped the table or built one of its own root.
        ours = self._store.has("root_distances") and self._store.metadata.get("root_pubkey") == self._root
        if not self._root_valid or not ours:
            self._build_root()
        return self._store.table("root_distances")

    @_open
    def set_root_pubkey(self, pubkey: str) -> None:
        self._root = normalize_pubkey(pubkey)
        about = self._store.metadata
        if (
            about.get("root_pubkey") == self._root
            and about.get("root_depth") == str(self._max_depth)
            and self._store.has("root_distances")
        ):
            self._root_valid = True
        else:
            self._build_root()

    def get_root_pubkey(self) -> str | None:
        return self._root

    @_open
    def rebuild_root_distances(self) -> None:
        if not self._root:
            raise ValueError("Root pubkey must be set to rebuild root distances")
        self._build_root()

    @_open
    def drop_root_distances(self) -> None:
        self._store.commit({"root_distances": None}, {"root_pubkey": "", "root_depth": "", "root_built_at": ""})
        self._root, self._root_valid = None, False

    @_open
    def get_users_at_distance(self, distance: int) -> list[str]:
        if not self._root:
            raise ValueError("Root pubkey must be set to use getUsersAtDistance")
        return _keys(self._root_table().filter(F.col("distance") == distance))

    @_open
    def get_distance_distribution(self) -> dict[int, int]:
        if not self._root:
            raise ValueError("Root pubkey must be set to use getDistanceDistribution")
        return {r["distance"]: r["count"] for r in trav.distribution(self._root_table()).collect()}

    # Mutes

    @property
    def mutes(self) -> DataFrame:
        return self._store.table("mutes")

    def _distances(self) -> DataFrame:
        if not self._root:
            raise ValueError("Root pubkey must be set to use distances")
        return self._root_table()

    @_open
    def mute_counts(self) -> DataFrame:
        """``pubkey, distance, followers, muters`` of every key, by distance from the root."""
        return mut.counts_by_distance(self.follows, self.mutes, self._distances())

    @_open
    def get_mute_stats(self, pubkey: str) -> dict[int, tuple[int, int]]:
        """Followers and muters of a key by their distance from the root."""
        key = normalize_pubkey(pubkey)
        follows, mutes = self.follows.filter(F.col("followed_pubkey") == key), self.mutes.filter(F.col("muted_pubkey") == key)
        rows = mut.counts_by_distance(follows, mutes, self._distances()).collect()
        return {r["distance"]: (r["followers"], r["muters"]) for r in sorted(rows, key=lambda r: r["distance"])}

    @_open
    def is_overmuted(self, pubkey: str, threshold: float = 1.0) -> bool:
        """By the nearest distance at which anybody follows or mutes the key."""
        for followers, muters in self.get_mute_stats(pubkey).values():
            return muters * threshold > followers
        return False

    @_open
    def get_muted_by(self, pubkey: str) -> list[str]:
        return _keys(self.mutes.filter(F.col("muter_pubkey") == pubkey).select(F.col("muted_pubkey").alias("pubkey")).orderBy("pubkey"))

    @_open
    def get_muters(self, pubkey: str) -> list[str]:
        return _keys(self.mutes.filter(F.col("muted_pubkey") == pubkey).select(F.col("muter_pubkey").alias("pubkey")).orderBy("pubkey"))

    @_open
    def remove_muted_not_followed(self) -> int:
        """Removes the keys that somebody mutes and nobody follows, with all their edges,
        from both tables in one commit; returns their number."""
        keys = cut(mut.muted_without_followers(self.follows, self.mutes))
        n = keys.count()
        if n:
            authors, gone = keys.select(F.col("pubkey").alias("follower_pubkey")), keys.withColumnRenamed("pubkey", "muted_pubkey")
            muters = self.mutes.join(gone, "muted_pubkey", "left_semi").select("muter_pubkey").union(keys)
            lost = cut(self._lists_of(authors))  # nobody follows the keys, so these are all edges that go
            less = lambda old: mut.without(old, keys)
            self._store.update_all([("follows", authors, less), ("mutes", cut(muters), less)], {"graph_updated_at": _now()})
            if self._root and self._root_valid:
                self._follow_up(lost, lost.limit(0))
        return n

    # Whole results as frames, for those that don't fit a list

    @_open
    def frame(self, what: str, *args) -> DataFrame:
        """What a list call returns, as a frame with the column ``pubkey``: "all_unique_pubkeys",
        "users_at_distance", "users_within_distance", "following" or "followers", with the call's arguments."""
        if what == "all_unique_pubkeys":
            return rel.all_pubkeys(self.follows)
        if what == "users_at_distance":
            return self._distances().filter(F.col("distance") == args[0]).select("pubkey")
        if what == "users_within_distance":
            a = normalize_pubkey(args[0])
            seeds = self._spark.range(1).select(F.lit(a).alias("source"))
            found = trav.within(self._ahead(), seeds, args[1]).filter(F.col("node") != a)
            return found.select(F.col("node").alias("pubkey"))
        if what in ("following", "followers"):
            return getattr(rel, what)(self.follows, args[0])
        raise ValueError(f"there is no list of {what}")

    # Searches

    @_open
    def get_shortest_path(self, source: str, target: str, max_depth: float | None = None) -> SocialPath | None:
        a, b = normalize_pubkey(source), normalize_pubkey(target)
        if a == b:
            return SocialPath([a], 0)
        if not rel.both_exist(self.follows, a, b):
            return None
        row = trav.shortest(self._ahead(), a, b, self._max_depth if max_depth is None else max_depth, True, self._back())
        return SocialPath(list(row["path"]), row["distance"]) if row else None

    @_open
    def get_shortest_distance(self, source: str, target: str, max_depth: float | None = None) -> int | None:
        a = normalize_pubkey(source)
        if self._root and a == self._root:
            row = self._root_table().filter(F.col("pubkey") == normalize_pubkey(target)).first()
            return row["distance"] if row else None
        b = normalize_pubkey(target)
        if a == b:
            return 0
        if not rel.exists(self.follows, a):
            return None
        row = trav.shortest(self._ahead(), a, b, self._max_depth if max_depth is None else max_depth, False, self._back())
        return row["distance"] if row else None

    @_open
    def get_shortest_distances_batch(self, source: str, targets: list[str]) -> dict[str, int | None]:
        """By the caller's own strings. From the root, strings are looked up as
        they are; otherwise they are normalised, if the source exists."""
        a = normalize_pubkey(source)
        out: dict[str, int | None] = dict.fromkeys(targets)
        if not targets:
            return out
        if self._root and a == self._root:
            found = trav.root_lookup(self._root_table(), self._targets(out))
            return out | {r["target"]: r["distance"] for r in found.collect()}
        if not rel.exists(self.follows, a):
            return out
        normal = {t: normalize_pubkey(t) for t in out}
        found = trav.distances_to(self._ahead(), a, self._targets(set(normal.values())), self._max_depth).collect()
        by_key = {r["target"]: r["distance"] for r in found} | {a: 0}
        return {t: by_key.get(k) for t, k in normal.items()}

    def _targets(self, keys: Iterable[str]) -> DataFrame:
        return self._spark.createDataFrame([(k,) for k in keys], T.StructType([T.StructField("target", T.StringType())]))

    @_open
    def get_users_within_distance(self, source: str, k: int) -> list[str] | None:
        a = normalize_pubkey(source)
        if self._root and a == self._root:
            return _keys(trav.root_within(self._root_table(), k))
        if k < 1:
            return []
        if not rel.exists(self.follows, a):
            return None
        seeds = self._spark.range(1).select(F.lit(a).alias("source"))
        found = trav.within(self._ahead(), seeds, k).filter(F.col("node") != a)
        return _keys(found.select(F.col("node").alias("pubkey")).orderBy("pubkey"))

    # Lookups

    @_open
    def get_stats(self) -> GraphStats:
        return GraphStats(**rel.graph_stats(self.follows).first().asDict())

    @_open
    def get_all_unique_pubkeys(self) -> list[str]:
        return _keys(rel.all_pubkeys(self.follows))

    @_open
    def pubkey_exists(self, pubkey: str) -> bool:
        """The text is looked up as it is."""
        return rel.exists(self.follows, pubkey)

    @_open
    def is_direct_follow(self, follower: str, followed: str) -> bool:
        return rel.follows(self.follows, normalize_pubkey(follower), normalize_pubkey(followed))

    @_open
    def are_mutual_follows(self, a: str, b: str) -> bool:
        return rel.are_mutual(self.follows, normalize_pubkey(a), normalize_pubkey(b))

    @_open
    def get_pubkey_degree(self, pubkey: str) -> Degree:
        return Degree(**rel.degree_of(self.follows, normalize_pubkey(pubkey)).first().asDict())

    @_open
    def get_following(self, pubkey: str) -> list[str]:
        return _keys(rel.following(self.follows, pubkey))

    @_open
    def get_followers(self, pubkey: str) -> list[str]:
        return _keys(rel.followers(self.follows, pubkey))


def _keys(df: DataFrame) -> list[str]:
    """The API returns lists; frames of any size are ``follows`` and the operators'."""
    return [r["pubkey"] for r in df.select("pubkey").collect() if r["pubkey"]]


__all__ = ["Degree", "GraphStats", "SocialGraphAnalyzer", "SocialPath", "is_hex_key"]
