"""From follow-list events to deduplicated edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions.keys import hex_key_column
from kinweave.plans.lineage import cut

FOLLOW_LIST_KIND = 3


def event_error() -> Column:
    """The first rule an event breaks, or null. The author, id and signature aren't checked."""
    kind, at = F.col("kind"), F.col("created_at")
    return (
        F.when(F.coalesce(kind != FOLLOW_LIST_KIND, F.lit(True)),
               F.concat(F.lit("Expected Kind 3 event, got Kind "), F.coalesce(kind.cast("string"), F.lit("undefined"))))
        .when(F.coalesce(at < 0, F.lit(True)), F.lit("Invalid created_at: must be a positive number"))
        .when(F.col("tags").isNull(), F.lit("Invalid tags: must be an array"))
    )


def validate(events: DataFrame, order: str = "ord") -> None:
    """Raises for the first broken event in input order, before anything is written."""
    broken = events.select(F.col(order), event_error().alias("error")).filter("error is not null")
    first = broken.agg(F.min_by("error", order).alias("error")).first()
    if first["error"] is not None:
        raise ValueError(first["error"])


def latest_per_author(events: DataFrame, order: str = "ord") -> DataFrame:
    """Each author's newest event; of equally new ones, the first in input order.

    An aggregate with map-side combining rather than a ranking window: an
    author with very many events doesn't gather them in one task. Newest events
    are first found by author, time and order alone; tags and other columns are
    combined only of the rows that match these, more than one per author if
    several have the same time and order.
    """
    rest = [c for c in events.columns if c not in ("pubkey", "created_at", order)]
    if rest:
        place = F.struct((-F.col("created_at")).alias("age"), F.col(order).alias("order"))
        first = events.groupBy(F.col("pubkey").alias("_pubkey")).agg(F.min(place).alias("_first"))
        first = first.select("_pubkey", F.col("_first.age").alias("_age"), F.col("_first.order").alias("_order"))
        same = F.col("_pubkey").eqNullSafe(F.col("pubkey")) & F.col("_age").eqNullSafe(-F.col("created_at")) & F.col("_order").eqNullSafe(F.col(order))
        events = events.join(first.hint("shuffle_hash"), same, "left_semi")
    kept = [c for c in events.columns if c != "pubkey"]
    newest = F.min_by(F.struct(*kept), F.struct(-F.col("created_at"), F.col(order))).alias("e")
    return events.groupBy("pubkey").agg(newest).select("pubkey", *[F.col(f"e.{c}").alias(c) for c in kept])


def follows_of(events: DataFrame) -> DataFrame:
    """Edges of each event's valid ``p`` tags, a followed key once per event.

    Followed keys are lower-cased, authors are left as they are.
    """
    valid = F.filter(
        "tags",
        lambda t: (F.size(t) >= 2) & (F.get(t, 0) == "p") & F.coalesce(hex_key_column(F.get(t, 1)), F.lit(False)),
    )
    followed = F.array_distinct(F.transform(valid, lambda t: F.lower(F.get(t, 1))))
    return events.select(
        F.col("pubkey").alias("follower_pubkey"), F.explode(followed).alias("followed_pubkey"), "created_at"
    )


def replace_lists(edges: DataFrame, new_edges: DataFrame) -> DataFrame:
    """The lists of authors with at least one new edge are replaced whole; an
    author whose new list is empty keeps the old one."""
    authors = new_edges.select("follower_pubkey").distinct()
    return edges.join(authors, "follower_pubkey", "left_anti").unionByName(new_edges)


def replace_lists_strictly(edges: DataFrame, events: DataFrame) -> DataFrame:
    """Replacement as the protocol has it: a list counts only if it is newer
    than the stored one, and an empty list clears."""
    stored = edges.groupBy("follower_pubkey").agg(F.max("created_at").alias("_at"))
    newer = (
        events.join(stored, events["pubkey"] == stored["follower_pubkey"], "left")
        .filter("_at is null or created_at > _at")
        .drop("follower_pubkey", "_at")
    )
    authors = newer.select(F.col("pubkey").alias("follower_pubkey"))
    return edges.join(authors, "follower_pubkey", "left_anti").unionByName(follows_of(newer))


def ingest(edges: DataFrame, events: DataFrame, order: str = "ord", strict: bool = False) -> DataFrame:
    """``edges`` after the follow lists of ``events``; each author's newest event is cut, as it is read twice."""
    kept = cut(latest_per_author(events, order))
    return replace_lists_strictly(edges, kept) if strict else replace_lists(edges, follows_of(kept))


def newer_lists(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """The rows of ``theirs`` whose author has no list in ``ours`` or an older one.

    For follows and mutes: the author is the first column, and all rows of a list
    have its ``created_at``. Lists are compared by one row each."""
    author = theirs.columns[0]
    known = ours.groupBy(author).agg(F.max("created_at").alias("_at"))
    lists = theirs.groupBy(author).agg(F.max("created_at").alias("_new"))
    newer = lists.join(known, author, "left").filter("_at is null or _new > _at").select(author)
    return theirs.join(newer, author, "left_semi")


def merge(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Each author's newer list; of equally new ones ours stays."""
    fresh = newer_lists(ours, theirs)
    return ours.join(fresh.select(ours.columns[0]).distinct(), ours.columns[0], "left_anti").unionByName(fresh)
