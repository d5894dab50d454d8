"""Event sources: Python objects, JSON lines, any DataFrame with an order column."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.operators.ingest import FOLLOW_LIST_KIND
from kinweave.plans.schema import EVENTS


def check_event(event: Mapping | None) -> None:
    """The checks that need the Python object: its presence and its types."""
    if event is None:
        raise ValueError("Event is required")
    if event.get("kind") != FOLLOW_LIST_KIND:
        raise ValueError(f"Expected Kind 3 event, got Kind {event.get('kind')}")
    at = event.get("created_at")
    if isinstance(at, bool) or not isinstance(at, int | float) or not at >= 0:
        raise ValueError("Invalid created_at: must be a positive number")
    if not isinstance(event.get("tags"), list | tuple):
        raise ValueError("Invalid tags: must be an array")


def events_from_rows(spark: SparkSession, events: Iterable[Mapping]) -> DataFrame:
    """Checked events with their input order in ``ord``; tags that aren't lists of text are dropped."""
    rows = []
    for at, event in enumerate(events):
        check_event(event)
        tags = [[x if isinstance(x, str) else None for x in t] for t in event["tags"] if isinstance(t, list | tuple)]
        rows.append(
            (event.get("id"), event.get("pubkey"), int(event["created_at"]), event["kind"], tags, event.get("content"), event.get("sig"), at)
        )
    return spark.createDataFrame(rows, T.StructType([*EVENTS.fields, T.StructField("ord", T.LongType())]))


def read_events(spark: SparkSession, path: str, broken: str = "fail") -> DataFrame:
    """Events of JSON lines; blank lines are skipped. Input order isn't defined
    across files, so the event id decides between equally new lists.

    A line that isn't a JSON object of an event's types is ``broken``: with
    "fail" the job that reads it ends with an error that shows the line, with
    "drop" it is left out, and with "keep" it stays as a row with the line in
    ``broken`` and nulls elsewhere, to be counted or stored.
    """
    if broken not in ("fail", "drop", "keep"):
        raise ValueError(f"broken must be fail, drop or keep, not {broken}")
    schema = T.StructType([*EVENTS.fields, T.StructField("broken", T.StringType())])
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", schema, {"columnNameOfCorruptRecord": "broken"}).alias("e")).select("e.*")
    if broken == "keep":
        return parsed
    if broken == "drop":
        return parsed.filter(F.col("broken").isNull()).drop("broken")
    error = F.raise_error(F.concat(F.lit("not an event: "), F.substring("broken", 1, 200))).cast("boolean")
    return parsed.filter(F.when(F.col("broken").isNull(), F.lit(True)).otherwise(error)).drop("broken")


def events_of_lists(spark: SparkSession, events: Iterable[Mapping], kinds: tuple[int, ...]) -> DataFrame:
    """Events of the given kinds in their input order; events of other kinds are passed over."""
    rows = []
    for at, event in enumerate(events):
        if event is not None and event.get("kind") in kinds:
            check_event({**event, "kind": FOLLOW_LIST_KIND})
            tags = [[x if isinstance(x, str) else None for x in t] for t in event["tags"] if isinstance(t, list | tuple)]
            rows.append((event.get("pubkey"), int(event["created_at"]), event["kind"], tags, at))
    names = {f.name: f for f in EVENTS.fields}
    fields = [names[c] for c in ("pubkey", "created_at", "kind", "tags")]
    return spark.createDataFrame(rows, T.StructType([*fields, T.StructField("ord", T.LongType())]))
