"""Streams of events into a graph."""

from kinweave.streaming.ingest import ingest_stream

__all__ = ["ingest_stream"]
