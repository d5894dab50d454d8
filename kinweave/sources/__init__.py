"""Where events come from and where graphs are kept."""

from kinweave.sources.events import events_from_rows, events_of_lists, read_events
from kinweave.sources.store import MemoryStore, SnapshotStore, open_store

__all__ = ["MemoryStore", "SnapshotStore", "events_from_rows", "events_of_lists", "open_store", "read_events"]
