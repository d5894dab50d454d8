"""Retry with doubling waits, for commits of the store."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import TypeVar

T = TypeVar("T")


def execute_with_retry(operation: Callable[[], T], max_retries: int = 3, first_wait: float = 0.05) -> T:
    """Up to ``max_retries`` tries that may fail, then one whose error is raised."""
    for attempt in range(max_retries):
        try:
            return operation()
        except Exception:  # noqa: BLE001  any error counts as a conflict
            time.sleep(first_wait * 2**attempt)
    return operation()
