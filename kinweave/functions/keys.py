"""Keys are 64 hexadecimal digits; the graph holds followed keys in lower case."""

from __future__ import annotations

import re

from pyspark.sql import Column

_HEX = re.compile("[0-9a-f]+", re.IGNORECASE | re.ASCII)


def is_hex(text: str | None) -> bool:
    return isinstance(text, str) and _HEX.fullmatch(text) is not None


def is_hex_key(key: str | None) -> bool:
    return isinstance(key, str) and len(key) == 64 and is_hex(key)


def normalize_pubkey(key: str) -> str:
    if not is_hex_key(key):
        raise ValueError(f"Invalid pubkey format: {key}")
    return key.lower()


def hex_key_column(key: Column) -> Column:
    """``is_hex_key`` for a column; null stays null."""
    return key.rlike(r"\A(?i)[0-9a-f]{64}\z")
