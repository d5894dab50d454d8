"""Scalar functions: key checks as Python values and as columns, and retries."""

from kinweave.functions.keys import hex_key_column, is_hex, is_hex_key, normalize_pubkey
from kinweave.functions.retry import execute_with_retry

__all__ = ["execute_with_retry", "hex_key_column", "is_hex", "is_hex_key", "normalize_pubkey"]
