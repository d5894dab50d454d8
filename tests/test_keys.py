import pytest
from pyspark.sql import functions as F

from kinweave.functions import execute_with_retry, hex_key_column, is_hex, is_hex_key, normalize_pubkey
from tests.graphs import EDA


def test_hex():
    assert is_hex("0aF") and not is_hex("") and not is_hex(None) and not is_hex("xyz") and not is_hex("ab\n")
    assert is_hex_key(EDA) and is_hex_key(EDA.upper()) and not is_hex_key(EDA[:-1]) and not is_hex_key(EDA + "\n")


def test_normalize():
    assert normalize_pubkey(EDA.upper()) == EDA
    for bad in ("", "zz", EDA + "0", None):
        with pytest.raises(ValueError, match="Invalid pubkey format"):
            normalize_pubkey(bad)


def test_column_twin(spark):
    rows = [(EDA,), (EDA.upper(),), (EDA + "\n",), ("x",), ("",), (None,)]
    df = spark.createDataFrame(rows, "k string").select("k", hex_key_column(F.col("k")).alias("ok"))
    assert all(r["ok"] == (None if r["k"] is None else is_hex_key(r["k"])) for r in df.collect())


def test_retry():
    tries = []

    def fails(times):
        tries.append(1)
        if len(tries) <= times:
            raise RuntimeError("busy")
        return "done"

    assert execute_with_retry(lambda: fails(3), first_wait=0) == "done" and len(tries) == 4
    tries.clear()
    with pytest.raises(RuntimeError):
        execute_with_retry(lambda: fails(9), first_wait=0)
    assert len(tries) == 4
