"""Suffix arrays against plain sorting, and the removal of repeats against brute force."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinweave.llm import suffix_dedup as sd
from kinweave.llm.suffix_array import suffix_array
from tests.llm.helpers import odd_docs


def plain_order(text):
    return sorted(range(len(text)), key=lambda i: text[i:])


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.binary(max_size=80), st.text("ab", max_size=80).map(str.encode), st.text("abc", max_size=12).map(lambda s: s.encode() * 6)))
def test_suffix_array_equals_sorting(text):
    assert suffix_array(text) == plain_order(text)


def test_suffix_array_of_regular_texts():
    fib = ["a", "ab"]
    while len(fib[-1]) < 900:
        fib.append(fib[-1] + fib[-2])
    for text in (b"", b"x", b"a" * 2000, b"ab" * 700, b"ba" * 700, fib[-1].encode(), bytes(range(256)) * 4, bytes(range(255, -1, -1)) * 4):
        assert suffix_array(text) == plain_order(text)


def brute(rows, length):
    """Of ``(id, text)`` rows: bytes, removed bytes, spans and digest of each."""
    first = {}
    for i, t in rows:
        if i is not None:
            raw = (t or "").encode()
            for p in range(len(raw) - length + 1):
                w = raw[p : p + length]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        if i is not None:
            for p in range(len(raw) - length + 1):
                if first[raw[p : p + length]] < i:
                    gone[p : p + length] = True
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(bool(g) and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def found(spark, rows, length, **more):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sd.remove_repeats(df.repartition(3), length=length, **more).collect()
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] and len(r["kept"]) == r["n_bytes"] - r["n_removed"] for r in got)
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got), key=repr)


def mixed(r, n, passages, alphabet="abcdeé ", most=160):
    word = lambda k: "".join(r.choice(alphabet) for _ in range(k))
    shared = [word(r.randrange(20, 140)) for _ in range(passages)]
    texts = []
    for _ in range(n):
        kind = r.random()
        if kind < 0.15 and texts:
            texts.append(r.choice(texts))
        elif kind < 0.3 and texts:
            t = r.choice(texts)
            at = r.randrange(len(t) + 1)
            texts.append(t[:at] + "#" + t[at + 1 :])
        else:
            texts.append("".join(r.choice(shared) if r.random() < 0.5 else word(r.randrange(most)) for _ in range(r.randrange(6))))
    return texts


@pytest.mark.parametrize(("seed", "length", "gram"), [(1, 50, 16), (2, 20, 8), (3, 5, 2), (4, 16, 16)])
def test_equals_brute_force(spark, seed, length, gram):
    r = random.Random(seed)
    texts = mixed(r, 120, 8)
    rows = [(i * 3 - 50, t) for i, t in enumerate(texts)]
    r.shuffle(rows)
    # Repeated rows, ids that two texts share, and rows without an id.
    rows += [rows[0], rows[5], (rows[7][0], texts[9]), (None, texts[3]), (None, None)]
    want = brute(rows, length)
    assert found(spark, rows, length, gram=gram) == want and sum(x[2] for x in want) > 1000


def test_hot_anchors_are_dealt_out(spark, monkeypatch):
    """A passage in every document, each time between other texts; its groups are split, and so are long runs."""
    monkeypatch.setattr(sd, "GROUP_WINDOWS", 40)
    monkeypatch.setattr(sd, "COMBINED_BYTES", 2000)
    monkeypatch.setattr(sd, "BLOCK_BYTES", 500)
    r = random.Random(9)
    word = lambda k: "".join(r.choice("abcdefgh") for _ in range(k))
    passage = word(70)
    rows = [(i, word(r.randrange(80)) + passage + word(r.randrange(80))) for i in range(250)]
    rows += [(300 + i, "z" * r.randrange(40, 900)) for i in range(20)] + [(400 + i, word(3) + "xy" * r.randrange(200)) for i in range(20)]
    want = brute(rows, 50)
    assert found(spark, rows, 50) == want and sum(x[2] >= 70 for x in want) > 245
    parts = sd._met(1)
    table = next(iter(_packed(rows)))
    asked = np.concatenate([np.frombuffer(b, sd._WANTED) for b in parts(table)["wanted"].to_pylist() if b])
    assert asked["parts"].max() > 20


def _packed(rows):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"_id": [i for i, _ in rows], "_key": [0] * len(rows), "_raw": [t.encode() for _, t in rows]})
    out = list(sd._dealt(1, 50, 16)(iter([batch])))
    table = pa.Table.from_batches(out)
    yield table.filter(pa.compute.equal(table["bucket"], 0))


def test_a_task_sends_a_form_once(spark):
    rows = [(i, "the same long text, which stands here in very many documents of the corpus" + chr(97 + i % 2)) for i in range(300)]
    table = next(iter(_packed(rows)))
    assert sum(len(b) for b in table["form"].to_pylist()) // 8 < 12
    assert found(spark, rows, 50) == brute(rows, 50)


def test_texts_are_shuffled_once(spark):
    df = spark.createDataFrame([(i, "x" * i) for i in range(90)], "doc_id bigint, text string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = sd.remove_repeats(df)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "ReusedExchange" in plan and plan.count("partial_first(_raw") == 1


def test_odd_tables(spark):
    docs = odd_docs(spark, ["word " * 3])
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = sd.remove_repeats(docs)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got.collect()), key=repr) == brute(rows, 50)
    assert sd.remove_repeats(docs.limit(0)).count() == 0
