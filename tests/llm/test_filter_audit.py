"""The audit against a plain run of every order, and its bitsets against Python sets."""

import random
import re
from itertools import permutations

import numpy as np

from kinweave.llm import filter_audit as fa
from tests.llm.helpers import odd_docs


def brute(docs, labels):
    """``docs``: (id, lang, text); ``labels``: (id, quality, toxic)."""
    first = {}
    for i, _, t in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    rows = []
    for i, lang, t in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = set()
        fails |= {"A"} if len(w) < 200 else set()
        fails |= {"B"} if 100 * len(set(w)) < 50 * len(w) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 3 * len(t) else set()
        fails |= {"D"} if re.search(r"[#$%&*|]", t) else set()
        fails |= {"E"} if i is not None and first[t] < i else set()
        good = i is not None and any(x == i and q == 1 for x, q, _ in labels)
        toxic = i is not None and any(x == i and b == 1 for x, _, b in labels)
        rows.append((lang or "", fails, good, toxic))
    out, removed_by = [], {}
    for part in {r[0] for r in rows}:
        for order in permutations("ABCDE"):
            left = [r for r in rows if r[0] == part]
            for step, f in enumerate(order):
                gone = [r for r in left if f in r[1]]
                before = [r for r in rows if r[0] == part and f in r[1] and r[1] & set(order[:step])]
                only = [r for r in rows if r[0] == part and r[1] == {f}]
                left = [r for r in left if f not in r[1]]
                removed_by[part, f] = removed_by.get((part, f), 0) + len(gone)
                out.append((part, "".join(order), step + 1, len(left), len(gone), len(before), len(only), sum(r[2] for r in gone), sum(r[3] for r in gone)))
    return sorted((*x, removed_by[x[0], x[1][x[2] - 1]]) for x in out)


def test_equals_every_order(spark, monkeypatch):
    monkeypatch.setattr(fa, "BLOCK", 16)
    monkeypatch.setattr(fa, "MOST_PARTS", 2)
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(1, 7)))
    texts = [None, "", "  \t\x0b ", "x y   z", "é" * 40, "A" * 3 + "é" * 97, "A" * 3 + "b" * 96]
    for _ in range(120):
        n = r.choice([3, 199, 200, 201, 260])
        t = " ".join(word() for _ in range(n)) if r.random() < 0.6 else " ".join(r.choice(["aa", "b", "cc"]) for _ in range(n))
        t += r.choice(["", "", "#", "$ &", "ABC" * 30, "|"])
        texts.append(t)
    texts += [r.choice(texts) for _ in range(60)]
    docs = [(i, r.choice(["en", "de", "", None, "fr"]), t) for i, t in enumerate(texts)]
    docs += [docs[9], docs[20], (None, "en", texts[9]), (None, "en", texts[9]), (3, "de", texts[30])]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, len(texts), 2)]
    labels += [labels[0], (labels[1][0], 1, 0), (labels[1][0], 0, 1), (None, 1, 1), (10_000, 1, 1)]
    df = spark.createDataFrame([(i, x, t, "clash", 1) for i, x, t in docs], "doc_id bigint, lang string, text string, part string, flags int")
    marks = spark.createDataFrame([(*x, "clash") for x in labels], "doc_id bigint, quality int, toxic int, part string")
    got = fa.audit_filters(df.repartition(3), marks)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(tuple(x) for x in got.collect()) == brute(docs, labels)


def test_bitsets_count_as_sets_do():
    r = np.random.default_rng(1)
    for n in (1, 7, 64, 1000):
        masks = r.random((8, n)) < 0.4
        part, good, toxic, *fails = masks
        counts = fa.subset_counts(fa._bits(part), [fa._bits(f) for f in fails], fa._bits(good), fa._bits(toxic))
        for subset in range(32):
            left = part & ~np.any([fails[f] for f in range(5) if subset >> f & 1] or [np.zeros(n, bool)], axis=0)
            assert counts[subset, 0] == left.sum()
            for f in range(5):
                gone = left & fails[f] if not subset >> f & 1 else np.zeros(n, bool)
                assert counts[subset, 1 + 3 * f : 4 + 3 * f].tolist() == [gone.sum(), (gone & good).sum(), (gone & toxic).sum()]


def test_odd_tables(spark):
    docs = odd_docs(spark)
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    rows = [(r["doc_id"], r["lang"], r["text"]) for r in docs.collect()]
    assert sorted(tuple(x) for x in fa.audit_filters(docs, labels).collect()) == brute(rows, [])
    assert fa.audit_filters(docs.limit(0), labels).count() == 0
