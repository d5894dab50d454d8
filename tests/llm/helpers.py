"""Brute-force twins and odd tables for the operators' tests."""

import re

LOWER = {c: c + 32 for c in range(65, 91)}
ODD_TEXTS = [None, "", " ", "\n\n", "a", "A b", "ß é", "\u0000", "x" * 30_000, "word " * 8_000, "same text here twice", "same text here twice"]


def odd_docs(spark, more=()):
    """Null, empty, long, tied and repeated rows, and columns whose names clash with the operators' own."""
    rows = [(i, t, None if i % 2 else "en", "s", -1, "clash", 7) for i, t in enumerate([*ODD_TEXTS, *more])]
    rows += [rows[-1], (None, "no id", "en", None, None, "clash", 7)]
    return spark.createDataFrame(
        rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, digest string, `_id` int"
    )


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingle_set(text, k):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < k else frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def brute_components(texts, k, percent):
    """``id -> smallest id reachable`` over all pairs of texts."""
    sets = {i: shingle_set(t, k) for i, t in texts.items()}
    up = {i: i for i in texts}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(texts)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                up[max(top(a), top(b))] = min(top(a), top(b))
    return {i: top(i) for i in ids}
