"""License scans: an exact set-similarity join of text blocks with templates.

A block is a line, or the words around a template's own phrase where these run
over a line break, so a wrapped notice is found however often it breaks. A block
matches a template if it holds at least the threshold's share of the template's
distinct words. Licences differ in one word, such as "Lesser", so a block often
matches several: then those count whose phrase stands in it in one piece, or
else in another block of the text, or else those of which it holds the largest
share. So every block that meets the threshold gives a label.

Tokens are ordered by how many lines of the whole input have them, rarest first;
a match must share a token of the template's prefix, have enough tokens (length
filter) and enough left after the first shared one (positional filter); what
passes is counted exactly. Phrases of the contract are searched besides.

Only template words can add to an overlap, so a block's token set is cut to
them first: the broadcast side and the frequencies have at most as many rows as
the templates have words, whatever the input. The input is read once; what is
kept of it are these token sets.
"""

from __future__ import annotations

import functools
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import ascii_lower, columns_only, join_per_key, stored
from kinweave.llm.exact_dedup import sha256_bytes

#: Fixed by the query's contract: phrase and label.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
#: Label, notice by which a public licence is announced, and the words in it that no other licence's notice has in one piece.
TEMPLATES = [
    ("agpl-3", "licensed under the GNU Affero General Public License version 3", "GNU Affero General Public License version 3"),
    ("agpl-3", "redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, "
     "either version 3 of the License", "GNU Affero General Public License as published by the Free Software Foundation, either version 3"),
    ("apache-2", "Licensed under the Apache License, Version 2.0", "Apache License, Version 2.0"),
    ("apache-2", "you may not use this file except in compliance with the License", "not use this file except in compliance with the License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted", "use in source and binary forms"),
    ("bsl-1", "Distributed under the Boost Software License, Version 1.0", "Boost Software License"),
    ("cc-by", "Licensed under CC BY 4.0", "CC BY 4.0"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", "CC BY-NC 4.0"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", "CC BY-SA 4.0"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike 4.0"),
    ("cc0-1", "waived all copyright and related or neighboring rights to this work", "copyright and related or neighboring rights"),
    ("epl-2", "made available under the terms of the Eclipse Public License 2.0", "Eclipse Public License 2.0"),
    ("gpl-2", "licensed under the GNU General Public License version 2", "GNU General Public License version 2"),
    ("gpl-2", "redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; "
     "either version 2 of the License", "GNU General Public License as published by the Free Software Foundation, either version 2"),
    ("gpl-3", "licensed under the GNU General Public License, version 3", "GNU General Public License, version 3"),
    ("gpl-3", "redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
     "either version 3 of the License", "GNU General Public License as published by the Free Software Foundation, either version 3"),
    ("gpl-2", "redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; "
     "version 2 of the License", "GNU General Public License as published by the Free Software Foundation; version 2"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
     "distribute this software for any purpose with or without fee"),
    ("lgpl-2.1", "redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; "
     "either version 2.1 of the License", "GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1"),
    ("lgpl-2.1", "licensed under the GNU Lesser General Public License version 2.1", "GNU Lesser General Public License version 2.1"),
    ("lgpl-3", "licensed under the GNU Lesser General Public License version 3", "GNU Lesser General Public License version 3"),
    ("mit", "Released under the MIT License", "MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "any person obtaining a copy"),
    ("mpl-2", "Licensed under the Mozilla Public License, Version 2.0", "Mozilla Public License, Version 2.0"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License", "Mozilla Public License"),
    ("unlicense", "This is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
    ("zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications",
     "anyone to use this software for any purpose, including commercial applications"),
]
#: Short identifiers in source files: label and identifier.
IDENTIFIERS = [("apache-2", "Apache-2.0"), ("bsd", "BSD-3-Clause"), ("gpl-2", "GPL-2.0"), ("gpl-3", "GPL-3.0"), ("mit", "MIT"), ("mpl-2", "MPL-2.0")]
TEMPLATES += [(label, f"SPDX-License-Identifier: {name}", f"SPDX-License-Identifier: {name}") for label, name in IDENTIFIERS]
THRESHOLD = 0.85
#: Words that may stand between those of a wrapped notice, on each side of its phrase.
SLACK = 3
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_NO_TEXTS = "array<string>"


def words(lowered: Column) -> Column:
    return F.array_remove(F.split(lowered, NOT_WORD), "")


def word_list(text: str) -> list[str]:
    return [w for w in re.split(NOT_WORD, text.translate({c: c + 32 for c in range(65, 91)})) if w]


def template_sets(templates: list[tuple[str, str, str]], threshold: float) -> list[tuple[str, list[str], str, int]]:
    """Label, distinct words, phrase and the number of words needed of each template."""
    out = []
    for label, text, phrase in templates:
        tokens = sorted(set(word_list(text)))
        out.append((label, tokens, " ".join(word_list(phrase)), math.ceil(round(threshold * len(tokens), 9))))
    return out


def reaches(templates: list[tuple[str, str, str]]) -> dict[str, int]:
    """How many words on each side of a phrase belong to its block in a wrapped text."""
    out: dict[str, int] = {}
    for _, text, phrase in templates:
        own = word_list(phrase)
        out[" ".join(own)] = max(out.get(" ".join(own), 0), len(word_list(text)) - len(own) + SLACK)
    return out


def _may_hold(lowered: Column, phrases: list[str]) -> Column:
    """Whether a text holds some phrase's words one after the other, perhaps as parts of longer words at its ends.

    A phrase's longest word is looked for first, which passes over most texts
    faster than a pattern of many alternatives.
    """
    by_word: dict[str, list[str]] = {}
    for p in phrases:
        by_word.setdefault(max(p.split(), key=len), []).append(f"(?:{NOT_WORD})".join(map(re.escape, p.split())))
    tests = [F.contains(lowered, F.lit(w)) & lowered.rlike("|".join(own)) for w, own in by_word.items()]
    return functools.reduce(lambda x, y: x | y, tests)


def base_places(lowered: Column, phrases: list[tuple[str, str]]) -> dict[str, Column]:
    """``n_base, first_word, last_word, base_labels`` (an array) of a text.

    The words are joined by single spaces, so a phrase's start is the number
    of spaces before it. Texts without any phrase's first word skip that.
    """
    may = _may_hold(lowered, [p for p, _ in phrases])
    flat = F.concat(F.lit(" "), F.array_join(words(lowered), " "), F.lit(" "))
    spaces = lambda x: (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))).cast("bigint")
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in phrases:
        n = F.regexp_count(flat, F.lit(f"(?<= ){phrase}(?= )")).cast("bigint")
        has = F.contains(flat, F.lit(f" {phrase} "))
        before = spaces(F.substring_index(flat, f" {phrase} ", 1))
        after = spaces(F.substring_index(flat, f" {phrase} ", -1))
        counts.append(F.when(has, n).otherwise(F.lit(0)))
        firsts.append(F.when(has, before))
        lasts.append(F.when(has, spaces(flat) - 1 - after - len(phrase.split())))
        labels.append(F.when(has, F.lit(label)))
    return {
        "n_base": F.when(may, sum(counts[1:], counts[0])).otherwise(F.lit(0)).cast("bigint"),
        "first_word": F.when(may, F.least(*firsts) if len(firsts) > 1 else firsts[0]),
        "last_word": F.when(may, F.greatest(*lasts) if len(lasts) > 1 else lasts[0]),
        "base_labels": F.when(may, F.array_compact(F.array(*labels))).otherwise(F.array().cast(_NO_TEXTS)),
    }


def _block(number: Column, own: Column, vocabulary: list[str], phrases: Column) -> Column:
    tokens = F.array_distinct(F.filter(own, lambda w: w.isin(*vocabulary)))
    return F.struct(number.cast("int").alias("block"), tokens.alias("tokens"), phrases.alias("phrases"))


def line_blocks(vocabulary: list[str], phrases: list[str]) -> Column:
    """Each line's distinct template words, and the phrases that stand in it."""
    padded = F.array(*[F.lit(f" {p} ") for p in phrases])

    def standing(own: Column) -> Column:
        flat = F.concat(F.lit(" "), F.array_join(own, " "), F.lit(" "))
        return F.when(F.col("_may"), F.transform(F.filter(padded, lambda p: F.contains(flat, p)), lambda p: F.trim(p))).otherwise(F.array().cast(_NO_TEXTS))

    return F.transform("_lines", lambda own, i: _block(i, own, vocabulary, standing(own)))


def _around(phrase: str, far: int, vocabulary: list[str]) -> Column:
    own = phrase.split()

    def starts(j: Column) -> Column:
        hit = F.get("_all", j) == own[0]
        for k, w in enumerate(own[1:], 1):
            hit = hit & (F.get("_all", j + k) == w)
        return hit

    def block(j: Column) -> Column:
        first = F.greatest(j - far, F.lit(0))
        last = F.least(j + (len(own) - 1 + far), F.size("_all") - 1)
        around = F.slice("_all", first + 1, last - first + 1)
        return F.when(F.get("_at", first) != F.get("_at", last), _block(-1 - j, around, vocabulary, F.array(F.lit(phrase))))

    places = F.filter(F.sequence(F.lit(0), F.size("_all") - len(own)), starts)
    return F.when(F.size("_all") >= len(own), F.array_compact(F.transform(places, block)))


def wrapped_blocks(vocabulary: list[str], reach: dict[str, int]) -> Column:
    """The words around each phrase where they run over a line break; numbered from -1 down by the phrase's place."""
    parts = [_around(phrase, far, vocabulary) for phrase, far in reach.items()]
    none = F.array().cast("array<struct<block:int,tokens:array<string>,phrases:array<string>>>")
    return F.when(F.col("_may") & (F.size("_lines") > 1), F.concat(*[F.coalesce(p, none) for p in parts])).otherwise(none)


def similar_blocks(blocks: DataFrame, sets: list[tuple[str, list[str], str, int]]) -> DataFrame:
    """``key, block, phrases, template, score, own`` of all blocks that meet the threshold,
    exactly; ``own``: whether the template's phrase stands in the block.

    ``blocks`` has ``key, block, tokens, phrases``; lines are numbered from 0 up."""
    spark = blocks.sparkSession
    shortest = min(need for *_, need in sets)
    counted = blocks.filter("block >= 0").select(F.explode("tokens").alias("t")).groupBy("t").count().collect()
    seen = {r["t"]: r["count"] for r in counted}  # at most as many as the templates have words
    order = sorted({w for _, t, *_ in sets for w in t}, key=lambda w: (seen.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    prefix = []
    for k, (_, tokens, phrase, need) in enumerate(sets):
        ranked = sorted(tokens, key=rank.__getitem__)
        prefix += [(ranked[i], k, i, len(ranked), need, tokens, phrase) for i in range(len(ranked) - need + 1)]
    index = spark.createDataFrame(prefix, "token string, template int, at_t int, n int, need int, words array<string>, phrase string")
    ranks = F.create_map(*[F.lit(x) for w, i in rank.items() for x in (w, i)])
    in_order = F.transform(F.array_sort(F.transform("tokens", lambda w: F.struct(F.element_at(ranks, w).alias("rank"), w.alias("w")))), lambda s: s["w"])
    long_enough = blocks.filter(F.size("tokens") >= shortest).select("key", "block", in_order.alias("tokens"), "phrases")
    probes = long_enough.select("key", "block", "tokens", "phrases", F.size("tokens").alias("m"), F.posexplode("tokens").alias("at_b", "token"))
    candidates = (
        probes.filter(F.col("at_b") <= F.col("m") - shortest)
        .join(F.broadcast(index), "token")
        .filter((F.col("m") >= F.col("need")) & (F.least(F.col("n") - F.col("at_t"), F.col("m") - F.col("at_b")) >= F.col("need")))
    )
    checked = candidates.withColumn("overlap", F.size(F.array_intersect("tokens", "words"))).filter("overlap >= need")
    own = F.array_contains("phrases", F.col("phrase")).alias("own")
    return checked.select("key", "block", "phrases", "template", (F.col("overlap") / F.col("n")).alias("score"), own)


def labels_of(hits: DataFrame, labels: list[str]) -> DataFrame:
    """``key, more, best, similar`` of each text with a block over the threshold: the labels
    chosen for its blocks, the largest share among these, and the labels of all
    templates that any block matches.

    Of a block's templates those count whose phrase stands in it; if there is
    none, those whose label the text's other blocks name so (a wrapped notice's
    line says less than the notice); if there is none either, those of which the
    block holds the largest share. A block's matches are gathered as a set, so
    copies of a text add nothing to them."""
    names = F.array(*[F.lit(x) for x in labels])
    match = F.struct("score", F.get(names, F.col("template")).alias("label"), "own")
    per_block = hits.groupBy("key", "block", "phrases").agg(F.collect_set(match).alias("all"))
    per_text = per_block.groupBy("key").agg(F.collect_set("all").alias("blocks"))
    named = F.transform(F.filter(F.flatten("blocks"), lambda m: m["own"]), lambda m: m["label"])

    def chosen(block: Column) -> Column:
        own = F.filter(block, lambda m: m["own"])
        known = F.filter(block, lambda m: F.array_contains(F.col("named"), m["label"]))
        most = F.filter(block, lambda m: m["score"] == F.array_max(F.transform(block, lambda x: x["score"])))
        return F.when(F.size(own) > 0, own).when(F.size(known) > 0, known).otherwise(most)

    picked = per_text.withColumn("named", named).select("key", "blocks", F.flatten(F.transform("blocks", chosen)).alias("chosen"))
    return picked.select(
        "key",
        F.array_distinct(F.transform("chosen", lambda m: m["label"])).alias("more"),
        F.array_max(F.transform("chosen", lambda m: m["score"])).alias("best"),
        F.array_distinct(F.transform(F.flatten("blocks"), lambda m: m["label"])).alias("similar"),
    )


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: list[tuple[str, str, str]] = TEMPLATES,
    phrases: list[tuple[str, str]] = PHRASES,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``id, n_words, n_base, first_word, last_word, base_labels, labels, score, similar`` per row.

    A null text counts as empty: no words, no labels, score 0. Texts are
    searched whole, however long, and over line breaks. ``similar`` has the labels
    of all templates that any block matches, ``labels`` those that are chosen
    for the blocks and ``base_labels``; ``score`` is the largest share of a
    chosen template, else 0; 1 where a phrase of ``phrases`` stands. Every row is judged by its own text, whatever its id:
    repeated rows, rows that share an id and rows with a null id are reported
    each. Extra columns aren't read; an empty table gives an empty result.
    """
    sets = template_sets(templates, threshold)
    vocabulary = sorted({w for _, t, *_ in sets for w in t})
    reach = reaches(templates)
    lowered = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    rows = columns_only(docs, id_col, text_col).select(F.col(id_col).alias("_id"), lowered.alias("_lower"))
    cut = rows.select(
        "_id", "_lower", sha256_bytes(F.col("_lower")).alias("key"), _may_hold(F.col("_lower"), list(reach)).alias("_may"),
        F.transform(F.split("_lower", "\n"), words).alias("_lines"),
    )
    flat = cut.withColumns({
        "_all": F.when(F.col("_may"), F.flatten("_lines")),
        "_at": F.when(F.col("_may"), F.flatten(F.transform("_lines", lambda own, i: F.array_repeat(i, F.size(own))))),
    })
    n_words = F.aggregate("_lines", F.lit(0).cast("bigint"), lambda n, own: n + F.size(own))
    base = base_places(F.col("_lower"), phrases)
    blocks = F.filter(F.concat(line_blocks(vocabulary, list(reach)), wrapped_blocks(vocabulary, reach)), lambda b: F.size(b["tokens"]) > 0)
    read = stored(
        flat.select("_id", "key", n_words.alias("n_words"), *[c.alias(name) for name, c in base.items()], blocks.alias("blocks")), "license-blocks"
    )
    hits = similar_blocks(read.select("key", F.explode("blocks").alias("b")).select("key", "b.*"), sets)
    per_text = labels_of(hits, [label for label, *_ in sets])
    # Rows of a text are counted where it has a hit, for those that very many rows share.
    per_text = stored(per_text, "license-hits")
    counts = read.join(per_text.select("key"), "key", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("copies"))
    total = read.count()
    out = read.drop("blocks")
    joined = join_per_key(out, stored(per_text.join(counts, "key"), "license-texts"), "key", "copies", total)
    none = F.array().cast(_NO_TEXTS)
    text = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    best = F.coalesce("best", F.lit(0.0))
    return joined.select(
        F.col("_id").alias(id_col),
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        text(F.col("base_labels")).alias("base_labels"),
        text(F.concat("base_labels", F.coalesce("more", none))).alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(best).alias("score"),
        text(F.coalesce("similar", none)).alias("similar"),
    )
