"""URL filters: prefix rules first, a character language-model ratio for the rest.

Two smoothed variable-order Markov models, one of accepted and one of rejected
URLs, are counted over every URL that a rule decides. A URL without a rule is
judged by the difference of its log-likelihoods per character against a
threshold calibrated on the decided URLs.

Symbols are mapped to an alphabet of 32, contexts have up to two symbols, so a
model has 32**3 = 32,768 rows at most: that is the proven bound under which it
reaches the driver and goes out as a constant. The bound doesn't depend on the input.

Of a URL the models see host and path only, as the query's SQL has it: scheme,
query and fragment change no verdict. README has figures.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.common import ascii_lower, columns_only, stored

#: (verdict, host, path); fixed by the query's contract.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: a-z, one symbol for digits, three marks, one for all else, one before the start.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0./-_^"


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/ ? #`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def match_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; both null if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def symbols(host: Column, path: Column) -> Column:
    text = ascii_lower(F.concat(host, path))
    return F.regexp_replace(F.regexp_replace(text, "[0-9]", "0"), r"(?s)[^a-z0./-]", "_")


def grams(symbol_text: Column) -> Column:
    """For each symbol, the two before it and itself."""
    padded = F.concat(F.lit("^^"), symbol_text)
    n = F.length(symbol_text)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(padded, i, F.lit(3)))).otherwise(
        F.array().cast("array<string>")
    )


def mean_ratio(symbol_text: Column, ratios: Column) -> Column:
    """The mean of the ratios of a text's grams, found by number in an array of
    32**3; null for an empty text. One pass carries the last two symbols."""
    size = len(ALPHABET)
    start = F.struct(F.lit(size**2 - 1).alias("code"), F.lit(0.0).alias("sum"))

    def step(acc: Column, symbol: Column) -> Column:
        code = ((acc["code"] % size**2) * size + F.instr(F.lit(ALPHABET), symbol) - 1).cast("int")
        return F.struct(code.alias("code"), (acc["sum"] + F.get(ratios, code)).alias("sum"))

    total = F.aggregate(F.split(symbol_text, ""), start, step)["sum"]
    return F.when(F.length(symbol_text) > 0, total / F.length(symbol_text))


def markov_ratio(spark: SparkSession, counts: DataFrame) -> DataFrame:
    """``code, gram, llr`` for all 32**3 grams from ``gram, verdict, n``.

    Witten-Bell: an order's estimate is mixed with the next lower order's by
    how many different symbols followed the context; the lowest order is
    uniform. A context that was never seen leaves all to the lower orders.
    """
    size = len(ALPHABET)
    at = lambda e: F.substring(F.lit(ALPHABET), (e % size).cast("int") + 1, F.lit(1))
    every = spark.range(0, size**3, 1, 1).select(
        F.col("id").cast("int").alias("code"),
        F.concat(at(F.floor(F.col("id") / (size * size))), at(F.floor(F.col("id") / size)), at(F.col("id"))).alias("gram"),
    )
    model = every
    for verdict in ("allow", "block"):
        own = counts.filter(F.col("verdict") == verdict)
        estimate: Column = F.lit(1.0 / size)
        for order in (0, 1, 2):
            context = F.substring("gram", 3 - order, order)  # empty for order 0, but not a constant: its join is by key too
            tail = F.substring("gram", 3 - order, order + 1)
            pair, ctx, n = f"_p{order}", f"_c{order}", f"{verdict}{order}"
            pairs = own.groupBy(tail.alias(pair)).agg(F.sum("n").alias(f"n_{n}"))
            contexts = pairs.groupBy(F.substring(pair, 1, order).alias(ctx)).agg(
                F.sum(f"n_{n}").alias(f"s_{n}"), F.count(F.lit(1)).alias(f"t_{n}")
            )
            model = (
                model.withColumn(pair, tail)
                .withColumn(ctx, context)
                .join(F.broadcast(pairs), pair, "left")
                .join(F.broadcast(contexts), ctx, "left")
                .drop(pair, ctx)
            )
            seen, all_, kinds = (F.coalesce(F.col(f"{x}_{n}"), F.lit(0)) for x in "nst")
            estimate = F.when(all_ + kinds > 0, (seen + kinds * estimate) / (all_ + kinds)).otherwise(estimate)
        model = model.withColumn(f"p_{verdict}", estimate)
    return model.select("code", "gram", (F.ln("p_allow") - F.ln("p_block")).alias("llr"))


def judge_urls(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: list[tuple[str, str, str]] = RULES,
) -> DataFrame:
    """``id, host, path, rule, verdict, score`` for every row.

    ``score`` is the length-normalised log-likelihood difference minus the
    calibrated threshold, the mean of the accepted and the rejected URLs' mean
    difference; a URL without a rule is allowed from 0 up. A null URL and one
    without ``://`` have empty parts, no score, and are blocked. Repeated rows
    are judged each; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    url = F.col(url_col)
    host, path = host_of(url), path_of(url)
    rows = columns_only(pages, id_col, url_col).select(F.col(id_col).alias("_id"), host.alias("host"), path.alias("path"))
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    ruled = rows.withColumns({"rule": rule, "by_rule": verdict, "_s": symbols(F.col("host"), F.col("path"))})
    counts = (
        ruled.filter("by_rule is not null")
        .select(F.col("by_rule").alias("verdict"), F.explode(grams(F.col("_s"))).alias("gram"))
        .groupBy("verdict", "gram")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    model = markov_ratio(spark, stored(counts, "url-counts")).orderBy("code").collect()
    # 32**3 numbers, as one constant that the optimizer folds into an array.
    ratios = F.split(F.lit(",".join(repr(r["llr"]) for r in model)), ",").cast("array<double>")
    judged = ruled.withColumn("diff", mean_ratio(F.col("_s"), ratios))
    means = judged.groupBy("by_rule").agg(F.avg("diff").alias("m")).filter("by_rule is not null").collect()
    threshold = reduce(lambda a, r: a + (r["m"] or 0.0), means, 0.0) / max(1, len(means))
    score = F.col("diff") - F.lit(float(threshold))
    by_model = F.when(score >= 0, "allow").otherwise("block")
    return judged.select(
        F.col("_id").alias(id_col),
        "host",
        "path",
        "rule",
        F.coalesce(F.col("by_rule"), by_model).alias("verdict"),
        score.alias("score"),
    )
