"""The operators' registered queries and, where SQL can state them, their SQL."""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.common import table
from kinweave.llm.decontaminate import find_leaks
from kinweave.llm.exact_dedup import exact_dedup
from kinweave.llm.filter_audit import audit_filters
from kinweave.llm.html_text import extract_text
from kinweave.llm.kmeans import lloyd
from kinweave.llm.langid import fit, identify, is_held_out
from kinweave.llm.licenses import PHRASES, TEMPLATES, THRESHOLD, reaches, scan_licenses, template_sets
from kinweave.llm.near_dedup import near_duplicates
from kinweave.llm.secrets import scan_secrets
from kinweave.llm.sentencepiece import round_trip
from kinweave.llm.suffix_dedup import remove_repeats
from kinweave.llm.url_filter import judge_urls
from kinweave.llm.warc import read_records, write_archive

#: A vocabulary file of the environment; any other BPE or unigram model's path does.
MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"


def op1_sentencepiece(spark: SparkSession, sf_dir: str, model_file: str = MODEL_FILE) -> DataFrame:
    """Every document's pieces, and the digest of the text that they decode to."""
    back = round_trip(table(spark, sf_dir, "documents"), model_file)
    return back.select("doc_id", F.size("ids").alias("n_tokens"), "ids", F.sha2("text", 256).alias("decoded_sha256"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit(docs))
    return found.select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=2, percent=80)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each place where a document repeats a benchmark item."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_records(write_archive(table(spark, sf_dir, "pages")))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages")).drop("score")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd(table(spark, sf_dir, "embeddings"), k=8, rounds=10, seed=3, dims=64)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), length=50).drop("kept")


OP10_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
     g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(t.text) AS text_sha256
FROM t JOIN g ON t.text = g.text
"""

OP9_SQL = r"""
WITH u AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
                                ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
fits AS (
  SELECT u.page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS by_rule
  FROM u JOIN rules ON (u.host = h OR ends_with(u.host, '.' || h)) AND starts_with(u.path, p)
  GROUP BY u.page_id),
r AS (
  SELECT u.*, fits.rule, fits.by_rule,
         regexp_replace(regexp_replace(translate(host || path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                       '[0-9]', '0', 'g'), '(?s)[^a-z0./-]', '_', 'g') AS s
  FROM u LEFT JOIN fits USING (page_id)),
g AS (SELECT page_id, by_rule, i, substr('^^' || s, i, 3) AS gram FROM r, LATERAL (SELECT unnest(range(1, length(s) + 1)) AS i)),
cls(v) AS (VALUES ('allow'), ('block')),
seen AS (SELECT DISTINCT gram FROM g),
c AS (SELECT by_rule AS v, gram, count(*) AS n FROM g WHERE by_rule IS NOT NULL GROUP BY ALL),
c0 AS (SELECT v, substr(gram, 3, 1) AS k, sum(n) AS n FROM c GROUP BY ALL),
c1 AS (SELECT v, substr(gram, 2, 2) AS k, sum(n) AS n FROM c GROUP BY ALL),
x0 AS (SELECT v, sum(n) AS s, count(*) AS t FROM c0 GROUP BY ALL),
x1 AS (SELECT v, substr(k, 1, 1) AS x, sum(n) AS s, count(*) AS t FROM c1 GROUP BY ALL),
x2 AS (SELECT v, substr(gram, 1, 2) AS x, sum(n) AS s, count(*) AS t FROM c GROUP BY ALL),
q0 AS (
  SELECT cls.v, seen.gram,
         CASE WHEN x0.s IS NULL THEN 1.0 / 32 ELSE (coalesce(c0.n, 0) + x0.t * CAST(1.0 / 32 AS DOUBLE)) / (x0.s + x0.t) END AS q
  FROM seen CROSS JOIN cls LEFT JOIN x0 ON x0.v = cls.v LEFT JOIN c0 ON c0.v = cls.v AND c0.k = substr(gram, 3, 1)),
q1 AS (
  SELECT q0.v, gram, CASE WHEN x1.s IS NULL THEN q ELSE (coalesce(c1.n, 0) + x1.t * q) / (x1.s + x1.t) END AS q
  FROM q0 LEFT JOIN x1 ON x1.v = q0.v AND x1.x = substr(gram, 2, 1) LEFT JOIN c1 ON c1.v = q0.v AND c1.k = substr(gram, 2, 2)),
q2 AS (
  SELECT q1.v, q1.gram, CASE WHEN x2.s IS NULL THEN q ELSE (coalesce(c.n, 0) + x2.t * q) / (x2.s + x2.t) END AS q
  FROM q1 LEFT JOIN x2 ON x2.v = q1.v AND x2.x = substr(q1.gram, 1, 2) LEFT JOIN c ON c.v = q1.v AND c.gram = q1.gram),
llr AS (SELECT a.gram, ln(a.q) - ln(b.q) AS d FROM q2 a JOIN q2 b ON a.gram = b.gram AND a.v = 'allow' AND b.v = 'block'),
sc AS (SELECT page_id, avg(d) AS diff FROM g JOIN llr USING (gram) GROUP BY page_id),
tau AS (SELECT avg(m) AS tau FROM (SELECT by_rule, avg(diff) AS m FROM r JOIN sc USING (page_id) WHERE by_rule IS NOT NULL GROUP BY by_rule))
SELECT r.page_id, r.host, r.path, r.rule,
       coalesce(r.by_rule, CASE WHEN sc.diff - coalesce(tau.tau, 0) >= 0 THEN 'allow' ELSE 'block' END) AS verdict
FROM r LEFT JOIN sc USING (page_id) CROSS JOIN tau
"""


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])
                                      WHEN len(w) = 1 THEN w ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
f AS (SELECT g, count(*) AS df FROM s GROUP BY g),
p AS (
  SELECT doc_id, g, n FROM (SELECT s.doc_id, s.g, n.n, row_number() OVER (PARTITION BY s.doc_id ORDER BY f.df, s.g) AS rn FROM s JOIN n USING (doc_id) JOIN f USING (g))
  WHERE rn <= n - CAST(ceil(n * 0.8) AS BIGINT) + 1),
cand AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM p x JOIN p y ON x.g = y.g AND x.doc_id < y.doc_id AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)),
links AS (
  SELECT a, b FROM (SELECT c.a, c.b, count(*) AS i FROM cand c JOIN s x ON x.doc_id = c.a JOIN s y ON y.doc_id = c.b AND y.g = x.g GROUP BY c.a, c.b) k
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 80 * (na.n + nb.n - i)),
e AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
c(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, c.r FROM c JOIN e ON e.a = c.doc_id WHERE c.r < e.b),
m AS (SELECT doc_id, min(r) AS r FROM c GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.r AS component_id, d.doc_id = m.r AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN m USING (doc_id)
"""

OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
     h AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS holder, cast(octet_length(encode(html)) AS BIGINT) AS n FROM p)
SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> holder THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> holder THEN holder END AS refers_to
FROM h
"""


def op8_sql() -> str:
    seps = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    places = " UNION ALL ".join(
        f"SELECT doc_id, '{label}' AS label, i - 1 AS start FROM d, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS i) WHERE "
        + " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(phrase.split()))
        for phrase, label in PHRASES
    )
    sets = ", ".join(
        f"('{label}', [{', '.join(repr(w) for w in t)}], '{phrase}', {need})" for label, t, phrase, need in template_sets(TEMPLATES, THRESHOLD)
    )
    wrapped = " UNION ALL ".join(
        f"""SELECT doc_id, '{phrase}' AS phrase, unnest(list_filter(range(1, len(w) + 1), lambda i: {' AND '.join(f"w[i + {k}] = '{x}'" for k, x in enumerate(phrase.split()))})) AS j,
        {len(phrase.split())} AS n, {far} AS far, w, ln FROM d WHERE contains(flat, ' {phrase} ')"""
        for phrase, far in reaches(TEMPLATES).items()
    )
    return f"""
WITH l AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
ls AS (SELECT doc_id, list_transform(string_split(t, chr(10)), lambda x: list_filter(string_split_regex(x, '{seps}'), lambda y: y <> '')) AS ls FROM l),
d AS (SELECT doc_id, flatten(ls) AS w, ' ' || array_to_string(flatten(ls), ' ') || ' ' AS flat,
             flatten(list_transform(ls, lambda x, i: list_transform(x, lambda y: i))) AS ln FROM ls),
places AS ({places}),
base AS (SELECT doc_id, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, list(DISTINCT label) AS labels FROM places GROUP BY doc_id),
templates(label, t, phrase, need) AS (VALUES {sets}),
occ AS ({wrapped}),
around AS (SELECT *, greatest(1, j - far) AS x, least(len(w), j + n - 1 + far) AS y FROM occ),
blocks AS (SELECT doc_id, 'l' || i AS blk, ls[i] AS b, contains(' ' || array_to_string(ls[i], ' ') || ' ', ' ' || templates.phrase || ' ') AS own, label, t, need
           FROM ls, LATERAL (SELECT unnest(range(1, len(ls) + 1)) AS i), templates
           UNION ALL SELECT doc_id, 'w' || j || around.phrase, w[x:y], templates.phrase = around.phrase, label, t, need FROM around, templates WHERE ln[x] <> ln[y]),
hits AS (SELECT doc_id, blk, label, own, len(list_intersect(list_distinct(b), t)) / len(t) AS score FROM blocks WHERE len(list_intersect(list_distinct(b), t)) >= need),
named AS (SELECT DISTINCT doc_id, label, true AS named FROM hits WHERE own),
top AS (SELECT *, bool_or(own) OVER (PARTITION BY doc_id, blk) AS any_own, bool_or(coalesce(named, false)) OVER (PARTITION BY doc_id, blk) AS any_named, max(score) OVER (PARTITION BY doc_id, blk) AS most
        FROM hits LEFT JOIN named USING (doc_id, label)),
pick AS (SELECT *, CASE WHEN any_own THEN own WHEN any_named THEN coalesce(named, false) ELSE score = most END AS chosen FROM top),
more AS (SELECT doc_id, list(DISTINCT label) FILTER (chosen) AS labels, list(DISTINCT label) AS similar, max(score) FILTER (chosen) AS score FROM pick GROUP BY doc_id)
SELECT d.doc_id, cast(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, cast(first_word AS BIGINT) AS first_word, cast(last_word AS BIGINT) AS last_word,
       array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ',') AS labels,
       cast(CASE WHEN n_base > 0 THEN 1 ELSE coalesce(more.score, 0) END AS DOUBLE) AS score, array_to_string(list_sort(coalesce(more.similar, [])), ',') AS similar
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN more USING (doc_id)
"""


def op11_sql(k: int = 8, rounds: int = 10, dims: int = 64) -> str:
    """The rounds, unrolled."""
    parts = [f"""WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}),
c0 AS (SELECT row_number() OVER (ORDER BY d) - 1 AS cluster, q AS c FROM (SELECT sha256('3:' || vec_id) AS d, q FROM v ORDER BY d LIMIT {k}))"""]
    for i in range(rounds + 1):
        parts.append(f"""far{i} AS (
  SELECT vec_id, q, cluster, cast(list_sum(list_transform(range(1, {dims + 1}), lambda i: (q[i] - c[i]) * (q[i] - c[i]))) AS BIGINT) AS distance FROM v CROSS JOIN c{i}),
a{i} AS MATERIALIZED (SELECT vec_id, q, cluster, distance FROM far{i} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) = 1)""")
        if i < rounds:
            parts.append(f"""s{i} AS (SELECT cluster, j, sum(q[j]) AS s, count(*) AS n FROM a{i}, LATERAL (SELECT unnest(range(1, {dims + 1})) AS j) GROUP BY cluster, j),
m{i} AS (SELECT cluster, list(cast((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS c FROM s{i} GROUP BY cluster),
c{i + 1} AS MATERIALIZED (SELECT cluster, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (cluster))""")
    return ",\n".join(parts) + f"""
SELECT vec_id, cast(cluster AS INTEGER) AS cluster, distance, cast(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
       cast(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (cluster)"""


def op12_sql(names: str = "ABCDE") -> str:
    places = ", ".join(
        f"('{''.join(order)}', {i + 1}, {1 << names.index(f)}, {sum(1 << names.index(g) for g in order[:i])})"
        for order in permutations(names)
        for i, f in enumerate(order)
    )
    return rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, doc_id > min(doc_id) OVER (PARTITION BY t) AS e FROM d),
f AS (
  SELECT part, doc_id, cast(len(w) < 200 AS INTEGER) + 2 * cast(100 * len(list_distinct(w)) < 50 * len(w) AS INTEGER)
         + 4 * cast(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS INTEGER)
         + 8 * cast(regexp_matches(t, '[#$%&*|]') AS INTEGER) + 16 * cast(e AS INTEGER) AS mask FROM w),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, mask, count(*) AS n, count_if(coalesce(good, false)) AS good, count_if(coalesce(toxic, false)) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, mask),
p(filter_order, step, bit, before) AS (VALUES {places}),
r AS (
  SELECT part, filter_order, step, bit,
         coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0) AS kept,
         coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit > 0), 0) AS removed,
         coalesce(sum(n) FILTER (mask & before > 0 AND mask & bit > 0), 0) AS redundant,
         coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
         coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit > 0), 0) AS good_lost,
         coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & bit > 0), 0) AS toxic_lost
  FROM m CROSS JOIN p GROUP BY ALL)
SELECT part, filter_order, cast(step AS INTEGER) AS step, cast(kept AS BIGINT) AS kept, cast(removed AS BIGINT) AS removed, cast(redundant AS BIGINT) AS redundant,
       cast(unique_fails AS BIGINT) AS unique_fails, cast(good_lost AS BIGINT) AS good_lost, cast(toxic_lost AS BIGINT) AS toxic_lost,
       cast(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM r
"""


#: Bytes as hexadecimal digits, in blocks so that no long text is searched for each of its windows.
OP13_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT doc_id, h, length(h) // 2 AS n FROM d),
blocks AS (SELECT doc_id, b, substr(h, 2 * b + 1, 2 * (512 + 49)) AS x FROM n, LATERAL (SELECT unnest(range(0, n, 512)) AS b)),
w AS (SELECT doc_id, b + i AS p, substr(x, 2 * i + 1, 100) AS w FROM blocks, LATERAL (SELECT unnest(range(0, least(512, length(x) // 2 - 49))) AS i)),
f AS (SELECT w, min(doc_id) AS first FROM w GROUP BY w),
hit AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM w JOIN f USING (w) WHERE doc_id > first),
run AS (SELECT doc_id, p, sum(CASE WHEN before IS NULL OR p > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM hit),
span AS (SELECT doc_id, k, min(p) AS a, max(p) + 50 AS b FROM run GROUP BY doc_id, k),
part AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM span
  UNION ALL SELECT doc_id, max(b), NULL FROM span GROUP BY doc_id),
kept AS (
  SELECT part.doc_id, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(b, n) - a)), '' ORDER BY a) AS h FROM part JOIN n USING (doc_id) GROUP BY part.doc_id),
gone AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM span GROUP BY doc_id)
SELECT n.doc_id, n.n AS n_bytes, cast(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept.h, n.h))) AS kept_sha256
FROM n LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


QUERIES = {
    "op1_sentencepiece": (op1_sentencepiece, None),
    "op2_warc": (op2_warc, OP2_SQL),
    "op3_language_id": (op3_language_id, None),
    "op4_near_dedup": (op4_near_dedup, OP4_SQL),
    "op5_decontaminate": (op5_decontaminate, None),
    "op6_html_text": (op6_html_text, None),
    "op7_secret_scan": (op7_secret_scan, None),
    "op8_license_scan": (op8_license_scan, op8_sql()),
    "op9_url_filter": (op9_url_filter, OP9_SQL),
    "op10_exact_dedup": (op10_exact_dedup, OP10_SQL),
    "op11_centroids": (op11_centroids, op11_sql()),
    "op12_filter_audit": (op12_filter_audit, op12_sql()),
    "op13_suffix_dedup": (op13_suffix_dedup, OP13_SQL),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
