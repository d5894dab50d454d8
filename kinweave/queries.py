"""Registered queries on the derived graph, each beside the SQL it must equal."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave import fixtures as fx
from kinweave.operators import ingest as ing
from kinweave.operators import measure
from kinweave.operators import mutes as mut
from kinweave.operators import paths
from kinweave.operators import patterns as pat
from kinweave.operators import relational as rel
from kinweave.operators import traverse as trav
from kinweave.plans.lineage import cut, cut_by, shared_root
from kinweave.plans.schema import EDGES
from kinweave.sources import compact

ROOT, DEPTH = 0, 6
SPLIT = "1998-01-01"
EPOCH_OF_SPLIT = 883612800
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Shared heads of the SQL: events, kept events, edges.
EVENTS_SQL = """n AS (SELECT count(*) AS n FROM customer),
ev AS (SELECT cast(o_custkey AS BIGINT) AS pubkey, cast(epoch(o_orderdate) AS BIGINT) AS created_at, cast(o_orderkey AS BIGINT) AS ord FROM orders)"""


def edges_sql(events: str = "ev", name: str = "e") -> str:
    return f"""{name}_kept AS (SELECT pubkey, created_at, ord FROM (SELECT *, row_number() OVER (PARTITION BY pubkey ORDER BY created_at DESC, ord) AS rn FROM {events}) WHERE rn = 1),
{name} AS (SELECT DISTINCT k.pubkey AS follower_pubkey, cast((l_partkey * 31 + l_suppkey * 17) % n.n AS BIGINT) AS followed_pubkey, k.created_at FROM {name}_kept k JOIN lineitem ON l_orderkey = k.ord CROSS JOIN n)"""


HEAD = f"WITH RECURSIVE {EVENTS_SQL},\n{edges_sql()}"
BFS = f""",
b(node, d) AS (SELECT {ROOT}::BIGINT, 0 UNION SELECT e.followed_pubkey, d + 1 FROM b JOIN e ON e.follower_pubkey = b.node WHERE d < {DEPTH}),
rd AS (SELECT node AS pubkey, min(d) AS distance FROM b GROUP BY node)"""


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query(HEAD + "\nSELECT * FROM e")
def follow_edges(spark, sf_dir):
    return fx.follow_edges(spark, sf_dir)


@query(HEAD + "\nSELECT * FROM e_kept")
def latest_event(spark, sf_dir):
    return ing.latest_per_author(fx.order_events(spark, sf_dir))


@query(HEAD + "\nSELECT DISTINCT sha256('u' || follower_pubkey) AS follower_pubkey, sha256('u' || followed_pubkey) AS followed_pubkey, created_at FROM e")
def parsed_follows(spark, sf_dir):
    return ing.follows_of(ing.latest_per_author(fx.event_objects(spark, sf_dir)))


def _halves(spark, sf_dir):
    events = fx.order_events(spark, sf_dir)
    return events.filter(F.col("created_at") < EPOCH_OF_SPLIT), events.filter(F.col("created_at") >= EPOCH_OF_SPLIT)


REPLACED = f"""{EVENTS_SQL},
ev1 AS (SELECT * FROM ev WHERE created_at < {EPOCH_OF_SPLIT}), ev2 AS (SELECT * FROM ev WHERE created_at >= {EPOCH_OF_SPLIT}),
{edges_sql('ev1', 'e1')},
{edges_sql('ev2', 'e2')},
e AS (SELECT * FROM e1 WHERE follower_pubkey NOT IN (SELECT follower_pubkey FROM e2) UNION ALL SELECT * FROM e2)"""


def _edges_of_events(spark, sf_dir, events):
    return fx.edges_of(spark, sf_dir, ing.latest_per_author(events))


@query(f"WITH {REPLACED} SELECT * FROM e")
def replace_lists(spark, sf_dir):
    first, second = (_edges_of_events(spark, sf_dir, x) for x in _halves(spark, sf_dir))
    return ing.replace_lists(first, second)


@query(HEAD + "\nSELECT count(*) AS total_follows, count(DISTINCT follower_pubkey) AS unique_followers, count(DISTINCT followed_pubkey) AS unique_followed FROM e")
def graph_stats(spark, sf_dir):
    return rel.graph_stats(fx.follow_edges(spark, sf_dir))


@query(
    HEAD + """
SELECT pubkey, cast(sum(o) AS BIGINT) AS out_degree, cast(sum(i) AS BIGINT) AS in_degree
FROM (SELECT follower_pubkey AS pubkey, 1 AS o, 0 AS i FROM e UNION ALL SELECT followed_pubkey, 0, 1 FROM e) GROUP BY pubkey"""
)
def degrees(spark, sf_dir):
    return rel.degrees(fx.follow_edges(spark, sf_dir))


@query(
    HEAD + f"\nSELECT count(*) FILTER (follower_pubkey = {ROOT}) AS out_degree, count(*) FILTER (followed_pubkey = {ROOT}) AS in_degree FROM e"
)
def pubkey_degree(spark, sf_dir):
    return rel.degree_of(fx.follow_edges(spark, sf_dir), ROOT)


@query(HEAD + "\nSELECT follower_pubkey AS pubkey FROM e UNION SELECT followed_pubkey FROM e")
def all_pubkeys(spark, sf_dir):
    return rel.all_pubkeys(fx.follow_edges(spark, sf_dir))


@query(
    HEAD + """
SELECT c_custkey::BIGINT AS pubkey, c_custkey IN (SELECT follower_pubkey FROM e UNION SELECT followed_pubkey FROM e) AS found FROM customer"""
)
def pubkey_exists(spark, sf_dir):
    probes = fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("bigint").alias("pubkey"))
    return rel.probe_exists(fx.follow_edges(spark, sf_dir), probes)


@query(
    HEAD + """,
p AS (SELECT DISTINCT cast(o_custkey AS BIGINT) AS a, cast(o_orderkey % n.n AS BIGINT) AS b FROM orders CROSS JOIN n)
SELECT a, b, (a, b) IN (SELECT (follower_pubkey, followed_pubkey) FROM e) AS follows FROM p"""
)
def direct_follow(spark, sf_dir):
    return rel.direct_follow(fx.follow_edges(spark, sf_dir), _pairs(spark, sf_dir))


@query(
    HEAD + """
SELECT x.follower_pubkey AS a, x.followed_pubkey AS b FROM e x JOIN e y ON x.follower_pubkey = y.followed_pubkey AND x.followed_pubkey = y.follower_pubkey
WHERE x.follower_pubkey < x.followed_pubkey"""
)
def mutual_follows(spark, sf_dir):
    return rel.mutual_follows(fx.follow_edges(spark, sf_dir))


@query(HEAD + f"\nSELECT followed_pubkey AS pubkey FROM e WHERE follower_pubkey = {ROOT}")
def following(spark, sf_dir):
    return rel.following(fx.follow_edges(spark, sf_dir), ROOT)


@query(HEAD + f"\nSELECT follower_pubkey AS pubkey FROM e WHERE followed_pubkey = {ROOT}")
def followers(spark, sf_dir):
    return rel.followers(fx.follow_edges(spark, sf_dir), ROOT)


@query(
    HEAD + """
SELECT x.follower_pubkey AS source, y.followed_pubkey AS target, count(*) AS via
FROM e x JOIN e y ON x.followed_pubkey = y.follower_pubkey GROUP BY ALL"""
)
def two_hop(spark, sf_dir):
    edges = cut(fx.follow_edges(spark, sf_dir))
    return rel.two_hop(edges, edges.select(F.col("follower_pubkey").alias("source")))


#: Pairs of keys that aren't taken from the edges: customer and order number.
PAIRS_SQL = "p AS (SELECT DISTINCT cast(o_custkey AS BIGINT) AS a, cast(o_orderkey % n.n AS BIGINT) AS b FROM orders CROSS JOIN n)"


def _pairs(spark, sf_dir, a="a", b="b"):
    customers = fx.table(spark, sf_dir, "customer").count()
    pairs = fx.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("bigint").alias(a), (F.col("o_orderkey") % customers).cast("bigint").alias(b)
    )
    return pairs.distinct()


@query(
    HEAD + f""",
{PAIRS_SQL}
SELECT p.a AS source, p.b AS target, min(x.followed_pubkey) AS mid
FROM p JOIN e x ON x.follower_pubkey = p.a JOIN e y ON y.follower_pubkey = x.followed_pubkey AND y.followed_pubkey = p.b GROUP BY ALL"""
)
def two_hop_pairs(spark, sf_dir):
    """Both ends fixed."""
    return rel.two_hop_pairs(cut(fx.follow_edges(spark, sf_dir)), _pairs(spark, sf_dir, "source", "target"))


@query(
    HEAD + f""",
{PAIRS_SQL},
k AS (SELECT follower_pubkey AS pubkey FROM e UNION SELECT followed_pubkey FROM e)
SELECT a, b, a IN (SELECT pubkey FROM k) AS found_a, b IN (SELECT pubkey FROM k) AS found_b FROM p"""
)
def both_exist(spark, sf_dir):
    return rel.pairs_exist(fx.follow_edges(spark, sf_dir), _pairs(spark, sf_dir))


@query(
    HEAD + f""",
w(node, d) AS (SELECT {ROOT}::BIGINT, 0 UNION SELECT e.followed_pubkey, d + 1 FROM w JOIN e ON e.follower_pubkey = w.node WHERE d < 3)
SELECT DISTINCT node AS pubkey FROM w WHERE node <> {ROOT}"""
)
def users_within_distance(spark, sf_dir):
    found = trav.single(fx.cached_edges(spark, sf_dir), ROOT, 3).filter("distance > 0")
    return found.select(F.col("node").alias("pubkey")).orderBy("pubkey")


@query(
    HEAD + """,
w(source, node, d) AS (SELECT DISTINCT follower_pubkey, follower_pubkey, 0 FROM e UNION SELECT w.source, e.followed_pubkey, d + 1 FROM w JOIN e ON e.follower_pubkey = w.node WHERE d < 3)
SELECT source, node, min(d) AS distance FROM w GROUP BY source, node HAVING min(d) > 0"""
)
def within_distance_all(spark, sf_dir):
    """From every follower."""
    edges = fx.cached_edges(spark, sf_dir)
    return trav.within(edges, edges.select(F.col("follower_pubkey").alias("source")).distinct(), 3)


@query(HEAD + BFS + "\nSELECT * FROM rd")
def root_distances(spark, sf_dir):
    return trav.root_distances(fx.cached_edges(spark, sf_dir), ROOT, DEPTH)


@query(HEAD + BFS + "\nSELECT pubkey FROM rd WHERE distance = 2")
def users_at_distance(spark, sf_dir):
    table = trav.root_distances(fx.cached_edges(spark, sf_dir), ROOT, DEPTH)
    return table.filter("distance = 2").select("pubkey")


@query(HEAD + BFS + "\nSELECT distance, count(*) AS count FROM rd WHERE distance > 0 GROUP BY distance")
def distance_distribution(spark, sf_dir):
    return trav.distribution(trav.root_distances(fx.cached_edges(spark, sf_dir), ROOT, DEPTH))


@query(HEAD + BFS + "\nSELECT c_custkey::BIGINT AS target, distance FROM customer LEFT JOIN rd ON pubkey = c_custkey")
def distance_batch(spark, sf_dir):
    targets = fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("bigint").alias("target"))
    return trav.distances_to(fx.cached_edges(spark, sf_dir), ROOT, targets, DEPTH)


@query(
    HEAD + BFS + """,
m AS (SELECT unnest(range(1, 7)) AS max_depth)
SELECT cast(max_depth AS INTEGER) AS max_depth, c_custkey::BIGINT AS target,
       CASE WHEN distance <= 1 OR (distance = 2 AND max_depth >= 2) OR (distance >= 3 AND distance <= 2 * floor(max_depth / 2)) THEN distance END AS distance
FROM customer CROSS JOIN m LEFT JOIN rd ON pubkey = c_custkey"""
)
def shortest_distance_contract(spark, sf_dir):
    """One search serves all depths: what a depth reaches is a filter on the distance."""
    targets = fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("bigint").alias("target"))
    found = cut(trav.distances_to(fx.cached_edges(spark, sf_dir), ROOT, targets, DEPTH))
    depths = F.array(*[
        F.struct(F.lit(m).alias("max_depth"), F.when(F.col("distance") <= trav.reachable_levels(m), F.col("distance")).alias("distance"))
        for m in range(1, DEPTH + 1)
    ])
    return found.select("target", F.explode(depths).alias("m")).select("m.max_depth", "target", "m.distance")


def _paths_sql() -> str:
    """A level at a time, one smallest path per node: enumerating all paths isn't feasible this deep."""
    parts = [f"{HEAD},\ns0 AS (SELECT {ROOT}::BIGINT AS node, 0 AS d, [{ROOT}::BIGINT] AS path)"]
    for i in range(DEPTH):
        parts.append(f"""s{i + 1} AS MATERIALIZED (
  SELECT * FROM s{i} UNION ALL SELECT e.followed_pubkey, {i + 1}, min(list_append(path, e.followed_pubkey)) FROM s{i} JOIN e ON e.follower_pubkey = s{i}.node
  WHERE d = {i} AND e.followed_pubkey NOT IN (SELECT node FROM s{i}) GROUP BY e.followed_pubkey)""")
    return ",\n".join(parts) + f"\nSELECT node AS target, d AS distance, array_to_string(path, '>') AS path FROM s{DEPTH}"


@query(_paths_sql())
def shortest_path_all(spark, sf_dir):
    """Paths to every node within DEPTH levels of the root."""
    found = trav.single(fx.cached_edges(spark, sf_dir), ROOT, DEPTH, with_path=True)
    as_text = F.concat_ws(">", F.col("path").cast("array<string>"))
    return found.select(F.col("node").alias("target"), "distance", as_text.alias("path"))


PAIR_DEPTH = 4


def _pair_paths_sql() -> str:
    """Of each source, a level at a time, one smallest path per node."""
    parts = [f"{HEAD},\n{PAIRS_SQL},\ns0 AS (SELECT DISTINCT a AS source, a AS node, 0 AS d, [a] AS path FROM p)"]
    for i in range(PAIR_DEPTH):
        parts.append(f"""s{i + 1} AS MATERIALIZED (
  SELECT * FROM s{i} UNION ALL SELECT s.source, e.followed_pubkey, {i + 1}, min(list_append(path, e.followed_pubkey)) FROM s{i} s JOIN e ON e.follower_pubkey = s.node
  WHERE d = {i} AND NOT EXISTS (SELECT 1 FROM s{i} t WHERE t.source = s.source AND t.node = e.followed_pubkey) GROUP BY s.source, e.followed_pubkey)""")
    return ",\n".join(parts) + (
        f"\nSELECT p.a AS source, p.b AS target, d AS distance, array_to_string(path, '>') AS path FROM p JOIN s{PAIR_DEPTH} s ON s.source = p.a AND s.node = p.b"
    )


@query(_pair_paths_sql())
def shortest_pairs(spark, sf_dir):
    """Paths of many pairs by the two-sided search that single ones use."""
    edges, pairs = cut(fx.follow_edges(spark, sf_dir)), _pairs(spark, sf_dir, "source", "target")
    found = trav.shortest_pairs(cut_by(edges, "follower_pubkey"), pairs, PAIR_DEPTH, True, rel.Dealt(edges, backward=True))
    return found.withColumn("path", F.concat_ws(">", F.col("path").cast("array<string>")))


@query(
    HEAD + BFS + """,
m AS (SELECT unnest(range(0, 8)) AS max_depth)
SELECT cast(max_depth AS INTEGER) AS max_depth, c_custkey::BIGINT AS target, distance
FROM customer CROSS JOIN m JOIN rd ON pubkey = c_custkey
WHERE distance <= 1 OR (distance = 2 AND max_depth >= 2) OR (distance >= 3 AND distance <= 2 * floor(max_depth / 2))"""
)
def shortest_by_depth(spark, sf_dir):
    """What a two-sided search finds at each depth; odd ones reach no further than even ones, and direct edges are always found.

    One search of the largest depth serves all: a smaller depth finds the pairs that it reaches."""
    edges = cut(fx.follow_edges(spark, sf_dir))
    ahead, back = cut_by(edges, "follower_pubkey"), rel.Dealt(edges, backward=True)
    pairs = fx.table(spark, sf_dir, "customer").select(F.lit(ROOT).cast("bigint").alias("source"), F.col("c_custkey").cast("bigint").alias("target"))
    found = trav.shortest_pairs(ahead, pairs, 7, backward=back)
    depths = F.array(*[F.when(F.col("distance") <= trav.reachable_levels(m), F.lit(m)) for m in range(8)])
    return found.select(F.explode(F.array_compact(depths)).alias("max_depth"), "target", "distance")


@query(HEAD + BFS + "\nSELECT pubkey, distance FROM rd WHERE distance BETWEEN 1 AND 3")
def root_within(spark, sf_dir):
    return trav.root_within(trav.root_distances(fx.cached_edges(spark, sf_dir), ROOT, DEPTH), 3)


@query(HEAD + BFS + "\nSELECT c_custkey::BIGINT AS target, distance FROM customer LEFT JOIN rd ON pubkey = c_custkey")
def root_lookup(spark, sf_dir):
    """Every key looked up in the root's table."""
    targets = fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("bigint").alias("target"))
    return trav.root_lookup(trav.root_distances(fx.cached_edges(spark, sf_dir), ROOT, DEPTH), targets)


@query(
    """SELECT cast(o_orderkey AS BIGINT) AS ord, CASE WHEN o_orderstatus = 'P' THEN 'Expected Kind 3 event, got Kind 1'
  WHEN o_orderpriority = '5-LOW' THEN 'Expected Kind 3 event, got Kind undefined' WHEN o_orderpriority = '1-URGENT' THEN 'Invalid created_at: must be a positive number'
  WHEN o_totalprice > 300000 THEN 'Invalid tags: must be an array' END AS error FROM orders"""
)
def event_errors(spark, sf_dir):
    """The first rule that each event breaks, of events that break several."""
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    tags = F.when(F.col("o_totalprice") <= 300000, F.array().cast("array<array<string>>"))
    events = fx.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("bigint").alias("ord"),
        F.when(status == "P", 1).when(priority != "5-LOW", 3).alias("kind"),
        F.when(priority == "1-URGENT", -1).otherwise(0).cast("bigint").alias("created_at"),
        tags.alias("tags"),
    )
    return events.select("ord", ing.event_error().alias("error"))


_U = "sha256('u' || cast(l_partkey % 50 AS BIGINT))"


@query(
    f"""SELECT DISTINCT 'A' || cast(l_orderkey AS BIGINT) AS follower_pubkey, {_U} AS followed_pubkey, 1::BIGINT AS created_at FROM lineitem WHERE l_linenumber IN (1, 2, 7)"""
)
def tag_rules(spark, sf_dir):
    """Tags of all kinds: upper case, too short, another type, no key, not hexadecimal, with relay and name."""
    key = F.sha2(F.concat(F.lit("u"), (F.col("l_partkey") % 50).cast("bigint").cast("string")), 256)
    p, n = F.lit("p"), F.col("l_linenumber")
    tag = (
        F.when(n == 1, F.array(p, F.upper(key))).when(n == 2, F.array(p, key)).when(n == 3, F.array(p, F.substring(key, 1, 63)))
        .when(n == 4, F.array(F.lit("P"), key)).when(n == 5, F.array(p)).when(n == 6, F.array(p, F.concat(F.lit("g"), F.substring(key, 2, 63))))
        .otherwise(F.array(p, key, F.lit("wss://relay"), F.lit("name")))
    )
    events = fx.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(tag).alias("tags"))
    author = F.concat(F.lit("A"), F.col("l_orderkey").cast("bigint").cast("string"))  # an author's key isn't checked
    return ing.follows_of(events.select(author.alias("pubkey"), F.lit(1).cast("bigint").alias("created_at"), "tags"))


def _two_calls_sql(strict: bool) -> str:
    """Events from the split on come first, the older ones second; orders of status F have no tags."""
    shown = lambda name, events: f"""{name}_kept AS (SELECT pubkey, created_at, ord FROM (SELECT *, row_number() OVER (PARTITION BY pubkey ORDER BY created_at DESC, ord) AS rn FROM {events}) WHERE rn = 1),
{name} AS (SELECT DISTINCT k.pubkey AS a, cast((l_partkey * 31 + l_suppkey * 17) % n.n AS BIGINT) AS b, k.created_at FROM {name}_kept k
  JOIN orders ON o_orderkey = k.ord JOIN lineitem ON l_orderkey = k.ord CROSS JOIN n WHERE o_orderstatus <> 'F')"""  # noqa: E731
    newer = "k.pubkey NOT IN (SELECT a FROM x1) OR k.created_at > (SELECT max(created_at) FROM x1 WHERE a = k.pubkey)"
    replaced = f"SELECT pubkey AS a FROM x2_kept k WHERE {newer}" if strict else "SELECT a FROM x2"
    return f"""WITH {EVENTS_SQL},
ev1 AS (SELECT * FROM ev WHERE created_at >= {EPOCH_OF_SPLIT}), ev2 AS (SELECT * FROM ev WHERE ord IN (SELECT o_orderkey FROM orders WHERE o_orderdate < '{SPLIT}' OR o_orderpriority = '1-URGENT')),
{shown('x1', 'ev1')},
{shown('x2', 'ev2')},
r AS ({replaced}),
z AS (SELECT * FROM x1 WHERE a NOT IN (SELECT a FROM r) UNION ALL SELECT * FROM x2 WHERE a IN (SELECT a FROM r))
SELECT sha256('u' || a) AS follower_pubkey, sha256('u' || b) AS followed_pubkey, created_at FROM z"""


def _two_calls(spark, sf_dir, strict):
    empty = F.array().cast("array<array<string>>")
    events = fx.event_objects(spark, sf_dir, "o_orderstatus", "o_orderpriority")
    events = events.withColumn("tags", F.when(F.col("o_orderstatus") == "F", empty).otherwise(F.col("tags")))
    late = F.col("created_at") >= EPOCH_OF_SPLIT
    columns = ["pubkey", "created_at", "kind", "tags", "ord"]
    nothing = spark.createDataFrame([], EDGES)
    first = cut(ing.ingest(nothing, events.filter(late).select(*columns)))
    return ing.ingest(first, events.filter(~late | (F.col("o_orderpriority") == "1-URGENT")).select(*columns), strict=strict)


@query(_two_calls_sql(False))
def ingest_two_calls(spark, sf_dir):
    """A later call's list wins even if it is older; one without follows clears nothing, though it hides older ones of its call."""
    return _two_calls(spark, sf_dir, False)


@query(_two_calls_sql(True))
def ingest_two_calls_strict(spark, sf_dir):
    """Only newer lists count, and an empty one clears."""
    return _two_calls(spark, sf_dir, True)


def _delta(spark, sf_dir, first, second):
    before = cut(_edges_of_events(spark, sf_dir, first))
    table = trav.root_distances(before, ROOT, DEPTH)
    after = cut(ing.replace_lists(before, _edges_of_events(spark, sf_dir, second)))
    return trav.relax(after, table, second.select("pubkey"), DEPTH)


@query(HEAD + BFS + "\nSELECT * FROM rd")
def root_delta_insert(spark, sf_dir):
    """Authors come in two halves, so no list is replaced and the delta equals a rebuild."""
    events = fx.order_events(spark, sf_dir)
    return _delta(spark, sf_dir, events.filter("pubkey % 2 = 0"), events.filter("pubkey % 2 = 1"))


def _relax_sql() -> str:
    """The delta's rounds, unrolled."""
    parts = [f"""WITH RECURSIVE {REPLACED},
b(node, d) AS (SELECT {ROOT}::BIGINT, 0 UNION SELECT e1.followed_pubkey, d + 1 FROM b JOIN e1 ON e1.follower_pubkey = b.node WHERE d < {DEPTH}),
t0 AS (SELECT node AS pubkey, min(d) AS distance FROM b GROUP BY node),
f0 AS (SELECT DISTINCT pubkey FROM ev2)"""]
    for i in range(DEPTH + 2):
        parts.append(f"""u{i} AS MATERIALIZED (
  SELECT o.pubkey, o.d AS distance FROM (SELECT e.followed_pubkey AS pubkey, min(t.distance + 1) AS d FROM f{i} f JOIN e ON e.follower_pubkey = f.pubkey
  JOIN t{i} t ON t.pubkey = f.pubkey WHERE t.distance + 1 <= {DEPTH} GROUP BY 1) o LEFT JOIN t{i} x ON x.pubkey = o.pubkey WHERE x.pubkey IS NULL OR o.d < x.distance),
t{i + 1} AS MATERIALIZED (SELECT * FROM t{i} WHERE pubkey NOT IN (SELECT pubkey FROM u{i}) UNION ALL SELECT * FROM u{i}),
f{i + 1} AS (SELECT pubkey FROM u{i})""")
    return ",\n".join(parts) + f"\nSELECT * FROM t{DEPTH + 2}"


@query(_relax_sql())
def root_delta_stale(spark, sf_dir):
    """Lists are replaced, and distances that lost their path stay."""
    return _delta(spark, sf_dir, *_halves(spark, sf_dir))


JSON_SQL = """WITH RECURSIVE e AS (
  SELECT DISTINCT cast(user_id AS BIGINT) AS follower_pubkey, cast(json_extract_string(props, '$.k') AS BIGINT) AS followed_pubkey FROM events
  WHERE json_extract_string(props, '$.k') IS NOT NULL)"""


@query(JSON_SQL + "\nSELECT count(*) AS total_follows, count(DISTINCT follower_pubkey) AS unique_followers, count(DISTINCT followed_pubkey) AS unique_followed FROM e")
def json_graph_stats(spark, sf_dir):
    """The graph of the event stream, its followed key read from JSON."""
    edges = fx.table(spark, sf_dir, "events").select(
        F.col("user_id").cast("bigint").alias("follower_pubkey"),
        F.get_json_object("props", "$.k").cast("bigint").alias("followed_pubkey"),
    )
    return rel.graph_stats(edges.filter("followed_pubkey is not null").distinct())


RANK_SQL = f"""{HEAD},
k AS MATERIALIZED (SELECT pubkey, count(e.followed_pubkey) AS o FROM (SELECT follower_pubkey AS pubkey FROM e UNION SELECT followed_pubkey FROM e) LEFT JOIN e ON e.follower_pubkey = pubkey GROUP BY pubkey),
c AS (SELECT count(*) AS c FROM k),
r(i, pubkey, rank, change) AS (
  SELECT 0, pubkey, 1.0::DOUBLE / c.c, 1.0::DOUBLE FROM k CROSS JOIN c
  UNION ALL
  SELECT i, pubkey, rank, sum(abs(rank - old)) OVER () FROM (
    SELECT r.i + 1 AS i, r.pubkey, r.rank AS old,
           (1 - {measure.DAMPING}::DOUBLE) / c.c + {measure.DAMPING}::DOUBLE * coalesce((SELECT sum(z.rank) FROM r z JOIN k USING (pubkey) WHERE k.o = 0), 0) / c.c + {measure.DAMPING}::DOUBLE * coalesce(g.got, 0) AS rank
    FROM r CROSS JOIN c LEFT JOIN (
      SELECT e.followed_pubkey AS pubkey, sum(x.rank / k.o) AS got FROM r x JOIN k USING (pubkey) JOIN e ON e.follower_pubkey = x.pubkey GROUP BY 1) g ON g.pubkey = r.pubkey
    WHERE r.change >= {measure.TOLERANCE} AND r.i < {measure.MOST_ROUNDS}))
SELECT pubkey, round(rank, 12) AS rank FROM r WHERE i = (SELECT max(i) FROM r)"""


@query(RANK_SQL)
def pagerank(spark, sf_dir):
    """Until the ranks' changes add up to less than the tolerance."""
    found = measure.pagerank(fx.follow_edges(spark, sf_dir))
    return found.select("pubkey", F.round("rank", 12).alias("rank"))


@query(
    HEAD + """,
p AS (SELECT DISTINCT least(follower_pubkey, followed_pubkey) AS a, greatest(follower_pubkey, followed_pubkey) AS b FROM e WHERE follower_pubkey <> followed_pubkey),
s AS (SELECT a AS x, b AS y FROM p UNION ALL SELECT b, a FROM p),
d AS (SELECT x, count(*) AS n FROM s GROUP BY x),
t AS (SELECT u.x, count(*) AS t FROM s u JOIN s v ON u.x = v.x AND u.y < v.y JOIN p ON p.a = u.y AND p.b = v.y GROUP BY u.x),
k AS (SELECT follower_pubkey AS pubkey FROM e UNION SELECT followed_pubkey FROM e)
SELECT pubkey, CASE WHEN n > 1 THEN 2.0::DOUBLE * coalesce(t, 0) / (n * (n - 1)) ELSE 0 END AS coefficient FROM k LEFT JOIN d ON d.x = pubkey LEFT JOIN t ON t.x = pubkey"""
)
def clustering_coefficient(spark, sf_dir):
    return measure.clustering_coefficient(cut(fx.follow_edges(spark, sf_dir)))


@query(
    HEAD + """,
s AS (SELECT follower_pubkey AS x, followed_pubkey AS y FROM e UNION SELECT followed_pubkey, follower_pubkey FROM e),
c(pubkey, component) AS (SELECT x, x FROM s UNION SELECT s.y, c.component FROM c JOIN s ON s.x = c.pubkey WHERE c.component < s.y)
SELECT pubkey, min(component) AS component FROM c GROUP BY pubkey"""
)
def weak_components(spark, sf_dir):
    return measure.weak_components(cut(fx.follow_edges(spark, sf_dir)))


@query(f"""WITH RECURSIVE {REPLACED},
b(node, d) AS (SELECT {ROOT}::BIGINT, 0 UNION SELECT e.followed_pubkey, d + 1 FROM b JOIN e ON e.follower_pubkey = b.node WHERE d < {DEPTH})
SELECT node AS pubkey, min(d) AS distance FROM b GROUP BY node""")
def root_delta_removal(spark, sf_dir):
    """Lists are replaced, and what lost its path is found and reached anew: equal to a rebuild."""
    first, second = _halves(spark, sf_dir)
    before = cut(_edges_of_events(spark, sf_dir, first))
    table = cut(trav.root_distances(before, ROOT, DEPTH))
    after = cut(ing.replace_lists(before, _edges_of_events(spark, sf_dir, second)))
    return trav.refresh(after, table, *trav.changes(before, after), DEPTH)


#: Distances of every node from each source of a pair, then whatever is built on them.
_FROM_SOURCES = f""",
{PAIRS_SQL},
w(source, node, d) AS (SELECT DISTINCT a, a, 0 FROM p UNION SELECT w.source, e.followed_pubkey, d + 1 FROM w JOIN e ON e.follower_pubkey = w.node WHERE d < {PAIR_DEPTH}),
near AS MATERIALIZED (SELECT source, node, min(d) AS d FROM w GROUP BY ALL)"""


@query(
    HEAD + _FROM_SOURCES + """,
m(source, node, d, paths) AS (
  SELECT DISTINCT a, a, 0, 1::HUGEINT FROM p
  UNION ALL SELECT m.source, e.followed_pubkey, m.d + 1, sum(m.paths) FROM m JOIN e ON e.follower_pubkey = m.node JOIN near ON near.source = m.source AND near.node = e.followed_pubkey AND near.d = m.d + 1 GROUP BY ALL)
SELECT p.a AS source, p.b AS target, d AS distance, cast(paths AS BIGINT) AS paths FROM p JOIN m ON m.source = p.a AND m.node = p.b"""
)
def shortest_path_counts(spark, sf_dir):
    """How many shortest paths each pair has."""
    edges, pairs = cut(fx.follow_edges(spark, sf_dir)), _pairs(spark, sf_dir, "source", "target")
    return paths.count_shortest_paths(cut_by(edges, "follower_pubkey"), pairs, PAIR_DEPTH, rel.Dealt(edges, backward=True))


@query(
    HEAD + _FROM_SOURCES + """,
s(source, node, d, path) AS (
  SELECT DISTINCT a, a, 0, cast(a AS VARCHAR) FROM p
  UNION ALL SELECT s.source, e.followed_pubkey, s.d + 1, s.path || '>' || e.followed_pubkey FROM s JOIN e ON e.follower_pubkey = s.node JOIN near ON near.source = s.source AND near.node = e.followed_pubkey AND near.d = s.d + 1)
SELECT p.a AS source, p.b AS target, d AS distance, path FROM p JOIN s ON s.source = p.a AND s.node = p.b"""
)
def all_shortest_paths(spark, sf_dir):
    """Every shortest path of each pair."""
    edges, pairs = cut(fx.follow_edges(spark, sf_dir)), _pairs(spark, sf_dir, "source", "target")
    found = paths.all_shortest_paths(cut_by(edges, "follower_pubkey"), pairs, PAIR_DEPTH, rel.Dealt(edges, backward=True))
    return found.withColumn("path", F.concat_ws(">", F.col("path").cast("array<string>")))


@query(
    HEAD + f""",
{PAIRS_SQL},
s(source, target, node, path) AS (
  SELECT a, b, a, [a] FROM p WHERE a <> b
  UNION ALL SELECT s.source, s.target, e.followed_pubkey, list_append(path, e.followed_pubkey) FROM s JOIN e ON e.follower_pubkey = s.node
  WHERE s.node <> s.target AND len(path) <= {PAIR_DEPTH} AND NOT list_contains(path, e.followed_pubkey))
SELECT source, target, array_to_string(path, '>') AS path FROM s WHERE node = target"""
)
def simple_paths(spark, sf_dir):
    """Every path of each pair that repeats no key and has at most so many edges."""
    edges, pairs = cut(fx.follow_edges(spark, sf_dir)), _pairs(spark, sf_dir, "source", "target")
    found = paths.simple_paths(cut_by(edges, "follower_pubkey"), pairs, PAIR_DEPTH, rel.Dealt(edges, backward=True))
    return found.withColumn("path", F.concat_ws(">", F.col("path").cast("array<string>")))


@query(
    HEAD + """,
w(there, here, d) AS (SELECT DISTINCT followed_pubkey, followed_pubkey, 0 FROM e UNION SELECT w.there, e.follower_pubkey, d + 1 FROM w JOIN e ON e.followed_pubkey = w.here WHERE d < 3),
near AS MATERIALIZED (SELECT there, here, min(d) AS d FROM w GROUP BY ALL)
SELECT x.here, x.there, min(e.followed_pubkey) AS via, x.d AS len FROM near x JOIN e ON e.follower_pubkey = x.here JOIN near y ON y.there = x.there AND y.here = e.followed_pubkey AND y.d = x.d - 1
GROUP BY ALL"""
)
def routing_table(spark, sf_dir):
    """Next hops to every followed key from all keys within three steps."""
    edges = fx.follow_edges(spark, sf_dir)
    back = cut_by(edges, "followed_pubkey")
    return paths.routing_table(back, back.select(F.col("followed_pubkey").alias("target")).distinct(), 3, back)


MUTES_SQL = """mu_kept AS (SELECT pubkey, created_at, ord FROM (SELECT ev.*, row_number() OVER (PARTITION BY pubkey ORDER BY created_at DESC, ord) AS rn FROM ev JOIN orders ON o_orderkey = ord WHERE o_orderpriority = '1-URGENT') WHERE rn = 1),
mu AS (SELECT DISTINCT k.pubkey AS muter_pubkey, cast((l_partkey * 13 + l_suppkey * 7) % n.n AS BIGINT) AS muted_pubkey, k.created_at FROM mu_kept k JOIN lineitem ON l_orderkey = k.ord CROSS JOIN n)"""
_COUNTS_SQL = f"""{HEAD}{BFS},
{MUTES_SQL},
x AS (SELECT follower_pubkey AS author, followed_pubkey AS pubkey, 1 AS f, 0 AS m FROM e UNION ALL SELECT muter_pubkey, muted_pubkey, 0, 1 FROM mu),
cd AS (SELECT x.pubkey, rd.distance, cast(sum(f) AS BIGINT) AS followers, cast(sum(m) AS BIGINT) AS muters FROM x JOIN rd ON rd.pubkey = author WHERE author <> x.pubkey GROUP BY ALL)"""


def _mute_counts(spark, sf_dir):
    edges = fx.cached_edges(spark, sf_dir)
    return mut.counts_by_distance(edges, fx.mute_edges(spark, sf_dir), cut(trav.root_distances(edges, ROOT, DEPTH)))


@query(_COUNTS_SQL + "\nSELECT * FROM cd")
def mute_counts(spark, sf_dir):
    """Followers and muters of every key by their distance from the root."""
    return _mute_counts(spark, sf_dir)


@query(_COUNTS_SQL + "\nSELECT * FROM cd x WHERE distance = (SELECT min(distance) FROM cd y WHERE y.pubkey = x.pubkey) AND muters > followers")
def overmuted(spark, sf_dir):
    return mut.overmuted(_mute_counts(spark, sf_dir))


@query(
    HEAD + f""",
{MUTES_SQL},
bad AS (SELECT DISTINCT muted_pubkey AS k FROM mu WHERE muted_pubkey NOT IN (SELECT followed_pubkey FROM e))
SELECT 'follow' AS kind, * FROM e WHERE follower_pubkey NOT IN (SELECT k FROM bad) AND followed_pubkey NOT IN (SELECT k FROM bad)
UNION ALL SELECT 'mute', * FROM mu WHERE muter_pubkey NOT IN (SELECT k FROM bad) AND muted_pubkey NOT IN (SELECT k FROM bad)"""
)
def muted_removed(spark, sf_dir):
    """Both tables less all keys that are muted and not followed."""
    follows, mutes = cut(fx.follow_edges(spark, sf_dir)), cut(fx.mute_edges(spark, sf_dir))
    gone = cut(mut.muted_without_followers(follows, mutes))
    left, silent = mut.without(follows, gone), mut.without(mutes, gone)
    silent = silent.withColumnsRenamed({"muter_pubkey": "follower_pubkey", "muted_pubkey": "followed_pubkey"})
    return left.withColumn("kind", F.lit("follow")).unionByName(silent.withColumn("kind", F.lit("mute")))


@query(HEAD + "\nSELECT DISTINCT x.follower_pubkey AS source, y.follower_pubkey AS target, 2 AS hops FROM e x JOIN e y ON x.followed_pubkey = y.followed_pubkey")
def pattern_same_interest(spark, sf_dir):
    """(a)->(x)<-(b): keys that follow a common key."""
    return pat.match(cut(fx.follow_edges(spark, sf_dir)), [pat.Step("out"), pat.Step("in")])


@query(
    HEAD + """,
w(source, node, d) AS (SELECT DISTINCT pubkey, pubkey, 0 FROM (SELECT follower_pubkey AS pubkey FROM e UNION SELECT followed_pubkey FROM e) UNION SELECT w.source, e.followed_pubkey, d + 1 FROM w JOIN e ON e.follower_pubkey = w.node WHERE d < 3)
SELECT source, node AS target, min(d) AS hops FROM w WHERE d >= 2 GROUP BY ALL"""
)
def pattern_two_to_three(spark, sf_dir):
    """(a)->{2,3}(b): walks of two or three edges, the shorter of each pair."""
    return pat.match(fx.cached_edges(spark, sf_dir), [pat.Step("out", 2, 3)])


@query(
    HEAD + """,
m AS (SELECT x.follower_pubkey AS a, x.followed_pubkey AS b FROM e x JOIN e y ON x.follower_pubkey = y.followed_pubkey AND x.followed_pubkey = y.follower_pubkey),
s AS (SELECT follower_pubkey AS a, followed_pubkey AS b FROM e UNION SELECT followed_pubkey, follower_pubkey FROM e),
r AS (SELECT a AS source, b AS target, 1 AS hops FROM m UNION ALL SELECT m.a, s.b, 2 FROM m JOIN s ON s.a = m.b)
SELECT source, target, min(hops) AS hops FROM r GROUP BY ALL"""
)
def pattern_friends_circle(spark, sf_dir):
    """(a)<->(b)-{0,1}(c): keys at or next to a mutual follow, in any direction."""
    return pat.match(cut(fx.follow_edges(spark, sf_dir)), [pat.Step("mutual"), pat.Step("any", 0, 1)])


@query(HEAD + f""",
{edges_sql('(SELECT * FROM ev WHERE ord % 2 = 0)', 'e1')},
{edges_sql('(SELECT * FROM ev WHERE ord % 2 = 1)', 'e2')},
t1 AS (SELECT follower_pubkey AS k, max(created_at) AS last FROM e1 GROUP BY 1), t2 AS (SELECT follower_pubkey AS k, max(created_at) AS last FROM e2 GROUP BY 1)
SELECT e1.* FROM e1 LEFT JOIN t2 ON k = follower_pubkey WHERE last IS NULL OR last <= created_at
UNION ALL SELECT e2.* FROM e2 LEFT JOIN t1 ON k = follower_pubkey WHERE last IS NULL OR last < created_at""")
def merged_lists(spark, sf_dir):
    """Two graphs of half the events each, merged by the newer list of each author."""
    events = fx.order_events(spark, sf_dir)
    ours, theirs = (cut(_edges_of_events(spark, sf_dir, events.filter(F.col("ord") % 2 == k))) for k in (0, 1))
    return ing.merge(ours, theirs)


@query(HEAD + """
SELECT follower_pubkey, followed_pubkey, created_at FROM e""")
def compact_round_trip(spark, sf_dir):
    """Every edge, written in the compact form and read from it."""
    path = f"{shared_root(spark).rstrip('/')}/kinweave-compact-{uuid.uuid4().hex}"
    compact.write_compact(cut(fx.follow_edges(spark, sf_dir)), path)
    return compact.read_compact(spark, path)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
