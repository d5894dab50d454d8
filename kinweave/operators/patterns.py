"""Path patterns: steps of given kinds and lengths, matched by joins and level loops.

    match(edges, [Step("out"), Step("any", 1, 3), Step("mutual")], starts)

is what a graph query language writes as ``(a)->(b)-[]-{1,3}(c)<->(d)``. A step of a
fixed length is so many joins; one of a range is a loop that keeps, for each
source, the nodes at each length; one without an upper bound is a search that
ends when nothing new is found.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.operators.relational import DST, SRC, Steps
from kinweave.operators.traverse import BROADCAST_ROWS
from kinweave.plans.lineage import cut, cut_and_count

KINDS = ("out", "in", "any", "mutual")


@dataclass(frozen=True)
class Step:
    """``kind``: "out" along edges, "in" against them, "any" either way, "mutual" where both exist.

    Repeated ``low`` to ``high`` times; ``high`` None has no bound. ``where`` is a
    condition on the node that the whole step ends at, in the column ``node``."""

    kind: str = "out"
    low: int = 1
    high: int | None = 1
    where: Column | None = None

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"a step is one of {', '.join(KINDS)}, not {self.kind}")
        if self.low < 0 or (self.high is not None and self.high < max(1, self.low)):
            raise ValueError("a step needs 0 <= low <= high and high >= 1")


def _edges_of(edges: DataFrame, kind: str) -> DataFrame:
    plain = edges.select(SRC, DST)
    if kind == "out":
        return plain
    turned = edges.select(F.col(DST).alias(SRC), F.col(SRC).alias(DST))
    if kind == "in":
        return turned
    return cut(plain.unionByName(turned).distinct() if kind == "any" else plain.join(turned, [SRC, DST], "left_semi"))


def _repeated(steps: Steps, rows: DataFrame, step: Step) -> DataFrame:
    """``source, node, hops`` after the step, with the least hops of each pair."""
    level, n = cut_and_count(rows)
    reached = level if step.low == 0 else None
    length = 0
    while n and (step.high is None or length < step.high):
        length += 1
        on = steps.join(level, n <= BROADCAST_ROWS).groupBy("source", F.col("next").alias("node")).agg((F.min("hops") + 1).alias("hops"))
        if step.high is None and length > step.low and reached is not None:
            on = on.join(reached.select("source", "node"), ["source", "node"], "left_anti")
        level, n = cut_and_count(on)
        if length >= step.low:
            reached = level if reached is None else cut(reached.unionByName(level).groupBy("source", "node").agg(F.min("hops").alias("hops")))
    return reached if reached is not None else level


def match(edges: DataFrame, pattern: list[Step], starts: DataFrame | None = None) -> DataFrame:
    """``source, target, hops``: each pair of ends that a walk of the pattern joins, once,
    with the edges of its shortest such walk.

    ``starts`` has the column ``source``; without it every key is one. A walk may
    pass a node again. Hot nodes' edges are dealt out as in all searches.
    """
    keys = starts if starts is not None else edges.select(F.explode(F.array(SRC, DST)).alias("source"))
    rows = keys.select("source", F.col("source").alias("node"), F.lit(0).alias("hops")).distinct()
    made: dict[str, Steps] = {}
    for step in pattern:
        if step.kind not in made:
            made[step.kind] = Steps(_edges_of(edges, step.kind))
        rows = _repeated(made[step.kind], rows, step)
        if step.where is not None:
            rows = rows.filter(step.where)
    return rows.select("source", F.col("node").alias("target"), "hops")
