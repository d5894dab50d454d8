"""Schemas and the cutting of lineage, shared by all operators."""

from kinweave.plans.lineage import cut, cut_and_count, cut_by, fixed_plans, partitions_for, shared_root
from kinweave.plans.schema import DISTANCES, EDGES, EVENTS
from kinweave.plans.skew import join_per_key

__all__ = ["DISTANCES", "EDGES", "EVENTS", "cut", "cut_and_count", "cut_by", "fixed_plans", "join_per_key", "partitions_for", "shared_root"]
