"""Connected components by alternating star contraction, each round written to the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrelq.llm.common import Workspace

MOST_ROUNDS = 60


def _to_least(pairs: DataFrame) -> DataFrame:
    """Rows (a, b) get the least b of their a; the least is summed up before it is joined back, so a hot node costs one row a task."""
    least = pairs.groupBy("a").agg(F.min("b").alias("least"))
    return pairs.join(least, "a")


def _settled(state: DataFrame) -> bool:
    """Whether the rows are stars: each a has one b, which is no a."""
    several = state.groupBy("a").count().filter(F.col("count") > 1).select("a")
    chained = state.join(state.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a")
    return not several.unionByName(chained).head(1)


def components(edges: DataFrame, work: Workspace) -> DataFrame:
    """From edges (a, b): rows (a, b) where b is the least node of a's component, for all a but these least nodes."""
    name = f"stars-{uuid.uuid4().hex[:8]}"  # an earlier result in the same folder may be an input
    state = work.save(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    for k in range(1, MOST_ROUNDS):
        if _settled(state):
            return state
        # larger neighbours of a node move to the least node around it
        both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _to_least(both).filter("b > a").select(F.col("b").alias("a"), F.least("a", "least").alias("b"))
        # a node and its smaller neighbours move to the least of these
        small = _to_least(large.filter("a <> b").distinct())
        moved = small.select("a", F.col("least").alias("b")).unionByName(small.filter("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b")))
        state = work.save(moved.distinct(), f"{name}-{k}")
        work.drop(f"{name}-{k - 1}")
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
