"""Plans as text, the trace of a query, and what the optimizer did."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

REPORTED = {
    "constants_folded": ("ConstantFolding", "NullPropagation"),
    "filters_simplified": ("BooleanSimplification", "PruneFilters", "SimplifyConditionals"),
    "predicates_pushed": ("PushDownPredicates", "PushPredicateThroughJoin", "PushPredicateThroughNonJoin", "PushDownLeftSemiAntiJoin"),
    "columns_pruned": ("ColumnPruning", "SchemaPruning"),
    "joins_reordered": ("ReorderJoin", "CostBasedJoinReorder"),
}


@dataclass
class Trace:
    ast: str
    logical: str
    optimized: str
    physical: str
    optimization: dict[str, int] = field(default_factory=dict)


def execution(df: DataFrame) -> Any:
    return df._jdf.queryExecution()


def logical(df: DataFrame) -> str:
    return execution(df).analyzed().toString()


def optimized(df: DataFrame) -> str:
    return execution(df).optimizedPlan().toString()


def physical(df: DataFrame) -> str:
    return execution(df).executedPlan().toString()


def report(df: DataFrame) -> dict[str, int]:
    """How often the rules of each kind changed the plan."""
    qe = execution(df)
    qe.optimizedPlan()
    rules = qe.tracker().rules()
    counted: dict[str, int] = {}
    it = rules.iterator()
    while it.hasNext():
        entry = it.next()
        counted[str(entry._1()).rpartition(".")[2]] = int(entry._2().numEffectiveInvocations())
    return {name: sum(counted.get(rule, 0) for rule in group) for name, group in REPORTED.items()}


def trace(df: DataFrame, ast: str) -> Trace:
    return Trace(ast, logical(df), optimized(df), physical(df), report(df))
