"""Settings of an engine, and what they mean for Spark."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum


class JoinPreference(Enum):
    """Hash and nested loop are the two algorithms a query can ask for; the others name Spark's further ones."""

    AUTO = None
    HASH = "SHUFFLE_HASH"
    BROADCAST = "BROADCAST"
    MERGE = "MERGE"
    NESTED_LOOP = "SHUFFLE_REPLICATE_NL"


class ExecutionMode(Enum):
    VECTORIZED = "vectorized"
    TUPLE = "tuple"


_RULES = "org.apache.spark.sql.catalyst.optimizer."


@dataclass(frozen=True)
class OptimizerOptions:
    constant_folding: bool = True
    filter_simplification: bool = True
    predicate_pushdown: bool = True
    projection_pruning: bool = True
    join_reordering: bool = True

    def excluded_rules(self) -> list[str]:
        off = {
            "constant_folding": ("ConstantFolding", "NullPropagation"),
            "filter_simplification": ("BooleanSimplification", "PruneFilters"),
            "predicate_pushdown": ("PushDownPredicates", "PushPredicateThroughNonJoin", "PushPredicateThroughJoin", "InferFiltersFromConstraints"),
            "projection_pruning": ("ColumnPruning",),
            "join_reordering": ("ReorderJoin", "CostBasedJoinReorder"),
        }
        return [_RULES + rule for name, rules in off.items() if not getattr(self, name) for rule in rules]

    def barrier(self) -> bool:
        """File scans push filters and prune columns by themselves; to see a plan without it, tables are read behind a checkpoint."""
        return not (self.predicate_pushdown and self.projection_pruning)


@dataclass(frozen=True)
class EngineConfig:
    optimizer: OptimizerOptions = field(default_factory=OptimizerOptions)
    mode: ExecutionMode = ExecutionMode.VECTORIZED
    batch_size: int = 4096
    join: JoinPreference = JoinPreference.AUTO
    strict: bool = False

    def __post_init__(self) -> None:
        if self.batch_size < 1:
            raise ValueError("batch_size must be at least 1")

    def settings(self) -> dict[str, str]:
        """Spark settings under which a query is analysed and planned."""
        vectorized = self.mode is ExecutionMode.VECTORIZED
        out = {
            "spark.sql.ansi.enabled": "true",
            "spark.sql.caseSensitive": "false",
            "spark.sql.optimizer.excludedRules": ",".join(self.optimizer.excluded_rules()),
            "spark.sql.parquet.enableVectorizedReader": str(vectorized).lower(),
            "spark.sql.codegen.wholeStage": str(vectorized).lower(),
            "spark.sql.parquet.columnarReaderBatchSize": str(self.batch_size if vectorized else 1),
        }
        if self.strict:
            out |= {"spark.sql.orderByOrdinal": "false", "spark.sql.groupByOrdinal": "false", "spark.sql.groupByAliases": "false"}
        return out
