"""Profiles of operators after a run: rows, times and bytes from Spark's metrics, through adaptive plans and query stages."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from kestrelq.plans.estimate import Estimator
from kestrelq.plans.tree import items


@dataclass
class Profile:
    """An operator: estimated rows (None: not known), rows of its inputs and its own (None: not counted), milliseconds and bytes of its own metrics."""

    operator: str
    estimated: int | None
    rows: int | None
    milliseconds: float
    bytes: int
    metrics: dict[str, int]
    children: list[Profile] = field(default_factory=list)

    @property
    def rows_in(self) -> int:
        """Rows that reach it: those of the nearest operators below that count theirs."""
        return sum(c.rows if c.rows is not None else c.rows_in for c in self.children)

    @property
    def inclusive(self) -> float:
        return self.milliseconds + sum(c.inclusive for c in self.children)

    def tree(self, indent: int = 0, whole: float | None = None) -> str:
        whole = whole or max(1e-9, self.inclusive)
        known = {"estimated": self.estimated, "in": self.rows_in if self.children else None, "out": self.rows}
        facts = [f"{k} {v}" for k, v in known.items() if v is not None] + [f"{self.inclusive:.1f} ms ({100 * self.inclusive / whole:.0f} %)", f"{self.bytes} bytes"]
        return "\n".join([f"{'  ' * indent}{self.operator}: {', '.join(facts)}", *(c.tree(indent + 1, whole) for c in self.children)])

    def walk(self):
        yield self
        for c in self.children:
            yield from c.walk()


def execute(df: DataFrame) -> int:
    """Runs the DataFrame's own plan to its last row; only the number of rows reaches the driver."""
    return int(df._jdf.queryExecution().toRdd().count())


def profile(df: DataFrame, estimator: Estimator) -> Profile:
    """Of a DataFrame that has been run. Operators of one code-generated stage share a clock, which counts for the uppermost; times add up over tasks."""
    return _visit(df._jdf.queryExecution().executedPlan(), estimator)


def _visit(node: Any, estimator: Estimator) -> Profile:
    name = node.nodeName()
    if name.startswith("AdaptiveSparkPlan"):
        return _visit(node.executedPlan(), estimator)
    if name.endswith("QueryStage"):
        return _visit(node.plan(), estimator)
    metrics, ms, size = _metrics(node)
    if name.startswith("WholeStageCodegen") or name == "InputAdapter":
        inner = _visit(items(node.children())[0], estimator)
        inner.metrics |= {f"codegen {k}": v for k, v in metrics.items()}
        inner.milliseconds += ms
        return inner
    return Profile(name.strip(), estimator.estimated(node, True), metrics.get("numOutputRows"), ms, size, metrics, [_visit(c, estimator) for c in items(node.children())])


def _metrics(node: Any) -> tuple[dict[str, int], float, int]:
    """Values by name, milliseconds and bytes, as the metrics' types say."""
    found, ms, size = {}, 0.0, 0
    for e in items(node.metrics()):
        value, kind = max(0, int(e._2().value())), e._2().metricType()
        found[str(e._1())] = value
        if kind == "timing":
            ms += value
        elif kind == "nsTiming":
            ms += value / 1e6
        elif kind == "size":
            size += value
    return found, ms, size
