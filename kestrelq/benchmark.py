"""Controlled experiments on generated tables: raw observations, medians, 95th percentiles, rows a second, and comparison of two runs."""

from __future__ import annotations

import csv
import json
import math
import os
import platform
import statistics
import time
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from kestrelq.config import EngineConfig, ExecutionMode, JoinPreference, OptimizerOptions
from kestrelq.engine import Engine
from kestrelq.sources.generate import benchmark_tables

WARM_UPS = 2
JOINED = "SELECT o.o_orderkey AS okey, c.c_region AS region FROM orders o INNER JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_totalprice > 1000"
DOUBLED = "SELECT l_extendedprice * 2 AS value FROM lineitem WHERE l_quantity < 25"


@dataclass(frozen=True)
class Observation:
    experiment: str
    variant: str
    run: int
    seconds: float
    rows: int


def cases() -> Iterator[tuple[str, str, EngineConfig, str, int]]:
    """Experiment, variant, configuration, query, tables read (as a share of the lineitem rows, in quarters and twentieths)."""
    off = OptimizerOptions
    yield "A_storage_layout", "column", EngineConfig(), "SELECT SUM(l_extendedprice) AS s FROM lineitem WHERE l_quantity < 51", 1
    yield "A_storage_layout", "row", EngineConfig(mode=ExecutionMode.TUPLE), "SELECT SUM(l_extendedprice) AS s FROM lineitem WHERE l_quantity < 51", 1
    for name, flag in (("off", False), ("on", True)):
        yield "B_predicate_pushdown", name, EngineConfig(optimizer=off(predicate_pushdown=flag)), "SELECT l_orderkey, l_extendedprice FROM lineitem WHERE l_quantity < 10", 1
        yield "C_projection_pruning", name, EngineConfig(optimizer=off(projection_pruning=flag)), "SELECT l_orderkey, l_extendedprice FROM lineitem", 1
    yield "D_join_algorithm", "hash", EngineConfig(join=JoinPreference.HASH), JOINED, 0
    yield "D_join_algorithm", "nested_loop", EngineConfig(join=JoinPreference.NESTED_LOOP), JOINED, 0
    yield "E_execution_model", "tuple", EngineConfig(mode=ExecutionMode.TUPLE), DOUBLED, 1
    yield "E_execution_model", "vectorized", EngineConfig(), DOUBLED, 1
    for size in (1, 16, 64, 256, 1024, 4096):
        yield "F_batch_size", str(size), EngineConfig(batch_size=size), DOUBLED, 1


def timed(make: Callable[[], DataFrame], runs: int, warm_ups: int = WARM_UPS) -> list[float]:
    """Seconds of each run into a sink that drops all rows."""
    out = []
    for i in range(warm_ups + runs):
        df = make()
        began = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        if i >= warm_ups:
            out.append(time.perf_counter() - began)
    return out


def run(spark: SparkSession, folder: str, rows: int = 20_000, runs: int = 11) -> list[Observation]:
    paths = {}
    for name, df in benchmark_tables(spark, rows).items():
        paths[name] = f"{folder}/{name}"
        df.write.mode("overwrite").parquet(paths[name])
    out = []
    for experiment, variant, config, sql, of_lineitem in cases():
        engine = Engine(spark, config)
        for name, path in paths.items():
            engine.catalog.parquet(name, path)
        scanned = rows if of_lineitem else max(rows // 4, 20) + max(rows // 20, 10)
        out += [Observation(experiment, variant, i, s, scanned) for i, s in enumerate(timed(lambda e=engine, q=sql: e.query(q).data, runs))]
    return out


def summary(found: list[Observation]) -> list[dict]:
    groups: dict[tuple[str, str], list[Observation]] = defaultdict(list)
    for o in found:
        groups[o.experiment, o.variant].append(o)
    out = []
    for (experiment, variant), own in sorted(groups.items()):
        times = sorted(o.seconds for o in own)
        median = statistics.median(times)
        out.append({"experiment": experiment, "variant": variant, "runs": len(times), "median_ms": median * 1000, "p95_ms": times[max(0, math.ceil(0.95 * len(times)) - 1)] * 1000, "rows_per_second": own[0].rows / median})
    return out


def environment(spark: SparkSession) -> dict:
    """Where a run was made."""
    system = spark._jvm.java.lang.System
    return {
        "spark": spark.version,
        "java": system.getProperty("java.version"),
        "python": platform.python_version(),
        "system": platform.platform(),
        "processor": platform.processor() or platform.machine(),
        "cpus": os.cpu_count(),
        "master": spark.sparkContext.master,
        "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"),
        "adaptive": spark.conf.get("spark.sql.adaptive.enabled"),
    }


def write(found: list[Observation], folder: str, where: dict | None = None) -> None:
    """Raw observations as CSV and JSON, the summary with its chart, and the environment."""
    target = Path(folder)
    target.mkdir(parents=True, exist_ok=True)
    (target / "raw.json").write_text(json.dumps([asdict(o) for o in found], indent=0))
    (target / "environment.json").write_text(json.dumps(where or {}, indent=1))
    with (target / "raw.csv").open("w", newline="") as f:
        rows = csv.DictWriter(f, ["experiment", "variant", "run", "seconds", "rows"])
        rows.writeheader()
        rows.writerows(map(asdict, found))
    made = summary(found)
    (target / "summary.json").write_text(json.dumps(made, indent=1))
    (target / "summary.svg").write_text(chart(made))


def chart(rows: list[dict]) -> str:
    """Bars of the medians."""
    most, high = max((r["median_ms"] for r in rows), default=1.0), 18
    bars = "".join(
        f'<text x="4" y="{i * high + 13}">{r["experiment"]} {r["variant"]}</text><rect x="260" y="{i * high + 2}" width="{420 * r["median_ms"] / most:.1f}" height="14"/><text x="{266 + 420 * r["median_ms"] / most:.1f}" y="{i * high + 13}">{r["median_ms"]:.1f} ms</text>'
        for i, r in enumerate(rows)
    )
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="800" height="{len(rows) * high + 4}" font-size="11" fill="#345">{bars}</svg>'


def compare(before: list[dict], after: list[dict]) -> list[dict]:
    """Cases that both summaries have: speed-up, and latency saved in percent."""
    old = {(r["experiment"], r["variant"]): r["median_ms"] for r in before}
    out = []
    for r in after:
        was = old.get((r["experiment"], r["variant"]))
        if was:
            out.append({"experiment": r["experiment"], "variant": r["variant"], "before_ms": was, "after_ms": r["median_ms"], "speedup": was / r["median_ms"], "saved_percent": 100 * (1 - r["median_ms"] / was)})
    return out
