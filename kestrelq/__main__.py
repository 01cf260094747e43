"""Command line: demo, ast, query, import, bench, compare."""

from __future__ import annotations

import argparse
import json
import sys
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame

from kestrelq import benchmark
from kestrelq.config import EngineConfig, ExecutionMode
from kestrelq.engine import Engine, Result
from kestrelq.errors import EngineError
from kestrelq.plans import profile
from kestrelq.session import local_session
from kestrelq.sources.colfile import write_colfile
from kestrelq.sources.csv_source import read_csv
from kestrelq.sources.generate import demo_tables

DEMO = "SELECT c.region AS region, SUM(o.total) AS revenue FROM customers c INNER JOIN orders o ON c.customer_id = o.customer_id WHERE o.total >= 80 GROUP BY c.region ORDER BY revenue DESC LIMIT 3"


def as_table(df: DataFrame) -> str:
    """The rows as text, with a line that counts them; for results that fit a screen."""
    rows = [["NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) for v in r] for r in df.collect()]
    widths = [max([len(c), *(len(r[i]) for r in rows)]) for i, c in enumerate(df.columns)]
    border = "+" + "+".join("-" * (w + 2) for w in widths) + "+"
    line = lambda cells: "|" + "|".join(f" {c:{w}} " for c, w in zip(cells, widths, strict=True)) + "|"
    return "\n".join([border, line(df.columns), border, *map(line, rows), border, f"{len(rows)} row(s)"])


def show(result: Result, traced: bool) -> None:
    if result.data is None:
        print(result.plan)
        return
    if traced:
        t = result.trace
        print(f"AST\n{t.ast}\nLOGICAL PLAN\n{t.logical}\nOPTIMIZED LOGICAL PLAN\n{t.optimized}\nOPTIMIZER ACTIONS\n{json.dumps(t.optimization, indent=1)}\n\nPHYSICAL PLAN\n{t.physical}")
    print(as_table(result.data))
    print(f"\nEXECUTION PROFILE\n{profile.profile(result.data, result.estimator).tree()}")


def _pair(text: str) -> tuple[str, str]:
    name, sign, path = text.partition("=")
    if not sign:
        raise argparse.ArgumentTypeError("a table is given as name=path")
    return name, path


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="kestrelq", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("demo")
    sub.add_parser("ast").add_argument("sql")
    query = sub.add_parser("query")
    for kind in ("csv", "columnar", "parquet"):
        query.add_argument(f"--{kind}", type=_pair, action="append", default=[], metavar="NAME=PATH")
    query.add_argument("--batch-size", type=int, default=4096)
    query.add_argument("--tuple", action="store_true")
    query.add_argument("--strict", action="store_true")
    query.add_argument("--trace", action="store_true")
    query.add_argument("sql")
    imported = sub.add_parser("import")
    for name in ("csv", "out"):
        imported.add_argument(name)
    imported.add_argument("name", nargs="?")
    bench = sub.add_parser("bench")
    bench.add_argument("out")
    bench.add_argument("--rows", type=int, default=20_000)
    bench.add_argument("--runs", type=int, default=11)
    compared = sub.add_parser("compare")
    for name in ("before", "after"):
        compared.add_argument(name)
    args = parser.parse_args(argv)
    if args.command == "compare":
        found = benchmark.compare(*(json.loads(Path(p).read_text()) for p in (args.before, args.after)))
        print(json.dumps(found, indent=1))
        return 0
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    try:
        if args.command == "demo":
            engine = Engine(spark)
            for name, df in demo_tables(spark).items():
                engine.register(name, df)
            show(engine.query(DEMO), True)
        elif args.command == "ast":
            print(Engine(spark).ast(args.sql))
        elif args.command == "import":
            n = write_colfile(read_csv(spark, args.csv), args.out, args.name or Path(args.csv).stem)
            print(f"{n} row(s) written to {args.out}")
        elif args.command == "bench":
            with tempfile.TemporaryDirectory() as folder:
                found = benchmark.run(spark, folder, args.rows, args.runs)
            benchmark.write(found, args.out, benchmark.environment(spark))
            print(json.dumps(benchmark.summary(found), indent=1))
        else:
            engine = Engine(spark, EngineConfig(mode=ExecutionMode.TUPLE if args.tuple else ExecutionMode.VECTORIZED, batch_size=args.batch_size, strict=args.strict))
            for name, path in args.csv:
                engine.import_csv(path, name)
            for name, path in args.columnar:
                engine.catalog.colfile(path, name)
            for name, path in args.parquet:
                engine.catalog.parquet(name, path)
            show(engine.query(args.sql), args.trace)
    except (EngineError, ValueError) as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
