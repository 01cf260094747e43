"""Every registered query over the star schema against its SQL in DuckDB, and the tools around the engine."""

import json
import math
from pathlib import Path

import duckdb
import pytest

from kestrelq import __main__ as cli
from kestrelq import benchmark, matrix
from kestrelq.sources.generate import benchmark_tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in matrix.STAR:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


def norm(value):
    return ("nan" if math.isnan(value) else round(value, 4)) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(matrix.queries()))
def test_query(spark, oracle, name):
    df = matrix.queries()[name](spark, SF)
    rows = df.collect()
    sql = matrix.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    oracle.execute(sql)
    found, columns = oracle.fetchall(), [d[0] for d in oracle.description]
    assert sorted(columns) == sorted(df.columns)
    order = [columns.index(c) for c in df.columns]
    assert sorted(repr([norm(x) for x in r]) for r in rows) == sorted(repr([norm(r[i]) for i in order]) for r in found)


def test_entry_and_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["segment", "revenue"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_demo_and_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "local_session", lambda: spark)
    assert cli.main(["demo"]) == 0
    shown = capsys.readouterr().out
    assert "| EUROPE  | 9800    |" in shown and shown.index("EUROPE") < shown.index("ASIA ") < shown.index("AMERICA") and "3 row(s)" in shown
    (tmp_path / "t.csv").write_text("a,b\n1,x\n2,y\n")
    assert cli.main(["import", str(tmp_path / "t.csv"), str(tmp_path / "t.col"), "t"]) == 0
    assert cli.main(["query", "--columnar", f"t={tmp_path / 't.col'}", "--csv", f"u={tmp_path / 't.csv'}", "--tuple", "SELECT t.a AS a, u.b AS b FROM t JOIN u ON t.a = u.a WHERE t.a > 1"]) == 0
    assert "| 2 | y |" in capsys.readouterr().out
    assert cli.main(["ast", "SELECT a FROM t"]) == 0 and "Project" in capsys.readouterr().out
    assert cli.main(["query", "--strict", "SELECT DISTINCT a FROM t"]) == 1 and "SyntaxFault" in capsys.readouterr().err


def test_benchmark_and_comparison(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(benchmark, "WARM_UPS", 0)
    found = benchmark.run(spark, str(tmp_path / "d"), 400, 1)
    benchmark.write(found, str(tmp_path / "r"))
    made = json.loads((tmp_path / "r/summary.json").read_text())
    assert {r["experiment"][0] for r in made} == set("ABCDEF") and "<svg" in (tmp_path / "r/summary.svg").read_text()
    assert len((tmp_path / "r/raw.csv").read_text().splitlines()) == len(found) + 1
    assert [r["speedup"] for r in benchmark.compare(made, [*made[:2], {"experiment": "X", "variant": "y", "median_ms": 1}])] == [1, 1]


def test_generator_formulas(spark):
    made = benchmark_tables(spark, 20_000)
    assert {k: v.count() for k, v in made.items()} == {"customer": 1000, "orders": 5000, "lineitem": 20_000}
    assert made["lineitem"].filter("l_quantity < 10").count() == 3600 and made["lineitem"].filter("l_quantity < 25").count() == 9600


def test_nothing_imports_the_llm_subpackage():
    root = Path(cli.__file__).parent
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "kestrelq.llm" not in path.read_text()
