"""SQL through the engine: results, failures, strict dialect, settings, plans and profiles."""

import random

import pytest

from kestrelq import operators as ops
from kestrelq.config import EngineConfig, ExecutionMode, JoinPreference, OptimizerOptions
from kestrelq.engine import Engine
from kestrelq.errors import BindError, EngineError, ExecutionError, SyntaxFault


@pytest.fixture
def engine(spark):
    e = Engine(spark)
    e.catalog.from_rows("sales", "region string, amount bigint", [("EU", 10), ("US", 5), ("EU", 20)])
    e.catalog.from_rows("left_t", "id bigint, value bigint", [(1, 10), (2, 20), (2, 21)])
    e.catalog.from_rows("right_t", "id bigint, value bigint", [(2, 200), (3, 300)])
    e.catalog.from_rows("nulls", "a bigint, b bigint", [(1, 10), (2, 5), (None, 5)])
    e.catalog.from_rows("integers", "id bigint", [(0,), (2,)])
    e.catalog.from_rows("floats", "id double", [(-0.0,), (2,)])
    e.catalog.from_rows("empty", "a bigint", [])
    return e


def strict(engine):
    engine.config = EngineConfig(strict=True)
    return engine


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize(
    "sql, expected",
    [
        ("SELECT amount FROM sales WHERE amount > 5 ORDER BY amount DESC LIMIT 1", [(20,)]),
        ("select region, sum(amount) as total from SALES group by region order by total desc;", [("EU", 30), ("US", 5)]),
        ("SELECT amount FROM sales WHERE 15 < amount", [(20,)]),
        ("SELECT amount FROM sales WHERE amount = NULL", []),
        ("SELECT l.value AS left_value, r.value AS right_value FROM left_t l INNER JOIN right_t r ON l.id = r.id ORDER BY left_value", [(20, 200), (21, 200)]),
        ("SELECT i.id AS id FROM integers i JOIN floats f ON i.id = f.id ORDER BY id", [(0,), (2,)]),
        ("SELECT a FROM nulls WHERE NOT (a > 1)", [(1,)]),
        ("SELECT b FROM nulls WHERE a > b OR b = 5 ORDER BY b", [(5,), (5,)]),
        ("SELECT a, COUNT(*) AS n FROM nulls GROUP BY a ORDER BY n, a LIMIT 1", [(None, 1)]),
        ("SELECT COUNT(a) AS c, COUNT(*) AS n, SUM(a) AS s, AVG(a) AS m, MIN(a) AS lo, MAX(a) AS hi FROM nulls", [(2, 3, 3, 1.5, 1, 2)]),
        ("SELECT COUNT(*) AS n, SUM(a) AS s FROM empty", [(0, None)]),
        ("SELECT 2 + 3 * 4 - 1 AS x, 7 / 2 AS y, -(3) AS z, 'it''s' AS s FROM sales LIMIT 1", [(13, 3.5, -3, "it's")]),
        ("SELECT region FROM sales GROUP BY region ORDER BY region", [("EU",), ("US",)]),
    ],
)
@pytest.mark.parametrize("mode", [False, True])
def test_results(engine, sql, expected, mode):
    engine.config = EngineConfig(strict=mode)
    assert rows(engine.sql(sql)) == expected


@pytest.mark.parametrize(
    "sql, kind",
    [
        ("SELECT a FROM nowhere", BindError),
        ("SELECT nothing FROM sales", BindError),
        ("SELECT region + 1 AS x FROM sales", BindError),
        ("SELECT amount FROM sales WHERE region > 1", BindError),
        ("SELECT SUM(region) AS s FROM sales", BindError),
        ("SELECT region, SUM(amount) AS s FROM sales GROUP BY amount", BindError),
        ("SELECT id FROM left_t l JOIN right_t r ON l.id = r.id", BindError),
        ("SELECT amount FROM sales WHERE amount", BindError),
        ("SELECT l.id AS i FROM left_t l JOIN right_t l ON TRUE", BindError),
        ("SELECT SUM(amount) + 1 AS x FROM sales", BindError),
        ("SELECT SUM(COUNT(amount)) AS x FROM sales", BindError),
        ("SELECT * FROM sales GROUP BY region", BindError),
        ("SELECT SUM(*) AS s FROM sales", EngineError),
        ("SELECT NULL AS x FROM sales", BindError),
        ("INSERT INTO sales VALUES (1)", EngineError),
        ("SELECT amount FROM sales LIMIT 1.5", EngineError),
        ("SELECT amount FROM sales LIMIT -1", EngineError),
        ("SELECT 'open FROM sales", EngineError),
        ("SELECT DISTINCT region FROM sales", SyntaxFault),
        ("SELECT l.id AS i FROM left_t l LEFT JOIN right_t r ON l.id = r.id", SyntaxFault),
        ("SELECT x FROM (SELECT amount AS x FROM sales) t", SyntaxFault),
        ("SELECT UPPER(region) AS u FROM sales", SyntaxFault),
        ("SELECT amount FROM sales UNION ALL SELECT 1", SyntaxFault),
        ("SELECT COUNT(DISTINCT region) AS n FROM sales", SyntaxFault),
        ("WITH t AS (SELECT 1) SELECT * FROM t", SyntaxFault),
        ("SELECT amount FROM sales WHERE region LIKE 'E%'", SyntaxFault),
        ("SELECT 1 AS x", SyntaxFault),
    ],
)
def test_strict_failures(engine, sql, kind):
    with pytest.raises(kind):
        strict(engine).sql(sql)


def test_run_time_errors(engine):
    for sql in ("SELECT 10 / (amount - amount) AS x FROM sales", "SELECT amount FROM sales WHERE 10 / (amount - 5) > 1"):
        with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
            engine.sql(sql).collect()
    engine.catalog.from_rows("big", "a bigint", [(9223372036854775807,)])
    with pytest.raises(Exception, match="ARITHMETIC_OVERFLOW"):
        engine.sql("SELECT a + 1 AS x FROM big").collect()


def test_syntax_errors_have_positions(engine):
    with pytest.raises(SyntaxFault) as e:
        engine.sql("SELECT (amount FROM sales")
    assert e.value.position is not None


def test_ordinals_are_constants_in_the_strict_dialect(engine):
    assert len(rows(strict(engine).sql("SELECT region, amount FROM sales ORDER BY 1"))) == 3
    with pytest.raises(BindError):
        engine.sql("SELECT region AS r FROM sales GROUP BY 1")


@pytest.mark.parametrize("preference", list(JoinPreference))
def test_join_algorithms_agree(engine, preference):
    engine.config = EngineConfig(join=preference)
    found = engine.query("SELECT l.value AS lv, r.value AS rv FROM left_t l JOIN right_t r ON l.id = r.id ORDER BY lv")
    assert rows(found.data) == [(20, 200), (21, 200)]
    wanted = {JoinPreference.HASH: "ShuffledHashJoin", JoinPreference.BROADCAST: "BroadcastHashJoin", JoinPreference.MERGE: "SortMergeJoin", JoinPreference.NESTED_LOOP: "CartesianProduct"}
    assert wanted.get(preference, "Join") in found.trace.physical


@pytest.mark.parametrize("off", range(6))
@pytest.mark.parametrize("mode", list(ExecutionMode))
def test_settings_change_no_result(engine, off, mode):
    engine.config = EngineConfig(optimizer=OptimizerOptions(*(i != off for i in range(5))), mode=mode, batch_size=3)
    assert rows(engine.query("SELECT s.region AS region, SUM(s.amount * 2) AS total FROM sales s JOIN left_t l ON s.amount = l.value WHERE 1 + 1 = 2 AND s.amount > 5 GROUP BY s.region ORDER BY region").data) == [("EU", 60)]
    assert engine.spark.conf.get("spark.sql.codegen.wholeStage", "true") == "true"


def test_batches_have_rows():
    with pytest.raises(ValueError):
        EngineConfig(batch_size=0)


@pytest.fixture
def on_disk(engine, tmp_path):
    engine.spark.range(100).selectExpr("id AS a", "id % 4 AS k", "CAST(id AS STRING) AS c").coalesce(1).write.parquet(str(tmp_path / "t"))
    engine.catalog.parquet("t", str(tmp_path / "t"))
    engine.catalog.parquet("u", str(tmp_path / "t"))
    return engine


def test_explain_of_each_operator(on_disk):
    sql = "SELECT x.k AS k, COUNT(*) AS n FROM t x JOIN u y ON x.a = y.a WHERE x.a >= 50 GROUP BY x.k ORDER BY n DESC LIMIT 2"
    lines = on_disk.query("EXPLAIN " + sql).plan.splitlines()
    assert lines == [
        "GlobalLimit 2  -- estimated 2",
        "  LocalLimit 2  -- estimated 2",
        "    Sort [n DESC NULLS LAST], true  -- estimated 4",
        "      Aggregate [k], [k, count(1) AS n]  -- estimated 4",
        "        Project [k]  -- estimated 24",
        "          Join Inner, (a = a)  -- estimated 24",
        "            Project [a, k]  -- estimated 49",
        "              Filter (isnotnull(a) AND (a >= 50))  -- estimated 49",
        "                LogicalRelation t AS x  -- 100 rows, reads 2 of 3 columns, 1 filters pushed, estimated 100",
        "            Project [a]  -- estimated 49",
        "              Filter ((a >= 50) AND isnotnull(a))  -- estimated 49",
        "                LogicalRelation u AS y  -- 100 rows, reads 1 of 3 columns, 1 filters pushed, estimated 100",
    ]
    physical = on_disk.query("EXPLAIN PHYSICAL " + sql).plan
    assert physical.count("reads 2 of 3 columns, 1 filters pushed") == 1 and "TakeOrderedAndProject" in physical and "HashAggregate" in physical


def test_profile_of_each_operator(on_disk):
    found = on_disk.query("SELECT k, COUNT(*) AS n FROM t WHERE a >= 50 GROUP BY k").profile()
    by = {p.operator.split()[0]: p for p in found.walk()}
    assert found.rows == 4 and found.estimated == 4
    assert by["Filter"].rows == 50 and by["Filter"].estimated == 49 and by["Filter"].rows_in == 100
    assert by["Scan"].bytes > 0 and found.inclusive >= by["Scan"].inclusive > 0
    assert "out 4" in found.tree() and "(100 %)" in found.tree().splitlines()[0]


def test_profiles_fetch_no_rows(on_disk):
    result = on_disk.query("SELECT a FROM t")
    result.data.collect = None  # not called
    assert result.profile().rows == 100


def test_explain_and_hints_know_comments_and_texts(engine):
    found = engine.query("-- first\n/* then */ EXPLAIN -- and\n SELECT 'a--b; /* c' AS s FROM sales").plan
    assert "a--b; /* c" in found and "3 rows" in found
    assert rows(engine.sql("-- EXPLAIN SELECT\nSELECT 'x -- y' AS s FROM empty")) == []
    engine.config = EngineConfig(join=JoinPreference.MERGE)
    physical = engine.query("-- select rows\n/* select */ SELECT l.value AS select_value FROM left_t l JOIN right_t r ON l.id = r.id").trace.physical
    assert "SortMergeJoin" in physical


def test_rules_off_hold_only_the_tables_of_a_query(engine):
    engine.config = EngineConfig(optimizer=OptimizerOptions(predicate_pushdown=False))
    engine.sql("SELECT amount FROM Sales").collect()
    assert set(engine.catalog.held) == {"sales"}


def test_trace_and_report(engine):
    sql = "SELECT amount FROM sales WHERE 1 + 1 = 2 AND amount > 5"
    assert "Scan" in engine.query("-- c\nEXPLAIN PHYSICAL " + sql).plan
    found = engine.query(sql)
    assert found.trace.optimization["constants_folded"] >= 1 and "Filter" in found.trace.logical and '"class"' in found.trace.ast
    profile = found.profile()
    assert any(p.rows == 2 for p in profile.walk()) and "out 2" in profile.tree()


def test_pushdown_and_pruning_reach_the_scan(engine, tmp_path):
    engine.spark.range(1000).selectExpr("id AS a", "id * 2 AS b", "CAST(id AS STRING) AS c").write.parquet(str(tmp_path / "t"))
    engine.catalog.parquet("t", str(tmp_path / "t"))
    on = engine.query("SELECT b FROM t WHERE a < 10").trace.physical
    assert "ReadSchema: struct<a:bigint,b:bigint>" in on and "LessThan(a,10)" in on
    engine.config = EngineConfig(optimizer=OptimizerOptions(predicate_pushdown=False))
    off = engine.query("SELECT b FROM t WHERE a < 10")
    assert "ReadSchema" not in off.trace.physical and off.data.count() == 10


def estimated(engine, sql):
    return engine.estimated_rows(engine.sql(sql))


def test_estimates(engine):
    engine.register("numbers", engine.spark.range(100).selectExpr("id AS value", "id % 4 AS k"))
    assert estimated(engine, "SELECT value FROM numbers WHERE value >= 50") == 49
    assert estimated(engine, "SELECT value FROM numbers WHERE value = 999") == 0
    assert estimated(engine, "SELECT value FROM numbers WHERE k = 1") == 25
    assert estimated(engine, "SELECT value FROM numbers WHERE k <> 1") == 75
    assert estimated(engine, "SELECT value FROM numbers WHERE value * 2 > 1") == 10
    assert estimated(engine, "SELECT k, COUNT(*) AS n FROM numbers GROUP BY k") == 4
    assert estimated(engine, "SELECT COUNT(*) AS n FROM numbers") == 1
    assert estimated(engine, "SELECT a.value AS v FROM numbers a JOIN numbers b ON a.k = b.k") == 2500
    # distinct values pass joins and projections
    assert estimated(engine, "SELECT a.k AS k, COUNT(*) AS n FROM numbers a JOIN numbers b ON a.value = b.value GROUP BY a.k") == 4
    assert estimated(engine, "SELECT t.g AS g, COUNT(*) AS n FROM (SELECT a.k AS g, a.value AS v FROM numbers a) t GROUP BY t.g") == 4
    assert estimated(engine, "SELECT t.g AS g FROM (SELECT a.k AS g, a.value AS v FROM numbers a) t WHERE t.g = 1") == 25
    assert estimated(engine, "SELECT a.value AS v FROM numbers a JOIN numbers b ON a.value = b.value WHERE a.value >= 50 LIMIT 7") == 7


def test_random_vectors(engine):
    rng = random.Random(3)
    for _ in range(3):
        values = [rng.randint(-1000, 999) for _ in range(rng.randint(0, 99))]
        engine.catalog.from_rows("numbers", "x bigint", [(v,) for v in values])
        want = sorted(v * 3 for v in values if v >= 0)
        for config in (EngineConfig(), EngineConfig(mode=ExecutionMode.TUPLE)):
            engine.config = config
            assert [r[0] for r in rows(engine.query("SELECT x * 3 AS y FROM numbers WHERE x >= 0 ORDER BY y").data)] == want


def test_operators(engine):
    s = ops.scan(engine.catalog.table("sales"), "s")
    assert rows(ops.top(ops.project(ops.where(s, "amount > 5"), a="amount", r="region"), 1, ("a", False))) == [(20, "EU")]
    assert sorted(rows(ops.aggregate(s, ["region"]))) == [("EU",), ("US",)]
    t = ops.scan(engine.catalog.table("nulls"), "t")
    assert ops.inner_join(s, t).count() == 9 and ops.inner_join(t, t.alias("u"), "t.a = u.a", JoinPreference.MERGE).count() == 2
    assert [r[0] for r in rows(ops.sort(t, ("a", True)).select("a"))] == [None, 1, 2]
    with pytest.raises(ValueError):
        ops.limit(s, -1)


def test_streams(engine, tmp_path):
    from kestrelq.streaming import on_batches

    engine.catalog.table("sales").write.parquet(str(tmp_path / "in"))
    stream = engine.spark.readStream.schema("region string, amount bigint").parquet(str(tmp_path / "in"))
    seen = []
    query = on_batches(engine, "live", stream, "SELECT region, SUM(amount) AS t FROM live GROUP BY region ORDER BY region", lambda df, n: seen.extend(rows(df)), str(tmp_path / "cp"))
    query.processAllAvailable()
    query.stop()
    assert seen == [("EU", 30), ("US", 5)]


def test_errors_are_translated(engine):
    with pytest.raises(EngineError):
        engine.import_csv("/nowhere/at/all.csv", "x")
    assert issubclass(ExecutionError, EngineError)
