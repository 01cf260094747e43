"""The registered queries over the star-schema tables, and their SQL.

`SHARED` is text that Spark and the oracle both run; where the dialects differ, `OWN` has Spark's text or function and `ORACLE` the other.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrelq import operators as ops
from kestrelq.catalog import table_stats
from kestrelq.config import EngineConfig, JoinPreference
from kestrelq.engine import Engine

STAR = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
Query = Callable[[SparkSession, str], DataFrame]

FLAGSHIP = """SELECT c.c_mktsegment AS segment, SUM(o.o_totalprice) AS revenue
FROM customer c INNER JOIN orders o ON c.c_custkey = o.o_custkey
WHERE o.o_totalprice >= 80000
GROUP BY c.c_mktsegment ORDER BY revenue DESC LIMIT 3"""

NULLS = "(VALUES (CAST(1 AS BIGINT), CAST(10 AS BIGINT)), (2, 5), (NULL, 5)) AS t(a, b)"
JOIN = "SELECT o.o_orderkey AS okey, o.o_totalprice AS price, c.c_name AS name FROM orders o INNER JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_totalprice > 100000"

SHARED: dict[str, str] = {
    "flagship": FLAGSHIP,
    "scan_star": "SELECT * FROM region",
    "project_prune": "SELECT l_orderkey, l_extendedprice FROM lineitem",
    "alias_precedence": "SELECT n.n_name AS name, (n.n_regionkey + 2) * 3 - 1 AS k, 'it''s' AS s, TRUE AS f FROM nation AS n WHERE n.n_regionkey = 0 OR n.n_regionkey = 1 AND n.n_nationkey > 10",
    "wildcard_plus_expr": "SELECT *, r_regionkey + 1 AS k1 FROM region",
    "filter_pushdown": "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_quantity < 10",
    "filter_reversed_literal": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE 25 < l_quantity",
    "filter_and_or_not": "SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE (l_quantity < 5 OR l_discount > CAST(0.05 AS DOUBLE)) AND NOT (l_returnflag = 'A')",
    "filter_string_not_equal": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F'",
    "filter_string_order": "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority >= '3'",
    "filter_boolean_order": "SELECT o_orderkey FROM orders WHERE (o_totalprice > 200000) > FALSE",
    "filter_const_fold": "SELECT o_orderkey FROM orders WHERE 1 + 1 = 2 AND TRUE AND o_totalprice > 250000",
    "filter_null_compare": "SELECT COUNT(*) AS n FROM orders WHERE o_totalprice = NULL",
    "filter_all_comparisons": "SELECT n_nationkey, n_nationkey = 3 AS eq, n_nationkey != 3 AS ne, n_nationkey < 3 AS lt, n_nationkey <= 3 AS le, n_nationkey > 3 AS gt, n_nationkey >= 3 AS ge FROM nation",
    "three_valued_not": f"SELECT a, b FROM {NULLS} WHERE NOT (a > 1)",
    "three_valued_or": f"SELECT a, b FROM {NULLS} WHERE a > b OR b = 5",
    "three_valued_and": f"SELECT b FROM {NULLS} WHERE NOT (a > 5 AND b > 7)",
    "arith_projection": "SELECT l_orderkey, l_linenumber, -l_quantity AS neg, l_extendedprice * (1 - l_discount) AS net, l_orderkey / 4 AS quarter FROM lineitem",
    "int_float_mix": "SELECT l_orderkey, l_linenumber, l_linenumber * 2 + CAST(0.5 AS DOUBLE) AS x FROM lineitem",
    "literals": "SELECT CAST(7 AS BIGINT) AS i, CAST(1.5 AS DOUBLE) AS f, 'x''y' AS s, FALSE AS b, CAST(NULL AS BIGINT) AS n FROM region",
    "join_hash_equi": JOIN,
    "join_theta_range": "SELECT n.n_nationkey AS nkey, r.r_regionkey AS rkey FROM nation n INNER JOIN region r ON n.n_regionkey < r.r_regionkey",
    "join_multi_key": "SELECT l.l_orderkey AS okey, l.l_linenumber AS line, p.p_partkey AS pkey FROM lineitem l INNER JOIN part p ON l.l_partkey = p.p_partkey AND l.l_quantity < p.p_size",
    "join_or_condition": "SELECT a.n_nationkey AS x, b.r_regionkey AS y FROM nation a JOIN region b ON a.n_regionkey = b.r_regionkey OR a.n_nationkey = b.r_regionkey",
    "join_one_side": "SELECT n.n_name AS name, r.r_name AS region FROM nation n JOIN region r ON n.n_nationkey < 3",
    "join_cross_true": "SELECT a.r_name AS x, b.r_name AS y FROM region a JOIN region b ON TRUE",
    "join_null_keys": f"SELECT x.a AS xa, y.b AS yb FROM (SELECT * FROM {NULLS}) x JOIN (SELECT * FROM {NULLS}) y ON x.a = y.a",
    "join_self": "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "join_multiway": "SELECT l.l_orderkey AS okey, l.l_linenumber AS line, c.c_name AS customer, n.n_name AS nation, r.r_name AS region FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey WHERE l.l_quantity > 40",
    "join_mixed_numeric_keys": "SELECT p.k AS size, p.n * l.n AS matches FROM (SELECT p_size AS k, COUNT(*) AS n FROM part GROUP BY p_size) p JOIN (SELECT l_quantity AS k, COUNT(*) AS n FROM lineitem GROUP BY l_quantity) l ON p.k = l.k",
    "agg_group": "SELECT l_returnflag AS flag, l_linestatus AS status, COUNT(*) AS n, ROUND(SUM(l_quantity), 2) AS qty, ROUND(AVG(l_extendedprice), 4) AS price, MIN(l_discount) AS lo, MAX(l_tax) AS hi FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "agg_group_expr": "SELECT l_linenumber + 1 AS k, ROUND(SUM(l_extendedprice * l_discount), 2) AS v FROM lineitem GROUP BY l_linenumber + 1",
    "agg_min_max_string_bool": "SELECT MIN(o_orderstatus) AS lo, MAX(o_orderstatus) AS hi, MIN(o_totalprice > 1000) AS every, MAX(o_totalprice > 300000) AS some FROM orders",
    "agg_null_group": f"SELECT a, COUNT(*) AS n FROM {NULLS} GROUP BY a",
    "agg_count_forms": "SELECT o_orderstatus AS s, COUNT(*) AS n, COUNT(o_orderkey) AS k FROM orders GROUP BY o_orderstatus",
    "agg_over_join": "SELECT n.n_name AS nation, COUNT(*) AS n, ROUND(SUM(o.o_totalprice), 2) AS total FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name",
    "distinct_via_group": "SELECT o_orderstatus FROM orders GROUP BY o_orderstatus",
    "sort_multi": "SELECT o_orderstatus, o_totalprice, o_orderkey FROM orders ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey",
    "sort_output_alias": "SELECT o_orderkey, o_totalprice * 2 AS twice FROM orders ORDER BY twice DESC, o_orderkey",
    "sort_nulls": f"SELECT a, b FROM {NULLS} ORDER BY a NULLS FIRST, b LIMIT 2",
    "topk": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    "limit_zero": "SELECT COUNT(*) AS n FROM (SELECT o_orderkey FROM orders LIMIT 0) t",
    "optimizer_off": JOIN,
    "tuple_mode": "SELECT l_orderkey, l_linenumber, l_extendedprice * 2 AS value FROM lineitem WHERE l_quantity < 25",
}

SHARED_SUMS = "COUNT(*) AS n, COUNT(l_orderkey) AS k, ROUND(SUM(l_quantity), 2) AS qty, ROUND(AVG(l_extendedprice), 4) AS price, MIN(l_shipdate) AS first_ship, MAX(l_linestatus) AS status"
OWN: dict[str, str] = {
    "agg_global": f"SELECT {SHARED_SUMS}, SUM(l_linenumber) AS lines FROM lineitem",
    "agg_global_empty": f"SELECT {SHARED_SUMS}, SUM(l_linenumber) AS lines FROM lineitem WHERE l_quantity < 0",
    "agg_null_skipping": f"SELECT COUNT(a) AS ca, COUNT(*) AS n, SUM(a) AS s, AVG(a) AS m, MIN(a) AS lo, MAX(a) AS hi FROM {NULLS}",
    "agg_sum_int": "SELECT l_returnflag AS f, SUM(l_linenumber) AS s FROM lineitem GROUP BY l_returnflag",
}
ORACLE: dict[str, str] = {k: v.replace("SUM(l_linenumber)", "CAST(SUM(l_linenumber) AS BIGINT)").replace("SUM(a)", "CAST(SUM(a) AS BIGINT)") for k, v in OWN.items()}


def engine(spark: SparkSession, sf_dir: str, config: EngineConfig | None = None, text: str | None = None) -> Engine:
    """With all tables, or with those that a query names: each table's footers cost a job to read."""
    made = Engine(spark, config)
    for name in STAR:
        if text is None or re.search(rf"\b{name}\b", text, re.I):
            made.catalog.parquet(name, f"{sf_dir}/{name}.parquet")
    return made


def _sql(text: str, config: EngineConfig | None = None) -> Query:
    return lambda spark, sf_dir: engine(spark, sf_dir, config, text).sql(text)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact statistics of the orders table, a row a column."""
    found = table_stats(_read(spark, sf_dir, "orders"))
    rows = [(c, found.rows, str(s.least), str(s.greatest), s.distinct, s.nulls) for c, s in found.columns.items() if c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")]
    return spark.createDataFrame(rows, "name string, n bigint, least string, greatest string, distinct_values bigint, nulls bigint")


ESTIMATED = {
    "scan": "SELECT o_orderkey FROM orders",
    "equality": "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'",
    "impossible": "SELECT o_orderkey FROM orders WHERE o_orderkey = -1",
    "range": "SELECT l_orderkey FROM lineitem WHERE l_quantity < 10",
    "unknown": "SELECT l_orderkey FROM lineitem WHERE l_quantity * 2 < 10",
    "groups": "SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY o_orderstatus",
    "join": "SELECT o.o_orderkey AS k FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey",
    "propagated": "SELECT t.s AS s, COUNT(*) AS n FROM (SELECT o.o_orderstatus AS s, c.c_custkey AS k FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey) t GROUP BY t.s",
    "limit": "SELECT o_orderkey FROM orders LIMIT 7",
}


def _estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row estimates from exact statistics."""
    made = engine(spark, sf_dir)
    return spark.createDataFrame([(name, made.estimated_rows(made.sql(text))) for name, text in ESTIMATED.items()], "name string, estimate bigint")


def _dataframe_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship by operators rather than SQL."""
    c = ops.scan(_read(spark, sf_dir, "customer"), "c", ["c_custkey", "c_mktsegment"])
    o = ops.where(ops.scan(_read(spark, sf_dir, "orders"), "o", ["o_custkey", "o_totalprice"]), "o_totalprice >= 80000")
    joined = ops.inner_join(o, c, "o.o_custkey = c.c_custkey")
    return ops.top(ops.aggregate(joined, [F.col("c_mktsegment").alias("segment")], revenue=F.sum("o_totalprice")), 3, ("revenue", False))


def _table(spark: SparkSession, text: str, column: str) -> DataFrame:
    return spark.createDataFrame([(i, line) for i, line in enumerate(text.splitlines())], f"line int, {column} string")


def _explained(prefix: str) -> Query:
    return lambda spark, sf_dir: _table(spark, engine(spark, sf_dir).query(f"{prefix} {FLAGSHIP}").plan, "plan")


def _trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = engine(spark, sf_dir).query(FLAGSHIP).trace
    return spark.createDataFrame(sorted(found.optimization.items()), "rule string, applied bigint")


def _profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = engine(spark, sf_dir).query(FLAGSHIP).profile()
    return spark.createDataFrame([(p.operator, p.rows) for p in found.walk()], "operator string, rows bigint")


def _ast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, engine(spark, sf_dir).ast(FLAGSHIP), "json")


def _own_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the folder that all executors share."""
    import uuid

    from kestrelq.session import shared_dir

    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _own_path(spark, "nation-csv")
    _read(spark, sf_dir, "nation").write.option("header", True).option("escape", '"').csv(path)
    return Engine(spark).import_csv(path, "nation_csv").select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("int").alias("n_regionkey"))


def _colfile_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written from the driver, read by the executors through format("colfile")."""
    from kestrelq.sources.colfile import write_colfile

    path = _own_path(spark, "nation-colfile")
    write_colfile(_read(spark, sf_dir, "nation"), path, "nation")
    engine_ = Engine(spark)
    engine_.catalog.colfile(path, "nation_colfile")
    return engine_.sql("SELECT * FROM nation_colfile").select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("int").alias("n_regionkey"))


def queries() -> dict[str, Query]:
    from kestrelq.config import ExecutionMode, OptimizerOptions

    out = {name: _sql(text) for name, text in (SHARED | OWN).items()}
    out["join_hash"] = _sql(JOIN, EngineConfig(join=JoinPreference.HASH))
    out["join_broadcast"] = _sql(JOIN, EngineConfig(join=JoinPreference.BROADCAST))
    out["join_merge"] = _sql(JOIN, EngineConfig(join=JoinPreference.MERGE))
    out["join_nl"] = _sql(JOIN, EngineConfig(join=JoinPreference.NESTED_LOOP))
    out["optimizer_off"] = _sql(JOIN, EngineConfig(optimizer=OptimizerOptions(False, False, False, False, False)))
    out["tuple_mode"] = _sql(SHARED["tuple_mode"], EngineConfig(mode=ExecutionMode.TUPLE, batch_size=1))
    out["strict_mode"] = _sql(FLAGSHIP, EngineConfig(strict=True))
    out["stats"] = _stats
    out["estimates"] = _estimates
    out["dataframe_flagship"] = _dataframe_join
    out |= {"explain": _explained("EXPLAIN"), "explain_physical": _explained("EXPLAIN PHYSICAL"), "trace": _trace, "profile": _profile, "ast": _ast, "csv_roundtrip": _csv_roundtrip, "colfile_roundtrip": _colfile_roundtrip}
    return out


def oracle_sql() -> dict[str, str]:
    column = "SELECT '{c}' AS name, COUNT(*) AS n, CAST(MIN({c}) AS VARCHAR) AS least, CAST(MAX({c}) AS VARCHAR) AS greatest, COUNT(DISTINCT {c}) AS distinct_values, COUNT(*) - COUNT({c}) AS nulls FROM orders"
    return (
        SHARED
        | ORACLE
        | {name: JOIN for name in ("join_hash", "join_broadcast", "join_merge", "join_nl")}
        | {"strict_mode": FLAGSHIP, "dataframe_flagship": FLAGSHIP, "csv_roundtrip": "SELECT * FROM nation", "colfile_roundtrip": "SELECT * FROM nation"}
        | {
            "estimates": """SELECT 'scan' AS name, COUNT(*) AS estimate FROM orders
UNION ALL SELECT 'equality', CAST(floor(COUNT(*) * (1 / CAST(COUNT(DISTINCT o_orderstatus) AS DOUBLE))) AS BIGINT) FROM orders
UNION ALL SELECT 'impossible', 0
UNION ALL SELECT 'range', CAST(floor(COUNT(*) * ((10 - MIN(l_quantity)) / (MAX(l_quantity) - MIN(l_quantity)))) AS BIGINT) FROM lineitem
UNION ALL SELECT 'unknown', CAST(floor(COUNT(*) * CAST(0.1 AS DOUBLE)) AS BIGINT) FROM lineitem
UNION ALL SELECT 'groups', COUNT(DISTINCT o_orderstatus) FROM orders
UNION ALL SELECT 'join', CAST(floor((SELECT COUNT(*) FROM orders) * (SELECT COUNT(*) FROM customer) / CAST(greatest((SELECT COUNT(DISTINCT o_custkey) FROM orders), (SELECT COUNT(DISTINCT c_custkey) FROM customer)) AS DOUBLE)) AS BIGINT)
UNION ALL SELECT 'propagated', COUNT(DISTINCT o_orderstatus) FROM orders
UNION ALL SELECT 'limit', 7"""
        }
        | {"stats": " UNION ALL ".join(column.format(c=c) for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"))}
    )
