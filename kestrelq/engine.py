"""The engine: registered tables, SQL in, DataFrames out, with plans, traces and profiles."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from kestrelq.catalog import Catalog
from kestrelq.config import EngineConfig, JoinPreference
from kestrelq.errors import translated
from kestrelq.plans import estimate, explain, profile, strict, tree

#: What stands between words, and the words, texts and signs of a statement.
_GAP = r"(?:\s|--[^\n]*(?:\n|$)|/\*.*?\*/)"
_EXPLAIN = re.compile(rf"{_GAP}*EXPLAIN{_GAP}+(PHYSICAL{_GAP}+)?(?=SELECT\b)", re.I | re.S)
_TOKEN = re.compile(rf"{_GAP}|'(?:[^'\\]|\\.|'')*'|\"[^\"]*\"|`[^`]*`|(?P<word>\w+)|.", re.S)


@dataclass
class Result:
    """Rows (`data`), or the text of a plan (`plan`), with the query's trace."""

    data: DataFrame | None
    plan: str | None
    trace: explain.Trace
    estimator: estimate.Estimator

    def profile(self) -> profile.Profile:
        """Runs the query where its data is, no row reaches the driver, and reports its operators."""
        profile.execute(self.data)
        return profile.profile(self.data, self.estimator)


class Engine:
    def __init__(self, spark: SparkSession, config: EngineConfig | None = None):
        self.spark, self.config = spark, config or EngineConfig()
        self.catalog = Catalog(spark)

    def register(self, name: str, df: DataFrame) -> DataFrame:
        return self.catalog.register(name, df)

    def import_csv(self, path: str, name: str) -> DataFrame:
        try:
            return self.catalog.csv(name, path)
        except Exception as e:
            raise translated(e) from e

    def ast(self, sql: str) -> str:
        """The syntax tree as JSON."""
        try:
            return tree.parsed(self.spark, self._plain(sql)[1]).prettyJson()
        except Exception as e:
            raise translated(e, sql) from e

    def sql(self, sql: str) -> DataFrame:
        """The query's rows; errors of names and types are raised here, before anything runs."""
        _, text = self._plain(sql)
        with self._settings(text):
            df = self._analysed(text)
            try:
                if self.config.settings() != EngineConfig(strict=self.config.strict).settings():
                    explain.execution(df).executedPlan()  # planned under these settings, whenever it runs
            except Exception as e:
                raise translated(e, sql) from e
            return df

    def query(self, sql: str) -> Result:
        kind, text = self._plain(sql)
        with self._settings(text):
            df = self._analysed(text)
            try:
                trace = explain.trace(df, tree.parsed(self.spark, text).prettyJson())  # plans under these settings
            except Exception as e:
                raise translated(e, sql) from e
        estimator = self.estimator(df)
        if kind == "":
            return Result(df, None, trace, estimator)
        qe = explain.execution(df)
        return Result(None, estimator.described(qe.executedPlan() if kind == "physical" else qe.optimizedPlan(), kind == "physical"), trace, estimator)

    def estimated_rows(self, df: DataFrame) -> int:
        return self.estimator(df).of(explain.execution(df).analyzed())

    def estimator(self, df: DataFrame) -> estimate.Estimator:
        """Knows the query's tables; their statistics are only gathered when an estimate is asked for."""
        return estimate.Estimator(self._stats, explain.execution(df).analyzed(), self.catalog.table_names())

    def _stats(self, name: str) -> tuple[int, dict]:
        found = self.catalog.stats(name)
        return found.rows, {c.lower(): (s.least, s.greatest, s.distinct) for c, s in found.columns.items()}

    @staticmethod
    def _plain(sql: str) -> tuple[str, str]:
        """Whether a plan is asked for ('', 'logical', 'physical'), and the statement without a semicolon at its end."""
        text = sql.strip().removesuffix(";")
        m = _EXPLAIN.match(text)
        return (("physical" if m[1] else "logical"), text[m.end() :]) if m else ("", text)

    def _analysed(self, text: str) -> DataFrame:
        try:
            plan = tree.parsed(self.spark, text)
            if self.config.strict:
                strict.check_syntax(plan)
            df = self.spark.sql(self._hinted(text, plan))
            if self.config.strict:
                strict.check_types(df._jdf.queryExecution().analyzed())
            return df
        except Exception as e:
            raise translated(e, text) from e

    def _hinted(self, text: str, plan: object) -> str:
        """With a preferred join algorithm, the hint for it on all tables of the query."""
        if self.config.join is JoinPreference.AUTO:
            return text
        names: list[str] = []
        for node in tree.of(plan).walk():
            if node.kind == "SubqueryAlias":
                names.append(node.data["identifier"]["name"])
            elif node.kind == "UnresolvedRelation":
                names.append(tree.names(node.data["multipartIdentifier"])[-1])
        if len(names) < 2:
            return text
        first = next(m for m in _TOKEN.finditer(text) if (m["word"] or "").lower() == "select")
        return f"{text[: first.end()]} /*+ {self.config.join.value}({', '.join(dict.fromkeys(names))}) */{text[first.end() :]}"

    @contextmanager
    def _settings(self, text: str) -> Iterator[None]:
        """The engine's settings for the time in which a query is analysed and planned."""
        conf, before = self.spark.conf, {}
        for key, value in self.config.settings().items():
            before[key] = conf.get(key, None)
            if value:
                conf.set(key, value)
            else:
                conf.unset(key)
        try:
            words = {m["word"].lower() if m["word"] else m[0].strip('`"').lower() for m in _TOKEN.finditer(text)}
            self.catalog.expose(self.config.optimizer.barrier(), words)  # a table that the statement does not name is left alone
            yield
        finally:
            for key, value in before.items():
                if value is None:
                    conf.unset(key)
                else:
                    conf.set(key, value)
