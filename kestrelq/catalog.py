"""Named tables: registration, lookup and exact statistics."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrelq.errors import BindError, StorageError
from kestrelq.session import shared_dir
from kestrelq.sources.colfile import read_colfile, read_header
from kestrelq.sources.csv_source import read_csv


@dataclass(frozen=True)
class ColumnStats:
    least: Any
    greatest: Any
    distinct: int
    nulls: int


@dataclass(frozen=True)
class TableStats:
    rows: int
    columns: dict[str, ColumnStats]


def table_stats(df: DataFrame) -> TableStats:
    """Rows, and for each column of an ordered type least, greatest, distinct and null values; one aggregation."""
    names = [c for c, t in df.dtypes if not t.startswith(("array", "map", "struct"))]
    parts = [F.count(F.lit(1))]
    for c in names:
        x = F.col(f"`{c}`")
        parts += [F.min(x), F.max(x), F.count_distinct(x), F.count_if(x.isNull())]
    row = df.agg(*parts).first()
    return TableStats(row[0], {c: ColumnStats(*row[1 + 4 * i : 5 + 4 * i]) for i, c in enumerate(names)})


class Catalog:
    """Tables by name, whatever its case; registering a name again replaces the table."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: dict[str, DataFrame] = {}
        self.known: dict[str, TableStats] = {}
        self.held: dict[str, DataFrame] = {}

    def register(self, name: str, df: DataFrame) -> DataFrame:
        key = name.lower()
        self.tables[key] = df
        self.known.pop(key, None)
        self.held.pop(key, None)
        df.createOrReplaceTempView(key)
        return df

    def from_rows(self, name: str, schema: str | T.StructType, rows: Iterable[tuple]) -> DataFrame:
        """Integers widen to double columns; any other mismatch, or a row of another length, is an error."""
        kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        made = []
        for row in rows:
            if len(row) != len(kind):
                raise StorageError(f"a row has {len(row)} values, the schema {len(kind)}")
            made.append(tuple(float(v) if isinstance(f.dataType, T.DoubleType) and isinstance(v, int) and not isinstance(v, bool) else v for f, v in zip(kind, row, strict=True)))
        try:
            return self.register(name, self.spark.createDataFrame(made, kind))
        except Exception as e:
            raise StorageError(str(e)) from e

    def parquet(self, name: str, path: str) -> DataFrame:
        return self.register(name, self.spark.read.parquet(path))

    def csv(self, name: str, path: str) -> DataFrame:
        return self.register(name, read_csv(self.spark, path))

    def colfile(self, path: str, name: str | None = None) -> DataFrame:
        return self.register(name or read_header(path)[0], read_colfile(self.spark, path))

    def table(self, name: str) -> DataFrame:
        try:
            return self.tables[name.lower()]
        except KeyError:
            raise BindError(f"unknown table {name}") from None

    def table_names(self) -> list[str]:
        return sorted(self.tables)

    def stats(self, name: str) -> TableStats:
        key = name.lower()
        if key not in self.known:
            self.known[key] = table_stats(self.table(name))
        return self.known[key]

    def size_in_bytes(self, name: str) -> int:
        """Spark's estimate of the table's size."""
        return int(self.table(name)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())

    def column_sizes(self, name: str) -> dict[str, int]:
        """Bytes of each column's values: texts by their length, others by the width of their type; one aggregation."""
        df = self.table(name)
        width = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "float": 4, "date": 4}
        parts = [F.coalesce(F.sum(F.octet_length(F.col(f"`{c}`")) if t in ("string", "binary") else F.when(F.col(f"`{c}`").isNotNull(), width.get(t, 8))), F.lit(0)) for c, t in df.dtypes]
        return dict(zip(df.columns, df.agg(*parts).first(), strict=True))

    def expose(self, barrier: bool, names: set[str]) -> None:
        """Sets the views of these tables to the tables, or to checkpointed copies through which nothing is pushed or pruned."""
        for key, df in self.tables.items():
            if key not in names:
                continue
            if barrier and key not in self.held:
                shared_dir(self.spark)
                self.held[key] = df.checkpoint()
            (self.held[key] if barrier else df).createOrReplaceTempView(key)
