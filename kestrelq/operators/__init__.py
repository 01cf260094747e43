"""The relational operators as functions of DataFrames; Catalyst and adaptive execution choose how they run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrelq.config import JoinPreference

_HINTS = {JoinPreference.HASH: "shuffle_hash", JoinPreference.BROADCAST: "broadcast", JoinPreference.MERGE: "merge", JoinPreference.NESTED_LOOP: "shuffle_replicate_nl"}


def scan(df: DataFrame, alias: str, columns: Sequence[str] | None = None) -> DataFrame:
    return (df.select(*columns) if columns else df).alias(alias)


def where(df: DataFrame, predicate: Column | str) -> DataFrame:
    """Rows for which the predicate is true, neither false nor null."""
    return df.filter(predicate)


def project(df: DataFrame, **columns: Column | str) -> DataFrame:
    """Named columns, each a column, or SQL text."""
    return df.select(*((F.expr(c) if isinstance(c, str) else c).alias(name) for name, c in columns.items()))


def inner_join(left: DataFrame, right: DataFrame, on: Column | str | None = None, preference: JoinPreference = JoinPreference.AUTO) -> DataFrame:
    """Any boolean condition; none is the cross product. A preference is a hint on the right side, which Spark builds from."""
    hint = _HINTS.get(preference)
    other = right.hint(hint) if hint else right
    if on is None:
        return left.crossJoin(other)
    return left.join(other, F.expr(on) if isinstance(on, str) else on, "inner")


def aggregate(df: DataFrame, by: Sequence[Column | str], **columns: Column) -> DataFrame:
    """Grouped, or with no keys one row even of no input; without columns the distinct keys."""
    named = [c.alias(n) for n, c in columns.items()]
    if not named:
        return df.select(*by).distinct()
    return df.groupBy(*by).agg(*named) if by else df.agg(*named)


def sort(df: DataFrame, *keys: tuple[str, bool]) -> DataFrame:
    """Keys with whether they ascend; nulls come first when ascending, last when descending."""
    return df.orderBy(*(F.col(k).asc_nulls_first() if up else F.col(k).desc_nulls_last() for k, up in keys))


def limit(df: DataFrame, n: int) -> DataFrame:
    if n < 0:
        raise ValueError("a limit is not negative")
    return df.limit(n)


def top(df: DataFrame, n: int, *keys: tuple[str, bool]) -> DataFrame:
    """Sort and limit; Spark keeps n rows a task and never sorts all."""
    return limit(sort(df, *keys), n)
