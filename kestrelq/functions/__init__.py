"""Typed literals and the five aggregates, for queries built with DataFrames."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def int64(value: int | None) -> Column:
    return F.lit(value).cast("bigint")


def float64(value: float | None) -> Column:
    return F.lit(value).cast("double")


def utf8(value: str | None) -> Column:
    return F.lit(value).cast("string")


def boolean(value: bool | None) -> Column:
    return F.lit(value).cast("boolean")


def count_all() -> Column:
    return F.count(F.lit(1))


count, total, average, least, greatest = F.count, F.sum, F.avg, F.min, F.max
