"""CSV with whole-file type inference.

A record is a line. A quote switches quoting on or off wherever it stands in a field, two within quotes are one quote, and commas within
quotes belong to the field; nothing is trimmed; a record whose quotes do not end is an error. Spark's reader splits files into lines and
skips each file's header, regular expressions split lines into fields.

All columns are read as text once and one aggregation counts, for each, how many values read as each type; the narrowest type that holds
all of them is taken (bigint, double, boolean, string), whatever their order. Blank values are null and decide nothing; a column of
blanks is string. A record with another number of values than the header is an error, whichever columns are selected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrelq.errors import StorageError

INTEGER = r"^[+-]?[0-9]+$"
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
NO_NUMBER = r"(?i)^[+-]?(nan|inf|infinity)$"
TRUTH = r"(?i)^(true|false)$"
_BAD, _LINE, _FIELDS = "_bad_record", "_line", "_fields"
#: A field behind its comma, and a quoted part of one.
FIELD = r',((?:[^",]++|"(?:[^"]++|"")*+")*+)'
QUOTED = r'"((?:[^"]++|"")*+)"'
#: No file has it, so that a whole line is one column.
NO_SEPARATOR = "\u0001\u0002\u0001"


def fields(line: Column) -> Column:
    """The fields of a record whose quotes end."""
    found = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(FIELD), F.lit(1))
    return F.transform(found, lambda x: F.when(x.contains('"'), F.replace(F.regexp_replace(x, QUOTED, "$1"), F.lit('""'), F.lit('"'))).otherwise(x))


def ends(line: Column) -> Column:
    """Whether its quotes end: their number is even."""
    return (F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))) % 2 == 0


def _text(spark: SparkSession, path: str) -> DataFrame:
    options = {"header": True, "sep": NO_SEPARATOR, "quote": "", "escape": "", "inferSchema": False, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    lines = spark.read.options(**options).csv(path)
    if not lines.columns:
        raise StorageError(f"{path} has no header")
    header = lines.columns[0]
    if header.count('"') % 2:
        raise StorageError("the header's quotes do not end")
    names = spark.range(1).select(fields(F.lit(header))).first()[0]
    if len(names) != len({n.lower() for n in names}):
        raise StorageError("the header has a name twice")
    kept = spark.read.options(**options, enforceSchema=True).schema(T.StructType([T.StructField(_LINE, T.StringType())])).csv(path)
    split = kept.select(_LINE, fields(F.col(_LINE)).alias(_FIELDS))
    bad = F.when(~ends(F.col(_LINE)) | (F.size(_FIELDS) != len(names)), F.col(_LINE))
    return split.select(*(F.nullif(F.get(_FIELDS, F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)), bad.alias(_BAD))


def _kinds(column: str) -> list:
    x = F.col(f"`{column}`")
    whole = x.rlike(INTEGER) & F.expr(f"try_cast(`{column}` AS BIGINT) IS NOT NULL")
    number = x.rlike(INTEGER) | x.rlike(NUMBER) | x.rlike(NO_NUMBER)
    return [F.count(x), F.count_if(whole), F.count_if(number), F.count_if(x.rlike(TRUTH))]


def infer(raw: DataFrame, columns: list[str]) -> dict[str, str]:
    """Column to type, from one pass over all records."""
    counts = raw.agg(F.count_if(F.col(_BAD).isNotNull()), *(k for c in columns for k in _kinds(c))).first()
    if counts[0]:
        raise StorageError(f"{counts[0]} records have another number of values than the header, or quotes that do not end")
    out = {}
    for i, c in enumerate(columns):
        n, whole, number, truth = counts[1 + 4 * i : 5 + 4 * i]
        out[c] = "string" if not n else "bigint" if whole == n else "double" if number == n else "boolean" if truth == n else "string"
    return out


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    raw = _text(spark, path)
    columns = [c for c in raw.columns if c != _BAD]
    kinds = infer(raw, columns)
    return raw.select(*(F.col(f"`{c}`").cast(kinds[c]).alias(c) for c in columns))
