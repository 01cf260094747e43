"""A compact columnar file, as a Spark data source of format "colfile".

Layout, little-endian: the tag; the table's name; number of columns and of rows as unsigned 64-bit integers; then for each column its
name, a type byte, a byte for nullable, and for each row a byte for presence and the value. Strings have their length before them.

The format has no offsets, so one pass that skips values finds where columns begin; then all columns are read in step, each through a
buffer of its own, and go to Spark as record batches. So memory follows the number of columns, not of rows. A file is one partition, a
folder one for each file of it; large data belongs in Parquet. Paths may be URIs of stores that Arrow knows.
"""

from __future__ import annotations

import shutil
import struct
import tempfile
from collections.abc import Iterator
from contextlib import ExitStack
from dataclasses import dataclass
from typing import Any, BinaryIO

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType, LocalFileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from kestrelq.errors import StorageError
from kestrelq.session import ship

#: The format's tag and type bytes.
TAG = b"LAM1"
TYPES = {1: T.LongType(), 2: T.DoubleType(), 3: T.StringType(), 4: T.BooleanType()}
CODES = {"bigint": 1, "double": 2, "string": 3, "boolean": 4}
_WIDER = {"tinyint": "bigint", "smallint": "bigint", "int": "bigint", "float": "double"}
_PACK = {1: struct.Struct("<q"), 2: struct.Struct("<d"), 4: struct.Struct("<B")}
_SIZE = struct.Struct("<Q")


BATCH, BUFFER = 4096, 1 << 16


def _opened(path: str, mode: str) -> BinaryIO:
    scheme, _, rest = path.partition(":")
    if "/" in scheme or not rest or scheme == "file":
        local = "/" + rest.lstrip("/") if scheme == "file" else path
        return open(local, mode, buffering=BUFFER)
    system, inner = FileSystem.from_uri(path)
    return system.open_input_file(inner) if mode == "rb" else system.open_output_stream(inner)


def files(path: str) -> list[str]:
    """The file, or those of a folder in the order of their names."""
    scheme, _, rest = path.partition(":")
    system, inner = (LocalFileSystem(), "/" + rest.lstrip("/") if scheme == "file" else path) if "/" in scheme or not rest or scheme == "file" else FileSystem.from_uri(path)
    if system.get_file_info(inner).type != FileType.Directory:
        return [path]
    found = sorted(x.base_name for x in system.get_file_info(FileSelector(inner)) if x.type == FileType.File and not x.base_name.startswith((".", "_")))
    return [f"{path.rstrip('/')}/{n}" for n in found]


def _write_text(out: BinaryIO, text: str) -> None:
    data = text.encode()
    out.write(_SIZE.pack(len(data)) + data)


def _take(source: BinaryIO, n: int) -> bytes:
    data = source.read(n)
    if len(data) != n:
        raise StorageError("the file ends early")
    return data


def _read_text(source: BinaryIO) -> str:
    return _take(source, _SIZE.unpack(_take(source, 8))[0]).decode()


def write_colfile(df: DataFrame, path: str, name: str) -> int:
    """Writes one file from the driver. Rows come one partition at a time; each column is spooled to a file until all have come."""
    plain = df.select(*(df[c].cast(_WIDER.get(t, t)).alias(c) for c, t in df.dtypes))
    for c, t in plain.dtypes:
        if t not in CODES:
            raise StorageError(f"column {c} of type {t} can't be stored")
    codes, n = [CODES[t] for _, t in plain.dtypes], 0
    with ExitStack() as stack:
        spools = [stack.enter_context(tempfile.TemporaryFile(buffering=BUFFER)) for _ in codes]
        for row in plain.toLocalIterator():
            n += 1
            for spool, code, value in zip(spools, codes, row, strict=True):
                spool.write(b"\0" if value is None else b"\1")
                if value is None:
                    continue
                if code == 3:
                    _write_text(spool, value)
                else:
                    spool.write(_PACK[code].pack(value))
        out = stack.enter_context(_opened(path, "wb"))
        out.write(TAG)
        _write_text(out, name)
        out.write(_SIZE.pack(len(codes)) + _SIZE.pack(n))
        for field, code, spool in zip(plain.schema, codes, spools, strict=True):
            _write_text(out, field.name)
            out.write(bytes([code, field.nullable]))
            spool.seek(0)
            shutil.copyfileobj(spool, out, BUFFER)
    return n


@dataclass
class Layout:
    """What a file holds and where each column's values begin."""

    name: str
    rows: int
    schema: T.StructType
    begins: list[int]


def _head(source: BinaryIO, path: str) -> tuple[str, int, int]:
    if source.read(4) != TAG:
        raise StorageError(f"{path} is no columnar file of this format")
    return _read_text(source), *(_SIZE.unpack(_take(source, 8))[0] for _ in range(2))


def read_layout(path: str) -> Layout:
    """One pass over the file, in which values are skipped."""
    with _opened(path, "rb") as source:
        name, columns, rows = _head(source, path)
        fields, begins = [], []
        for _ in range(columns):
            column = _read_text(source)
            code, nullable = _take(source, 2)
            if code not in TYPES:
                raise StorageError(f"unknown type byte {code}")
            fields.append(T.StructField(column, TYPES[code], bool(nullable)))
            begins.append(source.tell())
            for _ in range(rows):
                if _take(source, 1) != b"\0":
                    _take(source, _SIZE.unpack(_take(source, 8))[0] if code == 3 else _PACK[code].size)
    return Layout(name, rows, T.StructType(fields), begins)


def _values(source: BinaryIO, code: int, n: int) -> list[Any]:
    out: list[Any] = []
    for _ in range(n):
        if _take(source, 1) == b"\0":
            out.append(None)
        elif code == 3:
            out.append(_read_text(source))
        else:
            value = _PACK[code].unpack(_take(source, _PACK[code].size))[0]
            out.append(bool(value) if code == 4 else value)
    return out


def batches(path: str, rows: int = BATCH) -> Iterator[pa.RecordBatch]:
    """A file's rows, so many at a time."""
    layout = read_layout(path)
    kinds = {1: pa.int64(), 2: pa.float64(), 3: pa.string(), 4: pa.bool_()}
    codes = [CODES[f.dataType.simpleString()] for f in layout.schema]
    with ExitStack() as stack:
        sources = [stack.enter_context(_opened(path, "rb")) for _ in codes]
        for source, begin in zip(sources, layout.begins, strict=True):
            source.seek(begin)
        for at in range(0, layout.rows, rows):
            n = min(rows, layout.rows - at)
            yield pa.RecordBatch.from_arrays([pa.array(_values(s, c, n), kinds[c]) for s, c in zip(sources, codes, strict=True)], layout.schema.names)


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in files(self.path)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        yield from batches(partition.value)


class ColfileSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "colfile"

    def schema(self) -> T.StructType:
        return read_layout(files(self.options["path"])[0]).schema

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options["path"])


def read_colfile(spark: SparkSession, path: str) -> DataFrame:
    """The path must be one that all executors reach."""
    found = files(path)
    for p in found[1:]:
        read_header(p)
    schema = read_layout(found[0]).schema
    ship(spark)
    spark.dataSource.register(ColfileSource)
    return spark.read.format("colfile").schema(schema).load(path)


def read_header(path: str) -> tuple[str, int, int]:
    """Name, columns and rows, without reading values."""
    with _opened(files(path)[0], "rb") as source:
        return _head(source, path)
