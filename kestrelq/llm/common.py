"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kestrelq.session import shared_dir, ship

#: Rows of text are worked on in slices of about so many characters, so that a worker's memory does not follow the batch.
SLICE_CHARS = 2_000_000


#: Rows and bytes of a record batch where the session has Spark's defaults: batches of whole texts are large, and the JVM holds them outside its heap.
BATCH_SETTINGS = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "4194304b")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    for setting, (default, own) in BATCH_SETTINGS.items():
        if spark.conf.get(setting) == default:
            spark.conf.set(setting, own)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterable[pa.RecordBatch], text: str, chars: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that each holds about `chars` bytes of the text column, one row at least."""
    for batch in batches:
        n = batch.num_rows
        if batch.nbytes <= chars or n <= 1:
            if n:
                yield batch
            continue
        sizes = pc.binary_length(batch.column(batch.schema.get_field_index(text))).fill_null(0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i in range(n):
            total += int(sizes[i])
            if total >= chars:
                yield batch.slice(start, i + 1 - start)
                start, total = i + 1, 0
        if start < n:
            yield batch.slice(start)


class WordHashes:
    """64-bit hashes of words, kept in a bounded cache."""

    def __init__(self, most: int = 100_000):
        self.most, self.cache = most, {}

    def of(self, words: list[bytes]) -> np.ndarray:
        from xxhash import xxh64_intdigest

        if len(self.cache) > self.most:
            self.cache.clear()
        for w in set(words).difference(self.cache):
            self.cache[w] = xxh64_intdigest(w, 7)
        return np.fromiter(map(self.cache.__getitem__, words), np.uint64, len(words))


def factors(window: int, n: int) -> np.ndarray:
    """Odd factors of n independent multilinear hashes of so many words."""
    return np.random.default_rng(20).integers(0, 1 << 63, (n, window), np.uint64) * np.uint64(2) + np.uint64(1)


def trimmed(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow whose worker gives freed memory back when a task ends: workers wait idle, and others start beside them."""

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return whole


def trim() -> None:
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


class Workspace:
    """A folder of its own in the shared folder, for tables that cut lineage; everything in it survives a lost executor."""

    def __init__(self, spark: SparkSession, name: str = "", path: str = ""):
        """A new folder, or the one that the path names."""
        self.spark, self.path = spark, path or f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> str:
        path = f"{self.path}/{name}"
        writer = df.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
        return path

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Writes and reads again, with the schema given so that an empty table needs no inference."""
        schema = df.schema
        return self.spark.read.schema(schema).parquet(self.write(df, name))

    def _on_disk(self, name: str):
        """A path and its file system, Hadoop's."""
        target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return target, target.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        target, system = self._on_disk(name)
        return system.exists(target)

    def drop(self, name: str = "") -> None:
        """Deletes one table, or the whole folder."""
        target, system = self._on_disk(name)
        system.delete(target, True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of finished jobs: it acts when the driver's garbage is collected, first Python's, then the JVM's."""
    import gc
    import time

    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def train_fold(df: DataFrame, modulus: int, held: int) -> DataFrame:
    """Adds held_out: whether crc32 of doc_id as text leaves the remainder `held`."""
    return df.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == held, F.lit(False)))


def small_hash_sample(rows: DataFrame, by: str, of: list[str], size: int) -> DataFrame:
    """Of different rows: for each value of `by` those `size` with the smallest hashes of the columns `of`.

    The window that ranks them meets about three times as many rows for a value as it keeps: the hash of the others is above a bound that
    follows their number. Below ten times the size all rows meet it.
    """
    own = rows.withColumn("__hash", F.xxhash64(*of))
    counts = rows.groupBy(by).agg(F.count("*").alias("__n")).withColumnRenamed(by, "__by")
    near = own.join(counts, own[by].eqNullSafe(counts["__by"]))
    share = F.lit(3.0 * size) / F.col("__n")
    low = near.filter((F.col("__n") <= 10 * size) | (F.col("__hash").cast("double") < -(2.0**63) + share * 2.0**64))
    order = Window.partitionBy(by).orderBy("__hash", *of)
    return low.withColumn("__k", F.row_number().over(order)).filter(F.col("__k") <= size).drop("__hash", "__n", "__by", "__k")
