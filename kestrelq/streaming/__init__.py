"""Registered queries over streams: the engine's SQL on each micro-batch, or on a stream as a whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from kestrelq.engine import Engine


def on_stream(engine: Engine, name: str, stream: DataFrame, sql: str) -> DataFrame:
    """The query over a streaming table; Spark decides whether it can be kept up to date."""
    engine.register(name, stream)
    return engine.sql(sql)


def on_batches(engine: Engine, name: str, stream: DataFrame, sql: str, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """The query over each micro-batch by itself, given to a sink with the batch's number."""

    def run(batch: DataFrame, number: int) -> None:
        own = Engine(batch.sparkSession, engine.config)
        for known in engine.catalog.table_names():
            own.register(known, engine.catalog.table(known))
        own.register(name, batch)
        sink(own.sql(sql), number)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).start()
