"""Streams: event roll-ups under a watermark, and the memory controller as keyed state."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.sequence import next_limit
from ..session import scratch


def drain(stream: DataFrame, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Runs a stream over all that is there now and returns what it made, from Parquet files in the shared folder.

    In complete mode each batch replaces the files, otherwise it adds to them; a batch that is run again writes the same folder.
    """
    spark = stream.sparkSession
    path = f"{scratch(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out" if mode == "complete" else f"{path}/out/batch={number}")

    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint or f"{path}/checkpoint")
    writer.foreachBatch(write).start().awaitTermination()
    out = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/out")
    if not out.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(out):  # there was nothing to read
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{path}/out").select(*stream.columns)


def event_counts(events: DataFrame, ts: str, kind: str, value: str, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """kind, window start, n and total of each tumbling window."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    out = rows.groupBy(F.window(ts, every), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(kind, F.col("window.start").alias("begin"), "n", "total")


def limits(events: DataFrame, key: str, order: str, blocks: str, peak: str, target: int, first: int) -> DataFrame:
    """Streaming twin of adaptive_limits: limit_after of each call, with one whole number of state per key. Rows of a batch are
    taken in order."""

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState):
        limit = state.get[0] if state.exists else first
        rows = pd.concat(list(frames)).sort_values(order)
        out = []
        for b, p in zip(rows[blocks], rows[peak]):
            limit = next_limit(limit, int(b), int(p), target)
            out.append(limit)
        state.update((limit,))
        yield pd.DataFrame({key: [keys[0]] * len(out), order: rows[order].tolist(), "limit_after": out})

    kinds = dict(events.dtypes)
    return events.groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {order} {kinds[order]}, limit_after long", "lim long", "append", GroupStateTimeout.NoTimeout)


def table_stream(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table as a stream."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
