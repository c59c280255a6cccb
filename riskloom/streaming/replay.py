"""Runs a stream over what is there now and gives the result as a table, for replays and checks."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from riskloom.sources.shared import kept, shared_folder


def shared(spark: SparkSession) -> str:
    return shared_folder(spark).rstrip("/") + f"/stream-{uuid.uuid4().hex}"


def file_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a folder as a stream of its files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def in_parts(df: DataFrame, parts: list[Column]) -> str:
    """Writes the rows of each condition into one more file of a new folder, in this order. The rows are made by all tasks first;
    the one that writes a file only copies them."""
    path = shared(df.sparkSession)
    rows = kept(df)
    for part in parts:
        rows.filter(part).repartition(1).write.mode("append").parquet(path)
    return path


def part_stream(spark: SparkSession, path: str, schema: StructType, whole: bool = False) -> DataFrame:
    """The files of a folder as a stream, one in each micro-batch, in the order of their writing; or, where it is whole, all
    that are there when a micro-batch begins."""
    reader = spark.readStream.schema(schema)
    return (reader if whole else reader.option("maxFilesPerTrigger", 1)).parquet(path)


def run(writer: DataStreamWriter, seconds: float = 3600) -> None:
    """Runs a stream to the end of its input; one that takes longer or fails is stopped and raises."""
    q = writer.trigger(availableNow=True).start()
    try:
        if not q.awaitTermination(seconds):
            raise TimeoutError(f"the stream has not ended after {seconds} s")
    finally:
        q.stop()


def run_until(writer: DataStreamWriter, done: Callable[[], bool], seconds: float = 3600) -> None:
    """Runs a stream, of which timers are a part, until a condition holds, then stops it."""
    q, end = writer.start(), time.monotonic() + seconds
    try:
        while not done():
            if q.exception() is not None:
                raise RuntimeError(str(q.exception()))
            if time.monotonic() > end:
                raise TimeoutError(f"the stream was not done after {seconds} s")
            time.sleep(0.3)
    finally:
        q.stop()


def with_state(spark: SparkSession) -> None:
    """State in RocksDB, which processors with timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def into(stream: DataFrame, path: str, mode: str = "append") -> DataStreamWriter:
    """Writes each micro-batch into its own folder of path/rows, so that one that is run again replaces itself (or only the
    last one, where the mode is complete); the checkpoint is beside it."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows" if mode == "complete" else f"{path}/rows/batch={number}")

    return stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{path}/state")


def drained(stream: DataFrame, mode: str = "append", seconds: float = 3600) -> DataFrame:
    """All batches of a stream, written to the shared folder: appended, or the last one where the mode is complete."""
    spark, path = stream.sparkSession, shared(stream.sparkSession)
    with_state(spark)
    run(into(stream, path, mode), seconds)
    return spark.read.schema(stream.schema).parquet(f"{path}/rows").select(*stream.columns)
