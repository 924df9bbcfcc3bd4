"""Starting streams over a folder of event files and reading what they wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipledger.session import scratch_path
from clipledger.sources.views import shape_events

EVENTS_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Bytes of event files that a micro-batch takes, if nothing else is said.
BATCH_BYTES = 64 * 1024**3


def read_events(
    spark: SparkSession, root: str, files_per_trigger: int | None = None, bytes_per_trigger: int = BATCH_BYTES
) -> DataFrame:
    """The event files of a folder as a stream; a micro-batch takes so many files, else so many bytes."""
    reader = spark.readStream.schema(EVENTS_SCHEMA).option("pathGlobFilter", "events*.parquet")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    else:
        reader = reader.option("maxBytesPerTrigger", str(bytes_per_trigger))
    return shape_events(reader.parquet(root))


def _start(stream: DataFrame, mode: str, where: str):
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{where}/progress")
        .trigger(availableNow=True)
    )


#: A time that no event reaches.
END_OF_TIME = "9000-01-01 00:00:00"


class Replay:
    """A run of a stream to the end of the available input, and beyond: then nothing waits for its time any more.

    ``ticks`` is to be handed to the operator. ``drain`` runs what has come, any number of times; with
    ``close`` a last tick lets all timers go off.
    """

    def __init__(self, spark: SparkSession, where: str | None = None):
        self.spark, self.where = spark, where or scratch_path(spark, "replay")
        self._tick(spark.createDataFrame([], "ts timestamp"))
        self.ticks = spark.readStream.schema("ts timestamp").parquet(f"{self.where}/ticks")

    def _tick(self, rows: DataFrame) -> None:
        rows.coalesce(1).write.mode("append").parquet(f"{self.where}/ticks")

    def tick(self, time: str) -> None:
        """Time has come so far, whether or not there are events."""
        self._tick(self.spark.range(1).select(F.lit(time).cast("timestamp").alias("ts")))

    def _run(self, stream: DataFrame) -> None:
        _start(stream, "append", self.where).format("parquet").start(f"{self.where}/rows").awaitTermination()

    def drain(self, stream: DataFrame, close: bool = True) -> DataFrame:
        """The rows that came out so far."""
        self._run(stream)
        if close:
            self.tick(END_OF_TIME)
            self._run(stream)
        return self.spark.read.schema(stream.schema).parquet(f"{self.where}/rows")


def drain_batches(stream: DataFrame, mode: str, handle: Callable[[DataFrame, int], None], where: str) -> None:
    """Run to the end of the available input, handing each micro-batch to ``handle``."""
    _start(stream, mode, where).foreachBatch(handle).start().awaitTermination()
