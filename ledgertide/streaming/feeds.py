"""Streams over table folders, and sinks that can be run again safely."""

from __future__ import annotations

import datetime as dt
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.types import LongType, StructField, StructType

from ledgertide.session import shared_folder
from ledgertide.sources.keyed import CommitLog
from ledgertide.sources.schemas import raw_schema

KEYED_STATE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}

def table_stream(spark: SparkSession, folder: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """New files of one raw table as a stream with a fixed schema."""
    reader = spark.readStream.schema(raw_schema(name)).option("pathGlobFilter", f"{name}*.parquet")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def work_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def log_batches(target: str):
    """A batch handler that keeps every batch under its id; a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    return write


def start(stream: DataFrame, handler, checkpoint: str, mode: str = "append", once: bool = False) -> StreamingQuery:
    writer = stream.writeStream.outputMode(mode).foreachBatch(handler).option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def drain(
    stream: DataFrame, name: str, mode: str = "append", make=log_batches, schema: StructType | None = None
) -> tuple[DataFrame, StreamingQuery]:
    """Run a stream over what is there now and return the logged rows with their batch id.

    `make` gets the target folder and returns the batch handler; `schema` is that of its rows
    when they differ from the rows of the stream.
    """
    spark = stream.sparkSession
    folder = work_folder(spark, name)
    with keyed_state(spark):
        query = start(stream, make(f"{folder}/rows"), f"{folder}/checkpoint", mode, once=True)
        query.awaitTermination()
    fields = (schema or stream.schema).fields
    logged = spark.read.schema(StructType([*fields, StructField("batch_id", LongType())]))
    return logged.parquet(f"{folder}/rows"), query


def newest_per_key(logged: DataFrame, keys: list[str]) -> DataFrame:
    """The last logged state of each key of an update-mode stream."""
    values = [c for c in logged.columns if c not in keys and c != "batch_id"]
    last = F.max_by(F.struct(*values), "batch_id").alias("_last")
    return logged.groupBy(*keys).agg(last).select(*keys, "_last.*")


class ProgressTotals(StreamingQueryListener):
    """Adds up every progress report as it comes, however many there are.

    Spark itself keeps the last `spark.sql.streaming.numRecentProgressUpdates` reports only.
    """

    def __init__(self):
        self.batches: dict[str, int] = {}
        self.rows: dict[str, int] = {}
        self.dropped: dict[str, int] = {}
        self._ended: dict[str, threading.Event] = {}

    def _end(self, run: str) -> threading.Event:
        return self._ended.setdefault(run, threading.Event())

    def onQueryStarted(self, event) -> None:
        self._end(str(event.runId))

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        run = str(progress.runId)
        self.batches[run] = self.batches.get(run, 0) + 1
        self.rows[run] = self.rows.get(run, 0) + progress.numInputRows
        late = sum(state.numRowsDroppedByWatermark for state in progress.stateOperators)
        self.dropped[run] = self.dropped.get(run, 0) + late

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._end(str(event.runId)).set()

    def wait(self, query: StreamingQuery, seconds: float = 60) -> None:
        """Reports come by another thread; after the end of the query's run none is missing."""
        if not self._end(str(query.runId)).wait(seconds):
            raise TimeoutError("the query has not ended")

    def late_rows(self, query: StreamingQuery) -> int:
        """Rows that the watermark has dropped in the whole run."""
        self.wait(query)
        return self.dropped.get(str(query.runId), 0)


def split_late(ts: str, late: str):
    """A batch handler that parts the rows behind the watermark from the others, and keeps both.

    The watermark of a batch is the latest time of all batches before, less `late`. It is committed under the batch id,
    so a repeated batch is parted the same way. `target` gets on_time and late rows as folders late=0
    and late=1 of each batch; rows without a time are on time.
    """

    def make(target: str):
        def handle(batch: DataFrame, batch_id: int) -> None:
            marks = CommitLog(batch.sparkSession, f"{target}-marks")
            done = marks.find(f"batch-{batch_id}")
            number = done - 1 if done else marks.newest()
            latest = marks.read(number)["latest"] if number else None
            behind = F.lit(False)
            if latest is not None:
                mark = F.lit(latest).cast("timestamp_ntz") - F.expr(f"INTERVAL {late}")
                behind = F.coalesce(F.col(ts) <= mark, behind)
            seen = Observation()
            marked = batch.observe(seen, F.max(F.col(ts).cast("timestamp_ntz")).cast("string").alias("latest"))
            marked.withColumn("late", behind.cast("int")).write.mode("overwrite").partitionBy("late").parquet(
                f"{target}/batch_id={batch_id}")
            newest = max((t for t in (latest, seen.get["latest"]) if t is not None), default=None, key=dt.datetime.fromisoformat)
            marks.commit(f"batch-{batch_id}", lambda _number, _last: {"latest": newest})

        return handle

    return make


def in_waves(rows: DataFrame, wave: Column, folder: str, closing: dict | None = None) -> int:
    """Lay rows out as files that arrive one after the other, a file per wave (numbers from 0); returns their number.

    `closing` adds a last file with one row of these values and NULL elsewhere: a row whose time lies far ahead moves
    the watermark past all others. Files are told apart by their times, which a stream over the folder goes by.
    """
    spark = rows.sparkSession
    rows.withColumn("wave", wave).repartition("wave").write.partitionBy("wave").parquet(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    waves = sorted(
        (int(e.getPath().getName().split("=")[1]), e.getPath()) for e in system.listStatus(path) if "=" in e.getPath().getName()
    )
    if closing is not None:
        last = waves[-1][0] + 1 if waves else 0
        values = [F.lit(closing.get(f.name)).cast(f.dataType).alias(f.name) for f in rows.schema]
        target = f"{folder}/wave={last}"
        spark.range(1).select(*values).coalesce(1).write.parquet(target)
        waves.append((last, spark._jvm.org.apache.hadoop.fs.Path(target)))
    for number, part in waves:
        for entry in system.listStatus(part):
            if entry.getPath().getName().endswith(".parquet"):
                system.setTimes(entry.getPath(), 1_600_000_000_000 + 60_000 * number, -1)
    return len(waves)


def wave_stream(rows: DataFrame, folder: str, waves_per_batch: int = 1) -> DataFrame:
    """The files of `in_waves` as a stream, in their order; `rows` gives the schema."""
    reader = rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", waves_per_batch)
    return reader.option("recursiveFileLookup", "true").parquet(folder)


@contextmanager
def keyed_state(spark: SparkSession):
    """Settings under which a stream with keyed state and timers is started."""
    before = {key: spark.conf.get(key, None) for key in KEYED_STATE}
    for key, value in KEYED_STATE.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
