"""Exact deduplication as a stateful stream.

Every row becomes a digest of its text, a stable identifier (doc_id) and a content locator (file and row). These slim
rows stream through a grouping by digest whose state lives on disk (RocksDB), never expires and is checkpointed in the
shared folder: per digest it keeps the row that stays, its locator and the number of rows seen. A hit, that is a digest
seen more than once, is then checked on the full bytes; rows whose digests agree while their bytes differ are grouped
again by the bytes themselves.

Nothing is capped: a digest that a third of all rows share is summed before the shuffle, so its state sees one row for
each task, and the byte check deals its rows out over SALTS keys before it reduces them to the smallest and largest text.

Edge cases: a null text counts as empty; a null doc_id is smaller than any other; of rows equal in text and doc_id one
stays; an empty table gives an empty result; other columns are ignored by `find_copies` and kept by `drop_copies`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgertide.llm.work import located, place_name, settle, whole, work_folder

STATE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # the shared folder holds the state: executors keep no copy between batches and set no space aside
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: Keys over which the rows of one digest are dealt for the byte check.
SALTS = 16
#: Bytes of slim rows in a micro-batch: some five million rows, so large tables meet their keys again in the state.
BATCH_BYTES = 256 << 20


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def keyed_state(feed: DataFrame, folder: str, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Stream the slim rows written in `folder` through the keyed state; one row per digest: keep, seen.

    `keep` is the largest (doc_id, at). A run that breaks off goes on from its checkpoint.
    """
    spark = feed.sparkSession
    home = work_folder(spark, "dedup-state")
    before = {k: spark.conf.get(k, None) for k in STATE}
    for key, value in STATE.items():
        spark.conf.set(key, value)
    try:
        stream = spark.readStream.schema(feed.schema).option("maxBytesPerTrigger", str(batch_bytes)).parquet(folder)
        state = stream.groupBy("digest").agg(
            F.max(F.struct("doc_id", "at")).alias("keep"), F.count(F.lit(1)).alias("seen")
        )

        def write(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(f"{home}/changes/batch={batch_id}")

        query = (
            state.writeStream.outputMode("update")
            .foreachBatch(write)
            .option("checkpointLocation", f"{home}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        batches = query.lastProgress is not None
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    if not batches:  # there was no file with rows
        return spark.createDataFrame([], state.schema)
    changes = spark.read.schema(f"{_ddl(state)}, batch BIGINT").parquet(f"{home}/changes")
    last = F.max_by(F.struct("keep", "seen"), "batch").alias("last")
    return changes.groupBy("digest").agg(last).select("digest", "last.keep", "last.seen")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def colliding(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Digests seen more than once whose full texts are not all the same bytes. rows: digest, text, at."""
    seen_again = state.where("seen > 1").select("digest", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    dealt = rows.select("digest", "text", F.pmod(F.xxhash64("at"), F.lit(SALTS)).cast("int").alias("salt"))
    return (
        dealt.join(seen_again, ["digest", "salt"], "left_semi")
        .groupBy("digest")
        .agg(F.min("text").alias("low"), F.max("text").alias("high"))
        .where("low <> high")
        .select("digest")
    )


def find_copies(
    docs: DataFrame, digest: Callable[[Column], Column] = sha256, batch_bytes: int = BATCH_BYTES
) -> DataFrame:
    """One row per row of `docs`: doc_id, at (its locator), digest, keep_id, keep_at, group_size, kept.

    Of equal texts the row with the largest doc_id stays, and of those with the same doc_id the last one.
    """
    place = place_name(docs)
    return _find(located(docs, place), place, digest, batch_bytes)


def _find(placed: DataFrame, place: str, digest: Callable[[Column], Column] = sha256, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    spark = placed.sparkSession
    rows = placed.select("doc_id", whole().alias("text"), F.col(place).alias("at"))
    rows = rows.withColumn("digest", digest(F.col("text")))
    folder = work_folder(spark, "dedup-feed")
    slim = rows.select("doc_id", "at", "digest")
    slim.write.parquet(folder)
    feed = spark.read.schema(slim.schema).parquet(folder)
    state = settle(keyed_state(feed, folder, batch_bytes), "dedup-keys")
    wrong = settle(colliding(rows, state), "dedup-collisions")

    def told(known: DataFrame) -> DataFrame:
        return known.select(
            "doc_id", "at", "digest", F.col("keep.doc_id").alias("keep_id"), F.col("keep.at").alias("keep_at"),
            F.col("seen").alias("group_size"), (F.col("at") == F.col("keep.at")).alias("kept"),
        )

    if wrong.isEmpty():
        return told(feed.join(state, "digest"))
    sound = told(feed.join(state.join(wrong, "digest", "left_anti"), "digest"))
    apart = rows.join(wrong, "digest", "left_semi")
    by_text = apart.groupBy("digest", "text").agg(
        F.max(F.struct("doc_id", "at")).alias("keep"), F.count(F.lit(1)).alias("seen")
    )
    return sound.unionByName(told(apart.join(by_text, ["digest", "text"])))


def drop_copies(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that stay, with all their columns."""
    place = place_name(docs)
    rows = located(docs, place)
    gone = _find(rows, place, **options).where(~F.col("kept")).select(F.col("at").alias(place))
    return rows.join(gone, place, "left_anti").select(*docs.columns)
