"""Tables that change by key, and key ranges, on a log of commits in the shared folder.

`CommitLog` numbers small commits without gaps: a commit is written beside and moved to its number, which fails if another
writer has taken that number (an atomic move on HDFS and like stores, a hard link where the shared folder is mounted).
Commits have names, so a job that runs again finds what it has already done.

`KeyedTable` keeps immutable Parquet files and, per version, a list of files with the range of keys each holds. A change
rewrites the files that hold a changed key and references all others; readers see the version they began with.

`KeyRanges` hands out ranges of surrogate keys: two writers never get the same key, a repeated batch gets its old range.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from functools import cache
from urllib.parse import quote

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgertide.operators.ordered import numbered
from ledgertide.session import settle
from ledgertide.sources.tables import apply_changes


class CommitLog:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark._jvm
        self._system = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def _entry(self, number: int):
        return self._path(f"entries/{number:012d}")

    def _write_new(self, path, text: str) -> bool:
        """Create a file with this text; False if there is one already."""
        beside = self._path(f"beside/{uuid.uuid4().hex}")
        out = self._system.create(beside)
        out.write(bytearray(text.encode()))
        out.close()
        self._system.mkdirs(path.getParent())
        if self._system.getUri().getScheme() == "file":
            try:
                os.link(beside.toUri().getPath(), path.toUri().getPath())
                return True
            except FileExistsError:
                return False
            finally:
                self._system.delete(beside, False)
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            self._system.makeQualified(path).toUri(), self.spark._jsc.hadoopConfiguration()
        )
        plain = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self._system.makeQualified(beside), self._system.makeQualified(path), plain)
        except Py4JJavaError as error:
            self._system.delete(beside, False)
            if "FileAlreadyExistsException" in error.java_exception.getClass().getName():
                return False
            raise
        return True

    def _read(self, path) -> str | None:
        if not self._system.exists(path):
            return None
        stream = self._system.open(path)
        try:
            return self._jvm.java.io.BufferedReader(self._jvm.java.io.InputStreamReader(stream, "UTF-8")).readLine()
        finally:
            stream.close()

    def newest(self) -> int:
        """Number of the last commit, 0 if there is none."""
        path = self._path("entries")
        if not self._system.exists(path):
            return 0
        return max((int(e.getPath().getName()) for e in self._system.listStatus(path)), default=0)

    def read(self, number: int) -> dict:
        return json.loads(self._read(self._entry(number)))

    def find(self, name: str) -> int | None:
        """Number of the commit of this name.

        Before a commit is made every earlier one has its name filed, so only the last ones may have to be looked at.
        """
        filed = self._read(self._path(f"names/{quote(name, safe='')}"))
        if filed:
            return int(filed)
        self._file_names()
        filed = self._read(self._path(f"names/{quote(name, safe='')}"))
        return int(filed) if filed else None

    def _file_names(self) -> int:
        number = last = self.newest()
        while number:
            if not self._write_new(self._path(f"names/{quote(self.read(number)['name'], safe='')}"), str(number)):
                break
            number -= 1
        return last

    def commit(self, name: str, make: Callable[[int, dict | None], dict]) -> tuple[int, dict]:
        """Add the commit that `make` derives from the last one (number, content); asked again if another came first."""
        while True:
            done = self.find(name)
            if done:
                return done, self.read(done)
            last = self._file_names()
            content = make(last, self.read(last) if last else None) | {"name": name}
            if self._write_new(self._entry(last + 1), json.dumps(content)):
                self._file_names()
                return last + 1, content


#: Rows that Spark may broadcast if it finds their files small; those of a key and a short text take a few bytes each there.
FEW_ROWS = 100_000


def _sized(rows: DataFrame, count: int) -> DataFrame:
    """Rows of which there are `count`, for a join: packed files do not tell how much memory a broadcast of them takes."""
    return rows if count <= FEW_ROWS else rows.hint("merge")


class KeyedTable:
    def __init__(self, spark: SparkSession, folder: str, key: str):
        self.spark, self.folder, self.key = spark, folder.rstrip("/"), key
        self.log = CommitLog(spark, f"{self.folder}/_log")

    # -- reading

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest one by default."""
        version = self.log.newest() if version is None else version
        if not version:
            raise FileNotFoundError(self.folder)
        content = self.log.read(version)
        schema = StructType.fromJson(content["schema"])
        files = [r.file for r in self.files(version).select("file").collect()]  # as many as Spark lists for any scan
        return self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)

    def files(self, version: int | None = None) -> DataFrame:
        """file, low, high, rows of each file of a version."""
        return self.spark.read.parquet(self.log.read(version or self.log.newest())["files"])

    def before(self, name: str) -> DataFrame:
        """The rows as they are, or as they were before the change of this name."""
        done = self.log.find(name)
        return self.read(done - 1 if done else None)

    # -- writing

    def create(self, rows: DataFrame, files: int = 1) -> None:
        """The first version, its files cut by ranges of the key."""
        self.log.commit("create", lambda _number, _last: self._content(rows.schema, self._written(rows, files)))

    def change(
        self, changes: DataFrame, add: dict[str, str] | None = None, replace: dict[str, str] | None = None,
        insert: bool = False, name: str | None = None,
    ) -> int:
        """Add to columns or replace them for the keys of `changes` (a row per key); returns the number of the version.

        With `insert`, keys that are not there yet become rows, columns that are not replaced NULL. A change of a name
        that is done already does nothing. The changes are worked out once and stored, as several jobs read them.
        """
        add, replace = add or {}, replace or {}
        needed = dict.fromkeys([self.key, *add.values(), *replace.values()])
        stored = cache(lambda: settle(changes.select(*needed), "changes"))
        return self.log.commit(
            name or uuid.uuid4().hex, lambda number, last: self._changed(number, last, stored(), add, replace, insert)
        )[0]

    def compact(self, files: int) -> int:
        """The same rows in so many files, cut by ranges of the key."""
        def whole(number: int, last: dict) -> dict:
            rows = self.read(number)
            return self._content(rows.schema, self._written(rows, files))

        return self.log.commit(uuid.uuid4().hex, whole)[0]

    def touched(self, version: int, changes: DataFrame) -> list[str]:
        """Files of a version that hold a key of `changes`.

        Files whose range misses the span of the changes are left out by the list; of the others only the key is read.
        """
        span = changes.agg(F.min(self.key).alias("low"), F.max(self.key).alias("high"), F.count(self.key).alias("rows")).first()
        listed = self.files(version).filter((F.col("high") >= F.lit(span.low)) & (F.col("low") <= F.lit(span.high)))
        near = [r.file for r in listed.select("file").collect()]
        if not near:
            return []
        held = self._placed(self.spark.read.schema(self._schema(version)).parquet(*near))
        hit = held.join(_sized(changes.select(self.key), span.rows), self.key, "left_semi").select("file").distinct()
        return [r.file for r in hit.collect()]

    def _changed(self, number, last, changes, add, replace, insert) -> dict:
        schema = StructType.fromJson(last["schema"])
        touched = self.touched(number, changes)
        old = self.spark.read.schema(schema).parquet(*touched) if touched else self.spark.createDataFrame([], schema)
        gone = self.spark.createDataFrame([(f,) for f in touched], "file STRING")
        fresh = apply_changes(old, self.key, _sized(changes, changes.count()), add, replace)
        if insert:
            taken = {self.key: self.key} | replace
            held = self.files(number).join(gone, "file", "left_semi").agg(F.sum("rows")).first()[0] or 0
            new = changes.join(_sized(old.select(self.key), held), self.key, "left_anti").select(*[
                (F.col(taken[f.name]) if f.name in taken else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema
            ])
            fresh = fresh.unionByName(new)
        written = self._written(fresh, max(1, len(touched)))
        kept = self.files(number).join(gone, "file", "left_anti")
        return self._content(schema, kept.unionByName(written))

    def _schema(self, version: int) -> StructType:
        return StructType.fromJson(self.log.read(version)["schema"])

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.select(self.key, rows.metadataColumn("_metadata")["file_path"].alias("file"))

    def _written(self, rows: DataFrame, files: int) -> DataFrame:
        """Write the rows as new files, cut by ranges of the key, and list them."""
        target = f"{self.folder}/data/{uuid.uuid4().hex}"
        rows.repartitionByRange(files, self.key).write.parquet(target)
        stored = self._placed(self.spark.read.schema(rows.schema).parquet(target))
        return stored.groupBy("file").agg(F.min(self.key).alias("low"), F.max(self.key).alias("high"), F.count("*").alias("rows"))

    def _content(self, schema: StructType, listed: DataFrame) -> dict:
        target = f"{self.folder}/files/{uuid.uuid4().hex}"
        listed.coalesce(1).write.parquet(target)  # a short row per file
        return {"schema": schema.jsonValue(), "files": target}


class KeyRanges:
    """Ranges of consecutive keys for concurrent batches."""

    def __init__(self, spark: SparkSession, folder: str, first: int = 1):
        self.log, self.first = CommitLog(spark, folder), first

    def take(self, batch: str, count: int) -> int:
        """First key of the range of `count` keys that belongs to this batch."""
        _, range_ = self.log.commit(
            batch, lambda _number, last: {"first": last["first"] + last["count"] if last else self.first, "count": count}
        )
        if range_["count"] < count:
            raise ValueError(f"batch {batch} has a range of {range_['count']} keys and now needs {count}")
        return range_["first"]

    def with_keys(self, rows: DataFrame, order: list, name: str, batch: str) -> DataFrame:
        """Consecutive keys in a given order, from the range of this batch."""
        first = self.take(batch, rows.count())
        return numbered(rows, [], order, "_place").withColumn(name, F.col("_place") + (first - 1)).drop("_place")
