"""Staged batches checked against the keys of a `KeyedTable` without reading its history whole.

`KeyFilter` keeps, per version, which keys the table may hold: a key belongs to one part by its hash and sets PROBES bits in the
bitmap of that part. Only files that no earlier version had are read to bring the filter up to date. A key whose bits are not
all set is certainly not in the table; the others are looked up in the files whose key range holds one of them, so results
are exact.

NULL keys are no findings of uniqueness or references (the required-column checks tell them). Changes add keys to a table but
never remove any, so bits are never cleared.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgertide.sources.keyed import CommitLog, KeyedTable

#: Bits in the bitmap of a part, as Spark's bitmap functions fix them.
PART_BITS = 32768
#: Bits set for a key; stored sets of bitmaps after which they are merged.
PROBES, MERGE_AFTER = 4, 16
#: Keys a part is made for: one wrong hit in 450 then, one in 45 at twice as many, when the filter is built anew with more parts.
PART_KEYS = 2000


class KeyFilter:
    def __init__(self, table: KeyedTable, part_keys: int = PART_KEYS):
        self.table, self.spark, self.key, self.part_keys = table, table.spark, table.key, part_keys
        self.folder = f"{table.folder}/filter-{part_keys}"
        self.log = CommitLog(table.spark, f"{self.folder}/_log")

    # -- keeping

    def refresh(self, version: int | None = None) -> dict:
        """Cover a version (the newest one by default); what is covered already is not read again."""
        version = version or self.table.log.newest()
        return self.log.commit(str(version), lambda _number, last: self._covered(version, last))[1]

    def _covered(self, version: int, last: dict | None) -> dict:
        listed = self.table.files(version)
        rows = listed.agg(F.sum("rows")).first()[0] or 0
        wanted = 1 << max(0, math.ceil(math.log2(max(1, rows / self.part_keys))))
        if last and wanted > 2 * last["parts"]:
            last = None  # grown beyond its bitmaps: all files again, with more parts
        parts = last["parts"] if last else wanted
        new = listed.select("file")
        if last:
            new = new.join(self.spark.read.parquet(*last["files"]), "file", "left_anti")
        new_files = [r.file for r in new.collect()]  # as many as Spark lists for any scan
        bitmaps = list(last["bitmaps"]) if last else []
        if new_files:
            schema = self.table.read(version).schema
            keys = self.spark.read.schema(schema).parquet(*new_files).select(self.key).filter(F.col(self.key).isNotNull())
            bits = keys.select(self._part(parts), F.explode(self._probes()).alias("bit"))
            bitmaps.append(self._stored(bits.groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))))
        if len(bitmaps) > MERGE_AFTER:
            merged = self.spark.read.parquet(*bitmaps).groupBy("part").agg(F.bitmap_or_agg("bits").alias("bits"))
            bitmaps = [self._stored(merged)]
        return {"files": [self._stored(new.coalesce(1)), *(last["files"] if last else [])], "bitmaps": bitmaps, "parts": parts}

    def _stored(self, rows: DataFrame) -> str:
        target = f"{self.folder}/{uuid.uuid4().hex}"
        rows.write.parquet(target)
        return target

    def _part(self, parts: int) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(parts)).cast("long").alias("part")

    def _probes(self) -> Column:
        return F.array(*[F.pmod(F.xxhash64(self.key, F.lit(k + 1)), F.lit(PART_BITS)) for k in range(PROBES)])

    # -- asking

    def possible(self, keys: DataFrame, version: int | None = None) -> DataFrame:
        """The distinct keys that a version may hold."""
        content = self.refresh(version)
        asked = keys.select(self.key).filter(F.col(self.key).isNotNull()).distinct()
        if not content["bitmaps"]:
            return asked.limit(0)
        stored = self.spark.read.parquet(*content["bitmaps"]).groupBy("part").agg(F.bitmap_or_agg("bits").alias("bits"))

        def is_set(bit: Column) -> Column:
            byte = F.conv(F.hex(F.substring(F.col("bits"), (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
            return F.element_at(F.array(*[F.shiftright(byte, k).bitwiseAND(1) for k in range(8)]), (bit % 8).cast("int") + 1) == 1

        placed = asked.select(self.key, self._part(content["parts"]), self._probes().alias("probes"))
        return placed.join(stored, "part").filter(F.forall("probes", is_set)).select(self.key)

    def files_of(self, keys: DataFrame, version: int | None = None) -> list[str]:
        """Files of a version whose range holds one of the keys."""
        version = version or self.table.log.newest()
        listed = self.table.files(version).select("file", "low", "high").toPandas()  # a short row per file
        key = self.key

        def hit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                ordered = batch[key].sort_values()
                held = ordered.searchsorted(listed["low"]) < ordered.searchsorted(listed["high"], side="right")
                yield listed.loc[held, ["file"]]

        return [r.file for r in keys.mapInPandas(hit, "file STRING").distinct().collect()]

    def present(self, keys: DataFrame, version: int | None = None) -> DataFrame:
        """The distinct keys that a version holds; only keys of the files that may hold one are read."""
        version = version or self.table.log.newest()
        asked = self.possible(keys, version)
        files = self.files_of(asked, version)
        if not files:
            return asked.limit(0)
        held = self.spark.read.schema(self.table.read(version).schema).parquet(*files).select(self.key)
        return asked.join(held, self.key, "left_semi")

    def repeated(self, staged: DataFrame, version: int | None = None) -> DataFrame:
        """key, staged_rows, exists: keys that stand twice in the staged rows or are in the table already."""
        counted = staged.filter(F.col(self.key).isNotNull()).groupBy(self.key).agg(F.count("*").alias("staged_rows"))
        there = self.present(staged, version).withColumn("exists", F.lit(True))
        found = counted.join(there, self.key, "left").withColumn("exists", F.coalesce("exists", F.lit(False)))
        return found.filter((F.col("staged_rows") > 1) | F.col("exists"))

    def orphans(self, staged: DataFrame, column: str, version: int | None = None) -> DataFrame:
        """key, staged_rows: values of a column of the staged rows that are no key of the table."""
        asked = staged.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias(self.key)).agg(
            F.count("*").alias("staged_rows")
        )
        return asked.join(self.present(asked, version), self.key, "left_anti")
