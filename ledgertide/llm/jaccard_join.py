"""Similarity join on word n-grams: MinHash banding, then exact Jaccard on full n-gram sets.

Texts with the same n-gram set are one class, so copies are never paired. Classes meet in buckets of band hashes; the
number of bands and rows follows from the similarity and the recall that is asked for. In small buckets every pair is a
row, verified on both full sets. Buckets over BUCKET members are joined to clusters instead (two large buckets that share
a member are one cluster); a cluster is cut into blocks of about BLOCK classes, and every pair of blocks is verified in
one task as a product of incidence matrices, so a group of near copies of any size never becomes rows of pairs, never
gathers in one task, and loses no link. All pairs of a cluster are tried, more than the bands ask for.

Words are runs of letters, digits and underscores of the lower-cased text. n-grams are kept as 64-bit hashes.

Edge cases: null and empty texts and texts without words have no n-grams: no links and a class of their own; texts of
fewer than n words are one n-gram of all their words; a null doc_id takes part and is smaller than any other; rows with
equal doc_id are rows each; an empty table gives an empty result; other columns are ignored, and kept by `drop_similar`.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgertide.llm.components import components
from ledgertide.llm.work import located, place_name, settle, whole

N, SIMILARITY, RECALL = 5, 0.8, 0.9999
#: Hashes per class at most, members of a bucket whose pairs become rows, and classes in a block of a cluster.
HASHES, BUCKET, BLOCK = 128, 32, 128
SLICE = 4096

WORD = re.compile(r"\w+")
_RANDOM = np.random.default_rng(20)
MULTIPLIERS = _RANDOM.integers(0, 2**63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
ADDENDS = _RANDOM.integers(0, 2**63, HASHES, np.uint64)
MIX = np.uint64(0xFF51AFD7ED558CCD)


def bands_and_rows(similarity: float, recall: float, hashes: int = HASHES) -> tuple[int, int]:
    """Most rows per band for which enough bands fit: 1 - (1 - s^r)^b >= recall with b * r <= hashes."""
    for rows in range(16, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))
        if bands * rows <= hashes:
            return bands, rows
    raise ValueError("no banding reaches this recall with so few hashes")


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * MIX
    return x ^ (x >> np.uint64(29))


class Grams:
    """n-gram sets of texts, as sorted 64-bit hashes; the hashes of about `room` words are remembered."""

    def __init__(self, n: int, room: int = 400_000):
        import xxhash

        class Known(dict):
            def __missing__(self, word):
                if len(self) > room:
                    self.clear()
                found = self[word] = xxhash.xxh3_64_intdigest(word)
                return found

        self.n, self.known = n, Known()

    def __call__(self, text: str) -> np.ndarray:
        words = WORD.findall(text.lower())
        h = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        n = min(self.n, len(h))
        if not n:
            return h
        total = np.zeros(len(h) - n + 1, np.uint64)
        for k in range(n):
            total += h[k : len(h) - n + 1 + k] * MULTIPLIERS[k]
        return np.unique(mixed(total))


def band_hashes(grams: np.ndarray, bands: int, rows: int) -> np.ndarray:
    low = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(grams), 8192):
        part = grams[k : k + 8192][None, :] * MULTIPLIERS[: bands * rows, None] + ADDENDS[: bands * rows, None]
        np.minimum(low, part.min(1), out=low)
    by_band = mixed(low).reshape(bands, rows) * MULTIPLIERS[:rows]
    return mixed(by_band.sum(1) + np.arange(1, bands + 1).astype(np.uint64) * MIX).view(np.int64)


def signatures(rows: DataFrame, n: int, bands: int, per_band: int) -> DataFrame:
    """doc_id, at, id (digest of the n-gram set, null without n-grams), bands."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams_of = Grams(n)
        for batch in batches:
            ids, hashes = [], []
            for text in batch.column(2).to_pylist():
                grams = grams_of(text)
                ids.append(hashlib.blake2b(grams.tobytes(), digest_size=16).digest() if len(grams) else None)
                hashes.append(band_hashes(grams, bands, per_band) if len(grams) else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(ids, pa.binary()), pa.array(hashes, pa.list_(pa.int64()))],
                ["doc_id", "at", "id", "bands"],
            )

    texts = rows.select("doc_id", F.col("__at").alias("at"), whole().alias("text"))
    kind = texts.schema["at"].dataType.simpleString()
    return texts.mapInArrow(sign, f"doc_id BIGINT, at {kind}, id BINARY, bands ARRAY<BIGINT>")


def gram_sets(rows: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """id, grams (bytes of the sorted hashes) of the classes in `wanted` (id, at)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams_of = Grams(n)
        for batch in batches:
            sets = [grams_of(text).tobytes() for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["id", "grams"])

    texts = rows.select(F.col("__at").alias("at"), whole().alias("text")).join(wanted, "at").select("id", "text")
    return texts.mapInArrow(read, "id BINARY, grams BINARY")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    first = sets.select(F.col("id").alias("a"), F.col("grams").alias("grams_a"))
    second = sets.select(F.col("id").alias("b"), F.col("grams").alias("grams_b"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    joined = pairs.join(first, "a").join(second, "b").select("a", "b", "grams_a", "grams_b")
    return joined.mapInArrow(check, "a BINARY, b BINARY")


def _block_links(similarity: float):
    """For the classes of one or two blocks: copies linked to each (`linked`) and the smallest class reached (`near`)."""

    def link(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        _, low, high = key
        sets = [np.frombuffer(g, np.uint64) for g in rows["grams"]]
        sizes = np.array([len(s) for s in sets])
        grams, column = np.unique(np.concatenate(sets), return_inverse=True)
        row = np.repeat(np.arange(len(sets)), sizes)
        shared = np.bincount(column, minlength=len(grams)) > 1
        place = np.cumsum(shared) - 1
        row, column = row[shared[column]], place[column[shared[column]]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        both = np.zeros((len(sets), len(sets)), np.float32)
        width = int(shared.sum())
        for begin in range(0, width, SLICE):
            left, right = np.searchsorted(column, [begin, begin + SLICE])
            cells = np.zeros((len(sets), min(SLICE, width - begin)), np.float32)
            cells[row[left:right], column[left:right] - begin] = 1
            both += cells @ cells.T
        linked = both >= similarity * (sizes[:, None] + sizes[None, :] - both) - 1e-6
        block = rows["block"].to_numpy()
        if low != high:
            linked &= block[:, None] != block[None, :]
        np.fill_diagonal(linked, False)
        ids = rows["id"].to_numpy()
        rank = np.empty(len(ids), np.int64)
        by_id = sorted(range(len(ids)), key=ids.__getitem__)
        rank[by_id] = np.arange(len(ids))
        reached = rank.copy()
        while True:
            pulled = np.minimum(reached, np.where(linked, reached[None, :], len(ids)).min(1))
            if (pulled == reached).all():
                break
            reached = pulled
        near = [ids[by_id[r]] for r in reached]
        return pd.DataFrame({"id": ids, "linked": linked @ rows["copies"].to_numpy(), "near": near})

    return link


def similar(
    docs: DataFrame, n: int = N, similarity: float = SIMILARITY, recall: float = RECALL, bucket: int = BUCKET, block: int = BLOCK
) -> DataFrame:
    """One row per row of `docs`: doc_id, at, class_id (smallest doc_id it is linked to, over any number of links),
    n_links (rows whose similarity is high enough), kept (one row of each class)."""
    place = place_name(docs)
    return _similar(_slim(located(docs, place), place), n, similarity, recall, bucket, block)


def _slim(rows: DataFrame, place: str) -> DataFrame:
    return rows.select("doc_id", "text", F.col(place).alias("__at"))


def _similar(rows, n=N, similarity=SIMILARITY, recall=RECALL, bucket=BUCKET, block=BLOCK) -> DataFrame:
    signed = settle(signatures(rows, n, *bands_and_rows(similarity, recall)), "jaccard-signatures")
    classes = signed.where(F.col("id").isNotNull()).groupBy("id").agg(
        F.min(F.struct("doc_id", "at")).alias("first"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands")
    )
    classes = settle(classes, "jaccard-classes")
    entries = classes.select("id", F.explode("bands").alias("h"))
    buckets = entries.groupBy("h").agg(F.count(F.lit(1)).alias("members"), F.min("id").alias("lowest")).where("members > 1")
    met = settle(entries.join(buckets, "h"), "jaccard-buckets")

    few = met.where(F.col("members") <= bucket).select("h", "id")
    pairs = few.select("h", F.col("id").alias("a")).join(few.select("h", F.col("id").alias("b")), "h").where("a < b")
    pairs = pairs.select("a", "b").distinct()
    crowd = met.where(F.col("members") > bucket).select(F.col("id").alias("a"), F.col("lowest").alias("b"))
    crowded = not crowd.isEmpty()
    clusters = None
    if crowded:
        clusters = settle(components(crowd), "jaccard-clusters")
        one = clusters.select(F.col("id").alias("a"), F.col("root").alias("root_a"))
        two = clusters.select(F.col("id").alias("b"), F.col("root").alias("root_b"))
        pairs = pairs.join(one, "a", "left").join(two, "b", "left")
        pairs = pairs.where("root_a is null or root_b is null or root_a <> root_b").select("a", "b")
    pairs = settle(pairs, "jaccard-pairs")

    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))
    if crowded:
        ids = ids.unionByName(clusters.select("id"))
    wanted = ids.distinct().join(classes.select("id", "first.at"), "id")
    sets = settle(gram_sets(rows, wanted, n), "jaccard-sets")
    links = settle(verified(pairs, sets, similarity), "jaccard-links")
    ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = ends.join(classes.select(F.col("id").alias("b"), "copies"), "b").select(F.col("a").alias("id"), F.col("copies").alias("linked"))
    edges = links
    if crowded:
        parts = clusters.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
        member = clusters.join(parts, "root").withColumn("block", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        member = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        member = member.select(
            "id", "root", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")
        )
        member = member.join(classes.select("id", "copies"), "id").join(sets, "id")
        found = member.groupBy("root", "low", "high").applyInPandas(
            _block_links(similarity), "id BINARY, linked BIGINT, near BINARY"
        )
        found = settle(found, "jaccard-blocks")
        linked = linked.unionByName(found.select("id", "linked"))
        edges = edges.unionByName(found.where("near <> id").select(F.col("id").alias("a"), F.col("near").alias("b")))
    linked = linked.groupBy("id").agg(F.sum("linked").alias("linked"))
    groups = components(edges)
    known = classes.select("id", "first", "copies").join(groups, "id", "left").withColumn("root", F.coalesce("root", "id"))
    lowest = known.groupBy("root").agg(F.min("first").alias("lowest"))
    known = settle(known.join(lowest, "root").join(linked, "id", "left").select(
        "id", "lowest", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links")
    ), "jaccard-classes-linked")
    return signed.select("doc_id", "at", "id").join(known, "id", "left").select(
        "doc_id", "at", F.when(F.col("id").isNull(), F.col("doc_id")).otherwise(F.col("lowest.doc_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        (F.col("id").isNull() | (F.col("at") == F.col("lowest.at"))).alias("kept"),
    )


def drop_similar(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that stay, one of each class, with all their columns."""
    place = place_name(docs)
    rows = located(docs, place)
    gone = _similar(_slim(rows, place), **options).where(~F.col("kept")).select(F.col("at").alias(place))
    return rows.join(gone, place, "left_anti").select(*docs.columns)
