"""Mixing sources by temperature.

Token shares of the sources are raised to an exponent and normalised. The exponent (0: all sources alike, 1: as they are,
above 1: large sources more than their share) is found by bisection, SPLIT ways at a time: the smallest one whose entropy
does not exceed a target, or under which no source is repeated more often than a limit. A budget of tokens then gives each
source its quota, which is filled by passes over the source. A pass is a block permutation: documents fall into blocks by a
hash, blocks are put in the order of a hash of their number, and documents inside a block in the order of theirs; the last
pass ends where the quota is used up.

Blocks are about the square root of a source's documents in number and size, so running totals are two short windows
however large a source is. Totals are summed before the shuffle, and nothing but a few sums reaches the driver.

Edge cases: a null source counts as the source named by the empty text; a null text counts as empty and costs its end
token; repeated rows are documents each; an empty table gives an empty result; other columns are kept by `realise`.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgertide.llm.work import located, place_name, settle, whole

#: Parts and rounds of the search, the highest exponent tried.
SPLIT, ROUNDS, HIGHEST = 32, 5, 1024.0


@dataclass(frozen=True)
class Target:
    """What the mix is to meet: an entropy as a share of the largest possible one, or a limit of repetition.

    `budget` is in tokens; without one it is the smallest that reads the largest-share source once, so that every
    document is taken at least once, or, where an entropy target takes an exponent above 1 and so asks for less of the
    small sources, as many tokens as there are.
    """

    entropy: float | None = None
    repeat: float | None = None
    budget: int | None = None


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, tokens (words, and one for the end), at (the row's place), key (a hash for the order)."""
    return docs.select(
        "doc_id", F.coalesce("source", F.lit("")).alias("source"),
        (F.regexp_count(whole(), F.lit(r"\S+")) + 1).cast("long").alias("tokens"), F.col("__at").alias("at"),
        F.xxhash64("doc_id", whole(), F.lit(17)).alias("key"),
    )


def measures(totals: DataFrame, total: int, exponents: list[float]) -> list[tuple[float, float, float, float]]:
    """For each exponent the entropy of the weights and the highest repetition per token of the lowest one, all sources.

    Powers are of tokens over those of the largest source, so that none but those of negligible sources vanish.
    """
    top = totals.agg(F.max("tokens")).first()[0]
    of_top, share = F.col("tokens") / F.lit(top), F.col("tokens") / F.lit(total)
    columns = []
    for k, a in enumerate(exponents):
        p = F.pow(of_top, F.lit(a))
        columns += [F.sum(p).alias(f"z{k}"), F.sum(p * F.log(of_top)).alias(f"l{k}"),
                    F.max(p / share).alias(f"h{k}"), F.min(p / share).alias(f"m{k}")]
    row = totals.agg(*columns).first()
    return [
        (math.log(row[f"z{k}"]) - a * row[f"l{k}"] / row[f"z{k}"],
         row[f"h{k}"] / row[f"m{k}"] if row[f"m{k}"] else math.inf, row[f"h{k}"] / row[f"z{k}"], row[f"m{k}"] / row[f"z{k}"])
        for k, a in enumerate(exponents)
    ]


def exponent(totals: DataFrame, total: int, sources: int, target: Target) -> float:
    """The smallest exponent that meets the target, by repeated division of an interval.

    A limit of repetition is met at 1 (the shares as they are) at the latest. An entropy below that of the shares needs an
    exponent above 1: the upper end is doubled until it is met, to HIGHEST at most. Sources of equal shares keep their
    entropy at every exponent; where no exponent meets the target the shares stay as they are, and `met` tells so.
    """

    def tell(found: tuple) -> bool:
        entropy, spread, most, _ = found
        if target.entropy is not None:
            return entropy <= target.entropy * math.log(max(sources, 1)) + 1e-12
        repeated = spread if target.budget is None else most * target.budget / total
        return repeated <= target.repeat * (1 + 1e-12)

    low, high = 0.0, 1.0
    if target.entropy is not None:
        ends = [2.0**k for k in range(int(math.log2(HIGHEST)) + 1)]
        good = [tell(x) for x in measures(totals, total, ends)]
        if True not in good:
            return 1.0
        first = good.index(True)
        low, high = (ends[first - 1], ends[first]) if first else (0.0, 1.0)
    for _ in range(ROUNDS):
        tried = [low + (high - low) * k / SPLIT for k in range(SPLIT + 1)]
        good = [tell(x) for x in measures(totals, total, tried)]
        if good[0]:
            return low
        first = good.index(True) if True in good else SPLIT
        low, high = tried[first - 1], tried[first]
    return high


def entropy_share(totals: DataFrame, total: int, sources: int, a: float) -> float:
    """Entropy of the weights at an exponent as a share of the largest possible one."""
    return measures(totals, total, [a])[0][0] / math.log(sources) if sources > 1 else 1.0


def plan(docs: DataFrame, target: Target) -> DataFrame:
    """One row per copy of a document that the mix takes.

    at (place of the row), doc_id, source, tokens, weight (of its source), copy (the pass, from 0), begin (tokens of the
    source before it), position (the same as a share of the source's quota: sorting by it interleaves the sources),
    entropy (of the weights, as a share of the largest), met (whether an entropy target is met).
    """
    slim = settle(sized(docs), "mix-sizes")
    totals = settle(
        slim.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("documents")), "mix-totals"
    )
    row = totals.agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"), F.max("tokens").alias("top")).first()
    total, sources, top = row.t or 1, row.n, row.top or 1
    a = exponent(totals, total, sources, target) if sources else 1.0
    _, _, _, least = measures(totals, total, [a])[0] if sources else (0, 0, 0, 1.0)
    budget = target.budget if target.budget is not None else math.ceil(total / least) if a <= 1 else total
    entropy = entropy_share(totals, total, sources, a) if sources else 1.0
    met = target.entropy is None or entropy <= target.entropy + 1e-9
    power = F.pow(F.col("tokens") / top, F.lit(a))
    z = totals.agg(F.sum(power).alias("z")).first().z or 1.0
    weights = totals.select(
        "source", "documents", F.col("tokens").alias("source_tokens"),
        (power / z).alias("weight"),
    )
    quota = F.round(F.col("weight") * budget).cast("long")
    weights = weights.withColumn("quota", quota).withColumn("full", F.floor(F.col("quota") / F.col("source_tokens")))
    weights = weights.withColumn("blocks", F.ceil(F.sqrt("documents")).cast("int"))
    copies = (
        slim.join(weights, "source")
        .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full"))))
        .withColumn("block", F.pmod(F.xxhash64("key", "copy"), F.col("blocks")))
        .withColumn("turn", F.xxhash64("copy", "key", F.lit(29)))
    )
    own = Window.partitionBy("source", "copy", "block").orderBy("turn", "doc_id", "at").rowsBetween(Window.unboundedPreceding, 0)
    inside = copies.withColumn("until", F.sum("tokens").over(own))
    blocks = slim.join(weights, "source").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full"))))
    blocks = blocks.groupBy("source", "copy", F.pmod(F.xxhash64("key", "copy"), F.col("blocks")).alias("block"))
    blocks = blocks.agg(F.sum("tokens").alias("block_tokens"))
    ahead = Window.partitionBy("source", "copy").orderBy(F.xxhash64("source", "copy", "block"), "block")
    blocks = blocks.withColumn("ahead", F.sum("block_tokens").over(ahead.rowsBetween(Window.unboundedPreceding, 0)) - F.col("block_tokens"))
    placed = inside.join(blocks, ["source", "copy", "block"])
    end = F.col("copy") * F.col("source_tokens") + F.col("ahead") + F.col("until")
    placed = placed.withColumn("begin", end - F.col("tokens")).where(end <= F.col("quota"))
    return placed.select(
        "at", "doc_id", "source", "tokens", "weight", "copy", "begin", (F.col("begin") / F.col("quota")).alias("position"),
        F.lit(entropy).alias("entropy"), F.lit(met).alias("met"),
    )


def mix(docs: DataFrame, target: Target) -> DataFrame:
    place = place_name(docs)
    return plan(_slim(located(docs, place), place), target)


def _slim(rows: DataFrame, place: str) -> DataFrame:
    return rows.select("doc_id", "source", "text", F.col(place).alias("__at"))


def realise(docs: DataFrame, target: Target) -> DataFrame:
    """The rows of `docs`, all columns, as often as the mix takes them and in its order.

    Parts are ranges of the position, rows sorted inside them, so a reader that takes the written files by name and
    their rows in turn meets the sources interleaved and the copies of a document a whole pass apart.
    """
    place = place_name(docs)
    rows = located(docs, place)
    taken = plan(_slim(rows, place), target)
    turn = place_name(docs, "__turn")
    taken = taken.select(F.col("at").alias(place), F.struct("position", "copy", "at").alias(turn))
    mixed = rows.join(taken, place).repartitionByRange(turn).sortWithinPartitions(turn)
    return mixed.select(*docs.columns)
