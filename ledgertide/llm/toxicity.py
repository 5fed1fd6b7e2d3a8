"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence gets a logistic score of its words, whose weights are sums over hashed
features (the word, its first and last letters); the document's score is the sentences' noisy-or, one minus the product of (1 - p). Only document labels are known, so the weights are trained on the noisy-or:
a toxic document pulls up the sentences that already look worst, a clean one pushes all of its sentences down. Scored
documents also tell where their worst sentence is.

The classifier is fitted on at most SAMPLE labelled documents of each label, taken in the order of a hash of doc_id, with
weights that restore the share of each label. All else works on every document and on whole texts.

Edge cases: null and empty texts are one sentence without words; a null doc_id counts as not held out and is not learned
from; labels that are null are not learned from, and contradicting labels of a document all count; without any label of
one kind every score is the share of toxic labels (0 without labels); other columns are ignored, and kept by `clean`.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgertide.llm.work import whole

#: Labelled documents of each label that the classifier is fitted on at most, and its hashed words.
SAMPLE, BUCKETS = 3000, 1 << 20
#: Lengths of the beginnings and ends of a word that are features beside the word.
AFFIXES = (3, 4, 5)
EPOCHS, RATE, LASSO, START = 100, 1.0, 1e-4, -10.0
HELD_OUT = 5

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"\w+")


def held_out(doc_id: str | Column = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id) % HELD_OUT == 0, F.lit(False))


def features(word: str) -> list[int]:
    """Hashed features of a word."""
    named = [word, *(f"{word[:n]}-" for n in AFFIXES if n < len(word)), *(f"-{word[-n:]}" for n in AFFIXES if n < len(word))]
    return [zlib.crc32(name.encode()) & (BUCKETS - 1) for name in named]


def sentences(text: str) -> list[tuple[int, int, str]]:
    """Begin, end and lower-case form of each sentence; a text without any is one empty sentence."""
    found = [(m.start(), m.end(), m.group().lower()) for m in SENTENCE.finditer(text)]
    return found or [(0, 0, "")]


class Model:
    """Weights of hashed words and the score of a sentence without words."""

    def __init__(self, weights: dict[int, float], start: float):
        self.weights, self.start = weights, start

    def scorer(self, room: int = 500_000):
        """A function from a text to (score, begin, end, score of the worst sentence)."""
        weights, start, known = self.weights, self.start, {}

        class Known(dict):
            def __missing__(self, word):
                if len(self) > room:
                    self.clear()
                found = self[word] = sum(weights.get(f, 0.0) for f in features(word))
                return found

        known = Known()

        def score(text: str) -> tuple[float, int, int, float]:
            worst, at, clean = -np.inf, (0, 0), 0.0
            for begin, end, sentence in sentences(text):
                z = start
                for weight in map(known.__getitem__, set(WORD.findall(sentence))):
                    z += weight
                if z > worst:
                    worst, at = z, (begin, end)
                clean += np.logaddexp(0.0, z) if z > -30 else 0.0
            return float(-np.expm1(-clean)), *at, float(1 / (1 + np.exp(-worst)))

        return score


def train(bags: pa.Array, labels: list[int], importance: list[float]) -> Model:
    """Fit the weights to bags of sentences (lists of lists of words), by Adagrad with an L1 shrinkage."""
    in_bags = bags.flatten()
    words = in_bags.flatten().dictionary_encode()
    index = words.indices.to_numpy()
    of_sentence = np.repeat(np.arange(len(in_bags)), in_bags.value_lengths().to_numpy())
    of_bag = np.repeat(np.arange(len(bags)), bags.value_lengths().to_numpy())
    made = [features(w) for w in words.dictionary.to_pylist()]
    of_word = np.repeat(np.arange(len(made)), [len(x) for x in made])
    used, feature = np.unique(np.fromiter((f for x in made for f in x), np.int64), return_inverse=True)
    y, c = np.array(labels, float), np.array(importance, float)
    c /= c.sum()
    w, b = np.zeros(len(used)), START
    seen_w, seen_b = np.full(len(used), 1e-8), 1e-8
    for _ in range(EPOCHS):
        by_word = np.bincount(of_word, w[feature], len(made))
        z = np.clip(b + np.bincount(of_sentence, by_word[index], len(in_bags)), -30, 30)
        p = 1 / (1 + np.exp(-z))
        dirty = -np.expm1(-np.bincount(of_bag, np.logaddexp(0, z), len(bags)))
        # derivative of the log loss by z: p for clean bags, -(1 - P) / P * p for toxic ones
        pull = np.where(y > 0, -(1 - dirty) / np.maximum(dirty, 1e-12), 1.0) * c
        by_z = pull[of_bag] * p
        by_w = np.bincount(feature, np.bincount(index, by_z[of_sentence], len(made))[of_word], len(used))
        by_b = by_z.sum()
        seen_w += by_w**2
        seen_b += by_b**2
        step = RATE / np.sqrt(seen_w)
        w -= step * by_w
        w = np.sign(w) * np.maximum(np.abs(w) - step * LASSO, 0)
        b -= RATE / np.sqrt(seen_b) * by_b
    kept = w != 0
    return Model(dict(zip(used[kept].tolist(), w[kept].tolist(), strict=True)), float(b))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from the labels of documents that are not held out."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    known = known.select("doc_id", "toxic")
    counts = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    if len(counts) < 2:
        share = counts.get(1, 0) / total if total else 0.0
        return Model({}, float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    parts = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for y in (0, 1)]
    chosen = parts[0].unionByName(parts[1]).distinct()  # at most two samples of ids: small enough to send everywhere

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                [sorted(set(WORD.findall(s))) for _, _, s in sentences(text)]
                for text in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.list_(pa.string())))], ["toxic", "bag"])

    rows = docs.select("doc_id", whole().alias("text")).join(F.broadcast(chosen), "doc_id").select("toxic", "text")
    rows = rows.mapInArrow(bags, "toxic INT, bag ARRAY<ARRAY<STRING>>").toArrow()
    y = rows.column("toxic").to_pylist()
    if len(set(y)) < 2:
        share = counts[1] / total
        return Model({}, float(np.log(share / (1 - share))))
    drawn = {v: y.count(v) for v in (0, 1)}
    return train(rows.column("bag").combine_chunks(), y, [counts[v] / drawn[v] for v in y])


SCORES = "score DOUBLE, sentence_start INT, sentence_end INT, sentence_score DOUBLE"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of `docs` in a struct `doc`, with score and place of the worst sentence (in code points)."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = model.scorer()
        for batch in batches:
            doc = batch.column(0)
            found = [judge(text or "") for text in doc.field(doc.type.get_field_index("text")).to_pylist()]
            value, begin, end, worst = zip(*found, strict=True) if found else ((),) * 4
            yield pa.RecordBatch.from_arrays(
                [doc, pa.array(value, pa.float64()), pa.array(begin, pa.int32()), pa.array(end, pa.int32()),
                 pa.array(worst, pa.float64())],
                ["doc", "score", "sentence_start", "sentence_end", "sentence_score"],
            )

    return rows.mapInArrow(scored, f"doc {rows.schema['doc'].dataType.simpleString()}, {SCORES}")


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that are not predicted toxic."""
    return score(docs, fit(docs, labels)).where("score < 0.5").select("doc.*")
