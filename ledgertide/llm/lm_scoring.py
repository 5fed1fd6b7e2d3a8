"""Scoring by a log-bilinear language model trained with noise-contrastive estimation.

Token counts are taken over all training documents. Every word falls into a bucket, the end of a text into one of its own:
frequent words have a bucket each, all others share hashed buckets; the number of buckets grows with the square root of the
number of distinct words. The model predicts the bucket from the two buckets before, h = r_u A + r_v B, in two softmaxes of
about the square root of the buckets each: the group (buckets of like rank), then the bucket within the group. A word in a
hashed bucket also pays its smoothed share of the bucket's tokens, so probabilities over all words add up to one.

Training is noise-contrastive in both softmaxes. It goes in ROUNDS rounds, each over its own part of the documents: every task
trains a copy of the last average on all of its documents of the round, and the copies are averaged, weighted by tokens.

Texts are read into bucket numbers once; training and scoring read those. Counts of the HEAD most frequent words travel with the
tasks; the other words of a document meet their counts in a join on the word. The averaged weights grow with the square root of the distinct words; counts, their shuffle and the join grow with the corpus.

Edge cases: null and empty texts are the end token alone; a null doc_id counts as training; without training documents
every count is 0 and the model is uniform over its buckets; repeated rows count and are scored each; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgertide.llm.work import BATCH_ROWS, settle, whole

#: Buckets for each square root of the distinct words and at least, size of the vectors, noise groups of a step, noise buckets of
#: a group in a step, tokens of a step, learning rate, rounds of training.
BUCKETS, LEAST, SIZE, NOISE, NEAR, STEP, RATE, ROUNDS = 16, 512, 32, 48, 16, 4096, 0.12, 3
#: Squared slopes that rows of single buckets start from.
PAST = 1e-8
#: Words whose counts travel with the tasks; copies averaged in a group; parameters in a block.
HEAD, FAN, CHUNK = 200_000, 64, 1 << 16
#: Batches whose tokens are counted together; tokens that are trained on together; bytes of text read together.
GATHER, GATHERED, TEXT_BYTES = 16, 1 << 16, 4 << 20
#: Tokens scored together; tokens for each bucket from which exponentials are tabled, buckets or groups in a table at once; rows
#: beyond which a run is summed by itself; tokens in a product of scoring, and of training, so that they stay in the cache.
SCORED, TABLED, ACROSS, LONG, AT_ONCE, NEARBY = 1 << 20, 4, 64, 8, 1024, 1024


def held_out(doc_id: str | Column = "doc_id") -> Column:
    text = F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(text) % 7 == 2, F.lit(False))


def tokenise(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts in a row with A-Z lower-cased, and how many each text has."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, sizes = split.flatten(), split.value_lengths().to_numpy(zero_copy_only=False)
    filled = pc.greater(pc.binary_length(words), 0)
    if not pc.all(filled).as_py():  # blanks at the ends of a text
        mask = filled.to_numpy(zero_copy_only=False)
        sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[mask], minlength=len(sizes))
        words = words.filter(filled)
    return words, sizes


def count_words(docs: DataFrame) -> DataFrame:
    """word, n over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] = []

        def told() -> pa.RecordBatch:
            found = pc.value_counts(pa.concat_arrays(held))
            held.clear()
            return pa.RecordBatch.from_arrays([found.field(0), found.field(1)], ["word", "n"])

        for batch in batches:
            words, _ = tokenise(batch.column(0))
            held.append(words)
            if len(held) >= GATHER:
                yield told()
        if held:
            yield told()

    partial = docs.select(whole().alias("text")).mapInArrow(count, "word STRING, n BIGINT")
    return partial.groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Classes:
    """Counts that travel with the tasks: words by falling frequency, and the totals of the rest."""

    words: list[str]
    counts: np.ndarray
    documents: int
    tokens: int
    types: int
    #: Tokens and distinct words of each hashed bucket.
    hashed: np.ndarray | None = None
    hashed_types: np.ndarray | None = None

    @property
    def half(self) -> int:
        return max(LEAST, int(BUCKETS * math.sqrt(self.types))) // 2

    @property
    def own(self) -> int:
        return min(self.half, len(self.words))

    @property
    def end(self) -> int:
        return self.own

    @property
    def shared(self) -> int:
        """Hashed buckets."""
        return min(self.half, max(1, self.types - self.own))

    @property
    def start(self) -> int:
        return self.own + 1 + self.shared

    def bucket(self, word: str) -> int:
        """The hashed bucket of a word, from 0."""
        return zlib.crc32(word.encode()) % self.shared

    def fill(self, counts: DataFrame) -> None:
        """Sum the words that have no bucket of their own by hashed bucket."""
        found = counts.groupBy((F.crc32("word") % self.shared).cast("int").alias("k")).agg(
            F.sum("n").alias("n"), F.count(F.lit(1)).alias("types")
        ).toArrow()  # at most a row per bucket
        self.hashed, self.hashed_types = np.zeros(self.shared, np.int64), np.zeros(self.shared, np.int64)
        at = found.column("k").to_numpy()
        self.hashed[at], self.hashed_types[at] = found.column("n").to_numpy(), found.column("types").to_numpy()
        of_own = np.array([self.bucket(w) for w in self.words[: self.own]], np.int64)
        np.subtract.at(self.hashed, of_own, self.counts[: self.own])
        np.subtract.at(self.hashed_types, of_own, 1)

    def frequencies(self) -> np.ndarray:
        """Tokens of each bucket, at least a little."""
        return np.maximum(np.concatenate([self.counts[: self.own], [self.documents], self.hashed]).astype(float), 0.5)

    def shared_mass(self) -> np.ndarray:
        """What smoothed shares within a hashed bucket are divided by: its tokens, its types, one unseen type."""
        return (self.hashed + self.hashed_types + 1).astype(float)

    def kinds_of_head(self) -> np.ndarray:
        """Buckets of the words that travel with the tasks."""
        hashed = [self.own + 1 + self.bucket(w) for w in self.words[self.own :]]
        return np.concatenate([np.arange(self.own), np.array(hashed, np.int64)]).astype(np.int32)


def context_of(now: np.ndarray, sizes: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Previous and second previous bucket of every token of documents of the given sizes."""
    begins = np.cumsum(sizes) - sizes
    before = np.concatenate([[start], now[:-1]])
    before[begins] = start
    second = np.concatenate([[start], before[:-1]])
    second[begins] = start
    return before, second


class Model:
    """The log-bilinear model; all parameters lie in one array so that copies can be averaged."""

    def __init__(self, frequencies: np.ndarray, values: np.ndarray | None = None):
        self.classes = n = len(frequencies)
        self.width = math.ceil(math.sqrt(n))
        self.small = np.uint16 if n < 1 << 16 else np.int64  # sorted by digits where it can be
        starts = np.arange(0, n, self.width)
        self.groups, d = len(starts), SIZE
        shapes = [(n + 1, d), (d, d), (d, d), (n, d), (n,), (self.groups, d), (self.groups,)]
        total = sum(math.prod(s) for s in shapes)
        self.frequencies = frequencies
        self.mass = np.add.reduceat(frequencies, starts)
        if values is None:
            values = np.random.default_rng(7).normal(0, 0.1, total).astype(np.float32)
        self.values, self.parts, at = values, [], 0
        for shape in shapes:
            self.parts.append(values[at : at + math.prod(shape)].reshape(shape))
            at += math.prod(shape)
        self.r, self.a, self.b, self.q, self.bias, self.group_q, self.group_bias = self.parts
        self.ab = values[self.r.size : self.r.size + 2 * d * d].reshape(2 * d, d)  # a over b

    def __reduce__(self):
        return Model, (self.frequencies, self.values)

    def copy(self) -> Model:
        return Model(self.frequencies, self.values.copy())

    @classmethod
    def fresh(cls, frequencies: np.ndarray) -> Model:
        """The model training starts from: frequencies, hardly any context."""
        found = cls(frequencies)
        found.bias[:] = np.log(found.near())
        found.group_bias[:] = np.log(found.mass / found.mass.sum())
        found.a[:] += 0.5 * np.eye(SIZE, dtype=np.float32)
        found.b[:] += 0.5 * np.eye(SIZE, dtype=np.float32)
        return found

    def near(self) -> np.ndarray:
        """Share of each bucket in its group."""
        return self.frequencies / self.mass[np.arange(self.classes) // self.width]

    def trainer(self, seed: int):
        """A function that takes steps of noise-contrastive estimation over tokens (Adagrad).

        The tokens of a step are sorted by bucket, so those of one group lie together: they share the noise drawn for their
        group, and all products are of dense matrices, groups of like size in one call.
        """
        random = np.random.default_rng(seed)
        seen = Model(self.frequencies, np.full_like(self.values, 1e-3))
        for part in (seen.r, seen.q, seen.bias):  # a row that a step meets once has a slope of 1 / STEP of its token's
            part[:] = PAST
        noise = self.mass / self.mass.sum()
        log_noise, log_near = np.log(NOISE * noise).astype(np.float32), np.log(NEAR * self.near()).astype(np.float32)
        reach, up_to = np.concatenate([[0.0], np.cumsum(self.frequencies)]), np.cumsum(noise)
        up_to /= up_to[-1]

        def move(part, past, slope):
            past += slope**2
            part -= RATE * slope / np.sqrt(past)

        def add_up(index, rows):
            """The numbers in index and the sum of the rows of each."""
            index = index.astype(self.small)
            order = np.argsort(index, kind="stable")
            ordered = index.take(order)
            at = runs(ordered)
            by_size, found = run_sums(at, rows.take(order, 0))
            return ordered[at[by_size]].astype(np.int64), found

        def move_rows(part, past, touched, slope):
            now = past.take(touched, 0)
            now += slope * slope
            put_rows(past, touched, now)
            np.sqrt(now, out=now)
            slope *= RATE
            slope /= now
            moved = part.take(touched, 0)
            moved -= slope
            put_rows(part, touched, moved)

        def slopes(x, size):
            """size / (1 + exp(x)) in the place of x: slope of the loss of good pairs at x (size < 0) and bad ones at -x."""
            with np.errstate(over="ignore"):
                np.exp(x, out=x)
            x += 1
            return np.divide(np.float32(size), x, out=x)

        def step(now, before, second):
            n, order = len(now), np.argsort(now.astype(self.small), kind="stable")
            now, before, second = now.take(order), before.take(order), second.take(order)
            context, group = np.column_stack([before, second]), now // self.width
            both, by_h = np.empty((n, 2 * SIZE), np.float32), np.empty((n, SIZE), np.float32)
            padded, good = np.zeros((n + 1, SIZE), np.float32), np.empty(n, np.float32)  # the row of zeros fills up blocks
            h = padded[:n]
            drawn = np.searchsorted(up_to, random.random(NOISE), "right")
            minus_q, bias = -self.group_q[drawn], self.group_bias - log_noise
            to_drawn, of_drawn = np.zeros((NOISE, SIZE), np.float32), np.zeros(NOISE, np.float32)
            for k in range(0, n, NEARBY):
                part = slice(k, k + NEARBY)
                at_h, at_group = h[part], group[part]
                both[part] = self.r.take(context[part], 0).reshape(-1, 2 * SIZE)
                np.matmul(both[part], self.ab, out=at_h)
                own_q = self.group_q.take(at_group, 0)
                good[part] = slopes(np.einsum("ij,ij->i", at_h, own_q) + bias[at_group], -1 / n)
                bad = at_h @ minus_q.T
                bad -= bias[drawn]
                bad = slopes(bad, 1 / n)
                own_q *= good[part, None]
                np.subtract(own_q, bad @ minus_q, out=by_h[part])
                to_drawn += bad.T @ at_h
                of_drawn += np.ones(len(bad), np.float32) @ bad
            first = runs(group)
            there, sizes = group[first], np.diff(first, append=n)
            to_group, to_bias = np.zeros_like(self.group_q), np.zeros_like(self.group_bias)
            to_bias[there] = np.add.reduceat(good, first)
            drawn_once = np.zeros((self.groups, NOISE), np.float32)
            drawn_once[drawn, np.arange(NOISE)] = 1
            good_of_group = np.append(good, np.float32(0))

            # second softmax: the noise of a group comes from that group
            q, bias = self.q.take(now, 0), self.bias - log_near
            good = slopes(np.einsum("ij,ij->i", h, q) + bias[now], -1 / n)
            q *= good[:, None]
            by_h += q
            low, high = there * self.width, np.minimum((there + 1) * self.width, self.classes)
            at = np.sort(random.random((len(there), NEAR)), 1) * (reach[high] - reach[low])[:, None] + reach[low][:, None]
            other = np.clip(np.searchsorted(reach, at, "right") - 1, low[:, None], high[:, None] - 1)
            minus_q, minus_bias = -self.q.take(other, 0), -bias[other]
            to_other, to_other_bias = np.empty_like(minus_q), np.empty_like(minus_bias)
            by_near = np.empty((n + 1, SIZE), np.float32)
            for k in alike(sizes):
                place = np.arange(sizes[k[-1]])
                tokens = np.where(place < sizes[k][:, None], first[k][:, None] + place, n)
                at_h, at_q = padded.take(tokens, 0), minus_q.take(k, 0)
                bad = at_h @ at_q.transpose(0, 2, 1)
                bad += minus_bias[k][:, None]
                bad = slopes(bad, 1 / n)
                bad_t = bad.transpose(0, 2, 1)
                to_other[k] = bad_t @ at_h
                to_other_bias[k] = (bad_t @ (tokens < n).astype(np.float32)[:, :, None])[:, :, 0]
                to_group[there[k]] = (good_of_group.take(tokens)[:, None] @ at_h)[:, 0]
                put_rows(by_near, tokens.ravel(), (bad @ at_q).reshape(-1, SIZE))
            by_h -= by_near[:n]
            to_group += drawn_once @ to_drawn
            to_bias += drawn_once @ of_drawn
            own = runs(now)
            np.multiply(good[:, None], h, out=q)
            by_size, to_own = run_sums(own, q)
            own, own_bias = own[by_size], np.add.reduceat(good, own)[by_size]
            other = other.ravel()
            kept = runs(other)
            by_size, to_other = run_sums(kept, to_other.reshape(-1, SIZE))
            kept, other_bias = kept[by_size], np.add.reduceat(to_other_bias.ravel(), kept)[by_size]

            to_ab = both.T @ by_h
            contexts = [(*add_up(where, by_h), by.T.copy()) for where, by in ((before, self.a), (second, self.b))]
            for touched, by_row, by_bias in ((now[own], to_own, own_bias), (other[kept], to_other, other_bias)):
                move_rows(self.q, seen.q, touched, by_row)
                move_rows(self.bias, seen.bias, touched, by_bias)
            for touched, by_row, by in contexts:
                move_rows(self.r, seen.r, touched, by_row @ by)
            move(self.group_q, seen.group_q, to_group)
            move(self.group_bias, seen.group_bias, to_bias)
            move(self.ab, seen.ab, to_ab)

        return step

    def scorer(self):
        """A function from tokens to natural log-probabilities of their buckets, normalised over all buckets.

        A sum of exp((x + y) q) over many tokens is taken from the exponentials of xq and yq, worked out once for every
        bucket before and second before, where those are far from the ends of what floats hold.
        """
        of_before, of_second = self.r @ self.a, self.r @ self.b

        def context(before, second):
            found = of_before.take(before, 0)
            found += of_second.take(second, 0)
            return found

        def totals(before, second, weights, bias):
            """Log of the sum over weights for each token."""
            n, total = len(before), np.zeros(len(before), np.float32)
            if n > TABLED * len(of_before):
                for k in range(0, weights.shape[1], ACROSS):
                    x, y = of_before @ weights[:, k : k + ACROSS], of_second @ weights[:, k : k + ACROSS]
                    y += bias[k : k + ACROSS]
                    if max(-x.min(), x.max(), -y.min(), y.max()) > 40:
                        break
                    np.exp(x, out=x)
                    np.exp(y, out=y)
                    for i in range(0, n, AT_ONCE):
                        part = slice(i, i + AT_ONCE)
                        total[part] += np.einsum("ij,ij->i", x.take(before[part], 0), y.take(second[part], 0))
                else:
                    return np.log(total)
            weights, shares = np.ascontiguousarray(weights), np.exp(bias)
            z = np.empty((AT_ONCE, weights.shape[1]), np.float32)
            with np.errstate(over="ignore"):
                for i in range(0, n, AT_ONCE):
                    part = slice(i, i + AT_ONCE)
                    h = context(before[part], second[part])
                    at_z = np.matmul(h, weights, out=z[: len(h)])
                    np.matmul(np.exp(at_z, out=at_z), shares, out=total[part])
            beyond = np.flatnonzero(~((total > 1e-30) & (total < 1e30)))  # what floats do not hold
            total[beyond] = 1
            out = np.log(total)
            for k in beyond:
                z = (of_before[before[k]] + of_second[second[k]]) @ weights + bias
                out[k] = z.max() + np.log(np.exp(z - z.max()).sum())
            return out

        def score(now, before, second):
            out = np.empty(len(now))
            for k in range(0, len(now), SCORED):
                part = slice(k, k + SCORED)
                order = np.argsort(now[part].astype(self.small), kind="stable")
                sorted_now, x, y = now[part][order], before[part][order], second[part][order]
                group, found = sorted_now // self.width, np.empty(len(order))
                for i in range(0, len(found), AT_ONCE):
                    rows = slice(i, i + AT_ONCE)
                    q = self.group_q.take(group[rows], 0) + self.q.take(sorted_now[rows], 0)
                    found[rows] = np.einsum("ij,ij->i", context(x[rows], y[rows]), q)
                found += self.group_bias[group] + self.bias[sorted_now]
                found -= totals(x, y, self.group_q.T, self.group_bias)
                bounds = np.searchsorted(group, np.arange(self.groups + 1))
                for g in np.flatnonzero(np.diff(bounds)):
                    rows, those = slice(bounds[g], bounds[g + 1]), slice(g * self.width, (g + 1) * self.width)
                    found[rows] -= totals(x[rows], y[rows], self.q[those].T, self.bias[those])
                out[part][order] = found
            return out

        return score


def runs(ordered: np.ndarray) -> np.ndarray:
    """Where each run of equal numbers starts."""
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))


def run_sums(starts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the runs, longest first, and the sum of the rows of each: long runs one by one, the others row by row."""
    sizes = np.diff(starts, append=len(rows))
    shorter = len(rows) - sizes
    by_size = np.argsort(shorter.astype(np.uint16) if len(rows) < 1 << 16 else shorter, kind="stable")
    starts, sizes = starts[by_size], sizes[by_size]
    found = rows.take(starts, 0)
    ones = np.ones(sizes[0], rows.dtype)
    longer = np.searchsorted(-sizes, -np.arange(1, LONG + 1))  # runs of more than so many rows
    for k, (i, n) in enumerate(zip(starts[: longer[-1]].tolist(), sizes[: longer[-1]].tolist(), strict=True)):
        np.matmul(ones[:n], rows[i : i + n], out=found[k])
    for k, n in enumerate(longer[:-1].tolist(), 1):
        found[longer[-1] : n] += rows.take(starts[longer[-1] : n] + k, 0)
    return by_size, found


def alike(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Numbers of the sizes, put together where they differ by less than half and a few; the largest of each comes last."""
    order = np.argsort(sizes, kind="stable")
    ordered, at = sizes[order], 0
    while at < len(order):
        to = int(np.searchsorted(ordered, ordered[at] * 1.5 + 4, "right"))
        yield order[at:to]
        at = to


def put_rows(part: np.ndarray, touched: np.ndarray, rows: np.ndarray) -> None:
    """part[touched] = rows, each row copied as one item."""
    if part.ndim > 1:
        whole_row = f"V{part.itemsize * part.shape[1]}"
        part, rows = part.view(whole_row)[:, 0], np.ascontiguousarray(rows).view(whole_row)[:, 0]
    part[touched] = rows


def gathered(batches: Iterator[pa.RecordBatch], column: int, least: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until the column holds `least` bytes; rows are not cut."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += pc.sum(pc.binary_length(batch.column(column))).as_py() or 0
        if size >= least:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


CODED = (
    "row BIGINT, doc_id BIGINT, held_out BOOLEAN, n_tokens BIGINT, n_known BIGINT, logs DOUBLE, other_logs DOUBLE, "
    "rare ARRAY<STRUCT<word: STRING, n: INT>>, kinds BINARY"
)


def coded_rows(docs: DataFrame, classes: Classes) -> DataFrame:
    """Per document the buckets of its tokens (32-bit numbers), sums over words in the head, and the words outside the head."""
    sent = docs.sparkSession.sparkContext.broadcast((classes, pa.array(classes.words, pa.string()), classes.kinds_of_head()))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, head, kinds_of_head = sent.value
        own, first, shared = known.own, known.own + 1, known.shared
        row = TaskContext.get().partitionId() << 40
        logs_of = np.log10(np.append(known.counts, 0) + 1.0)  # the last one for words outside the head
        end_log = math.log10(known.documents + 1)
        for batch in gathered(batches, 2, TEXT_BYTES):
            n = batch.num_rows
            words, sizes = tokenise(batch.column(2))
            number = pc.fill_null(pc.index_in(words, head), -1).to_numpy(zero_copy_only=False)
            doc, rare = np.repeat(np.arange(n), sizes), number < 0
            other = words.filter(pa.array(rare)).dictionary_encode()
            kind = np.append(kinds_of_head, np.int32(0))[number]
            hashed = [first + zlib.crc32(w) % shared for w in other.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)]
            of_other = other.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            kind[rare] = np.array(hashed, np.int32)[of_other]
            logs = np.bincount(doc, logs_of[number], n).astype(float) + end_log
            found = np.bincount(doc, ~rare, n).astype(np.int64) + (known.documents > 0)
            other_logs = np.bincount(doc, logs_of[number] * (rare | (number >= own)), n).astype(float)
            types = max(1, len(other.dictionary))
            pair, times = np.unique(doc[rare] * types + of_other, return_counts=True)
            lists = pa.ListArray.from_arrays(
                pa.array(np.searchsorted(pair // types, np.arange(n + 1)), pa.int32()),
                pa.StructArray.from_arrays(
                    [other.dictionary.take(pa.array(pair % types)), pa.array(times, pa.int32())], ["word", "n"]
                ),
            )
            ends = np.cumsum(sizes + 1)
            now = np.full(int(ends[-1]), known.end, "<i4")
            is_word = np.ones(len(now), bool)
            is_word[ends - 1] = False
            now[is_word] = kind
            bounds = np.concatenate([[0], ends * 4]).tolist()
            stored = now.tobytes()
            whole_batch = pa.RecordBatch.from_arrays(
                [pa.array(row + np.arange(n)), batch.column(0), batch.column(1), pa.array(sizes + 1, pa.int64()), pa.array(found),
                 pa.array(logs), pa.array(other_logs), lists,
                 pa.array([stored[i:j] for i, j in zip(bounds, bounds[1:], strict=False)], pa.binary())],
                ["row", "doc_id", "held_out", "n_tokens", "n_known", "logs", "other_logs", "rare", "kinds"],
            )
            for k in range(0, n, BATCH_ROWS):
                yield whole_batch.slice(k, BATCH_ROWS)
            row += n

    return docs.select("doc_id", held_out().alias("held_out"), whole().alias("text")).mapInArrow(code, CODED)


def tokens_of(column: pa.Array, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of the documents, then bucket, previous and second previous bucket of each token."""
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False) // 4
    now = np.frombuffer(b"".join(column.to_pylist()), "<i4").astype(np.int64)
    return sizes, now, *context_of(now, sizes, start)


def train(coded: DataFrame, classes: Classes) -> Model:
    """Train in rounds over parts of the documents: a copy of the last average per task, then their average."""
    model = Model.fresh(classes.frequencies())
    part = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % ROUNDS, F.lit(0))
    learned = coded.where(~F.col("held_out"))
    for k in range(ROUNDS):
        model = train_round(learned.where(part == k).select("kinds"), classes, model, k)
    return model


def train_round(kinds: DataFrame, classes: Classes, model: Model, number: int) -> Model:
    """Train a copy of the model per task on all its documents and average the copies, at most FAN of them in a group."""
    spark = kinds.sparkSession
    sent, first = spark.sparkContext.broadcast(model), classes.start

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, task = sent.value.copy(), TaskContext.get().partitionId()
        step, tokens = model.trainer(task * ROUNDS + number), 0
        for batch in gathered(batches, 0, GATHERED * 4):
            _, now, before, second = tokens_of(batch.column(0), first)
            for k in range(0, len(now), STEP):
                step(now[k : k + STEP], before[k : k + STEP], second[k : k + STEP])
            tokens += len(now)
        if tokens:
            chunks = [model.values[k : k + CHUNK] for k in range(0, len(model.values), CHUNK)]
            n = len(chunks)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(n), pa.int32()), pa.array([task // FAN] * n, pa.int32()), pa.array([tokens] * n, pa.int64()),
                 pa.array(chunks, pa.list_(pa.float32()))],
                ["chunk", "part", "n", "v"],
            )

    def average(rows: pd.DataFrame) -> pd.DataFrame:
        n = rows["n"].to_numpy()
        v = (np.stack(rows["v"].to_numpy()) * n[:, None]).sum(0) / n.sum()
        return pd.DataFrame({"chunk": rows["chunk"][:1], "part": rows["part"][:1] // FAN, "n": n.sum(), "v": [v.astype(np.float32)]})

    kind = "chunk INT, part INT, n BIGINT, v ARRAY<FLOAT>"
    copies = kinds.mapInArrow(fit, kind)
    for keys in (["chunk", "part"], ["chunk", "part"], ["chunk"]):
        copies = copies.groupBy(*keys).applyInPandas(average, kind)
    found = copies.select("chunk", "v").toArrow().sort_by("chunk")  # one model
    if not found.num_rows:
        return model
    return Model(model.frequencies, found.column("v").combine_chunks().flatten().to_numpy().astype(np.float32))


def class_scores(coded: DataFrame, classes: Classes, model: Model) -> DataFrame:
    """The coded rows with class_score (log10 of the buckets, and shares of hashed ones) instead of their buckets."""
    coded = coded.drop("rare")
    sent = coded.sparkSession.sparkContext.broadcast((model, np.log10(classes.shared_mass()), classes.end, classes.start))
    kept = [c for c in coded.columns if c != "kinds"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, log_mass, end, start = sent.value
        score = model.scorer()
        for batch in gathered(batches, len(kept), SCORED * 4):
            sizes, now, before, second = tokens_of(batch.column(len(kept)), start)
            per_class = score(now, before, second) / math.log(10)
            shared = now > end
            per_class[shared] -= log_mass[now[shared] - end - 1]
            sums = np.add.reduceat(per_class, np.cumsum(sizes) - sizes)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sums)], [*kept, "class_score"])

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in coded.select(*kept).schema) + ", class_score DOUBLE"
    return coded.select(*kept, "kinds").mapInArrow(judge, kind)


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10) per document."""
    learned = docs.where(~held_out())
    counts = settle(count_words(learned), "lm-counts")
    documents = learned.count()
    totals = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("types")).first()
    head = counts.orderBy(F.desc("n"), "word").limit(HEAD).toArrow()  # at most HEAD words
    order = np.argsort(-head.column("n").to_numpy(), kind="stable")
    words = head.column("word").combine_chunks().take(pa.array(order)).to_pylist() if len(order) else []
    classes = Classes(words, head.column("n").to_numpy()[order].astype(np.int64), documents, totals.n or 0, totals.types)
    classes.fill(counts)
    coded = settle(coded_rows(docs, classes), "lm-coded")
    rows = settle(class_scores(coded, classes, train(coded, classes)), "lm-rows")
    rare = coded.select("row", F.explode("rare").alias("x")).select("row", "x.word", F.col("x.n").alias("times"))
    rare = rare.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 1)).alias("rare_logs"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("rare_known"),
    )
    tokens = classes.tokens + documents
    types = classes.types + (documents > 0)
    all_logs = F.col("logs") + F.coalesce("rare_logs", F.lit(0.0))
    other_logs = F.col("other_logs") + F.coalesce("rare_logs", F.lit(0.0))
    return rows.join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (all_logs - F.col("n_tokens") * math.log10(tokens + types + 1)).alias("base_score"),
        (F.col("class_score") + other_logs).alias("score"),
    )
