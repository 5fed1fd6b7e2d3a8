"""Packing documents into training windows by Karmarkar-Karp multiway differencing.

A document's ids, and one end id, are cut into whole windows and a rest; the rest is cut into pieces of at most `piece`
ids. Pieces gather until they fill about `windows` windows; the last one is cut so that the group is only SLACK short
of its windows. The group is then dealt out by differencing: partial partitions with opposing imbalances are merged,
the two most uneven first, largest sums onto smallest, until one near-equal partition is left. Whenever a window would
hold more than its capacity, the number of windows rises by one.

All of it happens where the rows are: no shuffle, a task holds one group, and the last group of a task wastes less than
a window per window count of that group. Sequence ids are unique; each holds the number of its task in the upper bits.

Edge cases: a null text counts as empty and gives one piece with the end id; a null doc_id is kept; equal rows are packed
each; an empty table gives no piece; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ledgertide.llm.tokens import tokenizer_path, word_ids
from ledgertide.llm.work import whole

CAPACITY, END_ID = 2048, 1
#: Longest piece of a rest, windows that a group fills, and how far a group stays below its windows, as a share.
PIECE, WINDOWS, SLACK = 512, 128, 0.002
#: Bytes of text that are tokenised together.
GATHER = 4 << 20

COLUMNS = "doc_id BIGINT, start BIGINT, length BIGINT, doc_tokens BIGINT, sequence_id BIGINT, offset BIGINT"


def differencing(sizes: list[int], parts: int) -> list[list[int]]:
    """Indexes of `sizes` in `parts` near-equal lists."""
    # A partial partition is its sums over zero, falling, beside the trees of their members; other sums are zero.
    heap = [(-size, k, [size], [k]) for k, size in enumerate(sizes)]
    heapq.heapify(heap)
    count = len(heap)
    while len(heap) > 1:
        _, _, a, of_a = heapq.heappop(heap)
        _, _, b, of_b = heapq.heappop(heap)
        over = max(0, len(a) + len(b) - parts)  # so many sums of b meet sums of a, the others fall on zeros
        own, rest = len(a) - over, len(b) - over
        merged = [*zip(a[:own], of_a[:own], strict=True), *zip(b[:rest], of_b[:rest], strict=True)]
        merged += [(a[own + i] + b[-1 - i], (of_a[own + i], of_b[-1 - i])) for i in range(over)]
        merged.sort(key=itemgetter(0), reverse=True)
        sums, trees = [x[0] for x in merged], [x[1] for x in merged]
        spread = sums[0] - (sums[-1] if len(sums) == parts else 0)
        heapq.heappush(heap, (-spread, count, sums, trees))
        count += 1
    trees = heap[0][3] if heap else []
    return [_members(tree) for tree in trees]


def _members(tree) -> list[int]:
    found, open_ = [], [tree]
    while open_:
        node = open_.pop()
        if isinstance(node, tuple):
            open_.extend(node)
        else:
            found.append(node)
    return found


def deal(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Members of each window; no window is over its capacity."""
    parts = max(1, -(-sum(sizes) // capacity))
    while True:
        dealt = differencing(sizes, parts)
        if all(sum(sizes[k] for k in members) <= capacity for members in dealt):
            return dealt
        parts += 1


class _Group:
    """Pieces that wait until there are enough for a group of windows."""

    def __init__(self, capacity: int, piece: int, windows: int):
        self.capacity, self.piece = capacity, piece
        self.room = int(capacity * windows * (1 - SLACK))
        self.pieces: list[tuple] = []
        self.held = 0

    def add(self, doc, start: int, ids: np.ndarray, total: int) -> Iterator[list[tuple]]:
        """Take the ids of a document's rest; gives the pieces of each group that became full."""
        while len(ids):
            n = min(self.piece, len(ids), self.room - self.held)
            self.pieces.append((doc, start, ids[:n], total))
            self.held += n
            start, ids = start + n, ids[n:]
            if self.held == self.room:
                yield self.take()

    def take(self) -> list[tuple]:
        pieces, self.pieces, self.held = self.pieces, [], 0
        return pieces


def _rows(pieces: list[tuple], windows: list[list[int]], first: int) -> Iterator[tuple]:
    for number, members in enumerate(windows):
        place = 0
        for k in members:
            doc, start, ids, total = pieces[k]
            yield doc, start, len(ids), total, first + number, place, ids
            place += len(ids)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Ids and texts of several batches at once, about GATHER bytes: words that they share are looked up once."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= GATHER:
            yield pa.concat_arrays([b.column(0) for b in held]), pa.concat_arrays([b.column(1) for b in held])
            held = []
    if held:
        yield pa.concat_arrays([b.column(0) for b in held]), pa.concat_arrays([b.column(1) for b in held])


def _record(rows: list[tuple], as_bytes: bool) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    arrays = [pa.array(c, pa.int64()) for c in columns[:6]]
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    if as_bytes:
        ids = pa.array([x.astype("<u4").tobytes() for x in columns[6]], pa.binary())
    else:
        ends = np.cumsum([0, *map(len, columns[6])], dtype=np.int32)
        ids = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(columns[6]).astype(np.int32)))
    return pa.RecordBatch.from_arrays([*arrays, ids], names)


def pack(
    docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, piece: int = PIECE, windows: int = WINDOWS,
    as_bytes: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids.

    `ids` are whole numbers, or with `as_bytes` their little-endian unsigned 32-bit form. `tokenizer` is the path of a
    tokenizer file that each executor has.
    """
    path = tokenizer or tokenizer_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, group = word_ids(path), _Group(capacity, piece, windows)
        sequence = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []
        for docs_, texts in _gathered(batches):
            ids, bounds = words.batch(texts)
            for k, doc in enumerate(docs_.to_pylist()):
                own = np.append(ids[bounds[k] : bounds[k + 1]], np.uint32(END_ID))
                whole_ones = len(own) // capacity
                for w in range(whole_ones):
                    rows.append((doc, w * capacity, capacity, len(own), sequence, 0, own[w * capacity : (w + 1) * capacity]))
                    sequence += 1
                at = whole_ones * capacity
                for pieces in group.add(doc, at, own[at:], len(own)):
                    dealt = deal([len(p[2]) for p in pieces], capacity)
                    rows += _rows(pieces, dealt, sequence)
                    sequence += len(dealt)
            if rows:
                yield _record(rows, as_bytes)
                rows = []
        if pieces := group.take():
            yield _record(list(_rows(pieces, deal([len(p[2]) for p in pieces], capacity), sequence)), as_bytes)

    kind = "BINARY" if as_bytes else "ARRAY<INT>"
    return docs.select("doc_id", whole().alias("text")).mapInArrow(cut, f"{COLUMNS}, ids {kind}")
