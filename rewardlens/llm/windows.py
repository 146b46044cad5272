"""Order-preserving packing by dynamic programming over cut positions.

The token ids of the texts, one after another in table order, are a stream that
is cut into windows of at most ``capacity`` ids; every window is a sequence. A
cut may fall after a text (free), after a sentence inside a text (``SENTENCE``)
or, in a sentence longer than a sixteenth of a window, after each sixteenth
(``HARD``), so that no sentence is too long for a window. The dynamic programme finds the cuts of least cost in tokens:

    f(j) = cut(j) + WINDOW + min over windows i .. j of f(i) + padding(length)

A window is padded to ``capacity`` unless its length is a power of two. The
padded windows need the least ``f(i) + position(i)`` among the last ``capacity``
positions, which a monotone queue holds; the others come from at most one
earlier position for each power of two.

Texts are tokenised and cut where they are read, in blocks of whole texts with at
least ``BLOCK`` ids, so nothing is shuffled, a task holds one block (or one
longer text), and a block costs less than one more window of padding. Windows are
numbered by partition and place, which a retried task repeats.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rewardlens.llm.packing import BYTE_CHARS, ChunkEncoder
from rewardlens.llm.textbatch import slices, text_buffer
from rewardlens.session import ship_package

CAPACITY = 2048
END_ID = 1
#: Costs in tokens of padding: a window at all, a cut after a sentence, a cut inside a sentence.
WINDOW, SENTENCE, HARD = 1, 4, 32
#: A sentence of more than one part in so many of a window can be cut inside.
INSIDE = 16
BLOCK = 1 << 20
#: Ends of a sentence before white space, and anywhere; a closing quotation mark or bracket may come between.
STOPS = (".", "!", "?", "…")
FULL_STOPS = ("。", "！", "？")
CLOSERS = "\"')]}”’」"


def sentence_tables(encoder: ChunkEncoder) -> tuple[np.ndarray, np.ndarray]:
    """For every token id: does it end a sentence (1 if white space follows, 2 in any case), and does it begin with white space?"""
    byte_of = {chr(c): b for b, c in BYTE_CHARS.items()}
    vocab = encoder.tokenizer.get_vocab()
    ends, space = np.zeros((2, max(vocab.values(), default=0) + 1), np.int8)
    for token, i in vocab.items():
        text = bytes(byte_of[c] if c in byte_of else ord(c) & 255 for c in token).decode("utf-8", "replace")
        body = text.rstrip(CLOSERS)
        ends[i] = 2 if body.endswith(FULL_STOPS) or "\n" in text else body.endswith(STOPS)
        space[i] = text[:1].isspace()
    return ends, space


def cut_points(ids: np.ndarray, text_ends: np.ndarray, ends: np.ndarray, space: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which the stream ``ids`` may be cut, from 0 to its end, and what each costs.

    ``text_ends`` has the position after each text. A sentence ends at a line end,
    at an ideographic full stop, or at another stop before white space.
    """
    n = len(ids)
    cost = np.full(n + 1, -1, np.int64)
    cost[1:n][ends[ids[:-1]] + space[ids[1:]] >= 2] = SENTENCE
    cost[0] = 0
    cost[text_ends] = 0
    at = np.flatnonzero(cost >= 0)
    step = max(1, capacity // INSIDE)
    wide = np.flatnonzero(np.diff(at) > step)
    if len(wide):
        cost[np.concatenate([np.arange(at[i] + step, at[i + 1], step) for i in wide])] = HARD
        at = np.flatnonzero(cost >= 0)
    return at, cost[at]


def best_cuts(at: np.ndarray, cost: np.ndarray, capacity: int) -> list[int]:
    """Indices into ``at`` of the chosen cuts, first and last position included.

    Among equal costs a padded window wins over a power of two, and the longest
    padded window over shorter ones.
    """
    m = len(at)
    exact: list[list[int]] = [[] for _ in range(m)]
    size = 1
    while size < capacity:
        j = np.searchsorted(at, at + size)
        hit = np.flatnonzero((j < m) & (at[np.minimum(j, m - 1)] == at + size))
        for i, k in zip(hit.tolist(), j[hit].tolist()):
            exact[k].append(i)
        size *= 2
    position, charge = at.tolist(), (cost + WINDOW).tolist()
    total, come = [0] * m, [0] * m
    queue, value, head = [0], [0], 0  # indices with rising f + position
    for j in range(1, m):
        p = position[j]
        while position[queue[head]] < p - capacity:
            head += 1
        f, i = value[head] + capacity - p, queue[head]
        for k in exact[j]:
            if total[k] < f:
                f, i = total[k], k
        f += charge[j]
        total[j], come[j] = f, i
        v = f + p
        while len(queue) > head and value[-1] > v:
            queue.pop()
            value.pop()
        queue.append(j)
        value.append(v)
    cuts = [m - 1]
    while cuts[-1]:
        cuts.append(come[cuts[-1]])
    return cuts[::-1]


class _Block:
    """Texts read but not cut yet, by row of the output."""

    def __init__(self) -> None:
        self.owners: list = []
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, owner, ids: np.ndarray) -> None:
        self.owners.append(owner)
        self.parts.append(ids)
        self.size += len(ids)

    def pieces(self, tables: tuple[np.ndarray, np.ndarray], capacity: int, first: int) -> tuple[list[list], int]:
        """Columns of all pieces, and how many windows there are."""
        ids = np.concatenate(self.parts).astype("<u4")
        sizes = np.fromiter(map(len, self.parts), np.int64, len(self.parts))
        ends = np.cumsum(sizes)
        at, cost = cut_points(ids, ends, *tables, capacity)
        cuts = at[best_cuts(at, cost, capacity)]
        bounds = np.union1d(cuts, ends)  # every piece ends at a cut or with its text
        starts = np.r_[0, bounds[:-1]]
        text = np.searchsorted(ends, starts, "right")
        window = np.searchsorted(cuts, starts, "right") - 1
        begins = ends - sizes
        raw = ids.tobytes()
        crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(starts.tolist(), bounds.tolist()) if b > a]
        real = bounds > starts
        text, window, starts, bounds = text[real], window[real], starts[real], bounds[real]
        columns = [[self.owners[t] for t in text.tolist()], (starts - begins[text]).tolist(), (bounds - starts).tolist(), crc,
                   sizes[text].tolist(), (first + window).tolist(), (starts - cuts[window]).tolist()]
        return columns, len(cuts) - 1


def pack_in_order(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text",
                  end_id: int = END_ID, block: int = BLOCK) -> DataFrame:
    """The pieces of all rows of ``docs`` in windows of at most ``capacity`` ids, in table order.

    ``(id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset)``. A
    null or empty text is its end id alone; repeated and null ids keep their own
    pieces; an empty table gives no rows; a text of any length is cut into as
    many pieces as it takes. Other columns are not read. ``capacity`` must be a
    power of two.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder.of(tokenizer)
        tables = sentence_tables(encoder)
        end = np.array([end_id], np.uint32)
        held, next_window, id_type = _Block(), TaskContext.get().partitionId() << 40, None

        def flush() -> pa.RecordBatch:
            nonlocal held, next_window
            columns, windows = held.pieces(tables, capacity, next_window)
            next_window += windows
            held = _Block()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], id_type), *[pa.array(c, pa.int64()) for c in columns[1:]]], names)

        for batch in batches:
            id_type = batch.schema.field("id").type
            for part in slices(batch, "text", 8 << 20):
                ids, at = encoder.encode(*text_buffer(part.column("text")))
                for r, owner in enumerate(part.column("id").to_pylist()):
                    held.add(owner, np.concatenate([ids[at[r]:at[r + 1]], end]))
                    if held.size >= block:
                        yield flush()
        if held.owners:
            yield flush()

    placed = rows.mapInArrow(task, f"id {kind}, " + ", ".join(f"{c} long" for c in names[1:]))
    return placed.select(F.col("id").alias(id_col), *names[1:])
