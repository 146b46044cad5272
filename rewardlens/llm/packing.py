"""Best-fit packing of token pieces by bin completion.

Texts become token ids in tasks; a text longer than a sequence is cut, its
first piece being the shorter one. Which piece goes where depends on piece
lengths only, and there are at most ``capacity`` of these, so the driver plans
on the histogram of lengths: a plan is a list of fillings, each with the number
of sequences that use it. Its size follows the number of different lengths, not
the number of documents.

The planner is a branch and bound over bin completions. Best-fit decreasing
gives the first incumbent. A branch takes the longest piece left, enumerates the
undominated fillings of the rest of its sequence (no further piece fits, and no
chosen piece can give way to a longer one), and uses a
filling for as many sequences as the counts allow at once. Fillings are enumerated
longest pieces first and handed out in handfuls, of each the least waste first; the rest of
a level's fillings is enumerated when the search comes back to it, so none is left out. A branch ends when
its waste leaves no room below the incumbent; the search ends at the lower bound, with
the tree, or when its effort is spent (``nodes`` fillings tried, or ``STEPS`` pieces put in for
each of them), with the incumbent as the answer.

Pieces then get their rank among the pieces of their length, by windows over
(length, slot) with slots from a hash, so one frequent length is dealt to many
tasks, and rank intervals lead to sequence and offset.
"""

from __future__ import annotations

import itertools
import os
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rewardlens.llm.common import materialize
from rewardlens.llm.textbatch import IS_SPACE, slices, text_buffer
from rewardlens.session import ship_package

CAPACITY = 1024
END_ID = 2
CACHED_CHUNKS = 1 << 19
ROWS_PER_SLOT = 200_000

Plan = list[tuple[tuple[int, ...], int]]

# ---------------------------------------------------------------- token ids

#: First bytes of characters that a single space can be split before: printable ASCII and
#: multi-byte characters, leaving out the lead bytes under which Unicode has white space.
_OPENS = np.zeros(256, bool)
_OPENS[0x21:0x7F] = True
_OPENS[0xC3:0xF8] = True
_OPENS[[0xE1, 0xE2, 0xE3]] = False
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def _byte_chars() -> dict[int, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for the code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: 256 + i for i, b in enumerate(rest)}


BYTE_CHARS = _byte_chars()
SPACE = chr(BYTE_CHARS[32])

_TOKENIZERS: dict = {}


class ChunkEncoder:
    """Token ids of whole texts, each distinct chunk of a slice encoded once.

    A chunk ends before a single space between two printable characters, and
    before a comma or full stop after an ASCII letter. The byte-level
    pre-tokenizer always begins a piece there, so the ids of a text are those of
    its chunks one after another. A chunk of letters only is one piece and goes
    straight to the tokenizer's model; others take the whole tokenizer. Chunks
    seen before come from a cache of at most ``CACHED_CHUNKS`` entries for each
    Python worker.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.known = pa.array([], pa.string())
        self.flat, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    @staticmethod
    def of(path: str) -> ChunkEncoder:
        if path not in _TOKENIZERS:
            _TOKENIZERS[path] = ChunkEncoder(path)
        return _TOKENIZERS[path]

    def _encode_new(self, names: list[str]) -> list[list[int]]:
        found: list[list[int] | None] = [None] * len(names)
        other = []
        one = self.model.tokenize
        for i, x in enumerate(names):
            body = x[1:] if x[0] == " " else x
            if body.isalpha():
                body = body if body.isascii() else body.encode().decode("latin-1").translate(BYTE_CHARS)
                found[i] = [t.id for t in one(SPACE + body if x[0] == " " else body)]
            else:
                other.append(i)
        for i, e in zip(other, self.tokenizer.encode_batch_fast([names[i] for i in other], add_special_tokens=False)):
            found[i] = e.ids
        return found

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and each row's offset into them."""
        cut = np.zeros(len(buf) + 1, bool)
        if len(buf) > 2:
            cut[1:-2] = (buf[1:-1] == 32) & _OPENS[buf[2:]] & ~IS_SPACE[buf[:-2]]
            cut[1:-1] |= ((buf[1:] == 44) | (buf[1:] == 46)) & _LETTER[buf[:-1]]
        cut[offs[np.flatnonzero(np.diff(offs))]] = True
        start = np.flatnonzero(cut[:-1])
        bounds = np.r_[start, len(buf)].astype(np.int32)
        chunks = pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(buf))]).dictionary_encode()
        names, code = chunks.dictionary, chunks.indices.to_numpy()
        at = pc.index_in(names, value_set=self.known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(at < 0)
        fresh = names.take(pa.array(new))
        ids = self._encode_new(fresh.to_pylist())
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        more = np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(n.sum()))
        at[new] = len(self.known) + np.arange(len(new))
        flat, size = np.concatenate([self.flat, more]), np.concatenate([self.size, n])
        first = np.cumsum(size) - size
        room = CACHED_CHUNKS - len(self.known)
        if room > 0 and len(new):
            use = np.bincount(code, minlength=len(names))[new]
            keep = np.flatnonzero((use > 1) & (pc.binary_length(fresh).to_numpy() <= 64))[:room]
            self.known = pa.concat_arrays([self.known, fresh.take(pa.array(keep))])
            self.flat = np.concatenate([self.flat, *[np.asarray(ids[i], np.uint32) for i in keep]])
            self.size = np.concatenate([self.size, n[keep]])
        at = at[code]
        n = size[at]
        done = np.r_[0, np.cumsum(n)]
        out = flat[np.repeat(first[at] - done[:-1], n) + np.arange(done[-1])]
        return out, done[np.searchsorted(start, offs)]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, id_col: str, text_col: str) -> DataFrame:
    """``(id, piece, start, length, ids_crc32)``; a null text is empty and still holds the end id."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = ChunkEncoder.of(tokenizer)
        for batch in batches:
            for part in slices(batch, "text", 8 << 20):
                ids, at = enc.encode(*text_buffer(part.column("text")))
                cols: list[list[int]] = [[], [], [], [], []]
                for r in range(part.num_rows):
                    own = np.append(ids[at[r]:at[r + 1]], np.uint32(END_ID)).astype("<u4")
                    head = len(own) % capacity or capacity
                    cuts = [0, *range(head, len(own) + 1, capacity)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        for c, v in zip(cols, (r, k, a, b - a, zlib.crc32(own[a:b].tobytes()))):
                            c.append(v)
                yield pa.RecordBatch.from_arrays(
                    [pc.take(part.column("id"), pa.array(cols[0], pa.int32())), *[pa.array(c, pa.int64()) for c in cols[1:]]],
                    ["id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(task, f"id {kind}, piece long, start long, length long, ids_crc32 long")


# ---------------------------------------------------------------- planning


def best_fit(hist: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing over runs of equal pieces."""
    bins: dict[tuple[int, ...], int] = {}
    for s in sorted(hist, reverse=True):
        left = hist[s]
        open_ = sorted((capacity - sum(p), p) for p in bins if capacity - sum(p) >= s)
        for room, p in [*open_, (capacity, ())]:
            if not left:
                break
            k = room // s
            have = bins.get(p, 0) if p else left
            for size, many in ((k, min(have, left // k)), (left % k, 1)):
                if size and many and left >= size * many and (not p or bins.get(p, 0) >= many):
                    if size < k and left >= k:
                        continue
                    if p:
                        bins[p] -= many
                        if not bins[p]:
                            del bins[p]
                    q = p + (s,) * size
                    bins[q] = bins.get(q, 0) + many
                    left -= size * many
    return list(bins.items())


#: Undominated fillings in a handful, and pieces put in before one is handed out with what it has.
HANDFUL, STEPS = 16, 448


def fillings(room: int, hist: dict[int, int], effort: list[int] | None = None) -> Iterator[tuple[int, ...]]:
    """All undominated fillings of ``room``, handful by handful; ``effort[0]`` counts the pieces put in."""
    sizes = sorted((s for s, n in hist.items() if n and s <= room), reverse=True)
    effort = [0] if effort is None else effort
    falling = [-s for s in sizes]

    def dominated(used: Counter, waste: int) -> bool:
        for s in sizes:  # longest first
            if hist[s] > used[s]:
                if s <= waste:
                    return True
                if any(n and c < s <= c + waste for c, n in used.items()):
                    return True
        return False

    chosen: list[int] = []
    used: Counter = Counter()
    left, since, whole = room, effort[0], 0
    found: list[tuple[int, tuple[int, ...]]] = []
    # per depth: the next size to try, and whether any went in
    stack, grown = [0], [False]
    while stack:
        j = max(stack[-1], bisect_left(falling, -left))
        while j < len(sizes) and used[sizes[j]] >= hist[sizes[j]]:
            j += 1
        if j < len(sizes):
            s = sizes[j]
            stack[-1], grown[-1] = j + 1, True
            chosen.append(s)
            used[s] += 1
            left -= s
            stack.append(j)
            grown.append(False)
            effort[0] += 1
        else:
            if not grown[-1] and not dominated(used, left):
                found.append((left, tuple(chosen)))
                whole += left == 0
            stack.pop()
            grown.pop()
            if chosen:
                used[chosen[-1]] -= 1
                left += chosen.pop()
        if found and (not stack or len(found) >= HANDFUL or whole >= 3 or effort[0] - since > STEPS):
            yield from (c for _, c in sorted(found, key=lambda x: (x[0], len(x[1]))))
            found, since, whole = [], effort[0], 0


def bin_completion(hist: dict[int, int], capacity: int, nodes: int = 4000) -> Plan:
    """Fillings and how many sequences use each; every piece of ``hist`` is in exactly one."""
    hist = {s: n for s, n in hist.items() if n}
    if not hist:
        return []
    total = sum(s * n for s, n in hist.items())
    over_half = sum(n for s, n in hist.items() if 2 * s > capacity)
    lower = max(-(-total // capacity), over_half)
    best = best_fit(hist, capacity)
    fewest = sum(n for _, n in best)
    # each level: counts left, fillings not tried yet, the filling in use, waste so far
    state, waste, path, spent, effort = dict(hist), 0, [], 0, [0]
    levels: list[tuple[dict[int, int], int, Iterator[tuple[int, ...]]]] = []
    fresh = True
    while spent < nodes and effort[0] < nodes * STEPS and fewest > lower:
        if fresh:
            if not state:
                if sum(n for _, n in path) < fewest:
                    best, fewest = list(path), sum(n for _, n in path)
                fresh = False
                continue
            longest = max(state)
            rest = dict(state)
            rest[longest] -= 1
            levels.append((state, waste, _completed(longest, capacity - longest, {s: n for s, n in rest.items() if n}, effort)))
        elif not levels:
            break
        state, waste, options = levels[-1]
        filling = next(options, None)
        if filling is None:
            levels.pop()
            if path and len(path) > len(levels) - 1:
                path = path[:max(0, len(levels) - 1)]
            fresh = False
            continue
        path = path[:len(levels) - 1]
        use = Counter(filling)
        times = min(state[s] // n for s, n in use.items())
        lost = (capacity - sum(use.elements())) * times
        spent += 1
        if total + waste + lost > (fewest - 1) * capacity:
            fresh = False
            continue
        path.append((tuple(sorted(use.elements(), reverse=True)), times))
        state = {s: n - times * use.get(s, 0) for s, n in state.items() if n > times * use.get(s, 0)}
        waste += lost
        fresh = True
    return best


def _completed(longest: int, room: int, rest: dict[int, int], effort: list[int]) -> Iterator[tuple[int, ...]]:
    """Sequences that begin with ``longest``; alone where nothing fits beside it."""
    any_ = False
    for f in fillings(room, rest, effort):
        any_ = True
        yield (longest, *f)
    if not any_:
        yield (longest,)


# ---------------------------------------------------------------- assignment


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", nodes: int = 4000) -> DataFrame:
    """Pieces of all rows of ``docs``, packed into sequences of at most ``capacity`` tokens.

    ``(id_col, piece, start, length, ids_crc32, sequence_id, offset)``. Rows with
    a null or empty text are pieces of one token; repeated and null ids keep
    their own pieces; an empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    ship_package(spark)
    pieces = materialize(token_pieces(docs, tokenizer, capacity, id_col, text_col).withColumn("rid", F.monotonically_increasing_id()), "pack-pieces")
    hist = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    full = hist.pop(capacity, 0)
    plan = [((capacity,), full)] * bool(full) + bin_completion(hist, capacity, nodes)
    rows, taken, seq = [], Counter(), 0
    for filling, times in plan:
        offset = 0
        for s in filling:
            rows.append((s, taken[s], taken[s] + times, seq, offset))
            taken[s] += times
            offset += s
        seq += times
    spots = spark.createDataFrame(rows, "length long, from_rank long, to_rank long, first_sequence long, offset long")
    slots = 1 + (full + sum(hist.values())) // ROWS_PER_SLOT
    slotted = pieces.withColumn("slot", F.pmod(F.xxhash64("id", "piece", "rid"), F.lit(16 * slots)))
    counts = slotted.groupBy("length", "slot").agg(F.count(F.lit(1)).alias("here"))
    before = Window.partitionBy("length").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select("length", "slot", F.coalesce(F.sum("here").over(before), F.lit(0)).alias("begin"))
    local = F.row_number().over(Window.partitionBy("length", "slot").orderBy("rid")) - 1
    ranked = slotted.withColumn("local", local).join(begins, ["length", "slot"]).withColumn("rank", F.col("begin") + F.col("local"))
    placed = ranked.join(F.broadcast(spots) if len(rows) <= 100_000 else spots,
                         (ranked["length"] == spots["length"]) & (F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("to_rank")))
    return placed.select(F.col("id").alias(id_col), F.col("piece").cast("int").alias("piece"), "start", ranked["length"].alias("length"), "ids_crc32",
                         (F.col("first_sequence") + F.col("rank") - F.col("from_rank")).alias("sequence_id"), "offset")
