"""Substring deduplication on a compacted De Bruijn graph of word windows.

A window of ``WINDOW`` words is an edge from its first to its last words; a
document walks from edge to edge. Repeated edges, those of several documents,
make up the graph that matters.

1. *Blocks.* Rows are dealt to blocks of about ``BLOCK_BYTES`` of text by a hash of
   the row's number. A block names each of its edges once, however many copies of a
   document it holds, so copies that make up a third of all rows are no hot key.
2. *Candidates.* Blocks send the first bits of each edge's hash (forty, and more than the
   edges need from some thousand million on) to the part that owns
   this range of the hash; parts answer with the edges that several blocks have.
3. *Graph.* For candidate edges the blocks send 96 bits of hashes, the smallest
   document id, and marks of the edge before and the edge after. Their join says
   which edges repeat, which document has them first, and where paths branch, begin
   or end: an edge continues only if every occurrence has the same neighbour.
4. *Compaction.* Back in its document, a run of repeated edges without such a
   point is one step along a path, named by its first edge. All documents on a
   path have it whole, so a path's rows are its source coordinates.
5. *Verification.* The words of each path occurrence are digested, and all
   occurrences of a path must agree; if hashes ever collide the job starts over
   with other hashes.

Parts and blocks follow the input in number, not in size, while there are few of them. What
travels is a message for each block and part, so that a message would hold ever fewer edges; from
some hundred million edges on both grow with the square root of the input, which keeps
``MESSAGE_EDGES`` to a message and the messages in proportion to the input.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rewardlens.llm.common import materialize
from rewardlens.llm.textbatch import BASE, U64, Words, inside_row, mix, text_buffer, window_hashes
from rewardlens.session import ship_package

WINDOW = 13
BLOCK_BYTES = 2 << 20
EDGES_PER_PART = 1 << 20
#: Edges that a block sends to a part, on average, before blocks and parts grow.
MESSAGE_EDGES = 1000
LEAST_BITS = 40
NO_ID = np.iinfo(np.int64).max
EDGE = np.dtype([("k1", "<u8"), ("k2", "<u4"), ("id", "<i8"), ("before", "<u4"), ("after", "<u4")])
#: The same with ids counted from the smallest one, for blobs whose ids lie close enough.
NEAR_EDGE = np.dtype([("k1", "<u8"), ("k2", "<u4"), ("id", "<u4"), ("before", "<u4"), ("after", "<u4")])
REPEATED, OLDER, CUT_BEFORE, CUT_AFTER = 1, 2, 4, 8


class Layout(NamedTuple):
    """How many blocks and parts there are, and how many bits of a hash name an edge at first."""

    blocks: int
    parts: int
    bits: int

    @staticmethod
    def of(size: int, edges: int) -> Layout:
        """For ``size`` bytes of text with about so many ``edges``."""
        even = math.isqrt(MESSAGE_EDGES * edges)
        per_block = max(BLOCK_BYTES, even * size // max(edges, 1))
        return Layout(1 + size // per_block, 1 + edges // max(EDGES_PER_PART, even), max(LEAST_BITS, min(56, edges.bit_length() + 8)))

    def short(self, k1: np.ndarray) -> np.ndarray:
        return k1 >> U64(64 - self.bits)

    def bounds(self, short: np.ndarray) -> np.ndarray:
        """Where each part's range begins in sorted short hashes."""
        return np.searchsorted(((short >> U64(self.bits - 40)) * U64(self.parts)) >> U64(40), np.arange(self.parts + 1).astype(U64))


class Block:
    """The words and edges of one block of rows, in the order of (id, row number)."""

    def __init__(self, parcels: pa.Table, window: int, seed: int, layout: Layout):
        self.layout = layout
        table = pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in parcels.column("parcel").to_pylist()])
        table = table.combine_chunks().sort_by([("id", "ascending"), ("rid", "ascending")])
        self.table, self.window = table, window
        buf, offs = text_buffer(table.column("text"))
        self.words = Words(buf, offs)
        row = self.words.row
        h = mix(self.words.hashes() + U64(seed))
        ok = inside_row(row, window, len(h))
        self.pos = np.flatnonzero(ok)
        self.other = mix(h ^ U64(0xA5A5A5A5A5A5A5A5))
        all1 = window_hashes(h, window)
        self.k1 = all1[self.pos]
        self.doc = np.repeat(np.arange(len(row) - 1), np.maximum(np.diff(row) - window + 1, 0))
        self.id = table.column("id").fill_null(NO_ID).to_numpy().astype(np.int64)

    def short_edges(self) -> np.ndarray:
        return _different(np.sort(self.layout.short(self.k1)))

    def candidates(self, repeated: np.ndarray) -> np.ndarray:
        """Indices of the edges that several blocks have, or that stand in this block more than once."""
        short, rest = self.layout.short(self.k1), U64(self.layout.bits - 20)
        in_order = np.sort(short)
        twice = in_order[1:][in_order[1:] == in_order[:-1]]
        wanted = _different(np.sort(np.concatenate([repeated, twice])))
        if not len(wanted):
            return np.zeros(0, np.int64)
        # a small table of the first 20 bits passes few others
        table = np.zeros(1 << 20, bool)
        table[(wanted >> rest).astype(np.int64)] = True
        may = np.flatnonzero(table[(short >> rest).astype(np.int64)])
        at = np.minimum(np.searchsorted(wanted, short[may]), len(wanted) - 1)
        return may[wanted[at] == short[may]]

    def second(self, use: np.ndarray) -> np.ndarray:
        """32 bits of another hash of the windows ``use``."""
        out = np.zeros(len(use), U64)
        for i in range(self.window):
            out = out * U64(BASE) + self.other[self.pos[use] + i]
        return (mix(out) >> U64(32)).astype(np.uint32)

    def marks(self, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marks of the edges before and after ``use``; 0 where the document begins or ends."""
        mark = ((self.k1 >> U64(8)) | U64(1)).astype(np.uint32)
        before, after = np.maximum(use - 1, 0), np.minimum(use + 1, len(self.k1) - 1)
        return (np.where((use > 0) & (self.doc[before] == self.doc[use]), mark[before], 0),
                np.where((use + 1 < len(self.k1)) & (self.doc[after] == self.doc[use]), mark[after], 0))

    def edges(self, use: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Different edges among ``use``, each occurrence's index among them, and whether several ids have the edge."""
        k1, k2 = self.k1[use], self.second(use)
        by = _order(k1, k2)
        k1, k2 = k1[by], k2[by]
        at = np.flatnonzero(np.r_[True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])]) if len(by) else np.zeros(0, np.int64)
        out = np.zeros(len(at), EDGE)
        which = np.zeros(len(by), np.int64)
        if not len(at):
            return out, which, np.zeros(0, bool)
        which[by] = np.repeat(np.arange(len(at)), np.diff(np.r_[at, len(by)]))
        ids = self.id[self.doc[use]][by]
        out["k1"], out["k2"], out["id"] = k1[at], k2[at], np.minimum.reduceat(ids, at)
        for name, marks in zip(("before", "after"), self.marks(use)):
            low, high = np.minimum.reduceat(marks[by], at), np.maximum.reduceat(marks[by], at)
            out[name] = np.where(low == high, low, 0)
        return out, which, np.maximum.reduceat(ids, at) != out["id"]


def _different(in_order: np.ndarray) -> np.ndarray:
    """The different values of a sorted array."""
    return in_order[np.r_[True, in_order[1:] != in_order[:-1]]] if len(in_order) else in_order


def _order(k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    """Sorts by (k1, k2); the second key matters only where the first one collides."""
    by = np.argsort(k1, kind="stable")
    a, b = k1[by], k2[by]
    if np.any((a[1:] == a[:-1]) & (b[1:] != b[:-1])):
        return np.lexsort((k2, k1))
    return by


def _pack(short: np.ndarray) -> bytes:
    """Sorted different numbers as their gaps, in as many bytes each as the usual gap needs.

    The largest number of that width stands for a gap that goes on in the next one.
    """
    gap = np.diff(short, prepend=U64(0)).astype(np.int64)
    spread = int(short[-1] - short[0]) // len(short) * 4
    width = min(7, max(1, -(-spread.bit_length() // 8)))
    top = (1 << 8 * width) - 1
    full, rest = np.divmod(gap, top)
    full[0], first = 0, int(gap[0])  # the first number stands in the head
    rest[0] = 0
    out = np.full(len(gap) + int(full.sum()), top, "<u8")
    out[np.cumsum(full + 1) - 1] = rest
    return bytes([width]) + first.to_bytes(8, "little") + np.ascontiguousarray(out[:, None].view(np.uint8)[:, :width]).tobytes()


def _unpack(blob: bytes) -> np.ndarray:
    width, first = blob[0], int.from_bytes(blob[1:9], "little")
    raw = np.frombuffer(blob, np.uint8, offset=9).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    gap = out.view("<u8").ravel()
    return (np.cumsum(gap, dtype=np.uint64) + U64(first))[gap != (1 << 8 * width) - 1]


def _pack_edges(edges: np.ndarray) -> bytes:
    low = int(edges["id"].min())
    near = int(edges["id"].max()) - low < 1 << 32
    out = edges.astype(EDGE)
    out["id"] -= low
    return bytes([near]) + low.to_bytes(8, "little", signed=True) + out.astype(NEAR_EDGE if near else EDGE).tobytes()


def _unpack_edges(blob: bytes) -> np.ndarray:
    out = np.frombuffer(blob, NEAR_EDGE if blob[0] else EDGE, offset=9).astype(EDGE)
    out["id"] += int.from_bytes(blob[1:9], "little", signed=True)
    return out


def _sent(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    cols = list(zip(*rows)) or [(), (), ()]
    return pa.table({"block": pa.array(cols[0], pa.int64()), "part": pa.array(cols[1], pa.int64()), "blob": pa.array(cols[2], pa.binary())})


PARCEL = "block long, parcel binary"


def _parcels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a batch for each block, compressed: the text travels once, and small."""
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    for batch in batches:
        block = batch.column("block").to_numpy()
        by = np.argsort(block, kind="stable")
        at = np.flatnonzero(np.r_[True, np.diff(block[by]) > 0]) if len(by) else np.zeros(0, np.int64)
        rows, out = batch.select(["rid", "id", "text"]), []
        for i, j in zip(at, np.r_[at[1:], len(by)]):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=options) as writer:
                writer.write_batch(rows.take(pa.array(by[i:j])))
            out.append(sink.getvalue().to_pybytes())
        yield pa.RecordBatch.from_arrays([pa.array(block[by[at]], pa.int64()), pa.array(out, pa.binary())], ["block", "parcel"])


SENT = "block long, part long, blob binary"


def _offer(layout: Layout, window: int, seed: int):
    def task(key: tuple, table: pa.Table) -> pa.Table:
        short = Block(table, window, seed, layout).short_edges()
        at = layout.bounds(short)
        return _sent([(key[0].as_py(), p, _pack(short[at[p]:at[p + 1]])) for p in range(layout.parts) if at[p] < at[p + 1]])

    return task


def _meet(layout: Layout):
    """The edges of one part that several blocks offer, for each of these blocks."""

    def task(table: pa.Table) -> pa.Table:
        blocks = table.column("block").to_numpy()
        keys = [_unpack(b) for b in table.column("blob").to_pylist()]
        size = [len(k) for k in keys]
        key = np.concatenate(keys)
        room = 64 - layout.bits
        if len(keys) <= 1 << room:  # hash and sender in one number
            both = np.sort((key << U64(room)) | np.repeat(np.arange(len(keys)).astype(U64), size))
            key, own = both >> U64(room), (both & U64((1 << room) - 1)).astype(np.int64)
        else:
            by = np.argsort(key, kind="stable")
            key, own = key[by], np.repeat(np.arange(len(keys)), size)[by]
        same = np.r_[False, key[1:] == key[:-1]]
        hit = same | np.r_[same[1:], False]
        key, own = key[hit], own[hit]
        by = np.argsort(own, kind="stable")
        key, own = key[by], own[by]
        at = np.searchsorted(own, np.arange(len(keys) + 1))
        part = table.column("part")[0].as_py()
        return _sent([(int(blocks[i]), part, _pack(key[at[i]:at[i + 1]])) for i in range(len(keys)) if at[i] < at[i + 1]])

    return task


def _repeated(answers: pa.Table) -> np.ndarray:
    if not answers.num_rows:
        return np.zeros(0, np.uint64)
    return np.sort(np.concatenate([_unpack(b) for b in answers.column("blob").to_pylist()]))


def _describe(layout: Layout, window: int, seed: int):
    def task(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _sent([])
        block = Block(table, window, seed, layout)
        edges, _, _ = block.edges(block.candidates(_repeated(answers)))
        at = layout.bounds(layout.short(edges["k1"]))
        return _sent([(key[0].as_py(), p, _pack_edges(edges[at[p]:at[p + 1]])) for p in range(layout.parts) if at[p] < at[p + 1]])

    return task


def _judge(table: pa.Table) -> pa.Table:
    """Flags of every edge of one part, for each block in the order it sent them."""
    sent = [_unpack_edges(b) for b in table.column("blob").to_pylist()]
    size = [len(x) for x in sent]
    edges = np.concatenate(sent)
    by = _order(edges["k1"], edges["k2"])
    e = edges[by]
    at = np.flatnonzero(np.r_[True, (e["k1"][1:] != e["k1"][:-1]) | (e["k2"][1:] != e["k2"][:-1])])
    n = np.diff(np.r_[at, len(e)])
    first = np.repeat(np.minimum.reduceat(e["id"], at), n)
    last = np.repeat(np.maximum.reduceat(e["id"], at), n)
    flags = np.where(first != last, REPEATED, 0) | np.where(first < e["id"], OLDER, 0)
    for name, bit in (("before", CUT_BEFORE), ("after", CUT_AFTER)):
        low, high = np.minimum.reduceat(e[name], at), np.maximum.reduceat(e[name], at)
        flags |= np.where(np.repeat((low != high) | (low == 0), n), bit, 0)
    out = np.zeros(len(edges), np.uint8)
    out[by] = flags
    ends = np.cumsum(size)
    part = table.column("part")[0].as_py()
    return _sent([(b, part, out[j - k:j].tobytes()) for b, j, k in zip(table.column("block").to_pylist(), ends, size)])


_SPANS = pa.list_(pa.struct([("path", pa.int64()), ("start", pa.int64()), ("words", pa.int64()), ("removed", pa.bool_()), ("digest", pa.string())]))


def _settle(layout: Layout, window: int, seed: int, texts: bool):
    def task(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        names = ["rid", "id", "n_words", "n_removed", "kept_sha256", "spans", *["kept"] * texts]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), _SPANS, *[pa.string()] * texts]
        if not table.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names)
        block = Block(table, window, seed, layout)
        kind = answers.column("kind").to_numpy() if answers.num_rows else np.zeros(0)
        use = block.candidates(_repeated(answers.filter(pa.array(kind == 1))))
        edges, which, several = block.edges(use)
        judged = answers.filter(pa.array(kind == 2)).sort_by("part")
        flag = np.concatenate([np.frombuffer(b, np.uint8) for b in judged.column("blob").to_pylist()]) if judged.num_rows else np.zeros(0, np.uint8)
        assert len(flag) == len(edges), "answers and edges differ"
        flag = (flag | np.where(several, REPEATED, 0)).astype(np.uint8)
        own = block.id[block.doc[use]]
        gone = (flag[which] & OLDER > 0) | (own > edges["id"][which])
        flag = flag[which]
        back = flag & REPEATED > 0
        use, gone, flag = use[back], gone[back], flag[back]
        pos, doc = block.pos[use], block.doc[use]
        # a run ends where the next repeated edge is not the next word's, or at a cut
        new = np.ones(len(use), bool)
        if len(use) > 1:
            new[1:] = (np.diff(pos) != 1) | (np.diff(doc) != 0) | (flag[:-1] & CUT_AFTER > 0) | (flag[1:] & CUT_BEFORE > 0)
        begin = np.flatnonzero(new)
        end = np.r_[begin[1:], len(use)][:len(begin)]
        w = block.words
        joined, start, stop = _joined(w)
        size = len(w) + 1
        depth = np.bincount(pos[gone], minlength=size) - np.bincount(pos[gone] + window, minlength=size)
        covered = np.cumsum(depth)[:-1] > 0
        first, last = pos[begin], pos[end - 1] + window
        digests = [hashlib.sha256(joined[i:j]).hexdigest()[:32] for i, j in zip(start[first].tolist(), stop[last - 1].tolist())]
        spans = pa.ListArray.from_arrays(
            pa.array(np.searchsorted(doc[begin], np.arange(len(w.row))), pa.int32()),
            pa.StructArray.from_arrays([pa.array(block.k1[use[begin]].view(np.int64)), pa.array(first - w.row[doc[begin]]), pa.array(last - first),
                                        pa.array(gone[begin]), pa.array(digests, pa.string())], fields=list(_SPANS.value_type)))
        removed = np.diff(np.r_[0, np.cumsum(covered)][w.row])
        shas, left = [], []
        for a, b, n in zip(w.row[:-1].tolist(), w.row[1:].tolist(), removed.tolist()):
            if n:
                edge = np.flatnonzero(np.diff(np.r_[True, covered[a:b], True].astype(np.int8))) + a
                kept = b" ".join(joined[i:j] for i, j in zip(start[edge[::2]].tolist(), stop[edge[1::2] - 1].tolist()))
            else:
                kept = joined[int(start[a]):int(stop[b - 1])] if a < b else b""
            shas.append(hashlib.sha256(kept).hexdigest())
            if texts:
                left.append(kept.decode())
        cols = [block.table.column("rid").combine_chunks(), block.table.column("id").combine_chunks(), pa.array(np.diff(w.row)), pa.array(removed),
                pa.array(shas, pa.string()), spans, *[pa.array(left, pa.string())] * texts]
        return pa.table(cols, names)

    return task


def _joined(w: Words) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All words with one space after each, and where each word begins and ends there."""
    size = w.end - w.start + 1
    end = np.cumsum(size) - 1
    out = np.full(int(size.sum()), 32, np.uint8)
    keep = np.ones(len(out), bool)
    keep[end] = False
    out[keep] = w.buf[w.is_word]
    return out.tobytes(), end - size + 1, end


def _once(docs: DataFrame, id_col: str, text_col: str, window: int, texts: bool, seed: int) -> DataFrame:
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size, words = docs.select(F.octet_length(text_col).cast("long").alias("b")).agg(F.coalesce(F.sum("b"), F.lit(0)), F.coalesce((F.sum("b") / 6).cast("long"), F.lit(0))).first()
    layout = Layout.of(size, words)
    tasks = max(1, min(layout.blocks, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("rid"), F.lit(layout.blocks))).mapInArrow(_parcels, PARCEL).repartition(tasks, "block")

    def table(names: str):
        return "rid long, id long, " + names

    offered = dealt.groupBy("block").applyInArrow(_offer(layout, window, seed), SENT)
    shared = offered.groupBy("part").applyInArrow(_meet(layout), SENT)
    described = dealt.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(_describe(layout, window, seed), SENT)
    judged = described.groupBy("part").applyInArrow(_judge, SENT)
    answers = shared.withColumn("kind", F.lit(1)).unionByName(judged.withColumn("kind", F.lit(2)))
    out = table("n_words long, n_removed long, kept_sha256 string, spans array<struct<path: long, start: long, words: long, removed: boolean, digest: string>>")
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_settle(layout, window, seed, texts), out + ", kept string" * texts)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, texts: bool = False) -> DataFrame:
    """Words that a document shares with one of a smaller id, and its repeated spans.

    ``(rid, id_col, n_words, n_removed, kept_sha256, spans)`` and, with ``texts``,
    ``kept``: one row for each row of ``docs``. A word goes if a window of
    ``window`` words covers it whose words also stand in a row of a smaller id; a
    null id is larger than any other, and rows of one id do not repeat each other.
    ``spans`` are the document's steps along repeated paths: the path, first word,
    number of words, whether an older document has it, and a digest of the words.
    Null, empty and short texts have no window. The id is an integer; other columns
    are not read. Row numbers come from the scan, so ``docs`` should be a table.
    """
    ship_package(docs.sparkSession)
    for seed in range(8):
        out = materialize(_once(docs, id_col, text_col, window, texts, seed), "repeats")
        steps = out.select(F.explode("spans").alias("s")).select("s.path", "s.words", "s.digest").distinct()
        if steps.groupBy("path", "words").count().filter("count > 1").isEmpty():
            return out.withColumnRenamed("id", id_col)
    raise RuntimeError("repeated paths could not be verified: their window hashes collide")


def repeated_paths(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(path, words, n_documents, n_occurrences, source_id, source_start)`` of ``remove_repeats`` rows."""
    s = found.select(F.col(id_col).alias("id"), "rid", F.explode("spans").alias("s"))
    return s.groupBy("s.path", "s.words").agg(
        F.count(F.lit(1)).alias("n_occurrences"), F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "s.start")).alias("src"),
        F.approx_count_distinct("rid").alias("n_documents")).select(
        "path", "words", "n_documents", "n_occurrences", F.col("src.id").alias("source_id"), F.col("src.start").alias("source_start"))
