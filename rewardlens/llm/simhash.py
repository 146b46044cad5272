"""SimHash near-duplicates with pigeonring filtering.

*Fingerprints.* Each text's word shingles are hashed with XXH64; a bit is set
where over half of the hashes have it. Equal fingerprints are one node.

*Candidates.* The 64 bits are a ring of five segments. With at most four
differing bits some segment begins a chain along the ring whose first segment
has none, whose first two have at most one, whose first three at most two, and
so on: l segments have at most ``l * 4 / 5``. The join key of a chain is its
first segment and two of the four halves of the next two segments, since two
differing bits leave two halves alike. With more fingerprints a key reaches on to a third
and fourth segment (three of six halves, four of eight), so that keys stay rarer than
fingerprints are many. Pairs that meet must pass the whole
chain before the full Hamming distance is taken.

*Groups.* A crowd of near copies meets under the same keys. All pairs of a crowd
are never made: neighbours in the order of each key link first, and components
of those links are taken; afterwards only members of different components meet,
and a key whose members are all in one component is dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rewardlens.llm.common import columns, fresh, materialize, numbered_rows, without
from rewardlens.llm.components import components
from rewardlens.llm.textbatch import LOWER, Words, slices, text_buffer
from rewardlens.session import ship_package

SEED = 42
#: Widths of the ring's segments, the top bits first.
SEGMENTS = (13, 13, 13, 13, 12)
MAX_DISTANCE = 4
#: A key has halves of two segments up to so many different fingerprints, of three up to so many, and then of four.
REACH_UP_TO = ((2, 1 << 26), (3, 1 << 33))


def reach_of(fingerprints: int) -> int:
    return next((reach for reach, most in REACH_UP_TO if fingerprints <= most), 4)


def key_bits(reach: int) -> int:
    """A key holds at most a 13-bit segment and 7-bit halves; above them stands the number of its choice."""
    return 13 + 7 * reach


SHINGLES_AT_ONCE = 1 << 16


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int = 4) -> DataFrame:
    """``(id, fp)``: the SimHash of each row's lower-cased word shingles as a signed long; no word gives 0."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        one = xxhash.xxh64_intdigest
        for batch in batches:
            for part in slices(batch, "text"):
                buf, offs = text_buffer(part.column("text"))
                w = Words(LOWER[buf], offs)
                # the words of all rows, one space after each
                size = w.end - w.start + 1
                end = np.cumsum(size) - 1
                joined = np.full(int(size.sum()), 32, np.uint8)
                keep = np.ones(len(joined), bool)
                keep[end] = False
                joined[keep] = w.buf[w.is_word]
                flat = joined.tobytes()
                begin = end - (size - 1)
                n = np.diff(w.row)
                count = np.where(n == 0, 0, np.maximum(n - words + 1, 1))
                row = np.repeat(np.arange(len(n)), count)
                nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                first = w.row[row] + nth
                a, b = begin[first], end[np.minimum(first + words, w.row[row + 1]) - 1]
                h = np.fromiter((one(flat[i:j], SEED) for i, j in zip(a.tolist(), b.tolist())), np.uint64, len(row))
                ones = np.zeros((len(n), 64), np.int64)
                for s in range(0, len(h), SHINGLES_AT_ONCE):
                    bits = np.unpackbits(h[s:s + SHINGLES_AT_ONCE].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
                    own = row[s:s + SHINGLES_AT_ONCE]
                    at = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                    ones[own[at]] += np.add.reduceat(bits, at, axis=0, dtype=np.int64)
                fp = np.packbits(2 * ones > count[:, None], axis=1).view(">u8").astype(np.uint64).ravel().view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(fp)], ["id", "fp"])

    return rows.mapInArrow(task, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def _bits(fp: Column, low: int, width: int) -> Column:
    return F.shiftright(fp, low).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _layout() -> list[tuple[int, int]]:
    """(lowest bit, width) of each segment."""
    out, top = [], 64
    for w in SEGMENTS:
        top -= w
        out.append((top, w))
    return out


def chain_keys(fp: Column, reach: int = 2) -> Column:
    """The keys under which a fingerprint meets others: for each chain begin, every choice of ``reach`` halves of the next ``reach`` segments."""
    seg, keys, choices = _layout(), [], math.comb(2 * reach, reach)
    for i in range(len(seg)):
        halves = []
        for l in range(1, reach + 1):
            low, width = seg[(i + l) % len(seg)]
            halves += [(low + width // 2, width - width // 2), (low, width // 2)]
        for j, chosen in enumerate(combinations(halves, reach)):
            key = F.lit(0).cast("long")
            for low, width in (seg[i], *chosen):
                key = F.shiftleft(key, width).bitwiseOR(_bits(fp, low, width))
            keys.append(key.bitwiseOR(F.lit((i * choices + j) << key_bits(reach))))
    return F.array(*keys)


def chain_begin(key: Column, reach: int = 2) -> Column:
    return F.floor(F.shiftright(key, key_bits(reach)) / math.comb(2 * reach, reach)).cast("int")


def passes_chain(x: Column, begin: Column) -> Column:
    """Whether the differing bits ``x`` stay within the chain's budgets from segment ``begin`` on."""
    seg, out = _layout(), F.lit(False)
    for i in range(len(seg)):
        ok, total = F.lit(True), F.lit(0)
        for l in range(len(seg)):
            total = total + F.bit_count(_bits(x, *seg[(i + l) % len(seg)]))
            ok = ok & (total <= (l + 1) * MAX_DISTANCE // len(seg))
        out = out | ((begin == i) & ok)
    return out


def near(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= MAX_DISTANCE


def link_fingerprints(fps: DataFrame) -> DataFrame:
    """``(fp, root)`` for every row of distinct ``fps(fp, n)``: the graph's edges are all pairs within ``MAX_DISTANCE`` bits.

    ``n`` is how many rows have the fingerprint; the most frequent one of a key
    is tried as the centre of its crowd.
    """
    reach = reach_of(fps.count())
    keyed = materialize(fps.select("fp", "n", F.explode(chain_keys(F.col("fp"), reach)).alias("key")), "simhash-keys")
    order = Window.partitionBy("key").orderBy("fp")
    beside = keyed.select("fp", F.array(F.lag("fp", 1).over(order), F.lag("fp", 2).over(order)).alias("before")).select("fp", F.explode("before").alias("other"))
    centre = materialize(keyed.groupBy("key").agg(F.count("fp").alias("members"), F.max(F.struct("n", "fp")).alias("top"))
                         .filter("members > 1").select("key", F.col("top.fp").alias("other")), "simhash-centres")
    around = keyed.join(centre, "key").select("fp", "other")
    first = beside.unionByName(around).filter(F.col("other").isNotNull() & (F.col("fp") != F.col("other")) & near(F.col("fp"), F.col("other")))
    roots = materialize(components(first.select(F.col("fp").alias("a"), F.col("other").alias("b"))), "simhash-roots")

    labelled = materialize(keyed.join(roots, keyed["fp"] == roots["node"], "left").select("key", "fp", F.coalesce("root", "fp").alias("root")), "simhash-labelled")
    mixed = materialize(labelled.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("key"), "simhash-mixed")
    open_ = materialize(labelled.join(mixed, "key"), "simhash-open")
    a, b = open_.alias("a"), open_.alias("b")
    x = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.root") < F.col("b.root")) & passes_chain(x, chain_begin(F.col("a.key"), reach)))
    across = met.filter(near(F.col("a.fp"), F.col("b.fp"))).select(F.col("a.root").alias("a"), F.col("b.root").alias("b"))
    joined = materialize(components(across).select(F.col("node").alias("root"), F.col("root").alias("last")), "simhash-joined")
    own = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))
    return own.join(joined, "root", "left").select("fp", F.coalesce("last", "root").alias("root"))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, rid_col: str | None = None) -> DataFrame:
    """Near-duplicate groups: one row for each row of ``docs``.

    ``(rid, id_col, fp, fingerprint, component_id, group_size, kept)``.
    ``component_id`` is the smallest id of the group, null where no row of it has
    an id. A null, empty or blank text has fingerprint 0. Repeated rows and ids
    keep a row each; ``kept`` is true for one row of a group, that with the
    smallest id (a null id comes last), then the first row. ``rid_col`` names a
    column that numbers the rows; without it rows are numbered here. Other
    columns are not read; an empty table gives no rows.
    """
    ship_package(docs.sparkSession)
    rid = F.col(rid_col) if rid_col else F.monotonically_increasing_id()
    marked = docs.select(F.struct(rid.alias("rid"), F.col(id_col).alias("id")).alias("key"), F.col(text_col).alias("text"))
    rows = materialize(fingerprints(marked, "key", "text", words).select(F.col("id.rid").alias("rid"), F.col("id.id").alias("id"), "fp"), "simhash-rows")
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "rid")).alias("first")
    fps = materialize(rows.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), first), "simhash-fps")
    linked = materialize(link_fingerprints(fps.select("fp", "n")), "simhash-linked")
    groups = fps.join(linked, "fp").groupBy("root").agg(F.min("first").alias("first"), F.sum("n").alias("group_size"))
    of_fp = materialize(linked.join(groups, "root").select("fp", "first", "group_size"), "simhash-groups")
    return rows.join(of_fp, "fp").select(
        "rid", F.col("id").alias(id_col), "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("first.id").alias("component_id"), "group_size", (F.col("rid") == F.col("first.rid")).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, as_read: bool = False) -> DataFrame:
    """One row of each near-duplicate group, with all columns of ``docs``.

    Rows are numbered in a written copy, or in place if ``docs`` is a table ``as_read``.
    """
    row = fresh(docs, "row")
    numbered = numbered_rows(docs, row, as_read, "simhash-numbered")
    gone = simhash_groups(numbered, id_col, text_col, words, row).filter("not kept").select(F.col("rid").alias(row))
    return without(numbered, gone, row, "simhash-gone").select(*columns(docs))
