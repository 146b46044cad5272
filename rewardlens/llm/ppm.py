"""Prediction by partial matching over byte contexts, with whole counts and exact code lengths.

*Counts.* Every byte of every text is one event: its ``order`` preceding bytes
(texts begin after as many newlines) and itself. Tasks sort and count the packed
bytes and hand counts on whenever they hold many, Spark adds them up.

*Trie.* A context's suffixes are its shorter contexts, down to the empty one. Events
whose contexts end in the same two bytes share all their contexts of two bytes
and more, so they are dealt out by these two bytes, and a task has whole branches of
the trie at a time; contexts of one byte and none are small tables that all tasks get. No context is left out.

*Probabilities.* Escape method C with symbol exclusion: in a context of ``t``
events of ``d`` symbols a seen symbol has ``c / (t + d)``, the escape
``d / (t + d)``; symbols of the longer contexts are excluded from the shorter
ones; last comes a uniform choice among the bytes not excluded. With frozen
counts the code length of a byte depends on its event only, so it is a table with
a row for each different event of any text, and for each label a code length.

*Scoring.* A text's exact code length is the sum over its events. The most frequent
events (``SENT`` numbers of table at most) go to every task; the different
other events of a text are looked up by a join with the whole table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rewardlens.llm.common import materialize, most_frequent
from rewardlens.llm.textbatch import slices, text_buffer

ORDER = 5  # the default; seven is the most that eight packed bytes allow
START = 10  # texts begin after `order` newlines
HELD = 1 << 20  # different events that a counting task holds before it hands them on
#: Contexts are dealt out by their last bytes, so many of them.
SHARED = 2
#: Events that a task works on together, but for those of one shared suffix.
TOGETHER = 1 << 17
#: Numbers of the events' table (one for each label and two for the event) that every task gets.
SENT = 1 << 23


def padded(buf: np.ndarray, offs: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows' bytes, each row after ``order`` start bytes, and each byte's place there."""
    rows = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    place = np.arange(len(buf)) + order * (rows + 1)
    out = np.full(len(buf) + order * (len(offs) - 1), START, np.uint8)
    out[place] = buf
    return out, place


def _events(buf: np.ndarray, offs: np.ndarray, order: int) -> np.ndarray:
    out, place = padded(buf, offs, order)
    key = np.zeros(len(place), np.uint64)
    for back in range(order, -1, -1):
        key = (key << np.uint64(8)) | out[place - back].astype(np.uint64)
    return key


def _add_up(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if n is None:
        keys = np.sort(keys)
        n = np.ones(len(keys), np.int64)
    else:
        by = np.argsort(keys, kind="stable")
        keys, n = keys[by], n[by]
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(n, at) if len(at) else np.zeros(0, np.int64)


def count_events(labelled: DataFrame, order: int = ORDER) -> DataFrame:
    """``(label, event, n)``: byte events of ``labelled(label, text)``; texts of no label count under a null one."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, list] = {}

        def given() -> Iterator[pa.RecordBatch]:
            for label, parts in held.items():
                keys, n = _merge(parts)
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(n)], ["label", "event", "n"])
            held.clear()

        for batch in batches:
            for part in slices(batch, "text"):
                labels = part.column("label").to_pylist()
                for label in dict.fromkeys(labels):
                    own = part if labels.count(label) == len(labels) else part.filter(pa.array([x == label for x in labels]))
                    held.setdefault(label, []).append(_add_up(_events(*text_buffer(own.column("text")), order)))
                    if len(held[label]) >= 6:
                        held[label] = [_merge(held[label])]
                if sum(len(keys) for parts in held.values() for keys, _ in parts) > HELD:
                    held.update({label: [_merge(parts)] for label, parts in held.items()})
                    if sum(len(parts[0][0]) for parts in held.values()) > HELD // 2:
                        yield from given()
        yield from given()

    rows = labelled.select(F.col("label").cast("string").alias("label"), "text").filter(F.col("text").isNotNull())
    return rows.mapInArrow(task, "label string, event long, n long").groupBy("label", "event").agg(F.sum("n").alias("n"))


def _merge(parts: list) -> tuple[np.ndarray, np.ndarray]:
    return _add_up(np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts]))


class Model(NamedTuple):
    """Labels in order, and ``(event, m, bits)``: each event's number in all texts and its code length under each label."""

    order: int
    labels: list[str]
    table: DataFrame


def _sums(values: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """Column sums of ``values`` (rows x labels) for each group."""
    return np.array([np.bincount(group, column, groups) for column in values.T]).reshape(-1, groups).T


def code_lengths(event: np.ndarray, count: np.ndarray, lower: np.ndarray, order: int) -> np.ndarray:
    """Bits of each event under each label, from the counts (events x labels) of all events of whole shared suffixes.

    ``lower`` has the counts of every (label, byte, next byte).
    """
    labels = count.shape[1]
    symbol = (event & 255).astype(np.int64)
    zero = np.zeros((len(event), labels))
    bits, found = zero.copy(), zero.astype(bool)
    # what the context one longer left: its events' counts here, and how many symbols it has seen
    gone, seen = zero, zero
    empty = lower.sum(1)  # label x next byte
    for k in range(order, -1, -1):
        if k >= SHARED:
            pair, of_pair = np.unique(event & ((1 << (8 * k + 8)) - 1), return_inverse=True)
            n_pair = _sums(count, of_pair, len(pair))
            context, of_context = np.unique(pair >> 8, return_inverse=True)
            here = n_pair[of_pair]
            total, kinds = (_sums(x, of_context, len(context)) for x in (n_pair, (n_pair > 0).astype(float)))
            own = of_context[of_pair]
            total, kinds = total[own], kinds[own]
        elif k == 1:
            byte = (event >> 8 & 255).astype(np.int64)
            here = lower[:, byte, symbol].T
            total, kinds = lower.sum(2)[:, byte].T, (lower > 0).sum(2)[:, byte].T
        else:
            here = empty[:, symbol].T
            total, kinds = (np.broadcast_to(x, zero.shape) for x in (empty.sum(1), (empty > 0).sum(1)))
        t, d = total - gone, kinds - seen
        new = ~found & (here > 0)
        whole = np.maximum(t + d, 1)
        bits += np.where(new, np.log2(whole) - np.log2(np.maximum(here, 1)), 0.0)
        found |= new
        bits += np.where(~found & (d > 0), np.log2(whole) - np.log2(np.maximum(d, 1)), 0.0)
        if k:
            # the counts that this context's symbols have in the next shorter one
            if k > SHARED:
                shorter, of_shorter = np.unique(event & ((1 << (8 * k)) - 1), return_inverse=True)
                below = _sums(count, of_shorter, len(shorter))[of_shorter]
            else:
                below = lower[:, event >> 8 & 255, symbol].T if k == SHARED else None
            if k >= SHARED:
                first = np.unique(of_pair, return_index=True)[1]
                gone = _sums(np.where(n_pair > 0, below[first], 0.0), of_context, len(context))[own]
            else:
                gone = np.einsum("jbs,js->jb", (lower > 0).astype(float), empty)[:, byte].T
            seen = kinds
    left = 256 - (empty > 0).sum(1)
    return bits + np.where(found, 0.0, np.log2(np.maximum(left, 1)))


def fit(events: DataFrame, order: int = ORDER) -> Model:
    """The model of counted ``events(label, event, n)``: learned from those with a label, with a row for every event.

    What reaches the driver are the labels, and at most 65,536 counts for each.
    """
    if not SHARED <= order <= 7:
        raise ValueError(f"the order must be from {SHARED} to 7")
    spark = events.sparkSession
    events = materialize(events, "ppm-events")
    pairs = events.filter("label is not null").groupBy("label", F.col("event").bitwiseAND(F.lit(0xFFFF)).alias("pair")).agg(F.sum("n").alias("n")).toArrow()
    labels = sorted(pairs.column("label").unique().to_pylist())
    lower = np.zeros((len(labels), 1 << 16))
    place = {x: j for j, x in enumerate(labels)}
    lower[[place[x] for x in pairs.column("label").to_pylist()], pairs.column("pair").to_numpy()] = pairs.column("n").to_numpy()
    sent = spark.sparkContext.broadcast((labels, lower.reshape(-1, 256, 256)))

    def worked(event: np.ndarray, label: pa.Array, n: np.ndarray) -> pa.RecordBatch:
        labels, lower = sent.value
        keys, row = np.unique(event, return_inverse=True)
        count = np.zeros((len(keys), len(labels)))
        codes = pa.compute.index_in(label, value_set=pa.array(labels, pa.string())).fill_null(-1).to_numpy(zero_copy_only=False)
        own = codes >= 0
        np.add.at(count, (row[own], codes[own]), n[own])
        bits = code_lengths(keys, count, lower, order).astype(np.float32)
        offs = np.arange(len(keys) + 1, dtype=np.int32) * len(labels)
        return pa.RecordBatch.from_arrays(
            [pa.array(keys), pa.array(np.bincount(row, n, len(keys)).astype(np.int64)), pa.ListArray.from_arrays(pa.array(offs), pa.array(bits.ravel()))], ["event", "m", "bits"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def flush(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(parts)
            return worked(t["event"].to_numpy(), t["label"].combine_chunks(), t["n"].to_numpy())

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < TOGETHER:
                continue
            # all but the last shared suffix are complete
            suffix = batch.column("suffix").to_numpy()
            at = int(np.searchsorted(suffix, suffix[-1]))
            if at == 0 and (len(held) == 1 or held[0].column("suffix")[0].as_py() == suffix[-1]):
                continue
            if at == 0:  # the last suffix began in an earlier batch
                whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                batch, held = whole, [whole]
                at = int(np.searchsorted(whole.column("suffix").to_numpy(), suffix[-1]))
            yield flush([*held[:-1], batch.slice(0, at)])
            held, size = [batch.slice(at)], batch.num_rows - at
        if held:
            yield flush(held)

    suffix = F.shiftright("event", 8).bitwiseAND(F.lit((1 << 8 * SHARED) - 1)).cast("int")
    dealt = events.withColumn("suffix", suffix).repartition("suffix").sortWithinPartitions("suffix")
    return Model(order, labels, materialize(dealt.mapInArrow(task, "event long, m long, bits array<float>"), "ppm-bits"))


def score_texts(rows: DataFrame, model: Model, text: str, name: str, also: Callable[[pa.RecordBatch], list[pa.Array]] | None = None,
                also_schema: str = "", sent: int = SENT) -> DataFrame:
    """``rows`` without their ``text``, with the list column ``name``: its code length under each label of ``model``.

    A null text is empty and takes no bits. Every event of the texts must be in the
    model's table. ``also`` may read more from the same slices, as columns of
    ``also_schema``. Texts are read once and not written.
    """
    spark = rows.sparkSession
    order, labels, table = model
    width = len(labels)
    top = most_frequent(table, "m", sent // (width + 2)).select("event", "bits").orderBy("event").toArrow()
    lists = pa.chunked_array(top.column("bits").chunks, pa.list_(pa.float32())).combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    shared = spark.sparkContext.broadcast((top.column("event").to_numpy(), flat.reshape(top.num_rows, width)))
    kept = [c for c in rows.columns if c != text]
    more = [c.split()[0] for c in also_schema.split(", ")] if also else []

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, table = shared.value
        item = pa.struct([("event", pa.int64()), ("n", pa.int64())])
        for batch in batches:
            for part in slices(batch, text):
                buf, offs = text_buffer(part.column(text))
                keys, inverse = np.unique(_events(buf, offs, order).astype(np.int64), return_inverse=True)
                at = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
                hit = known[at] == keys if len(known) else np.zeros(len(keys), bool)
                bits = np.zeros((part.num_rows, width))
                for j in range(width):
                    each = np.zeros(len(keys))
                    each[hit] = table[at[hit], j]
                    bits[:, j] = np.diff(np.r_[0.0, np.cumsum(each[inverse])][offs])
                missed = np.flatnonzero(~hit[inverse]) if width else np.zeros(0, np.int64)
                owner = np.searchsorted(offs, missed, "right") - 1
                pairs, n = np.unique(owner * np.int64(len(keys) or 1) + inverse[missed], return_counts=True)
                misses = pa.StructArray.from_arrays([pa.array(keys[pairs % (len(keys) or 1)]), pa.array(n.astype(np.int64))], fields=list(item))
                bounds = np.searchsorted(pairs // (len(keys) or 1), np.arange(part.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in kept], *(also(part) if also else []),
                     pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * width), pa.array(bits.ravel())),
                     pa.ListArray.from_arrays(pa.array(bounds), misses)], [*kept, *more, "_sent_bits", "_missed"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != text]
    schema = ", ".join([*kinds, *([also_schema] if also else []), "_sent_bits array<double>", "_missed array<struct<event: long, n: long>>"])
    staged = materialize(rows.mapInArrow(task, schema).withColumn("_text", F.monotonically_increasing_id()), "ppm-scored")
    open_ = staged.filter(F.size("_missed") > 0).select("_text", F.explode("_missed").alias("e")).select("_text", "e.event", "e.n")
    found = open_.join(table.select("event", "bits"), "event")
    rest = found.groupBy("_text").agg(F.array(*[F.sum(F.get("bits", j).cast("double") * F.col("n")) for j in range(width)]).cast("array<double>").alias("_rest"))
    total = F.when(F.col("_rest").isNull(), F.col("_sent_bits")).otherwise(F.zip_with("_sent_bits", "_rest", lambda a, b: a + b))
    return staged.join(rest, "_text", "left").select(*[F.col(f"`{c}`") for c in [*kept, *more]], total.alias(name))
