"""Constant-length packing of token sequences.

The reference concatenates every sequence (plus a concat token) into one
stream and cuts it into ``seq_length`` pieces. Here each sequence learns its
start offset in that stream from a bucketed running sum of lengths
(:func:`rewardlens.plans.ordinal.running`), sends only the slices that
overlap each piece, and pieces are reassembled by ``groupBy(piece)`` -- a
group of at most ``seq_length`` tokens. No single task sees the stream.

Buffered packing (``pack_buffered``) closes a buffer once its size reaches
``max_buffer_size`` and drops each buffer's short tail. Buffer boundaries are
a greedy reset-sum over sizes: exact but sequential. It is computed on keys and
sizes only, by a tree of summaries over ranges of the order (see
:func:`buffer_ids`).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rewardlens.operators.sample import draw
from rewardlens.plans.ordinal import range_buckets, running, written
from rewardlens.session import ship_package


def with_concat_token(ids, concat_token_id: int | None) -> Column:
    c = F.col(ids) if isinstance(ids, str) else ids
    if concat_token_id is None:
        return c
    return F.concat(c, F.array(F.lit(concat_token_id).cast("int")))


def format_text(df: DataFrame, formatting: Column | None = None, text_field: str | None = None) -> Column:
    """The text to pack: a formatting expression wins over a text field; one is required."""
    if formatting is not None:
        return formatting
    if text_field is not None:
        return F.col(text_field)
    raise ValueError("name a text field or give a formatting expression")


def concat_token(eos_token_id: int | None, fallback: int = 0) -> int:
    """The reference uses the tokenizer's EOS unless it is 0 / missing."""
    return eos_token_id if eos_token_id else fallback


def pack_constant_length(
    df: DataFrame,
    ids: str,
    order: Sequence[str],
    seq_length: int = 1024,
    concat_token_id: int | None = 0,
    group_cols: Sequence[str] = (),
) -> DataFrame:
    """``(piece_id, input_ids, labels)``: the concatenated stream cut into ``seq_length`` pieces.

    ``order`` is the total order of the stream. ``group_cols`` restart the
    stream per group (e.g. per buffer); the short tail of every stream is
    dropped. ``labels`` equal ``input_ids``.
    """
    L = seq_length
    s = df.withColumn("_seq", with_concat_token(ids, concat_token_id))
    s = s.withColumn("_len", F.size("_seq").cast("long"))
    if group_cols:
        # offsets restart per group; a group (a buffer) is bounded by the buffer
        # size, so a window inside it is a bounded task
        w = Window.partitionBy(*group_cols).orderBy(*order)
        s = s.withColumn("_off", F.sum("_len").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_len"))
        s = s.withColumn("_gt", F.sum("_len").over(Window.partitionBy(*group_cols)))
    else:
        # offsets from keys and lengths only; the tokens join them afterwards
        offs = running(s.select(*order, "_len"), list(order), value=F.col("_len"), out="_off")
        tot = offs.agg(F.sum("_len").alias("_gt"))  # one row
        s = s.join(offs.select(*order, "_off"), list(order)).crossJoin(F.broadcast(tot))
    full = (F.col("_gt") / L).cast("long")  # pieces that are complete
    first = (F.col("_off") / L).cast("long")
    last = F.least(((F.col("_off") + F.col("_len") - 1) / L).cast("long"), full - 1)
    s = s.filter((F.col("_len") > 0) & (first <= last))
    s = s.withColumn("_piece", F.explode(F.sequence(first, last)))
    lo = F.greatest(F.col("_piece") * L - F.col("_off"), F.lit(0))
    hi = F.least((F.col("_piece") + 1) * L - F.col("_off"), F.col("_len"))
    s = s.withColumn("_part", F.slice("_seq", (lo + 1).cast("int"), (hi - lo).cast("int")))
    s = s.withColumn("_at", F.col("_off") + lo)
    g = s.groupBy(*group_cols, "_piece").agg(F.array_sort(F.collect_list(F.struct("_at", "_part"))).alias("_s"))
    ids_out = F.flatten(F.transform("_s", lambda x: x["_part"]))
    return g.select(*group_cols, F.col("_piece").alias("piece_id"), ids_out.alias("input_ids"), ids_out.alias("labels"))


# ---------------------------------------------------------------- buffered packing
#: Neighbouring units that one level of the tree joins.
FAN = 32
SUMMARY = "unit long, thr array<double>, exit array<double>, n array<long>, total double"


def _outcome(e: np.ndarray, thr: np.ndarray, exit_: np.ndarray, n: np.ndarray, total: float) -> tuple[np.ndarray, np.ndarray]:
    """Exit fill and closed buffers of a unit entered with fill ``e``; thresholds descend."""
    at = len(thr) - np.searchsorted(thr[::-1], e, side="right")
    through = at == len(thr)
    if not len(thr):
        return e + total, np.zeros(len(e), np.int64)
    at = np.minimum(at, len(thr) - 1)
    return np.where(through, e + total, exit_[at]), np.where(through, 0, n[at])


def _merge_equal(thr: np.ndarray, exit_: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of neighbouring thresholds with one outcome the lowest stays."""
    keep = np.r_[(exit_[1:] != exit_[:-1]) | (n[1:] != n[:-1]), True] if len(thr) else np.zeros(0, bool)
    return thr[keep], exit_[keep], n[keep]


def _unit(sizes: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """What a run of rows does to the open buffer, for every fill it can be entered with.

    Entered with fill ``e`` the first buffer closes at the first row j with
    ``e >= limit - P[j]`` (P: inclusive prefix sums). From there the walk is fixed:
    each closing row leads to the next, and walks that share one go on together.
    """
    p = np.cumsum(sizes, dtype=np.float64)
    total = float(p[-1]) if len(p) else 0.0
    first = np.flatnonzero(p - sizes < limit)
    after = np.searchsorted(p, p + limit, side="left")  # the row that closes the next buffer
    exit_, n = np.zeros(len(p)), np.ones(len(p), np.int64)
    for j in range(len(p) - 1, -1, -1) if len(first) else ():
        if after[j] < len(p):
            exit_[j], n[j] = exit_[after[j]], n[after[j]] + 1
        else:
            exit_[j] = total - p[j]
    return *_merge_equal(limit - p[first], exit_[first], n[first]), total


def _then(u: tuple, v: tuple) -> tuple:
    """Unit ``u`` followed by unit ``v`` as one unit."""
    thr, exit_, n, total = u
    ends, more = _outcome(exit_, *v)
    low = thr[-1] if len(thr) else np.inf
    late = v[0] - total < low  # entered below all of u's thresholds, u only fills
    return *_merge_equal(np.r_[thr, (v[0] - total)[late]], np.r_[ends, v[1][late]], np.r_[n + more, v[2][late]]), total + v[3]


def _row(unit: int, x: tuple) -> pd.DataFrame:
    return pd.DataFrame({"unit": [unit], "thr": [x[0]], "exit": [x[1]], "n": [x[2]], "total": [x[3]]})


def _rows(pdf: pd.DataFrame) -> list[tuple]:
    pdf = pdf.sort_values("unit")
    return [(int(r.unit), (np.asarray(r.thr, float), np.asarray(r.exit, float), np.asarray(r.n, np.int64), float(r.total))) for r in pdf.itertuples()]


def _combine(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    units = _rows(pdf)
    whole = units[0][1]
    for _, x in units[1:]:
        whole = _then(whole, x)
    return _row(int(key[0]), whole)


def _descend(key: tuple, units: pd.DataFrame, parent: pd.DataFrame) -> pd.DataFrame:
    out = []
    fill, closed = (float(parent["fill"].iloc[0]), int(parent["closed"].iloc[0])) if len(parent) else (0.0, 0)
    for unit, x in _rows(units) if len(units) else ():
        out.append((unit, fill, closed))
        e, n = _outcome(np.array([fill]), *x)
        fill, closed = float(e[0]), closed + int(n[0])
    return pd.DataFrame(out, columns=["unit", "fill", "closed"])


def buffer_ids(df: DataFrame, size: Column, order: Sequence[str], max_buffer_size: float) -> DataFrame:
    """``(order..., buffer_id)``: greedy buffers closing once their size reaches ``max_buffer_size``.

    Only keys and sizes move. Rows are cut into ranges of the order; each range
    sums up what it does to an open buffer of any fill. ``FAN`` neighbouring
    ranges join into one, level by level, up to a single one; then the fill that
    each range really starts with comes back down the same tree, and each range
    numbers its own buffers. A summary has at most as many thresholds as rows fit
    into one buffer, whatever the input's size, and nothing reaches the driver.
    """
    ship_package(df.sparkSession)
    limit, keys = float(max_buffer_size), list(order)
    rows = range_buckets(df.select(*keys, size.cast("double").alias("_sz")), [F.col(k) for k in keys], "_unit")

    def summarise(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return _row(int(key[0]), _unit(pdf.sort_values(keys)["_sz"].fillna(0).to_numpy(), limit))

    levels = [written(rows.groupBy("_unit").applyInPandas(summarise, SUMMARY), "buffer-units")]
    while levels[-1].count() > 1:
        levels.append(written(levels[-1].groupBy(F.floor(F.col("unit") / FAN).alias("up")).applyInPandas(_combine, SUMMARY), "buffer-units"))
    start = levels[-1].select(F.col("unit"), F.lit(0.0).alias("fill"), F.lit(0).cast("long").alias("closed"))
    for level in levels[-2::-1]:
        start = written(level.groupBy(F.floor(F.col("unit") / FAN).alias("up")).cogroup(start.groupBy(F.col("unit").alias("up")))
                        .applyInPandas(_descend, "unit long, fill double, closed long"), "buffer-starts")

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(keys)
        p = np.cumsum(pdf["_sz"].fillna(0).to_numpy(), dtype=np.float64)
        number = np.zeros(len(p) + 1, np.int64)
        at = int(np.searchsorted(p, limit - float(pdf["fill"].iloc[0]), side="left"))
        while at < len(p):  # one step for each buffer that closes
            number[at + 1] += 1
            at = int(np.searchsorted(p, p[at] + limit, side="left"))
        return pdf[keys].assign(buffer_id=int(pdf["closed"].iloc[0]) + np.cumsum(number)[:-1])

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", buffer_id long"
    return rows.join(start, rows["_unit"] == start["unit"]).select(*keys, "_sz", "_unit", "fill", "closed").groupBy("_unit").applyInPandas(assign, schema)


def shuffle_pieces(pieces: DataFrame, seed: int, group_cols: Sequence[str] = ("buffer_id",), piece: str = "piece_id") -> DataFrame:
    """Finished pieces in a seeded order inside their buffer; ``piece`` becomes the new position."""
    key = F.concat_ws(":", *group_cols, piece)
    w = Window.partitionBy(*group_cols).orderBy(draw(key, seed), piece)
    return pieces.withColumn(piece, (F.row_number().over(w) - 1).cast("long"))


def pack_buffered(
    df: DataFrame,
    ids: str,
    order: Sequence[str],
    seq_length: int = 1024,
    num_of_sequences: int = 1024,
    chars_per_token: float = 3.6,
    text_len: Column | None = None,
    concat_token_id: int | None = 0,
    shuffle_seed: int | None = None,
) -> DataFrame:
    """Pack per buffer: tails are dropped once per buffer, as in the reference.

    With ``shuffle_seed`` a buffer's texts, and then its finished pieces, come in a seeded order.

    Buffers are measured in characters (``text_len``) or, for pre-tokenised
    input (``text_len=None``), in tokens.
    """
    if text_len is None:
        M = seq_length * num_of_sequences
        size = F.size(ids)
    else:
        M = seq_length * chars_per_token * num_of_sequences
        size = text_len
    withb = df.select(*order, ids).join(buffer_ids(df, size, order, M), list(order))
    if shuffle_seed is None:
        return pack_constant_length(withb, ids, order, seq_length, concat_token_id, group_cols=["buffer_id"])
    # the buffer's texts in a seeded order, cut, and the pieces in another
    mixed = withb.withColumn("_draw", draw(F.concat_ws(":", *order), shuffle_seed))
    pieces = pack_constant_length(mixed, ids, ["_draw", *order], seq_length, concat_token_id, group_cols=["buffer_id"])
    return shuffle_pieces(pieces, shuffle_seed)
