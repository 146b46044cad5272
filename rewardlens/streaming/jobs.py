"""Structured Streaming forms of the stateful operators.

State lives in the engine: Spark keeps, checkpoints and restores it, a file sink
writes what leaves it exactly once, and a restarted query goes on where it
stopped. Micro-batches may cut the data anywhere.

**The batch clock.** Rows carry the ordinal of their reward batch, which serves
as event time (one second a batch). A batch is closed once a row of a batch more
than ``lateness`` ordinals later has been seen in an earlier micro-batch; what
arrives for it after that is late and left out of all state. A row without a value
moves the clock and counts in nothing, so such a row of a far batch (a
*heartbeat*) closes what is open.

**Hot keys.** Before rows meet by key, each task reduces its own rows: to
moments for each batch, or to the last K rewards of each (prompt, batch). So a
key with a third of all rows sends a few rows a task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rewardlens.operators import rewards as R
from rewardlens.operators import stats as ST
from rewardlens.operators.pack import with_concat_token
from rewardlens.session import ship_package


def file_stream(spark: SparkSession, directory: str, file_name: str, schema: T.StructType, max_files: int = 1) -> DataFrame:
    """A parquet file source restricted to one file name (``pathGlobFilter``)."""
    return (spark.readStream.schema(schema).option("pathGlobFilter", file_name)
            .option("maxFilesPerTrigger", max_files).parquet(directory))


#: Seconds that batch 0 stands for: a watermark begins at 0, and what is not after it is late.
CLOCK_ZERO = 1 << 32


def batch_clock(df: DataFrame, batch: str, lateness: int = 0) -> DataFrame:
    """``df`` with the event time ``_t`` of its batch and a watermark that closes batches."""
    return df.withColumn("_t", F.timestamp_seconds(F.col(batch).cast("long") + CLOCK_ZERO)).withWatermark("_t", f"{lateness + 1} seconds")


def _to_files(df: DataFrame, path: str, checkpoint: str):
    return (df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start())


def _closed(batches: Sequence[int], state: GroupState) -> list[int]:
    """Positions of the batches that the watermark has passed, oldest first."""
    mark = state.getCurrentWatermarkMs()
    return sorted((i for i, b in enumerate(batches) if (b + CLOCK_ZERO) * 1000 <= mark), key=lambda i: batches[i])


def _wait_for(batches: Sequence[int], state: GroupState) -> None:
    """Come back when the oldest of ``batches`` closes."""
    if batches:
        state.setTimeoutTimestamp((min(batches) + CLOCK_ZERO) * 1000 - 1)


# ---------------------------------------------------------------- running moments

Moments = tuple[float, float, float]  # count, mean, sum of squared deviations


def merge_moments(a: Moments, b: Moments) -> Moments:
    """Moments of two sets of values together."""
    n = a[0] + b[0]
    if not b[0] or not n:
        return a
    d = b[1] - a[1]
    return n, a[1] + d * (b[0] / n), a[2] + b[2] + d * d * (a[0] * b[0] / n)


def _batch_partials(value: str, batch: str):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            t = pa.table({"b": rb.column(batch).cast(pa.int64()), "x": rb.column(value).cast(pa.float64())})
            g = t.group_by("b").aggregate([("x", "count"), ("x", "mean"), ("x", "variance")])
            n = g["x_count"].cast(pa.float64()).to_numpy()
            mean = np.nan_to_num(g["x_mean"].to_numpy(zero_copy_only=False).astype(float))
            var = np.nan_to_num(g["x_variance"].to_numpy(zero_copy_only=False).astype(float))
            yield pa.RecordBatch.from_arrays([g["b"].combine_chunks(), *[pa.array(c) for c in (n, mean, var * n)]], ["b", "n", "mean", "m2"])

    return task


def run_running_moments(stream: DataFrame, value: str, batch: str, out_path: str, checkpoint: str, lateness: int = 0):
    """Running moments after each closed reward batch, as :func:`~rewardlens.operators.stats.running_moments` gives them.

    Tasks send moments of their share of each batch; the one state holds the
    moments so far and those of the batches still open. Null values count in
    nothing; a batch without a value has null batch moments; rows without a
    batch are left out.
    """
    ship_package(stream.sparkSession)
    partial = (stream.select(F.col(batch).cast("long").alias(batch), F.col(value).cast("double").alias(value)).filter(F.col(batch).isNotNull())
               .mapInArrow(_batch_partials(value, batch), "b long, n double, mean double, m2 double"))
    kind = stream.schema[batch].dataType.simpleString()

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            *total, open_b, open_n, open_mean, open_m2 = state.get
            open_ = {int(b): m for b, *m in zip(open_b, open_n, open_mean, open_m2)}
        else:
            total = [ST.MOMENTS_INIT_COUNT, 0.0, ST.MOMENTS_INIT_COUNT * ST.MOMENTS_INIT_VAR]
            open_ = {}
        if not state.hasTimedOut:
            for part in parts:
                for b, *m in part[["b", "n", "mean", "m2"]].itertuples(index=False):
                    old = tuple(open_.get(b, (0.0, 0.0, 0.0)))
                    open_[b] = merge_moments(old, tuple(m)) if old[0] else tuple(m)
        out = []
        for i in _closed(batches := list(open_), state):
            own = tuple(open_.pop(batches[i]))
            total = merge_moments(tuple(total), own)
            n, mean, m2 = total
            bn, bmean, bm2 = own
            out.append((batches[i], bmean if bn else None, (bm2 / (bn - 1)) ** 0.5 if bn > 1 else None, mean, m2 / n,
                        (m2 / (n - 1)) ** 0.5 if n > 1 else None, n))
        columns = list(zip(*((b, *m) for b, m in open_.items()))) or [[], [], [], []]
        state.update((*map(float, total), [int(b) for b in columns[0]], *[[float(x) for x in c] for c in columns[1:]]))
        _wait_for(list(open_), state)
        if out:
            yield pd.DataFrame(out, columns=[batch, "batch_mean", "batch_std", "mean", "var", "std", "count"])

    clocked = batch_clock(partial, "b", lateness).withColumn("_all", F.lit(0))
    rows = clocked.groupBy("_all").applyInPandasWithState(
        update, f"{batch} {kind}, batch_mean double, batch_std double, mean double, var double, std double, count double",
        "n double, mean double, m2 double, open_b array<long>, open_n array<double>, open_mean array<double>, open_m2 array<double>",
        "append", GroupStateTimeout.EventTimeTimeout)
    return _to_files(rows, out_path, checkpoint)


# ---------------------------------------------------------------- prompt tracker


def _last_rewards(width: int, k: int):
    """The last ``k`` rewards of every (prompt, batch) of a task's rows, a row each; rows without a reward become one, of their latest batch."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            valued = rb.column("valued")
            beats = rb.filter(pc.invert(valued))
            if beats.num_rows:
                yield beats.slice(int(np.argmax(beats.column("b").to_numpy())), 1)
            rb = rb.filter(valued)
            if not rb.num_rows:
                continue
            code, b, r = _codes(rb.column("p"))[0], rb.column("b").to_numpy(), rb.column("r").to_numpy()
            order = np.lexsort((r, *[rb.column(f"_o{i}").to_numpy() for i in range(width)][::-1], b, code))
            yield rb.take(pa.array(order[_among_last(k, code[order], b[order])]))

    return task


def _codes(prompts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """A number for each prompt, the null one too, and the prompts by number."""
    d = prompts.dictionary_encode(null_encoding="encode")
    return d.indices.to_numpy(), d.dictionary


def _last_of_run(*keys: np.ndarray) -> np.ndarray:
    """For rows that lie together by ``keys``: the position of the last row with the same keys."""
    n = len(keys[0])
    new = np.zeros(max(n - 1, 0), bool)
    for c in keys:
        new |= c[1:] != c[:-1]
    ends = np.r_[np.flatnonzero(new), n - 1] if n else np.zeros(0, np.int64)
    return np.repeat(ends, np.diff(np.r_[-1, ends]))


def _among_last(k: int, *keys: np.ndarray) -> np.ndarray:
    """Which rows are among the last ``k`` with the same keys."""
    return _last_of_run(*keys) - np.arange(len(keys[0])) < k


def _as_long(df: DataFrame, column: str) -> Column:
    """An order column as a number: microseconds of a time, an integer as it is."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column)
    if isinstance(kind, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(column))
    if not isinstance(kind, T.IntegralType):
        raise ValueError(f"the order column {column} is neither an integer nor a time")
    return F.col(column).cast("long")


def run_prompt_tracker(stream: DataFrame, prompt: str, reward: str, batch: str, order: Sequence[str], out_path: str, checkpoint: str,
                       buffer_size: int = 8, lateness: int = 0, buckets: int = 64):
    """One row for each (prompt, closed batch): ``(prompt, batch, len, mean, std)`` of the prompt's buffer after it.

    Prompts are dealt by a hash to ``buckets``, and the state is one of a bucket: a
    call of the state function costs milliseconds, so it takes many prompts in turn.
    It holds of each prompt the last ``buffer_size`` rewards of closed batches, and as
    many of each open batch by ``order`` (integer or time columns, nulls first). Give
    as many buckets as keep one small; a restart needs the number it began with.
    A null prompt is a prompt. Rows without a reward only move the clock.
    """
    ship_package(stream.sparkSession)
    k, names = buffer_size, [f"_o{i}" for i in range(len(order))]
    kind, batch_kind = (stream.schema[c].dataType.simpleString() for c in (prompt, batch))
    # a prompt travels as text: pandas has no integers with nulls
    plain = isinstance(stream.schema[prompt].dataType, T.AtomicType)
    text = F.col(prompt).cast("string") if plain else F.to_json(F.struct(prompt))
    back = F.col("p").cast(kind) if plain else F.from_json("p", stream.select(prompt).schema)[prompt]
    rows = stream.select(text.alias("p"), F.col(batch).cast("long").alias("b"), F.col(reward).isNotNull().alias("valued"), F.col(reward).cast("double").alias("r"),
                         *[F.coalesce(_as_long(stream, c), F.lit(-(1 << 63))).alias(o) for c, o in zip(order, names)]).filter("b is not null")
    values = rows.mapInArrow(_last_rewards(len(order), k), rows.schema)

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        frames, seen = [], -1
        if state.exists:
            prompts, of, *columns, seen = state.get
            frames.append(pd.DataFrame({"p": np.array(prompts, object)[np.array(of, int)], **{c: np.array(x, float if c == "r" else np.int64) for c, x in zip(["b", "r", *names], columns)}}))
        if not state.hasTimedOut:
            frames += [part[part["valued"]][["p", "b", "r", *names]] for part in parts]
        if not sum(map(len, frames)):
            return
        rows = pd.concat(frames)
        code, prompts = _codes(pa.array(rows["p"], pa.string(), from_pandas=True))
        columns = {c: rows[c].to_numpy() for c in ["b", "r", *names]}
        by = np.lexsort((columns["r"], *[columns[c] for c in names[::-1]], columns["b"], code))
        code, columns = code[by], {c: x[by] for c, x in columns.items()}
        b, r = columns["b"], columns["r"]
        mark, ms = state.getCurrentWatermarkMs(), (b + CLOCK_ZERO) * 1000
        closed = ms <= mark
        ends = np.unique(_last_of_run(code, b)[closed & (ms > seen)])
        if len(ends):
            first = np.searchsorted(code, code[ends])
            size = np.minimum(k, ends - first + 1)
            at = ends[:, None] - np.arange(k)
            there = at >= first[:, None]
            buffer = np.where(there, r[np.maximum(at, 0)], 0.0)
            mean = buffer.sum(1) / size
            std = np.sqrt((np.where(there, buffer - mean[:, None], 0.0) ** 2).sum(1) / size)
            yield pd.DataFrame({"p": prompts.take(pa.array(code[ends])).to_pandas(), "b": b[ends], "len": size, "mean": mean, "std": std})
        kept = _among_last(k, code, np.where(closed, -1, b))
        state.update((prompts.to_pylist(), code[kept].tolist(), *[x[kept].tolist() for x in columns.values()], int(mark)))
        if not closed.all():
            _wait_for([int(b[~closed].min())], state)

    dealt = batch_clock(values, "b", lateness).withColumn("_bucket", F.pmod(F.xxhash64("p"), F.lit(buckets)))
    tracked = dealt.groupBy("_bucket").applyInPandasWithState(
        update, "p string, b long, len long, mean double, std double",
        f"p array<string>, of array<int>, b array<long>, r array<double>, {''.join(f'{o} array<long>, ' for o in names)}seen long",
        "append", GroupStateTimeout.EventTimeTimeout)
    return _to_files(tracked.select(back.alias(prompt), F.col("b").cast(batch_kind).alias(batch), "len", "mean", "std"), out_path, checkpoint)


def run_batch_moments(stream: DataFrame, value: str, batch: str, out_path: str, checkpoint: str, lateness: int = 0):
    """``(batch, mean, std, n)`` of each closed batch: an aggregate under the batch clock."""
    kind = stream.schema[batch].dataType.simpleString()
    x = F.col(value).cast("double")
    per = batch_clock(stream, batch, lateness).groupBy("_t", F.col(batch).cast(kind).alias(batch)).agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.count(x).alias("n"))
    return _to_files(per.drop("_t"), out_path, checkpoint)


def tracker_advantages(rows: DataFrame, tracked: DataFrame, batches: DataFrame, prompt: str, reward: str, batch: str,
                       min_count: int = 3, eps: float = ST.TRACKER_EPS) -> DataFrame:
    """``rows`` of closed batches with ``advantage`` and ``cold``, from what the two streams wrote.

    A late row is in no buffer, but is judged by the closed statistics of its
    batch if its prompt has any there.
    """
    t = tracked.select(prompt, batch, F.col("len").alias("_len"), F.col("mean").alias("_pm"), F.col("std").alias("_ps"))
    b = batches.select(batch, F.col("mean").alias("_bm"), F.col("std").alias("_bs"))
    j = ST.null_safe_join(ST.null_safe_join(rows.filter(F.col(reward).isNotNull()), t, [prompt, batch]), b, [batch])
    return ST.with_advantage(j, reward, min_count, eps)


# ---------------------------------------------------------------- metrics, logs


def run_metric_average(stream: DataFrame, out_path: str, checkpoint: str, mode: str = "mode", key: str = "key", value: str = "value",
                       step: str | None = None, lateness: int = 0):
    """Metric means per log call.

    With ``step`` (an integer), a log call is a step on the batch clock and its
    rows may come in any number of micro-batches: ``(mode, step, key, value)`` is
    written when the step closes. Without, a micro-batch is a log call.
    """
    if step is not None:
        logged = stream.filter(F.col(step).isNotNull())
        return _to_files(
            batch_clock(logged, step, lateness).groupBy("_t", mode, step, key).agg(F.avg(F.col(value).cast("double")).alias("_mean"), F.count(value).alias("_n"))
            .filter("_n > 0").select(F.col(mode).alias("mode"), step, R.metric_key(mode, key).alias("key"), F.col("_mean").alias("value")), out_path, checkpoint)

    def handle(mb: DataFrame, epoch: int):
        (R.metric_average(mb, mode, key, value).withColumn("epoch", F.lit(epoch).cast("long")).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(out_path))

    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_completion_log(stream: DataFrame, out_path: str, checkpoint: str, logging_steps: int, step: str = "step"):
    """Continuous append of the logged completions (file sink, exactly once)."""
    return _to_files(R.filter_logging_steps(stream, logging_steps, step), out_path, checkpoint)


# ---------------------------------------------------------------- packing

#: Pieces leave a task in frames of about so many tokens.
FRAME_TOKENS = 1 << 20


def run_pack_constant_length(stream: DataFrame, lane: str, ids: str, order: Sequence[str], out_path: str, checkpoint: str,
                             seq_length: int = 1024, concat_token_id: int | None = 0):
    """``(lane, piece_id, input_ids, labels)``: an endless packer for each lane of the stream.

    The rows of a lane, by micro-batch and in it by ``order``, are one run of
    tokens, each sequence followed by ``concat_token_id``. Full pieces leave at
    once; the unfinished piece and the number of the next one are the lane's state,
    so pieces do not depend on where micro-batches cut. A lane is what one task
    packs in turn: deal rows to lanes by a hash of their key, as many as tasks
    should work. An empty sequence is its concat token; a null one is left out.
    """
    ship_package(stream.sparkSession)
    kind = stream.schema[lane].dataType.simpleString()
    keys = [f"_o{i}" for i in range(len(order))]
    rows = stream.filter(F.col(ids).isNotNull()).select(F.col(lane).alias("lane"), with_concat_token(ids, concat_token_id).cast("array<int>").alias("seq"),
                                                        *[F.col(c).alias(k) for c, k in zip(order, keys)])

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        carry, piece = state.get if state.exists else ([], 0)
        frames = [p for p in parts if len(p)]
        if not frames:
            return
        rows = pd.concat(frames).sort_values(keys, kind="stable")
        runs = [np.asarray(carry, np.int32), *[np.asarray(s, np.int32) for s in rows["seq"]]]
        total = sum(map(len, runs))
        tail, missing = [], total % seq_length
        for run in reversed(runs):  # the unfinished piece: the last tokens of all
            if not missing:
                break
            tail.insert(0, run[max(0, len(run) - missing):])
            missing -= len(tail[0])
        state.update((np.concatenate([np.zeros(0, np.int32), *tail]).tolist(), int(piece) + total // seq_length))
        held, size = [], 0
        for i, run in enumerate(runs):  # pieces leave a frame at a time
            held.append(run)
            size += len(run)
            if size < max(seq_length, FRAME_TOKENS) and i + 1 < len(runs):
                continue
            flat = np.concatenate(held)
            full = size // seq_length
            pieces = list(flat[:full * seq_length].reshape(full, seq_length))
            if full:
                yield pd.DataFrame({lane: [key[0]] * full, "piece_id": np.arange(piece, piece + full), "input_ids": pieces, "labels": pieces})
            held, size, piece = [flat[full * seq_length:]], size - full * seq_length, piece + full

    packed = rows.groupBy("lane").applyInPandasWithState(
        update, f"{lane} {kind}, piece_id long, input_ids array<int>, labels array<int>", "carry array<int>, piece long", "append", GroupStateTimeout.NoTimeout)
    return _to_files(packed, out_path, checkpoint)
