"""Streaming queries: each runs a Structured Streaming job (availableNow) over
the events or documents into a fresh folder under ``spark.checkpoint.dir`` and
returns what its sink holds. Where state is kept, the rows arrive in three
micro-batches that cut reward batches in two, so the state is carried, and a
heartbeat closes the last batch. The oracle is the batch form's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rewardlens.functions.common import round6
from rewardlens.plans import fixtures as V
from rewardlens.plans.catalog import query
from rewardlens.plans.q_io import ORACLE_SINK_COMPLETION
from rewardlens.plans.q_rewards import SQL_METRIC_AVERAGE
from rewardlens.plans.q_stats import SQL_PROMPT_TRACKER, SQL_RUNNING_MOMENTS, K, MIN_COUNT
from rewardlens.plans.q_tokens import EOS, PACK_LEN, SQL_IDS, _out, token_table
from rewardlens.session import scratch_path
from rewardlens.streaming import jobs as J
from rewardlens.sources.tables import read_table


def _events_stream(spark, sf):
    schema = read_table(spark, sf, "events").schema
    return J.file_stream(spark, sf, "events.parquet", schema)


MICRO_BATCHES = 3
#: No reward batch has this number: a row of it only moves the clock.
FAR = 10_000_000


def arriving(df: DataFrame, run: F.Column | list[F.Column], name: str, last: DataFrame | None = None) -> DataFrame:
    """``df`` as a stream whose rows arrive by ``run`` (0, 1, 2, or a condition for each turn), a micro-batch each, the rows of ``last`` with the last.

    Every run is written by as many tasks as the session has cores, one file each.
    """
    spark = df.sparkSession
    path, files = scratch_path(spark, name), spark.sparkContext.defaultParallelism
    turns = run if isinstance(run, list) else [run == k for k in range(MICRO_BATCHES)]
    for k, turn in enumerate(turns):
        rows = df.filter(turn)
        if last is not None and k == len(turns) - 1:
            rows = rows.unionByName(last)
        rows.repartition(files).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


def _batches_stream(spark, sf):
    b = V.batches(spark, sf)
    # thirds of the month that begin and end inside a day
    run = F.floor((F.unix_seconds(F.col("ts").cast("timestamp")) / 86400 - F.lit(19723)) * MICRO_BATCHES / 31)
    beat = spark.range(1).select(*[(F.lit(FAR) if f.name == "batch_id" else F.lit(None)).cast(f.dataType).alias(f.name) for f in b.schema.fields])
    return arriving(b, F.greatest(F.lit(0), F.least(run, F.lit(MICRO_BATCHES - 1))), "event-files", beat)


def _run(*queries):
    for q in queries:
        q.awaitTermination()
        if q.exception() is not None:
            raise RuntimeError(str(q.exception()))


@query("stream_running_moments", SQL_RUNNING_MOMENTS)
def q_stream_running_moments(spark, sf):
    out, ck = scratch_path(spark, "rm-out"), scratch_path(spark, "rm-ckpt")
    _run(J.run_running_moments(_batches_stream(spark, sf), "reward", "batch_id", out, ck))
    r = spark.read.parquet(out)
    return r.select(*[round6(c).alias(c) if t == "double" else F.col(c) for c, t in r.dtypes])


#: Events of a bucket of prompts, about.
BUCKET_ROWS = 50_000


@query("stream_prompt_tracker", SQL_PROMPT_TRACKER)
def q_stream_prompt_tracker(spark, sf):
    tracked, tracked_ck, closed, closed_ck = (scratch_path(spark, n) for n in ("pt-out", "pt-ckpt", "pb-out", "pb-ckpt"))
    stream = _batches_stream(spark, sf)
    buckets = max(32, -(-V.batches(spark, sf).count() // BUCKET_ROWS))
    _run(J.run_prompt_tracker(stream, "prompt", "reward", "batch_id", ["ts", "event_id"], tracked, tracked_ck, K, buckets=buckets),
         J.run_batch_moments(stream, "reward", "batch_id", closed, closed_ck))
    r = J.tracker_advantages(V.batches(spark, sf), spark.read.parquet(tracked), spark.read.parquet(closed), "prompt", "reward", "batch_id", MIN_COUNT)
    return r.select("event_id", "batch_id", "prompt", "cold", round6("advantage").alias("advantage"))


@query("stream_completion_log", ORACLE_SINK_COMPLETION)
def q_stream_completion_log(spark, sf):
    ev = _events_stream(spark, sf).select(
        F.col("event_id").alias("step"), F.col("user_id").cast("string").alias("prompt"),
        F.col("event_type").alias("completion"), F.col("value").alias("reward"))
    out, ck = scratch_path(spark, "cl-out"), scratch_path(spark, "cl-ckpt")
    _run(J.run_completion_log(ev, out, ck, 10))
    return spark.read.parquet(out)


@query("stream_metric_average", SQL_METRIC_AVERAGE)
def q_stream_metric_average(spark, sf):
    ev = _events_stream(spark, sf).select(
        F.when(F.col("event_type") == "error", "eval").otherwise("train").alias("mode"),
        F.col("event_type").alias("key"), F.col("event_id").alias("step"), "value")
    out, ck = scratch_path(spark, "ma-out"), scratch_path(spark, "ma-ckpt")
    _run(J.run_metric_average(ev, out, ck))
    r = spark.read.parquet(out)
    return r.select("mode", "key", round6("value").alias("value"))


STEP = 500


@query("stream_metric_average_steps", f"""
SELECT mode, step, CASE WHEN mode = 'eval' THEN 'eval_' || key ELSE key END AS key, round(avg(value), 9) AS value
FROM (SELECT mode, step // {STEP} AS step, key, value FROM ({V.SQL_METRIC_LOG})) GROUP BY mode, step, key""")
def q_stream_metric_average_steps(spark, sf):
    """Log calls of ``STEP`` steps whose rows come in three micro-batches, dealt by hash and in no order."""
    m = V.metric_log(spark, sf).withColumn("step", F.floor(F.col("step") / STEP).cast("long"))
    steps = m.agg(F.max("step")).first()[0] or 0
    beat = spark.range(1).select(*[(F.lit(FAR) if f.name == "step" else F.lit(None)).cast(f.dataType).alias(f.name) for f in m.schema.fields])
    log = arriving(m, F.pmod(F.xxhash64("step", "key", "value"), F.lit(MICRO_BATCHES)), "metric-files", beat)
    out, ck = scratch_path(spark, "ms-out"), scratch_path(spark, "ms-ckpt")
    _run(J.run_metric_average(log, out, ck, step="step", lateness=steps))
    # values have two decimals, so at six an average over a multiple of 32 rows may fall halfway
    return spark.read.parquet(out).select("mode", "step", "key", F.round("value", 9).alias("value"))


LANES = 8
#: Tokens that a lane packs in one micro-batch, about.
TURN_TOKENS = 1 << 23


def doc_turns(t: DataFrame, tokens: int, turn_tokens: int = TURN_TOKENS) -> list[F.Column]:
    """Conditions that cut the documents into ranges of ids, as many as keep a lane's share of one small, three at least."""
    n = max(MICRO_BATCHES, -(-tokens // (LANES * turn_tokens)))
    doc = F.col("doc_id")
    if n == MICRO_BATCHES:
        most = t.agg(F.max(doc)).first()[0] or 0
        return [F.floor(doc * n / (most + 1)) == k for k in range(n)]
    cut = sorted(set(t.agg(F.percentile_approx(doc, [k / n for k in range(1, n)], 10_000)).first()[0]))
    return [doc <= cut[0], *[(doc > a) & (doc <= b) for a, b in zip(cut, cut[1:])], doc > cut[-1]]


@query("stream_pack_constant_length", f"""
WITH s AS (SELECT doc_id, doc_id % {LANES} AS lane, list_concat(ids, [{EOS}]) AS seq FROM ({SQL_IDS})),
e AS (SELECT lane, doc_id, generate_subscripts(seq, 1) AS i, unnest(seq) AS x FROM s),
g AS (SELECT lane, x, row_number() OVER (PARTITION BY lane ORDER BY doc_id, i) - 1 AS gp, count(*) OVER (PARTITION BY lane) AS n FROM e)
SELECT lane, gp // {PACK_LEN} AS piece_id, count(*) AS input_ids_size, CAST(sum((gp % {PACK_LEN} + 1) * (CAST(x AS BIGINT) + 128)) AS BIGINT) AS input_ids_digest
FROM g WHERE gp // {PACK_LEN} < n // {PACK_LEN} GROUP BY lane, gp // {PACK_LEN}""")
def q_stream_pack_constant_length(spark, sf):
    t = token_table(spark, sf).withColumn("lane", F.col("doc_id") % LANES)
    tokens = t.agg(F.sum(F.size("ids") + 1)).first()[0] or 0
    stream = arriving(t, doc_turns(t, tokens), "token-files")
    out, ck = scratch_path(spark, "pc-out"), scratch_path(spark, "pc-ckpt")
    _run(J.run_pack_constant_length(stream, "lane", "ids", ["doc_id"], out, ck, PACK_LEN, EOS))
    return _out(spark.read.parquet(out), ["input_ids"], keys=("lane", "piece_id"))
