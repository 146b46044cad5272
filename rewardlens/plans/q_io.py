"""Source and sink queries. Sinks write under ``spark.checkpoint.dir`` and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from rewardlens.functions.common import round6
from rewardlens.operators import rewards as R
from rewardlens.operators import stats as ST
from rewardlens.plans import fixtures as V
from rewardlens.plans.catalog import query
from rewardlens.plans.q_stats import SQL_SCORE_HISTOGRAM, long_scores
from rewardlens.session import scratch_path
from rewardlens.sources import sinks as K
from rewardlens.sources.split_source import read_split
from rewardlens.sources.tables import read_preference, read_table, split_head, table_path


@query("src_preference", f"""
SELECT idx, question, chosen, rejected, 'saved_images/' || CAST(idx AS VARCHAR) || '.jpg' AS image_path FROM ({V.SQL_PREF_TEXT})""")
def q_src_preference(spark, sf):
    t = V.pref_text(spark, sf).select(
        F.col("idx").cast("long").alias("idx"), "question", "chosen", "rejected",
        F.concat(F.lit("saved_images/"), F.col("idx").cast("string"), F.lit(".jpg")).alias("image_path"))
    path = scratch_path(spark, "preference")
    t.write.mode("overwrite").parquet(path)
    return read_preference(spark, path)


PCT = 5


@query("src_split_head", f"""
WITH o AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS ord FROM orders)
SELECT o_orderkey, o_custkey, o_totalprice FROM o
WHERE ord < (SELECT CAST(round_even(count(*) * {PCT} / 100.0, 0) AS BIGINT) FROM orders)""")
def q_src_split_head(spark, sf):
    o = read_table(spark, sf, "orders", ["o_orderkey", "o_custkey", "o_totalprice"])
    return split_head(o, "o_orderkey", PCT)


def _sql_rows(low: str, high: str, also: str = "true") -> str:
    return f"""
SELECT o_orderkey, o_custkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS ord, count(*) OVER () AS n FROM orders)
WHERE ord >= {low} AND ord < {high} AND {also}"""


def _sql_pct(pct: int) -> str:
    return f"CAST(round_even(n * {pct} / 100.0, 0) AS BIGINT)"


# the file of orders is in key order, so its first rows are those of the lowest keys
@query("src_split_option", _sql_rows("0", _sql_pct(PCT)))
def q_src_split_option(spark, sf):
    return read_split(spark, table_path(sf, "orders"), f"train[:{PCT}%]", ["o_orderkey", "o_custkey", "o_totalprice"])


@query("src_split_parts", f"""{_sql_rows(_sql_pct(40), _sql_pct(60), "o_totalprice > 100000")}
UNION ALL {_sql_rows("n - 100", "n", "o_totalprice > 100000")}""")
def q_src_split_parts(spark, sf):
    """The middle fifth and the last hundred rows, of these the dearer ones: the filter reaches the source."""
    o = read_split(spark, table_path(sf, "orders"), "train[40%:60%]+train[-100:]", ["o_orderkey", "o_custkey", "o_totalprice"])
    return o.filter(F.col("o_totalprice") > 100000)


@query("src_take", """SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 501""")
def q_src_take(spark, sf):
    # the reference stops after its counter passes 500: 501 rows
    return read_table(spark, sf, "orders", ["o_orderkey", "o_totalprice"]).orderBy("o_orderkey").limit(501)


@query("sink_score_log", f"""
SELECT idx, question, round(chosen_score, 6) AS chosen_score, round(rejected_score, 6) AS rejected_score,
       len(generated_scores) AS n_generated, 'saved_images/' || CAST(idx AS VARCHAR) || '.jpg' AS image_path,
       rejected AS rejected_text
FROM ({V.SQL_SCORED})""")
def q_sink_score_log(spark, sf):
    rec = K.score_log_records(V.scored(spark, sf))
    path = scratch_path(spark, "score_log")
    K.append_json(rec, path)
    back = K.read_json(spark, path, K.SCORE_LOG_SCHEMA)
    return back.select("idx", "question", round6("chosen_score").alias("chosen_score"), round6("rejected_score").alias("rejected_score"),
                       F.size("generated_score").cast("long").alias("n_generated"), "image_path",
                       F.get(F.col("rejected"), 1)["content"].alias("rejected_text"))


@query("sink_json_report", f"""
SELECT 'average_chosen_score' AS entry, CAST(NULL AS BIGINT) AS bin, round(avg(chosen_score), 6) AS value FROM ({V.SQL_SCORED})
UNION ALL SELECT 'average_rejected_score', NULL, round(avg(rejected_score), 6) FROM ({V.SQL_SCORED})
UNION ALL SELECT 'average_generated_score', NULL, round(avg(list_sum(generated_scores) / len(generated_scores)), 6) FROM ({V.SQL_SCORED})
UNION ALL SELECT 'histogram_' || series, bin, CAST(count AS DOUBLE) FROM ({SQL_SCORE_HISTOGRAM})""")
def q_sink_json_report(spark, sf):
    """Averages and the inputs of the three histograms, as one JSON line for each entry."""
    rep = ST.score_averages(V.scored(spark, sf))
    lines = rep.select(F.explode(F.array(*[F.struct(F.lit(c).alias("entry"), F.lit(None).cast("long").alias("bin"), F.col(c).alias("value")) for c in rep.columns])).alias("l")).select("l.*")
    hist = ST.score_histogram(long_scores(spark, sf)).select(
        F.concat(F.lit("histogram_"), "series").alias("entry"), F.col("bin").cast("long").alias("bin"), F.col("count").cast("double").alias("value"))
    path = scratch_path(spark, "report")
    lines.unionByName(hist).write.json(path)
    back = spark.read.schema("entry string, bin long, value double").json(path)
    return back.select("entry", "bin", round6("value").alias("value"))


ORACLE_SINK_COMPLETION = """
SELECT event_id AS step, CAST(user_id AS VARCHAR) AS prompt, event_type AS completion, value AS reward FROM events WHERE event_id % 10 = 0"""


@query("sink_completion_log", ORACLE_SINK_COMPLETION)
def q_sink_completion_log(spark, sf):
    ev = read_table(spark, sf, "events", ["event_id", "user_id", "event_type", "value"])
    log = ev.select(F.col("event_id").alias("step"), F.col("user_id").cast("string").alias("prompt"),
                    F.col("event_type").alias("completion"), F.col("value").alias("reward"))
    path = scratch_path(spark, "completions")
    K.append_parquet(R.filter_logging_steps(log, 10, "step"), path)
    return spark.read.parquet(path)


LOG_EVERY = 100


@query("sink_metrics", f"""
SELECT mode, step // {LOG_EVERY} * {LOG_EVERY} AS step, CASE WHEN mode = 'eval' THEN 'eval_' || key ELSE key END AS key, round(avg(value), 6) AS value
FROM ({V.SQL_METRIC_LOG}) GROUP BY ALL""")
def q_sink_metrics(spark, sf):
    log = V.metric_log(spark, sf).withColumn("step", (F.col("step") / LOG_EVERY).cast("long") * LOG_EVERY)
    path = scratch_path(spark, "metrics")
    K.append_parquet(R.metric_average(log, step="step"), path)
    back = spark.read.parquet(path)
    return back.select("mode", "step", "key", round6("value").alias("value"))


@query("state_save_load", f"""
SELECT CAST(count(reward) AS DOUBLE) AS count, round(avg(reward), 6) AS mean, round(stddev_samp(reward), 6) AS std,
       round(var_pop(reward), 6) AS var FROM ({V.SQL_BATCHES})""")
def q_state_save_load(spark, sf):
    rm = ST.running_moments(V.batches(spark, sf), "reward", "batch_id")
    last = rm.orderBy(F.col("batch_id").desc()).limit(1).select("count", "mean", "std", "var")
    path = scratch_path(spark, "moments")
    K.save_state(last, path)
    back = K.load_state(spark, path)
    return back.select(*[round6(c).alias(c) for c in ("count", "mean", "std", "var")])
