"""Score-report and statistics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rewardlens.functions.common import round6
from rewardlens.operators import stats as ST
from rewardlens.plans import fixtures as V
from rewardlens.plans.catalog import query
from rewardlens.plans.ordinal import running
from rewardlens.sources.tables import read_table

K, MIN_COUNT = 8, 3


def _r(df):
    return df.select(*[round6(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


SQL_GEN_MEAN = "list_sum(generated_scores) / len(generated_scores)"


@query("score_averages", f"""
SELECT round(avg(chosen_score), 6) AS average_chosen_score, round(avg(rejected_score), 6) AS average_rejected_score,
       round(avg({SQL_GEN_MEAN}), 6) AS average_generated_score FROM ({V.SQL_SCORED})""")
def q_score_averages(spark, sf):
    return _r(ST.score_averages(V.scored(spark, sf)))


@query("reward_gap", f"""
SELECT round(avg(chosen_score), 6) AS avg_chosen_reward, round(avg(rejected_score), 6) AS avg_rejected_reward,
       round(avg(chosen_score - rejected_score), 6) AS avg_reward_gap FROM ({V.SQL_SCORED})""")
def q_reward_gap(spark, sf):
    return _r(ST.reward_gap(V.scored(spark, sf), "chosen_score", "rejected_score"))


SQL_LONG_SCORES = f"""
SELECT idx, 'chosen' AS series, chosen_score AS score FROM ({V.SQL_SCORED})
UNION ALL SELECT idx, 'rejected', rejected_score FROM ({V.SQL_SCORED})
UNION ALL SELECT idx, 'generated', {SQL_GEN_MEAN} FROM ({V.SQL_SCORED})"""


def long_scores(spark, sf):
    s = V.scored(spark, sf)
    gen = F.aggregate("generated_scores", F.lit(0.0), lambda a, x: a + x) / F.size("generated_scores")
    return ST.union_scores(s, ["idx"], {"chosen": "chosen_score", "rejected": "rejected_score", "generated": gen})


@query("union_scores", f"SELECT idx, series, round(score, 6) AS score FROM ({SQL_LONG_SCORES})")
def q_union_scores(spark, sf):
    return _r(long_scores(spark, sf))


@query("score_range", f"SELECT round(min(score), 6) AS lo, round(max(score), 6) AS hi FROM ({SQL_LONG_SCORES})")
def q_score_range(spark, sf):
    return _r(ST.score_range(long_scores(spark, sf)))


SQL_SCORE_HISTOGRAM = f"""
WITH l AS ({SQL_LONG_SCORES}),
r AS (SELECT CASE WHEN min(score) = max(score) THEN min(score) - 0.5 ELSE min(score) END AS lo,
             CASE WHEN min(score) = max(score) THEN max(score) + 0.5 ELSE max(score) END AS hi FROM l),
a AS (SELECT series, score AS x, lo, hi, (hi - lo) / 50.0 AS step,
             least(CAST(floor((score - lo) * (50.0 / (hi - lo))) AS INTEGER), 49) AS i0 FROM l, r),
b AS (SELECT *, CASE WHEN x < (CASE WHEN i0 = 50 THEN hi ELSE 0.0 + i0 * step + lo END) THEN i0 - 1 ELSE i0 END AS i1 FROM a),
c AS (SELECT *, CASE WHEN x >= (CASE WHEN i1 + 1 = 50 THEN hi ELSE 0.0 + (i1 + 1) * step + lo END) AND i1 <> 49
                     THEN i1 + 1 ELSE i1 END AS i2 FROM b)
SELECT series, CAST(i2 AS BIGINT) AS bin, count(*) AS count FROM c GROUP BY series, i2"""


@query("score_histogram", SQL_SCORE_HISTOGRAM)
def q_score_histogram(spark, sf):
    return ST.score_histogram(long_scores(spark, sf))


@query("union_pairs", f"""
SELECT idx, 'chosen' AS series, chosen AS text FROM ({V.SQL_PREF_TEXT})
UNION ALL SELECT idx, 'rejected', rejected FROM ({V.SQL_PREF_TEXT})""")
def q_union_pairs(spark, sf):
    t = V.pref_text(spark, sf)
    return t.select("idx", F.explode(F.array(
        F.struct(F.lit("chosen").alias("series"), F.col("chosen").alias("text")),
        F.struct(F.lit("rejected").alias("series"), F.col("rejected").alias("text")),
    )).alias("u")).select("idx", "u.series", "u.text")


@query("pairwise_accuracy", f"""
SELECT round(avg(CASE WHEN score_0 <> score_1 THEN CAST((CASE WHEN score_1 > score_0 THEN 1 ELSE 0 END) = label AS DOUBLE) END), 6) AS accuracy,
       count(*) FILTER (WHERE score_0 = score_1) AS n_ties
FROM ({V.SQL_PAIRS})""")
def q_pairwise_accuracy(spark, sf):
    return _r(ST.pairwise_accuracy(V.pairs(spark, sf)))


@query("token_accuracy", """
WITH t AS (SELECT vec_id, label, k, embedding[8 * k + 1: 8 * k + 8] AS v FROM embeddings, range(8) r(k)),
u AS (SELECT list_position(v, list_max(v)) - 1 AS p, CASE WHEN k <= label THEN (label + k) % 8 ELSE -100 END AS l FROM t)
SELECT round(avg(CAST(p = l AS DOUBLE)), 6) AS accuracy FROM u WHERE l <> -100""")
def q_token_accuracy(spark, sf):
    e = read_table(spark, sf, "embeddings")
    ks = F.sequence(F.lit(0), F.lit(7))
    logits = F.transform(ks, lambda k: F.slice("embedding", k * 8 + 1, 8))
    labels = F.transform(ks, lambda k: F.when(k <= F.col("label"), (F.col("label") + k) % 8).otherwise(F.lit(-100)))
    return _r(ST.token_accuracy(e.select(logits.alias("logits"), labels.alias("labels")), "logits", "labels"))


@query("batch_moments", f"""
SELECT batch_id, count(reward) AS count, round(avg(reward), 6) AS mean, round(var_pop(reward), 6) AS var
FROM ({V.SQL_BATCHES}) GROUP BY batch_id""")
def q_batch_moments(spark, sf):
    return _r(ST.batch_moments(V.batches(spark, sf), "reward", "batch_id"))


@query("batch_moments_masked", f"""
WITH b AS (SELECT *, CAST(event_id % 3 <> 0 AS INTEGER) AS m FROM ({V.SQL_BATCHES}))
SELECT batch_id, CAST(sum(m) AS DOUBLE) AS count, round(avg(reward) FILTER (WHERE m = 1), 6) AS mean,
       round(var_pop(reward) FILTER (WHERE m = 1), 6) AS var FROM b GROUP BY batch_id""")
def q_batch_moments_masked(spark, sf):
    b = V.batches(spark, sf).withColumn("m", (F.col("event_id") % 3 != 0).cast("int"))
    return _r(ST.batch_moments(b, "reward", "batch_id", mask="m"))


@query("batch_moments_compat", f"""
WITH b AS (SELECT *, CAST(event_id % 3 <> 0 AS INTEGER) AS m FROM ({V.SQL_BATCHES})),
s AS (SELECT batch_id, CAST(sum(m) AS DOUBLE) AS n, sum(reward) / sum(m) AS mean FROM b GROUP BY batch_id)
SELECT batch_id, any_value(n) AS count, round(any_value(mean), 6) AS mean, round(sum(m * (reward - mean) ** 2) / any_value(n), 6) AS var
FROM b JOIN s USING (batch_id) GROUP BY batch_id""")
def q_batch_moments_compat(spark, sf):
    b = V.batches(spark, sf).withColumn("m", (F.col("event_id") % 3 != 0).cast("int"))
    return _r(ST.batch_moments(b, "reward", "batch_id", mask="m", compat=True))


SQL_RUNNING_MOMENTS = f"""
WITH b AS ({V.SQL_BATCHES}),
o AS (SELECT batch_id, avg(reward) AS bm, stddev_samp(reward) AS bs FROM b GROUP BY batch_id),
r AS (SELECT batch_id, avg(reward) OVER w AS mean, var_pop(reward) OVER w AS var, stddev_samp(reward) OVER w AS std,
             CAST(count(reward) OVER w AS DOUBLE) AS count
      FROM b WINDOW w AS (ORDER BY batch_id RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT DISTINCT batch_id, round(bm, 6) AS batch_mean, round(bs, 6) AS batch_std, round(mean, 6) AS mean,
       round(var, 6) AS var, round(std, 6) AS std, count FROM r JOIN o USING (batch_id)"""


@query("running_moments", SQL_RUNNING_MOMENTS)
def q_running_moments(spark, sf):
    return _r(ST.running_moments(V.batches(spark, sf), "reward", "batch_id"))


SQL_PROMPT_TRACKER = f"""
WITH b AS ({V.SQL_BATCHES}),
w AS (SELECT *, avg(reward) OVER f AS pm, stddev_pop(reward) OVER f AS ps, count(*) OVER g AS cn
      FROM b WINDOW f AS (PARTITION BY prompt ORDER BY batch_id, ts, event_id ROWS BETWEEN {K - 1} PRECEDING AND CURRENT ROW),
                    g AS (PARTITION BY prompt ORDER BY batch_id, ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
e AS (SELECT prompt, batch_id, arg_max(pm, (ts, event_id)) AS pm, arg_max(ps, (ts, event_id)) AS ps,
             least({K}, arg_max(cn, (ts, event_id))) AS len FROM w GROUP BY prompt, batch_id),
s AS (SELECT batch_id, avg(reward) AS bm, stddev_pop(reward) AS bs FROM b GROUP BY batch_id)
SELECT b.event_id, b.batch_id, b.prompt, e.len < {MIN_COUNT} AS cold,
       round((b.reward - CASE WHEN e.len < {MIN_COUNT} THEN s.bm ELSE e.pm END)
             / ((CASE WHEN e.len < {MIN_COUNT} THEN s.bs ELSE e.ps END) + 1e-6), 6) AS advantage
FROM b JOIN e ON b.prompt = e.prompt AND b.batch_id = e.batch_id JOIN s ON b.batch_id = s.batch_id"""


@query("prompt_tracker", SQL_PROMPT_TRACKER)
def q_prompt_tracker(spark, sf):
    t = ST.prompt_tracker(V.batches(spark, sf), "prompt", "reward", "batch_id", ["ts", "event_id"], K, MIN_COUNT)
    return t.select("event_id", "batch_id", "prompt", "cold", round6("advantage").alias("advantage"))


@query("prompt_stats", f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY prompt ORDER BY ts DESC, event_id DESC) AS rn FROM ({V.SQL_BATCHES}))
SELECT prompt, round(avg(reward), 6) AS mean, round(stddev_pop(reward), 6) AS std, count(reward) AS count
FROM r WHERE rn <= {K} GROUP BY prompt""")
def q_prompt_stats(spark, sf):
    return _r(ST.prompt_stats(V.batches(spark, sf), "prompt", "reward", ["ts", "event_id"], K))


@query("ordered_distinct", f"""
SELECT prompt, min(ts) AS ts, arg_min(event_id, (ts, event_id)) AS event_id FROM ({V.SQL_BATCHES}) GROUP BY prompt""")
def q_ordered_distinct(spark, sf):
    return ST.ordered_distinct(V.batches(spark, sf), "prompt", ["ts", "event_id"])


@query("distinct_prompts", f"SELECT DISTINCT prompt FROM ({V.SQL_BATCHES})")
def q_distinct_prompts(spark, sf):
    return ST.distinct_values(V.batches(spark, sf), "prompt")


@query("batch_width", f"""
SELECT doc_id // 8 AS batch_id, max(len(list_filter(regexp_split_to_array(text, '{V.WS_PATTERN}'), lambda t: t <> ''))) AS width
FROM documents GROUP BY doc_id // 8""")
def q_batch_width(spark, sf):
    d = read_table(spark, sf, "documents", ["doc_id", "text"])
    toks = F.filter(F.split("text", V.WS_PATTERN), lambda t: t != "")
    return ST.batch_width(d.select((F.col("doc_id") / 8).cast("long").alias("batch_id"), toks.alias("tokens")), "tokens", "batch_id")


@query("prefix_positions", f"""
SELECT doc_id, pos, CAST(sum(length(token)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
                         - length(token) AS BIGINT) AS char_offset
FROM ({V.SQL_WORDS})""")
def q_prefix_positions(spark, sf):
    from pyspark.sql import Window
    w = V.words(spark, sf)
    win = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return w.select("doc_id", "pos", (F.sum(F.length("token")).over(win) - F.length("token")).cast("long").alias("char_offset"))


@query("chunk_ordinal", """
SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS ordinal,
       CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // 100 AS BIGINT) AS chunk FROM orders""")
def q_chunk_ordinal(spark, sf):
    o = read_table(spark, sf, "orders", ["o_orderkey"])
    r = running(o, ["o_orderkey"], out="ordinal")
    return r.select("o_orderkey", "ordinal", (F.col("ordinal") / 100).cast("long").alias("chunk"))


@query("join_state", f"""
WITH b AS ({V.SQL_BATCHES}),
r AS (SELECT *, row_number() OVER (PARTITION BY prompt ORDER BY batch_id DESC, ts DESC, event_id DESC) AS rn,
             count(*) OVER (PARTITION BY prompt) AS cnt FROM b),
s AS (SELECT prompt, any_value(cnt) AS count, avg(reward) FILTER (WHERE rn <= {K}) AS m FROM r GROUP BY prompt)
SELECT b.event_id, b.prompt, s.count, round(s.m, 6) AS state_mean FROM b JOIN s ON b.prompt = s.prompt""")
def q_join_state(spark, sf):
    b = V.batches(spark, sf)
    st = ST.tracker_state(b, "prompt", "reward", "batch_id", ["ts", "event_id"], K)
    st = st.select("prompt", F.col("count").cast("long").alias("count"),
                   (F.aggregate("last", F.lit(0.0), lambda a, x: a + x) / F.size("last")).alias("state_mean"))
    j = ST.join_state(b.select("event_id", "prompt"), st, "prompt")
    return j.select("event_id", "prompt", "count", round6("state_mean").alias("state_mean"))
