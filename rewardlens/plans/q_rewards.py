"""Reward-analytics queries (flagship: ``group_advantage``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rewardlens.functions.common import round6
from rewardlens.operators import rewards as R
from rewardlens.plans import fixtures as V
from rewardlens.plans.catalog import ORACLE, query
from rewardlens.sources.bucketed import buckets_for, co_joined, write_bucketed
from rewardlens.sources.tables import read_table

W = V.ROLLOUT_WEIGHTS
RCOLS = list(V.ROLLOUT_REWARDS)
KEYS = ["group_id", "l_linenumber", "l_partkey", "l_suppkey"]
# (l_orderkey, l_linenumber) repeats in the fixture; these make a sample unique
FULL_KEYS = KEYS + ["l_shipdate", "l_extendedprice"]


def scored_rollouts(spark, sf):
    return R.weighted_reward(V.rollouts(spark, sf), RCOLS, W)


@query("weighted_reward", f"""
SELECT group_id, l_linenumber, l_partkey, l_suppkey, round({V.SQL_WEIGHTED}, 6) AS reward
FROM ({V.SQL_ROLLOUTS})""")
def q_weighted_reward(spark, sf):
    return scored_rollouts(spark, sf).select(*KEYS, round6("reward").alias("reward"))


@query("group_reward_stats", f"""
SELECT group_id, count(*) AS group_size, round(avg(r), 6) AS mean_reward, round(stddev_samp(r), 6) AS std_reward
FROM (SELECT group_id, {V.SQL_WEIGHTED} AS r FROM ({V.SQL_ROLLOUTS})) GROUP BY group_id""")
def q_group_reward_stats(spark, sf):
    s = R.group_reward_stats(scored_rollouts(spark, sf), "group_id", "reward")
    return s.select("group_id", "group_size", round6("mean_reward").alias("mean_reward"), round6("std_reward").alias("std_reward"))


SQL_ADV = f"""
WITH r AS (SELECT group_id, l_linenumber, l_partkey, l_suppkey, {V.SQL_WEIGHTED} AS reward FROM ({V.SQL_ROLLOUTS})),
s AS (SELECT group_id, avg(reward) AS m, stddev_samp(reward) AS sd FROM r GROUP BY group_id)
SELECT r.group_id, l_linenumber, l_partkey, l_suppkey, round(reward, 6) AS reward,
       round((reward - m) / (sd + 1e-4), 6) AS advantage
FROM r JOIN s ON r.group_id = s.group_id"""


@query("group_advantage", SQL_ADV)
def q_group_advantage(spark, sf):
    a = R.group_advantage(scored_rollouts(spark, sf), "group_id", "reward")
    return a.select(*KEYS, round6("reward").alias("reward"), round6("advantage").alias("advantage"))


@query("join_group_stats", f"""
WITH r AS (SELECT group_id, l_linenumber, l_partkey, l_suppkey, {V.SQL_WEIGHTED} AS reward FROM ({V.SQL_ROLLOUTS})),
s AS (SELECT group_id, count(*) AS group_size, avg(reward) AS m FROM r GROUP BY group_id)
SELECT r.group_id, l_linenumber, l_partkey, l_suppkey, group_size, round(m, 6) AS mean_reward
FROM r JOIN s ON r.group_id = s.group_id""")
def q_join_group_stats(spark, sf):
    r = scored_rollouts(spark, sf)
    stats = R.group_reward_stats(r, "group_id", "reward")
    j = R.join_group_stats(r, stats, "group_id")
    return j.select(*KEYS, "group_size", round6("mean_reward").alias("mean_reward"))


@query("group_size_check", f"""
SELECT group_id, count(*) AS group_size FROM ({V.SQL_ROLLOUTS}) GROUP BY group_id HAVING count(*) <> 4""")
def q_group_size_check(spark, sf):
    return R.group_size_check(V.rollouts(spark, sf), "group_id", 4)


@query("reward_func_means", f"""
SELECT 'rewards/' || name AS key, round(value, 6) AS value FROM (
  SELECT 'reward_discount' AS name, avg(reward_discount) AS value FROM ({V.SQL_ROLLOUTS})
  UNION ALL SELECT 'reward_tax', avg(reward_tax) FROM ({V.SQL_ROLLOUTS})
  UNION ALL SELECT 'reward_quantity', avg(reward_quantity) FROM ({V.SQL_ROLLOUTS}))""")
def q_reward_func_means(spark, sf):
    m = R.reward_func_means(V.rollouts(spark, sf), RCOLS)
    return m.select("key", round6("value").alias("value"))


@query("rollout_metrics", f"""
WITH r AS (SELECT group_id, l_quantity, {V.SQL_WEIGHTED} AS reward
           FROM (SELECT l_orderkey AS group_id, l_quantity, l_discount AS reward_discount, l_tax AS reward_tax,
                        l_quantity / 50 AS reward_quantity FROM lineitem)),
s AS (SELECT group_id, stddev_samp(reward) AS sd FROM r GROUP BY group_id)
SELECT round(avg(CAST(l_quantity AS DOUBLE)), 6) AS completion_length, round(avg(reward), 6) AS reward,
       round(avg(sd), 6) AS reward_std
FROM r JOIN s ON r.group_id = s.group_id""")
def q_rollout_metrics(spark, sf):
    li = V.rollouts(spark, sf).withColumn("completion_length", F.col("reward_quantity") * F.lit(50))
    r = R.weighted_reward(li, RCOLS, W)
    a = R.group_advantage(r, "group_id", "reward", keep_stats=True)
    m = R.rollout_metrics(a, "reward", "std_reward", "completion_length")
    return m.select(*[round6(c).alias(c) for c in m.columns])


@query("weights_check", f"""
SELECT group_id, l_linenumber, l_partkey, l_suppkey,
       round(reward_discount + reward_tax + reward_quantity, 6) AS reward
FROM ({V.SQL_ROLLOUTS})""")
def q_weights_check(spark, sf):
    # no weights given: every reward function weighs 1.0
    r = R.weighted_reward(V.rollouts(spark, sf), RCOLS, None)
    return r.select(*KEYS, round6("reward").alias("reward"))


@query("policy_loss", f"""
WITH t AS ({V.SQL_LOGPS}),
u AS (SELECT mask, exp(logp - old_logp) AS c1, advantage, exp(ref_logp - logp) - (ref_logp - logp) - 1 AS kl FROM t),
v AS (SELECT mask, c1 * advantage AS l1, least(greatest(c1, 0.8), 1.2) * advantage AS l2, kl FROM u)
SELECT round(sum((-least(l1, l2) + 0.04 * kl) * mask) / sum(mask), 6) AS loss FROM v""")
def q_policy_loss(spark, sf):
    return R.policy_loss(V.logps(spark, sf)).select(round6("loss").alias("loss"))


@query("kl_estimate", f"""
WITH t AS ({V.SQL_LOGPS})
SELECT round(avg(kl), 6) AS kl FROM (
  SELECT sample_id, sum((exp(ref_logp - logp) - (ref_logp - logp) - 1) * mask) / sum(mask) AS kl
  FROM t GROUP BY sample_id)""")
def q_kl_estimate(spark, sf):
    return R.kl_estimate(V.logps(spark, sf)).select(round6("kl").alias("kl"))


@query("clip_ratio", f"""
WITH t AS ({V.SQL_LOGPS}),
u AS (SELECT mask, exp(logp - old_logp) AS c1, advantage FROM t)
SELECT round(sum(CAST(c1 * advantage < least(greatest(c1, 0.8), 1.2) * advantage AS DOUBLE) * mask) / sum(mask), 6) AS clip_ratio
FROM u""")
def q_clip_ratio(spark, sf):
    return R.clip_ratio(V.logps(spark, sf)).select(round6("clip_ratio").alias("clip_ratio"))


@query("join_logps", f"""
WITH t AS ({V.SQL_LOGPS})
SELECT sample_id, pos, round(logp, 6) AS logp, round(old_logp, 6) AS old_logp, round(ref_logp, 6) AS ref_logp FROM t""")
def q_join_logps(spark, sf):
    t = V.logps(spark, sf)
    pol = t.select("sample_id", "pos", "logp")
    old = t.select("sample_id", "pos", "old_logp")
    ref = t.select("sample_id", "pos", "ref_logp")
    j = R.join_logps(pol, old, ref)
    return j.select("sample_id", "pos", *[round6(c).alias(c) for c in ("logp", "old_logp", "ref_logp")])


SQL_METRIC_AVERAGE = f"""
SELECT mode, CASE WHEN mode = 'eval' THEN 'eval_' || key ELSE key END AS key, round(avg(value), 6) AS value
FROM ({V.SQL_METRIC_LOG}) GROUP BY mode, key"""


@query("metric_average", SQL_METRIC_AVERAGE)
def q_metric_average(spark, sf):
    m = R.metric_average(V.metric_log(spark, sf))
    return m.select("mode", "key", round6("value").alias("value"))


@query("filter_logging_steps", f"""
SELECT mode, key, step, value FROM ({V.SQL_METRIC_LOG}) WHERE step % 10 = 0""")
def q_filter_logging_steps(spark, sf):
    return R.filter_logging_steps(V.metric_log(spark, sf), 10, "step")


@query("filter_milestones", f"""
SELECT mode, key, step, value FROM ({V.SQL_METRIC_LOG})
WHERE step IN (SELECT DISTINCT CAST(floor(n * f) AS BIGINT) FROM (SELECT max(event_id) AS n FROM events),
               (SELECT unnest([0.25, 0.4, 0.10, 0.5, 0.75, 1.0]::DOUBLE[]) AS f) UNION SELECT 1)""")
def q_filter_milestones(spark, sf):
    log = V.metric_log(spark, sf)
    # total steps = the last step of the log (a one-row aggregate)
    total = log.agg(F.max("step")).first()[0]
    return R.filter_milestones(log, int(total), "step")


@query("join_prompt_completion", f"""
SELECT p.conv_id AS sample_id, len(p.prompt) AS n_prompt_turns, p.completion[1].content AS completion
FROM ({V.SQL_PROMPT_COMPLETION}) p""")
def q_join_prompt_completion(spark, sf):
    pc = V.prompt_completion(spark, sf).withColumnRenamed("conv_id", "sample_id")
    prompts = pc.select("sample_id", F.size("prompt").alias("n_prompt_turns"))
    comps = pc.select("sample_id", F.get("completion", 0)["content"].alias("completion"))
    return R.join_prompt_completion(prompts, comps, "sample_id", strict=True)


@query("join_rewards", f"""
SELECT group_id, l_linenumber, l_partkey, l_suppkey, round(reward_discount, 6) AS reward_discount,
       round(reward_tax, 6) AS reward_tax, round(reward_quantity, 6) AS reward_quantity
FROM ({V.SQL_ROLLOUTS})""")
def q_join_rewards(spark, sf):
    r = V.rollouts(spark, sf)
    # long form (sample, func, reward) -> one column per reward function
    long = r.select(*FULL_KEYS, F.explode(F.array(*[
        F.struct(F.lit(c).alias("func"), F.col(c).alias("reward")) for c in RCOLS
    ])).alias("x")).select(*FULL_KEYS, "x.func", "x.reward")
    wide = R.join_rewards_long(long, FULL_KEYS, RCOLS)
    return wide.select(*KEYS, *[round6(c).alias(c) for c in RCOLS])


@query("uneven_batches", f"""
SELECT batch_id, count(*) AS rows, count(*) % 4 AS left_over FROM ({V.SQL_BATCHES}) GROUP BY batch_id HAVING count(*) % 4 > 0""")
def q_uneven_batches(spark, sf):
    return R.uneven_batches(V.batches(spark, sf), "batch_id", 4)


# ---------------------------------------------------------------- joins of tables that are in place

@query("join_logps_bucketed", ORACLE["join_logps"])
def q_join_logps_bucketed(spark, sf):
    t = V.logps(spark, sf)
    keys = ["sample_id", "pos"]
    n = buckets_for(read_table(spark, sf, "embeddings", ["embedding"]).agg(F.sum(F.size("embedding"))).first()[0] or 0)
    pol, old, ref = (write_bucketed(t.select(*keys, c), keys, f"logps_{c}", n) for c in ("logp", "old_logp", "ref_logp"))
    j = co_joined(pol, old, ref, on=keys)
    return j.select(*keys, *[round6(c).alias(c) for c in ("logp", "old_logp", "ref_logp")])


@query("join_rewards_bucketed", ORACLE["join_rewards"])
def q_join_rewards_bucketed(spark, sf):
    r = V.rollouts(spark, sf)
    long = write_bucketed(r.select(*FULL_KEYS, F.explode(F.array(*[
        F.struct(F.lit(c).alias("func"), F.col(c).alias("reward")) for c in RCOLS
    ])).alias("x")).select(*FULL_KEYS, "x.func", "x.reward"), FULL_KEYS, "rewards", buckets_for(len(RCOLS) * r.count()))
    wide = R.join_rewards_long(long, FULL_KEYS, RCOLS)
    return wide.select(*KEYS, *[round6(c).alias(c) for c in RCOLS])


@query("join_prompt_completion_bucketed", ORACLE["join_prompt_completion"])
def q_join_prompt_completion_bucketed(spark, sf):
    pc = V.prompt_completion(spark, sf).withColumnRenamed("conv_id", "sample_id")
    n = buckets_for(read_table(spark, sf, "conversations").count())  # a conversation has a turn at least
    prompts = write_bucketed(pc.select("sample_id", F.size("prompt").alias("n_prompt_turns")), ["sample_id"], "prompts", n)
    comps = write_bucketed(pc.select("sample_id", F.get("completion", 0)["content"].alias("completion")), ["sample_id"], "completions", n)
    return R.join_prompt_completion(prompts, comps.hint("merge"), "sample_id", strict=True)
