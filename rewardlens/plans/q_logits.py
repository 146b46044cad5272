"""Numeric array queries: embeddings read as logits."""

from __future__ import annotations

from pyspark.sql import functions as F

from rewardlens.functions import numeric as N
from rewardlens.functions.common import round6
from rewardlens.plans import fixtures as V
from rewardlens.plans.catalog import query

SQL_LSE = "(list_max(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) + ln(list_sum(list_transform(embedding, lambda x: exp(CAST(x AS DOUBLE) - list_max(list_transform(embedding, lambda y: CAST(y AS DOUBLE))))))))"


@query("selective_log_softmax", f"""
SELECT vec_id AS sample_id, round(CAST(embedding[label + 1] AS DOUBLE) - {SQL_LSE}, 6) AS logp FROM embeddings""")
def q_selective_log_softmax(spark, sf):
    lg = V.logits(spark, sf)
    return lg.select("sample_id", round6(N.selective_log_softmax("logits", F.col("index"))).alias("logp"))


SQL_MIX = "list_transform(range(1, 65), lambda i: 0.5 * CAST(embedding[65 - i] AS DOUBLE) + 0.5 * CAST(embedding[i] AS DOUBLE))"


@query("logit_mixture", f"""
WITH m AS (SELECT vec_id, label, {SQL_MIX} AS v FROM embeddings),
s AS (SELECT vec_id, label, v, list_max(v) + ln(list_sum(list_transform(v, lambda x: exp(x - list_max(v))))) AS lse FROM m)
SELECT vec_id AS sample_id, round(v[label + 1] - lse, 6) AS logp_label, round(list_max(v) - lse, 6) AS logp_max FROM s""")
def q_logit_mixture(spark, sf):
    lg = V.logits(spark, sf).withColumn("ref", F.reverse("logits"))
    r = N.logit_mixture(lg, "logits", "ref", "lp", 0.5)
    return r.select("sample_id", round6(F.get("lp", F.col("index"))).alias("logp_label"), round6(F.array_max("lp")).alias("logp_max"))


@query("cap_exp", f"""
SELECT vec_id AS sample_id, exp(least(CAST(list_max(embedding) AS DOUBLE) * 100, {N.EXP_CAP_FLOAT})) >= exp({N.EXP_CAP_FLOAT}) AS capped,
       round(ln(exp(least(CAST(list_max(embedding) AS DOUBLE) * 100, {N.EXP_CAP_FLOAT}))), 6) AS log_value
FROM embeddings""")
def q_cap_exp(spark, sf):
    lg = V.logits(spark, sf)
    v = N.cap_exp(F.array_max("logits").cast("double") * F.lit(100))
    return lg.select("sample_id", (v >= F.exp(F.lit(N.EXP_CAP_FLOAT))).alias("capped"), round6(F.log(v)).alias("log_value"))


@query("argmax_class", """
SELECT vec_id AS sample_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS argmax, CAST(label AS BIGINT) AS label FROM embeddings""")
def q_argmax_class(spark, sf):
    lg = V.logits(spark, sf)
    return lg.select("sample_id", N.argmax("logits").alias("argmax"), F.col("index").alias("label"))
