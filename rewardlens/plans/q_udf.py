"""Reward-function and row-function slots (pandas UDFs, mapInPandas)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from rewardlens.functions.common import round6
from rewardlens.functions.udtf import register_table_functions
from rewardlens.operators import reward_model as RM
from rewardlens.operators import udf as U
from rewardlens.plans import fixtures as V
from rewardlens.plans.catalog import query
from rewardlens.session import ship_package


@query("udf_reward", f"""
SELECT idx, round(CAST(length(chosen) AS DOUBLE) / 100.0, 6) AS reward_length,
       round(CAST(length(chosen) AS DOUBLE) / 100.0 * 2.0 + idx % 2 + CAST(length(question) AS DOUBLE) / 1000.0 * 0.5, 6) AS reward
FROM ({V.SQL_PREF_TEXT})""")
def q_udf_reward(spark, sf):
    t = V.pref_text(spark, sf).select("idx", F.col("question").alias("prompt"), F.col("chosen").alias("completion"))
    funcs = {
        "length": lambda prompt, completion, **_: U.length_reward(completion),
        "by_name": lambda prompt, completion, idx, **_: (idx % 2).cast("double"),
        "prompt": F.length("prompt").cast("double") / F.lit(1000.0),
    }
    r = U.apply_rewards(t, funcs, [2.0, 1.0, 0.5])
    return r.select("idx", round6("reward_length").alias("reward_length"), round6("reward").alias("reward"))


@query("udf_model_score", """
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS toks FROM documents)
SELECT doc_id, round(CASE WHEN len(toks) > 0 THEN CAST(len(list_distinct(toks)) AS DOUBLE) / len(toks) END, 6) AS score FROM t""")
def q_udf_model_score(spark, sf):
    from rewardlens.sources.tables import read_table
    ship_package(spark)
    d = read_table(spark, sf, "documents", ["doc_id", "text"])
    return d.select("doc_id", round6(U.model_scorer()(F.col("text"))).alias("score"))


@query("udf_format", f"""
SELECT idx, '### Question: ' || question || ' ### Answer: ' || chosen AS text FROM ({V.SQL_PREF_TEXT})""")
def q_udf_format(spark, sf):
    t = V.pref_text(spark, sf)
    fmt = U.formatting_udf("### Question: {question} ### Answer: {chosen}", ["question", "chosen"])
    return t.select("idx", fmt(F.col("question"), F.col("chosen")).alias("text"))


@query("udf_map_batched", f"""
SELECT idx, question AS prompt, chosen AS completion, true AS label FROM ({V.SQL_PREF_TEXT})
UNION ALL SELECT idx, question, rejected, false FROM ({V.SQL_PREF_TEXT})""")
def q_udf_map_batched(spark, sf):
    t = V.pref_text(spark, sf).withColumnRenamed("question", "prompt")
    return U.map_batched(t, U.unpair_batch, "idx long, prompt string, completion string, label boolean")


def _pref_view(spark, sf) -> str:
    """A temporary view of the preference texts, under a name of its own."""
    name = f"pref_{uuid.uuid4().hex}"
    V.pref_text(spark, sf).withColumnRenamed("question", "prompt").createTempView(name)
    register_table_functions(spark)
    return name


@query("udtf_unpair", f"""
SELECT idx, question AS prompt, chosen AS completion, true AS label FROM ({V.SQL_PREF_TEXT})
UNION ALL SELECT idx, question, rejected, false FROM ({V.SQL_PREF_TEXT})""")
def q_udtf_unpair(spark, sf):
    return spark.sql(f"SELECT * FROM unpair_rows(TABLE({_pref_view(spark, sf)}))")


@query("udtf_format", f"""
SELECT idx, '### Question: ' || coalesce(question, '') || ' ### Answer: ' || chosen AS text FROM ({V.SQL_PREF_TEXT})""")
def q_udtf_format(spark, sf):
    return spark.sql(f"""
        SELECT t.idx, f.text FROM {_pref_view(spark, sf)} t,
        LATERAL format_row(template => '### Question: {{question}} ### Answer: {{chosen}}', question => t.prompt, chosen => t.chosen) f""")


@query("reward_model_score")
def q_reward_model_score(spark, sf):
    """A reward model of the preference pairs, on the pairs themselves (SQL cannot fit it; tested against a plain fit)."""
    pairs = V.pref_text(spark, sf)
    score = RM.reward_scorer(spark, RM.fit_reward_model(pairs))
    return pairs.select("idx", round6(score("chosen")).alias("chosen_score"), round6(score("rejected")).alias("rejected_score"))
