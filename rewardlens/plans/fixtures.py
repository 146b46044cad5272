"""Input views derived from the driver's tables (see FIXTURES.md).

Each view exists twice: as a Spark builder ``(spark, sf_dir) -> DataFrame``
and as a DuckDB SQL expression over the same tables, used by the oracle.
The views read whole tables; nothing is sampled or capped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rewardlens.operators.conversation import assemble_messages
from rewardlens.sources.tables import dealt, read_table

# Fixed fixture parameters.
ROLLOUT_REWARDS = ("reward_discount", "reward_tax", "reward_quantity")
ROLLOUT_WEIGHTS = (2.0, 1.0, 0.5)
WS_PATTERN = "[ \\t\\n\\x0B\\f\\r]+"


# ---------------------------------------------------------------- rollouts
def rollouts(spark: SparkSession, sf: str) -> DataFrame:
    li = read_table(spark, sf, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("group_id"),
        "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice",
        F.col("l_discount").alias("reward_discount"),
        F.col("l_tax").alias("reward_tax"),
        (F.col("l_quantity") / F.lit(50)).alias("reward_quantity"),
    )


SQL_ROLLOUTS = """
SELECT l_orderkey AS group_id, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice,
       l_discount AS reward_discount, l_tax AS reward_tax, l_quantity / 50 AS reward_quantity
FROM lineitem"""

SQL_WEIGHTED = "reward_discount * 2.0 + reward_tax * 1.0 + reward_quantity * 0.5"


# ---------------------------------------------------------------- conversations
def messages(spark: SparkSession, sf: str) -> DataFrame:
    conv = read_table(spark, sf, "conversations")
    return assemble_messages(conv, "conv_id", "turn", "role", "text")


SQL_MESSAGES = """
SELECT conv_id, list({'role': role, 'content': text} ORDER BY turn) AS messages
FROM conversations GROUP BY conv_id"""


def prompt_completion(spark: SparkSession, sf: str) -> DataFrame:
    m = messages(spark, sf)
    return m.filter(F.element_at("messages", -1)["role"] == "assistant").select(
        "conv_id",
        F.slice("messages", 1, F.size("messages") - 1).alias("prompt"),
        F.slice("messages", -1, 1).alias("completion"),
    )


SQL_PROMPT_COMPLETION = f"""
SELECT conv_id, messages[1:len(messages) - 1] AS prompt, [messages[len(messages)]] AS completion
FROM ({SQL_MESSAGES}) WHERE messages[len(messages)].role = 'assistant'"""


def _roles(col="messages"):
    return F.transform(col, lambda m: m["role"])


def preference(spark: SparkSession, sf: str) -> DataFrame:
    m = messages(spark, sf)
    roles = _roles()
    n_asst = F.size(F.filter(roles, lambda r: r == "assistant"))
    first_a = F.array_position(roles, "assistant")
    last_a = F.size("messages") - F.array_position(F.reverse(roles), "assistant") + 1
    return m.filter(n_asst >= 2).select(
        "conv_id",
        F.slice("messages", 1, last_a - 1).alias("prompt"),
        F.array(F.element_at("messages", last_a.cast("int"))).alias("chosen"),
        F.array(F.element_at("messages", first_a.cast("int"))).alias("rejected"),
    )


SQL_PREFERENCE = f"""
SELECT conv_id,
       messages[1:(len(messages) - list_position(list_reverse(roles), 'assistant') + 1) - 1] AS prompt,
       [messages[len(messages) - list_position(list_reverse(roles), 'assistant') + 1]] AS chosen,
       [messages[list_position(roles, 'assistant')]] AS rejected
FROM (SELECT conv_id, messages, list_transform(messages, lambda m: m.role) AS roles FROM ({SQL_MESSAGES}))
WHERE len(list_filter(roles, lambda r: r = 'assistant')) >= 2"""


def implicit(spark: SparkSession, sf: str) -> DataFrame:
    p = preference(spark, sf)
    return p.select(
        "conv_id",
        F.concat("prompt", "chosen").alias("chosen"),
        F.concat("prompt", "rejected").alias("rejected"),
    )


SQL_IMPLICIT = f"""
SELECT conv_id, list_concat(prompt, chosen) AS chosen, list_concat(prompt, rejected) AS rejected
FROM ({SQL_PREFERENCE})"""


def joined_text(col):
    """Joined-text form of a conversation: contents separated by a newline."""
    return F.array_join(F.transform(col, lambda m: m["content"]), "\n")


def sql_joined_text(col: str) -> str:
    return f"array_to_string(list_transform({col}, lambda m: m.content), chr(10))"


def pref_text(spark: SparkSession, sf: str) -> DataFrame:
    m = messages(spark, sf)
    p = preference(spark, sf)
    q = m.select("conv_id", F.filter("messages", lambda x: x["role"] == "user").alias("u"))
    return p.join(q, "conv_id").select(
        F.col("conv_id").alias("idx"),
        F.get(F.col("u"), 0)["content"].alias("question"),
        F.get(F.col("chosen"), 0)["content"].alias("chosen"),
        F.get(F.col("rejected"), 0)["content"].alias("rejected"),
    )


SQL_PREF_TEXT = f"""
SELECT p.conv_id AS idx,
       list_filter(m.messages, lambda x: x.role = 'user')[1].content AS question,
       p.chosen[1].content AS chosen, p.rejected[1].content AS rejected
FROM ({SQL_PREFERENCE}) p JOIN ({SQL_MESSAGES}) m USING (conv_id)"""


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Length-based scores: deterministic stand-ins for a reward model."""
    t = pref_text(spark, sf)
    qlen = F.coalesce(F.length("question"), F.lit(0)).cast("double")
    gens = F.array(*[qlen / F.lit(100.0) + F.lit(0.5 * k) for k in range(5)])
    return t.select(
        "idx", "question", "chosen", "rejected",
        (F.length("chosen").cast("double") / F.lit(100.0)).alias("chosen_score"),
        (F.length("rejected").cast("double") / F.lit(100.0)).alias("rejected_score"),
        gens.alias("generated_scores"),
    )


SQL_SCORED = f"""
SELECT idx, question, chosen, rejected,
       CAST(length(chosen) AS DOUBLE) / CAST(100 AS DOUBLE) AS chosen_score,
       CAST(length(rejected) AS DOUBLE) / CAST(100 AS DOUBLE) AS rejected_score,
       [CAST(coalesce(length(question), 0) AS DOUBLE) / CAST(100 AS DOUBLE) + CAST(0.5 * k AS DOUBLE)
        FOR k IN range(5)] AS generated_scores
FROM ({SQL_PREF_TEXT})"""


# ---------------------------------------------------------------- logits / log-probs
def logits(spark: SparkSession, sf: str) -> DataFrame:
    e = read_table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("sample_id"), F.col("embedding").alias("logits"), F.col("label").alias("index"))


def logps(spark: SparkSession, sf: str) -> DataFrame:
    """Per-token log-probs: one row per (sample, position) of the 64-wide vectors."""
    from rewardlens.operators.rewards import group_advantage

    e = read_table(spark, sf, "embeddings")
    samples = e.select(
        F.col("vec_id").alias("sample_id"), "embedding", F.col("label").alias("group_id"),
        F.get("embedding", 0).cast("double").alias("reward"),
    )
    adv = group_advantage(samples, "group_id", "reward")
    ex = adv.select("sample_id", "group_id", "advantage", "embedding", F.posexplode("embedding").alias("p0", "_x"))
    i = F.col("p0") + 1
    n = F.size("embedding")
    return ex.select(
        "sample_id", F.col("p0").alias("pos"), "group_id",
        (-F.abs(F.col("_x"))).cast("double").alias("logp"),
        (-F.abs(F.element_at("embedding", (i % n + 1).cast("int")))).cast("double").alias("old_logp"),
        (-F.abs(F.element_at("embedding", (n + 1 - i).cast("int")))).cast("double").alias("ref_logp"),
        (i <= F.lit(6) * (F.col("group_id") + 1)).cast("int").alias("mask"),
        "advantage",
    )


SQL_LOGPS = """
SELECT s.vec_id AS sample_id, g.i - 1 AS pos, s.label AS group_id,
       CAST(-abs(s.embedding[g.i]) AS DOUBLE) AS logp,
       CAST(-abs(s.embedding[g.i % 64 + 1]) AS DOUBLE) AS old_logp,
       CAST(-abs(s.embedding[65 - g.i]) AS DOUBLE) AS ref_logp,
       CAST(g.i <= 6 * (s.label + 1) AS INTEGER) AS mask,
       (CAST(s.embedding[1] AS DOUBLE) - a.m) / (a.sd + 1e-4) AS advantage
FROM embeddings s
JOIN (SELECT label, avg(CAST(embedding[1] AS DOUBLE)) AS m, stddev_samp(CAST(embedding[1] AS DOUBLE)) AS sd
      FROM embeddings GROUP BY label) a ON a.label = s.label
CROSS JOIN (SELECT unnest(range(1, 65)) AS i) g"""


# ---------------------------------------------------------------- tokens
def words(spark: SparkSession, sf: str) -> DataFrame:
    """``(doc_id, pos, token)``: whitespace tokens of every document, 0-based position."""
    from rewardlens.operators.tokens import words as split_words_long

    return split_words_long(documents(spark, sf), "doc_id", "text")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """``(doc_id, text)`` for work on whole texts."""
    return dealt(read_table(spark, sf, "documents", ["doc_id", "text"]))


SQL_WORDS = f"""
SELECT doc_id, generate_subscripts(toks, 1) - 1 AS pos, unnest(toks) AS token
FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '{WS_PATTERN}'), lambda t: t <> '') AS toks FROM documents)"""

SQL_VOCAB = f"""
SELECT token, n, CAST(row_number() OVER (ORDER BY n DESC, token) - 1 AS BIGINT) AS token_id
FROM (SELECT token, count(*) AS n FROM ({SQL_WORDS}) GROUP BY token)"""


# ---------------------------------------------------------------- batches / logs / pairs / prompts
def batches(spark: SparkSession, sf: str) -> DataFrame:
    ev = read_table(spark, sf, "events", ["event_id", "ts", "user_id", "value"])
    return ev.select(
        F.dayofmonth("ts").alias("batch_id"), "ts", "event_id",
        F.col("user_id").alias("prompt"), F.col("value").alias("reward"),
    )


SQL_BATCHES = """
SELECT CAST(day(ts) AS BIGINT) AS batch_id, ts, event_id, user_id AS prompt, value AS reward FROM events"""


def metric_log(spark: SparkSession, sf: str) -> DataFrame:
    ev = read_table(spark, sf, "events", ["event_id", "event_type", "value"])
    return ev.select(
        F.when(F.col("event_type") == "error", "eval").otherwise("train").alias("mode"),
        F.col("event_type").alias("key"), F.col("event_id").alias("step"), "value",
    )


SQL_METRIC_LOG = """
SELECT CASE WHEN event_type = 'error' THEN 'eval' ELSE 'train' END AS mode,
       event_type AS key, event_id AS step, value FROM events"""


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    lb = read_table(spark, sf, "labels")
    return lb.select("doc_id", F.col("quality").cast("double").alias("score_0"), F.col("toxic").cast("double").alias("score_1"), F.lit(0).alias("label"))


SQL_PAIRS = """
SELECT doc_id, CAST(quality AS DOUBLE) AS score_0, CAST(toxic AS DOUBLE) AS score_1, 0 AS label FROM labels"""


def prompts(spark: SparkSession, sf: str) -> DataFrame:
    b = read_table(spark, sf, "benchmark")
    return b.select(F.col("item_id").alias("prompt_id"), F.col("text").alias("prompt"))
