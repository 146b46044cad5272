"""Queries of the training-data operators, and DuckDB SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from rewardlens.llm.common import read

SHARD_LIMIT = 1 << 20

#: The rules of the URL query, as (host, path, verdict).
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rewardlens.llm.substring import remove_repeats

    found = remove_repeats(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256", F.size("spans").cast("long").alias("n_spans"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rewardlens.llm.sharding import extendible_shards

    docs = read(spark, sf_dir, "documents")
    return extendible_shards(docs, "doc_id", F.octet_length("text"), SHARD_LIMIT)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rewardlens.llm.simhash import simhash_groups

    groups = simhash_groups(read(spark, sf_dir, "documents"))
    return groups.select("doc_id", "fingerprint", "component_id", "group_size")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rewardlens.llm.exact import exact_dedup

    return exact_dedup(read(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rewardlens.llm.langid import held_out, identify

    docs = read(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"), 4)
    pred = identify(docs, F.when(~out, F.col("lang")))
    return pred.select("doc_id", out.alias("held_out"), "lang_pred", "score", "bits")


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rewardlens.llm.pii import find_personal_data

    return find_personal_data(read(spark, sf_dir, "documents"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rewardlens.llm.langid import held_out
    from rewardlens.llm.lm import score_texts

    docs = read(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"), 7)
    s = score_texts(docs, ~out)
    return s.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rewardlens.llm.decontam import contaminated

    found = contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "score", "share", "item_words", "first_word", "last_word")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from rewardlens.llm.packing import pack

    return pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rewardlens.llm.repair import damage, digests, repair

    rows = read(spark, sf_dir, "conversations")
    found = repair(damage(rows))
    sums = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    ids = rows.select("conv_id").distinct()
    report = found.report.select(F.col("conv_id").alias("c"), *sums, "audit")
    hashes = digests(found.turns).withColumnRenamed("conv_id", "d")
    out = (ids.join(report, F.col("conv_id").eqNullSafe(F.col("c")), "left").join(hashes, F.col("conv_id").eqNullSafe(F.col("d")), "left"))
    return out.select("conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in sums], F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rewardlens.llm.runs import find_runs, plant_runs

    found = find_runs(plant_runs(read(spark, sf_dir, "documents")))
    # greatest length, then smallest start, then smallest period
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    text = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    found = found.withColumn("best", best)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"), F.col("best.n").alias("length"),
        (-F.col("best.p")).alias("period"), F.floor(F.col("best.n") * 1000 / -F.col("best.p")).cast("long").alias("exponent_milli"),
        F.sha2(text.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"), "n_words")


def op13_window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from rewardlens.llm.windows import pack_in_order

    return pack_in_order(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rewardlens.llm.urls import judge_urls

    return judge_urls(read(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_sharding, op3_simhash, op4_exact_dedup, op5_language_id, op6_decontamination, op7_packing, op8_url_filter,
                                    op9_personal_data, op10_lm_score, op11_conversation_repair, op12_periodic_runs, op13_window_packing)}
QUERIES["pipeline"] = corpus_pipeline.run

ORACLE = {
    "op2_sharding": f"""
WITH w AS (
  SELECT doc_id, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS hash,
         coalesce(strlen(text), 0)::BIGINT AS bytes
  FROM documents),
trie AS (
  SELECT d, (hash >> (60 - d)::INT) AS prefix, sum(bytes) AS total, count(*) AS n, max(bytes) AS largest
  FROM w, range(0, 61) r(d) GROUP BY 1, 2),
fit AS (SELECT * FROM trie WHERE total <= {SHARD_LIMIT} OR n = 1 OR d = 60),
leaf AS (
  SELECT w.doc_id, w.hash, w.bytes, min(f.d) AS depth
  FROM w JOIN fit f ON f.prefix = (w.hash >> (60 - f.d)::INT) GROUP BY 1, 2, 3),
placed AS (
  SELECT l.*, f.prefix, f.total, f.n, f.largest, row_number() OVER (PARTITION BY l.hash ORDER BY l.bytes) - 1 AS rank
  FROM leaf l JOIN fit f ON f.d = l.depth AND f.prefix = (l.hash >> (60 - l.depth)::INT)),
parts AS (
  SELECT *, CASE WHEN total <= {SHARD_LIMIT} OR n = 1 THEN 0
                 ELSE rank // greatest(1, {SHARD_LIMIT} // greatest(largest, 1)) END AS part
  FROM placed)
SELECT doc_id, hash, bytes, CAST(depth AS BIGINT) AS depth, CAST(prefix AS BIGINT) AS prefix, CAST(part AS BIGINT) AS part,
       depth || ':' || prefix || CASE WHEN part > 0 THEN '+' || part ELSE '' END AS shard,
       bytes > {SHARD_LIMIT} AS oversize
FROM parts""",
    "op4_exact_dedup": r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
r AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r""",
}
