"""Sub-word queries: ids by a public byte-pair vocabulary, back to text, and its use.

SQL cannot merge byte pairs, so ids are tested against the public tokenizer
itself; the text must come back whole, which SQL can say.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from rewardlens.operators.subword import SubwordVocabulary
from rewardlens.plans import fixtures as V
from rewardlens.plans.catalog import query
from rewardlens.plans.q_tokens import BATCH, CHATML_MAX, _out
from rewardlens.sources.tables import read_table

VOCABULARY = "byte_bpe_50k.tiktoken"
PAD_ID = 50256


def vocabulary(spark) -> SubwordVocabulary:
    import public_tokenizers

    return SubwordVocabulary.from_file(spark, public_tokenizers.path(VOCABULARY))


@query("encode_subword")
def q_encode_subword(spark, sf):
    ids = vocabulary(spark).encode(read_table(spark, sf, "documents", ["doc_id", "text"]), "doc_id", "text")
    return _out(ids, ["input_ids", "attention_mask"])


@query("decode_subword", "SELECT doc_id, coalesce(text, '') AS text FROM documents")
def q_decode_subword(spark, sf):
    v = vocabulary(spark)
    return v.decode(v.encode(read_table(spark, sf, "documents", ["doc_id", "text"]), "doc_id", "text"), "doc_id", "input_ids")


@query("subword_counts")
def q_subword_counts(spark, sf):
    found = vocabulary(spark).counts(read_table(spark, sf, "documents", ["text"]), "text")
    return found.select("token_id", F.hex("token").alias("token_hex"), "n", "texts")


@query("label_chatml_subword")
def q_label_chatml_subword(spark, sf):
    from rewardlens.operators.collate import chatml_collate

    m = V.messages(spark, sf).withColumn("batch_id", (F.col("conv_id") / BATCH).cast("long"))
    out = chatml_collate(m, vocabulary(spark), key="conv_id", pad_id=PAD_ID, max_length=CHATML_MAX)
    return _out(out, ["input_ids", "attention_mask", "labels"], keys=("conv_id",))
