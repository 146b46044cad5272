"""Conversation collators, over the whitespace vocabulary or a sub-word one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rewardlens.functions.chat import render
from rewardlens.operators import tokens as T
from rewardlens.operators.subword import SubwordVocabulary
from rewardlens.plans.ordinal import written


def encode_text(df: DataFrame, vocab: DataFrame | SubwordVocabulary, key: str, text: str, max_length: int | None = None) -> DataFrame:
    """``(key, input_ids, attention_mask)`` of a text column; rows without tokens get empty arrays."""
    if isinstance(vocab, SubwordVocabulary):
        return vocab.encode(df, key, text, max_length)
    return T.encode_texts(df, key, text, vocab, max_length)


def chatml_collate(df: DataFrame, vocab: DataFrame | SubwordVocabulary, key: str = "conv_id", messages: str = "messages", pad_id: int = 0,
                   max_length: int = 1024, template: str = "chatml", batch: str = "batch_id", ignore_index: int = T.IGNORE_INDEX) -> DataFrame:
    """Ids of the whole conversation (cut at ``max_length``), labels -100 over the prompt.

    The prompt defaults to all messages but the last, rendered with the
    generation suffix and cut to the conversation's length. Every sequence is
    left-padded to its batch's width.
    """
    texts = df.select(key, batch,
                      render(messages, template).alias("_full"),
                      render(F.slice(messages, 1, F.size(messages) - 1), template, True).alias("_prompt"))
    full = encode_text(texts, vocab, key, "_full", max_length)
    prm = encode_text(texts, vocab, key, "_prompt", None)
    j = texts.select(key, batch).join(full, key).join(prm.withColumnRenamed("input_ids", "_p_ids").drop("attention_mask"), key)
    n = F.size("input_ids")
    j = j.withColumn("prompts", F.slice("_p_ids", 1, n)).drop("_p_ids")
    npf = F.size("prompts")
    j = j.withColumn("labels", F.concat(F.array_repeat(F.lit(ignore_index), npf), F.slice("input_ids", npf + 1, n)))
    j = j.withColumn("prompt_attention_mask", F.array_repeat(F.lit(1), F.size("prompts")))
    j = written(j, "chatml-ids")  # padding reads the rows twice
    return T.pad_batch(j, {
        "input_ids": (pad_id, "left"), "attention_mask": (0, "left"), "labels": (ignore_index, "left"),
        "prompts": (pad_id, "left"), "prompt_attention_mask": (0, "left"),
    }, batch)
