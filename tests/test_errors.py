"""Failure contracts: checks that must stop a job (or fail before one runs)."""

import pytest
from pyspark.sql import functions as F

from rewardlens.operators import conversation as OC
from rewardlens.operators import rewards as R
from rewardlens.operators import tokens as T

MSG = "array<struct<role:string,content:string>>"


def test_invalid_dataset_keys(spark):
    df = spark.createDataFrame([("a", "b")], "prompt string, chosen string")
    with pytest.raises(KeyError):
        OC.dataset_kind(df)


def test_weights_must_match():
    with pytest.raises(ValueError):
        R.weights_check(["a", "b"], [1.0])
    assert R.weights_check(["a", "b"], None) == [1.0, 1.0]


def test_uneven_batches(spark):
    df = spark.createDataFrame([(b, i) for b, n in ((1, 8), (2, 6), (None, 3)) for i in range(n)], "batch_id int, x int")
    assert {(r.batch_id, r.rows, r.left_over) for r in R.uneven_batches(df, "batch_id", 4).collect()} == {(2, 6, 2), (None, 3, 3)}
    with pytest.raises(ValueError):
        R.uneven_batches(df, "batch_id", 1)


def test_invalid_padding_side(spark):
    df = spark.createDataFrame([(0, [1])], "batch_id int, ids array<int>")
    with pytest.raises(ValueError):
        T.pad_batch(df, {"ids": (0, "middle")})


def test_group_size_strict_fails(spark):
    df = spark.createDataFrame([(1, 0.1), (1, 0.2), (2, 0.3)], "group_id int, reward double")
    assert R.group_size_check(df, "group_id", 2).count() == 1
    with pytest.raises(Exception):
        R.group_size_check(df, "group_id", 2, strict=True).collect()


def test_prefix_check_strict_fails_for_sft(spark):
    df = spark.createDataFrame([([("user", "Hi")], [("assistant", "Yo")])], f"prompt {MSG}, completion {MSG}")
    flagged = OC.apply_chat_template(df, "simple_sft", strict=False).select(F.col("_error").isNotNull()).first()[0]
    assert flagged
    with pytest.raises(Exception):
        OC.apply_chat_template(df, "simple_sft", strict=True).collect()
    ok = OC.apply_chat_template(df, "chatml", strict=True).first()
    # the rendered prompt already ends with the generation suffix
    assert ok.completion == "Yo<|im_end|>\n"


def test_flush_left_needs_a_one(spark):
    df = spark.createDataFrame([(0, [0, 0], [1, 2])], "batch_id int, mask array<int>, t array<int>")
    with pytest.raises(Exception):
        T.flush_left(df, "mask", ["t"]).collect()


def test_reward_pairs_need_columns(spark):
    df = spark.createDataFrame([(0, [1])], "batch_id int, input_ids_chosen array<int>")
    with pytest.raises(ValueError):
        T.collate_reward_pairs(df, 0)


def test_preference_rules():
    rules = T.preference_padding_rules(["prompt_input_ids", "prompt_attention_mask", "chosen_labels", "chosen_input_ids", "x_logps"], 7)
    assert rules == {"prompt_input_ids": (7, "left"), "prompt_attention_mask": (0, "left"),
                     "chosen_labels": (-100, "right"), "chosen_input_ids": (7, "right")}
    with pytest.raises(ValueError):
        T.preference_padding_rules(["prompt_input_ids"], None)
    with pytest.raises(ValueError):
        T.preference_padding_rules(["other_labels_x_input_ids"], 0, encoder_decoder=True)
    assert T.preference_padding_rules(["prompt_input_ids", "prompt_attention_mask", "chosen_labels", "rejected_decoder_input_ids"], 7, encoder_decoder=True) == {
        "prompt_input_ids": (7, "right"), "prompt_attention_mask": (0, "right"), "chosen_labels": (-100, "right"), "rejected_decoder_input_ids": (-100, "right")}
    assert T.preference_padding_rules(["prompt_pixel_values", "x_logps"], None) == {"prompt_pixel_values": (0.0, "right")}


def test_strict_join_fails_on_unmatched(spark):
    p = spark.createDataFrame([(1, "a"), (2, "b")], "sample_id int, prompt string")
    c = spark.createDataFrame([(1, "x")], "sample_id int, completion string")
    assert R.join_prompt_completion(p, c, strict=False).count() == 1
    with pytest.raises(Exception):
        R.join_prompt_completion(p, c, strict=True).collect()
