"""Golden rows from the reference's docstrings and the semantics list."""

import pytest
from pyspark.sql import functions as F

from rewardlens.functions import arrays as A
from rewardlens.functions import matching as M
from rewardlens.functions import chat as C
from rewardlens.functions import numeric as N
from rewardlens.operators import conversation as OC
from rewardlens.operators import sample as SM
from rewardlens.operators import tokens as T

MSG = "array<struct<role:string,content:string>>"


def test_is_conversational(spark):
    conv = spark.createDataFrame([([("user", "What color is the sky?")],)], f"prompt {MSG}")
    plain = spark.createDataFrame([("The sky is",)], "prompt string")
    assert OC.is_conversational(conv) and not OC.is_conversational(plain)


def test_unpair_two_rows_to_four(spark):
    df = spark.createDataFrame([("The sky is", " blue.", " green."), ("The sun is", " in the sky.", " in the sea.")],
                               "prompt string, chosen string, rejected string")
    rows = sorted(OC.unpair_preference(df).collect(), key=lambda r: (r.prompt, not r.label))
    assert [(r.prompt, r.completion, r.label) for r in rows] == [
        ("The sky is", " blue.", True), ("The sky is", " green.", False),
        ("The sun is", " in the sky.", True), ("The sun is", " in the sea.", False)]


def test_extract_prompt_conversations(spark):
    q = ("user", "What color is the sky?")
    df = spark.createDataFrame([([q, ("assistant", "It is blue.")], [q, ("assistant", "It is green.")])], f"chosen {MSG}, rejected {MSG}")
    r = OC.extract_prompt(df).first()
    assert [tuple(m) for m in r.prompt] == [q]
    assert [tuple(m) for m in r.chosen] == [("assistant", "It is blue.")]
    assert [tuple(m) for m in r.rejected] == [("assistant", "It is green.")]


def test_extract_prompt_string_rules(spark):
    # (chosen, rejected) -> (prompt, rest of chosen, rest of rejected), by hand
    want = {
        ("the sky is blue", "the sky is green"): ("the sky is", " blue", " green"),
        ("abc d", "xyz "): ("", "abc d", "xyz "),
        ("abc ", "xbc"): ("abc", " ", "c"),  # the character before position 0 is the last one
        ("same", "same"): ("sam", "e", "e"),
        ("ab", "abc"): ("a", "b", "bc"),
        ("héllo wörld", "héllo welt"): ("héllo w", "örld", "elt"),
        ("a b", "a c"): ("a", " b", " c"),
    }
    df = spark.createDataFrame(list(want), "chosen string, rejected string")
    got = sorted(tuple(r) for r in OC.extract_prompt(df).select("prompt", "chosen", "rejected").collect())
    assert got == sorted(want.values())


def test_extract_prompt_guards_every_column(spark):
    df = spark.createDataFrame([("", "x")], "chosen string, rejected string")
    for c in ("prompt", "chosen", "rejected"):
        with pytest.raises(Exception, match="empty chosen or rejected"):
            OC.extract_prompt(df).select(c).collect()


def test_pair_ids(spark):
    df = spark.createDataFrame([("p", "a", "b"), ("q", "c", "d")], "prompt string, chosen string, rejected string")
    rows = OC.unpair_preference(df, "pair").collect()
    assert {(r.prompt, r.label) for r in rows} == {("p", True), ("p", False), ("q", True), ("q", False)}
    assert len({(r.prompt, r.pair) for r in rows}) == 2 == len({r.pair for r in rows})


def test_templates(spark):
    df = spark.createDataFrame([([("user", "Hi"), ("assistant", "Yo")],)], f"messages {MSG}")
    r = df.select(C.render("messages", "chatml", True).alias("a"), C.render("messages", "simple_chat", True).alias("b"),
                  C.render("messages", "simple_sft", eos_token="</s>").alias("c")).first()
    assert r.a == "<|im_start|>user\nHi<|im_end|>\n<|im_start|>assistant\nYo<|im_end|>\n<|im_start|>assistant\n"
    assert r.b == "User: Hi\n\nAssistant: Yo\n\nAssistant:"
    assert r.c == " Hi Yo</s>"
    cap = spark.createDataFrame([("user two",)], "s string").select(C.capitalize("s")).first()[0]
    assert cap == "User two"


def test_pad_left_right(spark):
    df = spark.createDataFrame([(0, [1, 2, 3]), (0, [4, 5])], "batch_id int, ids array<int>")
    right = {tuple(r.ids) for r in T.pad_batch(df, {"ids": (0, "right")}).collect()}
    left = {tuple(r.ids) for r in T.pad_batch(df, {"ids": (0, "left")}).collect()}
    assert right == {(1, 2, 3), (4, 5, 0)} and left == {(1, 2, 3), (0, 4, 5)}


def test_flush_left_rotates(spark):
    # the code gives [5, 6, 9], not the docstring's [5, 6, 0]
    df = spark.createDataFrame([(0, 0, [0, 0, 1, 1, 1], [9, 9, 2, 3, 4]), (0, 1, [0, 1, 1, 0, 0], [9, 5, 6, 9, 9])],
                               "batch_id int, r int, mask array<int>, t array<int>")
    out = {r.r: (list(r.mask), list(r.t)) for r in T.flush_left(df, "mask", ["t"]).collect()}
    assert out[0] == ([1, 1, 1], [2, 3, 4]) and out[1] == ([1, 1, 0], [5, 6, 9])


def test_first_true_and_truncate(spark):
    df = spark.createDataFrame([([3, 7, 2, 7, 5],), ([1, 1],)], "a array<int>")
    r = df.select(A.first_true_index("a", 7).alias("i"), A.truncate_response("a", 7, 0).alias("t"),
                  A.eos_mask("a", 7).alias("m"), A.completion_length("a", 7).alias("n"), A.truncate_left("a", 3).alias("l")).collect()
    assert (r[0].i, list(r[0].t), list(r[0].m), r[0].n, list(r[0].l)) == (1, [3, 7, 0, 0, 0], [1, 1, 0, 0, 0], 2, [2, 7, 5])
    assert (r[1].i, list(r[1].t), list(r[1].m), r[1].n, list(r[1].l)) == (2, [1, 1], [1, 1], 2, [1, 1])


def test_label_completion(spark):
    df = spark.createDataFrame([([5, 1, 2, 8, 9, 1, 2, 7],), ([5, 6],)], "l array<int>")
    single = [list(r[0]) for r in df.select(M.label_completion_single("l", [1, 2])).collect()]
    assert single == [[-100] * 7 + [7], [-100, -100]]
    # instruction [5], response [1, 2]: mask through first response end, keep the answer
    multi = df.withColumn("l", M.label_completion_multi("l", [1, 2], [5])).collect()
    assert list(multi[0].l) == [-100, -100, -100, 8, 9, 1, 2, 7]
    assert list(multi[1].l) == [-100, -100]


def test_numeric(spark):
    assert N.exp_cap("float") == N.EXP_CAP_FLOAT == 88.7228
    df = spark.createDataFrame([([1.0, 2.0, 3.0], 2)], "x array<double>, i int")
    r = df.select(N.selective_log_softmax("x", F.col("i")).alias("lp"), N.argmax("x").alias("am")).first()
    import math
    assert abs(r.lp - (3.0 - math.log(math.exp(1) + math.exp(2) + math.exp(3)))) < 1e-12 and r.am == 2


def test_logits_with_minus_infinity(spark):
    import math
    ninf = float("-inf")
    df = spark.createDataFrame([([ninf, 1.0, 2.0], 1), ([1e8, 1e8 + 1, ninf], 0), ([ninf, ninf, 5.0], 2)], "x array<double>, i int")
    got = [r[0] for r in df.select(N.selective_log_softmax("x", F.col("i"))).collect()]
    assert abs(got[0] - (1 - math.log(math.e + math.e**2))) < 1e-12 and abs(got[1] + math.log(1 + math.e)) < 1e-6 and got[2] == 0


def test_seeds_give_unrelated_orders(spark):
    keys = list(range(1, 1501)) + [2147483648, 9_000_000_000, -5, 2**62]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    order = {}
    for seed in (42, 43):
        rows = SM.shuffle_rows(df, "k", seed).collect()
        assert sorted(r.ordinal for r in rows) == list(range(len(keys)))
        order[seed] = [r.k for r in sorted(rows, key=lambda r: r.ordinal)]
    a, b = order[42], order[43]
    assert all(a != b[i:] + b[:i] for i in range(len(b)))
    chunks = [{frozenset(o[i:i + 3]) for i in range(0, 1500, 3)} for o in (a, b)]
    assert len(chunks[0] & chunks[1]) < 10
    scores = [r[0] for r in df.select(SM.random_score("k", 42)).collect()]
    assert all(0 <= s < 1 for s in scores) and 0.45 < sum(scores) / len(scores) < 0.55


def test_format_reward_two_decimals(spark):
    df = spark.createDataFrame([(0.12345,), (0.68789,), (0.125,), (12345.678,)], "x double")
    got = [r[0] for r in df.select(C.format_reward("x")).collect()]
    assert got == [f"{v:.2f}" for v in (0.12345, 0.68789, 0.125, 12345.678)]


def test_repeat_sampler_layout(spark):
    df = spark.createDataFrame([(i,) for i in range(7)], "k long")
    rows = sorted(SM.repeat_sampler(df, "k", mini_repeat_count=2, batch_size=3, repeat_count=4, seed=1).collect())
    seq = [r.k for r in rows]
    assert len(seq) == 2 * 3 * 4 * 2  # one incomplete chunk dropped
    first = seq[:6]
    assert seq[6:12] == first and first[0] == first[1] and len(set(first)) == 3
    assert len(set(seq)) == 6
