"""Invariants over the driver's tables."""

import re

from pyspark.sql import functions as F

from rewardlens.operators import rewards as R
from rewardlens.operators import stats as ST
from rewardlens.plans import fixtures as V
from tests.conftest import SF_SMALL


def test_advantages_sum_to_zero_per_group(spark):
    r = R.weighted_reward(V.rollouts(spark, SF_SMALL), list(V.ROLLOUT_REWARDS), V.ROLLOUT_WEIGHTS)
    a = R.group_advantage(r, "group_id", "reward")
    worst = a.groupBy("group_id").agg(F.abs(F.sum("advantage")).alias("s")).agg(F.max("s")).first()[0]
    assert worst is None or worst < 1e-6


def test_unpair_doubles_rows(spark):
    from rewardlens.operators.conversation import unpair_preference
    t = V.pref_text(spark, SF_SMALL).withColumnRenamed("question", "prompt")
    assert unpair_preference(t).count() == 2 * t.count()


def test_packing_is_the_stream_cut(spark):
    from rewardlens.operators.pack import pack_constant_length
    from rewardlens.plans.q_tokens import token_ids
    t = token_ids(spark, SF_SMALL)
    rows = sorted((r.doc_id, list(r.ids)) for r in t.collect())
    stream = [x for _, ids in rows for x in ids + [5]]
    L = 64
    want = [stream[i:i + L] for i in range(0, len(stream) - L + 1, L)]
    got = [list(r.input_ids) for r in sorted(pack_constant_length(t, "ids", ["doc_id"], L, 5).collect(), key=lambda r: r.piece_id)]
    assert got == want


def test_running_moments_are_those_of_all_rows_so_far(spark):
    import numpy as np
    b = V.batches(spark, SF_SMALL)
    got = {r.batch_id: r for r in ST.running_moments(b, "reward", "batch_id").collect()}
    rows = b.toPandas()
    for k in sorted(got):
        x = rows.reward[rows.batch_id <= k].to_numpy()
        assert abs(got[k].mean - np.mean(x)) < 1e-9 and abs(got[k].var - np.var(x)) < 1e-6 and abs(got[k]["count"] - len(x)) < 1e-9


def test_running_moments_of_large_values(spark):
    import numpy as np
    rng = np.random.default_rng(0)
    x = 1e8 + rng.normal(size=400)
    df = spark.createDataFrame([(int(i // 40), float(v)) for i, v in enumerate(x)], "batch long, v double")
    for r in ST.running_moments(df, "v", "batch").collect():
        so_far = x[:(r.batch + 1) * 40]
        assert abs(r.var / np.var(so_far) - 1) < 1e-6 and abs(r.mean - np.mean(so_far)) < 1e-6


def test_tracker_takes_the_last_rewards_of_a_prompt(spark):
    b = V.batches(spark, SF_SMALL).toPandas().sort_values(["batch_id", "ts", "event_id"])
    got = {r.event_id: r.advantage for r in ST.prompt_tracker(V.batches(spark, SF_SMALL), "prompt", "reward", "batch_id", ["ts", "event_id"], 8, 3).collect()}
    for (prompt, batch), rows in b.groupby(["prompt", "batch_id"]):
        past = b[(b.prompt == prompt) & (b.batch_id <= batch)].reward.to_numpy()
        use = past[-8:] if len(past) >= 3 else b[b.batch_id == batch].reward.to_numpy()
        for e, r in zip(rows.event_id, rows.reward):
            assert abs(got[e] - (r - use.mean()) / (use.std() + 1e-6)) < 1e-6


def test_null_keys_keep_their_rows(spark):
    df = spark.createDataFrame([(1, None, 1.0, 1, 1), (1, "a", 2.0, 2, 1), (None, "a", 3.0, 3, 0)], "batch_id int, prompt string, reward double, e int, m int")
    assert ST.prompt_tracker(df, "prompt", "reward", "batch_id", ["e"], 8, 3).count() == 3
    got = {r.batch_id: r["count"] for r in ST.batch_moments(df, "reward", "batch_id", mask="m").collect()}
    assert got == {1: 2.0, None: 0.0}


def test_encode_keeps_every_text(spark):
    from rewardlens.operators import tokens as T
    df = spark.createDataFrame([(1, "a b a"), (2, ""), (3, "  "), (4, "a zzz b")], "k long, text string")
    words = T.words(df, "k", "text")
    vocab = T.build_vocab(words.filter("token <> 'zzz'"))
    got = {r.k: list(r.input_ids) for r in T.encode(words, vocab, "k", keys=df, unk_id=99).collect()}
    assert got == {1: [0, 1, 0], 2: [], 3: [], 4: [0, 99, 1]}
    import pytest
    with pytest.raises(Exception, match="zzz"):
        T.encode(words, vocab, "k", keys=df).collect()
    text = {r.k: r.text for r in T.decode(T.encode(words, vocab, "k", keys=df, unk_id=99), vocab, "k", "input_ids", [0]).collect()}
    assert text == {1: "b", 2: "", 3: "", 4: "b"}


def test_encoding_joins_only_the_rare_words(spark, monkeypatch):
    from rewardlens.operators import tokens as T
    from rewardlens.plans.ordinal import written
    import pytest
    data = [(1, "a b a"), (2, ""), (3, None), (4, "a zzz\tb  " + "y" * 70), (4, "c"), (None, " c a "), (5, "zzz " * 3)]
    df = spark.createDataFrame(data, "k long, text string")
    vocab = written(T.build_vocab(T.words(df, "k", "text").filter("token <> 'zzz'")), "vocab")
    ids = {r.token: r.token_id for r in vocab.collect()}
    want = sorted([(k, [ids.get(w, 99) for w in (t or "").split()]) for k, t in data], key=repr)
    for sent in (1 << 18, 2, 0):  # all words sent but the long one, the two most frequent, none
        monkeypatch.setattr(T, "SENT_WORDS", sent)
        got = T.encode_texts(df, "k", "text", vocab, unk_id=99).collect()
        assert sorted([(r.k, list(r.input_ids)) for r in got], key=repr) == want
        assert all(r.attention_mask == [1] * len(r.input_ids) for r in got)
        cut = T.encode_texts(df, "k", "text", vocab, max_length=2, unk_id=99).collect()
        assert sorted([(r.k, list(r.input_ids)) for r in cut], key=repr) == sorted([(k, i[:2]) for k, i in want], key=repr)
        with pytest.raises(Exception, match="token outside the vocabulary: zzz"):
            T.encode_texts(df, "k", "text", vocab).collect()
    monkeypatch.setattr(T, "SENT_CHARS", 100)
    monkeypatch.setattr(T, "SENT_WORDS", 1 << 18)
    got = T.encode_texts(df, "k", "text", vocab, unk_id=99)
    assert sorted([(r.k, list(r.input_ids)) for r in got.collect()], key=repr) == want and "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_only_rare_words_leave_the_look_up(spark, monkeypatch):
    """Of the words of a text only those that are not sent are written; white space of every kind parts words."""
    from rewardlens.operators import tokens as T
    from rewardlens.plans.ordinal import written
    data = [(1, "a\x0bb\x0ca  r1 a\u00a0b "), (2, "r2\r\nr1 b a"), (3, " \t"), (4, None), (5, "a b " * 50 + "r2")]
    df = spark.createDataFrame(data, "k long, text string")
    vocab = written(T.build_vocab(T.words(df, "k", "text")), "vocab")
    ids = {r.token: r.token_id for r in vocab.collect()}
    staged = {}
    monkeypatch.setattr(T, "SENT_WORDS", 2)
    monkeypatch.setattr(T, "SLICE_CHARS", 8)
    monkeypatch.setattr(T, "written", lambda f, name: staged.setdefault(name, written(f, name)))
    got = {r.k: list(r.input_ids) for r in T.encode_texts(df, "k", "text", vocab).collect()}
    split = {k: [w for w in re.split("[ \t\n\x0b\x0c\r]+", t or "") if w] for k, t in data}
    assert got == {k: [ids[w] for w in ws] for k, ws in split.items()}
    assert {r["_key"]: r["_words"] for r in staged["looked-up"].collect()} == {k: [w for w in ws if ids[w] >= 2] for k, ws in split.items()}


def test_a_table_in_few_files_is_dealt_out(spark):
    from rewardlens.sources.tables import dealt, read_table
    docs = read_table(spark, SF_SMALL, "documents", ["doc_id", "text"])
    assert dealt(docs).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = docs.repartition(40)
    assert dealt(many) is many


def test_labels_by_plain_search(spark):
    """All templates in one pass against a slice at every position."""
    import random
    from rewardlens.functions import matching as M
    rng = random.Random(8)
    rows = [(i, None if i == 3 else [rng.choice([1, 1, 2, 2, 5, 7, None, -100]) for _ in range(rng.choice([0, 1, 2, 9, 30]))]) for i in range(300)]

    def starts(a, t):
        return [i for i in range(len(a) - len(t) + 1) if a[i:i + len(t)] == t]

    def single(a, t):
        at = starts(a, t)
        return [-100] * len(a) if not at else [-100 if i < at[-1] + len(t) else x for i, x in enumerate(a)]

    def multi(a, said, asked):
        e, s = [i + len(said) for i in starts(a, said)], starts(a, asked)
        if not e or not s:
            return [-100] * len(a)
        s = [0] + s if s[0] > e[0] else s
        out = list(a)
        for k in range(min(len(s), len(e))):
            for i in range(0 if k == 0 else s[k], e[k]):
                out[i] = -100
        return out[:s[-1]] + [-100] * (len(a) - s[-1]) if len(e) < len(s) else out

    df = spark.createDataFrame(rows, "k int, l array<int>").repartition(3)
    for said, asked in (([1, 2], [5]), ([1, 1], [1, 2, 1]), ([2], [2, 2])):
        got = df.select("k", M.label_completion_single("l", said).alias("s"), M.label_completion_multi("l", said, asked).alias("m")).collect()
        for r in got:
            a = rows[r.k][1]
            assert (r.s, r.m) == ((None, None) if a is None else (single(a, said), multi(a, said, asked))), (a, said, asked)


def test_automaton_finds_overlapping_and_nested_templates():
    import random
    import numpy as np
    from rewardlens.functions.matching import TemplateAutomaton
    rng = random.Random(2)
    for _ in range(300):
        templates = [[rng.randint(0, 2) for _ in range(rng.randint(1, 5))] for _ in range(rng.randint(1, 6))]
        docs = [[rng.randint(0, 3) for _ in range(rng.randint(0, 40))] for _ in range(3)]
        bounds = np.r_[0, np.cumsum([len(d) for d in docs])]
        got = TemplateAutomaton(templates).find(np.array(sum(docs, []), np.int64), bounds)
        for t, at in zip(templates, got):
            assert at.tolist() == [b + i for b, d in zip(bounds, docs) for i in range(len(d) - len(t) + 1) if d[i:i + len(t)] == t]


def test_ordinal_buckets_split_ties(spark):
    from rewardlens.plans.ordinal import range_buckets, running
    df = spark.range(40000).withColumn("tie", F.lit(1))
    sizes = [r["count"] for r in range_buckets(df, [F.col("tie"), F.col("id")], "b").groupBy("b").count().collect()]
    assert len(sizes) == 10 and max(sizes) < 3 * 4000
    bad = running(df, ["tie", "id"], out="o").filter("o <> id").count()
    assert bad == 0


def _greedy(sizes, limit):
    out, cur, b = [], 0, 0
    for s in sizes:
        out.append(b)
        cur += s
        if cur >= limit:
            cur, b = 0, b + 1
    return out


def test_buffers_equal_a_walk(spark, monkeypatch):
    import random

    from rewardlens.operators import pack as P
    from rewardlens.plans import ordinal
    monkeypatch.setattr(ordinal, "bucket_count", lambda rows: 70)  # three levels of the tree
    monkeypatch.setattr(P, "FAN", 5)
    rng = random.Random(1)
    for sizes, limit in (([100] * 3000, 3700), ([rng.randint(0, 50) for _ in range(3000)], 333), ([rng.randint(1, 9) for _ in range(500)], 100000), ([7] * 200, 3)):
        df = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "k long, s int")
        got = [r.buffer_id for r in P.buffer_ids(df, F.col("s"), ["k"], limit).orderBy("k").collect()]
        assert got == _greedy(sizes, limit)


def test_decode_moves_no_row_per_token(spark, monkeypatch):
    from rewardlens.operators import tokens as T
    from rewardlens.plans.ordinal import written
    long = "y" * 70
    vocab = written(spark.createDataFrame([("a", 0), ("b", 1), ("c", 2), (long, 5), ("d", 7)], "token string, token_id long"), "vocab")
    data = [(1, [0, 1, 2]), (2, []), (3, None), (None, [0]), (4, [5, 1]), (4, [2, 0, 7]), (5, [0, 99, -1, None, 2])]
    df = written(spark.createDataFrame(data, "k long, ids array<int>"), "ids")
    want = [(1, "a c"), (2, ""), (3, ""), (4, f"c {long} a d"), (4, f"c {long} a d"), (5, "a c"), (None, "")]
    for sent, chars in ((1 << 19, 64), (1 << 19, 100), (2, 64), (0, 64)):
        monkeypatch.setattr(T, "SENT_WORDS", sent)
        monkeypatch.setattr(T, "SENT_CHARS", chars)
        got = [(r.k, r.text) for r in T.decode(df, vocab, "k", "ids", [1]).collect()]
        assert sorted(got, key=lambda r: (r[0] is None, r[0] or 0)) == want, sent
    monkeypatch.setattr(T, "SENT_WORDS", 1 << 19)
    monkeypatch.setattr(T, "SENT_CHARS", 100)
    plan = T.decode(df.filter("k <> 4"), vocab, "k", "ids", [1])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan


def test_positions_come_in_slices(spark):
    import pyarrow as pa
    from rewardlens.functions.batches import in_slices, slices
    from rewardlens.operators import tokens as T
    masks = pa.array([[0, 1, 1], None, [], [1] * 9, [0, 0], [1, 0, 1]], pa.list_(pa.int32()))[1:]
    assert [len(s.flatten()) for s in slices(masks, 4)] == [0, 9, 2, 3]
    want = [None, [], list(range(9)), [0, 0], [0, 1, 1]]
    assert in_slices(masks, T._cumsum_before, 4).to_pylist() == want == T._cumsum_before(masks).to_pylist()
    df = spark.createDataFrame([(i, m) for i, m in enumerate(masks.to_pylist())], "k int, m array<int>")
    assert [r.p for r in df.select("k", T.position_ids("m").alias("p")).orderBy("k").collect()] == want


def test_the_stand_in_model_scores_in_slices(monkeypatch):
    import pandas as pd
    from rewardlens.operators import udf as U
    texts = pd.Series(["a b a", None, "", " c ", "a a a a", "x y z"] * 3, index=range(40, 58))
    seen = []
    plain = U.LexicalDiversityScorer._shares
    monkeypatch.setattr(U, "SLICE_CHARS", 8)
    monkeypatch.setattr(U.LexicalDiversityScorer, "_shares", lambda self, t: seen.append(t.fillna("").str.len().sum()) or plain(self, t))
    got = U.LexicalDiversityScorer().score(texts)
    assert len(seen) > 3 and max(seen) <= 8 and list(got.index) == list(texts.index)
    assert [None if x != x else round(x, 6) for x in got] == [0.666667, None, None, 1.0, 0.25, 1.0] * 3
    assert len(U.LexicalDiversityScorer().score(texts[:0])) == 0
