"""Sub-word ids against the public tokenizer, a plain trainer-order merge, and round trips."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rewardlens.operators.subword import MergeRanks, SubwordVocabulary
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def vocab(spark):
    return SubwordVocabulary.from_file(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def texts():
    rng = random.Random(3)
    out = ["", " ", "\n\n", "Hello world", "don't  stop\tnow \n", "naïve café 中文字 русский", "a" * 5000, "ab " * 3000, "x y　z w", "🙂🙃 é", "12 345,67.8",
           "<|endoftext|> is text", "  lead and trail  ", "\x00\x01\x7f", "I'll we've SHE'S 's"]
    alphabet = ["a", "B", "é", "中", " ", "  ", "\n", "\t", "'s", "'", "1", "23", ".", ",", "!?", "🙂", " ", "the", " of"]
    out += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    return out


def naive_merge(ranks, piece):
    parts = [piece[i:i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: (ranks.get(parts[i] + parts[i + 1], 1 << 60), i))
        if parts[best] + parts[best + 1] not in ranks:
            break
        parts[best:best + 2] = [parts[best] + parts[best + 1]]
    return [ranks[p] for p in parts]


def test_merging_by_rank():
    rng = random.Random(0)
    for _ in range(60):
        ranks = {bytes([b]): b for b in range(256)}
        while len(ranks) < 256 + 40:  # every entry is a union of two earlier ones, as a trainer leaves them
            a, b = rng.choice([*list(ranks)[97:101], *list(ranks)[256:]]), rng.choice([*list(ranks)[97:101], *list(ranks)[256:]])
            ranks.setdefault(a + b, len(ranks))
        m = MergeRanks(ranks)
        for _ in range(40):
            piece = bytes(rng.choice(b"abcd") for _ in range(rng.randint(1, 40)))
            want = [ranks[piece]] if piece in ranks else naive_merge(ranks, piece)
            assert m.merge(piece) == want
            assert b"".join(t for i in want for t, r in ranks.items() if r == i) == piece


def test_long_pieces_take_n_log_n():
    import time

    ranks = {bytes([b]): b for b in range(256)} | {b"a" * (2 ** k): 255 + k for k in range(1, 12)}
    begin = time.process_time()
    assert sum(MergeRanks(ranks).merge(b"a" * 300_000)) > 0
    assert time.process_time() - begin < 6


def test_ids_are_the_tokenizers(spark, vocab, plain):
    data = texts()
    df = spark.createDataFrame(list(enumerate(data)) + [(-1, None)], "k int, text string").repartition(3)
    got = {r.k: r for r in vocab.encode(df, "k", "text").collect()}
    assert got[-1].input_ids == [] and got[-1].attention_mask == []
    for k, t in enumerate(data):
        assert got[k].input_ids == plain.encode(t, add_special_tokens=False).ids, repr(t)
        assert got[k].attention_mask == [1] * len(got[k].input_ids)
    cut = {r.k: r.input_ids for r in vocab.encode(df, "k", "text", max_length=3).collect()}
    assert all(cut[k] == got[k].input_ids[:3] for k in got)


def test_round_trip_and_skipped_ids(spark, vocab):
    data = texts()
    df = spark.createDataFrame(list(enumerate(data)), "k int, text string")
    ids = vocab.encode(df, "k", "text")
    assert {r.k: r.text for r in vocab.decode(ids, "k", "input_ids").collect()} == dict(enumerate(data))
    odd = spark.createDataFrame([(0, [vocab.ranks[b"a"], 999_999, -5, vocab.ranks[b"b"], vocab.ranks[b"c"]]), (1, None), (2, [vocab.ranks[b"\xe4"]])], "k int, ids array<int>")
    assert {r.k: r.text for r in vocab.decode(odd, "k", "ids", skip_ids=[vocab.ranks[b"b"]]).collect()} == {0: "ac", 1: "", 2: "�"}


def test_counts(spark, vocab, plain):
    data = [t for t in texts() if t] + ["the the the", "the"]
    got = {r.token_id: (r.n, r.texts) for r in vocab.counts(spark.createDataFrame([(t,) for t in [*data, None, ""]], "text string"), "text").collect()}
    n, docs = {}, {}
    for t in data:
        ids = plain.encode(t, add_special_tokens=False).ids
        for i in ids:
            n[i] = n.get(i, 0) + 1
        for i in set(ids):
            docs[i] = docs.get(i, 0) + 1
    assert len(got) == len(vocab) and {i: x for i, x in got.items() if x[0]} == {i: (n[i], docs[i]) for i in n}


def test_no_shuffle_and_whole_documents(spark, vocab, plain):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    ids = vocab.encode(docs, "doc_id", "text")
    assert "Exchange" not in ids._jdf.queryExecution().executedPlan().toString()
    want = {r.doc_id: plain.encode(r.text or "", add_special_tokens=False).ids for r in docs.select("doc_id", "text").collect()}
    assert {r.doc_id: r.input_ids for r in ids.collect()} == want


def test_chatml_labels_over_subwords(spark, vocab, plain):
    from rewardlens.operators.collate import chatml_collate

    m = [[("user", "Hi there"), ("assistant", "Hello! How are you?")], [("user", "One more"), ("assistant", "Sure.")]]
    df = spark.createDataFrame([(i, 0, x) for i, x in enumerate(m)], "conv_id int, batch_id int, messages array<struct<role: string, content: string>>")
    got = {r.conv_id: r for r in chatml_collate(df, vocab, pad_id=50256).collect()}
    width = max(len(r.input_ids) for r in got.values())
    for i, x in enumerate(m):
        full = "".join(f"<|im_start|>{r}\n{c}<|im_end|>\n" for r, c in x)
        ids = plain.encode(full, add_special_tokens=False).ids
        own = got[i]
        assert len(own.input_ids) == width and own.input_ids[width - len(ids):] == ids and set(own.input_ids[:width - len(ids)]) <= {50256}
        answer = [v for v in own.labels if v != -100]
        assert ids[-len(answer):] == answer and plain.decode(answer).startswith(x[1][1])


def test_vocabulary_errors(spark):
    with pytest.raises(ValueError, match="byte"):
        SubwordVocabulary(spark, {b"a": 0})
    with pytest.raises(ValueError, match="share"):
        SubwordVocabulary(spark, {bytes([b]): b for b in range(256)} | {b"ab": 3})


def test_batches_are_coded_in_slices():
    """No array over all pieces or ids of a batch is made."""
    import pyarrow as pa
    from rewardlens.functions import batches
    data = [[f" word{i}", " the", "!"] * (i % 5) for i in range(40)]
    pieces = pa.array(data, pa.list_(pa.string()))
    sizes = []

    def coded(part):
        sizes.append(len(part.flatten()))
        return pa.array([[len(p) for p in row] for row in part.to_pylist()], pa.list_(pa.int32()))

    got = batches.in_slices(pieces, coded, 16)
    assert max(sizes) <= 16 and len(sizes) > 10 and got.to_pylist() == [[len(p) for p in row] for row in data]
