"""Decontamination, packing and the pipeline."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from rewardlens.llm import decontam, packing
from rewardlens.llm.textbatch import text_buffer
from tests.llm.data import prose, rows, stored, table
from tests.llm.test_dedup import brute_exact, brute_simhash

PATH = public_tokenizers.path("byte_bpe_50k.json")


def smith_waterman(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (1 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return int(h.max())


def test_alignment_scores():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(1, 15))] for _ in range(2))
        assert decontam.align(np.array(a, np.uint64), np.array(b, np.uint64))[0] == smith_waterman(a, b)


def leak_case():
    rng = random.Random(5)
    items = [prose(rng, rng.randint(24, 60) if 10 <= k < 20 else rng.randint(14, 60)) for k in range(30)] + ["", None, "two words", prose(rng, 400)]
    docs = []
    for k in range(60):
        docs.append([k, prose(rng, 150), "en"])
    truth = set()

    def plant(doc, item, words):
        w = docs[doc][1].split()
        docs[doc][1] = " ".join(w[:70] + words + w[70:])
        truth.add((doc, item))

    for k in range(10):  # exact, upper case, punctuated
        w = items[k].split()
        plant(k, k, w if k % 3 == 0 else [x.upper() for x in w] if k % 3 == 1 else [x + "," for x in w])
    for k in range(10, 20):  # edited: every ninth word replaced, one dropped, one added
        w = items[k].split()
        w = ["edit" if i % 9 == 4 else x for i, x in enumerate(w)]
        plant(k, k, w[:8] + ["extra"] + w[8:11] + w[12:])
    plant(20, 33, items[33].split()[100:200])  # an excerpt of a long item
    plant(21, 3, items[3].split())
    return [tuple(d) for d in docs], items, truth


def test_seeds_are_rare_pairs_and_cover_every_passage():
    rng = random.Random(3)
    texts = [prose(rng, rng.randint(5, 60)) for _ in range(40)] + ["the of the of the of the of the of the of"]
    block = decontam.Items(list(range(41)), texts)
    gram = np.unique(block.gram)
    held = np.array([rng.randint(0, 1000) for _ in gram])
    every = Counter(block.item.tolist())
    cost = {g: n * len({i for h, i in zip(block.gram.tolist(), block.item.tolist()) if h == g}) for g, n in zip(gram.tolist(), held.tolist())}
    all_pairs = list(zip(block.gram.tolist(), block.item.tolist(), block.pos.tolist()))
    block.keep_rare(gram, held)
    kept = set(zip(block.gram.tolist(), block.item.tolist(), block.pos.tolist()))
    for i, n in every.items():
        need = int(np.ceil(decontam.least_score(len(texts[i].split()))))
        own = [p for p in all_pairs if p[1] == i]
        dropped = [p for p in own if p not in kept]
        assert len(dropped) == (need - 1) // 2 == block.spared[i] and block.seeds[i] == need - 1 - len(dropped) >= 1
        assert max((cost[p[0]] for p in kept if p[1] == i), default=0) <= min((cost[p[0]] for p in dropped), default=10**9)


@pytest.mark.parametrize("hits", [1 << 20, 7])
def test_frequent_seeds_are_worked_off_in_parts(spark, tmp_path, monkeypatch, hits):
    """Many items of the same pairs in one document: parts of any size give the same rows."""
    monkeypatch.setattr(decontam, "HITS", hits)
    rng = random.Random(4)
    items = ["one two one two one two " + prose(rng, 4) for _ in range(12)] + [prose(rng, 30)]
    data = [(0, "one two " * 40 + items[3] + " one two" * 5, "en"), (1, prose(rng, 50) + " " + items[12] + " " + items[5], "en"), (2, items[12] * 1, None), (2, items[12] * 1, None), (3, None, None)]
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(items)] + [(12, items[12])], "item_id long, text string")
    got = sorted(tuple(r)[1:] for r in decontam.contaminated(stored(spark, tmp_path, data), bench).collect())
    want = set()
    for i, text, _ in data:
        for k, item in enumerate(items):
            score = decontam.align(decontam._words(pa.array([item]))[0], decontam._words(pa.array([text or ""]))[0])[0]
            if score >= decontam.least_score(len(item.split())):
                want.add((i, k))
    assert {(r[0], r[1]) for r in got} == want
    # repeated rows and repeated items give a row each
    assert sum((r[0], r[1]) == (2, 12) for r in got) == 4
    if hits == 7:
        monkeypatch.setattr(decontam, "HITS", 1 << 20)
        assert got == sorted(tuple(r)[1:] for r in decontam.contaminated(spark.read.parquet(f"{tmp_path}/documents.parquet"), bench).collect())


@pytest.mark.parametrize("block", [1 << 20, 200])
def test_leaks_are_found_and_nothing_else(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_WORDS", block)
    data, items, truth = leak_case()
    docs = stored(spark, tmp_path, data + [(100, None, None), (101, "", None)])
    bench = spark.createDataFrame([(k, t, 1) for k, t in enumerate(items)], "item_id long, text string, id int")
    got = decontam.contaminated(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == truth
    for r in got:
        if r.item_id < 10:
            assert r.score == r.item_words == r.last_word - r.first_word and r.share == 1
    kept = decontam.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {d[0] for d in data} - {d for d, _ in truth} | {100, 101}


def test_edited_copies_against_seedless_alignment(spark, tmp_path):
    rng = random.Random(9)
    items = [prose(rng, rng.randint(6, 23)) for _ in range(24)] + [prose(rng, 90)]
    docs = []
    for k, item in enumerate(items):
        w = item.split()
        for phase in range(4):  # every fourth word replaced
            docs.append(" ".join([*prose(rng, 30).split(), *["edit" if i % 4 == phase else x for i, x in enumerate(w)], *prose(rng, 30).split()]))
        # a word put in after every two: no stretch of three is left, yet half the words score
        docs.append(" ".join([*prose(rng, 30).split(), *[y for i, x in enumerate(w) for y in ([x, "more"] if i % 2 and i + 1 < len(w) else [x])], *prose(rng, 30).split()]))
        docs.append(" ".join([*w, *prose(rng, 3).split(), *w]))  # two copies close to each other
    got = decontam.contaminated(stored(spark, tmp_path, [(k, t, "en") for k, t in enumerate(docs)]),
                                spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    best = {}
    for r in got:
        best[(r.doc_id, r.item_id)] = max(r.score, best.get((r.doc_id, r.item_id), 0))
    want = {}
    for k, d in enumerate(docs):
        for i, item in enumerate(items):
            score = decontam.align(decontam._words(pa.array([item]))[0], decontam._words(pa.array([d]))[0])[0]
            if score >= decontam.least_score(len(item.split())):
                want[(k, i)] = score
    assert best == want
    assert all(sum((r.doc_id, r.item_id) == (6 * i + 5, i) for r in got) == 2 for i in range(len(items)))


def test_no_items_or_documents(spark, tmp_path):
    docs = stored(spark, tmp_path)
    bench = spark.createDataFrame([(1, "some item of more than five words")], "item_id long, text string")
    assert decontam.contaminated(docs, bench.filter("false")).count() == 0
    assert decontam.contaminated(docs.filter("false"), bench).count() == 0


def test_chunk_ids_are_the_tokenizers():
    import pyarrow as pa

    texts = [t for _, t, _ in rows()] + ["  a  b\n\n c", "don't  stop 123 abc\t q ", "a\u3000b\u00a0 c", "ab  ", " lead", "x.y,z .a ,b", "é. ü, A.B C.d e.\n", "a,,b..c", "1.5 2,3", "\u0085 x\u2028 y"]
    rng = random.Random(4)
    texts += ["".join(rng.choice("ab.,' \n\té中1\u00a0\u3000") for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    enc = packing.ChunkEncoder(PATH)
    plain = Tokenizer.from_file(PATH)
    for _ in range(2):  # the second time from the cache
        ids, at = enc.encode(*text_buffer(pa.array(texts, pa.string())))
        for k, t in enumerate(texts):
            assert ids[at[k]:at[k + 1]].tolist() == plain.encode(t or "", add_special_tokens=False).ids, repr(t)


def test_plans_hold_every_piece():
    rng = random.Random(0)
    for _ in range(150):
        cap = rng.choice([10, 20, 50, 100, 1024])
        hist = {rng.randint(1, cap - 1): rng.randint(1, rng.choice([2, 5, 1000])) for _ in range(rng.randint(0, 40))}
        first, plan = packing.best_fit(hist, cap), packing.bin_completion(hist, cap, nodes=300)
        for p in (first, plan):
            held = Counter()
            for filling, times in p:
                assert sum(filling) <= cap and times > 0
                for s in filling:
                    held[s] += times
            assert held == Counter(hist)
        assert sum(n for _, n in plan) <= sum(n for _, n in first)


def test_search_beats_best_fit():
    # 6 5 5 4 3 3 2 2 in tens: best fit takes four, three is possible
    hist = {6: 1, 5: 1, 4: 1, 3: 4, 2: 1, 1: 1}
    assert sum(n for _, n in packing.bin_completion(hist, 10)) == 3
    assert sum(n for _, n in packing.bin_completion({3: 4, 7: 2, 4: 2, 2: 2}, 10)) == 4


def check_pack(got, data, capacity):
    plain = Tokenizer.from_file(PATH)
    want = Counter()
    for i, t in data:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [2]
        head = len(ids) % capacity or capacity
        cuts = [0, *range(head, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in seqs.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(seqs)


@pytest.mark.parametrize("capacity", [1024, 32])
def test_pack(spark, capacity):
    got = packing.pack(table(spark), PATH, capacity).collect()
    n = check_pack(got, [(i, t) for i, t, _ in rows()], capacity)
    assert n <= -(-sum(r.length for r in got) // capacity) + 3


def test_pack_empty(spark):
    assert packing.pack(table(spark, []), PATH).count() == 0


def test_pipeline_against_brute_force(spark, tmp_path):
    data, items, truth = leak_case()
    data = data + [(i + 1000, t, lang) for i, t, lang in rows() if i is not None]
    stored(spark, tmp_path, data)
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    letters = [d for d in data if any(c.isalpha() for c in d[1] or "")]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    docs = {r.doc_id for r in got}
    assert not docs & {d for d, _ in truth}
    classes = {}
    for i, t, _ in letters:
        classes.setdefault("".join((t or "").split()), []).append((-len(t), i))
    unique = [min(v)[1] for v in classes.values()]
    left = [d for d in letters if d[0] in unique]
    groups, _ = brute_simhash(left)
    want = {c for _, _, c in groups} - {d for d, _ in truth}
    assert docs == want
    check_pack(got, [(i, t) for i, t, _ in data if i in docs and i != 1077] + [(1077, "the same")] * (1077 in docs), 1024)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "simhash_dedup", "decontamination", "packing"]
    assert brute_exact(data)


def test_pipeline_drops_texts_of_no_learned_language(spark, tmp_path):
    rng = random.Random(11)
    clean = [(i, prose(rng, 80, "en" if i % 2 else "de"), "en" if i % 2 else "de") for i in range(30)]
    short = [(40, "the same", None), (41, "er", None)]  # either language, and unlabelled
    unlabelled = [(50, prose(rng, 80), None), (51, prose(rng, 80, "de"), None)]
    junk = [(60, " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(50)), None),
            (61, "".join(rng.choice("0123456789abcdef") for _ in range(400)), None), (62, "= " * 200 + "a", None),
            (63, "中文字符測試一二三四五六七八九十" * 5, None), (64, "a" + "~" * 40, None)]
    docs = stored(spark, tmp_path, clean + short + unlabelled + junk)
    left = corpus_pipeline.language_id(spark, docs, str(tmp_path))
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.select("doc_id").collect()} == {i for i, _, _ in clean + short + unlabelled}


@pytest.mark.parametrize("data", [
    [], [(1, None, "en")], [(1, "12 34", "en"), (2, "", None)],  # no rows; a stage keeps nothing
    [(None, "the of and the of", "en"), (None, "the of and the of", "en"), (None, None, None), (5, "the  of and the of", "en"), (6, "und der", "de"), (6, "und der", "de")]])
def test_pipeline_of_awkward_tables(spark, tmp_path, data):
    stored(spark, tmp_path, data)
    spark.createDataFrame([(1, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # of equal texts the longest stays, then the smallest id; null ids come last; repeated rows are one
    assert sorted(r.doc_id for r in got) == ([5, 6] if len(data) > 2 else [])
