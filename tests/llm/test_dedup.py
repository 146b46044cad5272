"""Substring, exact and SimHash deduplication against brute force."""

import hashlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from rewardlens.llm import exact, sharding, simhash, substring
from tests.llm.data import SPACE, rows, stored, table, words

NULL_LAST = 10**18


def brute_repeats(data, window=13):
    key = lambda i: NULL_LAST if i is None else i
    first = {}
    for i, t, _ in data:
        w = words(t)
        for k in range(len(w) - window + 1):
            g = tuple(w[k:k + window])
            first[g] = min(first.get(g, NULL_LAST), key(i))
    out = []
    for i, t, _ in data:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k:k + window])] < key(i):
                gone[k:k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def test_messages_follow_the_input():
    for edges in (0, 1, 10**6, 10**8, 10**10, 10**13):
        layout = substring.Layout.of(6 * edges, edges)
        assert layout.blocks * layout.parts <= 4 + 3 * edges // substring.MESSAGE_EDGES + edges // 10**5
        assert 40 <= layout.bits <= 56 and 2 ** layout.bits >= 100 * edges
        short = layout.short(np.sort(np.random.default_rng(1).integers(0, 2**64, 1000, np.uint64)))
        at = layout.bounds(short) if layout.parts < 10**5 else [0, len(short)]
        assert at[0] == 0 and at[-1] == len(short)
    assert substring.Layout.of(10**8, 16 * 10**6) == (1 + 10**8 // substring.BLOCK_BYTES, 1 + 16 * 10**6 // substring.EDGES_PER_PART, 40)


@pytest.mark.parametrize("block, bits", [(1 << 21, 40), (4000, 40), (4000, 56), (2000, 62)])
def test_substring_matches_brute_force(spark, tmp_path, monkeypatch, block, bits):
    monkeypatch.setattr(substring, "LEAST_BITS", bits)  # 62: more senders than fit beside a hash
    monkeypatch.setattr(substring, "BLOCK_BYTES", block)
    monkeypatch.setattr(substring, "EDGES_PER_PART", block // 4)
    found = substring.remove_repeats(stored(spark, tmp_path), texts=True)
    got = found.collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_repeats(rows())
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in got)
    by = {(r.doc_id, r.rid): r for r in got}
    text = {i: words(t) for i, t, _ in rows() if i is not None}
    for r in by.values():  # spans are whole paths; removed ones cover exactly the removed words
        covered = set()
        for s in r.spans:
            assert s.words >= 13
            if s.removed:
                covered |= set(range(s.start, s.start + s.words))
            if r.doc_id is not None:
                assert hashlib.sha256(" ".join(text[r.doc_id][s.start:s.start + s.words]).encode()).hexdigest()[:32] == s.digest
        assert len(covered) == r.n_removed
    paths = substring.repeated_paths(found).collect()
    assert len({(p.path, p.words) for p in paths}) == len(paths) and all(p.n_occurrences >= 1 for p in paths)


def test_substring_compacts_a_shared_passage(spark, tmp_path):
    shared = " ".join(f"w{i}" for i in range(40))
    data = [(1, "a b " + shared + " c", None), (2, shared, None), (3, "x " + " ".join(shared.split()[10:]), None)]
    spans = {r.doc_id: [(s.start, s.words, s.removed) for s in r.spans] for r in substring.remove_repeats(stored(spark, tmp_path, data)).collect()}
    # all three share one path; where document 3 joins it, it is cut for all
    assert spans == {1: [(2, 22, False), (12, 30, False)], 2: [(0, 22, True), (10, 30, True)], 3: [(1, 30, True)]}


def brute_exact(data):
    groups = {}
    for k, (i, t, _) in enumerate(data):
        groups.setdefault(SPACE.sub("", t or ""), []).append((-len(t or ""), i is None, i if i is not None else 0, k))
    out = []
    for norm, members in groups.items():
        keep = min(members)
        for m in members:
            out.append((None if m[1] else m[2], None if keep[1] else keep[2], len(members), hashlib.sha256(norm.encode()).hexdigest()))
    return Counter(out), len(groups)


@pytest.mark.parametrize("capacity", [4096, 3])
def test_exact_matches_brute_force(spark, tmp_path, capacity):
    docs = stored(spark, tmp_path)
    got = exact.exact_dedup(docs, capacity=capacity).collect()
    want, classes = brute_exact(rows())
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == classes
    kept = exact.drop_copies(docs, capacity=capacity)
    assert kept.columns == docs.columns and kept.count() == classes


def test_index_buckets_hold_their_entries(spark, tmp_path):
    docs = stored(spark, tmp_path)
    log = exact._log(docs, "doc_id", "text", None)
    classes = exact.byte_classes(docs)
    index = exact.build_index(log, classes, capacity=3).collect()
    sizes = Counter(r.bucket for r in index)
    assert max(sizes.values()) <= 3 and len(sizes) > 10
    assert len({(r.h, r.sha) for r in index}) == len(index)
    # classes of one hash are chained, each with its own size; texts of one digest that differ in bytes stop the job
    from pyspark.sql import functions as F
    h = index[0].h
    same_hash = classes.withColumn("h", F.lit(h)), log.withColumn("h", F.lit(h))
    chained = exact.build_index(same_hash[1], same_hash[0]).collect()
    assert sorted(r.chain for r in chained) == list(range(len(index))) and Counter((r.sha, r.group_size) for r in chained) == Counter((r.sha, r.group_size) for r in index)
    with pytest.raises(Exception, match="differ in their bytes"):
        exact.build_index(same_hash[1].withColumn("sha", F.lit("x")), same_hash[0].withColumn("sha", F.lit("x"))).collect()


def test_rows_are_numbered_once(spark, tmp_path):
    """Stages on a plan that is no table as read, and that comes out in another order each time."""
    from pyspark.sql import functions as F
    data = [(i, t, "en") for i, t, _ in rows() if t and len(t) < 5000]
    docs = stored(spark, tmp_path, data).repartition(7).withColumn("z", F.rand()).orderBy("z").drop("z")
    _, classes = brute_exact(data)
    kept = exact.drop_copies(docs)
    assert kept.count() == classes and len({SPACE.sub("", r.text) for r in kept.select("text").collect()}) == classes
    near = simhash.drop_near_copies(docs)
    assert near.count() == len({r.component_id for r in simhash.simhash_groups(stored(spark, tmp_path, data, "again")).collect()})


def brute_simhash(data, n=4):
    fps = []
    for i, t, _ in data:
        w = words(t, lower=True)
        sh = [" ".join(w[k:k + n]) for k in range(max(1, len(w) - n + 1))] if w else []
        hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)))
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(fps)):
        for y in range(x):
            if (fps[x] ^ fps[y]).bit_count() <= 4:
                parent[find(x)] = find(y)
    lowest = {}
    for k, (i, _, _) in enumerate(data):
        if i is not None:
            lowest[find(k)] = min(lowest.get(find(k), NULL_LAST), i)
    return Counter((i, f"{fps[k]:016x}", lowest.get(find(k))) for k, (i, _, _) in enumerate(data)), len({find(k) for k in range(len(fps))})


def test_simhash_matches_brute_force(spark, tmp_path):
    docs = stored(spark, tmp_path)
    got = simhash.simhash_groups(docs).collect()
    want, groups = brute_simhash(rows())
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want
    assert sum(r.kept for r in got) == groups
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns and kept.count() == groups


@pytest.mark.parametrize("reach", [2, 3, 4])
def test_simhash_links_every_near_pair(spark, monkeypatch, reach):
    """Planted fingerprints around some centres: components equal those of all pairs."""
    import random

    monkeypatch.setattr(simhash, "REACH_UP_TO", ((reach, 1 << 40),))
    assert simhash.reach_of(10) == reach
    rng = random.Random(3)
    fps = set()
    for _ in range(30):
        c = rng.getrandbits(64)
        for _ in range(rng.randint(1, 25)):
            x = c
            for b in rng.sample(range(64), rng.randint(0, 7)):
                x ^= 1 << b
            fps.add(x)
    fps |= {0, (1 << 64) - 1, 15, 31}
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    got = {r.fp: r.root for r in simhash.link_fingerprints(spark.createDataFrame([(x, 1) for x in signed], "fp long, n long")).collect()}
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(fps)):
        for y in range(x):
            if (fps[x] ^ fps[y]).bit_count() <= 4:
                parent[find(x)] = find(y)
    classes = {}
    for k, s in enumerate(signed):
        classes.setdefault(find(k), set()).add(s)
    mine = {}
    for s, root in got.items():
        mine.setdefault(root, set()).add(s)
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, mine.values()))


def test_shards_fit(spark):
    from pyspark.sql import functions as F

    docs = table(spark)
    got = sharding.extendible_shards(docs, "doc_id", F.octet_length("text"), 3000).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _, _ in rows())
    size, members = Counter(), Counter()
    for r in got:
        size[r.shard] += r.bytes
        members[r.shard] += 1
        assert r.hash >> (60 - r.depth) == r.prefix and r.oversize == (r.bytes > 3000)
    assert all(n <= 3000 or members[s] == 1 for s, n in size.items())


def test_one_key_is_chained_over_shards(spark):
    from pyspark.sql import functions as F

    docs = table(spark, [(5, "x" * 100, None)] * 300 + [(i, "y" * 50, None) for i in range(100, 200)])
    got = sharding.extendible_shards(docs, "doc_id", F.octet_length("text"), 1000).collect()
    size = Counter()
    for r in got:
        size[r.shard] += r.bytes
    assert len(got) == 400 and max(size.values()) <= 1000
    assert len({r.shard for r in got if r.doc_id == 5}) == 30


def test_a_chained_key_keeps_all_rows_under_any_join(spark):
    """Half of all rows have one key, no side is broadcast, and AQE cuts and joins partitions as it likes."""
    from pyspark.sql import functions as F

    n = 40_000
    docs = spark.range(0, n, 1, 40).select(F.when(F.col("id") % 2 == 0, F.lit(-1)).otherwise(F.col("id")).alias("doc_id"), (F.col("id") % 7).alias("n"))
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.shuffle.partitions": "23"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = sharding.extendible_shards(docs, "doc_id", F.col("n"), 500)
        rows_, keys = got.count(), got.filter("doc_id = -1").count()
        largest = got.groupBy("shard").agg(F.sum("bytes").alias("b")).agg(F.max("b")).first()[0]
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert (rows_, keys) == (n, n // 2) and largest <= 500


@pytest.mark.parametrize("run", [
    lambda d: substring.remove_repeats(d), lambda d: exact.exact_dedup(d), lambda d: simhash.simhash_groups(d),
    lambda d: sharding.extendible_shards(d, "doc_id", __import__("pyspark").sql.functions.octet_length("text"), 100)])
def test_empty_table(spark, run):
    assert run(table(spark, [])).count() == 0
