"""Permutations by arithmetic, bucketed joins, the split source, table functions."""

import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from rewardlens.functions.udtf import register_table_functions
from rewardlens.operators import permute as PM
from rewardlens.operators import rewards as R
from rewardlens.plans import fixtures as V
from rewardlens.sources.bucketed import co_joined, write_bucketed
from rewardlens.sources.split_source import parse_split, read_split, row_range
from tests.conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ---------------------------------------------------------------- permutations


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 7, 11, 16, 97, 100, 997, 2048, 4999])
def test_a_bijection_for_any_count(spark, n):
    d = PM.domain(n)
    assert d.a * d.b >= n and d.excess <= d.a
    got = spark.range(n).select("id", PM.permuted("id", d, 5).alias("p")).withColumn("back", PM.permuted("p", d, 5, back=True)).collect()
    assert sorted(r.p for r in got) == list(range(n)) and all(r.back == r.id for r in got)


def test_domains_of_large_counts_are_square_and_tight():
    for n in (10**6 + 3, 10**9 + 7, 10**12 + 39, 2**53 + 111, 10**17 + 3):
        d = PM.domain(n)
        assert d.a * d.b >= n and d.excess <= 300 and 0.4 < d.a / d.b < 4.1


def test_orders_are_seeded_and_unrelated(spark):
    d = PM.domain(2000)
    one, two = ([r[0] for r in spark.range(2000).orderBy("id").select(PM.permuted("id", d, s)).collect()] for s in (1, 2))
    assert one != two and sum(a == b for a, b in zip(one, two)) < 12
    near = sum(abs(a - b) < 20 for a, b in zip(one, one[1:]))
    assert near < 80  # 40 are expected of a random order
    even = sum(p < 1000 for p in one[::2])
    assert 430 < even < 570


def test_no_exchange_after_the_ordinal(spark):
    assert "Exchange" not in _plan(spark.range(10**6).select(PM.permuted("id", PM.domain(10**6))))
    assert "Exchange" not in _plan(PM.sampler_index(spark, 10**9, 4, 3, 2))
    with pytest.raises(Exception, match="outside"):
        spark.range(5).select(PM.permuted("id", PM.domain(4))).collect()


def test_samplers_agree(spark):
    df = spark.createDataFrame([(10 * i,) for i in range(23)], "k long")
    rows = {r.position: r.k for r in PM.repeat_sampler(df, "k", 2, 4, 3, seed=9).collect()}
    index = {r.position: r["index"] for r in PM.sampler_index(spark, 23, 2, 4, 3, seed=9).collect()}
    assert sorted(rows) == list(range(5 * 4 * 2 * 3)) and rows == {p: 10 * i for p, i in index.items()}
    chunk = [rows[p] for p in range(24)]
    assert chunk[:8] == chunk[8:16] == chunk[16:] and chunk[::2] == chunk[1::2] and len(set(chunk)) == 4
    shuffled = {r.k: r.ordinal for r in PM.shuffle_rows(df, "k", 9).collect()}
    assert all(shuffled[rows[p]] == p // 24 * 4 + p % 8 // 2 for p in rows)
    e = PM.expand_generations(spark.createDataFrame([(x,) for x in "abcaab"], "p string"), "p", 2, 3).collect()
    assert sorted((r.prompt_rank, r.generation) for r in e) == [(i, g) for i in range(3) for g in range(2)] and {r.p for r in e} == set("abc")


# ---------------------------------------------------------------- bucketed tables


def test_joins_of_bucketed_tables_exchange_nothing(spark):
    t = V.logps(spark, SF_SMALL)
    keys = ["sample_id", "pos"]
    parts = [write_bucketed(t.select(*keys, c), keys, "logps", 4) for c in ("logp", "old_logp", "ref_logp")]
    j = co_joined(*parts, on=keys)
    assert "Exchange" not in _plan(j) and "SortMergeJoin" in _plan(j)
    plain = R.join_logps(*(t.select(*keys, c) for c in ("logp", "old_logp", "ref_logp")))
    assert "Exchange" in _plan(plain)
    assert sorted(map(tuple, j.collect())) == sorted(map(tuple, plain.collect()))
    means = parts[0].groupBy(*keys).agg(F.avg("logp"))
    assert "Exchange" not in _plan(means)


def test_rewards_and_prompts_in_buckets(spark):
    rng = random.Random(1)
    rows = [(i, f, rng.random()) for i in range(50) for f in ("a", "b")]
    long = write_bucketed(spark.createDataFrame(rows, "sample long, func string, reward double"), ["sample"], "rewards", 3)
    wide = R.join_rewards_long(long, ["sample"], ["a", "b"])
    assert "Exchange" not in _plan(wide)
    assert sorted((r["sample"], r.a, r.b) for r in wide.collect()) == sorted((i, dict((f, x) for j, f, x in rows if j == i)["a"], dict((f, x) for j, f, x in rows if j == i)["b"]) for i in range(50))
    p, c = (write_bucketed(spark.createDataFrame([(i, f"{n}{i}") for i in range(20 - (n == "c"))], f"sample_id long, {n} string"), ["sample_id"], n, 3) for n in "pc")
    j = R.join_prompt_completion(p, c.hint("merge"), "sample_id", strict=True)
    assert "Exchange" not in _plan(j)
    with pytest.raises(Exception, match="differ in length"):
        j.collect()
    for bad in (dict(keys=[]), dict(keys=["p"], buckets=0), dict(keys=["p"], buckets=10**6)):
        with pytest.raises(ValueError):
            write_bucketed(p, name="x", **bad)


def test_a_bucket_is_one_file(spark, tmp_path):
    import os
    write_bucketed(spark.range(1000), ["id"], "ids", 5, f"{tmp_path}/t")
    assert len([f for f in os.listdir(tmp_path / "t") if f.endswith(".parquet")]) == 5


# ---------------------------------------------------------------- split source


def test_split_syntax():
    assert parse_split("train[:5%]+test") == [("train", None, "5%"), ("test", None, None)]
    n = 1010
    data = list(range(n))
    for a, b, want in ((None, None, data), (None, "5%", data[:50]), ("10", "20", data[10:20]), ("-10%", None, data[-101:]), ("-5", "-2", data[-5:-2]),
                       ("20", "10", []), ("99%", "200%", data[1000:]), ("5000", None, []), ("0.5%", "1%", data[5:10])):
        low, high = row_range(a, b, n)
        assert data[low:high] == want, (a, b)
    assert row_range(None, "50%", 5)[1] == 2 and row_range(None, "50%", 7)[1] == 4  # halves to the even row
    for bad in ("train[", "train[1]", "[:3]", "train[a:b]", ""):
        with pytest.raises(ValueError):
            parse_split(bad)


@pytest.fixture(scope="module")
def table(tmp_path_factory):
    """Two files with five row groups, a null here and there."""
    path = tmp_path_factory.mktemp("split")
    data = [(i, f"t{i}", None if i % 7 == 0 else i / 2) for i in range(100)]
    for k, rows in enumerate((data[:60], data[60:])):
        t = pa.table({"id": [r[0] for r in rows], "text": [r[1] for r in rows], "score": pa.array([r[2] for r in rows], pa.float64())})
        pq.write_table(t, path / f"part-{k}.parquet", row_group_size=25)
    (path / "_SUCCESS").touch()
    return str(path), data


def test_slices_of_a_table_in_many_row_groups(spark, table):
    path, data = table
    for split, want in (("train", data), ("train[:5%]", data[:5]), ("train[20:70]", data[20:70]), ("train[-10:]+train[:3]", data[-10:] + data[:3]), ("train[50:50]", [])):
        got = [tuple(r) for r in read_split(spark, path, split).collect()]
        assert sorted(got, key=str) == sorted(want, key=str), split
    df = read_split(spark, path, "train[20:70]", ["score", "id"])
    assert df.columns == ["score", "id"] and df.rdd.getNumPartitions() == 4
    with pytest.raises(Exception, match="no split"):
        read_split(spark, path, "test[:3]").collect()


def test_filters_reach_the_source(spark, table):
    path, data = table
    cases = [(F.col("id") >= 90, lambda r: r[0] >= 90), (F.col("score").isNull(), lambda r: r[2] is None), (F.col("text") == "t33", lambda r: r[1] == "t33"),
             (F.col("id").isin(3, 40, 99) & (F.col("score") < 45), lambda r: r[0] in (3, 40, 99) and r[2] is not None and r[2] < 45),
             ((F.col("id") > 10) & (F.length("text") == 2), lambda r: False), ((F.col("id") < 5) | (F.col("id") == 50), lambda r: r[0] < 5 or r[0] == 50)]
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled", None)
    try:
        for on in ("true", "false"):
            spark.conf.set("spark.sql.python.filterPushdown.enabled", on)
            for cond, want in cases:
                df = read_split(spark, path, "train[2:98]").filter(cond)
                assert sorted(map(tuple, df.collect())) == sorted(r for r in data[2:98] if want(r)), (on, cond)
            narrow = read_split(spark, path, "train").filter("id >= 90")
            assert narrow.rdd.getNumPartitions() == (1 if on == "true" else 5)  # statistics rule the other row groups out
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled") if before is None else spark.conf.set("spark.sql.python.filterPushdown.enabled", before)


def test_named_splits(spark, tmp_path):
    for name, ids in (("train-00", [1, 2]), ("train-01", [3]), ("test", [9])):
        pq.write_table(pa.table({"id": ids}), tmp_path / f"{name}.parquet")
    assert sorted(r.id for r in read_split(spark, str(tmp_path), "train").collect()) == [1, 2, 3]
    assert [r.id for r in read_split(spark, str(tmp_path), "test[:1]+train[2:]").collect()] in ([9, 3], [3, 9])


def test_the_same_rows_as_by_key(spark):
    from rewardlens.sources.tables import split_head
    path = f"{SF_SMALL}/orders.parquet"
    by_key = split_head(spark.read.parquet(path).select("o_orderkey", "o_totalprice"), "o_orderkey", 5).collect()
    assert sorted(by_key) == sorted(read_split(spark, path, "train[:5%]", ["o_orderkey", "o_totalprice"]).collect()) and by_key
    assert duckdb.sql(f"SELECT count(*) FROM (SELECT o_orderkey, lag(o_orderkey) OVER () AS b FROM '{path}') WHERE b > o_orderkey").fetchall() == [(0,)]


# ---------------------------------------------------------------- table functions


def test_the_schema_follows_the_table(spark):
    register_table_functions(spark)
    rows = [(1, [("user", "q")], "yes", "no", 0.5), (2, None, None, "n", None)]
    spark.createDataFrame(rows, "id long, prompt array<struct<role: string, content: string>>, chosen string, rejected string, w double").createOrReplaceTempView("prefs")
    got = spark.sql("SELECT * FROM unpair_rows(TABLE(prefs))")
    assert got.schema.simpleString() == "struct<id:bigint,prompt:array<struct<role:string,content:string>>,w:double,completion:string,label:boolean>"
    assert sorted([(r.id, r.completion, r.label, r.w) for r in got.collect()], key=str) == sorted([(1, "yes", True, 0.5), (1, "no", False, 0.5), (2, None, True, None), (2, "n", False, None)], key=str)
    nested = spark.sql("SELECT * FROM unpair_rows(TABLE(SELECT id, array(chosen) AS chosen, array(rejected) AS rejected FROM prefs))")
    assert nested.schema["completion"].dataType.simpleString() == "array<string>" and nested.count() == 4
    for bad, why in (("TABLE(SELECT id FROM prefs)", "chosen and rejected"), ("TABLE(SELECT chosen, 1 AS rejected FROM prefs)", "different types"), ("TABLE(SELECT chosen, rejected, 1 AS label FROM prefs)", "already"), ("1", "table")):
        with pytest.raises(Exception, match=why):
            spark.sql(f"SELECT * FROM unpair_rows({bad})").collect()


def test_lateral_formatting(spark):
    register_table_functions(spark)
    spark.createDataFrame([(1, "a", 2.5), (2, None, None)], "id long, x string, y double").createOrReplaceTempView("fmt")
    got = spark.sql("SELECT t.id, f.text FROM fmt t, LATERAL format_row(template => '{x}:{y} {{}} {x}', x => t.x, y => t.y) f").collect()
    assert sorted(map(tuple, got)) == [(1, "a:2.5 {} a"), (2, ": {} ")]
    with pytest.raises(Exception, match="no argument"):
        spark.sql("SELECT * FROM fmt t, LATERAL format_row(template => '{z}', x => t.x) f").collect()


def test_buckets_follow_the_rows():
    from rewardlens.sources.bucketed import MOST_BUCKETS, ROWS_A_BUCKET, buckets_for
    assert buckets_for(0) == buckets_for(1000) == 8 and buckets_for(10 ** 12) == MOST_BUCKETS
    for rows in (10 ** 7, 10 ** 8, 648 * 10 ** 6):
        assert rows / buckets_for(rows) <= ROWS_A_BUCKET < rows / (buckets_for(rows) - 1)


def test_a_place_of_the_sampler_is_computed_once(spark):
    df = PM.sampler_index(spark, 23, 2, 4, 3, seed=9)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Range (0, 20" in plan and plan.index("Generate") < plan.index("aggregate(") and plan.count("Generate") == 1
    assert PM.sampler_index(spark, 23, 0, 4, 3).count() == PM.sampler_index(spark, 3, 2, 4, 3).count() == 0


def test_rewards_are_joined_by_one_exchange(spark):
    rows = [(1, "a", 1.0), (1, "b", None), (2, "a", 3.0), (None, "b", 4.0), (3, "other", 5.0), (2, "a", 3.0)]
    wide = R.join_rewards_long(spark.createDataFrame(rows, "s long, func string, reward double").repartition(3), ["s"], ["a", "b"])
    assert _plan(wide).count("Exchange hashpartitioning") == 1
    assert sorted([tuple(r) for r in wide.collect()], key=str) == sorted([(1, 1.0, None), (2, 3.0, None), (None, None, 4.0), (3, None, None)], key=str)
