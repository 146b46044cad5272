"""Plan checks: pruned scans, no single-partition exchange over row data, few scans and exchanges."""

from pyspark.sql import functions as F

from rewardlens.operators import pack as P
from rewardlens.operators import rewards as R
from rewardlens.operators import tokens as T
from rewardlens.plans import fixtures as V
from rewardlens.plans import q_tokens as Q
from rewardlens.plans.ordinal import SHUFFLE_CLEANUP, written
from rewardlens.plans.topk import top_k_per_key
from rewardlens.sources.tables import read_table
from tests.conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_group_advantage_plan(spark):
    r = R.weighted_reward(V.rollouts(spark, SF_SMALL), list(V.ROLLOUT_REWARDS), V.ROLLOUT_WEIGHTS)
    p = _plan(R.group_advantage(r, "group_id", "reward"))
    assert "SinglePartition" not in p
    assert "l_returnflag" not in p.split("ReadSchema")[1].split("\n")[0]  # unused columns pruned
    assert "Window" not in p  # aggregate + join, not a window over a whole group
    assert "PythonUDF" not in p and "ArrowEvalPython" not in p


def test_top_k_limits_before_the_shuffle(spark):
    p = _plan(top_k_per_key(read_table(spark, SF_SMALL, "events"), ["user_id"], ["ts", "event_id"], 5))
    assert p.count("WindowGroupLimit") == 2 and p.count("Exchange") == 1


def test_encode_reads_the_texts_once(spark):
    p = _plan(Q.token_ids(spark, SF_SMALL))
    # the texts alone: the vocabulary goes to the tasks, and no word is a row
    assert p.count("FileScan parquet") == 1 and "Generate" not in p and "Join" not in p


def test_packing_sends_each_token_once(spark):
    t = Q.token_table(spark, SF_SMALL)
    p = _plan(P.pack_constant_length(t, "ids", ["doc_id"], 64, 5))
    assert p.count("Generate explode(token") == 0 and p.count("FileScan parquet") <= 5


def test_collator_plans_read_written_sequences(spark):
    p = _plan(Q.q_collate_preference(spark, SF_SMALL))
    assert "Generate" not in p and p.count("FileScan parquet") <= 2


def test_padding_is_a_partial_aggregate_and_a_join(spark):
    t = Q.token_table(spark, SF_SMALL)
    p = _plan(T.pad_batch(t, {"ids": (0, "right")}))
    assert "partial_max" in p and "Window" not in p and "Python" not in p


def _shuffle_files(spark):
    return spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").count("/shuffle_")


def test_flush_left_shuffles_rows_once_at_a_time(spark):
    rows = [(i, i // 8, [j + 1 for j in range(1 + i % 7)]) for i in range(4000)]
    t = written(spark.createDataFrame(rows, "doc_id long, batch_id long, ids array<int>"), "flush-rows")
    p = T.pad_batch(t, {"ids": (-1, "left")}, "batch_id")
    p = p.withColumn("mask", F.transform("ids", lambda x: (x != -1).cast("int")))
    before = _shuffle_files(spark)
    out = T.flush_left(p, "mask", ["ids"], "batch_id")
    assert _shuffle_files(spark) <= before  # nothing is left of the shuffle for the cuts
    plan = _plan(out)
    assert "collect_list" not in plan and "Generate" not in plan  # and the result does not shuffle for them again
    widths = {b: max(len(r[2]) for r in rows if r[1] == b) for b in {r[1] for r in rows}}
    got = {r.doc_id: (list(r.ids), list(r.mask)) for r in out.collect()}
    fill = {i: widths[b] - len(ids) for i, b, ids in rows}
    assert got == {i: (ids + [-1] * fill[i], [1] * len(ids) + [0] * fill[i]) for i, b, ids in rows}


def test_a_written_table_leaves_no_shuffle_files(spark):
    spark.conf.set(SHUFFLE_CLEANUP, "false")
    before = _shuffle_files(spark)
    t = written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    assert _shuffle_files(spark) <= before and spark.conf.get(SHUFFLE_CLEANUP) == "false"
    assert sorted(map(tuple, t.collect())) == [(k, 1000 // 7 + (k < 1000 % 7)) for k in range(7)]


def test_filters_reach_the_scan(spark):
    p = _plan(read_table(spark, SF_SMALL, "orders", ["o_orderkey", "o_totalprice"]).filter(F.col("o_orderkey") < 100))
    assert "PushedFilters: [IsNotNull(o_orderkey), LessThan(o_orderkey,100)]" in p and "o_custkey" not in p
