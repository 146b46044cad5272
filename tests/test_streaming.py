"""Stream forms equal batch forms: state across micro-batches, batches cut in pieces, restarts, replays, late rows."""

import datetime
import json
import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from rewardlens.operators import pack as P
from rewardlens.operators import rewards as R
from rewardlens.operators import stats as ST
from rewardlens.streaming import jobs as J

SCHEMA = "batch_id int, ts timestamp, event_id long, prompt string, reward double"
START = datetime.datetime(2024, 1, 1)
FAR = 10_000_000


def reward_rows(batches=30, per=23, seed=2):
    """Rows of 30 batches over few prompts (one hot, one null), some without a reward, large values next to their spread."""
    rng = random.Random(seed)
    out = []
    for b in range(batches):
        for _ in range(per):
            n = len(out)
            out.append((b, START + datetime.timedelta(seconds=n * 60), n, rng.choice(["hot", "hot", "hot", "a", "b", None, f"rare{rng.randint(0, 40)}"]),
                        None if rng.random() < 0.05 else 1e6 + rng.random()))
    return out


class Feed:
    """A folder of files, each a micro-batch."""

    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema = spark, str(path), schema
        spark.createDataFrame([], schema).write.parquet(self.path)

    def add(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.path)

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(self.path)


def done(q):
    q.awaitTermination()
    assert q.exception() is None


def beat(b=FAR):
    return [(b, None, None, None, None)]


def close(a, b):
    return a is b or (a is not None and b is not None and abs(a - b) < 1e-6)


def test_moments_and_tracker_over_thirty_micro_batches_with_a_restart(spark, tmp_path):
    """The cuts between micro-batches fall inside reward batches; half of the files come after a stop."""
    rows = reward_rows()
    feed = Feed(spark, tmp_path / "src", SCHEMA)
    step = len(rows) // 30 + 1
    files = [rows[i:i + step] for i in range(0, len(rows), step)]

    def run():
        done(J.run_running_moments(feed.stream(), "reward", "batch_id", f"{tmp_path}/rm", f"{tmp_path}/rm-ck"))
        done(J.run_prompt_tracker(feed.stream(), "prompt", "reward", "batch_id", ["ts", "event_id"], f"{tmp_path}/pt", f"{tmp_path}/pt-ck", 8))
        done(J.run_batch_moments(feed.stream(), "reward", "batch_id", f"{tmp_path}/bm", f"{tmp_path}/bm-ck"))

    for part in files[:15]:
        feed.add(part)
    run()
    early = spark.read.parquet(f"{tmp_path}/rm").count()
    assert 5 < early < 30
    for part in files[15:]:
        feed.add(part)
    feed.add(beat())
    run()

    table = spark.createDataFrame(rows, SCHEMA)
    got = {r.batch_id: r for r in spark.read.parquet(f"{tmp_path}/rm").collect()}
    want = {r.batch_id: r for r in ST.running_moments(table, "reward", "batch_id").collect()}
    assert got.keys() == want.keys() and len(got) == 30
    for b, w in want.items():
        assert all(close(got[b][c], w[c]) for c in ("batch_mean", "batch_std", "mean", "var", "std", "count")), (b, got[b], w)

    scored = table.filter("reward is not null")
    adv = J.tracker_advantages(scored, spark.read.parquet(f"{tmp_path}/pt"), spark.read.parquet(f"{tmp_path}/bm"), "prompt", "reward", "batch_id", 3)
    got = {r.event_id: (r.cold, r.advantage) for r in adv.collect()}
    want = {r.event_id: (r.cold, r.advantage) for r in ST.prompt_tracker(scored, "prompt", "reward", "batch_id", ["ts", "event_id"], 8, 3).collect()}
    assert got.keys() == want.keys()
    assert all(got[e][0] == w[0] and abs(got[e][1] - w[1]) < 1e-4 for e, w in want.items())


def test_a_replayed_micro_batch_changes_nothing(spark, tmp_path):
    """The last commit is taken back, so the engine runs that micro-batch again on the same state."""
    rows = reward_rows(6)
    feed = Feed(spark, tmp_path / "src", SCHEMA)
    for part in (rows[:40], rows[40:90], rows[90:], beat()):
        feed.add(part)

    def run():
        done(J.run_running_moments(feed.stream(), "reward", "batch_id", f"{tmp_path}/rm", f"{tmp_path}/rm-ck"))

    run()
    before = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/rm").collect()))
    commits = sorted((int(x) for x in os.listdir(tmp_path / "rm-ck/commits") if x.isdigit()))
    for name in (str(commits[-1]), f".{commits[-1]}.crc"):
        if os.path.exists(tmp_path / "rm-ck/commits" / name):
            shutil.copy(tmp_path / "rm-ck/commits" / name, tmp_path / f"taken-{name}")
            os.unlink(tmp_path / "rm-ck/commits" / name)
    run()
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/rm").collect())) == before and len(before) == 6


def test_late_rows_are_left_out(spark, tmp_path):
    rows = reward_rows(8, 10)
    late = [(2, START, 9001, "hot", 5e6), (3, START, 9002, "a", 5e6)]
    feed = Feed(spark, tmp_path / "src", SCHEMA)
    for part in (rows[:45], rows[45:], late, beat()):
        feed.add(part)
    for lateness, want_rows in ((0, rows), (9, rows + late)):
        out = f"{tmp_path}/rm{lateness}"
        done(J.run_running_moments(feed.stream(), "reward", "batch_id", out, f"{out}-ck", lateness=lateness))
        done(J.run_prompt_tracker(feed.stream(), "prompt", "reward", "batch_id", ["ts", "event_id"], f"{out}-pt", f"{out}-pt-ck", 8, lateness=lateness))
        table = spark.createDataFrame(want_rows, SCHEMA)
        got = {r.batch_id: r["mean"] for r in spark.read.parquet(out).collect()}
        want = {r.batch_id: r["mean"] for r in ST.running_moments(table, "reward", "batch_id").collect()}
        assert got.keys() == want.keys() and all(close(got[b], want[b]) for b in want)
        last = {(r.prompt, r.batch_id): r["mean"] for r in spark.read.parquet(f"{out}-pt").collect()}
        stats = {r.prompt: r["mean"] for r in ST.prompt_stats(table.filter("reward is not null"), "prompt", "reward", ["batch_id", "ts", "event_id"], 8).collect()}
        for p, m in stats.items():
            newest = max(b for q, b in last if q == p)
            assert close(last[p, newest], m), (lateness, p)


def test_merged_moments_are_those_of_all_values():
    rng = random.Random(1)
    for _ in range(200):
        xs = [[1e9 + rng.random() for _ in range(rng.randint(0, 9))] for _ in range(4)]
        total = (0.0, 0.0, 0.0)
        for x in xs:
            n = len(x)
            m = sum(x) / n if n else 0.0
            total = J.merge_moments(total, (n, m, sum((v - m) ** 2 for v in x))) if total[0] else (float(n), m, sum((v - m) ** 2 for v in x))
        flat = sum(xs, [])
        if flat:
            mean = sum(flat) / len(flat)
            assert total[0] == len(flat) and abs(total[1] - mean) < 1e-6 and abs(total[2] - sum((v - mean) ** 2 for v in flat)) < 1e-3


def test_a_log_step_cut_over_three_micro_batches(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice(["train", "eval"]), s, rng.choice(["loss", "kl", None]), rng.random()) for s in range(12) for _ in range(9)]
    schema = "mode string, step long, key string, value double"
    feed = Feed(spark, tmp_path / "src", schema)
    for k in range(3):
        feed.add(rows[k::3])
    feed.add([(None, FAR, None, None)])
    done(J.run_metric_average(feed.stream(), f"{tmp_path}/out", f"{tmp_path}/ck", step="step", lateness=12))
    got = {(r.mode, r.step, r.key): r.value for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {(r.mode, r.step, r.key): r.value for r in R.metric_average(spark.createDataFrame(rows, schema), step="step").collect()}
    assert got.keys() == want.keys() and all(close(got[k], v) for k, v in want.items())


@pytest.mark.parametrize("cuts", [1, 4, 11])
def test_pieces_do_not_depend_on_micro_batches(spark, tmp_path, cuts):
    rng = random.Random(9)
    rows = [(i, i % 3 if i % 2 else 0, None if i == 7 else [rng.randint(0, 99) for _ in range(rng.choice([0, 1, 5, 40]))]) for i in range(60)]
    schema = "doc_id long, lane int, ids array<int>"
    feed = Feed(spark, tmp_path / "src", schema)
    size = -(-len(rows) // cuts)
    parts = [rows[i:i + size] for i in range(0, len(rows), size)]

    def run():
        done(J.run_pack_constant_length(feed.stream(), "lane", "ids", ["doc_id"], f"{tmp_path}/out", f"{tmp_path}/ck", 16, 7))

    for part in parts[:cuts // 2]:
        feed.add(part)
    run()
    for part in parts[cuts // 2:]:
        feed.add(part)
    run()
    got = {(r.lane, r.piece_id): r.input_ids for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    table = spark.createDataFrame([r for r in rows if r[2] is not None], schema)
    want = {(r.lane, r.piece_id): r.input_ids for r in P.pack_constant_length(table, "ids", ["doc_id"], 16, 7, group_cols=["lane"]).collect()}
    assert got == want and len(got) > 20


def test_prompts_share_the_trackers_state(spark, tmp_path):
    """300 prompts are a state of 4 buckets; numbers beyond 2^53 and none stay what they are."""
    feed = Feed(spark, f"{tmp_path}/src", SCHEMA.replace("prompt string", "prompt long"))
    big = (1 << 60) + 1
    rows = [(b, START, 1000 * b + i, big + i if i else None, float(i + b)) for b in range(3) for i in range(300)]
    feed.add(rows[:450])
    feed.add(rows[450:])
    feed.add(beat())
    q = J.run_prompt_tracker(feed.stream(), "prompt", "reward", "batch_id", ["ts", "event_id"], f"{tmp_path}/out", f"{tmp_path}/ck", 2, buckets=4)
    done(q)
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in map(lambda p: json.loads(p.json), q.recentProgress)) <= 5  # a heartbeat's bucket too
    got = {(r.prompt, r.batch_id): (r.len, r.mean) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {(big + i if i else None, b): (min(b + 1, 2), i + b - (0.5 if b else 0)) for b in range(3) for i in range(300)}


def test_state_is_the_engines(spark, tmp_path):
    """No table of epochs is kept beside the stream: the sink and the checkpoint are all there is."""
    feed = Feed(spark, tmp_path / "src", SCHEMA)
    feed.add(reward_rows(3))
    done(J.run_prompt_tracker(feed.stream(), "prompt", "reward", "batch_id", ["ts", "event_id"], f"{tmp_path}/out", f"{tmp_path}/ck", 8))
    assert sorted(os.listdir(tmp_path)) == ["ck", "out", "src"]
    with open(next((tmp_path / "ck/offsets").glob("[0-9]*"))) as f:
        assert json.loads(f.read().splitlines()[1])["conf"]["spark.sql.streaming.stateStore.providerClass"]


def test_turns_follow_the_tokens(spark):
    from pyspark.sql import functions as F
    from rewardlens.plans.q_streaming import LANES, MICRO_BATCHES, doc_turns
    t = spark.range(0, 4000, 4).withColumnRenamed("id", "doc_id")
    assert len(doc_turns(t, 1000)) == MICRO_BATCHES
    turns = doc_turns(t, LANES * 100 * 20, turn_tokens=100)
    assert len(turns) == 20
    held = [t.filter(c).agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first() for c in turns]
    assert sum(h[2] for h in held) == 1000 and max(h[2] for h in held) <= 60
    assert all(a[1] < b[0] for a, b in zip(held, held[1:]))


def test_pieces_leave_in_frames(spark, tmp_path):
    """More tokens than a frame holds, in a lane's one micro-batch."""
    from pyspark.sql import functions as F
    from rewardlens.streaming import jobs as J
    n, size = 60, 40_000
    rows = spark.range(n).select(F.lit(0).alias("lane"), F.col("id").alias("k"), F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (i + F.col("id") * size).cast("int")).alias("ids"))
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    J.run_pack_constant_length(stream, "lane", "ids", ["k"], f"{tmp_path}/out", f"{tmp_path}/ck", 1000, None).awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").select("piece_id", F.get("input_ids", 0).alias("a"), F.get("input_ids", 999).alias("b"), F.size("labels").alias("n")).orderBy("piece_id").collect()
    assert n * size > J.FRAME_TOKENS and [tuple(r) for r in got] == [(i, 1000 * i, 1000 * i + 999, 1000) for i in range(n * size // 1000)]
