"""Sampling, shuffling and generation-expansion queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rewardlens.functions.common import round6
from rewardlens.operators import permute as PM
from rewardlens.operators import sample as SM
from rewardlens.plans import fixtures as V
from rewardlens.plans.catalog import query
from rewardlens.sources.tables import read_table

SEED = 42
DRAW = f"('0x' || substr(md5('{SEED}:' || CAST(o_orderkey AS VARCHAR)), 1, 15))::BIGINT"
PK = f"{DRAW}, o_orderkey"


def _sql_sampler(mini: int, B: int, rep: int) -> str:
    return f"""
WITH o AS (SELECT o_orderkey AS key, row_number() OVER (ORDER BY {PK}) - 1 AS ord FROM orders),
n AS (SELECT count(*) AS n FROM orders),
c AS (SELECT key, ord, ord // {B} AS chunk FROM o, n WHERE ord // {B} < n.n // {B})
SELECT CAST(chunk * {rep * B * mini} + r * {B * mini} + (ord % {B}) * {mini} + m AS BIGINT) AS position, key AS o_orderkey
FROM c, range({rep}) a(r), range({mini}) b(m)"""


def _orders(spark, sf):
    return read_table(spark, sf, "orders", ["o_orderkey"])


@query("repeat_sampler", _sql_sampler(4, 3, 2))
def q_repeat_sampler(spark, sf):
    return SM.repeat_sampler(_orders(spark, sf), "o_orderkey", mini_repeat_count=4, batch_size=3, repeat_count=2, seed=SEED)


@query("sampler_train", _sql_sampler(4, 4 * 1 * 16 // 4, 1))
def q_sampler_train(spark, sf):
    return SM.sampler_train(_orders(spark, sf), "o_orderkey", per_device_batch_size=4, num_processes=1, grad_accum=16,
                            num_generations=4, num_iterations=1, seed=SEED)


@query("sampler_eval", _sql_sampler(4, 1, 1))
def q_sampler_eval(spark, sf):
    return SM.sampler_eval(_orders(spark, sf), "o_orderkey", num_generations=4, seed=SEED)


@query("shuffle_rows", f"SELECT o_orderkey, row_number() OVER (ORDER BY {PK}) - 1 AS ordinal FROM orders")
def q_shuffle_rows(spark, sf):
    return SM.shuffle_rows(_orders(spark, sf), "o_orderkey", SEED)


@query("random_score", f"SELECT o_orderkey, round(CAST({DRAW} AS DOUBLE) / {float(1 << SM.DIGEST_BITS)!r}, 6) AS score FROM orders")
def q_random_score(spark, sf):
    o = _orders(spark, sf)
    return o.select("o_orderkey", round6(SM.random_score("o_orderkey", SEED)).alias("score"))


@query("expand_generations", f"""
WITH f AS (SELECT prompt, min(ts) AS ts, arg_min(event_id, (ts, event_id)) AS event_id FROM ({V.SQL_BATCHES}) GROUP BY prompt),
r AS (SELECT prompt, row_number() OVER (ORDER BY ts, event_id) - 1 AS prompt_rank FROM f)
SELECT prompt_rank, prompt, g AS generation FROM r, range(4) t(g)""")
def q_expand_generations(spark, sf):
    e = SM.expand_generations(V.batches(spark, sf), "prompt", ["ts", "event_id"], 4)
    return e.select("prompt_rank", "prompt", F.col("generation").cast("long").alias("generation"))


MU, ACCUM = 2, 4


@query("reuse_schedule", f"""
WITH s AS (SELECT event_id AS step, ((event_id // {ACCUM}) - (event_id // {ACCUM}) % {MU}) * {ACCUM} + event_id % {ACCUM} AS source_step FROM events),
g AS (SELECT event_id AS step, value FROM events WHERE (event_id // {ACCUM}) % {MU} = 0)
SELECT s.step, s.source_step, g.value FROM s JOIN g ON s.source_step = g.step""")
def q_reuse_schedule(spark, sf):
    ev = read_table(spark, sf, "events", ["event_id", "value"])
    steps = ev.select(F.col("event_id").alias("step"))
    # completions are generated on micro-steps whose optimiser step is a multiple of num_iterations
    gen = ev.filter(((F.col("event_id") / ACCUM).cast("long") % MU) == 0).select(F.col("event_id").alias("step"), "value")
    r = SM.reuse_schedule(steps, gen, "step", MU, ACCUM)
    return r.select("step", "source_step", "value")


# ---------------------------------------------------------------- orders by arithmetic


def _sql_permuted(table: str, key: str, back: bool = False) -> str:
    """``(key, ord, place)``: the walk of every ordinal through the network, step by step."""
    steps = 2 * PM.ROUNDS
    h = f"('0x' || substr(md5('{SEED}:' || j || ':' || CASE WHEN j % 2 = 1 THEN r ELSE l END), 1, 15))::BIGINT"
    sign = "-" if back else "+"
    first, last, on = (steps, 0, -1) if back else (1, steps + 1, 1)
    return f"""
WITH RECURSIVE src AS (SELECT {key}, row_number() OVER (ORDER BY {key}) - 1 AS ord FROM ({table})),
c AS (SELECT count(*) AS n, greatest(CAST(ceil(sqrt(count(*))) AS BIGINT), 1) AS side FROM src),
d AS (SELECT any_value(n) AS n, arg_min(a, ((-n % a) + a) % a * 100000000 + a) AS a FROM c, range(0, {PM.TRIED} + 1) t(k), LATERAL (SELECT side + k AS a) s
      WHERE a <= least(side + {PM.TRIED}, 2 * side)),
e AS (SELECT n, a, greatest((n + a - 1) // a, 1) AS b FROM d),
walk AS (
  SELECT ord, n, a, b, ord % a AS l, ord // a AS r, {first} AS j FROM src, e
  UNION ALL
  SELECT ord, n, a, b,
         CASE WHEN j % 2 = 1 THEN ((l {sign} {h} % a) + a) % a ELSE l END,
         CASE WHEN j % 2 = 1 THEN r ELSE ((r {sign} {h} % b) + b) % b END, j + {on}
  FROM (SELECT ord, n, a, b, l, r, CASE WHEN j = {last} THEN {first} ELSE j END AS j FROM walk WHERE j <> {last} OR l + r * a >= n)),
p AS (SELECT ord, l + r * a AS place FROM walk WHERE j = {last} AND l + r * a < n)
SELECT {key}, ord, place, (SELECT n FROM e) AS n FROM p JOIN src USING (ord)"""


_SQL_ORDERS = _sql_permuted("SELECT o_orderkey FROM orders", "o_orderkey")


@query("shuffle_rows_permuted", f"SELECT o_orderkey, place AS ordinal FROM ({_SQL_ORDERS})")
def q_shuffle_rows_permuted(spark, sf):
    return PM.shuffle_rows(_orders(spark, sf), "o_orderkey", SEED)


@query("repeat_sampler_permuted", f"""
SELECT CAST(place // 3 * 24 + t.r * 12 + (place % 3) * 4 + m AS BIGINT) AS position, o_orderkey
FROM ({_SQL_ORDERS}) o, range(2) t(r), range(4) u(m) WHERE place // 3 < n // 3""")
def q_repeat_sampler_permuted(spark, sf):
    return PM.repeat_sampler(_orders(spark, sf), "o_orderkey", mini_repeat_count=4, batch_size=3, repeat_count=2, seed=SEED)


@query("sampler_index_permuted", f"""
SELECT CAST(ord // 3 * 24 + t.r * 12 + (ord % 3) * 4 + m AS BIGINT) AS position, place AS index
FROM ({_sql_permuted("SELECT o_orderkey FROM orders", "o_orderkey", back=True)}) o, range(2) t(r), range(4) u(m) WHERE ord // 3 < n // 3""")
def q_sampler_index_permuted(spark, sf):
    n = _orders(spark, sf).count()  # from the file's row counts
    return PM.sampler_index(spark, n, mini_repeat_count=4, batch_size=3, repeat_count=2, seed=SEED)


@query("expand_generations_permuted", f"""
SELECT place AS prompt_rank, prompt, g AS generation FROM ({_sql_permuted(f"SELECT DISTINCT prompt FROM ({V.SQL_BATCHES})", "prompt")}), range(4) t(g)""")
def q_expand_generations_permuted(spark, sf):
    e = PM.expand_generations(V.batches(spark, sf), "prompt", 4, SEED)
    return e.select("prompt_rank", "prompt", F.col("generation").cast("long").alias("generation"))
