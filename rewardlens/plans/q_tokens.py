"""Token-table queries: vocabulary, array operators, collators, packing.

Array outputs are reported as ``(size, digest)`` where digest is
sum((i + 1) * (x + 128)) over positions -- order-sensitive, exact in
integers, and computable the same way in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rewardlens.functions import arrays as A
from rewardlens.functions import matching as M
from rewardlens.operators import pack as P
from rewardlens.operators import tokens as T
from rewardlens.plans import fixtures as V
from rewardlens.plans import sqltext as S
from rewardlens.plans.catalog import query
from rewardlens.plans.ordinal import written
from rewardlens.sources.tables import read_table

# Fixed query parameters (token ids are vocabulary ranks of the documents corpus).
BOS, EOS, PAD = 1, 5, -1
SPECIAL = [BOS, EOS]
RESPONSE_TPL = [0, 0]
INSTRUCTION_TPL = [4]
BATCH = 8
CONTEXT = 16
PACK_LEN = 256


def digest(arr) -> F.Column:
    a = F.col(arr) if isinstance(arr, str) else arr
    return F.aggregate(F.transform(a, lambda x, i: (i.cast("long") + 1) * (x.cast("long") + 128)), F.lit(0).cast("long"), lambda s, v: s + v)


def sdig(col: str) -> str:
    return f"CAST(coalesce(list_sum(list_transform({col}, lambda x, i: CAST(i AS BIGINT) * (CAST(x AS BIGINT) + 128))), 0) AS BIGINT)"


SQL_IDS = f"""
SELECT doc_id, coalesce(ids, CAST([] AS INTEGER[])) AS ids FROM documents LEFT JOIN (
  SELECT w.doc_id, list(CAST(v.token_id AS INTEGER) ORDER BY w.pos) AS ids
  FROM ({V.SQL_WORDS}) w JOIN ({V.SQL_VOCAB}) v USING (token) GROUP BY w.doc_id) USING (doc_id)"""


_VOCABULARIES: dict[tuple[str, str], object] = {}


def doc_vocab(spark, sf):
    """The vocabulary of ``documents``, built and written once in a session."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _VOCABULARIES:
        _VOCABULARIES[key] = written(T.build_vocab(V.words(spark, sf)), "vocabulary")
    return _VOCABULARIES[key]


def token_ids(spark, sf):
    ids = T.encode_texts(V.documents(spark, sf), "doc_id", "text", doc_vocab(spark, sf))
    return ids.select("doc_id", F.col("input_ids").alias("ids"), (F.col("doc_id") / BATCH).cast("long").alias("batch_id"))


def token_table(spark, sf):
    """The same, written once, for queries that read the sequences more than once."""
    return written(token_ids(spark, sf), "token-ids")


def _out(df, cols, keys=("doc_id",)):
    return df.select(*keys, *[x for c in cols for x in (F.size(c).cast("long").alias(f"{c}_size"), digest(c).alias(f"{c}_digest"))])


def _sout(cols, keys="doc_id") -> str:
    return ", ".join([keys] + [f"len({c}) AS {c}_size, {sdig(c)} AS {c}_digest" for c in cols])


@query("build_vocab", f"SELECT token, n, token_id FROM ({V.SQL_VOCAB})")
def q_build_vocab(spark, sf):
    return T.build_vocab(V.words(spark, sf)).select("token", "n", "token_id")


@query("encode_tokens", f"SELECT {_sout(['ids'])} FROM ({SQL_IDS})")
def q_encode_tokens(spark, sf):
    return _out(token_ids(spark, sf), ["ids"])


@query("encode_fixed", f"""
SELECT {_sout(['input_ids', 'attention_mask'])} FROM (
  SELECT doc_id, list_concat(ids[1:128], list_transform(range(128 - len(ids[1:128])), lambda x: 0)) AS input_ids,
         list_concat(list_transform(ids[1:128], lambda x: 1), list_transform(range(128 - len(ids[1:128])), lambda x: 0)) AS attention_mask
  FROM ({SQL_IDS}))""")
def q_encode_fixed(spark, sf):
    return _out(T.encode_fixed(token_ids(spark, sf), "ids", 128, 0), ["input_ids", "attention_mask"])


@query("decode_tokens", f"""
SELECT doc_id, coalesce(t, '') AS text FROM documents LEFT JOIN (
  SELECT w.doc_id, string_agg(w.token, ' ' ORDER BY w.pos) AS t
  FROM ({V.SQL_WORDS}) w JOIN ({V.SQL_VOCAB}) v USING (token) WHERE v.token_id NOT IN ({BOS}, {EOS}) GROUP BY w.doc_id) USING (doc_id)""")
def q_decode_tokens(spark, sf):
    vocab = doc_vocab(spark, sf)
    ids = written(T.encode_texts(V.documents(spark, sf), "doc_id", "text", vocab), "token-ids")
    return T.decode(ids, vocab, "doc_id", "input_ids", SPECIAL)


def _sql_first(col: str, v: int) -> str:
    return f"(CASE WHEN list_position({col}, {v}) IS NULL OR list_position({col}, {v}) = 0 THEN len({col}) ELSE list_position({col}, {v}) - 1 END)"


@query("first_true_index", f"SELECT doc_id, CAST({_sql_first('ids', EOS)} AS BIGINT) AS idx FROM ({SQL_IDS})")
def q_first_true_index(spark, sf):
    return token_ids(spark, sf).select("doc_id", A.first_true_index("ids", EOS).cast("long").alias("idx"))


SQL_TRUNC = f"""
SELECT doc_id, ids, {_sql_first('ids', EOS)} AS k FROM ({SQL_IDS})"""


@query("truncate_response", f"""
SELECT {_sout(['ids'])} FROM (SELECT doc_id, list_transform(ids, lambda x, i: CASE WHEN i - 1 > k THEN {PAD} ELSE x END) AS ids FROM ({SQL_TRUNC}))""")
def q_truncate_response(spark, sf):
    t = token_ids(spark, sf)
    return _out(t.withColumn("ids", A.truncate_response("ids", EOS, PAD)), ["ids"])


@query("truncate_right", f"""
SELECT {_sout(['ids', 'mask'])} FROM (SELECT doc_id,
  list_transform(ids, lambda x, i: CASE WHEN i - 1 > k THEN {PAD} ELSE x END) AS ids,
  list_transform(ids, lambda x, i: CASE WHEN i - 1 > k THEN 0 ELSE 1 END) AS mask FROM ({SQL_TRUNC}))""")
def q_truncate_right(spark, sf):
    t = token_ids(spark, sf).withColumn("tr", A.truncate_right("ids", EOS, PAD))
    return _out(t.select("doc_id", F.col("tr.ids").alias("ids"), F.col("tr.mask").alias("mask")), ["ids", "mask"])


@query("eos_mask", f"""
SELECT {_sout(['mask'])} FROM (SELECT doc_id, list_transform(ids, lambda x, i: CASE WHEN i - 1 <= k THEN 1 ELSE 0 END) AS mask FROM ({SQL_TRUNC}))""")
def q_eos_mask(spark, sf):
    return _out(token_ids(spark, sf).withColumn("mask", A.eos_mask("ids", EOS)), ["mask"])


@query("completion_length", f"SELECT doc_id, CAST(least(k + 1, len(ids)) AS BIGINT) AS completion_length FROM ({SQL_TRUNC})")
def q_completion_length(spark, sf):
    return token_ids(spark, sf).select("doc_id", A.completion_length("ids", EOS).cast("long").alias("completion_length"))


@query("truncate_left", f"SELECT {_sout(['ids'])} FROM (SELECT doc_id, ids[greatest(1, len(ids) - 64 + 1):] AS ids FROM ({SQL_IDS}))")
def q_truncate_left(spark, sf):
    return _out(token_ids(spark, sf).withColumn("ids", A.truncate_left("ids", 64)), ["ids"])


def _sql_pad(col: str, width: str, v, side: str) -> str:
    fill = f"list_transform(range(greatest({width} - len({col}), 0)), lambda x: {v})"
    return f"list_concat({col}, {fill})" if side == "right" else f"list_concat({fill}, {col})"


SQL_BATCHED = f"""
SELECT doc_id, doc_id // {BATCH} AS batch_id, ids, max(len(ids)) OVER (PARTITION BY doc_id // {BATCH}) AS w FROM ({SQL_IDS})"""
SQL_RIGHT = f"SELECT doc_id, batch_id, {_sql_pad('ids', 'w', PAD, 'right')} AS ids FROM ({SQL_BATCHED})"
SQL_LEFT = f"SELECT doc_id, batch_id, {_sql_pad('ids', 'w', PAD, 'left')} AS ids FROM ({SQL_BATCHED})"


def right_padded(spark, sf):
    return T.pad_batch(token_table(spark, sf), {"ids": (PAD, "right")}, "batch_id")


def left_padded(spark, sf):
    return T.pad_batch(token_table(spark, sf), {"ids": (PAD, "left")}, "batch_id")


@query("pad_batch", f"SELECT {_sout(['ids'])} FROM ({SQL_LEFT})")
def q_pad_batch(spark, sf):
    return _out(left_padded(spark, sf), ["ids"])


@query("batch_width_check", f"SELECT batch_id, max(len(ids)) AS width, min(len(ids)) AS min_width FROM ({SQL_RIGHT}) GROUP BY batch_id")
def q_batch_width_check(spark, sf):
    r = right_padded(spark, sf)
    return r.groupBy("batch_id").agg(F.max(F.size("ids")).cast("long").alias("width"), F.min(F.size("ids")).cast("long").alias("min_width"))


@query("pad_to_length", f"SELECT {_sout(['ids'])} FROM (SELECT doc_id, {_sql_pad('ids', '4096', PAD, 'right')} AS ids FROM ({SQL_IDS}))")
def q_pad_to_length(spark, sf):
    return _out(token_ids(spark, sf).withColumn("ids", A.pad_to_length("ids", 4096, PAD)), ["ids"])


@query("pad_multiple_of", f"""
SELECT {_sout(['ids'])} FROM (SELECT doc_id, {_sql_pad('ids', 'CAST(ceil(w / 64) * 64 AS BIGINT)', PAD, 'right')} AS ids FROM ({SQL_BATCHED}))""")
def q_pad_multiple_of(spark, sf):
    return _out(T.pad_batch(token_table(spark, sf), {"ids": (PAD, "right")}, "batch_id", multiple_of=64), ["ids"])


@query("attention_mask", f"""
SELECT {_sout(['mask'])} FROM (SELECT doc_id, list_transform(ids, lambda x: CASE WHEN x <> {PAD} THEN 1 ELSE 0 END) AS mask FROM ({SQL_RIGHT}))""")
def q_attention_mask(spark, sf):
    return _out(right_padded(spark, sf).withColumn("mask", A.attention_mask("ids", PAD)), ["mask"])


@query("position_ids", f"""
WITH e AS (SELECT doc_id, generate_subscripts(ids, 1) AS i, unnest(ids) AS x FROM ({SQL_LEFT})),
m AS (SELECT doc_id, i, CASE WHEN x <> {PAD} THEN 1 ELSE 0 END AS a FROM e),
c AS (SELECT doc_id, i, sum(a) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - a AS p FROM m)
SELECT doc_id, count(*) AS position_ids_size, CAST(sum(CAST(i AS BIGINT) * (p + 128)) AS BIGINT) AS position_ids_digest FROM c GROUP BY doc_id""")
def q_position_ids(spark, sf):
    lp = left_padded(spark, sf).withColumn("mask", A.attention_mask("ids", PAD))
    return _out(lp.withColumn("position_ids", T.position_ids("mask")), ["position_ids"])


@query("mask_fill", f"""
SELECT {_sout(['ids'])} FROM (SELECT doc_id, list_transform(ids, lambda x: CASE WHEN x <> {PAD} THEN x ELSE 0 END) AS ids FROM ({SQL_LEFT}))""")
def q_mask_fill(spark, sf):
    lp = left_padded(spark, sf).withColumn("mask", A.attention_mask("ids", PAD))
    return _out(lp.withColumn("ids", A.mask_fill("ids", "mask", 0)), ["ids"])


SQL_SEQLEN = f"""
SELECT doc_id, ids, {_sql_first(f'ids[{CONTEXT + 1}:]', PAD)} - 1 + {CONTEXT} AS sl FROM ({SQL_RIGHT})"""


@query("sequence_length", f"SELECT doc_id, CAST(sl AS BIGINT) AS sequence_length FROM ({SQL_SEQLEN})")
def q_sequence_length(spark, sf):
    r = right_padded(spark, sf)
    return r.select("doc_id", A.sequence_length("ids", CONTEXT, PAD).cast("long").alias("sequence_length"))


@query("gather_final_reward", f"""
SELECT doc_id, round(CASE WHEN sl >= 0 THEN CAST(ids[sl + 1] AS DOUBLE) / 1000.0 ELSE CAST(ids[len(ids) + sl + 1] AS DOUBLE) / 1000.0 END, 6) AS reward
FROM ({SQL_SEQLEN})""")
def q_gather_final_reward(spark, sf):
    r = right_padded(spark, sf)
    rewards = F.transform("ids", lambda x: x.cast("double") / F.lit(1000.0))
    sl = A.sequence_length("ids", CONTEXT, PAD)
    return r.select("doc_id", F.round(A.get_signed(rewards, sl), 6).alias("reward"))


@query("add_bos", f"""
SELECT {_sout(['ids', 'mask'])} FROM (SELECT doc_id,
  CASE WHEN len(ids) = 0 OR ids[1] <> {BOS} THEN list_concat([{BOS}], ids) ELSE ids END AS ids,
  CASE WHEN len(ids) = 0 OR ids[1] <> {BOS} THEN list_concat([1], list_transform(ids, lambda x: 1)) ELSE list_transform(ids, lambda x: 1) END AS mask
  FROM ({SQL_IDS}))""")
def q_add_bos(spark, sf):
    t = token_ids(spark, sf).withColumn("mask", F.array_repeat(F.lit(1), F.size("ids")))
    i, m = A.add_bos("ids", "mask", BOS)
    return _out(t.select("doc_id", i.alias("ids"), m.alias("mask")), ["ids", "mask"])


@query("add_eos", f"""
SELECT {_sout(['ids', 'mask'])} FROM (SELECT doc_id,
  CASE WHEN len(ids) = 0 OR ids[-1] <> {EOS} THEN list_concat(ids, [{EOS}]) ELSE ids END AS ids,
  CASE WHEN len(ids) = 0 OR ids[-1] <> {EOS} THEN list_concat(list_transform(ids, lambda x: 1), [1]) ELSE list_transform(ids, lambda x: 1) END AS mask
  FROM ({SQL_IDS}))""")
def q_add_eos(spark, sf):
    t = token_ids(spark, sf).withColumn("mask", F.array_repeat(F.lit(1), F.size("ids")))
    i, m = A.add_eos("ids", "mask", EOS)
    return _out(t.select("doc_id", i.alias("ids"), m.alias("mask")), ["ids", "mask"])


@query("flush_left", f"""
WITH l AS (SELECT doc_id, batch_id, ids, list_transform(ids, lambda x: CASE WHEN x <> {PAD} THEN 1 ELSE 0 END) AS mask FROM ({SQL_LEFT})),
r AS (SELECT doc_id, batch_id, list_position(mask, 1) - 1 AS k, ids, mask FROM l),
s AS (SELECT doc_id, batch_id, list_concat(ids[k + 1:], ids[1:k]) AS ids, list_concat(mask[k + 1:], mask[1:k]) AS mask FROM r),
c AS (SELECT batch_id, max(len(list_filter(mask, lambda x: x = 1))) AS cut FROM s GROUP BY batch_id)
SELECT {_sout(['ids', 'mask'])} FROM (SELECT doc_id, ids[1:cut] AS ids, mask[1:cut] AS mask FROM s JOIN c USING (batch_id))""")
def q_flush_left(spark, sf):
    lp = left_padded(spark, sf).withColumn("mask", A.attention_mask("ids", PAD))
    return _out(T.flush_left(lp, "mask", ["ids"], "batch_id"), ["ids", "mask"])


@query("mask_labels_pad", f"""
SELECT {_sout(['labels'])} FROM (SELECT doc_id, list_transform(ids, lambda x: CASE WHEN x IN ({PAD}, {BOS}, {EOS}) THEN -100 ELSE x END) AS labels FROM ({SQL_RIGHT}))""")
def q_mask_labels_pad(spark, sf):
    return _out(T.mask_labels(right_padded(spark, sf), "ids", PAD, SPECIAL), ["labels"])


def _sql_matches(col: str, tpl: list[int]) -> str:
    m = len(tpl)
    lit = "[" + ", ".join(map(str, tpl)) + "]"
    return f"list_transform(list_filter(range(1, len({col}) - {m} + 2), lambda i: {col}[i:i + {m - 1}] = {lit}), lambda i: i - 1)"


SQL_LABELS = f"""SELECT doc_id, list_transform(ids, lambda x: CASE WHEN x IN ({PAD}, {BOS}, {EOS}) THEN -100 ELSE x END) AS labels FROM ({SQL_RIGHT})"""


@query("label_completion_single", f"""
WITH a AS (SELECT doc_id, labels, list_max({_sql_matches('labels', RESPONSE_TPL)}) + {len(RESPONSE_TPL)} AS e FROM ({SQL_LABELS}))
SELECT {_sout(['labels'])} FROM (SELECT doc_id,
  CASE WHEN e IS NULL THEN list_transform(labels, lambda x: -100) ELSE list_transform(labels, lambda x, i: CASE WHEN i - 1 < e THEN -100 ELSE x END) END AS labels FROM a)""")
def q_label_completion_single(spark, sf):
    lab = T.mask_labels(right_padded(spark, sf), "ids", PAD, SPECIAL)
    return _out(lab.withColumn("labels", M.label_completion_single("labels", RESPONSE_TPL)), ["labels"])


@query("label_completion_multi", f"""
WITH a AS (SELECT doc_id, labels,
             list_transform({_sql_matches('labels', RESPONSE_TPL)}, lambda s: s + {len(RESPONSE_TPL)}) AS re,
             {_sql_matches('labels', INSTRUCTION_TPL)} AS hi FROM ({SQL_LABELS})),
b AS (SELECT *, CASE WHEN len(hi) > 0 AND len(re) > 0 AND hi[1] > re[1] THEN list_concat([0], hi) ELSE hi END AS h2 FROM a),
c AS (SELECT *, list_transform(range(least(len(h2), len(re))), lambda k: {{'s': CASE WHEN k = 0 THEN 0 ELSE h2[k + 1] END, 'e': re[k + 1]}}) AS spans,
             CASE WHEN len(re) < len(h2) THEN h2[-1] END AS tail FROM b)
SELECT {_sout(['labels'])} FROM (SELECT doc_id,
  CASE WHEN len(re) = 0 OR len(hi) = 0 THEN list_transform(labels, lambda x: -100)
       ELSE list_transform(labels, lambda x, i: CASE WHEN len(list_filter(spans, lambda sp: i - 1 >= sp.s AND i - 1 < sp.e)) > 0
                                                     OR (tail IS NOT NULL AND i - 1 >= tail) THEN -100 ELSE x END) END AS labels FROM c)""")
def q_label_completion_multi(spark, sf):
    lab = T.mask_labels(right_padded(spark, sf), "ids", PAD, SPECIAL)
    return _out(lab.withColumn("labels", M.label_completion_multi("labels", RESPONSE_TPL, INSTRUCTION_TPL)), ["labels"])


@query("padding_free_batch", f"""
WITH l AS (SELECT doc_id, batch_id, list_filter(ids, lambda x: x <> {PAD}) AS i,
                  list_filter(list_transform(ids, lambda x: CASE WHEN x IN ({PAD}, {BOS}, {EOS}) THEN -100 ELSE x END), lambda x, k: ids[k] <> {PAD}) AS l
           FROM ({SQL_RIGHT})),
m AS (SELECT doc_id, batch_id, i, CASE WHEN len(l) > 0 THEN list_concat([-100], l[2:]) ELSE l END AS l,
             list_transform(i, lambda x, k: k - 1) AS p FROM l),
g AS (SELECT batch_id, flatten(list(i ORDER BY doc_id)) AS input_ids, flatten(list(p ORDER BY doc_id)) AS position_ids,
             flatten(list(l ORDER BY doc_id)) AS labels, list(len(i) ORDER BY doc_id) FILTER (WHERE len(i) > 0) AS sizes FROM m GROUP BY batch_id)
SELECT {_sout(['input_ids', 'position_ids', 'labels'], 'batch_id')},
       array_to_string(list_concat([0], list_transform(sizes, lambda s, k: list_sum(sizes[1:k]))), ' ') AS cu_seq_lens,
       CAST(list_max(sizes) AS BIGINT) AS max_length FROM g""")
def q_padding_free_batch(spark, sf):
    r = right_padded(spark, sf).withColumn("mask", A.attention_mask("ids", PAD))
    r = T.mask_labels(r, "ids", PAD, SPECIAL)
    p = T.padding_free_batch(r, "ids", "labels", "mask", "batch_id", "doc_id")
    p = p.withColumns({"cu_seq_lens": F.array_join(F.col("cu_seq_lens").cast("array<string>"), " "), "max_length": F.col("max_length").cast("long")})
    return _out(p, ["input_ids", "position_ids", "labels"], keys=("batch_id", "cu_seq_lens", "max_length"))


# ---------------------------------------------------------------- packing
SQL_STREAM = f"""
WITH s AS (SELECT doc_id, list_concat(ids, [{EOS}]) AS seq FROM ({SQL_IDS})),
e AS (SELECT doc_id, generate_subscripts(seq, 1) AS i, unnest(seq) AS x FROM s),
g AS (SELECT x, row_number() OVER (ORDER BY doc_id, i) - 1 AS gp FROM e)"""


@query("pack_constant_length", f"""
{SQL_STREAM}
SELECT gp // {PACK_LEN} AS piece_id, count(*) AS input_ids_size, CAST(sum((gp % {PACK_LEN} + 1) * (CAST(x AS BIGINT) + 128)) AS BIGINT) AS input_ids_digest
FROM g WHERE gp // {PACK_LEN} < (SELECT count(*) FROM g) // {PACK_LEN} GROUP BY gp // {PACK_LEN}""")
def q_pack_constant_length(spark, sf):
    t = token_table(spark, sf)
    p = P.pack_constant_length(t, "ids", ["doc_id"], PACK_LEN, P.concat_token(EOS))
    return _out(p, ["input_ids"], keys=("piece_id",))


# buffered: buffers of 8 pieces' worth of characters (3.6 characters per token)
BUF_SEQ = 8
BUF_M = PACK_LEN * 3.6 * BUF_SEQ

def _buffers_sql() -> str:
    # greedy buffer ids as a recursive walk over documents in order (the oracle only)
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, CAST(length(text) AS DOUBLE) AS sz, row_number() OVER (ORDER BY doc_id) AS rn FROM documents),
walk(rn, doc_id, bid, after) AS (
  SELECT rn, doc_id, 0, sz FROM d WHERE rn = 1
  UNION ALL
  SELECT d.rn, d.doc_id,
         CASE WHEN w.after >= {BUF_M} THEN w.bid + 1 ELSE w.bid END,
         CASE WHEN w.after >= {BUF_M} THEN d.sz ELSE w.after + d.sz END
  FROM walk w JOIN d ON d.rn = w.rn + 1)
SELECT doc_id, CAST(bid AS BIGINT) AS buffer_id FROM walk"""


def _sql_pack_buffered(order: str) -> str:
    return f"""
WITH b AS ({_buffers_sql()}),
s AS (SELECT i.doc_id, b.buffer_id, list_concat(i.ids, [{EOS}]) AS seq FROM ({SQL_IDS}) i JOIN b USING (doc_id)),
e AS (SELECT doc_id, buffer_id, generate_subscripts(seq, 1) AS i, unnest(seq) AS x FROM s),
g AS (SELECT buffer_id, x, row_number() OVER (PARTITION BY buffer_id ORDER BY {order}, i) - 1 AS gp,
             count(*) OVER (PARTITION BY buffer_id) AS n FROM e)
SELECT buffer_id, gp // {PACK_LEN} AS piece_id, count(*) AS input_ids_size,
       CAST(sum((gp % {PACK_LEN} + 1) * (CAST(x AS BIGINT) + 128)) AS BIGINT) AS input_ids_digest
FROM g WHERE gp // {PACK_LEN} < n // {PACK_LEN} GROUP BY buffer_id, gp // {PACK_LEN}"""


def _docs_with_ids(spark, sf):
    d = read_table(spark, sf, "documents", ["doc_id", "text"]).select("doc_id", F.length("text").alias("n_text"))
    return written(token_ids(spark, sf).join(d, "doc_id").drop("batch_id"), "token-ids")


@query("pack_buffered", _sql_pack_buffered("doc_id"))
def q_pack_buffered(spark, sf):
    t = _docs_with_ids(spark, sf)
    p = P.pack_buffered(t, "ids", ["doc_id"], PACK_LEN, BUF_SEQ, 3.6, text_len=F.col("n_text"), concat_token_id=EOS)
    return _out(p, ["input_ids"], keys=("buffer_id", "piece_id"))


SEED = 42


def _sql_draw(key: str) -> str:
    return f"('0x' || substr(md5('{SEED}:' || {key}), 1, 15))::BIGINT"


_SQL_SHUFFLED = _sql_pack_buffered(f"{_sql_draw('CAST(doc_id AS VARCHAR)')}, doc_id")


@query("pack_shuffle", f"""
SELECT buffer_id, row_number() OVER (PARTITION BY buffer_id ORDER BY {_sql_draw("buffer_id || ':' || piece_id")}, piece_id) - 1 AS piece_id,
       input_ids_size, input_ids_digest FROM ({_SQL_SHUFFLED})""")
def q_pack_shuffle(spark, sf):
    t = _docs_with_ids(spark, sf)
    p = P.pack_buffered(t, "ids", ["doc_id"], PACK_LEN, BUF_SEQ, 3.6, text_len=F.col("n_text"), concat_token_id=EOS, shuffle_seed=SEED)
    return _out(p, ["input_ids"], keys=("buffer_id", "piece_id"))


@query("pack_format", """SELECT doc_id, '### ' || lang || ': ' || text AS text FROM documents""")
def q_pack_format(spark, sf):
    d = read_table(spark, sf, "documents", ["doc_id", "lang", "text"])
    return d.select("doc_id", P.format_text(d, formatting=F.concat(F.lit("### "), F.col("lang"), F.lit(": "), F.col("text")), text_field="text").alias("text"))


# ---------------------------------------------------------------- conversation collators
def conv_vocab(spark, sf):
    """Vocabulary of the ChatML-rendered conversations (whitespace tokens)."""
    from rewardlens.functions.chat import render
    m = V.messages(spark, sf)
    w = T.words(m.select("conv_id", render("messages").alias("text")), "conv_id", "text")
    return written(T.build_vocab(w), "vocabulary")


SQL_CONV_WORDS = f"""
SELECT conv_id, generate_subscripts(toks, 1) - 1 AS pos, unnest(toks) AS token FROM (
  SELECT conv_id, list_filter(regexp_split_to_array({S.render('messages')}, '{V.WS_PATTERN}'), lambda t: t <> '') AS toks FROM ({V.SQL_MESSAGES}))"""
SQL_CONV_VOCAB = f"""
SELECT token, CAST(row_number() OVER (ORDER BY n DESC, token) - 1 AS INTEGER) AS token_id
FROM (SELECT token, count(*) AS n FROM ({SQL_CONV_WORDS}) GROUP BY token)"""


def _sql_encode_text(text_sql: str, key: str, src: str, max_len: int | None = None) -> str:
    cut = f"WHERE pos < {max_len}" if max_len else ""
    return f"""
SELECT w.{key}, list(v.token_id ORDER BY w.pos) AS ids FROM (
  SELECT {key}, pos, token FROM (
    SELECT {key}, generate_subscripts(toks, 1) - 1 AS pos, unnest(toks) AS token FROM (
      SELECT {key}, list_filter(regexp_split_to_array({text_sql}, '{V.WS_PATTERN}'), lambda t: t <> '') AS toks FROM ({src}))) {cut}) w
JOIN ({SQL_CONV_VOCAB}) v USING (token) GROUP BY w.{key}"""


CHATML_MAX = 1024


@query("label_chatml", f"""
WITH ids AS ({_sql_encode_text(S.render('messages'), 'conv_id', V.SQL_MESSAGES, CHATML_MAX)}),
pl AS (SELECT conv_id, len(list_filter(regexp_split_to_array({S.render('messages[1:len(messages) - 1]', gen=True)}, '{V.WS_PATTERN}'), lambda t: t <> '')) AS np
       FROM ({V.SQL_MESSAGES})),
lab AS (SELECT conv_id, conv_id // {BATCH} AS batch_id, ids,
               list_transform(ids, lambda x, i: CASE WHEN i - 1 < least(np, len(ids)) THEN -100 ELSE x END) AS labels
        FROM ids JOIN pl USING (conv_id)),
w AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch_id) AS w FROM lab)
SELECT {_sout(['input_ids', 'attention_mask', 'labels'], 'conv_id')} FROM (
  SELECT conv_id, {_sql_pad('ids', 'w', 0, 'left')} AS input_ids,
         {_sql_pad("list_transform(ids, lambda x: 1)", 'w', 0, 'left')} AS attention_mask,
         {_sql_pad('labels', 'w', -100, 'left')} AS labels FROM w)""")
def q_label_chatml(spark, sf):
    from rewardlens.operators.collate import chatml_collate
    m = V.messages(spark, sf).withColumn("batch_id", (F.col("conv_id") / BATCH).cast("long"))
    out = chatml_collate(m, conv_vocab(spark, sf), key="conv_id", pad_id=0, max_length=CHATML_MAX)
    return _out(out, ["input_ids", "attention_mask", "labels"], keys=("conv_id",))


def _pref_ids(spark, sf):
    """Preference rows with ChatML-rendered, tokenised prompt / chosen / rejected."""
    from rewardlens.functions.chat import render
    from rewardlens.operators.collate import encode_text
    p = V.preference(spark, sf)
    vocab = conv_vocab(spark, sf)
    texts = {"prompt": render("prompt", add_generation_prompt=True), "chosen": render("chosen"), "rejected": render("rejected")}
    # one long table of all three texts, one vocabulary join, one row for each conversation again
    long = p.select("conv_id", F.explode(F.array(*[F.struct(F.lit(k).alias("part"), t.alias("text")) for k, t in texts.items()])).alias("t"))
    e = encode_text(long.select(F.struct("conv_id", "t.part").alias("key"), "t.text"), vocab, "key", "text")
    wide = e.groupBy(F.col("key.conv_id").alias("conv_id")).agg(*[
        F.first(F.when(F.col("key.part") == k, F.col(c)), ignorenulls=True).alias(f"{k}_{c}") for k in texts for c in ("input_ids", "attention_mask")])
    return written(wide.withColumn("batch_id", (F.col("conv_id") / BATCH).cast("long")), "preference-ids")


def _sql_pref_ids() -> str:
    parts = {
        "prompt": S.render("prompt", gen=True), "chosen": S.render("chosen"), "rejected": S.render("rejected"),
    }
    ctes = ",\n".join(f"{k} AS ({_sql_encode_text(v, 'conv_id', V.SQL_PREFERENCE)})" for k, v in parts.items())
    return f"""{ctes},
ids AS (SELECT p.conv_id, p.conv_id // {BATCH} AS batch_id, p.ids AS prompt_ids, c.ids AS chosen_ids, r.ids AS rejected_ids
        FROM prompt p JOIN chosen c USING (conv_id) JOIN rejected r USING (conv_id))"""


@query("collate_reward_pairs", f"""
WITH {_sql_pref_ids()},
x AS (SELECT conv_id, batch_id, list_concat(prompt_ids, chosen_ids) AS c, list_concat(prompt_ids, rejected_ids) AS r FROM ids),
w AS (SELECT *, max(len(c)) OVER (PARTITION BY batch_id) AS wc, max(len(r)) OVER (PARTITION BY batch_id) AS wr FROM x)
SELECT {_sout(['input_ids_chosen', 'attention_mask_chosen', 'input_ids_rejected', 'attention_mask_rejected'], 'conv_id')},
       round(CAST(len(r) - len(c) AS DOUBLE), 6) AS margin FROM (
  SELECT conv_id, c, r, {_sql_pad('c', 'wc', 0, 'right')} AS input_ids_chosen, {_sql_pad('list_transform(c, lambda x: 1)', 'wc', 0, 'right')} AS attention_mask_chosen,
         {_sql_pad('r', 'wr', 0, 'right')} AS input_ids_rejected, {_sql_pad('list_transform(r, lambda x: 1)', 'wr', 0, 'right')} AS attention_mask_rejected FROM w)""")
def q_collate_reward_pairs(spark, sf):
    p = _pref_ids(spark, sf)
    x = p.select(
        "conv_id", "batch_id",
        F.concat("prompt_input_ids", "chosen_input_ids").alias("input_ids_chosen"),
        F.concat("prompt_attention_mask", "chosen_attention_mask").alias("attention_mask_chosen"),
        F.concat("prompt_input_ids", "rejected_input_ids").alias("input_ids_rejected"),
        F.concat("prompt_attention_mask", "rejected_attention_mask").alias("attention_mask_rejected"),
    )
    x = x.withColumn("margin", (F.size("input_ids_rejected") - F.size("input_ids_chosen")).cast("double"))
    c = T.collate_reward_pairs(x, pad_id=0).withColumn("margin", F.round(F.col("margin").cast("double"), 6))
    return _out(c, ["input_ids_chosen", "attention_mask_chosen", "input_ids_rejected", "attention_mask_rejected"], keys=("conv_id", "margin"))


@query("collate_preference", f"""
WITH {_sql_pref_ids()},
x AS (SELECT conv_id, batch_id, prompt_ids, chosen_ids, rejected_ids,
             list_transform(chosen_ids, lambda x: x) AS chosen_labels FROM ids),
w AS (SELECT *, max(len(prompt_ids)) OVER (PARTITION BY batch_id) AS wp, max(len(chosen_ids)) OVER (PARTITION BY batch_id) AS wc,
             max(len(rejected_ids)) OVER (PARTITION BY batch_id) AS wr FROM x)
SELECT {_sout(['prompt_input_ids', 'prompt_attention_mask', 'chosen_input_ids', 'chosen_labels', 'rejected_input_ids'], 'conv_id')} FROM (
  SELECT conv_id, {_sql_pad('prompt_ids', 'wp', 0, 'left')} AS prompt_input_ids,
         {_sql_pad('list_transform(prompt_ids, lambda x: 1)', 'wp', 0, 'left')} AS prompt_attention_mask,
         {_sql_pad('chosen_ids', 'wc', 0, 'right')} AS chosen_input_ids, {_sql_pad('chosen_labels', 'wc', -100, 'right')} AS chosen_labels,
         {_sql_pad('rejected_ids', 'wr', 0, 'right')} AS rejected_input_ids FROM w)""")
def q_collate_preference(spark, sf):
    p = _pref_ids(spark, sf)
    x = p.select("conv_id", "batch_id", "prompt_input_ids", "prompt_attention_mask", "chosen_input_ids",
                 F.col("chosen_input_ids").alias("chosen_labels"), "rejected_input_ids")
    c = T.collate_preference(x, pad_id=0)
    return _out(c, ["prompt_input_ids", "prompt_attention_mask", "chosen_input_ids", "chosen_labels", "rejected_input_ids"], keys=("conv_id",))


@query("collate_preference_logps", f"""
WITH {_sql_pref_ids()},
x AS (SELECT conv_id, batch_id, chosen_ids, CAST(-len(chosen_ids) AS DOUBLE) AS ref_chosen_logps,
             list_transform(prompt_ids[1:4], lambda t: CAST(t AS DOUBLE) / 2) AS pixels FROM ids),
w AS (SELECT *, max(len(pixels)) OVER (PARTITION BY batch_id) AS wp FROM x)
SELECT conv_id, ref_chosen_logps, len(p) AS n_pixels, list_sum(p) AS pixel_sum FROM (
  SELECT conv_id, ref_chosen_logps, {_sql_pad('pixels', 'wp', 0, 'right')} AS p FROM w)""")
def q_collate_preference_logps(spark, sf):
    """Log-probabilities are carried, pixel values padded with 0."""
    x = _pref_ids(spark, sf).select(
        "conv_id", "batch_id", (-F.size("chosen_input_ids")).cast("double").alias("ref_chosen_logps"),
        F.transform(F.slice("prompt_input_ids", 1, 4), lambda t: t.cast("double") / 2).alias("prompt_pixel_values"))
    c = T.collate_preference(x, pad_id=None)
    return c.select("conv_id", "ref_chosen_logps", F.size("prompt_pixel_values").cast("long").alias("n_pixels"),
                    F.aggregate("prompt_pixel_values", F.lit(0.0), lambda a, v: a + v).alias("pixel_sum"))


@query("collate_preference_seq2seq", f"""
WITH {_sql_pref_ids()},
w AS (SELECT *, max(len(prompt_ids)) OVER (PARTITION BY batch_id) AS wp, max(len(chosen_ids)) OVER (PARTITION BY batch_id) AS wc FROM ids)
SELECT {_sout(['prompt_input_ids', 'chosen_labels', 'rejected_decoder_input_ids'], 'conv_id')} FROM (
  SELECT conv_id, {_sql_pad('prompt_ids', 'wp', 0, 'right')} AS prompt_input_ids, {_sql_pad('chosen_ids', 'wc', -100, 'right')} AS chosen_labels,
         {_sql_pad('chosen_ids', 'wc', -100, 'right')} AS rejected_decoder_input_ids FROM w)""")
def q_collate_preference_seq2seq(spark, sf):
    """Encoder-decoder: everything is padded on the right, decoder sides with the ignored label."""
    x = _pref_ids(spark, sf).select("conv_id", "batch_id", "prompt_input_ids", F.col("chosen_input_ids").alias("chosen_labels"),
                                    F.col("chosen_input_ids").alias("rejected_decoder_input_ids"))
    c = T.collate_preference(x, pad_id=0, encoder_decoder=True)
    return _out(c, ["prompt_input_ids", "chosen_labels", "rejected_decoder_input_ids"], keys=("conv_id",))


@query("pad_nested", f"""
WITH s AS (SELECT vec_id, vec_id // {BATCH} AS batch_id, list_transform(range(1 + vec_id % 3), lambda r: embedding[1:CAST(1 + (vec_id + r) % 4 AS BIGINT)]) AS a FROM embeddings),
w AS (SELECT *, max(len(a)) OVER (PARTITION BY batch_id) AS w0, max(list_max(list_transform(a, lambda x: len(x)))) OVER (PARTITION BY batch_id) AS w1 FROM s)
SELECT vec_id, w0 AS n_rows, w1 AS n_cols, round(list_sum(list_transform(a, lambda x: list_sum(x))) - (w0 * w1 - list_sum(list_transform(a, lambda x: len(x)))), 4) AS total FROM w""")
def q_pad_nested(spark, sf):
    """Two-dimensional padding: the batch's most rows and longest row, filled with -1."""
    e = read_table(spark, sf, "embeddings", ["vec_id", "embedding"])
    rows = F.transform(F.sequence(F.lit(0), (F.col("vec_id") % 3).cast("int")), lambda r: F.slice("embedding", 1, (1 + (F.col("vec_id") + r) % 4).cast("int")))
    s = e.select("vec_id", (F.col("vec_id") / BATCH).cast("long").alias("batch_id"), rows.alias("a"))
    p = T.pad_nested_batch(s, "a", -1.0)
    flat = F.aggregate(F.flatten("a"), F.lit(0.0), lambda t, x: t + x)
    return p.select("vec_id", F.size("a").cast("long").alias("n_rows"), F.size(F.get("a", 0)).cast("long").alias("n_cols"), F.round(flat, 4).alias("total"))


@query("add_bos_sides", f"""
WITH {_sql_pref_ids()},
b AS (SELECT conv_id, CASE WHEN prompt_ids[1] = {BOS} THEN prompt_ids ELSE list_concat([{BOS}], prompt_ids) END AS p,
             CASE WHEN chosen_ids[1] = {BOS} THEN chosen_ids ELSE list_concat([{BOS}], chosen_ids) END AS c,
             CASE WHEN rejected_ids[-1] = {EOS} THEN rejected_ids ELSE list_concat(rejected_ids, [{EOS}]) END AS r FROM ids)
SELECT {_sout(['p', 'c', 'r'], 'conv_id')} FROM b""")
def q_add_bos_sides(spark, sf):
    x = _pref_ids(spark, sf)
    x = T.add_bos_eos(x, BOS, EOS, prompts=[("prompt_input_ids", "prompt_attention_mask"), ("chosen_input_ids", "chosen_attention_mask")],
                      seqs=[("rejected_input_ids", "rejected_attention_mask")])
    return _out(x.select("conv_id", F.col("prompt_input_ids").alias("p"), F.col("chosen_input_ids").alias("c"), F.col("rejected_input_ids").alias("r")),
                ["p", "c", "r"], keys=("conv_id",))
