"""Token tables: vocabulary, encode / decode, batch padding and collators.

Sequences are ``ARRAY<INT>`` columns. Per-row work is a column expression;
batch-level work (a padded width, an all-zero column) is a per-batch
aggregate joined back on ``batch_id`` (see :mod:`rewardlens.plans.spread`).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rewardlens.functions import arrays as A
from rewardlens.functions.batches import cuts, in_slices
from rewardlens.functions.common import as_col
from rewardlens.plans.ordinal import running, written
from rewardlens.plans.spread import spread
from rewardlens.session import ship_package

# Fixed value: the label that loss functions ignore.
IGNORE_INDEX = -100
WS_PATTERN = "[ \\t\\n\\x0B\\f\\r]+"


def split_words(text) -> Column:
    """Whitespace tokens of a text (empty pieces dropped)."""
    return F.filter(F.split(as_col(text), WS_PATTERN), lambda t: t != "")


WS_CHARS = " \t\n\x0b\f\r"


def words(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, pos, token)``: one row per whitespace token, 0-based position.

    Trimming the whitespace set first leaves no empty piece except for an
    all-whitespace text (a single ``""``), so no per-array lambda is needed.
    """
    pieces = F.split(F.trim(as_col(text), F.lit(WS_CHARS)), WS_PATTERN)
    return df.select(key, F.posexplode(pieces).alias("pos", "token")).filter(F.col("token") != "")


def build_vocab(words_df: DataFrame, token: str = "token") -> DataFrame:
    """``(token, n, token_id)``; ids by rank of (count desc, token asc), from 0.

    The rank is a running count over ranges of the whole order (count, token),
    so neither frequent tokens nor the many that occur once share a task. The
    counts are written once, and how many there are is read from their files.
    """
    counts = written(words_df.groupBy(token).agg(F.count(F.lit(1)).alias("n")), "token-counts")
    return running(counts, [F.col("n").desc(), F.col(token).asc()], out="token_id", rows=counts.count())


def word_array(text) -> Column:
    """The white-space words of a text as an array; none for a null or blank text."""
    trimmed = F.trim(F.coalesce(as_col(text), F.lit("")), F.lit(WS_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WS_PATTERN))


#: Every task gets the words of the lowest ids, at most so many and none longer than so many characters.
SENT_WORDS, SENT_CHARS = 1 << 19, 64


#: Characters of texts that a task splits at once, about.
SLICE_CHARS = 1 << 24


def _words_of(texts: pa.Array, max_length: int | None) -> tuple[pa.Array, np.ndarray]:
    """The words of trimmed texts in one array, and where each text's begin and end in it."""
    lists = pc.ascii_split_whitespace(texts)
    ends, flat = lists.offsets.to_numpy(), lists.flatten()
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)  # a blank text is one empty piece
    bounds = np.r_[0, np.cumsum(real)][ends - ends[0]]
    flat = flat.filter(pa.array(real)) if not real.all() else flat
    if max_length is None:
        return flat, bounds
    kept = np.minimum(np.diff(bounds), max_length)
    done = np.r_[0, np.cumsum(kept)]
    return flat.take(pa.array(np.arange(done[-1]) + np.repeat(bounds[:-1] - done[:-1], kept))), done


def _lists(values: pa.Array, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values)


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def fill_nulls(ids: pa.Array, more: pa.Array) -> pa.Array:
    """``ids`` with the nulls of each row replaced, in order, by the items of ``more``."""
    flat, fill = ids.flatten(), more.flatten()
    bounds = ids.offsets.to_numpy() - ids.offsets[0].as_py()
    return _lists(pc.replace_with_mask(flat, flat.is_null(), fill) if len(fill) else flat, bounds)


def encode_texts(df: DataFrame, key: str, text: str, vocab: DataFrame, max_length: int | None = None, unk_id: int | None = None) -> DataFrame:
    """``(key, input_ids, attention_mask)`` of a text column, one row for each row of ``df``.

    Ids are ranks, so the lowest ids are the most frequent words: these go to
    every task (``SENT_WORDS``, 10 MB as a rule, 36 at most) and are looked up for the
    distinct words of a slice of texts, which a task splits itself: no array of all
    words is made or written. Only other words, rare ones, leave it, and are joined to
    ``vocab``, which should be a written table. A word outside it becomes ``unk_id``,
    or fails the job when none is given.
    """
    spark = df.sparkSession
    ship_package(spark)
    sent = vocab.filter((F.col("token_id") < SENT_WORDS) & (F.length("token") <= SENT_CHARS)).select("token", F.col("token_id").cast("int").alias("id"))
    table = sent.toArrow().combine_chunks()
    complete = table.num_rows == vocab.count()
    known = spark.sparkContext.broadcast((table["token"].combine_chunks(), table["id"].combine_chunks()))
    INTS, WORDS = T.ArrayType(T.IntegerType()), T.ArrayType(T.StringType())

    def found_in(texts: pa.Array) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
        names, ids = known.value
        texts = texts.cast(pa.string())
        at = cuts(np.cumsum(pc.binary_length(texts).to_numpy()), SLICE_CHARS)
        for a, b in zip(at, at[1:]):
            flat, bounds = _words_of(texts.slice(a, b - a), max_length)
            flat = flat.dictionary_encode()
            yield ids.take(pc.index_in(flat.dictionary, value_set=names)), flat, bounds

    @F.arrow_udf(INTS)
    def look_up(texts: pa.Array) -> pa.Array:
        out = [pa.array([], pa.list_(pa.int32()))]
        for found, flat, bounds in found_in(texts):
            if found.null_count:
                if unk_id is None:
                    missing = flat.dictionary.filter(found.is_null())[0].as_py()
                    raise ValueError(f"token outside the vocabulary: {missing}")
                found = found.fill_null(unk_id)
            out.append(_lists(found.take(flat.indices), bounds))
        return pa.concat_arrays(out)

    @F.arrow_udf(T.StructType([T.StructField("ids", INTS), T.StructField("rare", WORDS)]))
    def look_up_open(texts: pa.Array) -> pa.Array:
        out, rare = [pa.array([], pa.list_(pa.int32()))], [pa.array([], pa.list_(pa.string()))]
        for found, flat, bounds in found_in(texts):
            ids = found.take(flat.indices)
            open_ = ids.is_null()
            out.append(_lists(ids, bounds))
            before = np.r_[0, np.cumsum(open_.to_numpy(zero_copy_only=False))]
            rare.append(_lists(flat.dictionary.take(flat.indices.filter(open_)), before[bounds]))
        return pa.StructArray.from_arrays([pa.concat_arrays(out), pa.concat_arrays(rare)], ["ids", "rare"])

    trimmed = F.trim(F.coalesce(as_col(text), F.lit("")), F.lit(WS_CHARS))
    if complete:
        return _with_mask(df.select(key, look_up(trimmed).alias("input_ids")))
    staged = df.select(F.monotonically_increasing_id().alias("_rid"), F.col(key).alias("_key"), look_up_open(trimmed).alias("_w"))
    # written with their row numbers: the texts whose rare words are looked up are joined back by them
    staged = written(staged.select("_rid", "_key", F.col("_w.ids").alias("_ids"), F.col("_w.rare").alias("_words")), "looked-up")
    j = staged.select("_rid", F.posexplode("_words").alias("pos", "token")).join(vocab.select("token", "token_id"), "token", "left")
    missing = F.raise_error(F.concat(F.lit("token outside the vocabulary: "), F.col("token"))) if unk_id is None else F.lit(unk_id)
    rare = j.groupBy("_rid").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce(F.col("token_id").cast("int"), missing.cast("int")).alias("id")))).alias("_rare"))
    found = F.coalesce(F.col("_rare.id"), F.array().cast("array<int>"))
    return _with_mask(staged.select("_rid", "_key", "_ids").join(rare, "_rid", "left").select(F.col("_key").alias(key), fill_nulls("_ids", found).alias("input_ids")))


def _with_mask(df: DataFrame) -> DataFrame:
    return df.withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("input_ids")))


def encode(words_df: DataFrame, vocab: DataFrame, key: str, max_length: int | None = None, keys: DataFrame | None = None,
           unk_id: int | None = None) -> DataFrame:
    """``(key, input_ids, attention_mask)``; optional cut to ``max_length`` before the join.

    A token outside the vocabulary becomes ``unk_id``, or fails the job when none
    is given. ``keys`` names all texts: one without tokens gets an empty sequence.
    """
    w = words_df
    if max_length is not None:
        w = w.filter(F.col("pos") < max_length)
    j = w.join(vocab.select("token", "token_id"), "token", "left")
    missing = F.raise_error(F.concat(F.lit("token outside the vocabulary: "), F.col("token"))) if unk_id is None else F.lit(unk_id)
    known = F.coalesce(F.col("token_id").cast("int"), missing.cast("int"))
    g = j.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", known.alias("id")))).alias("_s"))
    if keys is not None:
        g = keys.select(key).join(g, key, "left")
    ids = F.coalesce(F.transform("_s", lambda s: s["id"]), F.array().cast("array<int>"))
    return _with_mask(g.select(key, ids.alias("input_ids")))


def encode_fixed(df: DataFrame, ids: str, length: int = 128, pad_id: int = 0) -> DataFrame:
    """Cut and pad to exactly ``length`` (``padding="max_length"``), with mask."""
    cut = F.slice(ids, 1, length)
    return df.withColumns({
        "input_ids": A.pad_to_width(cut, length, pad_id, "right"),
        "attention_mask": A.pad_to_width(F.array_repeat(F.lit(1), F.size(cut)), length, 0, "right"),
    })


def decode(df: DataFrame, vocab: DataFrame, key: str, ids: str, skip_ids: Sequence[int] = ()) -> DataFrame:
    """``(key, text)``: tokens joined by a space, in position order; ``skip_ids`` and ids without a token dropped.

    A row of which nothing remains has an empty text. Rows that share a key share a
    text, that of all their tokens by position; a row without a key has an empty one.

    As in :func:`encode_texts` every task gets the words of the lowest ids, so no row
    per token is made or moved; only rare ids are joined to ``vocab``, whose ids are
    distinct. ``df`` and ``vocab`` are read more than once and should be written tables.
    """
    spark = df.sparkSession
    ship_package(spark)
    sent = vocab.filter(F.col("token_id").between(0, SENT_WORDS - 1) & (F.length("token") <= SENT_CHARS)).select("token_id", "token")
    table = sent.toArrow().combine_chunks()
    complete = table.num_rows == vocab.count()
    at = np.full(int(pc.max(table["token_id"]).as_py() or 0) + 1, -1, np.int64)
    at[table["token_id"].to_numpy()] = np.arange(table.num_rows)
    known = spark.sparkContext.broadcast(table["token"].take(pa.array(at, mask=at < 0)).combine_chunks())
    skipped = pa.array(sorted(skip_ids), pa.int64())

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def look_up(ids: pa.Array) -> pa.Array:
        return in_slices(ids, look_up_slice)

    def look_up_slice(ids: pa.Array) -> pa.Array:
        names = known.value
        flat = ids.flatten().cast(pa.int64())
        there = pc.and_(pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(names))), pc.invert(pc.is_in(flat, value_set=skipped)))
        found = names.take(pc.if_else(there, flat, pa.scalar(None, pa.int64())))
        offsets = ids.offsets.to_numpy()
        return pa.ListArray.from_arrays(pa.array(offsets - offsets[0]), found, mask=ids.is_null() if ids.null_count else None)

    if complete:
        looked = df.select(key, look_up(ids).alias("_words"))
    else:
        staged = written(df.select(F.monotonically_increasing_id().alias("_rid"), F.col(key), F.col(ids).alias("_ids")), "id-rows")
        staged = staged.withColumn("_words", look_up("_ids"))
        open_ = staged.select("_rid", F.posexplode(F.arrays_zip(F.col("_ids").alias("id"), F.col("_words").alias("token"))).alias("pos", "w")).filter("w.token is null")
        open_ = open_.select("_rid", "pos", F.col("w.id").alias("token_id")).filter(~F.col("token_id").isin(list(skip_ids)))
        rare = open_.join(vocab.select("token", "token_id"), "token_id").groupBy("_rid").agg(F.map_from_entries(F.collect_list(F.struct("pos", "token"))).alias("_rare"))
        words = F.transform("_words", lambda w, i: F.coalesce(w, F.element_at(F.col("_rare"), i)))
        looked = staged.join(rare, "_rid", "left").select(key, F.when(F.col("_rare").isNull(), F.col("_words")).otherwise(words).alias("_words"))
    text = F.when(F.col(key).isNull(), F.lit("")).otherwise(F.coalesce(F.array_join("_words", " "), F.lit(""))).alias("text")
    keys = df.select(key).filter(F.col(key).isNotNull())
    repeated = written(keys.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(key), "repeated-keys")
    if not repeated.count():
        return looked.select(key, text)
    places = F.filter(F.transform("_words", lambda w, i: F.struct(i.alias("pos"), w.alias("token"))), lambda p: p["token"].isNotNull())
    shared = looked.join(repeated, key, "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.array_sort(F.flatten(F.collect_list(places))).alias("_s"))
    shared = shared.select(key, "_n", F.array_join(F.transform("_s", lambda p: p["token"]), " ").alias("text"))
    return looked.join(repeated, key, "left_anti").select(key, text).unionByName(shared.select(key, F.explode(F.array_repeat("text", F.col("_n").cast("int"))).alias("text")))


def _cumsum_before(masks: pa.Array) -> pa.Array:
    bounds = masks.offsets.to_numpy() - masks.offsets[0].as_py()
    sums = np.r_[0, np.cumsum(masks.flatten().to_numpy(zero_copy_only=False).astype(np.int64))]
    out = sums[:-1] - np.repeat(sums[bounds[:-1]], np.diff(bounds))
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(out.astype(np.int32)), mask=masks.is_null() if masks.null_count else None)


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def exclusive_cumsum(masks: pa.Array) -> pa.Array:
    """``cumsum(mask) - mask`` per row, vectorised with numpy (O(n) per row) over slices of the batch.

    Spark has no array prefix-sum; an ``aggregate`` that appends to an array
    copies it every step (O(n^2)), so this one expression runs in Arrow batches.
    """
    return in_slices(masks, _cumsum_before)


def position_ids(mask) -> Column:
    return exclusive_cumsum(as_col(mask))


def pad_batch(df: DataFrame, cols: dict[str, tuple[int | float, str]], batch: str = "batch_id", multiple_of: int | None = None) -> DataFrame:
    """Pad each array column to its batch's max width (rounded up to ``multiple_of``).

    ``cols`` maps column -> (padding value, side). Widths are a per-batch
    aggregate spread back by join; invalid sides fail before any job runs.
    """
    for _, (_, side) in cols.items():
        if side not in ("left", "right"):
            raise ValueError("padding_side must be 'left' or 'right'")
    aggs = [F.max(F.size(c)).alias(f"_w_{c}") for c in cols]
    s = spread(df, [batch], aggs)
    out = {}
    for c, (v, side) in cols.items():
        w = A.round_up_multiple(F.col(f"_w_{c}"), multiple_of)
        out[c] = A.pad_to_width(c, w, v, side)
    return s.withColumns(out).drop(*[f"_w_{c}" for c in cols])


def pad_nested_batch(df: DataFrame, col: str, value: int | float, batch: str = "batch_id", side: str = "right") -> DataFrame:
    """Pad a two-dimensional array column to its batch's most rows and longest row, both on ``side``."""
    s = spread(df, [batch], [F.max(F.size(col)).alias("_w0"), F.max(F.array_max(F.transform(col, F.size))).alias("_w1")])
    kind = df.schema[col].dataType.elementType.simpleString()
    inner = F.transform(col, lambda row: A.pad_to_width(row, F.col("_w1"), value, side).cast(kind))
    empty = F.array_repeat(F.lit(value), F.col("_w1")).cast(kind)
    fill = F.array_repeat(empty, F.col("_w0") - F.size(col))
    return s.withColumn(col, F.concat(inner, fill) if side == "right" else F.concat(fill, inner)).drop("_w0", "_w1")


def flush_left(df: DataFrame, mask: str, tensors: Sequence[str], batch: str = "batch_id") -> DataFrame:
    """Rotate each row so its first mask 1 is at column 0; cut the batch at the first all-zero column.

    Rows without any 1 fail the job (``raise_error``), as the reference does.
    """
    k = F.array_position(mask, 1) - 1
    guard = F.when(k < 0, F.raise_error(F.lit("flush_left: a mask row has no 1"))).otherwise(k)
    r = df.withColumn("_k", guard.cast("int"))
    rot = {c: A.rotate_left(c, F.col("_k")) for c in [mask, *tensors]}
    r = r.withColumns(rot)
    # First column that is 0 in every row of the batch. Each row's 1s form a
    # few runs [start, end); the batch's union of runs, merged from column 0,
    # ends at that column. Only run boundaries leave the row, not tokens. Most
    # rows are one run of 1s and then 0s, which native searches find; only the
    # others are walked element by element.
    m = F.col(mask)
    n = F.size(m)
    zero = F.array_position(m, 0)
    r = r.withColumn("_first0", F.when(zero == 0, n).otherwise(zero - 1).cast("int"))
    r = r.withColumn("_more", F.array_position(F.slice(m, F.col("_first0") + 1, n), 1) > 0)
    idx = F.sequence(F.lit(0), n - 1)
    starts = F.filter(idx, lambda i: (F.get(m, i) == 1) & ((i == 0) | (F.get(m, i - 1) != 1)))
    ends = F.filter(idx, lambda i: (F.get(m, i) == 1) & ((i == n - 1) | (F.get(m, i + 1) != 1)))
    walked = F.arrays_zip(starts.alias("s"), F.transform(ends, lambda e: e + 1).alias("e"))
    one = F.array(F.struct(F.lit(0).alias("s"), F.col("_first0").alias("e")))
    runs = r.select(batch, F.explode(F.when(F.col("_more"), walked).otherwise(one)).alias("iv"))
    merged = runs.groupBy(batch).agg(F.array_sort(F.collect_list(F.struct(F.col("iv.s").alias("s"), F.col("iv.e").alias("e")))).alias("_iv"))
    reach = F.aggregate("_iv", F.lit(0), lambda acc, iv: F.when(iv["s"] <= acc, F.greatest(acc, iv["e"])).otherwise(acc))
    # Written, as the rows are shuffled for it without their other columns: that
    # shuffle is gone when the rows are shuffled again for the result.
    cut = written(merged.select(batch, reach.alias("_cut")), "batch-cuts")
    r = r.join(cut, batch, "left")
    width = F.least(F.coalesce(F.col("_cut"), F.lit(0)), F.size(mask))
    return r.withColumns({c: F.slice(c, 1, width) for c in [mask, *tensors]}).drop("_k", "_cut", "_first0", "_more")


def mask_labels(df: DataFrame, ids: str, pad_id: int, special_ids: Sequence[int] = (), out: str = "labels") -> DataFrame:
    """Labels = ids with pad (and listed special ids) replaced by -100."""
    return df.withColumn(out, A.replace_ids(ids, [pad_id, *special_ids], IGNORE_INDEX))


def padding_free_batch(df: DataFrame, ids: str, labels: str, mask: str, batch: str, order: str) -> DataFrame:
    """One row per batch: non-pad tokens concatenated, positions restarting per sequence.

    Labels are -100 at each sequence's first position; ``cu_seq_lens`` are the
    sequence starts plus the total length; ``max_length`` the longest sequence.
    A batch is a bounded group by construction (its batch size).
    """
    keep = lambda c: F.filter(c, lambda x, i: F.get(F.col(mask), i) == 1)
    per = df.select(batch, order, keep(F.col(ids)).alias("_i"), keep(F.col(labels)).alias("_l"))
    per = per.withColumn("_l", F.when(F.size("_l") > 0, F.concat(F.array(F.lit(IGNORE_INDEX)), F.slice("_l", 2, F.size("_l")))).otherwise(F.col("_l")))
    g = per.groupBy(batch).agg(F.array_sort(F.collect_list(F.struct(order, "_i", "_l"))).alias("_s"))
    sizes = F.filter(F.transform("_s", lambda s: F.size(s["_i"])), lambda n: n > 0)
    starts = F.aggregate(sizes, F.array().cast("array<int>"),
                         lambda acc, n: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + n)))
    return g.select(
        batch,
        F.flatten(F.transform("_s", lambda s: s["_i"])).alias("input_ids"),
        F.flatten(F.transform("_s", lambda s: F.transform(s["_i"], lambda x, i: i))).alias("position_ids"),
        F.flatten(F.transform("_s", lambda s: s["_l"])).alias("labels"),
        F.concat(F.array(F.lit(0)), starts).alias("cu_seq_lens"),
        F.array_max(sizes).alias("max_length"),
    )


def collate_reward_pairs(df: DataFrame, pad_id: int, batch: str = "batch_id", multiple_of: int | None = None) -> DataFrame:
    """Pad chosen and rejected ids / masks separately per batch; carry ``margin``."""
    need = ["input_ids_chosen", "attention_mask_chosen", "input_ids_rejected", "attention_mask_rejected"]
    if any(c not in df.columns for c in need):
        raise ValueError("reward pairs need the columns " + ", ".join(need))
    cols = {
        "input_ids_chosen": (pad_id, "right"), "attention_mask_chosen": (0, "right"),
        "input_ids_rejected": (pad_id, "right"), "attention_mask_rejected": (0, "right"),
    }
    out = pad_batch(df, cols, batch, multiple_of)
    if "margin" in df.columns:
        out = out.withColumn("margin", F.col("margin").cast("float"))
    return out


#: What pads a preference column, by its last part: decoder-only, then encoder-decoder.
PAD, LABEL, ZERO, PIXEL = "pad", "label", 0, 0.0
SUFFIX_PAD = {"input_ids": (PAD, LABEL), "labels": (LABEL, LABEL), "attention_mask": (ZERO, ZERO), "pixel_values": (PIXEL, None)}
#: Columns that end, not begin, with their tokens.
LEFT_PADDED = frozenset({"prompt_input_ids", "prompt_attention_mask"})


def preference_padding_rules(columns: Sequence[str], pad_id: int | None, label_pad_id: int = IGNORE_INDEX, encoder_decoder: bool = False) -> dict[str, tuple[int | float, str]]:
    """Padding value and side of every sequence column, from ``SUFFIX_PAD``; other columns have no rule."""
    rules: dict[str, tuple[int | float, str]] = {}
    for name in columns:
        suffix = next((x for x in SUFFIX_PAD if name.endswith("_" + x)), None)
        if suffix is None:
            continue
        what = SUFFIX_PAD[suffix][encoder_decoder]
        if encoder_decoder and suffix != "attention_mask":
            group = name.split("_", 1)[0]
            if group == "prompt" and suffix == "input_ids":
                what = PAD  # the encoder's own input
            elif group not in ("chosen", "rejected", "completion") and "decoder" not in name:
                what = None
            else:
                what = LABEL
        if what is None:
            raise ValueError(f"no padding is defined for column {name!r} of an encoder-decoder model")
        if what == PAD and pad_id is None:
            raise ValueError(f"column {name!r} needs a pad id")
        value = {PAD: pad_id, LABEL: label_pad_id}.get(what, what) if isinstance(what, str) else what
        rules[name] = (value, "left" if name in LEFT_PADDED and not encoder_decoder else "right")
    return rules


def collate_preference(df: DataFrame, pad_id: int | None, batch: str = "batch_id", label_pad_id: int = IGNORE_INDEX, encoder_decoder: bool = False) -> DataFrame:
    """Pad every sequence column per batch by the suffix rules; ``*_logps`` and others are carried."""
    rules = preference_padding_rules(df.columns, pad_id, label_pad_id, encoder_decoder)
    return pad_batch(df, rules, batch)


def add_bos_eos(df: DataFrame, bos_id: int | None, eos_id: int, prompts: Sequence[tuple[str, str]] = (("prompt_input_ids", "prompt_attention_mask"),),
                seqs: Sequence[tuple[str, str]] = (("input_ids", "attention_mask"),)) -> DataFrame:
    """BOS before each (ids, mask) pair of ``prompts`` and EOS after each of ``seqs``, where missing; absent pairs are skipped."""
    out = df
    for pairs, add, token in ((prompts, A.add_bos, bos_id), (seqs, A.add_eos, eos_id)):
        for ids, mask in pairs:
            if ids in df.columns:
                i, m = add(ids, mask, token)
                out = out.withColumns({ids: i, mask: m})
    return out
