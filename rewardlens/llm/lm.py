"""Language-model scores: a word unigram baseline and a pretrained byte-context PPM model.

Word counts and byte contexts cover every training text (``ppm``). The most frequent words, at
most ``hot_words``, go to every task; the words of a text that are not among them
are looked up exactly by a join with the whole vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rewardlens.llm.common import materialize, most_frequent
from rewardlens.llm.ppm import count_events, fit
from rewardlens.llm.ppm import score_texts as code_lengths_of
from rewardlens.llm.textbatch import LOWER, Words, slices, text_buffer
from rewardlens.session import ship_package

HOT_WORDS = 1 << 18
HOT_WORD_BYTES = 64


def _words(part: pa.RecordBatch) -> Words:
    buf, offs = text_buffer(part.column("text"))
    return Words(LOWER[buf], offs)


def word_counts(texts: DataFrame) -> DataFrame:
    """``(word, c)`` over all rows of ``texts(text)``, A-Z lower-cased."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 8 << 20):
                seen = pc.value_counts(_words(part).array())
                yield pa.RecordBatch.from_arrays([seen.field("values"), seen.field("counts")], ["word", "n"])

    return texts.select("text").mapInArrow(task, "word string, n long").groupBy("word").agg(F.sum("n").alias("c"))


def score_texts(docs: DataFrame, lesson: Column, id_col: str = "doc_id", text_col: str = "text", hot_words: int = HOT_WORDS) -> DataFrame:
    """Base and model scores of every row of ``docs``; rows where ``lesson`` is true are learned from.

    ``(id_col, n_tokens, n_known, train_tokens, base_score, score)``. Tokens are
    the lower-cased words and one end token. ``base_score`` sums
    log10((c+1) / (N+V+1)); ``score`` is log10 of the PPM probability of the
    text's bytes, 0 for an empty text. A null text is empty. Without training
    rows N and V are 0. Repeated ids keep a row each; other columns are not read.
    """
    spark = docs.sparkSession
    ship_package(spark)
    taught = F.coalesce(lesson, F.lit(False))
    lessons = docs.filter(taught).select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    vocab = materialize(word_counts(lessons), "lm-vocab")
    n_docs = lessons.count()
    n_words, n_types = vocab.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("c")).first()
    big_n, big_v = n_words + n_docs, n_types + (n_docs > 0)
    model = fit(count_events(docs.select(F.when(taught, F.lit("all")).alias("label"), F.col(text_col).alias("text"))))
    hot = most_frequent(vocab.filter(F.octet_length("word") <= HOT_WORD_BYTES), "c", hot_words).toArrow()
    sent = spark.sparkContext.broadcast((hot.column("word").combine_chunks(), np.log10(hot.column("c").to_numpy() + 1.0)))

    def looked_up(part: pa.RecordBatch) -> list[pa.Array]:
        words, logs = sent.value
        logs = np.r_[logs, 0.0]
        w = _words(part)
        own = w.array()
        code = pc.index_in(own, value_set=words).fill_null(len(words)).to_numpy(zero_copy_only=False)
        known = np.r_[0, np.cumsum(code < len(words))]
        total = np.r_[0.0, np.cumsum(logs[code])]
        missed = np.flatnonzero(code == len(words))
        off = np.searchsorted(missed, w.row).astype(np.int32)
        rare = pa.ListArray.from_arrays(pa.array(off), own.take(pa.array(missed)))
        at = w.row
        return [pa.array(np.diff(at) + 1), pa.array(np.diff(known[at])), pa.array(np.diff(total[at])), rare]

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    coded = code_lengths_of(rows, model, "text", "each", looked_up, "n_tokens long, hot_known long, hot_sum double, rare array<string>")
    scored = materialize(coded.withColumns({"rid": F.monotonically_increasing_id(), "bits": F.coalesce(F.get("each", 0), F.lit(0.0))}).drop("each"), "lm-scored")
    rest = (scored.select("rid", F.explode("rare").alias("word")).join(vocab, "word", "left").groupBy("rid")
            .agg(F.count("c").alias("rare_known"), F.sum(F.log10(F.coalesce("c", F.lit(0)) + 1.0)).alias("rare_sum")))
    end = float(np.log10(n_docs + 1.0))
    whole = float(np.log10(big_n + big_v + 1.0))
    return scored.drop("rare").join(rest, "rid", "left").select(
        F.col("id").alias(id_col), "n_tokens",
        (F.col("hot_known") + F.coalesce("rare_known", F.lit(0)) + int(n_docs > 0)).alias("n_known"),
        F.lit(int(big_n)).cast("long").alias("train_tokens"),
        (F.col("hot_sum") + F.coalesce("rare_sum", F.lit(0.0)) + end - F.col("n_tokens") * whole).alias("base_score"),
        (-F.col("bits") * float(np.log10(2.0))).alias("score"))
