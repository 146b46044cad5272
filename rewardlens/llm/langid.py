"""Language identification by prediction by partial matching.

One frozen byte-context model for each language (``ppm``); a text goes to the
language whose model codes it in the fewest bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rewardlens.llm.common import columns, fresh, materialize, numbered_rows, without
from rewardlens.llm.ppm import count_events, fit, score_texts
from rewardlens.session import ship_package


#: Longest context of the language models, in bytes.
ORDER = 5
#: Texts of fewer bytes are too little to tell a foreign text by.
SHORT = 32
#: A text may take so many times the bits a byte of its language's labelled texts, of which this share may be odd ones.
SLACK = 2.0
ODD = 0.01


def held_out(key: Column, buckets: int, which: int = 2) -> Column:
    """Whether crc32 of the key as text falls on ``which`` of ``buckets``; a null key counts as the empty text."""
    return (F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % buckets) == which


def languages(rows: DataFrame, lessons: DataFrame | None = None) -> DataFrame:
    """``rows`` without ``text`` and ``lesson``, with ``lang_pred``, ``lang_score`` and ``lang_bits``.

    Lessons are the rows with a non-null ``lesson`` (their label) and those of
    ``lessons(label, text)``. Predictions read the text alone. The language is
    ``und`` with score 0 for a null text, one without a letter, or when there was
    nothing to learn from; an empty table gives no rows, and repeated rows keep a row
    each. The score is the language's posterior probability under equal
    priors; ties go to the first label in order. The bits are the code length.
    """
    ship_package(rows.sparkSession)
    counted = rows.select(F.col("lesson").cast("string").alias("label"), "text")
    if lessons is not None:
        counted = counted.unionByName(lessons.select(F.col("label").cast("string").alias("label"), "text").filter("label is not null"))
    model = fit(count_events(counted, ORDER), ORDER)
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    scored = score_texts(rows.withColumn("_letters", letters).drop("lesson"), model, "text", "_each")
    if not model.labels:
        return scored.drop("_each", "_letters").withColumns({"lang_pred": F.lit("und"), "lang_score": F.lit(0.0), "lang_bits": F.lit(0.0)})
    best = scored.withColumn("lang_bits", F.array_min("_each"))
    at = F.array_position("_each", F.col("lang_bits")).cast("int")
    post = 1 / F.aggregate("_each", F.lit(0.0), lambda a, b: a + F.pow(F.lit(2.0), F.col("lang_bits") - b))
    return best.withColumns({
        "lang_pred": F.when(F.col("_letters"), F.element_at(F.array(*[F.lit(x) for x in model.labels]), at)).otherwise("und"),
        "lang_score": F.when(F.col("_letters"), post).otherwise(F.lit(0.0))}).drop("_each", "_letters")


def identify(docs: DataFrame, train: DataFrame | Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """``(id_col, lang_pred, score, bits)`` for every row of ``docs``; only its id and text are read.

    ``train`` is a table with ``label_col`` and ``text_col``, or the label of those
    rows of ``docs`` that are lessons, as an expression: then texts are read once less.
    """
    own = train if isinstance(train, Column) else F.lit(None).cast("string")
    lessons = None if isinstance(train, Column) else train.select(F.col(label_col).alias("label"), F.col(text_col).alias("text"))
    rows = languages(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), own.alias("lesson")), lessons)
    return rows.select(F.col("id").alias(id_col), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_bits").alias("bits"))


def fit_limits(rows: DataFrame, label: Column, rate: Column) -> dict[str, float]:
    """For each label the most bits a byte that a text of it may take, from the fits ``rate`` of all labelled ``rows``.

    ``SLACK`` times the fit that all but ``ODD`` of the label's texts reach, at
    most the eight bits of a code without any model. Fits are counted in bins,
    so labels times bins is what reaches the driver.
    """
    bins: dict[str, list] = {}
    for r in rows.groupBy(label.alias("label"), F.ceil(rate * 16).alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect():
        bins.setdefault(r["label"], []).append((r["bin"], r["n"]))
    limits = {}
    for name, own in bins.items():
        left = int(sum(n for _, n in own) * ODD)  # texts that may lie above
        for at, n in sorted(own, reverse=True):
            if n > left:
                break
            left -= n
        limits[name] = min(8.0, SLACK * at / 16)
    return limits


def keep_identified(docs: DataFrame, text_col: str = "text", label_col: str = "lang", least: float = 0.0, as_read: bool = False) -> DataFrame:
    """The rows of ``docs`` whose text has a language; learns from the labelled rows.

    Texts judged ``und`` go, those whose language has less than ``least``
    probability, and those that fit none of the languages: their best model
    takes more bits a byte than ``fit_limits`` allows for its language. The
    default keeps a text that two languages could have written: it is undecided,
    not foreign. A text under ``SHORT`` bytes is too little to tell and is kept
    for its letters. Labelled texts are lessons, so a labelled text fits as far
    as the model has learned it. Rows are numbered in a written copy, or in place
    if ``docs`` is a table ``as_read``.
    """
    row = fresh(docs, "row")
    numbered = numbered_rows(docs, row, as_read, "lang-rows")
    size = F.octet_length(text_col)
    judged = languages(numbered.select(F.col(row).alias("row"), F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("lesson"),
                                       F.col(label_col).cast("string").alias("label"), size.alias("size")))
    judged = materialize(judged, "lang-fits")
    fits = judged.filter((F.col("lang_pred") != "und") & (F.col("lang_score") >= least))
    rate = F.col("lang_bits") / F.col("size")
    limits = fit_limits(fits.filter(F.col("label").isNotNull() & (F.col("size") >= SHORT)), F.col("label"), rate)
    limit = F.lit(8.0)
    for name, most in sorted(limits.items()):
        limit = F.when(F.col("lang_pred") == name, F.lit(most)).otherwise(limit)
    good = (F.col("lang_pred") != "und") & (F.col("lang_score") >= least) & ((F.col("size") < SHORT) | (rate <= limit))
    bad = judged.filter(~F.coalesce(good, F.lit(False))).select(F.col("row").alias(row))
    return without(numbered, bad, row, "lang-gone").select(*columns(docs))
