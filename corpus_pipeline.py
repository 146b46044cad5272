"""From raw documents to packed training sequences, as stages over written tables.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor
kept; between stages the rows are written as Parquet in the shared scratch folder
and read again, so ``docs`` is a table as read (row numbers come from its scan). All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rewardlens.llm.common import materialize, read
from rewardlens.llm.decontam import drop_contaminated
from rewardlens.llm.exact import drop_copies
from rewardlens.llm.langid import keep_identified
from rewardlens.llm.packing import pack
from rewardlens.llm.simhash import drop_near_copies

TOKENIZER = "byte_bpe_50k.json"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts of an identified language. Null texts, texts without a letter and texts that fit no learned language go.

    Repeated rows are judged alike and all stay; a null ``lang`` teaches nothing; without labelled rows no language
    is known and nothing stays. An empty table stays empty.
    """
    return keep_identified(docs, as_read=True)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of texts that are equal without white space: the longest, then that of the smallest id.

    Null texts are empty ones; a null id comes last; of wholly repeated rows the first written stays. An empty table stays empty.
    """
    return drop_copies(docs, as_read=True)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: that of the smallest id, a null id last, then the first written.

    Null, empty and blank texts have one fingerprint and are a group. An empty table stays empty.
    """
    return drop_near_copies(docs, as_read=True)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a passage of a benchmark item. Null texts hold none, null and short items stand in none; repeated rows go or stay together."""
    return drop_contaminated(docs, read(spark, sf_dir, "benchmark"), as_read=True)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows and their places in sequences of 1024 tokens. A null or empty text is its end id; every row, repeated or with a null id, has its pieces."""
    return pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("simhash_dedup", simhash_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL cannot express the language model, the SimHash groups or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
