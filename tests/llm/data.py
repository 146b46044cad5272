"""Small awkward tables and plain brute-force versions of the operators."""

import math
import random
import re

from pyspark.sql import types as T

SPACE = re.compile(r"[\x20\x09-\x0D]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use themselves
    T.StructField("rid", T.StringType()), T.StructField("id", T.StringType()), T.StructField("row", T.LongType()),
    T.StructField("fp", T.DoubleType()), T.StructField("h", T.StringType()), T.StructField("a.b", T.LongType()),
    T.StructField("lang_pred", T.StringType()), T.StructField("lang_each", T.StringType()),
])


def words(text, lower=False):
    t = text or ""
    return WORD.findall(t.translate(LOWER) if lower else t)


def prose(rng, n, stock="en"):
    parts = {"en": ["the", "of", "ing", "th", "er", "an", "was", "sh"], "de": ["ung", "der", "ä", "sch", "und", "keit", "ß", "ver"]}[stock]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))


def rows():
    """(doc_id, text, lang): prose, copies, near copies, shared passages, and odd texts."""
    rng = random.Random(7)
    out = []
    for i in range(40):
        lang = "en" if i % 2 else "de"
        out.append((i, prose(rng, rng.randint(20, 200), lang), lang))
    passage = prose(rng, 60)
    base = prose(rng, 120)
    for i in range(40, 50):
        out.append((i, prose(rng, 15) + " " + passage + " " + prose(rng, 15), "en"))
    for i in range(50, 58):  # near copies: one word changed
        w = base.split()
        w[i] = "zzz"
        out.append((i, " ".join(w), "en"))
    for i in range(58, 70):  # exact copies but for white space
        out.append((i, ("\n" if i % 2 else "  ").join(base.split()), "en"))
    out += [(70, None, "en"), (71, "", None), (72, " \t\n ", "de"), (73, "Ünïcode \u00a0 text é\u3000中文", None), (74, "a", "en"),
            (75, "12 34 !!", "en"), (76, prose(rng, 20000), "en"), (77, "the same", "en"), (77, "the same", "en"), (78, "x" * 50000, "de"),
            (None, base, "en"), (None, None, None), (79, "the the the the the the the the the the the the the the the the", "en")]
    return out


def table(spark, data=None, partitions=3):
    data = rows() if data is None else data
    full = [(i, t, lang, f"src{k % 3}", len(t) if t else None, "x", None, 5, 0.5, "h", 1, "p", "e") for k, (i, t, lang) in enumerate(data)]
    return spark.createDataFrame(full, SCHEMA).repartition(partitions)


def stored(spark, tmp_path, data=None, name="documents"):
    """The table as files, since row numbers of several operators come from the scan."""
    path = f"{tmp_path}/{name}.parquet"
    table(spark, data).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def luhn(digits):
    total = 0
    for i, c in enumerate(digits[::-1]):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def log10(x):
    return math.log10(x)
