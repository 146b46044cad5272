"""URL filter: rules first, then logistic regression on hashed character n-grams (native DataFrame operations only).

The model sees the n-grams of host and path, hashed to ``dims`` weights. It is
trained by full-batch gradient steps on a small labelled URL table: at most ``max_rows``
different urls (a documented bound), half of each class, by the order of a hash. A url
weighs as much as its copies, and a class as much as all its rows, so copies neither crowd out
other urls nor get lost. The weights that reach the driver and the plan number ``dims`` at any input size.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rewardlens.llm.common import lower_ascii, materialize

#: (host, path, verdict)
Rule = tuple[str, str, str]


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased; empty without ``://``."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _fits(host: Column, path: Column, rule: Rule) -> Column:
    h, p, _ = rule
    return ((host == h) | host.endswith("." + h)) & path.startswith(p)


def match_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; both null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        hit = _fits(host, path, r)
        name, verdict = F.when(hit, F.lit(r[0] + r[1])).otherwise(name), F.when(hit, F.lit(r[2])).otherwise(verdict)
    return name, verdict


def ngram_features(host: Column, path: Column, dims: int, n: int = 4) -> Column:
    """Hashed character n-grams of ``^host$`` and ``^path$``, the two told apart by a seed."""
    def grams(c: Column, tag: str) -> Column:
        s = F.concat(F.lit("^"), c, F.lit("$"))
        last = F.greatest(F.length(s) - (n - 1), F.lit(1))
        return F.transform(F.sequence(F.lit(1), last), lambda i: F.pmod(F.xxhash64(F.lit(tag), F.substr(s, i, F.lit(n))), F.lit(dims)).cast("int"))
    return F.concat(grams(host, "host"), grams(path, "path"))


def _margin(feats: Column, weights: list[float], bias: float) -> Column:
    w = F.from_json(F.lit(json.dumps(weights)), "array<double>")
    total = F.aggregate(feats, F.lit(0.0), lambda acc, i: acc + F.get(w, i))
    return total / F.sqrt(F.size(feats).cast("double")) + F.lit(bias)


def train(labelled: DataFrame, dims: int = 4096, max_rows: int = 4000, steps: int = 25, rate: float = 0.5) -> tuple[list[float], float]:
    """Weights and bias from ``labelled(host, path, y)``; y is 1 for allow, 0 for block.

    Rows with a null label are left out. No rows give zero weights, so every
    url then scores one half.
    """
    rows = labelled.filter(F.col("y").isNotNull()).select("host", "path", F.col("y").cast("double").alias("y"))
    counted = materialize(rows.groupBy("host", "path", "y").agg(F.count(F.lit(1)).alias("copies")), "url-counts")
    totals = {r["y"]: r["n"] for r in counted.groupBy("y").agg(F.sum("copies").alias("n")).collect()}  # a row for each class
    taken = None
    for y in sorted(totals):
        own = counted.filter(F.col("y") == y).orderBy(F.xxhash64("host", "path"), "host", "path").limit(max(1, max_rows // len(totals)))
        taken = own if taken is None else taken.unionByName(own)
    if taken is None:
        return [0.0] * dims, 0.0
    sample = materialize(taken.select("y", F.col("copies").cast("double").alias("copies"), ngram_features(F.col("host"), F.col("path"), dims).alias("f")), "url-train")
    of_class = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.sum("copies").alias("n")).collect()}
    scale = F.lit(1.0)
    for y, n in of_class.items():
        scale = F.when(F.col("y") == y, F.lit(totals[y] / n)).otherwise(scale)
    rows, n = sample.withColumn("weight", F.col("copies") * scale), float(sum(totals.values()))
    w, seen, bias, bias_seen = [0.0] * dims, [1e-8] * dims, 0.0, 1e-8
    for _ in range(steps):
        err = F.col("weight") * (F.col("y") - F.lit(1.0) / (1 + F.exp(-_margin(F.col("f"), w, bias))))
        e = rows.select(err.alias("e"), "f")
        step = (e.select((F.col("e") / F.sqrt(F.size("f").cast("double"))).alias("g"), F.explode("f").alias("i")).groupBy("i").agg(F.sum("g").alias("g"))
                .unionByName(e.groupBy(F.lit(-1).alias("i")).agg(F.sum("e").alias("g"))))
        for i, g in step.collect():  # at most dims + 1 rows
            g /= n
            if i < 0:
                bias_seen += g * g
                bias += rate * g / math.sqrt(bias_seen)
            else:
                seen[i] += g * g
                w[i] += rate * g / math.sqrt(seen[i])
    return [round(x, 9) for x in w], round(bias, 9)


def judge_urls(pages: DataFrame, rules: Sequence[Rule], labelled: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url",
               dims: int = 4096, max_rows: int = 4000, steps: int = 25) -> DataFrame:
    """Verdict of every url: ``(id_col, host, path, rule, verdict, score)``.

    A rule fits its host and every subdomain when the path starts with the
    rule's; the longest wins and decides. The rest goes to the model: ``allow``
    from a score of 0.5. ``labelled(host, path, y)`` trains it; without one, the
    urls that rules decide are the labels. A null url, or one without ``://``,
    has an empty host and path. Repeated rows keep a row each, other columns are
    not read, an empty table gives no rows, and urls of any length are read whole.
    """
    base = pages.select(F.col(id_col).alias("id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    rule, decided = match_rule(F.col("host"), F.col("path"), rules)
    base = base.withColumns({"rule": rule, "decided": decided})
    if labelled is None:
        labelled = base.filter(F.col("decided").isNotNull()).select("host", "path", (F.col("decided") == "allow").cast("int").alias("y"))
    w, bias = train(labelled, dims, max_rows, steps)
    score = 1 / (1 + F.exp(-_margin(F.col("f"), w, bias)))
    return (base.withColumn("f", ngram_features(F.col("host"), F.col("path"), dims)).withColumn("score", score)
            .select(F.col("id").alias(id_col), "host", "path", "rule",
                    F.coalesce("decided", F.when(F.col("score") >= 0.5, "allow").otherwise("block")).alias("verdict"), "score"))
