"""Personal data: patterns for the plain kinds, then bootstrapped contextual extraction.

*Base spans* are emails, IP addresses, card and phone numbers found by fixed patterns.

*Bootstrapping.* Identifier-shaped tokens (with a digit, at least
``MIN_INSTANCE`` characters) and the base spans are instances. The words around an
instance are its lexical patterns: the word before, the two words before, and the
words on both sides. Patterns and instances form a graph. Seed instances (base
spans) count fully for their kind. In each round a pattern's score for a kind is
the weight of its different instances of that kind over this weight and the number of
its instances that contradict it: base spans of other kinds, and tokens that do not look
like the kind (``looks_like``). Unknown tokens that do look like it count neither way.
Patterns of ``MIN_SUPPORT`` sure instances and a score of at least ``SURE`` are kept, and
an instance takes the best score of its kept
patterns. At the end the kept patterns mark the instances, not yet covered, that
stand in them. A common word has years, amounts and names with digits beside it, so it
stays below ``SURE``. Graph tables hold a row for each different (pattern, instance), so a
number repeated in a third of all texts counts once.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rewardlens.llm.common import materialize
from rewardlens.llm.textbatch import slices
from rewardlens.session import ship_package

KINDS = ("email", "ip", "card", "phone")
MIN_INSTANCE = 5
MIN_SUPPORT = 3
SURE = 0.8
ROUNDS = 3
#: Words and instances of more characters stand under their digests.
NAMED = 256

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_HINT = re.compile(r"[0-9@]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = ".,;:!?\"'()[]{}<>"
_PHONE_LIKE = re.compile(r"[+0-9().\x20/-]+")
_NUMBER = re.compile(r"[0-9]+[.,][0-9]+|(?:19|20)[0-9]{2}[-/](?:19|20)[0-9]{2}|[0-9]{4}([-./])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-./])[0-9]{1,2}\2(?:[0-9]{2}){1,2}")
_IP_LIKE = re.compile(r"[0-9]+(?:\.[0-9]+){2,}|[0-9a-fA-F]*(?::[0-9a-fA-F]*){2,}")
_CARD_LIKE = re.compile(r"[0-9xX*\x20-]+")
_AT = re.compile(r"@|[(\[]at[)\]]", re.IGNORECASE)


def looks_like(token: str) -> list[str]:
    """The kinds that a token without a kind of its own might be, in another notation; amounts, dates and years are none."""
    digits = len(_NOT_DIGIT.sub("", token))
    out = ["email"] if _AT.search(token) else []
    if _NUMBER.fullmatch(token):
        return out
    if _IP_LIKE.fullmatch(token):
        return [*out, "ip"]
    if _CARD_LIKE.fullmatch(token) and 12 <= len(re.sub(r"[\x20-]", "", token)) <= 19:
        out.append("card")
    if _PHONE_LIKE.fullmatch(token) and (9 if digits == len(token) else 7) <= digits <= 15:
        out.append("phone")
    return out


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from each ``@`` so that long runs stay linear."""
    out, low = [], 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > low and text[begin - 1] in _LOCAL:
            begin -= 1
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            out.append((begin, m.end()))
        low = m.end() if m else at + 1
        at = text.find("@", low)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans by kind in the order of ``KINDS``, then by start; code points, end exclusive."""
    if not _HINT.search(text):
        return []
    out = [("email", a, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 or int(p.lstrip("0")[:4] or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 13 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def _named(word: str) -> str:
    """The word itself, or, where it is too long to be a name in graph tables, its digest."""
    return word if len(word) <= NAMED else "#" + hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def _patterns(left: list[str], right: list[str]) -> list[str]:
    """Lexical patterns of the words left and right of an instance; ``_`` is the instance."""
    out = []
    if left:
        out.append(f"{left[-1]} _")
        if len(left) > 1:
            out.append(f"{left[-2]} {left[-1]} _")
        if right:
            out.append(f"{left[-1]} _ {right[0]}")
    return out


def _neighbours(text: str, found: list[tuple[int, int]]) -> Iterator[tuple[list[str], list[str]]]:
    """The two words before each span and the one after it, whole; a span's own token counts up to the spans next to it."""
    spans = [m.span() for m in _WORD.finditer(text)]
    starts = [a for a, _ in spans]
    begins, ends = sorted(a for a, _ in found), sorted(b for _, b in found)
    for a, b in found:
        left, right = [], []
        w = bisect_left(starts, a) - 1
        while w >= 0 and len(left) < 2:
            low, high = spans[w]
            if high > a:  # the span's own token
                at = bisect_right(ends, a)
                low, high = max([low, *ends[max(0, at - 1):at]]), a
            if low < high:
                left.insert(0, _named(text[low:high].lower()))
            w -= 1
        w = max(0, bisect_right(starts, b) - 1)
        while w < len(spans) and not right:
            low, high = max(spans[w][0], b), spans[w][1]
            if spans[w][0] < b < high:
                at = bisect_left(begins, b)
                high = min([high, *begins[at:at + 1]])
            if low < high and text[low:high].strip(_EDGE):
                right.append(_named(text[low:high].lower()))
            w += 1
        yield left, right


def mentions(text: str, spans: list[tuple[str, int, int]]) -> Iterator[tuple[int, int, str, str | None, list[str]]]:
    """(start, end, instance, kind or None, patterns) of base spans and identifier-shaped tokens."""
    if not spans and not _HINT.search(text):
        return
    found = [(a, b, k) for k, a, b in spans]
    covered = sorted((a, b) for a, b, _ in found)
    c = 0
    for m in _WORD.finditer(text):
        if not _DIGIT.search(text, m.start(), m.end()):
            continue
        while c < len(covered) and covered[c][1] <= m.start():
            c += 1
        if c < len(covered) and covered[c][0] < m.end():
            continue
        a = m.start() + len(m[0]) - len(m[0].lstrip(_EDGE))
        b = a + len(m[0].strip(_EDGE))
        if b - a >= MIN_INSTANCE:
            found.append((a, b, None))
    for (a, b, kind), (left, right) in zip(found, _neighbours(text, [(a, b) for a, b, _ in found])):
        yield a, b, _named(text[a:b].lower()), kind, _patterns(left, right)


def extract(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row for each row of ``docs``: base spans and, as an array, its mentions."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 16 << 20):
                cols: list[list] = [[], [], [], [], [], [], []]
                for text in part.column("text").to_pylist():
                    text = text or ""
                    spans = base_spans(text)
                    kinds = [k for k, _, _ in spans]
                    said = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
                    row = (*[kinds.count(k) for k in KINDS], hashlib.sha256(said.encode()).hexdigest(), said,
                           [{"a": a, "b": b, "instance": i, "kind": k, "looks": [] if k else looks_like(text[a:b].lower()), "patterns": p} for a, b, i, k, p in mentions(text, spans)])
                    for c, v in zip(cols, row):
                        c.append(v)
                yield pa.RecordBatch.from_arrays(
                    [part.column("rid"), part.column("id"), *[pa.array(c, pa.int64()) for c in cols[:4]], pa.array(cols[4], pa.string()),
                     pa.array(cols[5], pa.string()), pa.array(cols[6], _MENTIONS)],
                    ["rid", "id", *[f"n_{k}" for k in KINDS], "base_sha256", "base", "mentions"])

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(task, f"rid long, id {kind}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, base string, "
                                 "mentions array<struct<a: long, b: long, instance: string, kind: string, looks: array<string>, patterns: array<string>>>")


_MENTIONS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("instance", pa.string()), ("kind", pa.string()), ("looks", pa.list_(pa.string())), ("patterns", pa.list_(pa.string()))]))


def bootstrap(edges: DataFrame, seeds: DataFrame, looks: DataFrame, rounds: int = ROUNDS, support: int = MIN_SUPPORT, sure: float = SURE) -> DataFrame:
    """Kept ``(pattern, kind, score)`` from distinct ``edges(pattern, instance)``, ``seeds(instance, kind)`` and ``looks(instance, kind)``.

    ``looks`` has the kinds that instances without a kind might be.
    """
    degree = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("degree"))
    first = seeds.withColumn("weight", F.lit(1.0))
    undecided = looks.join(seeds.select("instance"), "instance", "left_anti")
    weights, kept = first, None
    for _ in range(rounds):
        # an instance of the kind has a weight; one that only looks like it is left out; all others contradict
        known = weights.select("instance", "kind", "weight")
        alike = undecided.join(weights, ["instance", "kind"], "left_anti").select("instance", "kind", F.lit(0.0).alias("weight"))
        votes = (edges.join(known.unionByName(alike), "instance").groupBy("pattern", "kind")
                 .agg(F.sum("weight").alias("total"), F.count_if(F.col("weight") >= sure).alias("backed"), F.count(F.lit(1)).alias("fit")))
        kept = materialize(
            votes.filter(F.col("backed") >= support).join(degree, "pattern")
            .withColumn("score", F.col("total") / (F.col("total") + F.col("degree") - F.col("fit")))
            .filter(F.col("score") >= sure).select("pattern", "kind", "score"), "pii-patterns")
        reached = edges.join(kept, "pattern").groupBy("instance", "kind").agg(F.max("score").alias("weight"))
        new = reached.join(first, "instance", "left_anti")
        weights = materialize(first.unionByName(new.select(*first.columns)), "pii-weights")
    return kept


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS,
                       support: int = MIN_SUPPORT, sure: float = SURE) -> DataFrame:
    """``(id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans)`` for every row of ``docs``.

    Counts and digest are of the base spans; ``spans`` adds those of the method,
    all as ``kind:start:end`` by kind, then start. A null text is empty; repeated
    rows and ids keep a row each; other columns are not read.
    """
    ship_package(docs.sparkSession)
    rows = materialize(extract(docs, id_col, text_col), "pii-rows")
    said = materialize(rows.filter(F.size("mentions") > 0).select("rid", F.explode("mentions").alias("m")).select("rid", "m.*"), "pii-mentions")
    edges = materialize(said.select("instance", F.explode("patterns").alias("pattern")).distinct(), "pii-edges")
    seeds = materialize(said.filter(F.col("kind").isNotNull()).select("instance", "kind").distinct(), "pii-seeds")
    looks = materialize(said.filter(F.col("kind").isNull()).select("instance", F.explode("looks").alias("kind")).distinct(), "pii-looks")
    kept = bootstrap(edges, seeds, looks, rounds, support, sure)
    open_ = said.filter(F.col("kind").isNull()).select("rid", "a", "b", F.explode("patterns").alias("pattern"))
    marked = open_.join(kept.withColumnRenamed("kind", "found"), "pattern").groupBy("rid", "a", "b").agg(
        F.max(F.struct("score", "found")).alias("best"))
    added = marked.groupBy("rid").agg(F.collect_list(F.struct(F.col("best.found").alias("kind"), "a", "b")).alias("new"))
    order = F.array(*[F.lit(k) for k in KINDS])

    def keyed(s):
        return F.struct(F.array_position(order, s["kind"]).alias("at"), s["a"].alias("a"), s["b"].alias("b"), s["kind"].alias("kind"))

    own = F.transform(F.filter("mentions", lambda m: m["kind"].isNotNull()), keyed)
    extra = F.transform(F.coalesce("new", F.array().cast("array<struct<kind: string, a: long, b: long>>")), keyed)
    text = F.array_join(F.transform(F.array_sort(F.concat(own, extra)), lambda s: F.concat_ws(":", s["kind"], s["a"].cast("string"), s["b"].cast("string"))), ",")
    return rows.join(added, "rid", "left").select(
        F.col("id").alias(id_col), *[f"n_{k}" for k in KINDS], "base_sha256",
        F.when(F.col("new").isNull(), F.col("base")).otherwise(text).alias("spans"))
