"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

*Seeds.* An alignment of ``m`` matches and ``e`` edits has at most ``e + 1`` unbroken
stretches, so it keeps at least ``m - e - 1`` pairs of neighbouring item words: one
less than its score. Of the pairs that the least score asks for, half may be missing
and the other half still be found, so every item gives up that many of its pairs:
the most frequent ones, by the documents that hold a pair times the items that do,
counted over the whole corpus. The other, rarer pairs are its seeds. A passage that counts has as many seeds as
are then left, and their offsets between document and item differ by at most
``e``, which is no more than the item's words less the least score. A place without so
many seeds so close holds no passage that counts; nothing else is left out.

*Join.* Items come in blocks of at most ``BLOCK_WORDS`` words; a block's seeds
and words go to every task (a proven size), where documents meet them. Each block
meets all documents twice, once to count and once to align.
Nothing is shuffled, so a passage that stands in a third of all documents is no
hot key. What a document and the items make of frequent seeds is worked off in parts of ``HITS``.

*Alignment.* Around the seeds of one item a passage of the document is aligned
with the item's words: match 1, mismatch and gap -1, local. A passage counts
when its score is at least ``MIN_SHARE`` of the item's words (of at most
``LONG_ITEM`` words, so that an excerpt of a long item counts too). What is left
of the place on both sides is aligned again. Words are
compared in lower case without ASCII punctuation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rewardlens.llm.common import columns, fresh, materialize, numbered_rows, without
from rewardlens.llm.textbatch import U64, Words, inside_row, slices, text_buffer, window_hashes
from rewardlens.session import ship_package

SEED_WORDS = 2
#: Meetings of a document's and an item's seed that are looked at together.
HITS = 1 << 20
BLOCK_WORDS = 1 << 20
MIN_SHARE = 0.5
MIN_SCORE = 5
LONG_ITEM = 50

PLAIN = np.arange(256, dtype=np.uint8)
PLAIN[[b for b in range(33, 127) if not chr(b).isalnum()]] = 32


def _words(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all rows, and where each row begins."""
    buf, offs = text_buffer(pc.utf8_lower(col))
    w = Words(PLAIN[buf], offs)
    return w.hashes(), w.row


class Items:
    """The words and word pairs of a block of benchmark items."""

    def __init__(self, ids: list, texts: list):
        self.ids = ids
        self.hash, self.row = _words(pa.array(texts, pa.string()))
        self.size = np.diff(self.row)
        self.need = np.array([least_score(int(w)) for w in self.size])
        #: pairs that a passage keeps, how many of them may be no seeds, and how many seeds it has then
        pairs = np.ceil(self.need).astype(np.int64) - 1
        self.spared = pairs // 2
        self.seeds = pairs - self.spared
        at = np.flatnonzero(inside_row(self.row, SEED_WORDS, len(self.hash)))
        item = np.searchsorted(self.row, at, "right") - 1
        at, item = (x[self.size[item] >= MIN_SCORE] for x in (at, item))  # shorter ones never match
        self._set(window_hashes(self.hash, SEED_WORDS)[at], item, at - self.row[item])

    def _set(self, gram: np.ndarray, item: np.ndarray, pos: np.ndarray) -> None:
        by = np.lexsort((pos, item, gram))
        self.gram, self.item, self.pos = gram[by], item[by], pos[by]

    def words(self, item: int) -> np.ndarray:
        return self.hash[self.row[item]:self.row[item + 1]]

    def keep_rare(self, gram: np.ndarray, documents: np.ndarray) -> None:
        """Drop each item's most frequent pairs, as many as it may spare; ``documents`` hold each (sorted) ``gram``."""
        at = np.minimum(np.searchsorted(gram, self.gram), max(len(gram) - 1, 0))
        held = np.where(gram[at] == self.gram, documents[at], 0) if len(gram) else np.zeros(len(self.gram), np.int64)
        _, which = np.unique(self.gram, return_inverse=True)
        in_items = np.bincount(np.unique(np.stack([which, self.item]), axis=1)[0], minlength=len(which)) if len(which) else which
        cost = held * in_items[which]
        by = np.lexsort((self.pos, -cost, self.item))  # an item's most frequent pairs first
        item = self.item[by]
        rank = np.arange(len(by)) - np.searchsorted(item, item)
        keep = by[rank >= self.spared[item]]
        self._set(self.gram[keep], self.item[keep], self.pos[keep])

    def of_items(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Seeds (gram, item, position) of the items from ``low`` up to ``high``."""
        own = (self.item >= low) & (self.item < high)
        return self.gram[own], self.item[own], self.pos[own]


def _hits(part: pa.RecordBatch, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions whose n-gram is in sorted ``grams``, and which; the rows' words and begins."""
    h, row = _words(part.column("text"))
    g = window_hashes(h, SEED_WORDS)
    if not len(g) or not len(grams):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), h, row
    # a small bit table first: most windows are in no item
    table = np.zeros(1 << 20, bool)
    table[(grams >> U64(44)).astype(np.int64)] = True
    may = np.flatnonzero(table[(g >> U64(44)).astype(np.int64)] & inside_row(row, SEED_WORDS, len(h)))
    at = np.minimum(np.searchsorted(grams, g[may]), len(grams) - 1)
    ok = grams[at] == g[may]
    return may[ok], at[ok], h, row


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Best local score of ``item`` in ``passage`` and the end of its alignment there."""
    m = len(passage)
    step = np.arange(m + 1)
    above, best, end = np.zeros(m + 1, np.int64), 0, 0
    for w in item:
        here = np.zeros(m + 1, np.int64)
        here[1:] = np.maximum(above[:-1] + np.where(passage == w, 1, -1), above[1:] - 1)
        np.maximum(here, 0, out=here)
        here = np.maximum.accumulate(here + step) - step
        top = int(here.argmax())
        if here[top] > best:
            best, end = int(here[top]), top
        above = here
    return best, end


def least_score(words: int) -> float:
    return max(MIN_SCORE, MIN_SHARE * min(words, LONG_ITEM))


def _passages(docs: np.ndarray, item: np.ndarray, diag: np.ndarray, block: Items) -> Iterator[tuple[int, int, int, int]]:
    """(document, item, first, last) of the merged places with enough seeds of one item, in document words."""
    by = np.lexsort((diag, item, docs))
    docs, item, diag = docs[by], item[by], diag[by]
    size = block.size[item]
    drift = np.floor(size - block.need[item]).astype(np.int64)
    last = np.arange(len(docs)) + block.seeds[item] - 1
    end = np.minimum(last, len(docs) - 1)
    dense = np.flatnonzero((last < len(docs)) & (docs[end] == docs) & (item[end] == item) & (diag[end] - diag <= drift))
    docs, item, low, high = docs[dense], item[dense], (diag - drift)[dense], (diag + drift + size)[dense]
    i = 0
    while i < len(docs):
        j, top = i + 1, high[i]
        while j < len(docs) and docs[j] == docs[i] and item[j] == item[i] and low[j] <= top:
            top = max(top, high[j])
            j += 1
        yield int(docs[i]), int(item[i]), int(low[i]), int(top)
        i = j


def _aligned(item: np.ndarray, own: np.ndarray, doc: np.ndarray, first: int, last: int, need: float) -> Iterator[tuple[int, int, int]]:
    """(score, first, last) of the passages of ``item`` (sorted: ``own``) in words ``first`` to ``last`` of ``doc``."""
    left = [(first, last)]
    while left:
        a, b = left.pop()
        passage = doc[a:b]
        common = own[np.minimum(np.searchsorted(own, passage), len(own) - 1)] == passage
        if common.sum() < need:
            continue
        score, end = align(item, passage)
        if score >= need:
            _, back = align(item[::-1], passage[:end][::-1])
            yield score, a + end - back, a + end
            left += [(a, a + end - back), (a + end, b)]


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(rid, id_col, item_id, score, share, item_words, first_word, last_word)``: one row for each aligned passage.

    ``score`` is the alignment's, ``share`` the score over the item's words,
    ``first_word`` and ``last_word`` bound the passage in the document's words
    (punctuation dropped, last exclusive). Items of fewer than ``MIN_SCORE``
    words cannot be told from chance and never match; null texts hold no word.
    Repeated rows, ids and items give a row each. Other columns are not read.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    bench = materialize(items.select(F.col(item_id).alias("id"), F.coalesce(F.col(item_text), F.lit("")).alias("text")), "leak-items")
    size = bench.agg(F.sum(F.size(F.split("text", r"\s+")).cast("long"))).first()[0] or 0
    blocks = 1 + size // BLOCK_WORDS
    kind, item_kind = (t.schema["id"].dataType.simpleString() for t in (rows, bench))
    out = None
    for b in range(blocks):
        own = bench.filter(F.pmod(F.xxhash64("id", "text"), F.lit(2 * blocks)).isin(2 * b, 2 * b + 1)).orderBy("id", "text").toArrow()  # about BLOCK_WORDS words
        block = Items(own.column("id").to_pylist(), own.column("text").to_pylist())
        pairs = spark.sparkContext.broadcast(np.unique(block.gram))
        counts = rows.mapInArrow(_count_task(pairs), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()  # at most a block's pairs
        gram, n = counts.column("gram").to_numpy().astype(np.int64).view(U64), counts.column("n").to_numpy()
        by = np.argsort(gram)
        block.keep_rare(gram[by], n[by])
        ready = spark.sparkContext.broadcast(block)
        found = rows.mapInArrow(_align_task(ready, own.schema.field("id").type), f"rid long, id {kind}, item_id {item_kind}, score long, item_words long, first_word long, last_word long")
        out = found if out is None else out.unionByName(found)
    return out.select("rid", F.col("id").alias(id_col), F.col("item_id").alias(item_id), "score", (F.col("score") / F.col("item_words")).alias("share"),
                      "item_words", "first_word", "last_word")


def _count_task(pairs):
    """In how many documents of the task each of the sorted ``pairs`` stands."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = pairs.value
        total = np.zeros(len(grams), np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                places, which, _, row = _hits(part, grams)
                doc = np.searchsorted(row, places, "right") - 1
                once = np.unique(doc * np.int64(len(grams) or 1) + which)
                total += np.bincount(once % (len(grams) or 1), minlength=len(grams))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(grams[some].view(np.int64)), pa.array(total[some])], ["gram", "n"])

    return task


def _align_task(ready, id_type: pa.DataType):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = ready.value
        grams, first = np.unique(block.gram, return_index=True)
        many = np.diff(np.r_[first, len(block.gram)])
        sorted_words = {}

        def meetings(places: np.ndarray, which: np.ndarray, row: np.ndarray, first: np.ndarray, many: np.ndarray, item: np.ndarray, pos: np.ndarray):
            """Documents, items and offsets of the seeds ``which`` at ``places``."""
            n = many[which]
            at = np.repeat(places, n)
            seed = np.repeat(first[which], n) + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            doc = np.searchsorted(row, at, "right") - 1
            return doc, item[seed], at - row[doc] - pos[seed]

        def parts_of(places: np.ndarray, which: np.ndarray, row: np.ndarray):
            """All meetings, in parts of about ``HITS``: whole documents, or one document and a range of items."""
            owner = np.searchsorted(row, places, "right") - 1
            upto = np.cumsum(many[which])
            i = 0
            while i < len(places):
                j = int(np.searchsorted(upto, (upto[i - 1] if i else 0) + HITS, "right"))
                j = int(np.searchsorted(owner, owner[j], "left")) if j < len(owner) else j
                if j > i:
                    yield meetings(places[i:j], which[i:j], row, first, many, block.item, block.pos)
                    i = j
                    continue
                j = int(np.searchsorted(owner, owner[i], "right"))
                total = int(upto[j - 1] - (upto[i - 1] if i else 0))
                cuts = np.linspace(0, len(block.ids), 2 + total // HITS).astype(np.int64)
                for low, high in zip(cuts, cuts[1:]):
                    gram, item, pos = block.of_items(low, high)
                    begin = np.searchsorted(gram, grams[which[i:j]])
                    own = np.searchsorted(gram, grams[which[i:j]], "right") - begin
                    if own.any():
                        yield meetings(places[i:j], np.arange(j - i), row, begin, own, item, pos)
                i = j

        for batch in batches:
            for part in slices(batch, "text"):
                places, which, h, row = _hits(part, grams)
                out: list[tuple] = []
                for doc, item, diag in parts_of(places, which, row):
                    for d, i_, low, high in _passages(doc, item, diag, block):
                        if i_ not in sorted_words:
                            sorted_words[i_] = np.sort(block.words(i_))
                        text = h[row[d]:row[d + 1]]
                        for score, begin, end in _aligned(block.words(i_), sorted_words[i_], text, max(0, low), min(high, len(text)), block.need[i_]):
                            out.append((d, i_, score, int(block.size[i_]), begin, end))
                cols = list(zip(*out)) or [()] * 6
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c).take(pa.array(cols[0], pa.int64())) for c in ("rid", "id")],
                     pa.array([block.ids[i] for i in cols[1]], id_type),
                     *[pa.array([int(x) for x in c], pa.int64()) for c in cols[2:]]],
                    ["rid", "id", "item_id", "score", "item_words", "first_word", "last_word"])

    return task


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", as_read: bool = False) -> DataFrame:
    """The rows of ``docs`` without an aligned passage, with all columns.

    They are numbered in a written copy, or in place if ``docs`` is a table ``as_read``.
    """
    row = fresh(docs, "row")
    numbered = numbered_rows(docs, row, as_read, "leak-rows")
    hit = contaminated(numbered, items, row, text_col).select(row).distinct()
    return without(numbered, hit, row, "leak-gone").select(*columns(docs))
