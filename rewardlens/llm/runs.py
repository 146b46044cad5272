"""Periodic runs of words by multi-scale minimizers.

A run is a stretch of words with smallest period ``q`` (words ``q`` apart are
identical) of at least ``max(least, 2 q)`` words that no neighbouring word
extends. Each text is searched in a task, all texts of a slice at once:

* Periods below ``SHORT`` come from direct scans, one for each lag.
* A scale ``s`` covers the periods from ``s`` to ``2 s``. Grams of ``s / 2``
  words are hashed, and the least hash of ``s / 2`` neighbouring grams is a
  minimizer. Inside a run of period ``p >= s`` such a window and the window ``p``
  words on hold the same grams, so they choose the same one and the run shows up
  as a pair of equal minimizers ``p`` apart. Every pair at a distance of the
  scale is extended both ways by comparing prefix hashes, and what comes out is
  compared word by word.
* A gram that lies in a run of at most half its length (all of them are known
  from smaller scales) is no minimizer, so equal minimizers are more than an
  eighth of ``2 s`` apart and pairs stay in proportion to the words. Only a
  run whose every gram is of that kind is missed by this: it consists of two
  touching runs of one shorter period, and its period follows from their phases
  (``_junctions``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rewardlens.llm.textbatch import BASE, BASE_INVERSE, U64, Words, mix, powers, slices, text_buffer
from rewardlens.session import ship_package

LEAST = 12
#: Periods below this are scanned directly; half of it is the shortest gram, which must be as long as a run may be.
SHORT = 24
NONE = U64(0xFFFFFFFFFFFFFFFF)

#: Runs as three arrays: first word, number of words, period.
Runs = tuple[np.ndarray, np.ndarray, np.ndarray]


def _stretches(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last of each stretch of consecutive numbers in the sorted ``at``."""
    cut = np.flatnonzero(np.diff(at) != 1)
    return at[np.r_[0, cut + 1]], at[np.r_[cut, len(at) - 1]] + 1


def _at_lag(codes: np.ndarray, row: np.ndarray, lag: int, least: int) -> Runs:
    """Every maximal stretch with period ``lag``, by comparing each word with the one ``lag`` on."""
    same = np.flatnonzero((codes[:-lag] == codes[lag:]) & (row[:-lag] == row[lag:])) if len(codes) > lag else np.zeros(0, np.int64)
    if not len(same):
        return same, same, same
    a, b = _stretches(same)
    n = b - a + lag
    ok = n >= max(least, 2 * lag)
    return a[ok], n[ok], np.full(int(ok.sum()), lag)


class _Found:
    """Runs found so far, each stretch with its smallest period (periods come in ascending order)."""

    def __init__(self) -> None:
        self.start = self.length = self.period = np.zeros(0, np.int64)
        self._keys: set[tuple[int, int]] = set()

    def add(self, runs: Runs) -> None:
        new = []
        order = np.lexsort((runs[0], runs[2]))
        for i in order:
            key = (int(runs[0][i]), int(runs[1][i]))
            if key not in self._keys:
                self._keys.add(key)
                new.append(i)
        if new:
            self.start, self.length, self.period = (np.r_[old, more[new]] for old, more in zip((self.start, self.length, self.period), runs))


def _window_min(h: np.ndarray, w: int) -> np.ndarray:
    """Position of the first least value of every ``w`` neighbouring values; windows of ``NONE`` only are left out."""
    value, at, span = h, np.arange(len(h)), 1
    while span < w:
        step = min(span, w - span)
        left, right = value[:-step], value[step:]
        keep = left <= right
        value, at = np.where(keep, left, right), np.where(keep, at[:-step], at[step:])
        span += step
    at = at[value != NONE]
    return at[np.r_[True, at[1:] != at[:-1]]] if len(at) else at


def _junctions(codes: np.ndarray, row: np.ndarray, found: _Found, low: int, high: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Seeds (word, lag) of runs made of two touching runs of one period of at most ``most``.

    The first run's words, shifted by the lag, must fall on the second run in
    phase, which fixes the lag modulo the period. The stretch begins where either
    run begins.
    """
    use = np.flatnonzero(found.period <= most)
    order = use[np.lexsort((found.start[use], found.period[use]))]
    at, lag = [], []
    for i, j in zip(order, order[1:]):
        q, b, b2 = int(found.period[i]), int(found.start[i]), int(found.start[j])
        e, e2 = b + int(found.length[i]), b2 + int(found.length[j])
        top = min(high - 1, e - b, e2 - b2)
        if q != found.period[j] or b2 > e or row[b] != row[b2] or top < low:
            continue
        root, other = codes[b:b + q], codes[b2:b2 + q]
        twice, size = np.r_[root, root].tobytes(), codes.itemsize
        x = twice.find(other.tobytes())
        while x % size and x >= 0:
            x = twice.find(other.tobytes(), x + 1)
        if x < 0:
            continue
        first = low + (b2 - (b + x // size) - low) % q
        for p in range(first, top + 1, q):
            at.append(max(b, b2 - p))
            lag.append(p)
    return np.array(at, np.int64), np.array(lag, np.int64)


class _Prefix:
    """Prefix hashes of the words of a slice, for comparing stretches of any length."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        self.total = np.zeros(n + 1, U64)
        np.cumsum(mix(codes.astype(U64)) * powers(BASE, n), out=self.total[1:])
        self.power, self.inverse = powers(BASE, n + 1), powers(BASE_INVERSE, n + 1)

    def grams(self, k: int) -> np.ndarray:
        """Hash of the ``k`` words from each word on."""
        m = len(self.total) - k
        return mix((self.total[k:] - self.total[:-k]) * self.inverse[:m])

    def same(self, a: np.ndarray, n: np.ndarray, lag: np.ndarray) -> np.ndarray:
        """Whether the ``n`` words from ``a`` on equal those ``lag`` words later."""
        t = self.total
        return (t[a + n] - t[a]) * self.power[lag] == t[a + lag + n] - t[a + lag]

    def reach(self, at: np.ndarray, lag: np.ndarray, room: np.ndarray, back: bool) -> np.ndarray:
        """How many words from ``at`` on (or before it) equal those ``lag`` later, at most ``room``."""
        low, high = np.zeros(len(at), np.int64), room.copy()
        while (low < high).any():
            mid = (low + high + 1) // 2
            ok = self.same(at - mid if back else at, mid, lag)
            low, high = np.where(ok, mid, low), np.where(ok, high, mid - 1)
        return low


def _at_scale(codes: np.ndarray, row: np.ndarray, bounds: np.ndarray, prefix: _Prefix, found: _Found, scale: int) -> Runs:
    """Runs with periods from ``scale`` to ``2 * scale``, from equal minimizers and junctions."""
    k = scale // 2
    h = prefix.grams(k)
    m = len(h)
    h[row[:m] != row[k - 1:k - 1 + m]] = NONE
    periodic = np.zeros(len(codes) + 1, np.int64)
    known = (found.period <= k // 2) & (found.length >= k)
    np.add.at(periodic, found.start[known], 1)
    np.add.at(periodic, found.start[known] + found.length[known] - k + 1, -1)
    h[np.cumsum(periodic)[:m] > 0] = NONE
    at, lag = ([x] for x in _junctions(codes, row, found, scale, 2 * scale, k // 2))
    anchors = _window_min(h, k) if m >= k else np.zeros(0, np.int64)
    sorted_ = anchors[np.argsort(h[anchors], kind="stable")]
    r = 1
    while r < len(sorted_):
        a, b = sorted_[:-r], sorted_[r:]
        near = (h[a] == h[b]) & (row[a] == row[b]) & (b - a < 2 * scale)
        if not near.any():
            break
        far = near & (b - a >= scale)
        at.append(a[far])
        lag.append((b - a)[far])
        r += 1
    at, lag = np.concatenate(at), np.concatenate(lag)
    right = prefix.reach(at, lag, bounds[row[at] + 1] - at - lag, back=False)
    left = prefix.reach(at, lag, at - bounds[row[at]], back=True)
    ok = left + right >= lag
    start, length, lag = (at - left)[ok], (left + right + lag)[ok], lag[ok]
    sure = np.zeros(len(start), bool)
    extra: list[Runs] = []
    done: dict[tuple[int, int], bool] = {}
    for i in np.lexsort((lag, length, start)):
        s, n, p = int(start[i]), int(length[i]), int(lag[i])
        if (s, n) in found._keys or (s, n) in done:
            continue
        done[s, n] = sure[i] = np.array_equal(codes[s:s + n - p], codes[s + p:s + n])
        if not sure[i]:  # two different stretches with one hash: compare word by word
            lo, hi = bounds[row[s]], bounds[row[s] + 1]
            a, c, q = _at_lag(codes[lo:hi], row[lo:hi], p, LEAST)
            extra.append((a + lo, c, q))
    return tuple(np.concatenate([x[sure], *[y[j] for y in extra]]) for j, x in enumerate((start, length, lag)))


def runs_of(codes: np.ndarray, bounds: np.ndarray, least: int = LEAST) -> Runs:
    """Runs of every row; ``bounds`` has each row's first word and the total at the end.

    Sorted by first word, then period. ``least`` is at most 12: shorter grams
    than that are not looked at.
    """
    sizes = np.diff(bounds)
    row = np.repeat(np.arange(len(sizes)), sizes)
    found = _Found()
    for lag in range(1, SHORT):
        found.add(_at_lag(codes, row, lag, least))
    scale = SHORT
    while len(sizes) and 2 * scale <= sizes.max():
        # only rows that can hold a run of this scale
        rows = np.flatnonzero(sizes >= 2 * scale)
        pick = np.flatnonzero(np.isin(row, rows, kind="table"))
        if len(pick) < len(codes):
            keep = np.full(len(codes), -1)
            keep[pick] = np.arange(len(pick))
            inside = _Found()
            use = keep[found.start] >= 0
            inside.add((keep[found.start[use]], found.length[use], found.period[use]))
            back = pick
        else:
            inside, back = found, None
        own = codes[pick] if back is not None else codes
        own_bounds = np.r_[0, np.cumsum(sizes[rows])]
        own_row = np.repeat(np.arange(len(rows)), sizes[rows])
        a, n, p = _at_scale(own, own_row, own_bounds, _Prefix(own), inside, scale)
        found.add((a if back is None else back[a], n, p))
        scale *= 2
    order = np.lexsort((found.period, found.start))
    return found.start[order], found.length[order], found.period[order]


def _joined(words: Words, keep: np.ndarray) -> pa.Array:
    """The kept words of each row, joined by one space."""
    rows = len(words.row) - 1
    first, size = words.start[keep], (words.end - words.start)[keep]
    done = np.r_[0, np.cumsum(size + 1)]
    at = np.repeat(first - done[:-1], size + 1) + np.arange(done[-1])
    out = words.buf[np.minimum(at, max(len(words.buf) - 1, 0))] if len(at) else np.zeros(0, np.uint8)
    out[done[1:] - 1] = 32
    count = np.r_[0, np.cumsum(keep)][words.row]  # kept words before each row
    ends = done[count]
    some = np.diff(count) > 0
    last = np.zeros(len(out), bool)
    last[ends[1:][some] - 1] = True
    offs = np.r_[0, np.cumsum(np.diff(ends) - some)].astype(np.int32)
    return pa.Array.from_buffers(pa.string(), rows, [None, pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(out[~last]))])


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """``(id_col, n_words, runs, collapsed)`` for every row of ``docs``.

    ``runs`` is an array of ``(start, length, period)`` sorted by start, then
    period; ``collapsed`` has the words that no run holds after its first period,
    joined by one space. Null and empty texts have no words, no runs and an empty
    ``collapsed``; repeated and null ids keep their own rows; an empty table
    gives no rows. Other columns are not read. Nothing is shuffled, and a task
    holds one slice of texts, or one text, at a time.
    """
    if not 2 <= least <= LEAST:
        raise ValueError(f"least must be from 2 to {LEAST}")
    ship_package(docs.sparkSession)
    item = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(*text_buffer(part.column("text")))
                codes = words.array().dictionary_encode().indices.to_numpy()
                start, length, period = runs_of(codes, words.row, least)
                change = np.zeros(len(codes) + 1, np.int64)
                np.add.at(change, start + period, 1)
                np.add.at(change, start + length, -1)
                keep = np.cumsum(change)[:len(codes)] == 0
                owner = np.searchsorted(words.row, start, "right") - 1
                offs = np.searchsorted(start, words.row).astype(np.int32)
                runs = pa.StructArray.from_arrays(
                    [pa.array(start - words.row[owner], pa.int64()), pa.array(length, pa.int64()), pa.array(period, pa.int64())], fields=list(item))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(np.diff(words.row), pa.int64()), pa.ListArray.from_arrays(pa.array(offs), runs), _joined(words, keep)],
                    ["id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(task, f"id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
    return found.select(F.col("id").alias(id_col), "n_words", "runs", "collapsed")


def plant_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, text_col)`` where every tenth text, by hash of its id, repeats a stretch of its own words to the end.

    With ``h = crc32(id)`` as an unsigned number, ``g = h // 10`` and ``n`` words:
    where ``h % 10 = 0`` and ``n > 0``, the words from ``a = g % n`` on become the
    first ``p = 1 + (n - a) // (3 + g % 8)`` of them, over and over. A null id is not hashed.
    """
    space = " \t\n\x0b\x0c\r"
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    staged = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.floor(h / 10).cast("long").alias("g"),
        F.when(h % 10 == 0, F.split(F.trim(F.coalesce(F.col(text_col), F.lit("")), F.lit(space)), r"[\x20\x09-\x0D]+")).alias("w"))
    n = F.size("w")
    staged = staged.withColumn("a", F.when(F.col("w").isNotNull(), F.col("g") % n).cast("int"))
    staged = staged.withColumn("p", (F.floor((n - F.col("a")) / (F.col("g") % 8 + 3)) + 1).cast("int"))
    a, p, w = F.col("a"), F.col("p"), F.col("w")
    source = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i < a, i).otherwise(a + (i - a) % p))
    planted = F.array_join(F.transform(source, lambda i: F.get(w, i)), " ")
    return staged.select(F.col("id").alias(id_col), F.when(w.isNotNull(), planted).otherwise(F.col("text")).alias(text_col))
