"""Sub-word ids by a given byte-pair vocabulary.

The vocabulary is a file of byte strings with ranks, one ``base64 rank`` a line, as
public byte-level tokenizers come; it is never trained here. Texts are cut into
pieces by the vocabulary's pattern in the JVM. Each task encodes the distinct
pieces of a batch once, keeps short ones for later batches, and puts the ids back in
place with array arithmetic, so encoding is one narrow pass without a shuffle.
The ranks (some ten thousand entries, at most ``MOST_TOKENS``) are broadcast.
"""

from __future__ import annotations

import base64
import heapq
import itertools
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rewardlens.functions.batches import in_slices
from rewardlens.functions.common import as_col
from rewardlens.session import ship_package

# Fixed value: the pattern that the public 50,257-entry byte-level vocabulary cuts texts with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: A larger vocabulary is no longer sent to every task.
MOST_TOKENS = 1 << 20
#: Pieces of at most so many bytes, and so many of them, stay known to a Python worker.
KEPT_BYTES, KEPT_PIECES = 64, 1 << 18

IDS = T.ArrayType(T.IntegerType())


class MergeRanks:
    """Encodes one piece: of all neighbouring parts whose union has a rank, the lowest rank merges first."""

    def __init__(self, ranks: dict[bytes, int]):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary has no token for byte {missing[0]}")
        self.ranks = ranks
        self.known: dict[str, list[int]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of the parts that remain. A heap of candidate pairs over a linked list: n log n for any piece."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        end = list(range(1, n + 1))  # where the part that begins here ends; 0 once it is merged away
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            mid = end[i]
            if not mid or mid >= n or end[mid] != stop:
                continue  # a part of this pair has changed
            end[i], end[mid] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := ranks.get(piece[i:end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            j = before[i]
            if j >= 0 and (r := ranks.get(piece[j:stop])) is not None:
                heapq.heappush(heap, (r, j, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i:end[i]]])
            i = end[i]
        return out

    def encode(self, piece: str) -> list[int]:
        found = self.known.get(piece)
        if found is None:
            raw = piece.encode("utf-8")
            found = self.merge(raw)
            if len(raw) <= KEPT_BYTES and len(self.known) < KEPT_PIECES:
                self.known[piece] = found
        return found


#: What a Python worker has made of a broadcast vocabulary, with the broadcast itself, which keeps its id taken.
_ENCODERS: dict[int, tuple] = {}


def _encoder(shared) -> MergeRanks:
    if id(shared) not in _ENCODERS:
        _ENCODERS[id(shared)] = (shared, MergeRanks(shared.value))
    return _ENCODERS[id(shared)][1]


_BYTES: dict[int, tuple] = {}


def _bytes_of(shared) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens' bytes one after another, and each id's size and place."""
    if id(shared) not in _BYTES:
        ranks = shared.value
        size = np.zeros(max(ranks.values()) + 1, np.int64)
        names: list[bytes] = [b""] * len(size)
        for token, i in ranks.items():
            names[i], size[i] = token, len(token)
        _BYTES[id(shared)] = (shared, np.frombuffer(b"".join(names), np.uint8), size, np.cumsum(size) - size)
    return _BYTES[id(shared)][1:]


class SubwordVocabulary:
    """A byte-pair vocabulary and the columns that use it."""

    def __init__(self, spark: SparkSession, ranks: dict[bytes, int], pattern: str = PATTERN):
        if len(ranks) > MOST_TOKENS:
            raise ValueError(f"a vocabulary of {len(ranks)} tokens is over the bound of {MOST_TOKENS}")
        if len(set(ranks.values())) != len(ranks):
            raise ValueError("two tokens share an id")
        MergeRanks(ranks)  # every byte must have a token
        ship_package(spark)
        self.ranks, self.pattern = ranks, pattern
        self._spark = spark
        self._shared = spark.sparkContext.broadcast(ranks)

    @classmethod
    def from_file(cls, spark: SparkSession, path: str, pattern: str = PATTERN) -> SubwordVocabulary:
        """From a file with ``base64(token) rank`` on each line."""
        with open(path, "rb") as f:
            return cls(spark, {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) if token}, pattern)

    def __len__(self) -> int:
        return len(self.ranks)

    def table(self) -> DataFrame:
        """``(token_id, token)`` with the token's bytes."""
        return self._spark.createDataFrame([(i, bytearray(t)) for t, i in self.ranks.items()], "token_id int, token binary")

    def pieces(self, text) -> Column:
        """The pieces of a text, in order; together they are the text. A null text has none."""
        return F.regexp_extract_all(F.coalesce(as_col(text), F.lit("")), F.lit("(?U)" + self.pattern), F.lit(0))

    def ids(self, text, max_length: int | None = None) -> Column:
        """``ARRAY<INT>`` of a text column, cut to ``max_length`` where given."""
        shared = self._shared

        @F.arrow_udf(IDS)
        def encode(pieces: pa.Array) -> pa.Array:
            return in_slices(pieces, encode_slice)

        def encode_slice(pieces: pa.Array) -> pa.Array:
            encoder = _encoder(shared)
            flat = pieces.flatten().dictionary_encode()
            found = [encoder.encode(p) for p in flat.dictionary.to_pylist()]
            size = np.fromiter(map(len, found), np.int64, len(found))
            ids = np.fromiter(itertools.chain.from_iterable(found), np.int32, int(size.sum()))
            code = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            done = np.r_[0, np.cumsum(size[code])]
            out = ids[np.repeat((np.cumsum(size) - size)[code] - done[:-1], size[code]) + np.arange(done[-1])]
            offsets = pieces.offsets.to_numpy()
            return pa.ListArray.from_arrays(pa.array(done[offsets - offsets[0]], pa.int32()), pa.array(out))

        whole = encode(self.pieces(text))
        return whole if max_length is None else F.slice(whole, 1, max_length)

    def text(self, ids, skip_ids: Sequence[int] = ()) -> Column:
        """The text of an id array. Ids in ``skip_ids`` and ids outside the vocabulary are dropped; broken characters become U+FFFD."""
        shared, skip = self._shared, sorted(skip_ids)

        @F.arrow_udf(T.StringType())
        def decode(ids: pa.Array) -> pa.Array:
            return in_slices(ids, decode_slice)

        def decode_slice(ids: pa.Array) -> pa.Array:
            tokens, size, first = _bytes_of(shared)
            flat = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            known = (flat >= 0) & (flat < len(size)) & ~np.isin(flat, skip)
            flat = np.where(known, flat, 0)
            n = np.where(known, size[flat], 0)
            done = np.r_[0, np.cumsum(n)]
            raw = tokens[np.repeat(first[flat] - done[:-1], n) + np.arange(done[-1])].tobytes()
            offsets = ids.offsets.to_numpy()
            at = done[offsets - offsets[0]]
            return pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(at, at[1:])], pa.string())

        return decode(F.coalesce(as_col(ids), F.array().cast(IDS)))

    def encode(self, df: DataFrame, key: str, text: str, max_length: int | None = None) -> DataFrame:
        """``(key, input_ids, attention_mask)`` for every row of ``df``; a null or empty text gets empty arrays."""
        out = df.select(key, self.ids(text, max_length).alias("input_ids"))
        return out.withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("input_ids")))

    def decode(self, df: DataFrame, key: str, ids: str, skip_ids: Sequence[int] = ()) -> DataFrame:
        """``(key, text)`` for every row of ``df``; a row of which nothing remains has an empty text."""
        return df.select(key, self.text(ids, skip_ids).alias("text"))

    def counts(self, df: DataFrame, text: str) -> DataFrame:
        """``(token_id, token, n, texts)``: how often, and in how many texts, each token of the vocabulary occurs (0 included).

        Tasks add up before anything is shuffled, so a token that fills a third of
        the corpus is summed in parts.
        """
        # sorted ids beside their predecessors: an id's first place in a text is where the two differ
        ids = df.select(F.array_sort(self.ids(text)).alias("_ids"))
        shifted = F.concat(F.array(F.lit(None).cast("int")), F.slice("_ids", 1, F.greatest(F.size("_ids") - 1, F.lit(0))))
        pairs = ids.select(F.explode(F.arrays_zip(F.col("_ids").alias("token_id"), shifted.alias("before"))).alias("p")).select("p.*").filter("token_id is not null")
        used = pairs.groupBy("token_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("token_id").eqNullSafe(F.col("before"))).alias("texts"))
        zero = F.lit(0).cast("long")
        return self.table().join(used, "token_id", "left").select(
            "token_id", "token", F.coalesce("n", zero).alias("n"), F.coalesce("texts", zero).alias("texts"))

