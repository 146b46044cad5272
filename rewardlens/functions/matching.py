"""Templates in token sequences, found by one automaton over flat Arrow arrays.

All templates are searched in one pass: an automaton whose state is the longest
template beginning that ends at a token, with failure links to the next shorter
one. Time grows with the tokens and the matches, not with how many templates there
are or how long they are. Tokens of no template send the automaton back to its start,
so only stretches of template tokens are walked.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rewardlens.functions.common import as_col
from rewardlens.session import ship_package

LABELS = T.ArrayType(T.IntegerType())


class TemplateAutomaton:
    """Finds every occurrence (overlapping ones too) of every template."""

    def __init__(self, templates: Sequence[Sequence[int]]):
        if not all(len(t) for t in templates):
            raise ValueError("a template has no tokens")
        self.lengths = [len(t) for t in templates]
        self.next: list[dict[int, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        for k, template in enumerate(templates):
            state = 0
            for token in template:
                if token not in self.next[state]:
                    self.next[state][token] = len(self.next)
                    self.next.append({})
                    self.ends.append([])
                state = self.next[state][token]
            self.ends[state].append(k)
        fail = [0] * len(self.next)
        queue = deque(self.next[0].values())
        while queue:  # states by length; a state's transitions are completed from its failure state
            state = queue.popleft()
            self.ends[state] = self.ends[state] + self.ends[fail[state]]
            for token, after in self.next[state].items():
                fail[after] = self.next[fail[state]].get(token, 0)
                queue.append(after)
            self.next[state] = self.next[fail[state]] | self.next[state]
        self.tokens = np.unique(np.concatenate([np.asarray(t, np.int64) for t in templates]))

    def find(self, flat: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
        """For each template the sorted positions where it starts; rows begin and end at ``bounds``."""
        found: list[list[int]] = [[] for _ in self.lengths]
        at = np.flatnonzero(np.isin(flat, self.tokens))
        if len(at):
            cut = (np.diff(at) != 1) | np.isin(at[1:], bounds)
            starts = np.r_[0, np.flatnonzero(cut) + 1]
            tokens, where = flat[at].tolist(), at.tolist()
            shortest = min(self.lengths)
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(at)]):
                if b - a < shortest:
                    continue
                state = 0
                for i in range(a, b):
                    state = self.next[state].get(tokens[i], 0)
                    for k in self.ends[state]:
                        found[k].append(where[i] - self.lengths[k] + 1)
        return [np.array(f, np.int64) for f in found]


def _masked(labels: pa.Array, spans, ignore_index: int) -> pa.Array:
    """``labels`` with ``ignore_index`` over the spans that ``spans(flat, bounds)`` gives as starts and ends."""
    flat, offsets = labels.flatten(), labels.offsets.to_numpy()
    bounds = (offsets - offsets[0]).astype(np.int64)
    null = flat.is_null().to_numpy(zero_copy_only=False) if flat.null_count else None
    values = flat.fill_null(np.iinfo(np.int32).min).to_numpy(zero_copy_only=False).astype(np.int64)
    starts, ends = spans(values, bounds)
    change = np.zeros(len(values) + 1, np.int64)
    some = np.asarray(starts) < np.asarray(ends)
    np.add.at(change, np.asarray(starts, np.int64)[some], 1)
    np.add.at(change, np.asarray(ends, np.int64)[some], -1)
    hidden = np.cumsum(change)[:-1] > 0
    out = pa.array(np.where(hidden, ignore_index, values).astype(np.int32), mask=None if null is None else null & ~hidden)
    none = labels.is_null() if labels.null_count else None
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), out, mask=none)


def _masking(labels, spans, ignore_index: int) -> Column:
    ship_package(SparkSession.active())

    @F.arrow_udf(LABELS)
    def mask(labels: pa.Array) -> pa.Array:
        return _masked(labels, spans, ignore_index)

    return mask(as_col(labels).cast(LABELS))


def label_completion_single(labels, response_template: Sequence[int], ignore_index: int = -100) -> Column:
    """Mask labels through the end of the *last* response template; the whole row if there is none."""
    automaton = TemplateAutomaton([response_template])
    m = len(response_template)

    def spans(flat: np.ndarray, bounds: np.ndarray):
        (hits,) = automaton.find(flat, bounds)
        if not len(hits):
            return bounds[:-1], bounds[1:]
        last = np.searchsorted(hits, bounds[1:]) - 1
        there = (last >= 0) & (hits[np.maximum(last, 0)] >= bounds[:-1])
        return bounds[:-1], np.where(there, hits[np.maximum(last, 0)] + m, bounds[1:])

    return _masking(labels, spans, ignore_index)


def label_completion_multi(labels, response_template: Sequence[int], instruction_template: Sequence[int], ignore_index: int = -100) -> Column:
    """Mask everything outside assistant responses.

    The k-th span goes from the k-th instruction to the end of the k-th response
    template, the first from the row's beginning; where the first response comes
    before the first instruction, the row's beginning counts as an instruction. An
    instruction left over hides the rest of the row; a row without one of the
    templates is masked whole.
    """
    automaton = TemplateAutomaton([response_template, instruction_template])
    m = len(response_template)

    def spans(flat: np.ndarray, bounds: np.ndarray):
        answers, asks = automaton.find(flat, bounds)
        starts, ends = [], []
        a, q = np.searchsorted(answers, bounds), np.searchsorted(asks, bounds)
        for r, (low, high) in enumerate(zip(bounds.tolist(), bounds[1:].tolist())):
            said, asked = (answers[a[r]:a[r + 1]] + m).tolist(), asks[q[r]:q[r + 1]].tolist()
            if not said or not asked:
                starts.append(low)
                ends.append(high)
                continue
            if asked[0] > said[0]:
                asked.insert(0, low)
            for k, (s, e) in enumerate(zip(asked, said)):
                starts.append(low if k == 0 else s)
                ends.append(e)
            if len(said) < len(asked):
                starts.append(asked[-1])
                ends.append(high)
        return starts, ends

    return _masking(labels, spans, ignore_index)
