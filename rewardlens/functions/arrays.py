"""Token-sequence array expressions (``Column -> Column``).

All positions are 0-based, as in the tensors they replace; Spark's array
functions are 1-based, so the conversions live here and nowhere else.
Where a plain ``slice`` / ``concat`` / ``array_repeat`` suffices it is used
instead of a lambda, so the projection stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rewardlens.functions.common import as_col, lit_or_col


def first_true_index(arr, value) -> Column:
    """0-based position of the first element equal to ``value``; ``size`` if none."""
    a = as_col(arr)
    pos = F.array_position(a, lit_or_col(value))
    return F.when(pos == 0, F.size(a)).otherwise(pos - 1).cast("int")


def first_true_index_bool(bools) -> Column:
    """Same as :func:`first_true_index` for a boolean / 0-1 array."""
    a = as_col(bools)
    return first_true_index(F.transform(a, lambda x: x.cast("boolean")), F.lit(True))


def truncate_response(arr, stop_token_id: int, pad_token_id: int) -> Column:
    """Keep everything through the first stop token, fill the rest with pad."""
    a = as_col(arr)
    idx = first_true_index(a, stop_token_id)
    return F.concat(F.slice(a, 1, idx + 1), F.array_repeat(F.lit(pad_token_id), F.size(a) - idx - 1))


def stop_mask(arr, stop_token_id: int) -> Column:
    """1 through the first stop token (inclusive), 0 after; all 1 if none."""
    a = as_col(arr)
    idx = first_true_index(a, stop_token_id)
    ones = F.least(idx + 1, F.size(a))
    return F.concat(F.array_repeat(F.lit(1), ones), F.array_repeat(F.lit(0), F.size(a) - ones))


def truncate_right(arr, stop_token_id: int, pad_token_id: int) -> Column:
    """``struct(ids, mask)``: :func:`truncate_response` plus its 0/1 mask."""
    return F.struct(truncate_response(arr, stop_token_id, pad_token_id).alias("ids"), stop_mask(arr, stop_token_id).alias("mask"))


def eos_mask(arr, eos_token_id: int) -> Column:
    """Completion mask: 1 up to and including the first EOS, 0 after."""
    return stop_mask(arr, eos_token_id)


def completion_length(arr, eos_token_id: int) -> Column:
    """Sum of :func:`eos_mask` without building it."""
    a = as_col(arr)
    return F.least(first_true_index(a, eos_token_id) + 1, F.size(a))


def truncate_left(arr, max_length: int) -> Column:
    """Keep the last ``max_length`` elements (``x[-n:]``)."""
    a = as_col(arr)
    return F.slice(a, F.greatest(F.lit(1), F.size(a) - max_length + 1), F.lit(max_length))


def pad_to_width(arr, width, value, side: str = "right") -> Column:
    """Pad to ``width`` on one side; longer input is returned unchanged."""
    if side not in ("left", "right"):
        raise ValueError("padding_side must be 'left' or 'right'")
    a = as_col(arr)
    fill = F.array_repeat(lit_or_col(value), lit_or_col(width) - F.size(a))
    return F.concat(a, fill) if side == "right" else F.concat(fill, a)


def pad_to_length(arr, length: int, value) -> Column:
    """Right-pad to ``length``; longer input is not cut."""
    return pad_to_width(arr, length, value, "right")


def round_up_multiple(width, multiple: int | None) -> Column:
    w = lit_or_col(width)
    if not multiple:
        return w
    return (F.ceil(w / F.lit(multiple)) * F.lit(multiple)).cast("int")


def attention_mask(arr, pad_token_id: int) -> Column:
    """``token != pad`` as 0/1."""
    return F.transform(as_col(arr), lambda x: (x != F.lit(pad_token_id)).cast("int"))


def mask_fill(arr, mask, value) -> Column:
    """Replace elements where ``mask`` is 0/false by ``value``."""
    return F.zip_with(as_col(arr), as_col(mask), lambda x, m: F.when(m.cast("boolean"), x).otherwise(lit_or_col(value)))


def sequence_length(arr, context_length: int, pad_token_id: int) -> Column:
    """Index of the last non-pad response token (may be ``context_length - 1``)."""
    a = as_col(arr)
    resp = F.slice(a, context_length + 1, F.greatest(F.size(a) - context_length, F.lit(0)))
    return first_true_index(resp, pad_token_id) - 1 + context_length


def get_signed(arr, idx) -> Column:
    """Python-style indexing: negative counts from the end."""
    a = as_col(arr)
    i = lit_or_col(idx)
    return F.when(i >= 0, F.get(a, i)).otherwise(F.try_element_at(a, i))


def add_bos(ids, mask, bos_token_id: int | None) -> tuple[Column, Column]:
    """Prepend BOS (and mask 1) when the sequence is empty or starts otherwise."""
    i, m = as_col(ids), as_col(mask)
    if bos_token_id is None:
        return i, m
    bos = F.lit(bos_token_id)
    need = (F.size(i) == 0) | F.coalesce(F.get(i, 0) != bos, F.lit(True))
    return (
        F.when(need, F.concat(F.array(bos), i)).otherwise(i),
        F.when(need, F.concat(F.array(F.lit(1)), m)).otherwise(m),
    )


def add_eos(ids, mask, eos_token_id: int) -> tuple[Column, Column]:
    """Append EOS (and mask 1) when the sequence is empty or ends otherwise."""
    i, m = as_col(ids), as_col(mask)
    eos = F.lit(eos_token_id)
    need = (F.size(i) == 0) | F.coalesce(F.try_element_at(i, F.lit(-1)) != eos, F.lit(True))
    return (
        F.when(need, F.concat(i, F.array(eos))).otherwise(i),
        F.when(need, F.concat(m, F.array(F.lit(1)))).otherwise(m),
    )


def rotate_left(arr, k) -> Column:
    """``torch.roll(a, -k)`` for ``0 <= k < size``."""
    a = as_col(arr)
    kk = lit_or_col(k)
    return F.concat(F.slice(a, kk + 1, F.size(a)), F.slice(a, F.lit(1), kk))


def replace_ids(arr, ids: list[int], value: int = -100) -> Column:
    """Replace any of ``ids`` (pad and listed special ids) by ``value``."""
    arr_ids = F.array(*[F.lit(x) for x in ids])
    return F.transform(as_col(arr), lambda x: F.when(F.array_contains(arr_ids, x), F.lit(value)).otherwise(x))
