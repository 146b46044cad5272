"""Chat templates and text expressions over ``ARRAY<STRUCT<role, content>>``.

The three fixed templates are rendered as column expressions (no template
engine): the whole conversation is one ``array_join`` over ``transform``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rewardlens.functions.common import as_col

# Fixed values that must equal the reference's templates.
CHATML_BOS = "<|im_start|>"
CHATML_EOS = "<|im_end|>"
CHATML_GENERATION = "<|im_start|>assistant\n"
SIMPLE_CHAT_GENERATION = "Assistant:"

TEMPLATES = ("chatml", "simple_chat", "simple_sft")


def capitalize(s) -> Column:
    """Python ``str.capitalize``: first character upper, the rest lower (not ``initcap``)."""
    c = as_col(s)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, F.lit(2), F.length(c))))


def _render_one(template: str, m: Column, eos_token: str) -> Column:
    if template == "chatml":
        return F.concat(F.lit(CHATML_BOS), m["role"], F.lit("\n"), m["content"], F.lit(CHATML_EOS + "\n"))
    if template == "simple_chat":
        return F.concat(capitalize(m["role"]), F.lit(": "), m["content"], F.lit("\n\n"))
    if template == "simple_sft":
        return F.concat(F.lit(" "), m["content"])
    raise ValueError(f"unknown template {template!r}; expected one of {TEMPLATES}")


def render(messages, template: str = "chatml", add_generation_prompt: bool = False, eos_token: str = "</s>") -> Column:
    """Render a conversation to text with one of the fixed templates."""
    body = F.array_join(F.transform(as_col(messages), lambda m: _render_one(template, m, eos_token)), "")
    if template == "simple_sft":
        return F.concat(body, F.lit(eos_token))
    if add_generation_prompt:
        suffix = CHATML_GENERATION if template == "chatml" else SIMPLE_CHAT_GENERATION
        return F.concat(body, F.lit(suffix))
    return body


def chat_pair(prompt, completion) -> Column:
    """``(prompt, completion)`` strings -> a user/assistant conversation."""
    return F.array(
        F.struct(F.lit("user").alias("role"), as_col(prompt).alias("content")),
        F.struct(F.lit("assistant").alias("role"), as_col(completion).alias("content")),
    )


def vlm_user_message(question) -> Column:
    """User turn with an image part and a text part (typed content)."""
    part = "struct<type:string,text:string>"
    content = F.array(
        F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text")),
        F.struct(F.lit("text").alias("type"), as_col(question).alias("text")),
    ).cast(f"array<{part}>")
    return F.array(F.struct(F.lit("user").alias("role"), content.alias("content")))


def vlm_assistant_message(text) -> Column:
    part = "struct<type:string,text:string>"
    content = F.array(F.struct(F.lit("text").alias("type"), as_col(text).alias("text"))).cast(f"array<{part}>")
    return F.array(F.struct(F.lit("assistant").alias("role"), content.alias("content")))


def name_tail(name) -> Column:
    """Last path component: ``org/model`` -> ``model``."""
    return F.element_at(F.split(as_col(name), "/"), -1)


def format_reward(x) -> Column:
    """Two decimals, half-to-even on the binary value, no thousands separator."""
    return F.call_function("format_number", as_col(x).cast("double"), F.lit("0.00"))


def strip_token(text, token: str) -> Column:
    """Remove every occurrence of ``token`` (plain text, not a pattern)."""
    return F.replace(as_col(text), F.lit(token), F.lit(""))


def common_prefix_length(a, b) -> Column:
    """Number of equal leading characters of two strings.

    Binary search on ``substring`` equality inside one ``aggregate``: no
    per-character arrays, ``O(n log n)`` character compares per row.
    """
    x, y = as_col(a), as_col(b)
    n = F.least(F.length(x), F.length(y))
    steps = F.sequence(F.lit(1), F.lit(32))

    def step(st, _):
        lo, hi = st["lo"], st["hi"]
        mid = ((lo + hi + 1) / 2).cast("int")
        ok = F.substring(x, 1, mid) == F.substring(y, 1, mid)
        go = lo < hi
        return F.struct(
            F.when(go & ok, mid).otherwise(lo).alias("lo"),
            F.when(go & ~ok, mid - 1).otherwise(hi).alias("hi"),
        )

    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), n.alias("hi")), step, lambda st: st["lo"])


def common_prefix_length_array(a, b) -> Column:
    """Number of equal leading elements of two arrays (null-safe element equality)."""
    x, y = as_col(a), as_col(b)
    n = F.least(F.size(x), F.size(y))
    eq = F.zip_with(F.slice(x, 1, n), F.slice(y, 1, n), lambda u, v: u.eqNullSafe(v))
    p = F.array_position(eq, False)
    return F.when(p == 0, n).otherwise(p - 1).cast("int")
