"""DuckDB SQL fragments shared by the oracle strings (not used by Spark)."""

from __future__ import annotations

NL = "chr(10)"


def render(col: str, template: str = "chatml", gen: bool = False, eos: str = "</s>") -> str:
    if template == "chatml":
        body = f"array_to_string(list_transform({col}, lambda m: '<|im_start|>' || m.role || {NL} || m.content || '<|im_end|>' || {NL}), '')"
        return f"({body} || '<|im_start|>assistant' || {NL})" if gen else body
    if template == "simple_chat":
        body = (f"array_to_string(list_transform({col}, lambda m: upper(substr(m.role, 1, 1)) || lower(substr(m.role, 2)) "
                f"|| ': ' || m.content || {NL} || {NL}), '')")
        return f"({body} || 'Assistant:')" if gen else body
    if template == "simple_sft":
        return f"(array_to_string(list_transform({col}, lambda m: ' ' || m.content), '') || '{eos}')"
    raise ValueError(template)


def joined(col: str, field: str = "content", sep: str = NL) -> str:
    return f"array_to_string(list_transform({col}, lambda m: m.{field}), {sep})"


def ints(col: str) -> str:
    """Integer array -> space separated text (the registry's scalar form of id arrays)."""
    return f"array_to_string({col}, ' ')"
