"""Chat templates compiled from their text to one Column.

The language is the part of Jinja that chat templates use: ``{{ .. }}``, ``{% for %}``,
``{% if / elif / else %}``, ``{% set %}``, comments, ``-`` for trimming, strings, numbers, ``+ ~ == != < > in
not and or``, ``x if c else y``, ``a.b``, ``a['b']``, ``a[0]``, ``a[1:]``, the loop variables, the usual string
methods and filters, ``is defined / none / string``, and ``raise_exception``. Blocks on lines of their
own leave no blank lines. What is known when a query is built (tokens,
``add_generation_prompt``, fields that a schema lacks) is folded away; the rest becomes Spark expressions, a loop a
``transform``. So no template engine runs in tasks, and Catalyst sees the whole.

A null value renders as nothing and counts as false. JSON is compact.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rewardlens.functions.chat import capitalize

# The three chat templates, whose texts must come out as those of functions/chat.py.
CHATML = ("{% for message in messages %}{{ '<|im_start|>' + message['role'] + '\n' + message['content'] + '<|im_end|>\n' }}{% endfor %}"
          "{% if add_generation_prompt %}{{ '<|im_start|>assistant\n' }}{% endif %}")
SIMPLE_CHAT = ("{% for message in messages %}{{ message['role'].capitalize() + ': ' + message['content'] + '\n\n' }}{% endfor %}"
               "{% if add_generation_prompt %}{{ 'Assistant:' }}{% endif %}")
SIMPLE_SFT = "{% for message in messages %}{{ ' ' + message['content'] }}{% endfor %}{{ eos_token }}"

#: ChatML with tool descriptions in the system turn.
CHATML_TOOLS = r"""{%- if tools %}
    {{- '<|im_start|>system\n' }}
    {%- if messages[0].role == 'system' %}
        {{- messages[0].content + '\n\n' }}
    {%- endif %}
    {{- '# Tools\n' }}
    {%- for tool in tools %}
        {{- tool | tojson + '\n' }}
    {%- endfor %}
    {{- '<|im_end|>\n' }}
{%- endif %}
{%- for message in messages %}
    {%- if not (tools and loop.first and message.role == 'system') %}
        {{- '<|im_start|>' + message.role + '\n' + message.content + '<|im_end|>\n' }}
    {%- endif %}
{%- endfor %}
{%- if add_generation_prompt %}
    {{- '<|im_start|>assistant\n' }}
{%- endif %}"""


class TemplateError(ValueError):
    """The template's text is wrong or uses what the compiler does not know."""


# ---------------------------------------------------------------- values


@dataclass(frozen=True)
class Const:
    """Known when the query is built."""

    value: Any


@dataclass(frozen=True)
class Data:
    """A column and its type."""

    col: Column
    type: T.DataType


class _Undefined:
    def __repr__(self) -> str:
        return "undefined"


UNDEFINED = _Undefined()
Value = Const | Data | _Undefined


@dataclass
class _Loop:
    """The ``loop`` variable: place and number of items, known or not."""

    index0: Value
    length: Value


# ---------------------------------------------------------------- text to tree

_TAG = re.compile(r"(\{%-?.*?-?%\}|\{\{-?.*?-?\}\}|\{#-?.*?-?#\})", re.DOTALL)
_TOKEN = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<num>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+~<>()\[\].,|:%=]))", re.DOTALL)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def _pieces(text: str) -> list[tuple[str, str]]:
    """(kind, body) with kind ``text``, ``block`` or ``print``; trimming done."""
    parts = _TAG.split(text)
    out = []
    for i, part in enumerate(parts):
        if i % 2 == 0:
            before, after = parts[i - 1] if i else "", parts[i + 1] if i + 1 < len(parts) else ""
            if before.endswith(("-%}", "-}}", "-#}")):
                part = part.lstrip()
            elif before.startswith(("{%", "{#")) and part.startswith("\n"):
                part = part[1:]
            if after.startswith(("{%-", "{{-", "{#-")):
                part = part.rstrip()
            elif after.startswith(("{%", "{#")):
                line = part.rfind("\n") + 1
                if not part[line:].strip(" \t") and (line or not i):
                    part = part[:line]
            if part:
                out.append(("text", part))
        elif not part.startswith("{#"):
            out.append(("block" if part.startswith("{%") else "print", part[2:-2].strip("-").strip()))
    return out


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise TemplateError(f"cannot read {text[at:at + 20]!r}")
        kind = m.lastgroup
        body = m[kind]
        out.append((kind, re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), body[1:-1], flags=re.DOTALL) if kind == "str" else body))
        at = m.end()
    return out


class _Expression:
    """Recursive descent from tokens to a function of the environment."""

    def __init__(self, text: str):
        self.tokens, self.at, self.text = _tokens(text), 0, text

    def parse(self) -> Callable[[dict], Value]:
        out = self.choice()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r} in {self.text!r}")
        return out

    def peek(self, *ops: str) -> str | None:
        if self.at < len(self.tokens):
            kind, body = self.tokens[self.at]
            if kind in ("op", "name") and body in ops:
                return body
        return None

    def take(self, *ops: str) -> str | None:
        found = self.peek(*ops)
        self.at += found is not None
        return found

    def need(self, op: str) -> None:
        if not self.take(op):
            raise TemplateError(f"{op!r} is missing in {self.text!r}")

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError(f"a name is missing in {self.text!r}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def choice(self):
        yes = self.either()
        if not self.take("if"):
            return yes
        cond = self.either()
        no = self.choice() if self.take("else") else (lambda env: Const(""))
        return lambda env: _choose(truth(cond(env)), lambda: yes(env), lambda: no(env))

    def either(self):
        left = self.both()
        while self.take("or"):
            left = (lambda a, b: lambda env: _or(a(env), lambda: b(env)))(left, self.both())
        return left

    def both(self):
        left = self.negation()
        while self.take("and"):
            left = (lambda a, b: lambda env: _and(a(env), lambda: b(env)))(left, self.negation())
        return left

    def negation(self):
        if self.take("not"):
            inner = self.negation()
            return lambda env: _not(truth(inner(env)))
        return self.comparison()

    def comparison(self):
        left = self.sum()
        while True:
            if op := self.take("==", "!=", "<", ">", "<=", ">="):
                left = (lambda a, b, op: lambda env: compare(op, a(env), b(env)))(left, self.sum(), op)
            elif self.take("in"):
                left = (lambda a, b: lambda env: contains(b(env), a(env)))(left, self.sum())
            elif self.peek("not") and self.tokens[self.at + 1:self.at + 2] == [("name", "in")]:
                self.at += 2
                left = (lambda a, b: lambda env: _not(contains(b(env), a(env))))(left, self.sum())
            elif self.take("is"):
                negated, test = bool(self.take("not")), self.name()
                left = (lambda a, test, negated: lambda env: _not(is_(test, a(env))) if negated else is_(test, a(env)))(left, test, negated)
            else:
                return left

    def sum(self):
        left = self.unary()
        while op := self.take("+", "~", "-", "%"):
            left = (lambda a, b, op: lambda env: arithmetic(op, a(env), b(env)))(left, self.unary(), op)
        return left

    def unary(self):
        if self.take("-"):
            inner = self.unary()
            return lambda env: arithmetic("-", Const(0), inner(env))
        return self.postfix()

    def arguments(self) -> list:
        out = []
        while not self.take(")"):
            out.append(self.choice())
            if not self.peek(")"):
                self.need(",")
        return out

    def postfix(self):
        value = self.primary()
        while True:
            if self.take("."):
                name = self.name()
                if self.take("("):
                    value = (lambda v, n, args: lambda env: call(n, v(env), [a(env) for a in args]))(value, name, self.arguments())
                else:
                    value = (lambda v, n: lambda env: attribute(v(env), n))(value, name)
            elif self.take("["):
                if self.take(":"):
                    stop = self.choice()
                    value = (lambda v, b: lambda env: cut(v(env), Const(0), b(env)))(value, stop)
                else:
                    index = self.choice()
                    if self.take(":"):
                        stop = None if self.peek("]") else self.choice()
                        value = (lambda v, a, b: lambda env: cut(v(env), a(env), b(env) if b else None))(value, index, stop)
                    else:
                        value = (lambda v, i: lambda env: item(v(env), i(env)))(value, index)
                self.need("]")
            elif self.take("|"):
                name = self.name()
                args = self.arguments() if self.take("(") else []
                value = (lambda v, n, args: lambda env: call(n, v(env), [a(env) for a in args]))(value, name, args)
            else:
                return value

    def primary(self):
        if self.take("("):
            inner = self.choice()
            self.need(")")
            return inner
        if self.at >= len(self.tokens):
            raise TemplateError(f"{self.text!r} ends too early")
        kind, body = self.tokens[self.at]
        self.at += 1
        if kind == "str":
            return lambda env: Const(body)
        if kind == "num":
            return lambda env: Const(int(body))
        if kind == "op":
            raise TemplateError(f"unexpected {body!r} in {self.text!r}")
        known = {"true": True, "True": True, "false": False, "False": False, "none": None, "None": None}
        if body in known:
            return lambda env: Const(known[body])
        if body == "raise_exception" and self.take("("):
            args = self.arguments()
            return lambda env: Data(F.raise_error(text_of(args[0](env))).cast("string"), T.StringType())
        return lambda env: env.get(body, UNDEFINED)


# ---------------------------------------------------------------- operations


def _known(v: Value) -> bool:
    return not isinstance(v, Data)


def _plain(v: Value) -> Any:
    return v.value if isinstance(v, Const) else None


def as_data(v: Value) -> Data:
    if isinstance(v, Data):
        return v
    x = _plain(v)
    kind = T.BooleanType() if isinstance(x, bool) else T.LongType() if isinstance(x, int) else T.StringType()
    return Data(F.lit(x).cast(kind), kind)


def truth(v: Value) -> Value:
    """As a condition: empty, zero, null and undefined are false."""
    if isinstance(v, _Loop):
        return Const(True)
    if _known(v):
        return Const(bool(_plain(v)))
    if isinstance(v.type, T.BooleanType):
        c = v.col
    elif isinstance(v.type, T.StringType):
        c = v.col != ""
    elif isinstance(v.type, (T.ArrayType, T.MapType)):
        c = F.size(v.col) > 0
    elif isinstance(v.type, T.NumericType):
        c = v.col != 0
    else:
        c = v.col.isNotNull()
    return Data(F.coalesce(c, F.lit(False)), T.BooleanType())


def _not(v: Value) -> Value:
    v = truth(v)
    return Const(not v.value) if isinstance(v, Const) else Data(~v.col, T.BooleanType())


def _and(a: Value, b: Callable[[], Value]) -> Value:
    a = truth(a)
    if isinstance(a, Const):
        return truth(b()) if a.value else a
    other = truth(b())
    if isinstance(other, Const):
        return a if other.value else other
    return Data(a.col & other.col, T.BooleanType())


def _or(a: Value, b: Callable[[], Value]) -> Value:
    """Jinja's ``or`` gives the first true operand; between columns of one type that is a choice, else a condition."""
    if _known(a):
        return a if truth(a).value else b()
    other = b()
    if isinstance(a.type, T.StringType) and isinstance(as_data(other).type, T.StringType):
        return Data(F.when(truth(a).col, a.col).otherwise(as_data(other).col), a.type)
    return Data(truth(a).col | as_data(truth(other)).col, T.BooleanType())


def _choose(cond: Value, yes: Callable[[], Value], no: Callable[[], Value]) -> Value:
    if isinstance(cond, Const):
        return yes() if cond.value else no()
    a, b = yes(), no()
    if isinstance(a, Data) and isinstance(b, Data) and a.type == b.type:
        return Data(F.when(cond.col, a.col).otherwise(b.col), a.type)
    return Data(F.when(cond.col, text_of(a)).otherwise(text_of(b)), T.StringType())


def compare(op: str, a: Value, b: Value) -> Value:
    if _known(a) and _known(b):
        x, y = _plain(a), _plain(b)
        known = {"==": lambda: x == y, "!=": lambda: x != y, "<": lambda: x < y, ">": lambda: x > y, "<=": lambda: x <= y, ">=": lambda: x >= y}
        return Const(known[op]())
    x, y = as_data(a).col, as_data(b).col
    if op in ("==", "!="):  # null equals null and nothing else
        c = x.eqNullSafe(y)
        return Data(c if op == "==" else ~c, T.BooleanType())
    c = {"<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op]
    return Data(F.coalesce(c, F.lit(False)), T.BooleanType())


def contains(whole: Value, part: Value) -> Value:
    if _known(whole) and _known(part):
        return Const(_plain(part) in (_plain(whole) or ()))
    if _known(whole) and isinstance(_plain(whole), (list, tuple)):
        return Data(F.coalesce(as_data(part).col.isin(list(_plain(whole))), F.lit(False)), T.BooleanType())
    w = as_data(whole)
    if isinstance(w.type, T.StructType):
        return Const(_plain(part) in w.type.fieldNames())
    c = F.array_contains(w.col, as_data(part).col) if isinstance(w.type, T.ArrayType) else F.contains(w.col, as_data(part).col)
    return Data(F.coalesce(c, F.lit(False)), T.BooleanType())


def is_(test: str, v: Value) -> Value:
    if test in ("defined", "undefined"):
        return Const((v is not UNDEFINED) == (test == "defined"))
    if test in ("none", "null"):
        return Data(v.col.isNull(), T.BooleanType()) if isinstance(v, Data) else Const(isinstance(v, Const) and v.value is None)
    if test == "string":
        return Const(isinstance(v.type, T.StringType) if isinstance(v, Data) else isinstance(_plain(v), str))
    if test in ("iterable", "sequence"):
        return Const(isinstance(v.type, (T.ArrayType, T.StringType)) if isinstance(v, Data) else isinstance(_plain(v), (list, tuple, str)))
    if test == "mapping":
        return Const(isinstance(v.type, (T.StructType, T.MapType)) if isinstance(v, Data) else isinstance(_plain(v), dict))
    if test in ("true", "false"):
        return truth(v) if test == "true" else _not(v)
    raise TemplateError(f"unknown test {test!r}")


def arithmetic(op: str, a: Value, b: Value) -> Value:
    if op == "~" or op == "+" and (_is_text(a) or _is_text(b)):
        if _known(a) and _known(b):
            return Const(_const_text(a) + _const_text(b))
        return Data(F.concat(text_of(a), text_of(b)), T.StringType())
    if _known(a) and _known(b):
        x, y = _plain(a), _plain(b)
        return Const(x + y if op == "+" else x - y if op == "-" else x % y)
    x, y = as_data(a).col.cast("long"), as_data(b).col.cast("long")
    return Data(x + y if op == "+" else x - y if op == "-" else F.pmod(x, y), T.LongType())


def _is_text(v: Value) -> bool:
    return isinstance(v.type, T.StringType) if isinstance(v, Data) else isinstance(_plain(v), str)


def attribute(v: Value, name: str) -> Value:
    if isinstance(v, _Loop):
        if name == "index0":
            return v.index0
        if name == "index":
            return arithmetic("+", v.index0, Const(1))
        if name == "length":
            return v.length
        if name == "first":
            return compare("==", v.index0, Const(0))
        if name == "last":
            return compare("==", v.index0, arithmetic("-", v.length, Const(1)))
        raise TemplateError(f"unknown loop variable {name!r}")
    if isinstance(v, Data):
        if isinstance(v.type, T.StructType):
            return Data(v.col[name], v.type[name].dataType) if name in v.type.fieldNames() else UNDEFINED
        if isinstance(v.type, T.MapType):
            return Data(F.try_element_at(v.col, F.lit(name)), v.type.valueType)
        raise TemplateError(f"a value of type {v.type.simpleString()} has no attribute {name!r}")
    x = _plain(v)
    return Const(x[name]) if isinstance(x, dict) and name in x else UNDEFINED


def item(v: Value, index: Value) -> Value:
    i = _plain(index)
    if isinstance(i, str):
        return attribute(v, i)
    if _known(v):
        x = _plain(v)
        if isinstance(x, (list, tuple, str)) and isinstance(i, int):
            return Const(x[i]) if -len(x) <= i < len(x) else UNDEFINED
        return UNDEFINED
    if not isinstance(v.type, T.ArrayType):
        raise TemplateError(f"a value of type {v.type.simpleString()} has no items")
    at = F.lit(i + 1 if i >= 0 else i) if isinstance(i, int) else as_data(index).col.cast("int") + 1
    return Data(F.try_element_at(v.col, at), v.type.elementType)


def cut(v: Value, start: Value, stop: Value | None) -> Value:
    a, b = _plain(start), None if stop is None else _plain(stop)
    if not isinstance(a, int) or stop is not None and not isinstance(b, int):
        raise TemplateError("the bounds of a slice must be numbers")
    if _known(v):
        return Const(_plain(v)[a:b])
    if not isinstance(v.type, T.ArrayType):
        raise TemplateError("only arrays are sliced")
    n = F.size(v.col)
    low = F.lit(a) if a >= 0 else F.greatest(n + a, F.lit(0))
    high = n if b is None else F.least(F.lit(b), n) if b >= 0 else n + b
    return Data(F.slice(v.col, (low + 1).cast("int"), F.greatest(high - low, F.lit(0)).cast("int")), v.type)


_STRIPPED = " \t\n\r\x0b\x0c"


def call(name: str, v: Value, args: list[Value]) -> Value:
    """String methods and filters."""
    if name == "default":
        return _choose(is_("defined", v), lambda: v, lambda: args[0]) if v is UNDEFINED or _known(v) else Data(F.coalesce(v.col, as_data(args[0]).col), v.type)
    if name in ("length", "count"):
        if _known(v):
            return Const(len(_plain(v) or ()))
        return Data((F.length(v.col) if isinstance(v.type, T.StringType) else F.size(v.col)).cast("long"), T.LongType())
    if name == "tojson":
        if _known(v):
            return Const(json.dumps(_plain(v), ensure_ascii=False, separators=(",", ":")))
        if isinstance(v.type, (T.StructType, T.ArrayType, T.MapType)):
            return Data(F.to_json(v.col), T.StringType())
        return Data(F.regexp_extract(F.to_json(F.struct(v.col.alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1), T.StringType())
    if name in ("first", "last"):
        return item(v, Const(0 if name == "first" else -1))
    if name == "join":
        sep = _plain(args[0]) if args else ""
        return Const(sep.join(map(str, _plain(v)))) if _known(v) else Data(F.array_join(v.col, sep), T.StringType())
    texts = {
        "upper": (str.upper, F.upper), "lower": (str.lower, F.lower), "capitalize": (str.capitalize, capitalize),
        "trim": (str.strip, lambda c: F.trim(c, F.lit(_STRIPPED))), "strip": (str.strip, lambda c: F.trim(c, F.lit(_STRIPPED))),
        "lstrip": (str.lstrip, lambda c: F.ltrim(c, F.lit(_STRIPPED))), "rstrip": (str.rstrip, lambda c: F.rtrim(c, F.lit(_STRIPPED))), "string": (str, lambda c: c),
    }
    if name in texts and not args:
        plain, column = texts[name]
        return Const(plain(_const_text(v))) if _known(v) else Data(column(text_of(v)), T.StringType())
    if name in ("startswith", "endswith", "replace") and all(_known(a) for a in args):
        given = [_const_text(a) for a in args]
        if _known(v):
            return Const(getattr(_const_text(v), name)(*given))
        c = text_of(v)
        if name == "replace":
            return Data(F.replace(c, *map(F.lit, given)), T.StringType())
        return Data(c.startswith(given[0]) if name == "startswith" else c.endswith(given[0]), T.BooleanType())
    raise TemplateError(f"unknown method or filter {name!r}")


def _const_text(v: Value) -> str:
    x = _plain(v)
    return "" if x is None else str(x)


def text_of(v: Value) -> Column:
    """What ``{{ v }}`` prints."""
    if _known(v):
        return F.lit(_const_text(v))
    if isinstance(v.type, T.BooleanType):
        return F.when(v.col, "True").when(~v.col, "False").otherwise("")
    if isinstance(v.type, (T.StructType, T.ArrayType, T.MapType)):
        return F.coalesce(F.to_json(v.col), F.lit(""))
    return F.coalesce(v.col.cast("string"), F.lit(""))


# ---------------------------------------------------------------- blocks


class _Nodes:
    """The blocks of a template, as functions from an environment to texts and columns."""

    def __init__(self, pieces: list[tuple[str, str]]):
        self.pieces, self.at = pieces, 0

    def until(self, *ends: str) -> tuple[list, str]:
        """Nodes up to one of the block tags ``ends``, and that tag's text."""
        out = []
        while self.at < len(self.pieces):
            kind, body = self.pieces[self.at]
            self.at += 1
            if kind == "text":
                out.append((lambda t: lambda env: [t])(body))
            elif kind == "print":
                out.append((lambda e: lambda env: [_printed(e(env))])(_Expression(body).parse()))
            else:
                word = body.split(None, 1)[0] if body else ""
                if word in ends:
                    return out, body
                out.append(self.block(word, body[len(word):].strip()))
        if ends:
            raise TemplateError(f"{ends[-1]!r} is missing")
        return out, ""

    def block(self, word: str, rest: str):
        if word == "for":
            m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.*)", rest, re.DOTALL)
            if not m:
                raise TemplateError(f"cannot read the loop {rest!r}")
            body, _ = self.until("endfor")
            return (lambda name, over, body: lambda env: _for(name, over(env), body, env))(m[1], _Expression(m[2]).parse(), body)
        if word == "if":
            branches, cond = [], _Expression(rest).parse()
            while True:
                body, tag = self.until("elif", "else", "endif")
                branches.append((cond, body))
                if tag.startswith("elif"):
                    cond = _Expression(tag[4:].strip()).parse()
                elif tag == "else":
                    last, _ = self.until("endif")
                    branches.append((lambda env: Const(True), last))
                    break
                else:
                    break
            return lambda env: _if(branches, env)
        if word == "set":
            m = re.fullmatch(r"([A-Za-z_]\w*)\s*=(?!=)\s*(.*)", rest, re.DOTALL)
            if not m:
                raise TemplateError(f"cannot read {rest!r}")
            return (lambda name, value: lambda env: env.__setitem__(name, value(env)) or [])(m[1], _Expression(m[2]).parse())
        raise TemplateError(f"unknown block {word!r}")


def _printed(v: Value) -> str | Column:
    return _const_text(v) if _known(v) else text_of(v)


def _run(nodes: list, env: dict) -> list[str | Column]:
    """The parts of a block, neighbouring known texts joined."""
    out: list[str | Column] = []
    for node in nodes:
        for part in node(env):
            if isinstance(part, str) and out and isinstance(out[-1], str):
                out[-1] += part
            elif not isinstance(part, str) or part:
                out.append(part)
    return out


def _column(parts: Sequence[str | Column]) -> Column:
    columns = [F.lit(p) if isinstance(p, str) else p for p in parts]
    return columns[0] if len(columns) == 1 else F.concat(*columns) if columns else F.lit("")


def _for(name: str, over: Value, body: list, env: dict) -> list[str | Column]:
    if _known(over):
        items = list(_plain(over) or ())
        return [p for i, x in enumerate(items) for p in _run(body, env | {name: Const(x), "loop": _Loop(Const(i), Const(len(items)))})]
    if not isinstance(over.type, T.ArrayType):
        raise TemplateError(f"a value of type {over.type.simpleString()} is no list")
    size = Data(F.size(over.col).cast("long"), T.LongType())

    def each(x: Column, i: Column) -> Column:
        inner = env | {name: Data(x, over.type.elementType), "loop": _Loop(Data(i.cast("long"), T.LongType()), size)}
        return _column(_run(body, inner))

    return [F.coalesce(F.array_join(F.transform(over.col, each), ""), F.lit(""))]


def _if(branches: list, env: dict) -> list[str | Column]:
    out: Column | None = None
    for cond, body in branches:
        c = truth(cond(env))
        if isinstance(c, Const):
            if not c.value:
                continue
            parts = _run(body, env if out is None else dict(env))  # a name set under a known condition stays set
            return parts if out is None else [out.otherwise(_column(parts))]
        text = _column(_run(body, dict(env)))
        out = F.when(c.col, text) if out is None else out.when(c.col, text)
    return [] if out is None else [out.otherwise("")]


# ---------------------------------------------------------------- use


class Template:
    """A chat template, read once and compiled for any table."""

    def __init__(self, text: str):
        self.nodes, _ = _Nodes(_pieces(text)).until()

    def column(self, df: DataFrame, names: dict[str, str] | Sequence[str] = ("messages",), **known: Any) -> Column:
        """The rendered text for each row of ``df``.

        ``names`` maps the template's variables to columns (or lists columns that
        go under their own names); ``known`` are values fixed for the whole query, such
        as ``add_generation_prompt`` or ``eos_token``. A variable that is neither is undefined.
        """
        columns = names if isinstance(names, dict) else {n: n for n in names}
        env: dict = {k: Const(v) for k, v in known.items()}
        env |= {n: Data(F.col(c), df.schema[c].dataType) for n, c in columns.items()}
        return _column(_run(self.nodes, env))
