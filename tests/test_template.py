"""Compiled chat templates against rendered goldens and against the fixed expressions."""

import pytest
from pyspark.sql import functions as F

from rewardlens.functions import chat as C
from rewardlens.functions.template import CHATML, CHATML_TOOLS, SIMPLE_CHAT, SIMPLE_SFT, Template, TemplateError

MESSAGES = "array<struct<role: string, content: string>>"
TALKS = [
    [("user", "Hi"), ("assistant", "hello THERE")],
    [("system", "Be brief."), ("user", "One?"), ("assistant", "1"), ("user", "éü 中")],
    [("sYSTEM", " "), ("user", "")],
    [],
]


@pytest.fixture(scope="module")
def talks(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TALKS)], f"k int, messages {MESSAGES}")


def rendered(df, text, *args, **known):
    return [r[0] for r in df.orderBy("k").select(Template(text).column(df, *args, **known)).collect()]


def test_the_fixed_templates_come_out_unchanged(talks):
    for text, name in ((CHATML, "chatml"), (SIMPLE_CHAT, "simple_chat"), (SIMPLE_SFT, "simple_sft")):
        for gen in (True, False):
            want = [r[0] for r in talks.orderBy("k").select(C.render("messages", name, gen)).collect()]
            assert rendered(talks, text, add_generation_prompt=gen, eos_token="</s>") == want


def test_tools(spark, talks):
    tools = [{"name": "add", "args": ["a", "é"]}, {"name": "now"}]
    got = rendered(talks, CHATML_TOOLS, tools=tools, add_generation_prompt=True)
    lines = '# Tools\n{"name":"add","args":["a","é"]}\n{"name":"now"}\n<|im_end|>\n'
    assert got[0] == f"<|im_start|>system\n{lines}<|im_start|>user\nHi<|im_end|>\n<|im_start|>assistant\nhello THERE<|im_end|>\n<|im_start|>assistant\n"
    assert got[1].startswith(f"<|im_start|>system\nBe brief.\n\n{lines}<|im_start|>user\nOne?") and got[1].count("Be brief.") == 1
    # without tools it is ChatML, and so is a column of tools that is empty
    plain = rendered(talks, CHATML, add_generation_prompt=True)
    assert rendered(talks, CHATML_TOOLS, add_generation_prompt=True) == plain
    with_column = talks.withColumn("t", F.array().cast("array<struct<name: string>>"))
    assert rendered(with_column, CHATML_TOOLS, {"messages": "messages", "tools": "t"}, add_generation_prompt=True) == plain
    one = talks.withColumn("t", F.array(F.struct(F.lit("add").alias("name"))))
    assert rendered(one, CHATML_TOOLS, {"messages": "messages", "tools": "t"})[0].startswith('<|im_start|>system\n# Tools\n{"name":"add"}\n<|im_end|>\n')


GOLDENS = [
    ("{% for m in messages %}{{ loop.index }}/{{ loop.length }}{% if not loop.last %}, {% endif %}{% endfor %}", ["1/2, 2/2", "1/4, 2/4, 3/4, 4/4", "1/2, 2/2", ""]),
    ("{{ messages[0].role if messages else 'none' }}", ["user", "system", "sYSTEM", "none"]),
    ("{{ messages[-1]['content'] | trim | upper }}", ["HELLO THERE", "ÉÜ 中", "", ""]),
    ("{% if messages|length > 3 %}long{% elif messages[0].role == 'user' %}user{% else %}other{% endif %}", ["user", "long", "other", "other"]),
    ("{% set who = 'me' %}{{ who ~ '-' ~ bos_token }}", ["me-<s>"] * 4),
    ("{% for m in messages[1:] %}{{ m.role[0:] if false else m.role.lower() }};{% endfor %}", ["assistant;", "user;assistant;user;", "user;", ""]),
    ("{% for m in messages[:-1] if_ %}{% endfor %}", None),
    ("{% for m in messages %}{% if m.role in ['x'] %}{% endif %}{% endfor %}", None),
    ("{% for m in messages %}{{ 'T' if loop.index0 % 2 == 0 else 'F' }}{% endfor %}", ["TF", "TFTF", "TF", ""]),
    ("{% for m in messages %}{% if m.name is defined %}{{ m.name }}{% else %}-{% endif %}{% endfor %}", ["--", "----", "--", ""]),
    ("{% for m in messages %}{% if 'e' in m.content and not m.role.startswith('s') or m.content == '1' %}{{ m.content }}|{% endif %}{% endfor %}", ["hello THERE|", "One?|1|", "", ""]),
    ("{{ \"it's\\n\" }}{# nothing #}{{- 'x' -}}   y", ["it's\nxy"] * 4),
    ("{{ missing }}[{{ missing | default('d') }}]{{ messages | count }}", ["[d]2", "[d]4", "[d]2", "[d]0"]),
    ("a\n  {% if true %}\nb\n  {% endif %}\nc", ["a\nb\nc"] * 4),
    ("{{ (messages[0].content or 'empty').replace('H', 'J') }}", ["Ji", "Be brief.", " ", "empty"]),
    ("{{ messages[0] | tojson }}", ['{"role":"user","content":"Hi"}', '{"role":"system","content":"Be brief."}', '{"role":"sYSTEM","content":" "}', None]),
    ("{% for t in ['a', 'b'] %}{{ t }}{% endfor %}", None),
    ("{{ 3 - 1 + 2 }}{{ 'x' if messages[0].content != 'Hi' and 1 < 2 }}", ["4", "4x", "4x", "4x"]),
]


@pytest.mark.parametrize("text, want", GOLDENS)
def test_goldens(talks, text, want):
    if want is None:
        with pytest.raises(TemplateError):
            Template(text).column(talks)
        return
    got = rendered(talks, text, bos_token="<s>")
    assert [g for g, w in zip(got, want) if w is not None] == [w for w in want if w is not None]


@pytest.mark.parametrize("text", ["{% for m in messages %}", "{{ 'a }}", "{% while x %}", "{{ messages | nope }}", "{{ a b }}", "{% if %}x{% endif %}", "{{ messages.role }}", "{{ (a }}", "{% endfor %}"])
def test_faults_are_found_when_compiled(talks, text):
    with pytest.raises(TemplateError):
        Template(text).column(talks)


def test_nulls_and_exceptions(spark):
    df = spark.createDataFrame([(0, [("user", None)]), (1, None)], f"k int, messages {MESSAGES}")
    assert rendered(df, CHATML) == ["<|im_start|>user\n<|im_end|>\n", ""]
    strict = "{% for m in messages %}{% if m.role != 'assistant' %}{{ raise_exception('only assistants') }}{% endif %}{% endfor %}"
    with pytest.raises(Exception, match="only assistants"):
        rendered(df, strict)
    ok = spark.createDataFrame([(0, [("assistant", "x")])], f"k int, messages {MESSAGES}")
    assert rendered(ok, strict) == [""]


def test_known_conditions_leave_no_trace_in_the_plan(talks):
    plan = talks.select(Template(CHATML_TOOLS).column(talks, add_generation_prompt=False).alias("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Tools" not in plan and "CASE" not in plan and plan.count("transform(") == 1
