"""Conversation / preference-shaping queries over the conversations table."""

from __future__ import annotations

from pyspark.sql import functions as F

from rewardlens.functions import chat as C
from rewardlens.functions import template as TP
from rewardlens.operators import conversation as OC
from rewardlens.plans import fixtures as V
from rewardlens.plans import sqltext as S
from rewardlens.plans.catalog import query
from rewardlens.sources.tables import image_path, read_table


def _joined(col):
    return V.joined_text(F.col(col))


@query("assemble_messages", f"""
SELECT conv_id, len(messages) AS n_messages, {S.joined('messages', 'role', "','")} AS roles,
       {S.joined('messages')} AS text
FROM ({V.SQL_MESSAGES})""")
def q_assemble_messages(spark, sf):
    m = V.messages(spark, sf)
    return m.select(
        "conv_id", F.size("messages").alias("n_messages"),
        F.array_join(F.transform("messages", lambda x: x["role"]), ",").alias("roles"),
        _joined("messages").alias("text"),
    )


@query("dataset_kind", f"""
SELECT 'messages' AS view, 'language_modeling' AS kind, true AS conversational, (SELECT count(*) FROM ({V.SQL_MESSAGES})) AS n_rows
UNION ALL SELECT 'prompt_completion', 'prompt_completion', true, (SELECT count(*) FROM ({V.SQL_PROMPT_COMPLETION}))
UNION ALL SELECT 'preference', 'preference', true, (SELECT count(*) FROM ({V.SQL_PREFERENCE}))
UNION ALL SELECT 'implicit', 'preference_implicit', true, (SELECT count(*) FROM ({V.SQL_IMPLICIT}))
UNION ALL SELECT 'unpaired', 'unpaired_preference', false, (SELECT 2 * count(*) FROM ({V.SQL_PREF_TEXT}))
UNION ALL SELECT 'prompt_only', 'prompt_only', false, (SELECT count(*) FROM ({V.SQL_PREF_TEXT}))""")
def q_dataset_kind(spark, sf):
    t = V.pref_text(spark, sf)
    views = {
        "messages": V.messages(spark, sf).drop("conv_id"),
        "prompt_completion": V.prompt_completion(spark, sf).drop("conv_id"),
        "preference": V.preference(spark, sf).drop("conv_id"),
        "implicit": V.implicit(spark, sf).drop("conv_id"),
        "unpaired": OC.unpair_preference(t.select(F.col("question").alias("prompt"), "chosen", "rejected")),
        "prompt_only": t.select(F.col("question").alias("prompt")),
    }
    out = None
    for name, df in views.items():
        # kind and form come from the schema on the driver; the count is a job
        row = df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("view"), F.lit(OC.dataset_kind(df)).alias("kind"),
            F.lit(OC.is_conversational(df)).alias("conversational"), "n_rows",
        )
        out = row if out is None else out.unionByName(row)
    return out


@query("is_conversational", f"""
SELECT 'messages' AS view, true AS conversational, (SELECT count(*) FROM ({V.SQL_MESSAGES})) AS n_rows
UNION ALL SELECT 'pref_text', false, (SELECT count(*) FROM ({V.SQL_PREF_TEXT}))""")
def q_is_conversational(spark, sf):
    out = None
    for name, df in (("messages", V.messages(spark, sf)), ("pref_text", V.pref_text(spark, sf).withColumnRenamed("question", "prompt"))):
        row = df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("view"), F.lit(OC.is_conversational(df)).alias("conversational"), "n_rows")
        out = row if out is None else out.unionByName(row)
    return out


for _tpl in C.TEMPLATES:
    def _mk(tpl):
        @query(f"template_{tpl}", f"""
SELECT conv_id, {S.render('messages', tpl)} AS text FROM ({V.SQL_MESSAGES})""")
        def q(spark, sf):
            m = V.messages(spark, sf)
            return m.select("conv_id", C.render("messages", tpl).alias("text"))
        return q
    _mk(_tpl)


@query("template_compiled", f"""
SELECT conv_id, {S.render('messages', 'chatml', gen=True)} AS chatml, {S.render('messages', 'simple_chat', gen=True)} AS simple_chat,
       {S.render('messages', 'simple_sft')} AS simple_sft FROM ({V.SQL_MESSAGES})""")
def q_template_compiled(spark, sf):
    m = V.messages(spark, sf)
    return m.select(
        "conv_id", TP.Template(TP.CHATML).column(m, add_generation_prompt=True).alias("chatml"),
        TP.Template(TP.SIMPLE_CHAT).column(m, add_generation_prompt=True).alias("simple_chat"),
        TP.Template(TP.SIMPLE_SFT).column(m, eos_token="</s>").alias("simple_sft"))


@query("template_tools", f"""
WITH t AS (SELECT conv_id, messages, range(len(messages) % 3) AS tools FROM ({V.SQL_MESSAGES})),
p AS (SELECT *, len(tools) > 0 AND messages[1].role = 'system' AS moved FROM t)
SELECT conv_id, CASE WHEN len(tools) > 0 THEN '<|im_start|>system' || chr(10)
         || CASE WHEN moved THEN messages[1].content || chr(10) || chr(10) ELSE '' END || '# Tools' || chr(10)
         || array_to_string(list_transform(tools, lambda i: '{{"name":"tool_' || i || '","turns":' || len(messages) || '}}' || chr(10)), '')
         || '<|im_end|>' || chr(10) ELSE '' END
       || {S.render('CASE WHEN moved THEN messages[2:] ELSE messages END', 'chatml', gen=True)} AS text
FROM p""")
def q_template_tools(spark, sf):
    m = V.messages(spark, sf)
    n = F.size("messages") % 3
    tools = F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")),
                        lambda i: F.struct(F.concat(F.lit("tool_"), i.cast("string")).alias("name"), F.size("messages").alias("turns")))
    m = m.withColumn("tools", tools)
    return m.select("conv_id", TP.Template(TP.CHATML_TOOLS).column(m, ["messages", "tools"], add_generation_prompt=True).alias("text"))


def _sql_apply(view: str, tpl: str, keys=("chosen", "rejected")) -> str:
    p = S.render("prompt", tpl, gen=True)
    parts = ", ".join(f"substr({S.render(f'list_concat(prompt, {k})', tpl)}, length({p}) + 1) AS {k}" for k in keys)
    return f"SELECT conv_id, {p} AS prompt, {parts} FROM ({view})"


@query("apply_chat_template", _sql_apply(V.SQL_PREFERENCE, "chatml"))
def q_apply_chat_template(spark, sf):
    return OC.apply_chat_template(V.preference(spark, sf), "chatml")


@query("maybe_apply_chat_template", _sql_apply(V.SQL_PROMPT_COMPLETION, "simple_chat", ("completion",)))
def q_maybe_apply_chat_template(spark, sf):
    return OC.maybe_apply_chat_template(V.prompt_completion(spark, sf), "simple_chat")


@query("template_prefix_check", f"""
SELECT conv_id, NOT starts_with({S.render('list_concat(prompt, completion)', 'simple_sft')}, {S.render('prompt', 'simple_sft')}) AS has_error
FROM ({V.SQL_PROMPT_COMPLETION})""")
def q_template_prefix_check(spark, sf):
    # the SFT template always ends in EOS, so every row fails the prefix check
    r = OC.apply_chat_template(V.prompt_completion(spark, sf), "simple_sft", strict=False)
    return r.select("conv_id", F.col("_error").isNotNull().alias("has_error"))


@query("unpair_preference", f"""
SELECT idx, question AS prompt, chosen AS completion, true AS label FROM ({V.SQL_PREF_TEXT})
UNION ALL SELECT idx, question, rejected, false FROM ({V.SQL_PREF_TEXT})""")
def q_unpair_preference(spark, sf):
    t = V.pref_text(spark, sf).withColumnRenamed("question", "prompt")
    return OC.unpair_preference(t)


@query("maybe_unpair_preference", f"""
SELECT conv_id, {S.joined('prompt')} AS prompt, {S.joined('chosen')} AS completion, true AS label FROM ({V.SQL_PREFERENCE})
UNION ALL SELECT conv_id, {S.joined('prompt')}, {S.joined('rejected')}, false FROM ({V.SQL_PREFERENCE})""")
def q_maybe_unpair_preference(spark, sf):
    u = OC.maybe_unpair_preference(V.preference(spark, sf))
    return u.select("conv_id", _joined("prompt").alias("prompt"), _joined("completion").alias("completion"), "label")


def _sql_extract_text() -> str:
    c, r = S.joined("chosen"), S.joined("rejected")
    return f"""
WITH x AS (SELECT conv_id, {c} AS c, {r} AS r FROM ({V.SQL_IMPLICIT})),
y AS (SELECT conv_id, c, r, least(length(c), length(r)) AS n, string_split(c, '') AS ca, string_split(r, '') AS ra FROM x),
z AS (SELECT conv_id, c, r, n, ca,
             coalesce(list_position(list_transform(range(1, n + 1), lambda i: ca[i] = ra[i]), false) - 1, n) AS p FROM y),
w AS (SELECT conv_id, c, r, CASE WHEN p >= n THEN n - 1
                                 WHEN (CASE WHEN p = 0 THEN ca[length(c)] ELSE ca[p] END) = ' ' THEN p - 1
                                 ELSE p END AS idx FROM z)
SELECT conv_id,
       CASE WHEN idx >= 0 THEN substr(c, 1, idx) ELSE substr(c, 1, length(c) - 1) END AS prompt,
       CASE WHEN idx >= 0 THEN substr(c, idx + 1) ELSE substr(c, length(c), 1) END AS chosen,
       CASE WHEN idx >= 0 THEN substr(r, idx + 1) ELSE substr(r, length(r), 1) END AS rejected
FROM w"""


@query("extract_prompt", _sql_extract_text())
def q_extract_prompt(spark, sf):
    i = V.implicit(spark, sf)
    t = i.select("conv_id", _joined("chosen").alias("chosen"), _joined("rejected").alias("rejected"))
    return OC.extract_prompt(t)


@query("maybe_extract_prompt", f"""
WITH y AS (SELECT conv_id, chosen, rejected, least(len(chosen), len(rejected)) AS n FROM ({V.SQL_IMPLICIT})),
z AS (SELECT *, coalesce(list_position(list_transform(range(1, n + 1),
                   lambda i: chosen[i] IS NOT DISTINCT FROM rejected[i]), false) - 1, n) AS p FROM y),
w AS (SELECT *, CASE WHEN p >= n THEN n - 1 ELSE p END AS idx FROM z)
SELECT conv_id, idx AS n_prompt, {S.joined('chosen[1:idx]')} AS prompt, {S.joined('chosen[idx + 1:]')} AS chosen,
       {S.joined('rejected[idx + 1:]')} AS rejected
FROM w""")
def q_maybe_extract_prompt(spark, sf):
    e = OC.maybe_extract_prompt(V.implicit(spark, sf))
    return e.select("conv_id", F.size("prompt").alias("n_prompt"), _joined("prompt").alias("prompt"),
                    _joined("chosen").alias("chosen"), _joined("rejected").alias("rejected"))


@query("build_chat_pair", f"""
SELECT idx, {S.render("[{'role': 'user', 'content': question}, {'role': 'assistant', 'content': chosen}]")} AS text
FROM ({V.SQL_PREF_TEXT})""")
def q_build_chat_pair(spark, sf):
    t = OC.build_chat_pair(V.pref_text(spark, sf), "question", "chosen")
    return t.select("idx", C.render("messages").alias("text"))


@query("concat_conversation", f"""
SELECT conv_id, {S.render('list_concat(prompt, completion)')} AS text FROM ({V.SQL_PROMPT_COMPLETION})""")
def q_concat_conversation(spark, sf):
    t = OC.concat_conversation(V.prompt_completion(spark, sf))
    return t.select("conv_id", C.render("messages").alias("text"))


@query("build_vlm_messages", f"""
SELECT idx, 'image,text' AS prompt_parts, question AS prompt_text, chosen AS chosen_text, rejected AS rejected_text
FROM ({V.SQL_PREF_TEXT})""")
def q_build_vlm_messages(spark, sf):
    t = OC.build_vlm_messages(V.pref_text(spark, sf))
    first = F.get(F.col("prompt"), 0)["content"]
    return t.select(
        "idx",
        F.array_join(F.transform(first, lambda p: p["type"]), ",").alias("prompt_parts"),
        F.get(first, 1)["text"].alias("prompt_text"),
        F.get(F.get(F.col("chosen"), 0)["content"], 0)["text"].alias("chosen_text"),
        F.get(F.get(F.col("rejected"), 0)["content"], 0)["text"].alias("rejected_text"),
    )


@query("bootstrap_completion", f"""
SELECT conv_id,
       CASE WHEN messages[len(messages)].role = 'assistant' THEN len(messages) - 1 ELSE len(messages) END AS n_prompt,
       (CASE WHEN messages[len(messages)].role = 'assistant' THEN messages[len(messages)].content ELSE '' END)
         || CAST(conv_id AS VARCHAR) AS completion
FROM ({V.SQL_MESSAGES})""")
def q_bootstrap_completion(spark, sf):
    m = V.messages(spark, sf).select("conv_id", F.col("messages").alias("prompt"), F.col("conv_id").cast("string").alias("completion"))
    b = OC.bootstrap_completion(m)
    return b.select("conv_id", F.size("prompt").alias("n_prompt"), F.get(F.col("completion"), 0)["content"].alias("completion"))


@query("project_drop", f"""SELECT idx, chosen, rejected FROM ({V.SQL_PREF_TEXT})""")
def q_project_drop(spark, sf):
    return V.pref_text(spark, sf).drop("question")


@query("project_signature", f"""SELECT question AS prompt FROM ({V.SQL_PREF_TEXT})""")
def q_project_signature(spark, sf):
    return OC.project_signature(V.pref_text(spark, sf).withColumnRenamed("question", "prompt"))


@query("cast_schema", f"""
SELECT CAST(CAST(idx AS INTEGER) AS BIGINT) AS idx, question, CAST(CAST(chosen_score AS FLOAT) AS DOUBLE) AS chosen_score FROM ({V.SQL_SCORED})""")
def q_cast_schema(spark, sf):
    from pyspark.sql import types as T
    schema = T.StructType([
        T.StructField("idx", T.IntegerType()), T.StructField("question", T.StringType()),
        T.StructField("chosen_score", T.FloatType()),
    ])
    return OC.cast_schema(V.scored(spark, sf), schema)


@query("reward_passthrough", f"""SELECT idx, label FROM (
  SELECT idx, true AS label FROM ({V.SQL_PREF_TEXT}) UNION ALL SELECT idx, false FROM ({V.SQL_PREF_TEXT}))""")
def q_reward_passthrough(spark, sf):
    from rewardlens.operators.rewards import reward_passthrough_cols
    u = OC.unpair_preference(V.pref_text(spark, sf).withColumnRenamed("question", "prompt"))
    return u.select(*reward_passthrough_cols(u))


@query("image_path_col", f"""SELECT idx, 'saved_images/' || CAST(idx AS VARCHAR) || '.jpg' AS image_path FROM ({V.SQL_PREF_TEXT})""")
def q_image_path_col(spark, sf):
    t = V.pref_text(spark, sf)
    return t.select("idx", image_path(F.col("idx")).alias("image_path"))


@query("name_tail", """SELECT page_id, 'rewards/' || string_split(url, '/')[-1] AS key FROM pages""")
def q_name_tail(spark, sf):
    p = read_table(spark, sf, "pages", ["page_id", "url"])
    return p.select("page_id", F.concat(F.lit("rewards/"), C.name_tail("url")).alias("key"))


@query("format_reward", """SELECT event_id, format('{:.2f}', value / 7) AS reward FROM events""")
def q_format_reward(spark, sf):
    e = read_table(spark, sf, "events", ["event_id", "value"])
    return e.select("event_id", C.format_reward(F.col("value") / F.lit(7)).alias("reward"))


@query("decode_strip_padding", f"""
SELECT conv_id, replace({S.render('messages')}, '<|im_end|>', '') AS text FROM ({V.SQL_MESSAGES})""")
def q_decode_strip_padding(spark, sf):
    m = V.messages(spark, sf)
    return m.select("conv_id", C.strip_token(C.render("messages"), C.CHATML_EOS).alias("text"))
