"""Dialogues of preference_pairs as texts of every template and task."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftspark.operators import chat
from weftspark.plans import views
from weftspark.plans.registry import query

_C = "coalesce(m.content, '')"
_S = f"regexp_replace({_C}, '{chat.STRIP}', '', 'g')"
#: SQL for one message m, and the dialogue's frame.
_ONE = {
    "default": f"CASE WHEN m.role IN ('user', 'system', 'assistant') THEN concat('<|', m.role, '|>', chr(10), {_C}, '</s>', chr(10)) ELSE '' END",
    "no_special": f"CASE m.role WHEN 'user' THEN concat('User: ', {_S}, ' ') WHEN 'system' THEN concat('System: ', {_S}, ' ') WHEN 'assistant' THEN concat('Assistant: ', {_C}, '</s>') ELSE '' END",
    "ultralm": f"CASE m.role WHEN 'user' THEN concat('User: ', {_S}, chr(10)) WHEN 'system' THEN concat('System: ', {_S}, chr(10)) WHEN 'assistant' THEN concat('Assistant: ', {_C}, '</s>', chr(10)) ELSE '' END",
    "vicuna": f"CASE m.role WHEN 'user' THEN concat('USER: ', {_S}) WHEN 'assistant' THEN concat(' ASSISTANT: ', {_S}, '</s>') ELSE '' END",
    "alpaca": f"CASE m.role WHEN 'user' THEN concat('### Instruction:', chr(10), {_S}, chr(10)) WHEN 'assistant' THEN concat('### Response:', chr(10), {_S}, '</s>', chr(10)) ELSE '' END",
    "star": f"CASE m.role WHEN 'user' THEN concat('<|user|>', chr(10), {_S}, '<|end|>') WHEN 'system' THEN concat('<|system|>', chr(10), {_S}, '<|end|>') WHEN 'assistant' THEN concat('<|assistant|>', chr(10), {_C}, '<|end|>') ELSE '' END",
    "chatml": f"CASE WHEN m.role IN ('user', 'system', 'assistant') THEN concat('<|im_start|>', m.role, chr(10), {_C}, '<|im_end|>', chr(10)) ELSE '' END",
}


def _loop(messages, template):
    if template in ("no_special", "ultralm", "star"):
        return f"CASE WHEN coalesce({messages}[1].content, '') = '' THEN {messages}[2:] ELSE {messages} END"
    if template in ("vicuna", "alpaca"):
        return f"CASE WHEN {messages}[1].role = 'system' THEN {messages}[2:] ELSE {messages} END"
    return messages


def _text(messages, template, end="''"):
    text = f"array_to_string(list_transform({_loop(messages, template)}, lambda m: {_ONE[template]}), '')"
    if template not in ("vicuna", "alpaca"):
        return f"concat({text}, {end})"
    after = "' '" if template == "vicuna" else "chr(10)"
    lead = f"concat('<s>', CASE WHEN {messages}[1].role = 'system' THEN concat(regexp_replace(coalesce({messages}[1].content, ''), '{chat.STRIP}', '', 'g'), {after}) ELSE '' END)"
    odd = f"list_bool_or(list_transform({_loop(messages, template)}, lambda m, i: (m.role = 'user') <> (i % 2 = 1)))"
    return f"CASE WHEN coalesce({odd}, false) THEN NULL ELSE concat({lead}, {text}, {end}) END"


def _sft(template):
    @query(f"chat_sft_{template}", f"SELECT pair_id, {_text('messages', template)} AS text FROM {{dialogues}}")
    def run(spark, folder):
        return chat.formatted(views.dialogues(spark, folder, "messages"), "sft", template).select("pair_id", "text")


for _template in _ONE:
    _sft(_template)

_ASKED = "CASE WHEN len(messages) > 0 THEN concat('<|im_start|>assistant', chr(10)) ELSE '' END"
_ASKED_VICUNA = f"CASE WHEN ({_loop('chosen[1:2]', 'vicuna')})[-1].role = 'user' THEN ' ASSISTANT:' ELSE '' END"


@query("chat_generation", f"SELECT pair_id, {_text('messages', 'chatml', _ASKED)} AS text FROM {{dialogues}}")
def chat_generation(spark, folder):
    return chat.formatted(views.dialogues(spark, folder, "messages"), "generation", "chatml").select("pair_id", "text")


@query("chat_generation_vicuna", f"SELECT pair_id, {_text('chosen[1:2]', 'vicuna', _ASKED_VICUNA)} AS text FROM {{dialogues}}")
def chat_generation_vicuna(spark, folder):
    rows = views.dialogues(spark, folder, "chosen").withColumn("messages", F.slice("chosen", 1, 2))
    return chat.formatted(rows, "generation", "vicuna").select("pair_id", "text")


@query("chat_rm", f"SELECT pair_id, {_text('chosen', 'ultralm')} AS text_chosen, {_text('rejected', 'ultralm')} AS text_rejected FROM {{dialogues}}")
def chat_rm(spark, folder):
    return chat.formatted(views.dialogues(spark, folder, "chosen", "rejected"), "rm", "ultralm").select("pair_id", "text_chosen", "text_rejected")


@query("chat_dpo", f"SELECT pair_id, {_text('chosen[1:len(chosen) - 1]', 'default')} AS text_prompt, {_text('chosen[len(chosen):len(chosen)]', 'default')} AS text_chosen, {_text('rejected[len(rejected):len(rejected)]', 'default')} AS text_rejected FROM {{dialogues}}")
def chat_dpo(spark, folder):
    return chat.formatted(views.dialogues(spark, folder, "chosen", "rejected"), "dpo", "default").select("pair_id", "text_prompt", "text_chosen", "text_rejected")


_INSERTED = "CASE WHEN len(messages) > 0 AND coalesce(messages[1].role, '') <> 'system' AND CAST(concat('0x', substr(md5(concat('42:', pair_id)), 1, 8)) AS BIGINT) / CAST(4294967296 AS DOUBLE) < CAST(0.8 AS DOUBLE) THEN list_concat([{'role': 'system', 'content': ''}], messages) ELSE messages END"


@query("chat_system_insert", f"SELECT pair_id, {_text('messages', 'chatml')} AS text FROM (SELECT pair_id, {_INSERTED} AS messages FROM {{dialogues}})")
def chat_system_insert(spark, folder):
    return chat.formatted(views.dialogues(spark, folder, "messages"), "sft", "chatml", key="pair_id").select("pair_id", "text")


@query("chat_rank_text", f"SELECT pair_id, regexp_replace(array_to_string(list_transform(chosen, lambda m: concat(coalesce(m.role, ''), ': ', {_C})), chr(10)), '{chat.STRIP}', '', 'g') AS text FROM {{dialogues}}")
def chat_rank_text(spark, folder):
    return views.dialogues(spark, folder, "chosen").select("pair_id", chat.rank_text(F.col("chosen")).alias("text"))


@query("chat_dpo_columns", f"SELECT pair_id, {_text('chosen[1:len(chosen) - 1]', 'chatml')} AS prompt, {_text('chosen[len(chosen):len(chosen)]', 'chatml')} AS chosen, {_text('rejected[len(rejected):len(rejected)]', 'chatml')} AS rejected FROM {{dialogues}}")
def chat_dpo_columns(spark, folder):
    return chat.renamed(chat.formatted(views.dialogues(spark, folder, "chosen", "rejected"), "dpo", "chatml")).select("pair_id", "prompt", "chosen", "rejected")
