"""Dialogues as text: chat templates as column expressions, and the forms of each training task."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What counts as white space at the ends of a text, in Java's and RE2's syntax alike.
SPACE = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
STRIP = f"^{SPACE}+|{SPACE}+$"
EMPTY_SYSTEM_CHANCE = 0.8


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, STRIP, "")


@dataclass(frozen=True)
class Template:
    """How the messages of a dialogue follow one another.

    parts has for each role what comes before and after its content and whether that is stripped; other roles leave no
    trace. skip_empty drops a first message with empty content; lead puts bos and the stripped first system message
    before the rest, whose roles must then alternate from the user on. prompt is what asks for an answer at the end,
    after any last message or after the user's only.
    """

    parts: dict[str, tuple[str, str, bool]]
    skip_empty: bool = False
    lead: str | None = None
    after_lead: str = ""
    prompt: str = ""
    prompt_after_user: bool = False
    has_system: bool = True


#: The published layouts, with {eos} for the end of a sequence.
TEMPLATES = {
    "default": Template({r: (f"<|{r}|>\n", "{eos}\n", False) for r in ("user", "system", "assistant")}, prompt="<|assistant|>\n"),
    "no_special": Template({"user": ("User: ", " ", True), "system": ("System: ", " ", True), "assistant": ("Assistant: ", "{eos}", False)}, skip_empty=True),
    "ultralm": Template({"user": ("User: ", "\n", True), "system": ("System: ", "\n", True), "assistant": ("Assistant: ", "{eos}\n", False)}, skip_empty=True),
    "vicuna": Template({"user": ("USER: ", "", True), "assistant": (" ASSISTANT: ", "{eos}", True)}, lead="{bos}", after_lead=" ", prompt=" ASSISTANT:", prompt_after_user=True),
    "alpaca": Template({"user": ("### Instruction:\n", "\n", True), "assistant": ("### Response:\n", "{eos}\n", True)}, lead="{bos}", after_lead="\n", prompt="### Instruction:\n", prompt_after_user=True),
    "star": Template({"user": ("<|user|>\n", "<|end|>", True), "system": ("<|system|>\n", "<|end|>", True), "assistant": ("<|assistant|>\n", "<|end|>", False)}, skip_empty=True),
    "chatml": Template({r: (f"<|im_start|>{r}\n", "<|im_end|>\n", False) for r in ("user", "system", "assistant")}, prompt="<|im_start|>assistant\n"),
    "gemma": Template({"user": ("<start_of_turn>user\n", "<end_of_turn>\n", False), "assistant": ("<start_of_turn>model\n", "<end_of_turn>\n", False)}, prompt="<start_of_turn>model\n", has_system=False),
    "zephyr": Template({r: (f"<|{r}|>\n", "</s>\n", False) for r in ("user", "system", "assistant")}, prompt="<|assistant|>\n"),
}


def evaluation_template(model: str) -> str | None:
    """Template of an evaluated model by a part of its name, or none."""
    return next((t for t in ("gemma", "chatml", "zephyr") if f"templ_{t}" in model.lower()), None)


def active_template(chosen: str | None, own: str | None = None, automatic: bool = False) -> str:
    """The template asked for, else the tokenizer's own, else the default one if that may be set."""
    if chosen or own:
        return chosen or own
    if automatic:
        return "default"
    raise ValueError("no chat template")


def _content(m: Column) -> Column:
    return F.coalesce(m["content"], F.lit(""))


def render(messages: Column, template: str, bos: str = "<s>", eos: str = "</s>", generation: bool = False, strict: bool = False) -> Column:
    """The dialogue as text; null contents are empty, and so is a dialogue without messages.

    Where roles should alternate and don't, the text is null, or with strict the query fails.
    """
    t = TEMPLATES[template]
    lit = lambda s: F.lit(s.replace("{bos}", bos).replace("{eos}", eos))

    def one(m: Column) -> Column:
        out: Column = F.lit("")
        for role, (before, after, strip) in t.parts.items():
            text = stripped(_content(m)) if strip else _content(m)
            out = F.when(m["role"] == role, F.concat(lit(before), text, lit(after))).otherwise(out)
        return out

    first = F.get(messages, F.lit(0))
    rest = F.slice(messages, 2, F.size(messages))
    lead: Column = F.lit("")
    loop = messages
    if t.skip_empty:
        loop = F.when(_content(first) == "", rest).otherwise(messages)
    if t.lead is not None:
        system = first["role"] == "system"
        loop = F.when(system, rest).otherwise(messages)
        lead = F.concat(lit(t.lead), F.when(system, F.concat(stripped(_content(first)), lit(t.after_lead))).otherwise(F.lit("")))
    text = F.concat(lead, F.array_join(F.transform(loop, one), ""))
    if generation and t.prompt:
        asked = F.size(loop) > 0
        if t.prompt_after_user:
            asked = asked & (F.try_element_at(loop, F.lit(-1))["role"] == "user")
        text = F.when(F.coalesce(asked, F.lit(False)), F.concat(text, lit(t.prompt))).otherwise(text)
    if t.lead is not None:
        odd = F.exists(F.transform(loop, lambda m, i: (m["role"] == "user") != (i % 2 == 0)), lambda x: x)
        wrong = F.raise_error(F.lit("roles must alternate from the user on")).cast("string") if strict else F.lit(None).cast("string")
        text = F.when(F.coalesce(odd, F.lit(False)), wrong).otherwise(text)
    return text


def chance(*key: Column | str, seed: int = 42) -> Column:
    """A number from 0 to 1 that hangs on the key only, by the first 32 bits of an md5."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in key)))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(2.0**32)


def system_inserted(messages: Column, key: Column | str, template: str, p: float = EMPTY_SYSTEM_CHANCE, seed: int = 42) -> Column:
    """With chance p an empty system message before dialogues without one, if the template has a place for it."""
    if not TEMPLATES[template].has_system:
        return messages
    empty = F.array(F.struct(F.lit("system").alias("role"), F.lit("").alias("content")))
    wanted = (F.size(messages) > 0) & (F.coalesce(F.get(messages, F.lit(0))["role"], F.lit("")) != "system") & (chance(key, seed=seed) < p)
    return F.when(wanted, F.concat(empty, messages)).otherwise(messages)


def formatted(rows: DataFrame, task: str, template: str, key: str | None = None, **options) -> DataFrame:
    """Rows with the texts of a task: sft and generation ``text``, rm ``text_chosen`` and ``text_rejected``, dpo those of the last turns and ``text_prompt``.

    With a key, empty system messages are inserted. Raises ValueError for another task or missing columns.
    """
    need = {"sft": ["messages"], "generation": ["messages"], "rm": ["chosen", "rejected"], "dpo": ["chosen", "rejected"]}
    if task not in need:
        raise ValueError(f"task {task!r} is none of {', '.join(need)}")
    gone = [c for c in need[task] if c not in rows.columns]
    if gone:
        raise ValueError(f"columns are missing: {', '.join(gone)}")
    put = (lambda m: system_inserted(m, key, template)) if key else (lambda m: m)
    if task in ("sft", "generation"):
        return rows.withColumn("text", render(put(F.col("messages")), template, generation=task == "generation", **options))
    if task == "rm":
        return rows.withColumns({f"text_{c}": render(put(F.col(c)), template, **options) for c in ("chosen", "rejected")})
    last = lambda c: F.slice(c, F.greatest(F.size(c), F.lit(1)), 1)
    prompt = F.slice("chosen", F.lit(1), F.greatest(F.size("chosen") - 1, F.lit(0)))
    return rows.withColumns({"text_prompt": render(put(prompt), template, **options)} | {f"text_{c}": render(last(c), template, **options) for c in ("chosen", "rejected")})


def renamed(rows: DataFrame) -> DataFrame:
    """text_prompt, text_chosen and text_rejected, where there are such columns, as prompt, chosen and rejected; these are replaced."""
    found = [c for c in ("prompt", "chosen", "rejected") if f"text_{c}" in rows.columns]
    return rows.drop(*found).withColumnsRenamed({f"text_{c}": c for c in found})


def rank_text(messages: Column) -> Column:
    """Lines ``role: content``, without white space at the ends."""
    return stripped(F.array_join(F.transform(messages, lambda m: F.concat(F.coalesce(m["role"], F.lit("")), F.lit(": "), _content(m))), "\n"))
