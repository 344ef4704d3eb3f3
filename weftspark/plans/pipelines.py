"""Whole ways from a table of dialogues to what a training stage takes; their steps have SQL of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftspark.operators import chat, mixing, preferences, tokens
from weftspark.plans import views
from weftspark.plans.registry import query

#: Fractions of the sources by their place in alphabetical order: whole, repeated and partly taken.
FRACTIONS = (1.0, 1.5, 0.25, 2.0)
LENGTH = 256


def mixed_dialogues(spark, folder) -> DataFrame:
    """Dialogues of every source, once each and in the fractions of the mix, with ``copy``."""
    rows = views.dialogues(spark, folder, "source", "messages").where("source is not null").select("source", F.col("pair_id").alias("pos"), "messages", mixing.canonical("messages").alias("key"))
    names = sorted(r.source for r in rows.select("source").distinct().collect())  # sources of a mix are few
    fractions = {s: FRACTIONS[i % len(FRACTIONS)] for i, s in enumerate(names)}
    return mixing.mixed(mixing.deduplicated(rows, "key", names), fractions)


@query("pipeline_sft")
def pipeline_sft(spark, folder):
    """(source, copy, batch, chunk, n, kept): mix, tokens, packing, masked labels, without chunks that are mostly masked."""
    rows = mixed_dialogues(spark, folder).select("source", "copy", "pos", F.expr("pos div 64").alias("batch"), tokens.chat_tokens(F.col("messages")).alias("input_ids"))
    packed = tokens.sft_rows(rows, LENGTH, ["<|assistant|>"], ["<|end|>"], by=("source", "copy", "batch"))
    return packed.select("source", "copy", "batch", "chunk", F.size("input_ids").alias("n"), F.size(F.filter("labels", lambda x: x != "-100")).alias("kept"))


@query("pipeline_dpo")
def pipeline_dpo(spark, folder):
    """(pair_id, chosen_n, rejected_n, masked): pairs once by their id of both dialogues, as text, tokenised, cut and padded in batches of 16."""
    rows = views.dialogues(spark, folder, "chosen", "rejected").where("size(chosen) > 0 and size(rejected) > 0").withColumns({"source": F.lit("all"), "pos": F.col("pair_id"), "key": mixing.full_id()})
    texts = chat.renamed(chat.formatted(mixing.deduplicated(rows, "key"), "dpo", "chatml", key="pair_id"))
    words = lambda c: F.filter(F.split(c, r"[ \t\n\r\f]+"), lambda w: w != "")
    ids = texts.select("pair_id", words(F.col("prompt")).alias("prompt_ids"), *(words(F.concat("prompt", s)).alias(f"{s}_full") for s in ("chosen", "rejected")))
    ready = tokens.dpo_rows(ids, "<s>", "</s>", 256, 128).where("valid").withColumn("batch", F.expr("pair_id div 16"))
    out = tokens.padded(ready, {"chosen_input_ids": "<pad>", "rejected_input_ids": "<pad>", "chosen_labels": "-100"}, multiple=8)
    masked = F.size(F.filter("chosen_labels", lambda x: x == "-100"))
    return out.select("pair_id", F.size("chosen_input_ids").alias("chosen_n"), F.size("rejected_input_ids").alias("rejected_n"), masked.alias("masked"))


@query("pipeline_online")
def pipeline_online(spark, folder):
    """(gen_id, use, chosen, rejected): sampled answers that differ, ranked by length, mixed with the original pairs."""
    rows = preferences.varied(views.candidates(spark, folder))
    ranks = F.transform("gen_answers", lambda a: 1 + F.size(F.filter("gen_answers", lambda b: F.length(b) > F.length(a))))
    picked = rows.select("gen_id", "prompt_id", preferences.best_worst(F.col("gen_answers"), ranks).alias("p")).select("gen_id", "prompt_id", F.col("p.best").alias("chosen"), F.col("p.worst").alias("rejected"))
    last = lambda c: F.expr(f"try_element_at({c}, -1).content").alias(c)
    original = views.dialogues(spark, folder, "prompt_id", "chosen", "rejected").select("prompt_id", last("chosen"), last("rejected"))
    return preferences.mixed_original(picked, original, 0.3, 0.1).select("gen_id", "use", "chosen", "rejected")
