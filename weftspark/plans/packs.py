"""Token sequences: packing, masks, truncation, padding."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftspark.operators import tokens
from weftspark.plans import views
from weftspark.plans.registry import query

LENGTH, ROWS = 512, 64
_BATCH = f"SELECT source, pos // {ROWS} AS batch, pos, row_id, input_ids FROM {{sequences}}"
_PLACED = f"SELECT *, CAST(coalesce(sum(len(input_ids)) OVER (PARTITION BY source, batch ORDER BY pos, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s, CAST(sum(len(input_ids)) OVER (PARTITION BY source, batch) AS BIGINT) AS total FROM ({_BATCH})"
_CHUNKS = f"CAST(greatest(ceil(total / {LENGTH}) - 1, 0) AS BIGINT)"


def _batched(spark, folder):
    return views.sequences(spark, folder).withColumn("batch", F.expr(f"pos div {ROWS}")).withColumn("order", F.struct("pos", "row_id"))


def _packed(spark, folder, **more):
    return tokens.packed(_batched(spark, folder), LENGTH, by=("source", "batch"), order="order", **more)


@query(
    "pack_chunks",
    f"SELECT source, batch, CAST(floor(g / {LENGTH}) AS BIGINT) AS chunk, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(id AS BIGINT) * (g % {LENGTH} + 1)) AS BIGINT) AS weighted FROM (SELECT source, batch, {_CHUNKS} AS chunks, s + generate_subscripts(input_ids, 1) - 1 AS g, unnest(input_ids) AS id FROM ({_PLACED})) WHERE floor(g / {LENGTH}) < chunks GROUP BY ALL",
)
def pack_chunks(spark, folder):
    weighted = F.aggregate(F.transform("input_ids", lambda x, i: x.cast("bigint") * (i + 1)), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return _packed(spark, folder).select("source", "batch", "chunk", F.size("input_ids").cast("bigint").alias("n"), weighted.alias("weighted"))


@query(
    "pack_cu_seqlens",
    f"WITH p AS ({_PLACED}), o AS (SELECT source, batch, CAST(ceil(s / {LENGTH}) - 1 AS BIGINT) AS chunk, s - CAST(ceil(s / {LENGTH}) - 1 AS BIGINT) * {LENGTH} AS o FROM p WHERE s > 0 AND ceil(s / {LENGTH}) - 1 < {_CHUNKS}),"
    f" c AS (SELECT DISTINCT source, batch, unnest(range({_CHUNKS})) AS chunk FROM p), j AS (SELECT c.source, c.batch, c.chunk, coalesce(list(o ORDER BY o) FILTER (o IS NOT NULL), []) AS os FROM c LEFT JOIN o ON c.source = o.source AND c.batch = o.batch AND c.chunk = o.chunk GROUP BY ALL)"
    f" SELECT source, batch, chunk, array_to_string(CASE WHEN len(os) > 0 AND os[-1] = {LENGTH} THEN os ELSE list_append(os, {LENGTH}) END, ',') AS cu_seqlens FROM j",
)
def pack_cu_seqlens(spark, folder):
    return _packed(spark, folder).select("source", "batch", "chunk", F.array_join(F.transform("cu_seqlens", lambda x: x.cast("string")), ",").alias("cu_seqlens"))


@query("pack_with_tail", "SELECT source, CAST(sum(len(input_ids)) AS BIGINT) AS n FROM {sequences} GROUP BY source HAVING sum(len(input_ids)) > 0")
def pack_with_tail(spark, folder):
    return _packed(spark, folder, drop_tail=False).groupBy("source").agg(F.sum(F.size("input_ids")).cast("bigint").alias("n"))


@query(
    "combine_cu",
    f"WITH k AS (SELECT source, batch, CAST(sum(1) AS BIGINT) AS x FROM (SELECT DISTINCT source, batch, unnest(range({_CHUNKS})) AS chunk FROM ({_PLACED})) GROUP BY ALL) SELECT source, batch, CAST(x * {LENGTH} AS INTEGER) AS last, CAST(0 AS INTEGER) AS first FROM k",
)
def combine_cu(spark, folder):
    out = tokens.combined_offsets(_packed(spark, folder), by=("source", "batch"), order="chunk")
    return out.select("source", "batch", F.element_at("cu_seqlens", -1).alias("last"), F.element_at("cu_seqlens", 1).alias("first"))


@query("stack_batches", f"SELECT source, batch, CAST(max(c) AS BIGINT) AS rows, CAST({LENGTH} AS INTEGER) AS length FROM (SELECT source, batch, {_CHUNKS} AS c FROM ({_PLACED})) GROUP BY ALL HAVING max(c) > 0")
def stack_batches(spark, folder):
    return tokens.stacked(_packed(spark, folder), by=("source", "batch"))


_WORDS = "list_filter(string_split_regex(coalesce(m.content, ''), '[ \\t\\n\\r\\f]+'), lambda w: w <> '')"
_CHAT = f"SELECT pair_id, flatten(list_transform(messages, lambda m: list_concat(list_concat([concat('<|', m.role, '|>')], {_WORDS}), ['<|end|>']))) AS t FROM {{dialogues}}"
_KEPT = (
    f"WITH c AS ({_CHAT}), u AS (SELECT pair_id, generate_subscripts(t, 1) AS p, unnest(t) AS w FROM c),"
    " e AS (SELECT pair_id, p, CASE w WHEN '<|assistant|>' THEN 0 ELSE 1 END AS kind FROM u WHERE w IN ('<|assistant|>', '<|end|>')),"
    " l AS (SELECT pair_id, p, kind, lead(p) OVER o AS q, lead(kind) OVER o AS k FROM e WINDOW o AS (PARTITION BY pair_id ORDER BY p, kind)),"
    " s AS (SELECT pair_id, CAST(sum(q - p) AS BIGINT) AS kept FROM l WHERE kind = 0 AND k = 1 GROUP BY pair_id) "
)


def _labelled(spark, folder):
    chats = views.dialogues(spark, folder, "messages").select("pair_id", tokens.chat_tokens(F.col("messages")).alias("input_ids"))
    return tokens.masked_labels(chats, ["<|assistant|>"], ["<|end|>"], ignored="-100")


@query("label_mask", _KEPT + "SELECT c.pair_id, CAST(len(t) AS BIGINT) AS n, coalesce(kept, 0) AS kept FROM c LEFT JOIN s ON c.pair_id = s.pair_id")
def label_mask(spark, folder):
    kept = F.size(F.filter("labels", lambda x: x != "-100"))
    return _labelled(spark, folder).select("pair_id", F.size("input_ids").cast("bigint").alias("n"), kept.cast("bigint").alias("kept"))


@query("mask_filter", _KEPT + "SELECT c.pair_id FROM c LEFT JOIN s ON c.pair_id = s.pair_id WHERE len(t) - coalesce(kept, 0) <= CAST(0.9 AS DOUBLE) * len(t)")
def mask_filter(spark, folder):
    return tokens.mostly_learned(_labelled(spark, folder), ignored="-100").select("pair_id")


MAX, PROMPT = 128, 48


def _dpo(spark, folder, keep="keep_end"):
    words = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), r"[ \t\n\r\f]+"), lambda w: w != "")
    rows = views.dialogues(spark, folder, "prompt", "chosen", "rejected")
    answer = lambda s: words(F.expr(f"try_element_at({s}, -1).content"))
    rows = rows.select("pair_id", words(F.col("prompt")).alias("prompt_ids"), answer("chosen").alias("c"), answer("rejected").alias("r"))
    rows = rows.select("pair_id", "prompt_ids", F.concat("prompt_ids", "c").alias("chosen_full"), F.concat("prompt_ids", "r").alias("rejected_full"))
    return tokens.dpo_rows(rows, "<s>", "</s>", MAX, PROMPT, keep, ignored="-100")


def _count(c):
    return f"len(list_filter(string_split_regex(coalesce({c}, ''), '[ \\t\\n\\r\\f]+'), lambda w: w <> ''))"


_LENGTHS = (
    f"WITH n AS (SELECT pair_id, {_count('prompt')} + 1 AS p, {_count('chosen[-1].content')} + 1 AS c, {_count('rejected[-1].content')} + 1 AS r FROM {{dialogues}}),"
    f" t AS (SELECT pair_id, CASE WHEN p + greatest(c, r) > {MAX} THEN least(p, {PROMPT}) ELSE p END AS p, c, r, greatest(c, r) AS l FROM n),"
    f" a AS (SELECT pair_id, p, CASE WHEN p + l > {MAX} THEN least(c, {MAX - PROMPT}) ELSE c END AS c, CASE WHEN p + l > {MAX} THEN least(r, {MAX - PROMPT}) ELSE r END AS r FROM t) "
)


@query("dpo_tokenize_lengths", _LENGTHS + "SELECT pair_id, CAST(p + c AS INTEGER) AS chosen_n, CAST(p AS INTEGER) AS masked, CAST(p + r AS INTEGER) AS rejected_n FROM a")
def dpo_tokenize_lengths(spark, folder):
    masked = F.size(F.filter("chosen_labels", lambda x: x == "-100"))
    return _dpo(spark, folder).select("pair_id", F.size("chosen_input_ids").alias("chosen_n"), masked.alias("masked"), F.size("rejected_input_ids").alias("rejected_n"))


@query("dpo_tokenize_starts", f"WITH w AS (SELECT pair_id, list_concat(['<s>'], {_count('prompt')[4:-1]}) AS t, greatest({_count('chosen[-1].content')}, {_count('rejected[-1].content')}) + 1 AS l FROM {{dialogues}}) SELECT pair_id, array_to_string(CASE WHEN len(t) + l > {MAX} THEN t[1:{PROMPT}] ELSE t END, ' ') AS prompt FROM w")
def dpo_tokenize_starts(spark, folder):
    rows = _dpo(spark, folder, "keep_start")
    prompt = F.slice("chosen_input_ids", F.lit(1), F.size(F.filter("chosen_labels", lambda x: x == "-100")))
    return rows.select("pair_id", F.array_join(prompt, " ").alias("prompt"))


_PADDED = f"WITH b AS (SELECT row_id // 16 AS batch, row_id, input_ids, max(len(input_ids)) OVER (PARTITION BY row_id // 16) AS longest FROM {{sequences}} WHERE len(input_ids) <= 2048), p AS (SELECT *, CAST(ceil(longest / 8) * 8 AS BIGINT) AS width FROM b) "


def _padded(spark, folder):
    rows = views.sequences(spark, folder).where(F.size("input_ids") <= 2048).withColumn("batch", F.expr("row_id div 16"))
    rows = rows.withColumn("attention_mask", F.transform("input_ids", lambda _: F.lit(True))).withColumn("labels", F.col("input_ids"))
    return tokens.padded(rows, {"input_ids": 0, "labels": -100, "attention_mask": False}, multiple=8)


@query("pad_batches", _PADDED + "SELECT batch, row_id, CAST(width AS INTEGER) AS width, CAST(len(input_ids) AS INTEGER) AS filled, CAST(coalesce(list_sum(input_ids), 0) - 100 * (width - len(input_ids)) AS BIGINT) AS labels FROM p")
def pad_batches(spark, folder):
    total = F.aggregate("labels", F.lit(0).cast("bigint"), lambda a, x: a + x)
    filled = F.size(F.filter("attention_mask", lambda x: x))
    return _padded(spark, folder).select("batch", "row_id", F.size("input_ids").alias("width"), filled.alias("filled"), total.alias("labels"))


@query(
    "adjust_mask",
    _PADDED + ", f AS (SELECT batch, row_id, width - len(input_ids) AS z, len(input_ids) AS n, sum(len(input_ids)) OVER (PARTITION BY batch) AS total, sum(width - len(input_ids)) OVER (PARTITION BY batch) AS zeros,"
    " coalesce(sum(width - len(input_ids)) OVER (PARTITION BY batch ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p), m AS (SELECT *, CASE WHEN zeros >= (8 - total % 8) % 8 THEN (8 - total % 8) % 8 ELSE 0 END AS more FROM f)"
    " SELECT batch, row_id, CAST(n + least(z, greatest(more - before, 0)) AS INTEGER) AS filled FROM m",
)
def adjust_mask(spark, folder):
    rows = tokens.mask_rounded(_padded(spark, folder), order="row_id")
    return rows.select("batch", "row_id", F.size(F.filter("attention_mask", lambda x: x)).alias("filled"))


@query("chosen_and_rejected", _LENGTHS + "SELECT pair_id, CAST(0 AS INTEGER) AS side, CAST(p + c AS INTEGER) AS n FROM a UNION ALL SELECT pair_id, 1, CAST(p + r AS INTEGER) FROM a")
def chosen_and_rejected(spark, folder):
    return tokens.chosen_and_rejected(_dpo(spark, folder), "pair_id").select("pair_id", "side", F.size("input_ids").alias("n"))
