"""Token sequences: packing in order, masking of labels, truncation of preference pairs, padding of batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IGNORED = -100
BATCH_ROWS = 1024


def held(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Rows with a column worked out once a row: as the output of a generator it isn't put back into lambdas that read it for every element."""
    return rows.select(*(c for c in rows.columns if c != name), F.explode(F.array(value)).alias(name))


def chat_tokens(messages: Column) -> Column:
    """Words of a dialogue as tokens, each message between the markers of its role and its end."""
    words = lambda m: F.filter(F.split(F.coalesce(m["content"], F.lit("")), r"[ \t\n\r\f]+"), lambda w: w != "")
    return F.flatten(F.transform(messages, lambda m: F.concat(F.array(F.concat(F.lit("<|"), m["role"], F.lit("|>"))), words(m), F.array(F.lit("<|end|>")))))


def _placed(rows: DataFrame, by: tuple[str, ...], order: str, ids: str) -> DataFrame:
    """Rows with __n, their place __s in the batch's tokens and the batch's __total. A batch is a bounded number of rows."""
    batch = Window.partitionBy(*by)
    n = F.size(ids).cast("bigint")
    before = F.coalesce(F.sum("__n").over(batch.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("__n", n).withColumn("__s", before).withColumn("__total", F.sum("__n").over(batch))


def packed(rows: DataFrame, length: int, by: tuple[str, ...] = ("batch",), order: str = "pos", ids: str = "input_ids", drop_tail: bool = True) -> DataFrame:
    """(by..., chunk, input_ids, labels, cu_seqlens): each batch's sequences one after another, in chunks of a length.

    The last 1 to ``length`` tokens of a batch are dropped, or with drop_tail False kept as a shorter chunk. cu_seqlens
    are the places in the chunk at which sequences begin, one at the very start of a chunk being in the chunk before, and
    the chunk's length. Sequences are sent once, in the slices that chunks have of them.
    """
    placed = _placed(rows, by, order, ids)
    chunks = F.greatest(F.ceil(F.col("__total") / length) - (1 if drop_tail else 0), F.lit(0))
    placed = placed.withColumn("__chunks", chunks)
    first, last = F.floor(F.col("__s") / length), F.floor((F.col("__s") + F.col("__n") - 1) / length)
    parts = placed.where("__n > 0").withColumn("chunk", F.explode(F.sequence(first, last))).where("chunk < __chunks")
    start = F.greatest(F.col("chunk") * length, F.col("__s"))
    size = F.least((F.col("chunk") + 1) * length, F.col("__s") + F.col("__n")) - start
    part = F.slice(ids, (start - F.col("__s") + 1).cast("int"), size.cast("int"))
    pieces = parts.select(*by, "chunk", F.struct(start.alias("at"), part.alias("ids")).alias("piece")).groupBy(*by, "chunk").agg(F.sort_array(F.collect_list("piece")).alias("pieces"))
    tokens = pieces.select(*by, "chunk", F.flatten(F.transform("pieces", lambda x: x["ids"])).alias("input_ids"))
    starts = placed.where("__s > 0").withColumn("chunk", F.ceil(F.col("__s") / length) - 1).where("chunk < __chunks")
    offsets = starts.select(*by, "chunk", (F.col("__s") - F.col("chunk") * length).cast("int").alias("o")).groupBy(*by, "chunk").agg(F.sort_array(F.collect_list("o")).alias("offsets"))
    out = tokens.join(offsets, [*by, "chunk"], "left").withColumn("offsets", F.coalesce("offsets", F.array().cast("array<int>")))
    end = F.size("input_ids")
    closed = F.when(F.coalesce(F.try_element_at("offsets", F.lit(-1)), F.lit(-1)) == end, F.col("offsets")).otherwise(F.concat("offsets", F.array(end)))
    return out.select(*by, "chunk", "input_ids", F.col("input_ids").alias("labels"), closed.alias("cu_seqlens"))


def ends_of(ids: Column, pattern: list) -> Column:
    """Places just after each match of the pattern."""
    k = len(pattern)
    what = F.array(*map(F.lit, pattern))
    places = F.when(F.size(ids) >= k, F.sequence(F.lit(k), F.size(ids))).otherwise(F.array().cast("array<int>"))
    return F.filter(places, lambda i: F.slice(ids, i - (k - 1), k) == what)


def kept_spans(ids: Column, begin: list, end: list) -> Column:
    """Spans (p, q) of answers: from a beginning to an end, with neither another beginning nor end between; at one place beginnings come first."""
    event = lambda kind: lambda p: F.struct(p.alias("p"), F.lit(kind).alias("kind"))
    events = F.array_sort(F.concat(F.transform(ends_of(ids, begin), event(0)), F.transform(ends_of(ids, end), event(1))))
    nexts = F.slice(events, 2, F.greatest(F.size(events), F.lit(0)))
    pairs = F.filter(F.arrays_zip(events.alias("a"), nexts.alias("b")), lambda x: (x["a"]["kind"] == 0) & (x["b"]["kind"] == 1))
    return F.transform(pairs, lambda x: F.struct(x["a"]["p"].alias("p"), x["b"]["p"].alias("q")))


def masked_labels(rows: DataFrame, begin: list, end: list, ids: str = "input_ids", ignored=IGNORED) -> DataFrame:
    """Rows with labels: the tokens of complete answers, all others ignored."""
    kind = rows.schema[ids].dataType.elementType
    spans = held(held(rows, ids, F.col(ids)), "__spans", kept_spans(F.col(ids), begin, end))
    keep = lambda x, i: F.when(F.exists("__spans", lambda s: (i >= s["p"]) & (i < s["q"])), x).otherwise(F.lit(ignored).cast(kind))
    return held(spans, "labels", F.transform(ids, keep)).drop("__spans")


def mostly_learned(rows: DataFrame, most: float = 0.9, labels: str = "labels", ignored=IGNORED) -> DataFrame:
    """Rows of whose labels no more than that part is ignored."""
    kind = rows.schema[labels].dataType.elementType
    return rows.where(F.size(F.filter(labels, lambda x: x == F.lit(ignored).cast(kind))) <= most * F.size(labels))


def sft_rows(rows: DataFrame, length: int, begin: list | None = None, end: list | None = None, **how) -> DataFrame:
    """Packed sequences with masked labels, without those that are mostly masked."""
    out = packed(rows, length, **how)
    if begin is None:
        return out
    return mostly_learned(masked_labels(out.drop("labels"), begin, end))


def answer_split(full: Column, prompt: Column) -> Column:
    """Struct (prompt, answer) of the tokens of prompt and answer together; where the prompt's last token changed by merging, it is the answer's."""
    n = F.when(F.slice(full, F.lit(1), F.size(prompt)) == prompt, F.size(prompt)).otherwise(F.greatest(F.size(prompt) - 1, F.lit(0)))
    return F.struct(F.slice(full, F.lit(1), n).alias("prompt"), F.slice(full, n + 1, F.size(full)).alias("answer"))


def _last(a: Column, n: int) -> Column:
    return F.slice(a, F.greatest(F.size(a) - n + 1, F.lit(1)), n)


def dpo_rows(rows: DataFrame, bos, eos, max_length: int, max_prompt_length: int, keep: str = "keep_end", ignored=IGNORED) -> DataFrame:
    """Rows (prompt_ids, chosen_full, rejected_full, ...) with {chosen,rejected}_{input_ids,attention_mask,labels}.

    The _full columns are the tokens of prompt and answer together. bos is put before a prompt and eos after an answer
    that lack it; if prompt and longer answer exceed max_length the prompt is cut to max_prompt_length, at its end or
    its start, and answers that are still too long to the rest. valid is false where the two prompts differ in more than
    one token or in length by more than one.
    """
    if keep not in ("keep_start", "keep_end"):
        raise ValueError(f"unknown truncation {keep!r}")
    kind = rows.schema["prompt_ids"].dataType.elementType
    lit = lambda x: F.array(F.lit(x).cast(kind))
    begun = lambda a: F.when(F.coalesce(F.get(a, F.lit(0)) == F.lit(bos).cast(kind), F.lit(False)), a).otherwise(F.concat(lit(bos), a))
    ended = lambda a: F.when(F.coalesce(F.try_element_at(a, F.lit(-1)) == F.lit(eos).cast(kind), F.lit(False)), a).otherwise(F.concat(a, lit(eos)))
    out = rows.withColumns({f"__{s}": answer_split(F.col(f"{s}_full"), F.col("prompt_ids")) for s in ("chosen", "rejected")})
    cp, rp = F.col("__chosen.prompt"), F.col("__rejected.prompt")
    differ = F.size(F.filter(F.zip_with(F.slice(cp, F.lit(1), F.least(F.size(cp), F.size(rp))), F.slice(rp, F.lit(1), F.least(F.size(cp), F.size(rp))), lambda a, b: a != b), lambda x: x))
    out = out.withColumn("valid", (differ <= 1) & (F.abs(F.size(cp) - F.size(rp)) <= 1))
    out = out.withColumns({f"__{s}_{k}": f(F.col(f"__{s}.{k}")) for s in ("chosen", "rejected") for k, f in (("prompt", begun), ("answer", ended))})
    longer = F.greatest(F.size("__chosen_answer"), F.size("__rejected_answer"))
    out = out.withColumn("__longer", longer)
    short = lambda a: F.slice(a, 1, max_prompt_length) if keep == "keep_start" else _last(a, max_prompt_length)
    for s in ("chosen", "rejected"):
        p = F.col(f"__{s}_prompt")
        out = out.withColumn(f"__{s}_prompt", F.when(F.size(p) + F.col("__longer") > max_length, short(p)).otherwise(p))
        too_long = F.size(f"__{s}_prompt") + F.col("__longer") > max_length
        out = out.withColumn(f"__{s}_answer", F.when(too_long, F.slice(f"__{s}_answer", 1, max_length - max_prompt_length)).otherwise(F.col(f"__{s}_answer")))
        ids = F.concat(f"__{s}_prompt", f"__{s}_answer")
        out = out.withColumn(f"{s}_input_ids", ids).withColumn(f"{s}_attention_mask", F.transform(ids, lambda _: F.lit(True)))
        out = out.withColumn(f"{s}_labels", F.concat(F.array_repeat(F.lit(ignored).cast(kind), F.size(f"__{s}_prompt")), f"__{s}_answer"))
    return out.drop(*(c for c in out.columns if c.startswith("__")))


def padded_to(array: Column, length: Column, value) -> Column:
    """The array with the value added up to the length; longer ones stay."""
    return F.concat(array, F.array_repeat(value, F.greatest(length - F.size(array), F.lit(0)).cast("int")))


def padded(rows: DataFrame, columns: dict[str, object], by: tuple[str, ...] = ("batch",), multiple: int = 1) -> DataFrame:
    """Each column padded with its value to the longest of the batch, rounded up to a multiple."""
    batch = Window.partitionBy(*by)
    out = rows
    for c, value in columns.items():
        longest = F.max(F.size(c)).over(batch)
        kind = rows.schema[c].dataType.elementType
        out = out.withColumn(c, padded_to(F.col(c), F.ceil(longest / multiple) * multiple, F.lit(value).cast(kind)))
    return out


def mask_rounded(rows: DataFrame, mask: str = "attention_mask", by: tuple[str, ...] = ("batch",), order: str = "pos", multiple: int = 8) -> DataFrame:
    """The first false places of a batch set to true, row by row, until the true ones are a multiple; nothing where too few are false."""
    batch = Window.partitionBy(*by)
    false = F.filter(F.transform(mask, lambda x, i: F.when(~x, i)), lambda x: x.isNotNull())
    out = rows.withColumn("__false", false).withColumn("__more", F.pmod(-F.sum(F.size(mask) - F.size("__false")).over(batch), F.lit(multiple)))
    before = F.coalesce(F.sum(F.size("__false")).over(batch.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = out.withColumn("__more", F.when(F.sum(F.size("__false")).over(batch) >= F.col("__more"), F.col("__more")).otherwise(F.lit(0))).withColumn("__before", before)
    flips = F.least(F.size("__false"), F.greatest(F.col("__more") - F.col("__before"), F.lit(0)).cast("int"))
    out = held(out, "__upto", F.coalesce(F.get("__false", flips - 1), F.lit(-1)))
    return out.withColumn(mask, F.transform(mask, lambda x, i: x | (i <= F.col("__upto")))).select(rows.columns)


def combined_offsets(rows: DataFrame, by: tuple[str, ...] = ("batch",), order: str = "pos", offsets: str = "cu_seqlens") -> DataFrame:
    """(by..., cu_seqlens): one row a batch, with all offsets after one another from 0 on."""
    last = F.coalesce(F.try_element_at(offsets, F.lit(-1)), F.lit(0))
    before = F.coalesce(F.sum(last).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    moved = rows.withColumn("__b", before).select(*by, F.struct(F.col(order).alias("at"), F.transform(offsets, lambda x: (x + F.col("__b")).cast("int")).alias("o")).alias("x"))
    joined = F.flatten(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["o"]))
    return moved.groupBy(*by).agg(F.concat(F.array(F.lit(0)), joined).alias("cu_seqlens"))


def stacked(rows: DataFrame, by: tuple[str, ...] = ("batch",), ids: str = "input_ids", mask: str | None = None) -> DataFrame:
    """(by..., rows, length): checks that all sequences of a batch are as long and none is padded; fails otherwise."""
    full = F.lit(True) if mask is None else F.forall(mask, lambda x: x)
    sizes = rows.groupBy(*by).agg(F.count("*").alias("rows"), F.min(F.size(ids)).alias("length"), F.max(F.size(ids)).alias("__most"), F.min(full).alias("__full"))
    ok = F.assert_true((F.col("length") == F.col("__most")) & F.col("__full"), F.lit("sequences of a batch differ in length or are padded"))
    return sizes.withColumn("__ok", ok).where("__ok is null").drop("__ok", "__most", "__full")


def chosen_and_rejected(rows: DataFrame, key: str, columns: tuple[str, ...] = ("input_ids", "labels", "attention_mask")) -> DataFrame:
    """(key, side, columns...): a batch's chosen sequences, side 0, with its rejected ones, side 1, to be padded together."""
    sides = [rows.select(key, F.lit(i).alias("side"), *(F.col(f"{s}_{c}").alias(c) for c in columns)) for i, s in enumerate(("chosen", "rejected"))]
    return sides[0].unionByName(sides[1])
