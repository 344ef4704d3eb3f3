"""Pairs of a train and a held-out row with the same or almost the same prompt.

The words of all prompts make one text, whose suffixes at words are sorted in partitions by their first words: a suffix
array. Neighbours with a long common prefix form runs, in which suffixes of both splits reveal spans that their prompts
share at about the same place. The spans of two prompts are merged into how much of them they cover: M words with
M // 8 errors keep so many places at which a span of several words begins. Prompts that are covered so far are compared
with a banded edit distance. Copies of a prompt are one prompt here.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftspark.llm.words import words
from weftspark.session import checkpointed

WORDS_AN_ERROR = 8
#: Words that the span has at least: M - M // 8 equal words lie in at most M // 8 + 1 runs.
LONG, LONG_SPAN, SHORT_SPAN = 24, 6, 4
#: Words of a suffix that it is sorted by; prefixes in common are measured up to these.
KEY_WORDS = 8
#: Suffixes of a run and split that one task has at once; longer runs are divided.
RUN_ROWS = 20_000
#: Pairs of suffixes that are looked at together.
BLOCK = 1 << 20
PLACEHOLDER = r"(?i)^\s*(none|null|nil|nan|n/?a|undefined|unknown|0+|[^\p{L}\p{N}]*)\s*$"


def signature(w: list[str]) -> int:
    """A bit for each word, out of 64."""
    bits = 0
    for x in w:
        bits |= 1 << (xxhash.xxh3_64_intdigest(x) & 63)
    return bits - (bits >> 63 << 64)


def spans(w: list[str]) -> list[tuple[str, int, int]]:
    """(first words, words of a span, position) of each suffix; texts about LONG words long are looked at both ways."""
    n = len(w)
    sizes = [(SHORT_SPAN, "s ")] * (SHORT_SPAN <= n < LONG) + [(LONG_SPAN, "l ")] * (n >= LONG - LONG // WORDS_AN_ERROR)
    return [(kind + " ".join(w[i : i + KEY_WORDS]), q, i) for q, kind in sizes for i in range(n + 1 - q)]


def least_places(n: int, q: int) -> int:
    """Places at which q equal words begin in a text of n words and another that has an eighth of them altered, dropped or added."""
    errors = n // WORDS_AN_ERROR
    return max(1, n - errors - (errors + 1) * (q - 1))


def near(a: list[str], b: list[str]) -> bool:
    """Whether at most one word in eight of the longer is altered, dropped or added."""
    n, m = len(a), len(b)
    most = max(n, m) // WORDS_AN_ERROR
    if abs(n - m) > most:
        return False
    far = most + 1
    last = [j if j <= most else far for j in range(m + 1)]
    for i in range(1, n + 1):
        row = [far] * (m + 1)
        if i <= most:
            row[0] = i
        x = a[i - 1]
        for j in range(max(1, i - most), min(m, i + most) + 1):
            row[j] = min(last[j - 1] + (x != b[j - 1]), last[j] + 1, row[j - 1] + 1)
        if min(row) > most:
            return False
        last = row
    return last[m] <= most


def _prompts(batches):
    """Adds the words as one text and its digest; both null without words."""
    for batch in batches:
        texts = [" ".join(words(t.as_py())) or None for t in batch.column("prompt")]
        digests = [t and xxhash.xxh3_128_digest(t) for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column("pair_id"), batch.column("held"), pa.array(digests, pa.binary()), pa.array(texts, pa.string())], names=["pair_id", "held", "gid", "words"])


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, runs, keys, places, signs, sizes = array("q"), array("q"), [], array("i"), array("q"), array("i")
        for k, t in enumerate(batch.column("words")):
            w = t.as_py().split(" ")
            sign = signature(w)
            for key, q, i in spans(w):
                at.append(k)
                runs.append(xxhash.xxh3_64_intdigest(key[:2] + " ".join(w[i : i + q])) - 2**63)
                keys.append(key)
                places.append(i)
                signs.append(sign)
                sizes.append(len(w))
        kept = batch.take(pa.array(at, pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [kept.column("gid"), kept.column("in_held"), kept.column("in_train"), pa.array(runs, pa.int64()), pa.array(keys, pa.string()), pa.array(places, pa.int32()), pa.array(signs, pa.int64()), pa.array(sizes, pa.int32())],
            names=["gid", "in_held", "in_train", "run", "key", "pos", "sign", "n"],
        )


def common_words(a: str, b: str) -> int:
    """Words at the beginning that two keys of one kind share."""
    if a[:2] != b[:2]:
        return 0
    n = 0
    for x, y in zip(a[2:].split(" "), b[2:].split(" ")):
        if x != y:
            break
        n += 1
    return n


def _cross(held: dict[str, np.ndarray], train: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of held and train suffixes of a run whose prompts may be almost the same, in blocks."""
    step = max(1, BLOCK // max(1, len(train["n"])))
    for at in range(0, len(held["n"]), step):
        h = {k: v[at : at + step, None] for k, v in held.items()}
        most = np.maximum(h["n"], train["n"]) // WORDS_AN_ERROR
        good = (np.abs(h["n"] - train["n"]) <= most) & (np.abs(h["pos"] - train["pos"]) <= most)
        good &= np.bitwise_count(h["sign"] ^ train["sign"]) <= 2 * most
        a, b = np.nonzero(good)
        yield a + at, b


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(held_gid, train_gid, span) for places at which both prompts have a span, from sorted suffixes of a partition."""
    names = ["held_gid", "train_gid", "span"]
    rest: pa.Table | None = None

    def whole(table: pa.Table, ends: bool) -> tuple[list[pa.RecordBatch], pa.Table | None]:
        table = table.combine_chunks()
        keys, run = table.column("key").to_pylist(), table.column("run").to_numpy()
        cut = np.flatnonzero(np.diff(run)) + 1
        spans_ = np.array([LONG_SPAN if k[0] == "l" else SHORT_SPAN for k in keys]) if keys else np.empty(0, int)
        # neighbours of one hash whose keys have too few words in common aren't of one run
        odd = [i for i in range(1, len(keys)) if run[i] == run[i - 1] and keys[i] != keys[i - 1] and common_words(keys[i - 1], keys[i]) < spans_[i]]
        starts = np.unique(np.concatenate([[0], cut, odd])).astype(int)
        last = len(keys) if ends else int(starts[-1])
        gids = table.column("gid")
        own = {c: table.column(c).to_numpy() for c in ("n", "pos", "sign")}
        held, train = (table.column(c).to_numpy(zero_copy_only=False) for c in ("in_held", "in_train"))
        left, right, span = [], [], []
        for a, b in zip(starts, [*starts[1:], len(keys)]):
            if a >= last or b - a < 2 or not (held[a:b].any() and train[a:b].any()):
                continue
            hs, ts = np.flatnonzero(held[a:b]) + a, np.flatnonzero(train[a:b]) + a
            for x, y in _cross({c: v[hs] for c, v in own.items()}, {c: v[ts] for c, v in own.items()}):
                left.append(hs[x])
                right.append(ts[y])
                span.append(np.full(len(x), spans_[a]))
        out = []
        if left:
            l, r, q = np.concatenate(left), np.concatenate(right), np.concatenate(span)
            for i in range(0, len(l), 100_000):
                part = slice(i, i + 100_000)
                out.append(pa.RecordBatch.from_arrays([gids.take(pa.array(l[part])).combine_chunks(), gids.take(pa.array(r[part])).combine_chunks(), pa.array(q[part], pa.int32())], names=names))
        return out, None if ends else table.slice(last)

    for batch in batches:
        table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        if table.num_rows:
            out, rest = whole(table, False)
            yield from out
    if rest is not None and rest.num_rows:
        yield from whole(rest, True)[0]


def _near(batches):
    for batch in batches:
        good = []
        for span, places, a, b in zip(*(batch.column(c).to_pylist() for c in ("span", "places", "held_words", "train_words"))):
            a, b = a.split(" "), b.split(" ")
            good.append(places >= least_places(max(len(a), len(b)), span) and near(a, b))
        kept = batch.filter(pa.array(good, pa.bool_()))
        yield pa.RecordBatch.from_arrays([kept.column("held_gid"), kept.column("train_gid")], names=["held_gid", "train_gid"])


def cross_split_pairs(pairs: DataFrame) -> DataFrame:
    """(held_id, train_id) of every validation or test row and train row with one record.

    A pair_id counts once; rows with a null pair_id or another split aren't looked at. Prompts without a word are like
    no other; a null or placeholder prompt_id is equal to none.
    """
    rows = pairs.where("pair_id is not null and split in ('train', 'validation', 'test')").select("pair_id", (F.col("split") != "train").alias("held"), "prompt_id", "prompt").dropDuplicates(["pair_id"])
    texts = rows.where("prompt is not null").select("pair_id", "held", "prompt").mapInArrow(_prompts, "pair_id bigint, held boolean, gid binary, words string").where("gid is not null")
    prompts = checkpointed(texts.groupBy("gid").agg(F.first("words").alias("words"), F.max("held").alias("in_held"), F.max(~F.col("held")).alias("in_train")))

    kind = "gid binary, in_held boolean, in_train boolean, run bigint, key string, pos int, sign bigint, n int"
    suffixes = prompts.select("gid", "in_held", "in_train", "words").mapInArrow(_suffixes, kind)
    # runs without suffixes of both splits tell nothing; long ones are divided on both sides, every part of one meeting every part of the other
    sizes = suffixes.groupBy("run").agg(F.sum(F.col("in_held").cast("int")).alias("h"), F.sum(F.col("in_train").cast("int")).alias("t")).where("h > 0 and t > 0")
    parts = sizes.select("run", F.ceil(F.col("h") / RUN_ROWS).cast("int").alias("rows"), F.ceil(F.col("t") / RUN_ROWS).cast("int").alias("columns"))
    sides = suffixes.join(parts, "run").withColumn("row", F.pmod(F.xxhash64("gid"), F.col("rows")).cast("int")).withColumn("column", F.pmod(F.xxhash64("gid"), F.col("columns")).cast("int"))
    across = F.when(F.col("in_held"), F.transform(F.sequence(F.lit(0), F.col("columns") - 1), lambda c: F.col("row") * F.col("columns") + c)).otherwise(F.array().cast("array<int>"))
    down = F.when(F.col("in_train"), F.transform(F.sequence(F.lit(0), F.col("rows") - 1), lambda r: r * F.col("columns") + F.col("column"))).otherwise(F.array().cast("array<int>"))
    placed = sides.withColumn("part", F.explode(F.array_union(across, down)))
    placed = placed.withColumn("in_held", F.col("in_held") & (F.floor(F.col("part") / F.col("columns")) == F.col("row"))).withColumn("in_train", F.col("in_train") & (F.col("part") % F.col("columns") == F.col("column")))
    array_ = placed.select("gid", "in_held", "in_train", "run", "part", "key", "pos", "sign", "n").repartition("run", "part").sortWithinPartitions("run", "part", "key")
    shared = array_.select("gid", "in_held", "in_train", F.xxhash64("run", "part").alias("run"), "key", "pos", "sign", "n").mapInArrow(_runs, "held_gid binary, train_gid binary, span int")
    places = shared.where("held_gid != train_gid").groupBy("held_gid", "train_gid", "span").agg(F.count("*").alias("places"))
    text = lambda name: prompts.where(f"in_{name}").select(F.col("gid").alias(f"{name}_gid"), F.col("words").alias(f"{name}_words"))
    almost = places.join(text("held"), "held_gid").join(text("train"), "train_gid").mapInArrow(_near, "held_gid binary, train_gid binary").distinct()
    same = prompts.where("in_held and in_train").select(F.col("gid").alias("held_gid"), F.col("gid").alias("train_gid"))
    held = texts.where("held").select(F.col("gid").alias("held_gid"), F.col("pair_id").alias("held_id"))
    train = texts.where("not held").select(F.col("gid").alias("train_gid"), F.col("pair_id").alias("train_id"))
    by_prompt = almost.unionAll(same).join(held, "held_gid").join(train, "train_gid").select("held_id", "train_id")

    known = rows.where(F.col("prompt_id").isNotNull() & ~F.col("prompt_id").rlike(PLACEHOLDER))
    key = lambda name, where: known.where(where).select("prompt_id", F.col("pair_id").alias(f"{name}_id"), F.col("prompt").isNull().alias(f"{name}_null"))
    by_id = key("held", "held").join(key("train", "not held"), "prompt_id").where("held_null or train_null").select("held_id", "train_id")
    return by_prompt.unionAll(by_id).distinct()


def cross_split_report(pairs: DataFrame) -> DataFrame:
    """(split, source, n_rows, n_leaked, n_pairs) of the validation and test rows."""
    rows = pairs.where("split in ('validation', 'test')").dropDuplicates(["pair_id"]).select("split", F.col("dataset_mix_source").alias("source"), F.col("pair_id").alias("held_id"))
    counts = cross_split_pairs(pairs).groupBy("held_id").agg(F.count("*").alias("n"))
    return rows.join(counts, "held_id", "left").groupBy("split", "source").agg(F.count("*").alias("n_rows"), F.count("n").alias("n_leaked"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_pairs"))
